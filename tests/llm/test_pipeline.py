import os
import random

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from skylattice.llm import queries
from tests.llm.cases import docs

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    before, columns = rows.count(), rows.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DATA).persist()
        assert 0 < rows.count() <= before, name
        assert rows.columns[:5] == columns and (name == "mix" or rows.columns == columns)
        before = rows.count()
    assert corpus_pipeline.run(spark, DATA).count() == before


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_awkward_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs(spark), docs(spark, [])):
            assert stage(spark, rows, DATA).count() <= rows.count(), name


def _words(r, n, letters):
    return [("".join(r.choice(letters) for _ in range(r.randrange(2, 8)))) for _ in range(n)]


def _alike(a, b):
    sets = []
    for t in (a, b):
        words = t.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def _planted():
    """Documents of two made-up languages, and what each stage must do with them by brute force."""
    r, rows, bad, near, leaks, private = random.Random(12), [], set(), {}, set(), {}
    items = [(i, f"If {a} has {r.randrange(3, 40)} apples and gives {r.randrange(1, 3)} of them to {b} then how many apples does {a} keep in the end?")
             for i, (a, b) in enumerate([("Alice", "Bob"), ("Carla", "Dan")])]
    for i in range(160):
        lang, letters = ("xx", "aeioulmn") if i % 2 else ("yy", "bcdgkrstuy")
        text, kind = " ".join(_words(r, r.randrange(60, 200), letters)), i % 16
        if kind == 3:
            text = r.choice(["123 456", "", "!!! ---", None])
            bad.add(i)
        elif kind == 5:
            j = r.choice([k for k in range(i) if k % 16 in (0, 1, 2)])
            words = rows[j][1].split()
            if i % 32 == 5:
                words[r.randrange(len(words))] = "Changed"
            text, lang = " ".join(words), rows[j][2]
            assert _alike(text, rows[j][1]) >= 0.8
            near[i] = j
        elif kind == 7:
            text += ". " + items[i % 2][1].replace("Alice", "Zoe").replace("Carla", "Yan") + " " + text[:50]
            leaks.add(i)
        elif kind == 9:
            text += f" ann.{i}@mail.example.org {text[:40]}"
            private[i] = text.replace(f"ann.{i}@mail.example.org", "[EMAIL]")
        rows.append((i, text, lang, ("s1", "s2", None)[i % 3], None if text is None else len(text)))
    return items, rows, bad, near, leaks, private


def test_run_against_brute_force(spark, tmp_path):
    items, rows, bad, near, leaks, private = _planted()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 160, 7)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    expected, docs_now = [], spark.createDataFrame(rows, schema)
    left = {i for i, *_ in rows}
    for gone in (bad, set(near), leaks, set()):
        left = left - gone
        expected.append(set(left))
    for (name, stage), ids in zip(corpus_pipeline.STAGES, expected):
        docs_now = spark.createDataFrame(stage(spark, docs_now, str(tmp_path)).collect(), schema)
        assert {x["doc_id"] for x in docs_now.collect()} == ids, name
    texts = {x["doc_id"]: x["text"] for x in docs_now.collect()}
    assert texts == {i: private.get(i, t) for i, t, *_ in rows if i in left}
    final = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) <= left and all(final[i]["text"] == texts[i] for i in final)
    # Shares of the words by source: weights 3 and 1 by code point, null last with 2.
    size, taken = {}, {}
    for i in left:
        source = rows[i][3]
        size[source] = size.get(source, 0) + len(texts[i].split())
        taken[source] = taken.get(source, 0) + (final[i]["taken"] if i in final else 0)
        assert i not in final or 0 < final[i]["taken"] <= 2 * len(texts[i].split())
    target, weight = dict.fromkeys(size, 0.0), {"s1": 3, "s2": 1, None: 2}
    open_, rest = set(size), 1.5 * sum(size.values())
    while open_ and rest > 1e-9:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] + share[s] > 2 * size[s]}
        if not over:
            target |= {s: target[s] + share[s] for s in open_}
            break
        for s in over:
            rest -= 2 * size[s] - target[s]
            target[s] = 2.0 * size[s]
        open_ -= over
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in size), (taken, target)


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())
