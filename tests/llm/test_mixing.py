import random
import re

import pytest

from skylattice.llm import mixing
from tests.llm.cases import DOCS, docs


def _targets(sizes):
    """Brute force: share by weight, cut at twice the size, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def _rows(seed, n=400):
    r = random.Random(seed)
    return [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 30, 200]))), "en", r.choice(["a", "a", "a", "b", "c", "d", None, "é"]), 1) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_are_met(spark, seed):
    rows = _rows(seed)
    got = mixing.mix(docs(spark, rows).repartition(5)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    sizes, taken = {}, {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    expected = _targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and abs(r["target"] - expected[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    again = mixing.mix(docs(spark, rows[::-1]).coalesce(1)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_quality_counts(spark):
    rows = [(i, "one two three four", "en", "ab"[i % 2], 1) for i in range(2000)]
    quality = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(2000)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = mixing.mix(docs(spark, rows), quality).where("target < 2 * source_size").collect()
    partly = {q: sum(r["taken"] % 4 == 0 and r["taken"] > 0 for r in got if (r["doc_id"] % 4 < 2) == q) for q in (True, False)}
    assert partly[True] >= partly[False]


def test_key_order_is_that_of_the_buckets(spark):
    rows = _rows(9, 200)
    whole = mixing.mix(docs(spark, rows), buckets=1).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, mixing.mix(docs(spark, rows), buckets=64).collect()))


def test_awkward_rows(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(DOCS) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(docs(spark, [])).collect() == []
    empty = mixing.mix(docs(spark, [(1, None, None, "a", 0), (2, "", None, "b", 0)])).collect()
    assert [(r["taken"], r["target"]) for r in empty] == [(0, 0.0), (0, 0.0)]


def test_mixed_documents(spark):
    out = mixing.mixed(docs(spark))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.columns[-1] == "taken"
    assert all(r["taken"] > 0 for r in out.collect())


def test_only_functions(spark):
    plan = mixing.mix(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
