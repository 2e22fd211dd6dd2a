import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from skylattice.llm import merkle
from tests.llm.cases import DOCS, docs


def _expected(rows):
    texts = sorted(((i, t or "") for i, t in rows), key=lambda x: -x[0])
    out = {}
    for at, (i, text) in enumerate(texts):
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(at + 1) % len(texts)][1][:half]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest())
    return out


def test_edits_of_unique_ids(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(["One. Two.", None, "", "é😀x" * 50, "a\n\nb\n# c\nd", "Same line.\nOther line.", "x" * 5000])]
    rows += [(-5, "negative", None, None, None), (2**62, "huge. And more of it. And even more.", None, None, None)]
    got = merkle.edited_fingerprints(docs(spark, rows).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == _expected([r[:2] for r in rows])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_awkward_rows(spark):
    got = merkle.edited_fingerprints(docs(spark)).collect()
    assert len(got) == len(DOCS) and sum(r["doc_id"] is None for r in got) == 2
    by_text = {}
    for r in merkle.fingerprints(docs(spark)).collect():
        by_text.setdefault(r["root"], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len(by_text) == len({t or "" for _, t, *_ in DOCS})
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1


def test_one_row_and_none(spark):
    one = merkle.edited_fingerprints(docs(spark, [(9, "abcd", None, None, None)])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1.0
    assert merkle.edited_fingerprints(docs(spark, [])).collect() == []


def test_differing_branches_locate_edits(spark):
    a = "intro\n\nfirst. part\nsecond\n\n# third\nfourth"
    b = a.replace("second", "edited").replace("fourth", "changed")
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    out = row.select(merkle.edits(F.col("a"), F.col("b")).alias("e"), merkle.edits(F.col("a"), F.col("a")).alias("none"), F.size("a.sections").alias("n")).first()
    assert out["none"] == [] and out["n"] == 3
    assert [tuple(x) for x in out["e"]] == [(1, 1), (2, 1)]


def test_pieces_make_up_the_paragraph(spark):
    texts = ["One two. Three four five six seven eight nine ten eleven.  ", " lead", "", "   ", "x" * 300, "a b c d e f g h i j"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", F.array_join(F.regexp_extract_all("t", F.lit(merkle.PIECE), F.lit(0)), "").alias("p")).collect()
    assert all(r["t"] == r["p"] for r in got)


def _leaves(paragraph):
    patterns = [merkle.PIECE] * (len(paragraph) >= merkle.SHORT) + [merkle.WORD_PIECE] * (len(paragraph) < 2 * merkle.SHORT)
    return [xxhash.xxh64_intdigest(m.group().encode(), 42) >> 32 for p in patterns for m in re.finditer(p, paragraph, re.A)]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _fingerprint(text):
    """The fingerprint and the set of leaves, written down plainly."""
    lines, sections = text.split("\n"), []
    for i, line in enumerate(lines):
        if i == 0 or line.startswith("#") or lines[i - 1].strip(" ") == "":
            sections.append([])
        sections[-1].append(line)
    nodes = [_sha("".join(_sha(p) for p in s)) for s in sections]
    inner = lambda s: ",".join(f"{_sha(p)[:16]}={''.join(f'{x:08x}' for x in _leaves(p))}" for p in s)
    made = _sha("".join(nodes)) + ":" + ";".join(f"{n[:16]}/{inner(s)}" for n, s in zip(nodes, sections))
    return made, {x for line in lines for x in _leaves(line)}


def _dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_trees_and_likeness_against_brute_force(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 9)))
    line = lambda: " ".join(word() + r.choice(["", "", ".", "!"]) for _ in range(r.randrange(0, 40)))
    texts = ["\n".join(r.choice(["", "# ", "#"]) + line() for _ in range(r.randrange(1, 8))) for _ in range(60)] + ["", "one", "a b. c", "  "]
    got = {x["doc_id"]: x for x in merkle.edited_fingerprints(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        other = texts[i - 1]  # the next in descending order; after 0 comes the last
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        (a, x), (b, y), (_, z) = map(_fingerprint, (text, edited, other))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (a, b)
        assert abs(got[i]["near_edited"] - _dice(x, y)) < 1e-12 and abs(got[i]["near_next"] - _dice(x, z)) < 1e-12


def test_edits_of_short_texts_stay_alike(spark):
    texts = ["The cat sat down.", "A bird sang in a tree", "ab cd", "Nobody knew what it was or where it came from at all", "It rains."]
    for r in merkle.edited_fingerprints(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect():
        assert r["near_edited"] > 0.3 and r["near_next"] < r["near_edited"]
