import random
import zlib

import numpy as np

from skylattice.llm import langid
from tests.llm.cases import DOCS, docs

SYLLABLES = {"aa": ["the", "ing", "and", "er", "on"], "bb": ["ein", "ung", "sch", "ich", "zu"], "cc": ["ción", "que", "los", "ado", "ñe"]}


def _rows(n, start=0):
    r = random.Random(start + 3)
    out = []
    for i in range(n):
        lang = r.choice(sorted(SYLLABLES))
        words = ["".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(r.randint(8, 40))]
        out.append((start + i, " ".join(words).capitalize(), lang, "s", 1))
    return out


def test_held_out_accuracy(spark):
    rows = _rows(200)
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, rows)).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == {x[0] for x in held} and held
    assert sum(got[x[0]]["lang_pred"] == x[2] for x in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_awkward_rows(spark):
    got = langid.identify(docs(spark, DOCS + _rows(30, 1000))).collect()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {2, 3, 5, 7, None} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert len(got) == len(DOCS) + 30


def test_nothing_to_learn(spark):
    assert langid.identify(docs(spark, [])).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs(spark, [(0, "some text", None, None, 1)])).collect()} == {"und"}


def test_products_equal_bundles():
    texts = ["Hello world, hello words", "ünder größe", "x"]
    prototypes = np.stack([langid.bundle(np.bincount(next(langid._trigrams([t]))[0], minlength=langid.LETTERS**3)) for t in texts])
    products = langid.trigram_products(prototypes)
    for i, t in enumerate(texts):
        grams, _ = next(langid._trigrams([t]))
        own = prototypes[i]
        for k, p in enumerate(prototypes):
            assert abs(products[grams, k].sum() - own @ p / np.linalg.norm(p)) < 1e-2 * np.linalg.norm(own)


def test_identified_keeps_clean_documents(spark):
    rows = _rows(60) + [(900, "123 456", "aa", "s", 1), (901, None, "aa", "s", 1)]
    out = langid.identified(docs(spark, rows))
    assert {r["doc_id"] for r in out.collect()} == {x[0] for x in rows[:60]} and out.columns == docs(spark, rows).columns
