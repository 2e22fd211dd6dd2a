"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram of letters is bound from the vectors of its letters, the
first permuted twice and the second once, by multiplying them; the trigrams of a text are bundled by adding them, and
so are the texts of a language into its prototype. A text has the language whose prototype has the largest cosine
with its bundle. Words are padded with a space letter on both sides; letters are lower-cased.

Binding is linear in the counts, so the product of a bundle and a prototype is the sum over the text's trigrams of
that trigram's product with the prototype; these products are a table of letters^3 times languages, made once. The
text's own norm is the same for all languages, so it is left out of the comparison and of the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Letters share this many vectors; number 0 is the space.
LETTERS = 64
DIMENSIONS = 2048
SEED = 20_240_501


def _letter_numbers() -> np.ndarray:
    """The vector's number of every code point: 0 for all that isn't a letter."""
    table = np.zeros(0x110000, np.uint8)
    points = np.fromiter((i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()), np.int64)
    lower = np.fromiter((ord(chr(i).lower()[0]) for i in points), np.int64, len(points))
    number = 27 + (lower * 2654435761 % 2**32) % (LETTERS - 27)
    plain = (lower >= 97) & (lower <= 122)
    number[plain] = lower[plain] - 96
    table[points] = number
    return table


_TABLE: list[np.ndarray] = []


def letter_numbers() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_numbers())
    return _TABLE[0]


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))


def _pairs(dimensions: int) -> np.ndarray:
    """For each pair of first two letters, their bound vectors; one row a pair."""
    v = letter_vectors(dimensions)
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return (first[:, None, :] * second[None, :, :]).reshape(LETTERS * LETTERS, dimensions)


def bundle(counts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundle of trigrams with these counts (letters^3 of them)."""
    third = counts.reshape(LETTERS * LETTERS, LETTERS).astype(np.float64) @ letter_vectors(dimensions).astype(np.float64)
    return (third * _pairs(dimensions)).sum(0)


def trigram_products(prototypes: np.ndarray) -> np.ndarray:
    """letters^3 times languages: each trigram's product with each prototype, which is scaled to length 1."""
    dimensions = prototypes.shape[1]
    v, pairs = letter_vectors(dimensions).astype(np.float32), _pairs(dimensions).astype(np.float32)
    out = [pairs @ (v * (p / (np.linalg.norm(p) or 1)).astype(np.float32)).T for p in prototypes]
    return np.stack([x.reshape(-1) for x in out], axis=1)


_BLOCK = 1 << 20


def _trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(trigram numbers, which text each belongs to), for as many texts at a time as make a block of letters."""
    table, at = letter_numbers(), 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or "") < _BLOCK):
            size += len(texts[end] or "")
            end += 1
        points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts[at:end]]
        lengths = np.fromiter((len(p) + 2 for p in points), np.int64, len(points))
        letters = np.zeros(int(lengths.sum()), np.int32)
        for start, p in zip(np.cumsum(lengths) - lengths, points):
            letters[start + 1 : start + 1 + len(p)] = table[p]
        a, b, c = letters[:-2], letters[1:-1], letters[2:]
        kept = np.flatnonzero(b)  # the middle one is a letter; a space at either side ends the word
        owner = np.repeat(np.arange(at, end), lengths)[kept + 1]
        yield (a[kept] * LETTERS + b[kept]) * LETTERS + c[kept], owner
        at = end


#: Languages whose trigrams a task counts before it bundles them.
HELD_LANGUAGES = 64


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 1 when divided by 3; null ids don't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, max_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from all documents with a language that aren't held out.

    Each task bundles its rows into one vector a language, counting ``HELD_LANGUAGES`` at a time; bundles add up. The
    driver gets ``dimensions`` numbers for each of at most ``max_languages`` languages; more raise, as every task holds
    a prototype of each.
    """
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def bundled(counts: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, held in counts.items():
            yield pd.DataFrame({"lang": lang, "at": np.arange(dimensions), "value": bundle(held, dimensions)})

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                held = counts.setdefault(lang, np.zeros(LETTERS**3, np.int64))
                for grams, _ in _trigrams(part["text"].tolist()):
                    held += np.bincount(grams, minlength=LETTERS**3)
            if len(counts) > HELD_LANGUAGES:
                yield from bundled(counts)
                counts.clear()
        yield from bundled(counts)

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("value", T.DoubleType())])
    summed = (
        rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInPandas(bundles, schema)
        .groupBy("lang", "at")
        .agg(F.sum("value").alias("value"))
    )
    found = summed.toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    prototypes = np.zeros((len(languages), dimensions))
    if languages:
        number = {x: i for i, x in enumerate(languages)}
        prototypes[found["lang"].map(number).to_numpy(), found["at"].to_numpy()] = found["value"].to_numpy()
    return languages, prototypes


def predictor(languages: list[str], prototypes: np.ndarray):
    """A pandas UDF from text to (lang_pred, score)."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        products = trigram_products(prototypes) if languages else np.zeros((LETTERS**3, 1), np.float32)
        names = np.array([*languages, UNKNOWN], object)
        for part in parts:
            cosines, seen = np.zeros((len(part), products.shape[1])), np.zeros(len(part), np.int64)
            for grams, owner in _trigrams(part.tolist()):
                seen += np.bincount(owner, minlength=len(part))
                for k in range(products.shape[1]):
                    cosines[:, k] += np.bincount(owner, products[grams, k], len(part))
            best = np.where(seen > 0, cosines.argmax(1), len(languages)) if languages else np.zeros(len(part), np.int64)
            positive = np.maximum(cosines, 0)
            score = np.divide(positive.max(1), positive.sum(1), out=np.zeros(len(part)), where=(positive.sum(1) > 0) & (seen > 0))
            yield pd.DataFrame({"lang_pred": names[best], "score": np.minimum(score, 1.0)})

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``lang_pred`` and ``score``.

    The score is the best cosine's share of all positive cosines: 1 if no other language is like the text at all.
    Null texts and texts without a letter get ``und`` and 0, and so do all texts if there is nothing to learn from.
    Equal cosines: the first language by code point. Repeated rows are each predicted; an empty table gives no rows;
    null ids are learned from. Other columns are not looked at.
    """
    languages, prototypes = learn(docs, id_col, text_col, lang_col)
    predict = predictor(languages, prototypes)
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col)).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")


def identified(docs: DataFrame, min_gain: float = 1.2, text_col: str = "text", **columns) -> DataFrame:
    """The documents whose language is known, all their columns kept.

    Rejected are those without a letter, and those whose score isn't ``min_gain`` times the share that each language
    would have if all were equally like the text. Nulls and ties: see ``identify``.
    """
    languages, prototypes = learn(docs, text_col=text_col, **columns)
    if not languages:
        return docs.where(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    least = min(1.0, min_gain / len(languages))
    found = docs.withColumn("__language", predictor(languages, prototypes)(F.col(text_col)))
    kept = (F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= least)
    return found.where(kept).drop("__language")
