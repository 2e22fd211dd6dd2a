"""Rows that every operator must take: nulls, empty and long texts, repeats, extra columns with clashing names."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet. " * 8000
DOCS = [
    (1, "The cat sat on the mat and looked at the moon.", "en", "a", 46),
    (1, "The cat sat on the mat and looked at the moon.", "en", "a", 46),
    (2, "", "en", "b", 0),
    (3, None, None, None, None),
    (4, LONG, "la", "b", len(LONG)),
    (5, "12345 678 !!", "en", "a", 12),
    (None, "A text without a number of its own, but long enough.", "en", None, 50),
    (None, None, None, None, None),
    (6, "é😀   x\ty\r\nz", None, "", 10),
    (7, "   \n\t ", "en", "c", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = (
    "fingerprint component_id score lang_pred held_out taken target size spans n_tokens n_bytes root row key fp contaminated ident "
    "__kept label u v tree edited quality source_size bucket q_id p"
).split()


def docs(spark, rows=None, clash=True):
    df = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("?") for c in CLASHING}) if clash else df


def key(rows, *columns):
    return sorted(([r[c] for c in columns] for r in rows), key=repr)
