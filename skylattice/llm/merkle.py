"""Document fingerprints: a Merkle tree over paragraphs and sections.

Lines are paragraphs. A section starts at the text's start, after a blank line and at a heading (a line that starts
with ``#``). A paragraph's node is the SHA-256 of its text, a section's that of its paragraphs' nodes, and the root that
of the sections' nodes, so equal roots mean equal texts and differing branches tell which sections and paragraphs were
edited. Under each paragraph are its leaves, 32-bit hashes of its pieces: a sentence, or eight words of a longer one;
of short paragraphs single words, so that half of a short text still has leaves of its own. The likeness of two fingerprints is the Dice coefficient of their sets of leaves.

The fingerprint as text is the root, a colon, and the sections, joined by semicolons: node, slash, the paragraphs,
joined by commas. A paragraph is the first 16 digits of its node, an equals sign and its leaves of 8 digits each.

Everything is built of SQL functions; a text is shuffled once for its edit and its neighbour's likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import cut

#: Up to eight words that end a sentence, else eight words, else the white space that is left.
PIECE = r"(?:\s*+\S++){1,8}?(?:(?<=[.!?])|$)|(?:\s*+\S++){1,8}|\s++"
#: A word, or the white space that is left.
WORD_PIECE = r"\s*+\S++|\s++"
#: Paragraphs with so many code points have pieces as leaves, those with fewer than twice as many have words: a text that
#: gets half as long has leaves of one kind in common.
SHORT = 96


def _leaves(paragraph: Column) -> Column:
    none, n = F.array().cast("array<string>"), F.char_length(paragraph)
    all_of = lambda pattern: F.regexp_extract_all(paragraph, F.lit(pattern), F.lit(0))
    pieces = F.concat(F.when(n >= SHORT, all_of(PIECE)).otherwise(none), F.when(n < 2 * SHORT, all_of(WORD_PIECE)).otherwise(none))
    return F.transform(pieces, lambda p: F.shiftright(F.xxhash64(p), 32).cast("int"))


def tree(text: Column) -> Column:
    """The tree of a text: struct of ``root`` and ``sections`` (``node``, ``paragraphs`` of ``node`` and ``leaves``)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    paragraphs = F.transform(
        lines,
        lambda p: F.struct(
            F.sha2(p, 256).alias("node"),
            _leaves(p).alias("leaves"),
            (F.trim(p) == "").alias("blank"),
            p.startswith("#").alias("heading"),
        ),
    )
    return _assembled(paragraphs)


def _assembled(paragraphs: Column) -> Column:
    # Each of these stands inside the next, bound by a lambda, so that none is computed twice.
    def with_starts(ps: Column) -> Column:
        n = F.size(ps)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | F.element_at(ps, i + 1)["heading"] | F.element_at(ps, F.greatest(i, F.lit(1)))["blank"],
        )
        return F.transform(
            F.arrays_zip(starts.alias("from"), F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n)).alias("to")),
            lambda s: _section(F.transform(F.slice(ps, s["from"] + 1, s["to"] - s["from"]), lambda p: F.struct(p["node"].alias("node"), p["leaves"].alias("leaves")))),
        )

    sections = _bind(paragraphs, with_starts)
    return _bind(sections, lambda s: F.struct(F.sha2(F.array_join(s["node"], ""), 256).alias("root"), s.alias("sections")))


def _section(ps: Column) -> Column:
    return _bind(ps, lambda p: F.struct(F.sha2(F.array_join(p["node"], ""), 256).alias("node"), p.alias("paragraphs")))


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def leaves(tree_col: Column) -> Column:
    """All leaves of a tree, without repeats."""
    return F.array_distinct(F.flatten(F.transform(tree_col["sections"], lambda s: F.flatten(s["paragraphs"]["leaves"]))))


def to_text(tree_col: Column) -> Column:
    hexed = lambda x: F.lower(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    paragraph = lambda p: F.concat(p["node"].substr(1, 16), F.lit("="), F.array_join(F.transform(p["leaves"], hexed), ""))
    section = lambda s: F.concat(s["node"].substr(1, 16), F.lit("/"), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(tree_col["root"], F.lit(":"), F.array_join(F.transform(tree_col["sections"], section), ";"))


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of leaves: 1 if equal (two empty ones are), 0 if nothing is shared."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) * 2.0 / total)


def edits(a: Column, b: Column) -> Column:
    """Where two trees differ: (``section``, ``paragraph``) numbers of ``a``, from 0, whose paragraph isn't in ``b``.

    Sections whose node is in ``b`` are not gone into; equal roots give an empty array.
    """
    sections = lambda t: t["sections"]["node"]
    known = F.flatten(F.transform(b["sections"], lambda s: s["paragraphs"]["node"]))
    inner = F.flatten(
        F.transform(
            a["sections"],
            lambda s, i: F.when(F.array_contains(sections(b), s["node"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
                F.filter(
                    F.transform(
                        s["paragraphs"],
                        lambda p, j: F.when(~F.array_contains(known, p["node"]), F.struct(i.alias("section"), j.alias("paragraph"))),
                    ),
                    lambda x: x.isNotNull(),
                )
            ),
        )
    )
    return F.when(a["root"] == b["root"], F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(inner)


def neighbours(rows: DataFrame) -> DataFrame:
    """``row`` and ``n`` of each row, and of the next one in descending order, around the end: ``next_row``.

    ``rows``: ``doc_id``, ``row`` (unique) and ``n``. Rows are dealt out by ranges of the order and numbered within
    them; the first row of each range is looked up for the range before, so no task sees more than a range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("row").asc()]
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    inside = ranged.withColumn("inner_next", F.lead("row").over(Window.partitionBy("range").orderBy(*order)))
    place = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.col("row"))
    heads = ranged.groupBy("range").agg(F.min_by("row", place).alias("head"))
    ring = Window.orderBy("range")
    all_of = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("range", F.coalesce(F.lead("head").over(ring), F.first("head").over(all_of)).alias("range_next"))
    return inside.join(after, "range").select("row", "n", F.coalesce("inner_next", "range_next").alias("next_row"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` and ``root``; null texts count as empty ones, which have one empty paragraph."""
    return docs.select(F.col(id_col).alias("doc_id"), tree(F.col(text_col)).alias("tree")).select(
        "doc_id", to_text(F.col("tree")).alias("fingerprint"), "tree.root"
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text, and its edit: the last floor(n/2) code points replaced by the first ones of the next document.

    The next document is the one after it in descending ``doc_id``, after the last the first. Returns ``doc_id``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    Null texts are empty. Rows that repeat an id follow each other in the order of their texts' hashes; rows equal in
    both are one row in the order and so share their next document, and each is returned. Null ids come after all
    others. A single document is its own next. An empty table gives no rows; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")))
    # Both uses of the texts read these two columns only, so they share one shuffle.
    held = source.select(row.alias("row"), "text")
    ids = source.groupBy(row.alias("row")).agg(
        F.first("doc_id").alias("doc_id"), F.max(F.char_length("text")).cast("bigint").alias("n"), F.count("*").alias("copies")
    )
    ids = cut(ids)
    ring = cut(neighbours(ids.select("doc_id", "row", "n")))
    # What a document gives to the one before it: the head of its text and its leaves.
    wanted = ring.select(F.col("next_row").alias("row"), F.col("row").alias("to_row"), F.col("n").alias("to_n"))
    given = held.join(wanted.hint("shuffle_merge"), "row").select(
        "to_row",
        F.col("text").substr(F.lit(1), F.floor(F.col("to_n") / 2).cast("int")).alias("head"),
        leaves(tree(F.col("text"))).alias("next_leaves"),
    )
    if not ids.where("copies > 1").isEmpty():
        given = given.dropDuplicates(["to_row"])
    n = F.char_length("text")
    both = held.join(given.hint("shuffle_merge").withColumnRenamed("to_row", "row"), "row").select(
        "row", "text", "next_leaves", F.concat(F.col("text").substr(F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("head")).alias("edited")
    )
    trees = both.select("row", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "next_leaves",
                        tree(F.col("text")).alias("tree"), tree(F.col("edited")).alias("edited_tree"))
    return trees.select(
        F.expr("try_cast(split_part(row, ':', 1) as bigint)").alias("doc_id"), "n_chars", "edited_sha256",
        to_text(F.col("tree")).alias("fingerprint"), to_text(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(leaves(F.col("tree")), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(leaves(F.col("tree")), F.col("next_leaves")).alias("near_next"),
    )
