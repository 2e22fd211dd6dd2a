"""Conversations without quotes, in reply order, by linking quoted passages to the messages they come from.

A line's quote level is the number of ``>`` marks at its start. Lines in a row with the same level above 0 are a
passage; a line like "Ann wrote:" right before a deeper line introduces it and is no text of its own. A passage, its
paragraphs and its lines are normalised (lower case, single blanks) and hashed; so are those of every message's own text.
Short lines and paragraphs decide only for messages that nothing else links. The hashes are joined within a conversation, each standing for the first message that said it, so common lines
make no pairs. A message replies to the earlier message of which it quotes most at its lowest level; following replies
leads to its thread's first message, by pointer jumping. A message that quotes nothing known starts a thread.

The result has one row a message, ordered by ``thread`` and ``turn`` within a conversation, so that no conversation
has to fit into one task. Everything is built of SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import cut

MARKS = r"^[\x20\t]{0,3}(?:>[\x20\t]?)+"
INTRODUCTION = r"(?i)\bwrote:\s*$|\bschrieb.*:\s*$|\ba écrit\s*:\s*$|\bescribió:\s*$"
#: Lines and paragraphs shorter than this, unless the whole, only link messages that no other unit links.
MIN_LINE = 12


def _lines(text: Column) -> Column:
    """Lines as ``level`` and ``body``."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n", -1),
        lambda x: F.struct(
            F.regexp_count(F.regexp_extract(x, MARKS, 0), F.lit(">")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")
        ),
    )


def _said(lines: Column, x: Column, i: Column) -> Column:
    """Whether a line has no marks and is no introduction."""
    return (x["level"] == 0) & ~(x["body"].rlike(INTRODUCTION) & (F.coalesce(F.try_element_at(lines, i + 2)["level"], F.lit(0)) > 0))


def _own(lines: Column) -> Column:
    """Bodies of the lines without marks, introductions left out."""
    return F.transform(F.filter(lines, lambda x, i: _said(lines, x, i)), lambda x: x["body"])


def _parted(lines: Column) -> Column:
    """The same with an empty line in place of each one left out, so that quotes part paragraphs."""
    return F.transform(lines, lambda x, i: F.when(_said(lines, x, i), x["body"]).otherwise(F.lit("")))


def _passages(lines: Column) -> Column:
    """Runs of lines with one level above 0: ``level`` and ``lines``."""
    places = F.sequence(F.lit(1), F.size(lines))
    level = lambda i: F.coalesce(F.try_element_at(lines, i)["level"], F.lit(0))
    starts = F.filter(places, lambda i: (level(i) > 0) & ((i == 1) | (level(F.greatest(i - 1, F.lit(1))) != level(i))))
    stops = F.filter(places, lambda i: (level(i) > 0) & ((i == F.size(lines)) | (level(i + 1) != level(i))))
    return F.transform(
        F.arrays_zip(starts.alias("a"), stops.alias("b")),
        lambda r: F.struct(
            level(r["a"]).alias("level"), F.transform(F.slice(lines, r["a"], r["b"] - r["a"] + 1), lambda x: x["body"]).alias("lines")
        ),
    )


def _normal(x: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(x, r"\s+", " ")))


def _units(bodies: Column) -> Column:
    """What can be linked of some lines, normalised, as ``unit`` and ``short``: the whole, paragraphs and lines."""
    paragraphs = F.split(F.array_join(bodies, "\n"), r"\n\s*\n")
    whole = F.array(F.struct(_normal(F.array_join(bodies, " ")).alias("unit"), F.lit(False).alias("short")))
    parts = F.transform(
        F.transform(F.concat(paragraphs, bodies), _normal), lambda x: F.struct(x.alias("unit"), (F.char_length(x) < MIN_LINE).alias("short"))
    )
    return F.filter(F.array_distinct(F.concat(whole, parts)), lambda x: x["unit"] != "")


def parse(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with ``own`` (text without quotes) and ``passages``."""
    rows = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    ).withColumn("lines", F.when(F.coalesce(F.col("text").contains(">"), F.lit(False)), _lines(F.col("text"))))
    return rows.withColumns(
        {
            "quotes": F.coalesce(F.exists("lines", lambda x: x["level"] > 0), F.lit(False)),
            "own_lines": F.when(F.col("lines").isNotNull(), _own(F.col("lines"))).otherwise(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)),
        }
    ).withColumns(
        {
            "own": F.when(F.col("quotes"), F.regexp_replace(F.array_join("own_lines", "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text")),
            "passages": F.when(F.col("quotes"), _passages(F.col("lines"))),
            "parted": F.when(F.col("quotes"), _parted(F.col("lines"))).otherwise(F.col("own_lines")),
        }
    )


def reply_links(parsed: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``key`` (of the text), ``reply_to``, ``n_linked`` for messages with a linked passage."""
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    quoted = (
        parsed.where(known & F.col("quotes"))
        .select("conv_id", "turn", F.xxhash64("text").alias("key"), F.posexplode("passages").alias("number", "p"))
        .select("conv_id", "turn", "key", "number", F.col("p.level").alias("level"), F.explode(_units(F.col("p.lines"))).alias("u"))
    )
    unit = (F.xxhash64("u.unit").alias("hash"), F.char_length("u.unit").alias("chars"))
    quoted = cut(quoted.select("conv_id", "turn", "key", "number", "level", *unit, "u.short"))
    if quoted.isEmpty():
        return quoted.select("conv_id", "turn", "key", F.col("turn").alias("reply_to"), F.lit(0).cast("bigint").alias("n_linked"))
    said = (
        parsed.where(known)
        .select("conv_id", "turn", F.explode(_units(F.col("parted"))).alias("u"))
        .groupBy("conv_id", *unit)
        .agg(F.min("turn").alias("first"), F.min(F.when(~F.col("u.short"), F.col("turn"))).alias("first_long"))
    )
    both = cut(quoted.join(said, ["conv_id", "hash", "chars"]))
    shared = ("conv_id", "turn", "key", "number", "level", "hash", "chars")
    long = both.where(~F.col("short") & (F.col("first_long") < F.col("turn"))).select(*shared, F.col("first_long").alias("source"))
    short = both.where(F.col("first") < F.col("turn")).select(*shared, F.col("first").alias("source")).distinct()
    # A null text isn't quoting, so keys are never null here.
    met = long.unionByName(short.join(long.select("conv_id", "turn", "key").distinct(), ["conv_id", "turn", "key"], "left_anti"))
    whole = met.groupBy("conv_id", "turn", "key", "level", "source").agg(
        F.sum("chars").alias("chars"), F.collect_set("number").alias("numbers")
    )
    return whole.groupBy("conv_id", "turn", "key").agg(
        F.max(F.struct((-F.col("level")).alias("l"), "chars", "source"))["source"].alias("reply_to"),
        F.size(F.array_distinct(F.flatten(F.collect_list("numbers")))).cast("bigint").alias("n_linked"),
    )


def threads(replies: DataFrame, max_steps: int = 64) -> DataFrame:
    """``conv_id``, ``turn``, ``thread`` (the turn that replies lead back to) and ``depth``, for messages that reply."""
    state = cut(replies.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread")).withColumn("depth", F.lit(1).cast("bigint")))
    for _ in range(max_steps):
        ahead = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        if state.join(ahead, ["conv_id", "thread"], "left_semi").isEmpty():
            return state
        state = cut(
            state.join(ahead, ["conv_id", "thread"], "left").select(
                "conv_id", "turn", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            )
        )
    raise RuntimeError("a thread has no start")


def conversations(messages: DataFrame) -> DataFrame:
    """Per message: ``conv_id``, ``thread``, ``turn``, ``depth``, ``role``, ``reply_to``, ``text``, ``n_quotes``, ``n_linked``.

    ``text`` is without quotes, and as it was if there are none; null stays null. ``depth`` counts replies back to the
    thread's start. Null ``conv_id`` or ``turn``: the message isn't linked, and is a thread of its own. Rows that repeat
    a ``conv_id`` and ``turn`` are all returned; others that reply to that turn reply to all of them. Passages that
    several messages said belong to the first. Empty and white texts can't be quoted. An empty table gives no rows;
    other columns are not looked at.
    """
    parsed = parse(messages)
    links = cut(reply_links(parsed))
    places = threads(links)
    rows = parsed.withColumn("key", F.xxhash64("text"))
    linked = rows.join(links, ["conv_id", "turn", "key"], "left").join(
        places.withColumnRenamed("depth", "found_depth").withColumnRenamed("thread", "found_thread"), ["conv_id", "turn"], "left"
    )
    replies = F.col("reply_to").isNotNull()
    return linked.select(
        "conv_id",
        F.when(replies, F.col("found_thread")).otherwise(F.col("turn")).alias("thread"),
        "turn",
        F.when(replies, F.col("found_depth")).otherwise(F.lit(0)).cast("bigint").alias("depth"),
        "role", "reply_to", F.col("own").alias("text"),
        F.coalesce(F.when(F.col("quotes"), F.size("passages")), F.lit(0)).cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )
