"""WARC archives, read back by verifying the chain of record boundaries.

Writing: one record per page, of type ``response`` with an HTTP head and the payload, or of type ``revisit`` with the
head alone where another page has the same payload. Files are cut at about ``FILE_BYTES``.

Reading: the version line is the separator by which Spark's text source cuts the files, so tasks read ranges of bytes and
no file is held whole. Every piece that starts with a readable header is a candidate, also inside payloads; its place
is the sum of what lies before it, its length gives its successor's offset. Inside a range chains are followed over the
offsets alone, which leaves for each candidate the offset where its chain leaves the range. From the file's start these
exits are then followed by pointer jumping: the reached set doubles its length in each step. Candidates on the chain
from a range's reached entry are records; all others are rejected, as their bytes belong to a payload. Records whose
payload holds the version line are put together again from their pieces.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.common import cut, remove, shared_dir

FILE_BYTES = 32 << 20
#: Groups of equal payloads that go to every task; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 100_000

#: Fixed values of the WARC 1.1 format and of base32.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_CRLF = "\r\n"
_RECORD_ID = "urn:skylattice:page:"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32, 32 digits: each five hex digits are four of base32."""
    digits = F.sha1(data)
    return F.concat(
        *[
            F.substring(F.lit(BASE32), F.shiftright(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int"), shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
            for k in range(8)
            for shift in (15, 10, 5, 0)
        ]
    )


def assign(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``n``, ``digest``, ``head``: of pages with equal payloads, the largest id."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    ).withColumns({"n": F.octet_length("payload").cast("bigint"), "digest": base32_sha1(F.col("payload"))})
    groups = cut(
        rows.where(F.col("n") >= min_bytes)
        .groupBy(F.col("digest").alias("same_digest"), F.col("n").alias("same_n"))
        .agg(F.max("page_id").alias("head"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    return rows.join(groups, (F.col("digest") == F.col("same_digest")) & (F.col("n") == F.col("same_n")), "left").drop("same_digest", "same_n")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes one record per page (``page_id``, ``url``, ``html``) to WARC files in the folder ``path``.

    Of pages with equal payloads of at least ``min_bytes`` that with the largest id is a response and the others
    revisit it; smaller ones are all responses. Null html is an empty payload; a null or broken url loses its blanks.
    Rows that repeat the largest id are all responses; null ids are smaller than all others. No pages: no records.
    """
    rows = assign(pages, min_bytes)
    revisit = F.col("head").isNotNull() & (F.coalesce(F.col("page_id") != F.col("head"), F.lit(True)))
    ident = lambda c: F.concat(F.lit(f"<{_RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(_CRLF * 2)
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}{_CRLF}WARC-Refers-To: "), ident(F.col("head")))),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")),
    ]
    record = F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), http, body)
    sizes = rows.agg(F.avg("n").alias("mean")).first()["mean"] or 0.0
    per_file = max(1, int(file_bytes / (sizes + 600)))
    # A record ends with two line ends, which is what the writer puts after each value.
    rows.select(record.alias("value")).write.mode("overwrite").option("lineSep", _CRLF * 2).option("maxRecordsPerFile", per_file).text(path)


_ENDS = _CRLF * 2


def _pieces(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """What lies between the version lines: ``file``, ``size``, ``block`` (start of the range), ``id`` (rising), ``value``."""
    files = spark.read.option("lineSep", magic).option("pathGlobFilter", "part-*").text(path)
    return files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
    )


def _field(head: str, name: str) -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _payload_of(block: Column) -> tuple[Column, Column]:
    """The HTTP head of a record's block and the bytes after it; without a head all are payload."""
    text = block.cast("string")
    head = F.when(F.contains(text, F.lit(_ENDS)), F.substring_index(text, _ENDS, 1))
    return head, F.when(head.isNull(), block).otherwise(F.substring(block, F.octet_length(head) + 5, F.octet_length(block)))


def candidates(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """All pieces: ``file``, ``size``, ``block``, ``seq`` (number in the range), ``at`` (where the version line before it
    starts), and of those that could be records ``jump`` (to the successor) and the fields; of others ``jump`` is null.
    """
    magic = version + _CRLF
    digits = F.col("length").rlike("^[0-9]{1,15}$")
    raw = F.col("value").cast("binary")
    http, payload = _payload_of(F.col("body"))
    plain = lambda c: F.regexp_replace(c, rf"^<(?:{_RECORD_ID})?|>$", "")
    rows = (
        _pieces(spark, path, magic)
        .withColumn("head", F.when(F.contains("value", F.lit(_ENDS)), F.substring_index("value", _ENDS, 1)))
        .withColumns({"length": _field("head", "Content-Length"), "kind": _field("head", "WARC-Type"), "after": F.octet_length("head") + 4})
        .withColumn("length", F.when(digits & (F.col("kind") != ""), F.col("length").cast("bigint")))
        .withColumn("whole", F.octet_length("value") >= F.col("after") + F.col("length") + 4)
        # Two line ends must follow a record; of one that goes on in other pieces the successor tells.
        .withColumn("ends", F.coalesce(~F.col("whole") | (F.substring(raw, (F.col("after") + F.col("length") + 1).cast("int"), F.lit(4)) == F.lit(_ENDS.encode())), F.lit(False)))
        .withColumn("body", F.when(F.col("whole") & F.col("ends"), F.substring(raw, F.col("after") + 1, F.col("length").cast("int"))))
        .withColumns({"http": http, "payload": payload})
    )
    cut_up = cut(
        rows.select(
            "file", "size", "block", "id", F.octet_length("value").alias("bytes"), "after", "length", "whole",
            F.when(F.col("ends"), len(magic) + F.col("after") + F.col("length") + 4).alias("jump"),
            plain(_field("head", "WARC-Record-ID")).alias("page_id"), F.col("kind").alias("record_type"),
            plain(_field("head", "WARC-Refers-To")).alias("refers_to"),
            *_told("kind", "head", "http", "payload"),
        )
    )
    length = F.col("bytes") + len(magic)
    before = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut_up.groupBy("file", "block").agg(F.sum(length).alias("in_range"), F.min("id").alias("first_id"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("file", "block", "first_id", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("base"))
    placed = cut_up.withColumn("inside", F.coalesce(F.sum(length).over(before), F.lit(0))).join(bases, ["file", "block"])
    placed = placed.withColumn("at", F.col("base") + F.col("inside") - len(magic)).withColumn("seq", F.col("id") - F.col("first_id"))
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("jump") <= F.col("size"))
    return cut(placed.withColumn("jump", F.when(fits, F.col("jump"))).drop("base", "inside", "id", "first_id"))


def _told(kind: str, head: str, http: str, payload: str) -> list[Column]:
    """Size and digest of a record's payload: made anew, but for revisits as the record tells them."""
    revisit = F.col(kind) == "revisit"
    told = F.regexp_replace(F.regexp_extract(head, r"(?i)(?:^|\r\n)WARC-Payload-Digest:[ \t]*([^\r\n]*)", 1), "^sha1:", "")
    n = F.regexp_extract(http, r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]+)", 1)
    return [
        F.when(revisit, F.when(n != "", n.cast("bigint"))).otherwise(F.octet_length(payload).cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.when(told != "", told)).otherwise(base32_sha1(F.col(payload))).alias("payload_digest"),
    ]


_FOREST = T.StructType([T.StructField(n, t) for n, t in (
    ("file", T.StringType()), ("block", T.LongType()), ("at", T.LongType()), ("leaves_to", T.LongType()), ("first", T.LongType()), ("last", T.LongType()))])


def chains(offsets: list[int], successors: list[int]) -> list[tuple[int, int, int]]:
    """Of the candidates of a range, in order: where the chain leaves the range, and the place in the range's forest.

    Each candidate hangs below its successor. The numbers ``first`` to ``last`` of a candidate enclose those of all
    candidates below it, so an entry's chain consists of the candidates whose numbers enclose the entry's.
    """
    found = dict(zip(offsets, successors))
    below = dict.fromkeys(offsets, 1)
    for at in offsets:
        if found[at] in found:
            below[found[at]] += below[at]
    first, free, leave, fresh = {}, {}, {}, 0
    for at in reversed(offsets):
        after = found[at]
        if after in found:
            first[at], leave[at] = free[after], leave[after]
            free[after] += below[at]
        else:
            first[at], leave[at] = fresh, after
            fresh += below[at]
        free[at] = first[at] + 1
    return [(leave[at], first[at], first[at] + below[at] - 1) for at in offsets]


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    made = chains(group["at"].tolist(), group["to"].tolist())
    leave, first, last = zip(*made)
    return pd.DataFrame({"file": group["file"].to_numpy(), "block": group["block"].to_numpy(), "at": group["at"].to_numpy(), "leaves_to": leave, "first": first, "last": last})


def reached(exits: DataFrame, max_steps: int = 40) -> DataFrame:
    """Entries (``file``, ``at``) that the exits lead to from each file's start.

    ``exits``: ``file``, ``at``, ``to``, one row an entry. After k steps the set holds the first 2^k entries of every
    chain, and a pointer leads 2^k exits ahead.
    """
    pointers, known, count = exits, exits.where("at = 0").select("file", "at"), -1
    for _ in range(max_steps):
        ahead = pointers.join(known, ["file", "at"]).select("file", F.col("to").alias("at"))
        known = cut(known.unionByName(ahead).distinct())
        if (now := known.count()) == count:
            return known
        count = now
        onward = pointers.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        pointers = cut(pointers.join(onward, ["file", "to"]).select("file", "at", F.col("next").alias("to")))
    raise RuntimeError("the chain of blocks did not end")


def read_archives(spark: SparkSession, path: str, strict: bool = True, version: str = VERSION) -> DataFrame:
    """Per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Digest and size are of the full payload: made anew for responses, told by the record for revisits. ``strict``: an
    archive whose chain doesn't end at the file's end is damaged and raises; otherwise the records before the damage
    are returned. Empty files have no records. Ranges are as long as ``spark.sql.files.maxPartitionBytes`` has them.
    """
    pieces = candidates(spark, path, version)
    links = pieces.where("jump is not null").select("file", "block", "at", (F.col("at") + F.col("jump")).alias("to"))
    found = cut(links.groupBy("file", "block").applyInPandas(_forest, _FOREST))
    targets = found.select("file", F.col("leaves_to").alias("at")).distinct()
    entries = found.join(targets, ["file", "at"], "left_semi").unionByName(found.where("at = 0"))
    exits = cut(entries.select("file", "at", F.col("leaves_to").alias("to")).distinct())
    known = reached(exits)
    if strict:
        ends = known.groupBy("file").agg(F.max("at").alias("end"))
        sizes = pieces.groupBy("file").agg(F.max("size").alias("size"))
        bad = sizes.join(ends, "file", "left").where("end is null or end <> size").select("file").first()
        if bad:
            raise ValueError(f"the records of {bad['file']} don't reach its end")
    starts = found.join(known, ["file", "at"], "left_semi").select("file", "block", F.col("first").alias("entry"))
    chain = found.join(starts, ["file", "block"]).where("entry between first and last").select("file", "at")
    records = pieces.join(chain, ["file", "at"])
    split = cut(records.where("not whole").select("file", "at", "block", "seq", "size", "jump", "after", "length", "page_id", "record_type", "refers_to"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    records = records.where("whole").select(*out)
    if not split.isEmpty():
        inner = pieces.join(chain, ["file", "at"], "left_anti").where("at >= 0").select("file", "at", "block", "seq")
        records = records.unionByName(_joined(spark, path, version + _CRLF, split, inner).select(*out))
    return records.select(
        F.col("page_id").try_cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("bigint").alias("refers_to")
    )


def _joined(spark: SparkSession, path: str, magic: str, split: DataFrame, inner: DataFrame) -> DataFrame:
    """The records that consist of several pieces: their heads are in ``split``, ``inner`` has what no chain reaches."""
    known = ["jump", "after", "length", "page_id", "record_type", "refers_to"]
    owner = F.last(F.when(F.col("jump").isNotNull(), F.struct("at", *known)), True).over(Window.partitionBy("file").orderBy("at"))
    parts = split.drop("size").unionByName(inner, allowMissingColumns=True).withColumn("of", owner)
    parts = cut(parts.where("at < of.at + of.jump").select("file", "block", "seq", "at", "of"))
    ranges = parts.select("file", "block").distinct()
    number = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    values = _pieces(spark, path, magic).join(ranges, ["file", "block"], "left_semi").withColumn("seq", number.cast("bigint"))
    met = parts.join(values.select("file", "block", "seq", "value"), ["file", "block", "seq"])
    whole = met.groupBy("file", F.col("of.at").alias("start")).agg(
        F.first("of").alias("of"), F.sort_array(F.collect_list(F.struct("at", "value"))).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["value"]), magic)
    body = F.substring(text.cast("binary"), F.col("of.after") + 1, F.col("of.length").cast("int"))
    rows = whole.select("of.*", body.alias("body"), F.substring_index(F.col("pieces")[0]["value"], _ENDS, 1).alias("head"))
    http, payload = _payload_of(F.col("body"))
    rows = rows.withColumns({"http": http, "payload": payload})
    return rows.select("page_id", "record_type", "refers_to", *_told("record_type", "head", "http", "payload"))


def round_trip(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives of all pages to the shared folder, reads them back and removes them.

    See ``write_archives`` and ``read_archives``. An empty table gives no rows; other columns are not looked at.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    try:
        write_archives(pages, path, min_bytes, file_bytes)
        return cut(read_archives(spark, path))
    finally:
        remove(spark, path)
