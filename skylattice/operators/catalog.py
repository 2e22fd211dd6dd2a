"""Items kept in a catalog database: rows, base items, partitions.

A row has ``id``, ``geometry`` (hex of extended WKB), ``collection``, ``datetime``, ``end_datetime`` and ``content``
(JSON without what the collection's base item has).
"""

from __future__ import annotations

import datetime as dt
import json
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions.geo import bounds_of_wkb, geojson_from_wkb
from skylattice.operators.search import search as _search


def merge(base, item, unset: str | None = None):
    """``base`` with ``item`` on top: objects are merged by key, of anything else the item's value stays.

    Lists of equal length are merged by place if both hold objects. ``unset``: an item's value that removes the key.
    """
    if isinstance(base, dict) and isinstance(item, dict):
        out = dict(base)
        for k, v in item.items():
            if unset is not None and v == unset:
                out.pop(k, None)
            else:
                out[k] = merge(base[k], v, unset) if k in base else v
        return out
    if isinstance(base, list) and isinstance(item, list) and len(base) == len(item) and all(isinstance(x, dict) for x in base + item):
        return [merge(b, i, unset) for b, i in zip(base, item)]
    return item


def merge_json(base: Column, item: Column, unset: str | None = None) -> Column:
    """``merge`` on JSON texts; a null base leaves the item, a null item the base."""

    @F.arrow_udf(T.StringType())
    def merged(bases: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for b, i in zip(bases.to_pylist(), items.to_pylist()):
            out.append(b if i is None else i if b is None else json.dumps(merge(json.loads(b), json.loads(i), unset), ensure_ascii=False))
        return pa.array(out, pa.string())

    return merged(base, item)


#: Keys of a row's content that become keys of the item; of a base item all keys do.
CONTENT_KEYS = ("stac_version", "stac_extensions", "bbox", "links", "assets", "properties")
#: Base items up to this many are sent to every task.
BROADCAST_BASES = 10_000


def hydrate(rows: DataFrame, bases: DataFrame | None = None, unset: str | None = None, more: str | None = None) -> DataFrame:
    """Rows with ``content`` completed by their collection's base item (``collection``, ``base``: JSON).

    A collection without a base item raises when its rows are read. ``more``: a column for the base item's other keys, as
    JSON; null without base items.
    """
    if bases is None:
        return rows if more is None else rows.withColumn(more, F.lit(None).cast("string"))
    known = bases.select(F.col("collection").alias("__collection"), F.col("base").alias("__base"))
    if known.limit(BROADCAST_BASES + 1).count() <= BROADCAST_BASES:
        known = F.broadcast(known)
    joined = rows.join(known, rows["collection"] == known["__collection"], "left")
    base = F.when(F.col("__base").isNotNull(), F.col("__base")).otherwise(
        F.raise_error(F.concat(F.lit("no base item for collection "), F.coalesce("collection", F.lit("null"))))
    )
    if more is not None:
        own = ("type", "id", "collection", "geometry", *CONTENT_KEYS)
        others = F.map_filter(F.from_json("__base", "map<string,variant>"), lambda k, _: ~k.isin(*own))
        joined = joined.withColumn(more, F.to_json(others))
    return joined.withColumn("content", merge_json(base, F.col("content"), unset)).drop("__collection", "__base")


def rows_to_item_texts(rows: DataFrame, bases: DataFrame | None = None, unset: str | None = None) -> DataFrame:
    """One JSON text an item, in ``item``; the box is the content's, or the bounds of the geometry."""
    wkb = F.unhex("geometry")
    part = lambda k: F.variant_get(F.parse_json("content"), f"$.{k}", "variant")
    made = hydrate(rows, bases, unset, "__more").withColumn("__box", bounds_of_wkb(wkb))
    box = F.coalesce(part("bbox"), F.when(F.col("__box").isNotNull(), F.parse_json(F.to_json(F.array(*[F.col(f"__box.{n}") for n in ("xmin", "ymin", "xmax", "ymax")])))))
    fields = [
        F.lit("Feature").alias("type"), "id", "collection", F.parse_json(geojson_from_wkb(wkb)).alias("geometry"), box.alias("bbox"),
        *[part(k).alias(k) for k in CONTENT_KEYS if k != "bbox"],
    ]
    shaped = made.select(*fields, "__more")
    # Keys that the content doesn't have stay away.
    item, more = F.to_json(F.struct(*[c for c in shaped.columns if c != "__more"])), F.col("__more")
    whole = F.concat(F.substring(item, F.lit(1), F.char_length(item) - 1), F.lit(","), F.substring(more, 2, 1 << 30))
    return shaped.select(F.when(more.isNull() | (more == "{}"), item).otherwise(whole).alias("item"))


def catalog_rows(
    rows: DataFrame, collection: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None,
    cql2: dict | None = None, now: dt.datetime | None = None,
) -> DataFrame:
    """Rows that fulfil every given condition. A CQL2 search excludes the other conditions."""
    if cql2 is not None and (collection is not None or start is not None or end is not None):
        raise ValueError("give a CQL2 search or a collection and times, not both")
    return _search(rows, collection, start, end, cql2=cql2, now=now)


def dsn(conninfo: str | None, search_path: str = "public", statement_timeout: int | None = None) -> str:
    """Connection parameters with the search path and, if given, the statement timeout added to the options.

    ``conninfo``: keys and values (``host=x``, also with blanks around ``=`` and quoted values), a ``postgresql://`` URI,
    or None, where the database's own environment variables say the rest.
    """
    parts = _parameters(conninfo or "")
    options = [parts.pop("options", ""), f"-c search_path={search_path}"]
    if statement_timeout is not None:
        options.append(f"-c statement_timeout={statement_timeout}")
    return " ".join(f"{k}={_quoted(v)}" for k, v in {**parts, "options": " ".join(filter(None, options))}.items())


def _quoted(value: str) -> str:
    if value and not re.search(r"[\s'\\]", value):
        return value
    return "'" + re.sub(r"(['\\])", r"\\\1", value) + "'"


_PARAMETER = re.compile(r"\s*([^\s=]+)\s*=\s*('(?:[^'\\]|\\.)*'|(?:[^\s'\\]|\\.)*)(?=\s|$)")


def _parameters(conninfo: str) -> dict[str, str]:
    if re.match(r"postgres(?:ql)?://", conninfo):
        authority, _, query = conninfo.split("://", 1)[1].partition("?")
        login, _, place = authority.rpartition("@")
        hosts, _, name = place.partition("/")
        user, _, password = login.partition(":")
        # Several hosts, and addresses in brackets, may each have a port.
        pairs = [re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", h) for h in hosts.split(",")]
        if not all(pairs):
            raise ValueError("the URI's host can't be read")
        host, port = ",".join(m[1].strip("[]") for m in pairs), ",".join(m[2] or "" for m in pairs)
        found = {"user": user, "password": password, "host": host, "port": port if port.strip(",") else "", "dbname": name}
        found |= dict(p.split("=", 1) for p in query.split("&") if "=" in p)
        return {k: unquote(v) for k, v in found.items() if v}
    out, at = {}, 0
    while at < len(conninfo.rstrip()):
        m = _PARAMETER.match(conninfo, at)
        if not m:
            raise ValueError("the connection parameters can't be read")
        value = m[2][1:-1] if m[2].startswith("'") else m[2]
        out[m[1]] = re.sub(r"\\(.)", r"\1", value)
        at = m.end()
    return out


# --- partitions


def with_partition_files(partitions: DataFrame, updated_after: dt.datetime | None = None) -> DataFrame:
    """Partitions in the order of their last update, with ``file``, ``start`` and ``end``.

    ``partitions``: ``collection``, ``lower``, ``upper`` (null: unbounded; what the file is named by), ``first``,
    ``last`` (times of its items) and ``last_updated``. The end is a microsecond after the last item.
    """
    day = lambda c: F.date_format(c, "yyyyMMdd")
    name = F.when(F.col("lower").isNull() | F.col("upper").isNull(), "items.parquet").otherwise(
        F.concat(F.lit("items_"), day("lower"), F.lit("_"), day("upper"), F.lit(".parquet"))
    )
    out = partitions.select(
        "collection", name.alias("file"), F.col("first").alias("start"), (F.col("last") + F.expr("interval 1 microsecond")).alias("end"), "last_updated"
    )
    if updated_after is not None:
        out = out.where(F.col("last_updated") >= F.lit(updated_after))
    return out.orderBy("last_updated")


#: Partitions up to this many are sent to every task; more are joined by collection.
BROADCAST_PARTITIONS = 100_000


def assign_partitions(items: DataFrame, partitions: DataFrame) -> DataFrame:
    """Items with the ``file`` of their partition: same collection, start <= datetime < end; null bounds are open.

    Items of no partition are left out, and of several partitions they are in each.
    """
    p = partitions.select(F.col("collection").alias("__c"), "file", F.col("start").alias("__start"), F.col("end").alias("__end"))
    if p.limit(BROADCAST_PARTITIONS + 1).count() <= BROADCAST_PARTITIONS:
        p = F.broadcast(p)
    inside = (
        (F.col("collection") == F.col("__c"))
        & (F.col("__start").isNull() | (F.col("datetime") >= F.col("__start")))
        & (F.col("__end").isNull() | (F.col("datetime") < F.col("__end")))
    )
    return items.join(p, inside).drop("__c", "__start", "__end")
