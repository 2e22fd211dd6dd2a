"""Searching item tables: boxes, times and a subset of CQL2-JSON, as plain predicates that scans can push down."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.columns import col

Box = tuple[float, float, float, float]


def bbox_intersects(box: Column, query: Box) -> Column:
    """Whether a box struct meets (xmin, ymin, xmax, ymax). xmin > xmax: the query crosses the antimeridian."""
    xmin, ymin, xmax, ymax = query
    north = (box["ymin"] <= ymax) & (box["ymax"] >= ymin)
    if xmin <= xmax:
        return north & (box["xmin"] <= xmax) & (box["xmax"] >= xmin)
    return north & ((box["xmax"] >= xmin) | (box["xmin"] <= xmax))


def clustered(table: DataFrame, partitions: int, bits: int = 10) -> DataFrame:
    """The table sorted along a Z-order curve of the boxes' centres, so that files and row groups cover small areas."""
    scale = lambda low, high, span: F.least(
        F.greatest(F.floor((F.coalesce((low + high) / 2, F.lit(0.0)) + span / 2) / span * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)
    )
    x, y = scale(F.col("bbox.xmin"), F.col("bbox.xmax"), 360.0), scale(F.col("bbox.ymin"), F.col("bbox.ymax"), 180.0)
    spread = lambda v, at: [F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), 2 * i + at) for i in range(bits)]
    key = F.lit(0).cast("bigint")
    for part in spread(x, 0) + spread(y, 1):
        key = key.bitwiseOR(part)
    keyed = table.withColumn("__z", key)
    return keyed.repartitionByRange(partitions, "__z").sortWithinPartitions("__z").drop("__z")


def search(
    table: DataFrame, collection: str | list[str] | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None,
    bbox: Box | None = None, cql2: dict | None = None, where: Column | None = None, now: dt.datetime | None = None,
) -> DataFrame:
    """Items that fulfil every given condition.

    Times are half-open: ``start`` <= datetime < ``end``. With a start and no end, the end is ``now`` or the current
    time.
    """
    conditions: list[Column] = []
    if collection is not None:
        conditions.append(F.col("collection").isin([collection] if isinstance(collection, str) else collection))
    if start is not None:
        conditions.append(F.col("datetime") >= F.lit(start))
        if end is None:
            conditions.append(F.col("datetime") < (F.current_timestamp() if now is None else F.lit(now)))
    if end is not None:
        conditions.append(F.col("datetime") < F.lit(end))
    if bbox is not None:
        conditions.append(bbox_intersects(F.col("bbox"), bbox))
    if cql2 is not None:
        conditions.append(from_cql2(cql2))
    if where is not None:
        conditions.append(where)
    for c in conditions:
        table = table.where(c)
    return table


def _box_of(geometry) -> Box:
    if isinstance(geometry, dict) and "bbox" in geometry:
        b = geometry["bbox"]
        return (b[0], b[1], b[-2], b[-1]) if len(b) == 4 else (b[0], b[1], b[3], b[4])
    if isinstance(geometry, dict) and geometry.get("type") == "Polygon":
        ring = geometry["coordinates"][0]
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        box = (min(xs), min(ys), max(xs), max(ys))
        if len(geometry["coordinates"]) > 1 or not all(p[0] in box[::2] and p[1] in box[1::2] for p in ring):
            raise ValueError("s_intersects takes a bbox or a polygon that is one")
        return box
    raise ValueError("s_intersects takes a bbox or a polygon that is one")


def _times(value) -> tuple[Column | None, Column | None]:
    """Start and end of an instant or interval; ``..`` is open."""
    instant = lambda x: None if x == ".." else F.to_timestamp(F.lit(x["timestamp"] if isinstance(x, dict) else x))
    if isinstance(value, dict) and "interval" in value:
        return instant(value["interval"][0]), instant(value["interval"][1])
    at = instant(value)
    return at, at


def _all(*conditions: Column | None) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out if c is None else out & c
    return out


_COMPARE: dict[str, Callable] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def from_cql2(node) -> Column:
    """A Column from CQL2-JSON: and, or, not, comparisons, between, in, like, isNull, s_intersects, t_intersects, t_during.

    Other operators raise ``ValueError``. Properties are columns of the table layout; ``geometry`` stands for the box.
    """
    if isinstance(node, bool) or node is None or isinstance(node, (int, float, str)):
        return F.lit(node)
    if "property" in node:
        return col(node["property"])
    if "timestamp" in node:
        return F.to_timestamp(F.lit(node["timestamp"]))
    op, args = node.get("op"), node.get("args", [])
    if op in ("and", "or"):
        out = from_cql2(args[0])
        for a in args[1:]:
            out = (out & from_cql2(a)) if op == "and" else (out | from_cql2(a))
        return out
    if op == "not":
        return ~from_cql2(args[0])
    if op in _COMPARE:
        return _COMPARE[op](from_cql2(args[0]), from_cql2(args[1]))
    if op == "between":
        return from_cql2(args[0]).between(from_cql2(args[1]), from_cql2(args[2]))
    if op == "in":
        return from_cql2(args[0]).isin([x for x in args[1]])
    if op == "like":
        return from_cql2(args[0]).like(args[1])
    if op == "isNull":
        return from_cql2(args[0]).isNull()
    if op == "s_intersects":
        return bbox_intersects(F.col("bbox"), _box_of(args[1]))
    if op in ("t_intersects", "t_during"):
        value, (start, end) = from_cql2(args[0]), _times(args[1])
        if op == "t_during":
            return _all(None if start is None else value > start, None if end is None else value < end)
        return _all(None if start is None else value >= start, None if end is None else value <= end)
    raise ValueError(f"unsupported CQL2 operator: {op!r}")
