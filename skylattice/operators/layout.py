"""Between the JSON layout (nested properties) and the table layout (flat columns), and on to JSON texts.

Table layout: properties are columns, times are timestamps, the box is a struct of doubles, the geometry is tagged WKB.
All of it is projections; only the geometry codec leaves the JVM.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions.columns import TIME_KEYS, TOP_KEYS, asset_map, bbox_array, bbox_struct, col, format_time, parse_time, prune_null_assets, self_href
from skylattice.functions.crs import WGS84
from skylattice.functions.geo import geojson_from_wkb
from skylattice.sources.items import assets_replaced, replaced

#: The tag of WKB geometry columns.
GEOMETRY_TAG = {"ARROW:extension:name": "geoarrow.wkb", "ARROW:extension:metadata": json.dumps({"crs": WGS84})}


def flatten_properties(items: DataFrame, drop_invalid: bool = True) -> DataFrame:
    """Properties become columns. One named like another column is dropped with a warning, or raises ``ValueError``."""
    if "properties" not in items.columns:
        return items
    kind = items.schema["properties"].dataType
    taken = [c for c in items.columns if c != "properties"]
    clash = [n for n in kind.names if n in taken]
    if clash:
        message = "properties named like top-level fields: " + ", ".join(f"properties.{n}" for n in clash)
        if not drop_invalid:
            raise ValueError(message)
        warnings.warn(f"{message}; they are dropped", stacklevel=3)
    lifted = [col("properties").getField(n).alias(n) for n in kind.names if n not in clash]
    return items.select(*[col(c) for c in taken], *lifted)


def nest_properties(table: DataFrame) -> DataFrame:
    """All columns that aren't top-level fields become fields of ``properties``."""
    top = [c for c in table.columns if c in TOP_KEYS]
    rest = [c for c in table.columns if c not in TOP_KEYS]
    nested = [F.struct(*[col(c).alias(c) for c in rest]).alias("properties")] if rest else []
    return table.select(*[col(c) for c in top], *nested)


def parse_times(table: DataFrame, strict: bool = True) -> DataFrame:
    """Texts in the time columns become timestamps; void columns too; timestamps stay; other types raise."""
    out = {}
    for f in table.schema.fields:
        if f.name in TIME_KEYS:
            if isinstance(f.dataType, T.StringType):
                out[f.name] = parse_time(col(f.name), strict)
            elif isinstance(f.dataType, T.NullType):
                out[f.name] = F.lit(None).cast("timestamp")
            elif not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                raise ValueError(f"{f.name} has type {f.dataType.simpleString()}, not a time")
    return table.withColumns(out) if out else table


def format_times(table: DataFrame) -> DataFrame:
    times = [f.name for f in table.schema.fields if f.name in TIME_KEYS and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return table.withColumns({n: format_time(col(n)) for n in times}) if times else table


def bbox_size(table: DataFrame) -> int:
    """Numbers in the list boxes: 4 or 6. Null boxes don't count; mixed sizes and others raise; no box at all: 4."""
    sizes = sorted(r[0] for r in table.where("bbox is not null").select(F.size("bbox")).distinct().collect())
    if not sizes:
        return 4
    if len(sizes) > 1 or sizes[0] not in (4, 6):
        raise ValueError(f"bounding boxes must all have 4 or all 6 numbers; found {sizes}")
    return sizes[0]


def box_to_struct(table: DataFrame, size: int | None = None) -> DataFrame:
    if "bbox" not in table.columns or not isinstance(table.schema["bbox"].dataType, T.ArrayType):
        return table
    return table.withColumn("bbox", bbox_struct(F.col("bbox"), size or bbox_size(table)))


def box_to_array(table: DataFrame) -> DataFrame:
    if "bbox" not in table.columns or not isinstance(table.schema["bbox"].dataType, T.StructType):
        return table
    return table.withColumn("bbox", bbox_array(F.col("bbox"), table.schema["bbox"].dataType.names))


def to_table_layout(items: DataFrame, drop_invalid: bool = True, strict_times: bool = True, bbox_numbers: int | None = None) -> DataFrame:
    """Table layout of items in the JSON layout. ``bbox_numbers`` (4 or 6) saves the pass that finds it."""
    out = box_to_struct(parse_times(flatten_properties(items, drop_invalid), strict_times), bbox_numbers)
    return out.withMetadata("geometry", GEOMETRY_TAG) if "geometry" in out.columns else out


def to_json_layout(table: DataFrame) -> DataFrame:
    """JSON layout of a table: times as texts, nested properties, box as a list. Geometries stay WKB."""
    return box_to_array(nest_properties(format_times(table)))


def to_item_texts(table: DataFrame, inject_type: bool = True) -> DataFrame:
    """One JSON text an item, in ``item``. Assets that are null are left out; other nulls are written.

    ``inject_type``: items without a ``type`` get Feature.
    """
    if inject_type and "type" not in table.columns:
        table = table.select(F.lit("Feature").alias("type"), "*")
    rows = to_json_layout(table)
    fields = {f.name: f.dataType for f in rows.schema.fields}
    as_json = lambda c: F.parse_json(geojson_from_wkb(c))
    if "geometry" in fields:
        rows = rows.withColumn("geometry", as_json(F.col("geometry")))
    properties = fields.get("properties")
    if isinstance(properties, T.StructType) and "proj:geometry" in properties.names:
        rows = rows.withColumn("properties", replaced(F.col("properties"), properties, {"proj:geometry": as_json}))
    if "assets" in fields:
        kind = fields["assets"]
        if isinstance(kind, T.StructType):
            rows = rows.withColumn("assets", assets_replaced(F.col("assets"), kind, as_json))
        rows = rows.withColumn("assets", prune_null_assets(asset_map(F.col("assets"), kind)))
    return rows.select(F.to_json(F.struct(*[col(c).alias(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("item"))


def to_items(table: DataFrame):
    """Dicts of the items, one at a time; partitions are fetched as they are needed."""
    for row in to_item_texts(table, inject_type=False).toLocalIterator():
        yield json.loads(row["item"])


#: The order of the columns that come first in an item frame.
FRAME_ORDER = ("type", "stac_version", "stac_extensions", "id", "geometry", "bbox", "links", "assets", "collection")


def to_item_frame(items: DataFrame, add_self_link: bool = False, datetime_precision: str = "us") -> DataFrame:
    """Items as a flat frame: fixed columns first, then the properties, and ``self_link`` if asked for; lists as boxes.

    A property named like a top-level field always raises. Times are microseconds; ``ns`` isn't supported.
    """
    if datetime_precision != "us":
        raise ValueError("times have microseconds; datetime_precision must be 'us'")
    flat = parse_times(flatten_properties(items, drop_invalid=False), strict=False)
    if add_self_link:
        flat = flat.withColumn("self_link", self_href(F.col("links")))
    first = [c for c in FRAME_ORDER if c in flat.columns]
    return flat.select(*[col(c) for c in first], *[col(c) for c in flat.columns if c not in first])


def to_item_collection(table: DataFrame, by: str | None = None) -> DataFrame:
    """Feature collections as JSON texts in ``collection_json``: one of all items, or one for each value of ``by``.

    A collection is one text, so its items must fit into a row.
    """
    dropped = table.drop("self_link")
    keyed = to_item_texts(dropped) if by is None else to_item_texts(dropped).withColumn("key", F.get_json_object("item", f"$.{by}"))
    made = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("item")), ","), F.lit("]}"))
    grouped = keyed.groupBy() if by is None else keyed.groupBy(F.col("key").alias(by))
    return grouped.agg(made.alias("collection_json"), F.count("*").alias("n_items"))


def union_items(*tables: DataFrame) -> DataFrame:
    """All rows of tables whose columns may differ; missing ones are null, whole numbers widen to doubles."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
