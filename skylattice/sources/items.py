"""Reading items: newline-delimited JSON, arrays, feature collections, lists of dicts, Arrow and pandas tables."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions.columns import col
from skylattice.functions.geo import wkb_from_geojson
from skylattice.sources.schema import InferredSchema, infer, same_schema


def _each_item(value: Column) -> Column:
    """Items in a JSON text: the elements of an array, the features of a collection, or the object itself."""
    collection = F.from_json(value, "features array<string>")["features"]
    looks = F.ltrim(value, F.lit(" \t\r\n"))
    return (
        F.when(looks.startswith("["), F.from_json(value, "array<string>"))
        .when(value.contains('"features"') & collection.isNotNull(), collection)
        .otherwise(F.array(value))
    )


def item_texts(spark: SparkSession, paths: str | Iterable[str], form: str = "auto") -> DataFrame:
    """One JSON text an item, in the column ``item``, its digits and blanks untouched.

    ``form``: ``lines`` (each line is an item, array or collection), ``files`` (each file is one), or ``auto``, which
    reads a file by lines if each of its lines is JSON; that costs one pass. Blank lines are skipped, and files without
    any have no items.
    """
    paths = [paths] if isinstance(paths, str) else [str(p) for p in paths]
    if form not in ("auto", "lines", "files"):
        raise ValueError(f"unknown form: {form}")
    if form == "auto":
        lines = spark.read.text(paths).select(F.input_file_name().alias("file"), "value").where(F.trim("value") != "")
        whole = F.try_parse_json("value")
        by_lines = lines.groupBy("file").agg(F.bool_and(whole.isNotNull()).alias("ok")).collect()
        parts = [
            item_texts(spark, [r["file"] for r in by_lines if r["ok"] == ok], kind)
            for ok, kind in ((True, "lines"), (False, "files"))
            if any(r["ok"] == ok for r in by_lines)
        ]
        if not parts:
            return spark.createDataFrame([], "item string")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    texts = spark.read.text(paths, wholetext=form == "files").where(F.trim("value") != "")
    checked = F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 200)))
    )
    return texts.select(F.explode(_each_item(checked)).alias("item"))


def parse_items(texts: DataFrame, schema: T.StructType | InferredSchema | None = None, strict: bool = True, infer_limit: int | None = None) -> DataFrame:
    """Items in the JSON layout from the texts in ``item``: nested properties, list boxes, geometries as WKB.

    Without a schema all texts are looked at first, or ``infer_limit`` of them: then other texts must have the same
    schema, or it raises.
    """
    if schema is None:
        found = infer(texts, strict, infer_limit)
        if infer_limit is not None and not same_schema(found.schema, infer(texts, strict).schema):
            raise ValueError("the schemas of the items differ")
        schema = found
    if isinstance(schema, InferredSchema):
        schema = schema.schema
    asked = _geometry_as_text(schema)
    rows = texts.select(F.from_json("item", asked, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    return encode_geometries(rows)


def _geometry_as_text(kind: T.DataType, path: str = "") -> T.DataType:
    if path == "geometry" or path.endswith("proj:geometry"):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _geometry_as_text(f.dataType, f"{path}.{f.name}".lstrip("."))) for f in kind.fields])
    return kind


def encode_geometries(rows: DataFrame) -> DataFrame:
    """GeoJSON texts to WKB: ``geometry``, and ``proj:geometry`` in properties and in every asset."""
    fields = {f.name: f.dataType for f in rows.schema.fields}
    out = rows
    if isinstance(fields.get("geometry"), T.StringType):
        out = out.withColumn("geometry", wkb_from_geojson("geometry"))
    properties = fields.get("properties")
    if isinstance(properties, T.StructType) and "proj:geometry" in properties.names:
        out = out.withColumn("properties", replaced(col("properties"), properties, {"proj:geometry": wkb_from_geojson}))
    elif isinstance(fields.get("proj:geometry"), T.StringType):
        out = out.withColumn("proj:geometry", wkb_from_geojson(col("proj:geometry")))
    assets = fields.get("assets")
    if isinstance(assets, T.StructType):
        out = out.withColumn("assets", assets_replaced(col("assets"), assets, wkb_from_geojson))
    return out


def replaced(struct: Column, kind: T.StructType, changes: dict) -> Column:
    """The struct with some fields changed by functions; null stays null."""
    parts = [changes.get(f.name, lambda c: c)(struct.getField(f.name)).alias(f.name) for f in kind.fields]
    return F.when(struct.isNotNull(), F.struct(*parts))


def assets_replaced(assets: Column, kind: T.StructType, change) -> Column:
    """Assets with ``proj:geometry`` of every asset changed."""
    has = [f for f in kind.fields if isinstance(f.dataType, T.StructType) and "proj:geometry" in f.dataType.names]
    if not has:
        return assets
    inner = {f.name: (lambda c, f=f: replaced(c, f.dataType, {"proj:geometry": change})) for f in has}
    return replaced(assets, kind, inner)


def read_items(
    spark: SparkSession, paths: str | Iterable[str], form: str = "auto", schema: T.StructType | InferredSchema | None = None,
    strict: bool = True, limit: int | None = None, infer_limit: int | None = None,
) -> DataFrame:
    """Items of JSON files in the JSON layout. ``limit``: so many items; ``infer_limit``: see ``parse_items``.

    The schema is that of all items. With ``infer_limit`` it is that of the first ones, which the others must have.
    """
    texts = item_texts(spark, paths, form)
    return parse_items(texts if limit is None else texts.limit(limit), schema, strict, infer_limit)


def from_items(spark: SparkSession, items: Iterable, schema: T.StructType | InferredSchema | None = None, strict: bool = True) -> DataFrame:
    """Items of dicts, or of objects with ``to_dict``, in the JSON layout. No items: ``ValueError``."""
    rows = [(json.dumps(x if isinstance(x, dict) else x.to_dict(transform_hrefs=False)),) for x in items]
    if not rows:
        raise ValueError("no items")
    return parse_items(spark.createDataFrame(rows, "item string"), schema, strict)


def from_table(spark: SparkSession, table) -> DataFrame:
    """A table in either layout: a DataFrame as it is, else an Arrow or pandas table, or any Arrow stream."""
    if isinstance(table, DataFrame):
        return table
    if hasattr(table, "__arrow_c_stream__") and not hasattr(table, "to_pandas"):
        import pyarrow as pa

        table = pa.table(pa.RecordBatchReader.from_stream(table).read_all())
    return spark.createDataFrame(table)
