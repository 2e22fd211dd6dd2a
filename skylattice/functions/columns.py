"""Times, boxes, links and assets as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the item format: the keys outside of properties, and the keys that hold times.
TOP_KEYS = ("stac_version", "stac_extensions", "type", "id", "bbox", "geometry", "collection", "links", "assets")
TIME_KEYS = ("datetime", "start_datetime", "end_datetime", "created", "updated", "expires", "published", "unpublished")

#: A date and time with a zone, and at most six digits of a second.
_STRICT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T\x20][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def parse_time(text: Column, strict: bool = True) -> Column:
    """Timestamp of an ISO text. Strict: texts without a zone or with over six digits of a second raise.

    Otherwise a missing zone is UTC (the session's zone) and further digits are cut.
    """
    value = F.to_timestamp(text)
    if not strict:
        return value
    return F.when(text.isNull() | text.rlike(_STRICT), value).otherwise(
        F.raise_error(F.concat(F.lit("time without zone or beyond microseconds: "), text)).cast("timestamp")
    )


def format_time(time: Column) -> Column:
    """ISO text in UTC with six digits of a second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


_CORNERS = {4: ("xmin", "ymin", "xmax", "ymax"), 6: ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")}


def bbox_struct(box: Column, size: int) -> Column:
    """Struct of doubles from a list of ``size`` (4 or 6) numbers; null stays null, other sizes raise."""
    if size not in _CORNERS:
        raise ValueError(f"a bounding box has 4 or 6 numbers, not {size}")
    made = F.struct(*[box[i].cast("double").alias(n) for i, n in enumerate(_CORNERS[size])])
    wrong = F.raise_error(F.concat(F.lit("mixed bounding boxes: "), F.size(box).cast("string"), F.lit(f" numbers instead of {size}")))
    return F.when(box.isNull(), F.lit(None)).when(F.size(box) == size, made).otherwise(wrong.cast(_box_type(size)))


def _box_type(size: int) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in _CORNERS[size]])


def bbox_array(box: Column, fields: list[str]) -> Column:
    """List of numbers from a struct with these fields."""
    names = _CORNERS.get(len(fields))
    if names is None or set(names) != set(fields):
        raise ValueError(f"not a bounding box: {fields}")
    return F.when(box.isNotNull(), F.array(*[box[n] for n in names]))


def self_href(links: Column) -> Column:
    """Target of the first link with ``rel`` self, no or a JSON media type, and an absolute URL; null if there is none."""
    media = lambda x: F.coalesce(x["type"], F.lit(""))
    fits = F.filter(
        links,
        lambda x: (x["rel"] == "self")
        & media(x).isin("", "application/json", "application/geo+json")
        & F.coalesce(F.try_parse_url(x["href"], F.lit("HOST")), F.lit("")).cast("string").__ne__(""),
    )
    return F.try_element_at(fits, F.lit(1))["href"]


def asset_map(assets: Column, kind: T.DataType) -> Column:
    """Assets as a map from name to a variant; struct fields become entries. Null fields of an asset are kept."""
    if isinstance(kind, T.MapType):
        return F.transform_values(assets, lambda _, v: F.parse_json(F.to_json(v, {"ignoreNullFields": "false"})))
    entries = [
        F.struct(F.lit(f.name).alias("key"), F.parse_json(F.to_json(assets.getField(f.name), {"ignoreNullFields": "false"})).alias("value"))
        if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))
        else F.struct(F.lit(f.name).alias("key"), F.parse_json(F.to_json(F.array(assets.getField(f.name))))[0].alias("value"))
        for f in kind.fields
    ]
    return F.when(assets.isNotNull(), F.map_from_entries(F.array(*entries)))


def prune_null_assets(assets: Column) -> Column:
    """The entries of a map of assets that aren't null."""
    return F.map_filter(assets, lambda _, v: v.isNotNull())
