"""One query for each operator, over the driver's tables, with the same query in DuckDB SQL.

Most use one view of ``events`` as items; its arithmetic is the same in both engines.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions.columns import asset_map, bbox_array, bbox_struct, format_time, parse_time, prune_null_assets, self_href
from skylattice.functions.geo import bounds_of_wkb, geojson_from_wkb, wkb_from_geojson
from skylattice.operators import catalog, export, layout
from skylattice.operators.search import bbox_intersects, search
from skylattice.sources.items import item_texts, parse_items, read_items
from skylattice.sources.schema import infer
from skylattice.sources.sinks import read_footers, sync_partitions, write_item_lines, write_item_parquet
from skylattice.streaming.sync import sync_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/skylattice-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in the table layout, made of ``events``."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    xmin = ((F.col("user_id") * 7 + k) % 360 - 180).cast("double")
    ymin = ((F.col("user_id") * 3 + F.col("event_id")) % 180 - 90).cast("double")
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_type").alias("collection"),
        F.col("ts").cast("timestamp").alias("datetime"),
        F.struct(xmin.alias("xmin"), ymin.alias("ymin"), (xmin + 1).alias("xmax"), (ymin + 1).alias("ymax")).alias("bbox"),
        k.alias("k"),
        F.col("value"),
        F.col("user_id"),
    )


_I = """(select 'evt_' || event_id as id, event_type as collection, ts as datetime, k, value, user_id, xmin, ymin, xmin + 1 as xmax, ymin + 1 as ymax
from (select *, cast((user_id * 7 + k) % 360 - 180 as double) as xmin, cast((user_id * 3 + event_id) % 180 - 90 as double) as ymin
from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)))"""
_BOX = "xmin <= 40 and xmax >= -40 and ymin <= 45 and ymax >= -45"
_BOUNDS = (-40.0, -45.0, 40.0, 45.0)


def _flat(items: DataFrame) -> DataFrame:
    return items.select("id", "collection", _ntz(F.col("datetime")).alias("datetime"), "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax", "k", "value")


def _utc(*parts: int) -> dt.datetime:
    return dt.datetime(*parts, tzinfo=dt.timezone.utc)


_COLS = "id, collection, datetime, xmin, ymin, xmax, ymax, k, value"


@query(f"select {_COLS} from {_I} where collection = 'click' and datetime >= timestamp '2024-01-05' and datetime < timestamp '2024-01-12' and {_BOX} and value < 20")
def flagship_search(spark, sf_dir):
    found = search(items_view(spark, sf_dir), "click", _utc(2024, 1, 5), _utc(2024, 1, 12), _BOUNDS, where=F.col("value") < 20)
    return _flat(found)


@query(f"select id, collection from {_I} where collection = 'click'")
def search_collection(spark, sf_dir):
    return search(items_view(spark, sf_dir), "click").select("id", "collection")


@query(f"select id, collection from {_I} where collection = 'view' and datetime >= timestamp '2024-01-10' and datetime < timestamp '2024-01-15'")
def search_collection_interval(spark, sf_dir):
    return catalog.catalog_rows(items_view(spark, sf_dir), "view", _utc(2024, 1, 10), _utc(2024, 1, 15)).select("id", "collection")


@query(f"select id, collection from {_I}")
def search_all(spark, sf_dir):
    return search(items_view(spark, sf_dir)).select("id", "collection")


@query(f"select id from {_I} where datetime >= timestamp '2024-01-20' and datetime < timestamp '2024-01-25'")
def search_open_end(spark, sf_dir):
    return search(items_view(spark, sf_dir), start=_utc(2024, 1, 20), now=_utc(2024, 1, 25)).select("id")


@query(f"select id from {_I} where ymin <= 10 and ymax >= -10 and (xmax >= 170 or xmin <= -170)")
def search_antimeridian(spark, sf_dir):
    return search(items_view(spark, sf_dir), bbox=(170.0, -10.0, -170.0, 10.0)).select("id")


def _cql2(node: dict) -> Query:
    return lambda spark, sf_dir: search(items_view(spark, sf_dir), cql2=node).select("id")


_P = lambda n: {"property": n}
for _name, _node, _where in (
    ("cql2_and_or_not", {"op": "or", "args": [{"op": "and", "args": [{"op": "=", "args": [_P("collection"), "click"]}, {"op": "not", "args": [{"op": "<", "args": [_P("k"), 50]}]}]}, {"op": ">=", "args": [_P("value"), 90]}]},
     "(collection = 'click' and not (k < 50)) or value >= 90"),
    ("cql2_between_in", {"op": "and", "args": [{"op": "between", "args": [_P("k"), 10, 40]}, {"op": "in", "args": [_P("collection"), ["click", "view"]]}]},
     "k between 10 and 40 and collection in ('click', 'view')"),
    ("cql2_like_isnull", {"op": "and", "args": [{"op": "like", "args": [_P("id"), "evt_1%"]}, {"op": "not", "args": [{"op": "isNull", "args": [_P("value")]}]}]},
     "id like 'evt_1%' and not (value is null)"),
    ("cql2_s_intersects_bbox", {"op": "s_intersects", "args": [_P("geometry"), {"bbox": list(_BOUNDS)}]}, _BOX),
    ("cql2_t_during", {"op": "t_during", "args": [_P("datetime"), {"interval": ["2024-01-05T00:00:00Z", "2024-01-08T00:00:00Z"]}]},
     "datetime > timestamp '2024-01-05' and datetime < timestamp '2024-01-08'"),
    ("cql2_t_intersects", {"op": "t_intersects", "args": [_P("datetime"), {"interval": ["2024-01-28T00:00:00Z", ".."]}]}, "datetime >= timestamp '2024-01-28'"),
):
    QUERIES[_name] = _cql2(_node)
    ORACLES[_name] = f"select id from {_I} where {_where}"


# --- layout


def _event_texts(spark: SparkSession, sf_dir: str, more: str = "") -> DataFrame:
    """Items as JSON texts, made of ``events``; ``more``: further properties as SQL fields."""
    return items_view(spark, sf_dir).selectExpr(
        f"""to_json(named_struct('type', 'Feature', 'id', id, 'collection', collection,
        'geometry', named_struct('type', 'Point', 'coordinates', array(bbox.xmin, bbox.ymin)),
        'bbox', array(bbox.xmin, bbox.ymin, bbox.xmax, bbox.ymax),
        'links', array(named_struct('rel', 'self', 'href', concat('https://example.com/', id), 'type', 'application/geo+json')),
        'assets', named_struct('data', named_struct('href', concat('https://example.com/', id, '.tif'))),
        'properties', named_struct('datetime', date_format(datetime, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), 'k', k, 'eo:cloud_cover', value {more})),
        map('ignoreNullFields', 'false')) as item"""
    )


@query(f"select id, k, value as cloud_cover, datetime from {_I}")
def flatten_properties(spark, sf_dir):
    table = layout.to_table_layout(parse_items(_event_texts(spark, sf_dir)), bbox_numbers=4)
    return table.select("id", "k", F.col("`eo:cloud_cover`").alias("cloud_cover"), _ntz(F.col("datetime")).alias("datetime"))


@query(f"select id, collection, k from {_I}")
def flatten_collision_drop(spark, sf_dir):
    items = parse_items(_event_texts(spark, sf_dir, ", 'collection', 'other'"))
    return layout.flatten_properties(items, drop_invalid=True).select("id", "collection", "k")


@query(f"select id, k, value from {_I}")
def nest_properties_json(spark, sf_dir):
    nested = layout.nest_properties(items_view(spark, sf_dir))
    props = F.to_json("properties")
    return nested.select("id", F.get_json_object(props, "$.k").cast("bigint").alias("k"), F.get_json_object(props, "$.value").cast("double").alias("value"))


@query(f"select id, strftime(datetime, '%Y-%m-%dT%H:%M:%S.%fZ') as datetime_text from {_I}")
def time_to_iso(spark, sf_dir):
    return items_view(spark, sf_dir).select("id", format_time(F.col("datetime")).alias("datetime_text"))


@query(f"select id, datetime from {_I}")
def time_roundtrip(spark, sf_dir):
    return items_view(spark, sf_dir).select("id", _ntz(parse_time(format_time(F.col("datetime")))).alias("datetime"))


@query(f"select id, datetime - interval 2 hours as datetime from {_I}")
def time_offset_normalise(spark, sf_dir):
    text = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS'+02:00'")
    return items_view(spark, sf_dir).select("id", _ntz(parse_time(text)).alias("datetime"))


@query("""select o_orderkey, cast(null as timestamp) as datetime, o_orderdate as start_datetime, max(l_shipdate) as end_datetime
from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate""")
def time_null_repair(spark, sf_dir):
    ends = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end_datetime"))
    orders = _table(spark, sf_dir, "orders").withColumns({"datetime": F.lit(None), "start_datetime": F.col("o_orderdate").cast("timestamp")})
    items = layout.parse_times(orders.join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    return items.select("o_orderkey", *[_ntz(F.col(c)).alias(c) for c in ("datetime", "start_datetime", "end_datetime")])


@query(f"select id, xmin, ymin, xmax, ymax from {_I}")
def bbox_to_struct(spark, sf_dir):
    box = F.array(*[F.col(f"bbox.{n}") for n in ("xmin", "ymin", "xmax", "ymax")])
    return items_view(spark, sf_dir).select("id", bbox_struct(box, 4).alias("b")).select("id", "b.*")


@query(f"select id, xmin as b0, ymin as b1, xmax as b2, ymax as b3, 4 as n from {_I}")
def bbox_to_array(spark, sf_dir):
    made = items_view(spark, sf_dir).select("id", bbox_array(F.col("bbox"), ["xmin", "ymin", "xmax", "ymax"]).alias("b"))
    return made.select("id", *[F.col("b")[i].alias(f"b{i}") for i in range(4)], F.size("b").alias("n"))


@query(f"select id, xmin, ymin, cast(k as double) as zmin, xmax, ymax, cast(k + 10 as double) as zmax from {_I}")
def bbox_3d(spark, sf_dir):
    box = F.array(F.col("bbox.xmin"), F.col("bbox.ymin"), F.col("k").cast("double"), F.col("bbox.xmax"), F.col("bbox.ymax"), (F.col("k") + 10).cast("double"))
    return items_view(spark, sf_dir).select("id", bbox_struct(box, 6).alias("b")).select("id", "b.*")


@query(f"select 4 as n_flat, 6 as n_solid, 4 as n_without, true as mixed_raises where exists (select 1 from {_I})")
def bbox_dim_check(spark, sf_dir):
    items = items_view(spark, sf_dir)
    boxes = lambda n: items.select(F.array_repeat(F.lit(0.0), n).alias("bbox"))
    none = items.select(F.lit(None).cast("array<double>").alias("bbox"))
    try:
        layout.bbox_size(boxes(4).unionByName(boxes(6)))
        raises = False
    except ValueError:
        raises = True
    sizes = [layout.bbox_size(x) for x in (boxes(4), boxes(6).unionByName(none), none)]
    return spark.createDataFrame([(*sizes, raises)], "n_flat int, n_solid int, n_without int, mixed_raises boolean")


def _polygon() -> Column:
    at = lambda x, y: F.array(F.col(f"bbox.{x}"), F.col(f"bbox.{y}"))
    ring = F.array(at("xmin", "ymin"), at("xmax", "ymin"), at("xmax", "ymax"), at("xmin", "ymax"), at("xmin", "ymin"))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def _point() -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array("bbox.xmin", "bbox.ymin").alias("coordinates")))


def _double_hex(value: str) -> str:
    """SQL for the little-endian hex of a double that is zero or a normal number."""
    exponent = f"cast(floor(log2(abs({value}))) as bigint)"
    sign = f"case when {value} < 0 then 2048 else 0 end"
    mantissa = f"cast((abs({value}) / pow(2.0, {exponent}) - 1) * 4503599627370496 as bigint)"
    big = f"case when {value} = 0 then '0000000000000000' else printf('%03X%013X', {exponent} + 1023 + {sign}, {mantissa}) end"
    return f"list_aggregate(list_transform(range(8), lambda j: substr({big}, cast(15 - 2 * j as bigint), 2)), 'string_agg', '')"


_HEX = f"(select id, {', '.join(f'{_double_hex(c)} as {c}' for c in ('xmin', 'ymin', 'xmax', 'ymax'))} from {_I})"


@query(f"select id, '0101000000' || xmin || ymin as wkb from {_HEX}")
def wkb_point_hex(spark, sf_dir):
    return items_view(spark, sf_dir).select("id", F.hex(wkb_from_geojson(_point())).alias("wkb"))


@query(f"""select id, '01030000000100000005000000' || xmin || ymin || xmax || ymin || xmax || ymax || xmin || ymax || xmin || ymin as wkb from {_HEX}""")
def wkb_polygon_hex(spark, sf_dir):
    return items_view(spark, sf_dir).select("id", F.hex(wkb_from_geojson(_polygon())).alias("wkb"))


@query(f"select id, xmin as x, ymin as y from {_I}")
def wkb_roundtrip_xy(spark, sf_dir):
    text = geojson_from_wkb(wkb_from_geojson(_point()))
    at = lambda i: F.get_json_object(text, f"$.coordinates[{i}]").cast("double")
    return items_view(spark, sf_dir).select("id", at(0).alias("x"), at(1).alias("y"))


@query(f"select id, xmin, ymin, xmax, ymax from {_I}")
def wkb_bounds(spark, sf_dir):
    return items_view(spark, sf_dir).select("id", bounds_of_wkb(wkb_from_geojson(_polygon())).alias("b")).select("id", "b.*")


@query(f"select id, cast(1 + (case when k % 2 = 0 then 1 else 0 end) + (case when k % 3 = 0 then 1 else 0 end) as integer) as n_assets from {_I}")
def asset_prune_nulls(spark, sf_dir):
    asset = lambda c: F.when(c, F.struct(F.lit("h").alias("href"), F.lit(None).cast("string").alias("title")))
    assets = F.struct(asset(F.lit(True)).alias("a"), asset(F.col("k") % 2 == 0).alias("b"), asset(F.col("k") % 3 == 0).alias("c"))
    made = items_view(spark, sf_dir).select("id", assets.alias("assets"))
    return made.select("id", F.size(prune_null_assets(asset_map(F.col("assets"), made.schema["assets"].dataType))).alias("n_assets"))


_LINES = "(select l_orderkey, l_linenumber, min(l_extendedprice) as price from lineitem group by l_orderkey, l_linenumber)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("price"))


def _order_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")), F.struct("price"))
    return _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("assets"))


@query(f"""select l_orderkey, min(case when l_linenumber = 1 then price end) as price_1, min(case when l_linenumber = 2 then price end) as price_2
from {_LINES} group by l_orderkey""")
def asset_pivot(spark, sf_dir):
    price = lambda n: F.try_element_at("assets", F.lit(f"line_{n}"))["price"]
    return _order_assets(spark, sf_dir).select("l_orderkey", price(1).alias("price_1"), price(2).alias("price_2"))


@query(f"select l_orderkey, 'line_' || l_linenumber as name, price from {_LINES}")
def asset_explode(spark, sf_dir):
    return _order_assets(spark, sf_dir).select("l_orderkey", F.explode("assets").alias("name", "asset")).select("l_orderkey", "name", "asset.price")


@query("""select page_id, case when page_id % 3 = 0 then null when page_id % 3 = 1 then url else url || '/alt' end as self_link,
case when page_id % 3 = 0 then null else regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) end as host from pages""")
def self_link(spark, sf_dir):
    link = lambda rel, href, kind: F.struct(F.lit(rel).alias("rel"), href.alias("href"), F.lit(kind).cast("string").alias("type"))
    url, which = F.col("url"), F.col("page_id") % 3
    links = (
        F.when(which == 0, F.array(link("parent", url, None), link("self", url, "text/html")))
        .when(which == 1, F.array(link("self", F.lit("relative/path"), None), link("self", url, "application/geo+json")))
        .otherwise(F.array(link("self", F.concat(url, F.lit("/alt")), ""), link("self", url, "application/json")))
    )
    made = _table(spark, sf_dir, "pages").select("page_id", self_href(links).alias("self_link"))
    return made.select("page_id", "self_link", F.try_parse_url("self_link", F.lit("HOST")).alias("host"))


@query(f"select id, 'Feature' as type from {_I}")
def type_inject(spark, sf_dir):
    texts = layout.to_item_texts(items_view(spark, sf_dir), inject_type=True)
    return texts.select(F.get_json_object("item", "$.id").alias("id"), F.get_json_object("item", "$.type").alias("type"))


@query("""select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then o_orderpriority end, c_mktsegment) as label, c_name as owner
from orders join customer on c_custkey = o_custkey""")
def hydrate_base_item(spark, sf_dir):
    bases = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("collection"),
        F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("label"), F.col("c_name").alias("owner")).alias("properties"))).alias("base"),
    )
    content = F.to_json(F.struct(F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("label")).alias("properties")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("collection"), content.alias("content"))
    rows = rows.join(bases.select("collection"), "collection", "left_semi")
    made = catalog.hydrate(rows, bases)
    leaf = lambda n: F.get_json_object("content", f"$.properties.{n}")
    return made.select("o_orderkey", leaf("label").alias("label"), leaf("owner").alias("owner"))


@query(f"select id, xmin, ymin, xmax, ymax, k from {_I}")
def catalog_rows_to_items(spark, sf_dir):
    rows = items_view(spark, sf_dir).select(
        "id", "collection", F.hex(wkb_from_geojson(_polygon())).alias("geometry"),
        F.to_json(F.struct(F.struct("k").alias("properties"))).alias("content"),
    )
    texts = catalog.rows_to_item_texts(rows)
    box = lambda i: F.get_json_object("item", f"$.bbox[{i}]").cast("double")
    return texts.select(
        F.get_json_object("item", "$.id").alias("id"), *[box(i).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))],
        F.get_json_object("item", "$.properties.k").cast("bigint").alias("k"),
    )


# --- partitions


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition for each collection and week."""
    week = F.date_trunc("week", "datetime").cast("timestamp")
    return items_view(spark, sf_dir).groupBy("collection", week.alias("lower")).agg(
        F.min("datetime").alias("first"), F.max("datetime").alias("last")
    ).withColumns({"upper": F.col("lower") + F.expr("interval 7 days"), "last_updated": F.col("last")})


_PARTS = f"""(select collection, date_trunc('week', datetime) as lower, date_trunc('week', datetime) + interval 7 days as upper, min(datetime) as start,
max(datetime) + interval 1 microsecond as "end", max(datetime) as last_updated from {_I} group by 1, 2, 3)"""
_FILE = "'items_' || strftime(lower, '%Y%m%d') || '_' || strftime(upper, '%Y%m%d') || '.parquet'"


def _partition_columns(parts: DataFrame) -> DataFrame:
    return parts.select("collection", "file", *[_ntz(F.col(c)).alias(c) for c in ("start", "end", "last_updated")])


@query(f'select collection, {_FILE} as file, start, "end", cast(last_updated as timestamp) as last_updated from {_PARTS}')
def partitions_view(spark, sf_dir):
    return _partition_columns(catalog.with_partition_files(_partitions(spark, sf_dir)))


@query(f"""select collection, {_FILE} as file, start, "end", cast(last_updated as timestamp) as last_updated from {_PARTS}
where last_updated >= timestamp '2024-01-20'""")
def partitions_updated_after(spark, sf_dir):
    return _partition_columns(catalog.with_partition_files(_partitions(spark, sf_dir), _utc(2024, 1, 20)))


@query(f"""select p.collection, {_FILE} as file, count(*) as n from {_PARTS} p join {_I} i on i.collection = p.collection and i.datetime >= p.start
and i.datetime < p."end" group by 1, 2""")
def partition_sync_assign(spark, sf_dir):
    parts = catalog.with_partition_files(_partitions(spark, sf_dir))
    return catalog.assign_partitions(items_view(spark, sf_dir), parts).groupBy("collection", "file").agg(F.count("*").alias("n"))


@query(f"""select p.collection, {_FILE} as file, count(*) as n from {_PARTS} p join {_I} i on i.collection = p.collection and i.datetime >= p.start
and i.datetime < p."end" where p.last_updated >= timestamp '2024-01-20' group by 1, 2""")
def partition_sync(spark, sf_dir):
    path = _scratch(spark, "sync")
    parts = catalog.with_partition_files(_partitions(spark, sf_dir), _utc(2024, 1, 20))
    sync_partitions(items_view(spark, sf_dir), parts, path)
    written = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return written.groupBy("collection", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


# --- schemas and unions


@query(f"""select id, k, cast(null as double) as value from {_I} where k < 50 union all by name select id, value from {_I} where k >= 50""")
def union_by_name_missing(spark, sf_dir):
    items = items_view(spark, sf_dir)
    return layout.union_items(items.where("k < 50").select("id", "k"), items.where("k >= 50").select("id", "value"))


@query(f"select id, case when k % 3 = 0 then null when k % 3 = 1 then cast(k as double) else k + 0.5 end as gsd from {_I}")
def schema_null_promote(spark, sf_dir):
    gsd = "case when k % 3 = 0 then 'null' when k % 3 = 1 then cast(k as string) else concat(cast(k as string), '.5') end"
    texts = items_view(spark, sf_dir).selectExpr(f"""concat('{{"id":"', id, '","gsd":', {gsd}, '}}') as item""")
    return parse_items(texts).select("id", F.col("gsd").cast("double").alias("gsd"))


@query(f"""select key, count(*) as n from (select unnest(json_keys(case when k % 2 = 0 then '{{"a": 1, "b": 2}}' else '{{"b": 2, "c": 3}}' end)) as key from {_I})
group by key""")
def schema_presence_profile(spark, sf_dir):
    text = F.when(F.col("k") % 2 == 0, F.lit('{"a": 1, "b": 2}')).otherwise(F.lit('{"b": 2, "c": 3}'))
    return items_view(spark, sf_dir).select(F.explode(F.json_object_keys(text)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query(f"""select * from (values ('collection', 'string'), ('id', 'string'), ('k', 'bigint'), ('nothing', 'string'), ('value', 'double')) t(name, type)
where exists (select 1 from {_I})""")
def schema_infer(spark, sf_dir):
    texts = items_view(spark, sf_dir).select(
        F.to_json(F.struct("id", "collection", "k", "value", F.lit(None).cast("string").alias("nothing")), {"ignoreNullFields": "false"}).alias("item")
    )
    found = infer(texts).schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found.fields], "name string, type string")


# --- sources and sinks


_BASE = f"select id, collection, datetime, xmin, ymin, k from {_I}"


def _base(table: DataFrame) -> DataFrame:
    return table.select("id", "collection", _ntz(F.col("datetime")).alias("datetime"), "bbox.xmin", "bbox.ymin", "k")


@query(_BASE)
def ndjson_roundtrip(spark, sf_dir):
    path = _scratch(spark, "lines")
    table = layout.to_table_layout(parse_items(_event_texts(spark, sf_dir)), bbox_numbers=4)
    write_item_lines(table, path, mode="overwrite")
    return _base(layout.to_table_layout(read_items(spark, path, form="lines"), bbox_numbers=4))


@query(_BASE)
def parquet_roundtrip(spark, sf_dir):
    path = _scratch(spark, "items")
    table = layout.to_table_layout(parse_items(_event_texts(spark, sf_dir)), bbox_numbers=4)
    write_item_parquet(table, path)
    return _base(spark.read.parquet(path))


def _folded(spark: SparkSession, sf_dir: str, opening: str, closing: str, name: str) -> DataFrame:
    path = _scratch(spark, name)
    texts = _event_texts(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(64)))
    joined = texts.groupBy("part").agg(F.array_join(F.collect_list("item"), ",\n").alias("items"))
    joined.select(F.concat(F.lit(opening), "items", F.lit(closing)).alias("value")).repartition(8, "value").write.option("maxRecordsPerFile", 1).text(path)
    return _base(layout.to_table_layout(read_items(spark, path, form="files"), bbox_numbers=4))


@query(_BASE)
def read_array_json(spark, sf_dir):
    return _folded(spark, sf_dir, "[\n", "\n]", "arrays")


@query(_BASE)
def read_feature_collection(spark, sf_dir):
    return _folded(spark, sf_dir, '{"type": "FeatureCollection", "features": [', "]}", "collections")


@query(_BASE)
def read_auto(spark, sf_dir):
    path = _scratch(spark, "auto")
    _event_texts(spark, sf_dir).select(F.col("item").alias("value")).write.text(path)
    return _base(layout.to_table_layout(read_items(spark, path), bbox_numbers=4))


@query(f"select least(25, count(*)) as n, least(25, count(*)) as n_known from {_I}")
def limit_exact(spark, sf_dir):
    path = _scratch(spark, "limited")
    _event_texts(spark, sf_dir).select(F.col("item").alias("value")).write.text(path)
    found = read_items(spark, path, form="lines", limit=25).select("id")
    known = items_view(spark, sf_dir).select(F.col("id").alias("known"))
    return found.join(known, F.col("id") == F.col("known"), "left").agg(F.count("*").alias("n"), F.count_distinct("known").alias("n_known"))


def _with_metadata(item: dict) -> dict:
    item["assets"] = {**(item.get("assets") or {}), "metadata": {"href": f"https://example.com/{item['collection']}/{item['id']}.json"}}
    return item


@query(f"select id, 'https://example.com/' || collection || '/' || id || '.json' as added_href from {_I}")
def row_func_inject_asset(spark, sf_dir):
    changed = export.map_items(_event_texts(spark, sf_dir), _with_metadata)
    return changed.select(F.get_json_object("item", "$.id").alias("id"), F.get_json_object("item", "$.assets.metadata.href").alias("added_href"))


@query(f"""select '1.1.0' as version, 'geometry' as primary_column, 'WKB' as encoding, 4326 as epsg, 'xmin' as covering, true as in_all_files
where exists (select 1 from {_I})""")
def item_parquet_footers(spark, sf_dir):
    path = _scratch(spark, "footers")
    write_item_parquet(layout.to_table_layout(parse_items(_event_texts(spark, sf_dir)), bbox_numbers=4), path, collections={"click": {"id": "click"}})
    seen = set(read_footers(path))
    geo, item = (json.loads(x) for x in next(iter(seen)))
    geometry = geo["columns"]["geometry"]
    row = (geo["version"], geo["primary_column"], geometry["encoding"], geometry["crs"]["id"]["code"], geometry["covering"]["bbox"]["xmin"][1],
           len(seen) == 1 and item["collections"] == {"click": {"id": "click"}})
    return spark.createDataFrame([row], "version string, primary_column string, encoding string, epsg int, covering string, in_all_files boolean")


@query(f"select id, k, xmin, ymin, collection from {_I}")
def catalog_sync_files(spark, sf_dir):
    path = _scratch(spark, "catalog-sync")
    rows = items_view(spark, sf_dir).select(
        "id", F.hex(wkb_from_geojson(_point())).alias("geometry"), "collection", "datetime", F.lit(None).cast("timestamp").alias("end_datetime"),
        F.to_json(F.struct(F.struct(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("datetime"), "k").alias("properties"))).alias("content"),
    )
    base = '{"type": "Feature", "stac_version": "1.0.0", "properties": {"k": -1}}'
    bases = items_view(spark, sf_dir).select("collection").distinct().withColumn("base", F.lit(base))
    export.catalog_sync(spark, rows, _partitions(spark, sf_dir), path, bases=bases)
    written = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return written.select("id", F.col("k").cast("bigint").alias("k"), "bbox.xmin", "bbox.ymin", "collection")


@query(f"select collection, count(*) as n_items, cast(count(*) as integer) as n_features from {_I} group by collection")
def feature_collection_agg(spark, sf_dir):
    made = layout.to_item_collection(items_view(spark, sf_dir).select("id", "collection", "k"), by="collection")
    return made.select("collection", "n_items", F.json_array_length(F.get_json_object("collection_json", "$.features")).alias("n_features"))


@query(f"select id, collection, k, value from {_I}")
def stream_available_now(spark, sf_dir):
    source, target, checkpoint = (_scratch(spark, f"stream-{x}") for x in ("in", "out", "state"))
    rows = items_view(spark, sf_dir).select("id", "collection", "k", "value")
    rows.write.parquet(source)
    sync_available(spark, source, target, checkpoint, rows.schema)
    return spark.read.schema(T.StructType([rows.schema[c] for c in ("id", "k", "value", "collection")])).parquet(target).select(rows.columns)


@query(f"select id, xmin, ymin, xmax, ymax, k, strftime(datetime, '%Y-%m-%dT%H:%M:%S.%fZ') as datetime_text from {_I}")
def item_frame_legacy(spark, sf_dir):
    frame = layout.to_item_frame(parse_items(_event_texts(spark, sf_dir)), add_self_link=True)
    box = [F.col("bbox")[i].alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))]
    return frame.select("id", *box, "k", format_time(F.col("datetime")).alias("datetime_text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship search over the whole month."""
    found = search(items_view(spark, sf_dir), "click", _utc(2024, 1, 1), _utc(2024, 2, 1), _BOUNDS, where=F.col("value") < 20)
    return _flat(found)


__all__ = ["ORACLES", "QUERIES", "bbox_intersects", "flagship", "items_view"]
