import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import skylattice as sky
from skylattice.functions.geo import encode
from skylattice.operators.catalog import catalog_rows, dsn, hydrate, merge, rows_to_item_texts
from skylattice.operators.search import bbox_intersects, clustered, from_cql2
from skylattice.sources.jdbc import catalog_source
from tests.samples import scene


def test_merge():
    base = {"a": 1, "assets": {"x": {"gsd": 10, "type": "t"}}, "l": [{"p": 1}, {"p": 2}], "gone": 1}
    item = {"assets": {"x": {"href": "h", "gsd": 20}, "y": {}}, "l": [{"q": 1}, {"p": 3}], "gone": "#"}
    assert merge(base, item, unset="#") == {
        "a": 1, "assets": {"x": {"gsd": 20, "type": "t", "href": "h"}, "y": {}}, "l": [{"p": 1, "q": 1}, {"p": 3}],
    }
    assert merge([1], [2, 3]) == [2, 3]


def _rows(spark):
    g = {"type": "Polygon", "coordinates": [[[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 0.0]]]}
    content = {"assets": {"x": {"href": "h"}}, "properties": {"k": 1}, "private": 1}
    return spark.createDataFrame(
        [("a", encode(g).hex(), "c", json.dumps(content)), ("b", None, "c", json.dumps(content | {"bbox": [1, 2, 3, 4]}))],
        "id string, geometry string, collection string, content string",
    )


def test_rows_become_items(spark):
    bases = spark.createDataFrame([("c", json.dumps({"stac_version": "1.0.0", "assets": {"x": {"type": "t"}}}))], "collection string, base string")
    got = {x["id"]: x for x in (json.loads(r[0]) for r in rows_to_item_texts(_rows(spark), bases).collect())}
    assert got["a"]["bbox"] == [0, 0, 2, 1] and got["b"]["bbox"] == [1, 2, 3, 4]
    assert got["a"]["assets"] == {"x": {"href": "h", "type": "t"}} and got["a"]["stac_version"] == "1.0.0"
    assert "private" not in got["a"] and "links" not in got["a"] and got["b"].get("geometry") is None


def test_missing_base_item(spark):
    bases = spark.createDataFrame([("d", "{}")], "collection string, base string")
    with pytest.raises(Exception, match="no base item for collection c"):
        hydrate(_rows(spark), bases).collect()


def test_conditions(spark):
    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.timezone.utc)
    rows = spark.createDataFrame([(n, "a" if n % 2 else "b", day(n)) for n in range(1, 9)], "n int, collection string, datetime timestamp")
    ids = lambda df: sorted(r["n"] for r in df.collect())
    assert ids(catalog_rows(rows, "a", day(3), day(7))) == [3, 5]
    assert ids(catalog_rows(rows, start=day(7), now=day(8))) == [7]
    assert ids(catalog_rows(rows, end=day(3))) == [1, 2]
    assert ids(catalog_rows(rows)) == list(range(1, 9))
    assert ids(catalog_rows(rows, cql2={"op": "in", "args": [{"property": "n"}, [1, 2]]})) == [1, 2]
    with pytest.raises(ValueError):
        catalog_rows(rows, "a", cql2={"op": "=", "args": [1, 1]})
    assert catalog_source(spark, rows) is rows and catalog_source(spark, lambda s: rows) is rows


def test_dsn():
    assert dsn("host=x dbname=y", "catalog,public", 500) == "host=x dbname=y options='-c search_path=catalog,public -c statement_timeout=500'"
    assert dsn("host=x options='-c a=b'") == "host=x options='-c a=b -c search_path=public'"


def test_cql2(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, "abd", 5), (3, "x", 7)], "n int, s string, `eo:v` int")
    ids = lambda node: sorted(r["n"] for r in rows.where(from_cql2(node)).collect())
    p = lambda n: {"property": n}
    assert ids({"op": "like", "args": [p("s"), "ab%"]}) == [1, 2]
    assert ids({"op": "isNull", "args": [p("eo:v")]}) == [1]
    assert ids({"op": "not", "args": [{"op": "between", "args": [p("eo:v"), 5, 6]}]}) == [3]
    assert ids({"op": "or", "args": [{"op": "=", "args": [p("n"), 1]}, {"op": ">", "args": [p("eo:v"), 6]}]}) == [1, 3]
    with pytest.raises(ValueError, match="casei"):
        from_cql2({"op": "casei", "args": []})
    with pytest.raises(ValueError):
        from_cql2({"op": "s_intersects", "args": [p("geometry"), {"type": "Polygon", "coordinates": [[[0, 0], [5, 5], [0, 9], [0, 0]]]}]})


def test_boxes(spark):
    rows = spark.createDataFrame([(1, (170.0, 0.0, 175.0, 1.0)), (2, (-179.0, 0.0, -178.0, 1.0)), (3, (0.0, 0.0, 1.0, 1.0)), (4, None)],
                                 "n int, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    ids = lambda q: sorted(r["n"] for r in rows.where(bbox_intersects(F.col("bbox"), q)).collect())
    assert ids((160, -5, -170, 5)) == [1, 2] and ids((1, 1, 2, 2)) == [3] and ids((2, 2, 3, 3)) == []
    assert clustered(rows, 2).count() == 4


def test_flagship_on_items(spark):
    table = sky.to_table_layout(sky.from_items(spark, [scene(1), scene(2, **{"eo:cloud_cover": 80.5})]))
    found = sky.search(table, "scenes", dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc), dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc),
                       (10, 45, 11, 46), where=F.col("`eo:cloud_cover`") < 20)
    assert [r["id"] for r in found.collect()] == ["scene-1"]


def test_connection_strings():
    end = "options='-c search_path=public'"
    assert dsn(None) == dsn("") == end
    assert dsn("host=h  port = 5432 password='a b\\'c'") == f"host=h port=5432 password='a b\\'c' {end}"
    assert dsn("postgresql://u:p%40w@h:5433/db?sslmode=require") == f"user=u password=p@w host=h port=5433 dbname=db sslmode=require {end}"
    assert dsn("postgres://[::1]:5/x,y") == f"host=::1 port=5 dbname=x,y {end}"
    assert dsn("postgresql://a:1,b:2/db").startswith("host=a,b port=1,2 dbname=db")
    assert dsn("options='-c a=b' host=x", "s,public", 5) == "host=x options='-c a=b -c search_path=s,public -c statement_timeout=5'"
    for wrong in ("host", "host='x", "=x"):
        with pytest.raises(ValueError):
            dsn(wrong)


def test_catalog_sync(spark, tmp_path):
    from skylattice.sources.sinks import read_footers

    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.timezone.utc)
    content = json.dumps({"properties": {"datetime": "2024-01-02T00:00:00Z", "n": 1}, "assets": {}, "links": [], "stac_version": "1.0.0"})
    rows = spark.createDataFrame(
        [(f"i{n}", "0101000000000000000000F03F0000000000000040", "c", day(2), None, content) for n in range(3)],
        "id string, geometry string, collection string, datetime timestamp, end_datetime timestamp, content string",
    )
    parts = spark.createDataFrame(
        [("c", None, None, None, None, day(3))], "collection string, lower timestamp, upper timestamp, first timestamp, last timestamp, last_updated timestamp"
    )
    path = str(tmp_path / "out")
    change = lambda item: {**item, "properties": {**item["properties"], "n": 2}}
    assert sky.catalog_sync(spark, rows, parts, path, change=change) == [f"{path}/c/items.parquet"]
    assert [r["n"] for r in spark.read.parquet(f"{path}/c/items.parquet").collect()] == [2, 2, 2]
    assert len(list(read_footers(path))) == 1 and sky.catalog_sync(spark, rows, parts, path, updated_after=day(9)) == []


def test_all_keys_of_a_base_item(spark):
    rows = spark.createDataFrame(
        [("i", "0101000000000000000000F03F0000000000000040", c, '{"properties": {"k": 1}, "mine": 1}') for c in ("a", "b")],
        "id string, geometry string, collection string, content string",
    )
    bases = spark.createDataFrame([("a", '{"type": "Feature", "extra": {"x": [1, "y"]}, "note": null, "properties": {"z": 2}}'), ("b", '{"properties": {}}')], "collection string, base string")
    got = {x["collection"]: x for x in (json.loads(r["item"]) for r in rows_to_item_texts(rows, bases).collect())}
    assert got["a"]["extra"] == {"x": [1, "y"]} and got["a"]["properties"] == {"k": 1, "z": 2} and "mine" not in got["a"]
    assert set(got["b"]) == {"type", "id", "collection", "geometry", "bbox", "properties"}
