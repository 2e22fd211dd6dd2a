import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import skylattice as sky
from skylattice.compare import assert_items_equal, differences
from skylattice.functions.columns import bbox_struct, parse_time, self_href
from skylattice.operators import layout
from skylattice.sources.schema import parse_type, same_schema
from tests.samples import point, scene


def _round(spark, items):
    return sorted(sky.to_items(sky.to_table_layout(sky.from_items(spark, items))), key=lambda x: x["id"])


def test_round_trip(spark):
    items = [scene(1), scene(2, datetime=None, created="2024-01-01T00:00:00+02:00", gsd=0.25)]
    assert_items_equal(_round(spark, items), items)


def test_assets_that_items_lack_stay_away(spark):
    items = [point(1, assets={"a": {"href": "x", "title": None}}), point(2, assets={"b": {"href": "y"}}), point(3, assets={})]
    out = _round(spark, items)
    assert [sorted(x["assets"]) for x in out] == [["a"], ["b"], []]
    assert "title" in out[0]["assets"]["a"]


def test_null_geometry_and_box(spark):
    out = _round(spark, [point(1), point(2, geometry=None, bbox=None)])
    assert out[1]["geometry"] is None and out[1]["bbox"] is None


def test_projected_geometry(spark):
    g = {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]}
    items = [scene(1, **{"proj:geometry": g}), scene(2)]
    items[0]["assets"]["image"]["proj:geometry"] = g
    table = sky.to_table_layout(sky.from_items(spark, items))
    assert table.schema["proj:geometry"].dataType == T.BinaryType()
    assert_items_equal(sorted(sky.to_items(table), key=lambda x: x["id"]), items)


def test_three_dimensional_boxes(spark):
    items = [point(1, bbox=[1, 2, 3, 4, 5, 6])]
    table = sky.to_table_layout(sky.from_items(spark, items))
    assert table.schema["bbox"].dataType.names == ["xmin", "ymin", "zmin", "xmax", "ymax", "zmax"]
    assert_items_equal(list(sky.to_items(table)), items)


def test_mixed_boxes_raise(spark):
    items = sky.from_items(spark, [point(1), point(2, bbox=[1, 2, 3, 4, 5, 6])])
    with pytest.raises(ValueError, match="all 6"):
        sky.to_table_layout(items)
    with pytest.raises(ValueError):
        bbox_struct(F.col("bbox"), 5)


def test_clashing_properties(spark):
    item = point(1)
    item["properties"] |= {"collection": "other", "geometry": 1}
    items = sky.from_items(spark, [item])
    with pytest.warns(UserWarning, match="properties.collection"):
        table = sky.to_table_layout(items)
    assert table.columns.count("collection") == 1 and table.first()["collection"] == "points"
    with pytest.raises(ValueError, match="properties.geometry"):
        sky.to_table_layout(items, drop_invalid=False)
    with pytest.raises(ValueError):
        sky.to_item_frame(items)


def test_no_items(spark):
    with pytest.raises(ValueError, match="no items"):
        sky.from_items(spark, [])


def test_types_of_inference():
    got = parse_type("OBJECT<`a:b`: ARRAY<OBJECT<x: DECIMAL(3,1), y: VOID>>, `q``t`: OBJECT<>, s: STRING>")
    assert got.names == ["a:b", "q`t", "s"] and got["q`t"].dataType == T.StructType([])
    assert got["a:b"].dataType.elementType["x"].dataType == T.DoubleType()
    with pytest.raises(ValueError):
        parse_type("NOTHING")


def _texts(spark, *items):
    return spark.createDataFrame([(json.dumps(x),) for x in items], "item string")


def test_inference_widens_and_repairs(spark):
    found = sky.infer(_texts(spark, {"a": 1, "n": None, "datetime": None, "l": []}, {"a": 1.5, "n": None, "l": [1], "o": {}}))
    types = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    assert types == {"a": "double", "n": "string", "datetime": "string", "l": "array<bigint>", "o": "map<string,string>"}
    assert found.count == 2 and "n" in found.only_null


@pytest.mark.parametrize("a,b", [(1, "x"), (True, 1), ({"x": 1}, "x")])
def test_conflicts(spark, a, b):
    texts = _texts(spark, {"p": {"k": a}}, {"p": {"k": b}})
    with pytest.raises(ValueError, match="p.k"):
        sky.infer(texts)
    assert sky.infer(texts, strict=False).conflicts == ["p.k"]


def test_first_items_must_be_like_the_rest(spark):
    from skylattice.sources.items import parse_items

    texts = _texts(spark, {"a": 1}, {"a": 1, "b": 2}).coalesce(1)
    with pytest.raises(ValueError, match="differ"):
        parse_items(texts, infer_limit=1)
    assert same_schema(T.StructType([]), T.StructType([]))


FORMS = {
    "lines": lambda items: "\n".join(map(json.dumps, items)) + "\n\n",
    "array lines": lambda items: "\n".join(json.dumps([x]) for x in items),
    "compact array": json.dumps,
    "pretty array": lambda items: json.dumps(items, indent=2),
    "collection": lambda items: json.dumps({"type": "FeatureCollection", "features": items}),
    "pretty collection": lambda items: json.dumps({"type": "FeatureCollection", "features": items}, indent=1),
}


@pytest.mark.parametrize("form", FORMS)
def test_input_forms(spark, tmp_path, form):
    items = [scene(1), scene(2)]
    (tmp_path / "x.json").write_text(FORMS[form](items))
    out = sorted(sky.to_items(sky.to_table_layout(sky.read_items(spark, str(tmp_path / "x.json")))), key=lambda x: x["id"])
    assert_items_equal(out, items)


def test_pretty_single_item_and_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(scene(1), indent=2))
    (tmp_path / "b.json").write_text(json.dumps(scene(2)))
    (tmp_path / "c.json").write_text("\n")
    paths = [str(tmp_path / n) for n in ("a.json", "b.json", "c.json")]
    assert sky.read_items(spark, paths).count() == 2
    assert sky.read_items(spark, paths, limit=1).count() == 1


def test_broken_json_raises(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "a"}\n{"id": ')
    with pytest.raises(Exception, match="not JSON"):
        sky.read_items(spark, str(tmp_path / "x.json"), form="lines").collect()


def test_digits_are_kept(spark):
    text = '{"id":"a","geometry":{"type":"Point","coordinates":[-105.10190000000001, 2.50]},"properties":{}}'
    from skylattice.sources.items import parse_items

    table = parse_items(spark.createDataFrame([(text,)], "item string"))
    assert json.loads(sky.to_item_texts(table).first()[0])["geometry"]["coordinates"] == [-105.10190000000001, 2.5]


@pytest.mark.parametrize("text,ok", [
    ("2024-01-01T00:00:00Z", True), ("2024-01-01 00:00:00.5+02:00", True), ("2024-01-01T00:00:00.123456Z", True),
    ("2024-01-01T00:00:00", False), ("2024-01-01T00:00:00.123456789Z", False), ("yesterday", False),
])
def test_times(spark, text, ok):
    rows = spark.createDataFrame([(text,)], "t string").select(parse_time(F.col("t")).alias("t"))
    if ok:
        assert rows.first()["t"] is not None
    else:
        with pytest.raises(Exception):
            rows.collect()


def test_time_columns_of_other_types(spark):
    with pytest.raises(ValueError, match="created"):
        layout.parse_times(spark.createDataFrame([(1,)], "created int"))
    assert layout.parse_times(spark.sql("select null as updated")).schema["updated"].dataType == T.TimestampType()


def test_self_links(spark):
    rows = spark.createDataFrame(
        [(1, [("self", "rel/path", None), ("self", "https://a.b/c", "")]), (2, [("self", "https://a.b/c", "text/html")]), (3, []), (4, None),
         (5, [("self", "https://a.b/x", "application/geo+json"), ("self", "https://a.b/y", None)])],
        "n int, links array<struct<rel:string,href:string,type:string>>",
    )
    got = {r["n"]: r["h"] for r in rows.select("n", self_href(F.col("links")).alias("h")).collect()}
    assert got == {1: "https://a.b/c", 2: None, 3: None, 4: None, 5: "https://a.b/x"}


def test_item_frame(spark):
    frame = sky.to_item_frame(sky.from_items(spark, [scene(1)]), add_self_link=True)
    assert frame.columns[:9] == list(layout.FRAME_ORDER) and frame.first()["self_link"].endswith("scene-1")
    with pytest.raises(ValueError):
        sky.to_item_frame(frame, datetime_precision="ns")


def test_item_collection(spark):
    items = [scene(1), scene(2)]
    got = json.loads(sky.to_item_collection(sky.to_table_layout(sky.from_items(spark, items))).first()["collection_json"])
    assert_items_equal(got, {"type": "FeatureCollection", "features": items})


def test_union_and_arrow_input(spark):
    a, b = (sky.to_table_layout(sky.from_items(spark, [x])) for x in (scene(1), point(2)))
    assert layout.union_items(a.drop("assets", "links"), b.drop("assets", "links")).count() == 2
    assert sky.from_table(spark, pa.table({"id": ["x"]})).first()["id"] == "x"
    reader = pa.RecordBatchReader.from_batches(pa.schema([("id", pa.string())]), [pa.record_batch({"id": ["y"]})])
    assert sky.from_table(spark, reader).first()["id"] == "y"


def test_comparator():
    assert not differences({"a": None, "t": "2024-01-01T00:00:00Z"}, {"t": "2024-01-01T02:00:00.000+02:00"})
    assert differences([1], [1, 2]) and differences(1, True) and differences("a", "b") and not differences(1, 1.0)
    with pytest.raises(AssertionError):
        assert_items_equal([scene(1)], [])
