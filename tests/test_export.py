import datetime as dt
import json

import skylattice as sky
from skylattice.compare import assert_items_equal
from skylattice.functions.geo import encode
from tests.samples import SCENE, scene


def _source(spark):
    day = lambda n: dt.datetime(2024, 6, n, tzinfo=dt.timezone.utc)
    rows = []
    for n in (1, 2, 3):
        item = scene(n)
        content = {"properties": item["properties"], "links": item["links"], "assets": {"image": {"href": "h"}}, "stac_extensions": item["stac_extensions"]}
        rows.append((item["id"], encode(item["geometry"]).hex(), "scenes", day(n), day(n), json.dumps(content)))
    return spark.createDataFrame(rows, "id string, geometry string, collection string, datetime timestamp, end_datetime timestamp, content string"), day


def test_catalog_to_files(spark, tmp_path):
    source, day = _source(spark)
    bases = spark.createDataFrame([("scenes", json.dumps({"stac_version": "1.0.0", "assets": {"image": {"type": "image/tiff"}}}))], "collection string, base string")
    change = lambda item: item | {"assets": item["assets"] | {"extra": {"href": item["id"]}}}
    path = sky.catalog_to_parquet(spark, lambda s: source, str(tmp_path / "x"), collection="scenes", start=day(2), end=day(4), bases=bases, change=change)
    got = sorted(sky.to_items(sky.read_item_parquet(spark, path)), key=lambda x: x["id"])
    assert [x["id"] for x in got] == ["scene-2", "scene-3"]
    expected = scene(2)
    expected["assets"] = {"image": {"href": "h", "type": "image/tiff"}, "extra": {"href": "scene-2"}}
    assert_items_equal(got[0], expected)


def test_everything_without_conditions(spark):
    source, _ = _source(spark)
    assert sky.catalog_to_table(spark, source).count() == 3


def test_one_row(spark):
    table = sky.to_table_layout(sky.from_items(spark, [SCENE]))
    assert_items_equal(sky.row_to_item(spark, table.first(), table.schema), SCENE)
