import glob
import json

import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import skylattice as sky
from skylattice.compare import assert_items_equal
from skylattice.sources.sinks import footer_metadata, resolve_path
from tests.samples import point, scene


@pytest.fixture
def table(spark):
    return sky.to_table_layout(sky.from_items(spark, [scene(1), scene(2)]))


@pytest.mark.parametrize("version", ["1.0.0", "1.1.0"])
def test_footers(spark, table, tmp_path, version):
    path = str(tmp_path / "items")
    sky.write_item_parquet(table, path, schema_version=version, collections={"scenes": {"id": "scenes"}}, item_key="own")
    for file in glob.glob(f"{path}/*.parquet"):
        footer = pq.read_metadata(file).metadata
        geo = json.loads(footer[b"geo"])
        assert geo["version"] == version and geo["primary_column"] == "geometry"
        assert ("covering" in geo["columns"]["geometry"]) == (version == "1.1.0")
        assert geo["columns"]["geometry"]["crs"]["id"] == {"authority": "EPSG", "code": 4326}
        assert json.loads(footer[b"own"]) == {"version": "1.0.0", "collections": {"scenes": {"id": "scenes"}}}
        assert pq.read_schema(file).field("geometry").metadata[b"ARROW:extension:name"] == b"geoarrow.wkb"
    assert_items_equal(sorted(sky.to_items(sky.read_item_parquet(spark, path)), key=lambda x: x["id"]), [scene(1), scene(2)])


def test_footer_options():
    assert json.loads(footer_metadata(["proj:geometry"])[b"geo"])["columns"]["proj:geometry"]["crs"] is None
    with pytest.warns(FutureWarning):
        assert "collection" in json.loads(footer_metadata([], collection={"id": "a"})[b"item-metadata"])
    with pytest.raises(ValueError):
        footer_metadata([], schema_version="2.0.0")


def test_modes_and_empty_tables(spark, table, tmp_path):
    path = str(tmp_path / "items")
    sky.write_item_parquet(table, path)
    sky.write_item_parquet(table, path)
    assert spark.read.parquet(path).count() == 2
    sky.write_item_parquet(table, path, mode="append")
    assert spark.read.parquet(path).count() == 4
    sky.write_item_parquet(table.where("false"), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    assert not glob.glob(f"{path}/_staging*")


def test_single_file(spark, table, tmp_path):
    path = tmp_path / "deep" / "items.parquet"
    sky.write_item_parquet(table, str(path), single_file=True)
    assert path.is_file() and pq.read_table(path).num_rows == 2


def test_predicates_reach_the_scan(spark, table, tmp_path, capsys):
    sky.write_item_parquet(table, str(tmp_path / "i"))
    sky.search(sky.read_item_parquet(spark, str(tmp_path / "i")), "scenes", bbox=(0, 0, 20, 50)).explain()
    plan = capsys.readouterr().out
    assert "bbox.xmin" in plan.split("PushedFilters")[1]


def test_lines(spark, table, tmp_path):
    path = str(tmp_path / "lines")
    sky.write_item_lines(table.drop("type"), path)
    sky.write_item_lines(table, path)
    assert sky.read_items(spark, path).count() == 4
    one = tmp_path / "one.json"
    sky.write_item_lines(table.drop("type"), str(one), single_file=True)
    assert [json.loads(x)["type"] for x in one.read_text().splitlines()] == ["Feature"] * 2


def test_delta_is_optional(table):
    with pytest.raises(ImportError, match="delta"):
        sky.write_delta(table, "/nowhere")


def test_paths(tmp_path):
    fs = pafs.LocalFileSystem()
    assert resolve_path("a/b.parquet", fs) == (fs, "a/b.parquet")
    assert resolve_path("s3://bucket/b.parquet", fs) == (fs, "bucket/b.parquet")
    assert resolve_path(tmp_path)[1] == str(tmp_path)
    assert resolve_path(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x"


def test_sync(spark, tmp_path):
    import datetime as dt

    from skylattice.operators.catalog import with_partition_files

    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.timezone.utc)
    parts = spark.createDataFrame(
        [("points", None, None, None, None, day(5)), ("other", day(1), day(8), day(1), day(2), day(1))],
        "collection string, lower timestamp, upper timestamp, first timestamp, last timestamp, last_updated timestamp",
    )
    files = with_partition_files(parts)
    assert [r["file"] for r in files.collect()] == ["items_20240101_20240108.parquet", "items.parquet"]
    items = sky.to_table_layout(sky.from_items(spark, [point(1), point(2, collection="other")]))
    path = str(tmp_path / "out")
    assert len(sky.sync_partitions(items, files, path)) == 2
    changed = with_partition_files(parts, day(3))
    more = sky.to_table_layout(sky.from_items(spark, [point(1), point(3)]))
    assert sky.sync_partitions(more, changed, path) == [f"{path}/points/items.parquet"]
    read = lambda: spark.read.option("recursiveFileLookup", "true").parquet(path)
    assert sorted(r["id"] for r in read().collect()) == ["point-1", "point-2", "point-3"]
    for file in glob.glob(f"{path}/*/*.parquet"):
        assert json.loads(pq.read_metadata(file).metadata[b"geo"])["primary_column"] == "geometry"
    assert sorted(glob.glob(f"{path}/*/*")) == [f"{path}/other/items_20240101_20240108.parquet", f"{path}/points/items.parquet"]
    assert sky.sync_partitions(more, files.where("false"), path) == []
    gone = more.where(F.lit(False))
    assert sky.sync_partitions(gone, changed, path) == []
    assert [r["id"] for r in read().collect()] == ["point-2"]


def test_stream(spark, tmp_path):
    from skylattice.streaming import sync_available

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = lambda *r: spark.createDataFrame(r, "id string, collection string, v int").write.mode("append").parquet(source)
    rows(("a", "x", 1), ("b", "y", 1))
    schema = spark.read.parquet(source).schema
    assert sync_available(spark, source, target, state, schema) == 2
    rows(("a", "x", 2), ("c", "x", 1))
    sync_available(spark, source, target, state, schema)
    assert sync_available(spark, source, target, state, schema) == 0
    assert {(r["id"], r["v"]) for r in spark.read.parquet(target).collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_writer_options(spark, tmp_path):
    path = str(tmp_path / "i")
    items = sky.to_table_layout(sky.from_items(spark, [point(i) for i in range(30)])).coalesce(1)
    sky.write_item_parquet(items, path, row_group_rows=10, write_statistics=False, compression="snappy")
    (file,) = glob.glob(f"{path}/*.parquet")
    group = pq.read_metadata(file).row_group(0)
    assert group.column(0).compression == "SNAPPY" and not group.column(0).is_stats_set


def test_one_call_converters(spark, tmp_path):
    path, lines = str(tmp_path / "i"), str(tmp_path / "l")
    sky.items_to_parquet(spark, [scene(1), scene(2)], path, write={"item_key": "own"})
    sky.parquet_to_lines(spark, path, lines)
    again = str(tmp_path / "again")
    sky.items_to_parquet(spark, lines, again)
    assert_items_equal(sorted(sky.to_items(sky.read_item_parquet(spark, again)), key=lambda x: x["id"]), [scene(1), scene(2)])
