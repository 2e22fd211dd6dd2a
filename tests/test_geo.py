import json
import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylattice.functions.geo import bounds, bounds_of_wkb, decode, encode, geojson_from_wkb, wkb_from_geojson

RING = [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 0.0]]
GEOMETRIES = [
    {"type": "Point", "coordinates": [1.5, -2.5]},
    {"type": "Point", "coordinates": [1.5, -2.5, 3.0]},
    {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 1.0]]},
    {"type": "Polygon", "coordinates": [RING, [[0.5, 0.1], [0.6, 0.1], [0.6, 0.2], [0.5, 0.1]]]},
    {"type": "MultiPoint", "coordinates": [[0.0, 1.0], [2.0, 3.0]]},
    {"type": "MultiLineString", "coordinates": [[[0.0, 0.0, 1.0], [1.0, 1.0, 2.0]]]},
    {"type": "MultiPolygon", "coordinates": [[RING], [RING]]},
    {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "Polygon", "coordinates": [RING]}]},
    {"type": "Point", "coordinates": []},
    {"type": "LineString", "coordinates": []},
    {"type": "GeometryCollection", "geometries": []},
]


@pytest.mark.parametrize("geometry", GEOMETRIES, ids=lambda g: g["type"])
def test_round_trip(geometry):
    assert decode(encode(geometry)) == geometry


def test_known_bytes():
    assert encode({"type": "Point", "coordinates": [1, 2]}) == struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    assert encode({"type": "Point", "coordinates": [1, 2, 3]})[:5] == struct.pack("<BI", 1, 1001)
    assert encode(None) is None and decode(None) is None and bounds(None) is None


def test_empty_parts_of_multipolygon_go():
    assert decode(encode({"type": "MultiPolygon", "coordinates": [[], [RING]]}))["coordinates"] == [[RING]]


def test_other_flavours_are_read():
    assert decode(struct.pack(">BIdd", 0, 1, 1.0, 2.0)) == {"type": "Point", "coordinates": [1.0, 2.0]}
    assert decode(struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 1.0, 2.0)) == {"type": "Point", "coordinates": [1.0, 2.0]}
    assert decode(struct.pack("<BIddd", 1, 1 | 0x80000000, 1.0, 2.0, 3.0))["coordinates"] == [1.0, 2.0, 3.0]
    for code in (2001, 3001, 1 | 0x40000000):
        with pytest.raises(ValueError):
            decode(struct.pack("<BI4d", 1, code, 1.0, 2.0, 3.0, 4.0))
    with pytest.raises(ValueError):
        encode({"type": "Circle"})


def test_bounds():
    assert bounds(encode(GEOMETRIES[7])) == (0.0, 0.0, 2.0, 2.0)
    assert bounds(encode({"type": "Point", "coordinates": []})) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-180, 180), st.floats(-90, 90)), min_size=2, max_size=20))
def test_lines_round_trip(points):
    line = {"type": "LineString", "coordinates": [list(p) for p in points]}
    assert decode(encode(line)) == line
    box = bounds(encode(line))
    assert box[0] == min(p[0] for p in points) and math.isclose(box[3], max(p[1] for p in points))


def test_columns(spark):
    rows = spark.createDataFrame([('{"type":"Point","coordinates":[1,2]}',), (None,), ("null",)], "g string")
    out = rows.select(geojson_from_wkb(wkb_from_geojson("g")).alias("g"), bounds_of_wkb(wkb_from_geojson("g")).alias("b")).collect()
    assert out[0]["g"] == '{"type":"Point","coordinates":[1.0,2.0]}' and out[0]["b"]["xmax"] == 1.0
    assert out[1]["g"] is None and out[2]["b"] is None


def test_batches_against_each_geometry(spark):
    """Points and plain polygons are coded by the batch; the result is that of each geometry alone."""
    r = random.Random(4)
    number = lambda: r.choice([0, -0.0, 1, -7.25, 1e300, 5e-324, r.uniform(-180, 180), r.randrange(-90, 90)])
    made = [None, {"type": "Point", "coordinates": []}, {"type": "Point", "coordinates": [1, 2, 3]}, {"type": "MultiPolygon", "coordinates": [[[]], [[[0, 0], [1, 1], [0, 0]]], []]}]
    for _ in range(200):
        ring = [[number(), number()] for _ in range(r.randrange(0, 5))]
        made += [{"type": "Point", "coordinates": [number(), number()]}, {"coordinates": [ring], "type": "Polygon"}, {"type": "Polygon", "coordinates": [ring, ring]}]
    rows = [(i, None if g is None else json.dumps(g)) for i, g in enumerate(made)]
    wkb = wkb_from_geojson(F.col("t"))
    frame = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    got = frame.select("i", wkb.alias("w"), geojson_from_wkb(wkb).alias("back"), bounds_of_wkb(wkb).alias("b")).collect()
    for x in got:
        data = encode(made[x["i"]])
        assert (x["w"] and bytes(x["w"])) == data
        assert (x["back"] and json.loads(x["back"])) == decode(data)
        assert (x["b"] and tuple(x["b"])) == bounds(data)
    assert decode(encode(made[3]))["coordinates"] == [[[[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]
    assert bytes(frame.where("i = 4").select(wkb.alias("w")).first()["w"])[:1] == b"\x01"
