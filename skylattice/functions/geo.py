"""GeoJSON and WKB.

Written: little-endian ISO WKB, Z as type code + 1000. Read: both byte orders, ISO and extended codes with or without a
reference system number; measures (M) are refused. Null stays null.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type codes of simple features.
CODES = {
    "Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7,
}
NAMES = {v: k for k, v in CODES.items()}
PARTS = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


def _first_position(coordinates) -> list | None:
    if coordinates and not isinstance(coordinates[0], (list, tuple)):
        return coordinates
    for part in coordinates or ():
        if (found := _first_position(part)) is not None:
            return found
    return None


def _has_z(geometry: dict) -> bool:
    if geometry["type"] == "GeometryCollection":
        return any(map(_has_z, geometry.get("geometries") or ()))
    position = _first_position(geometry.get("coordinates") or ())
    return position is not None and len(position) > 2


def encode(geometry: dict | None) -> bytes | None:
    """WKB of a GeoJSON geometry. Parts of a MultiPolygon without a non-empty ring are left out; an empty Point has NaN coordinates."""
    if geometry is None:
        return None
    out: list[bytes] = []
    _encode(geometry, _has_z(geometry), out)
    return b"".join(out)


def _encode(geometry: dict, z: bool, out: list[bytes]) -> None:
    kind = geometry.get("type")
    if kind not in CODES:
        raise ValueError(f"not a GeoJSON geometry: {kind!r}")
    out.append(struct.pack("<BI", 1, CODES[kind] + 1000 * z))
    if kind == "GeometryCollection":
        members = geometry.get("geometries") or []
        out.append(struct.pack("<I", len(members)))
        for member in members:
            _encode(member, z, out)
        return
    width, coordinates = 2 + z, geometry.get("coordinates") or []

    def positions(line) -> None:
        if set(map(len, line)) <= {width}:
            flat = [*chain.from_iterable(line)]
        else:  # positions of several lengths
            flat = [v for p in line for v in (*p[:width], *[0.0] * (width - len(p)))]
        out.append(struct.pack(f"<I{len(flat)}d", len(line), *flat))

    if kind == "Point":
        values = [*map(float, coordinates[:width])] or [math.nan] * width
        out.append(struct.pack(f"<{width}d", *values, *[0.0] * (width - len(values))))
    elif kind == "LineString":
        positions(coordinates)
    elif kind == "Polygon":
        out.append(struct.pack("<I", len(coordinates)))
        for ring in coordinates:
            positions(ring)
    else:
        parts = [c for c in coordinates if any(c)] if kind == "MultiPolygon" else coordinates
        out.append(struct.pack("<I", len(parts)))
        for part in parts:
            _encode({"type": PARTS[kind], "coordinates": part}, z, out)


class _Reader:
    """Reads a geometry. With ``boxes``, only the boxes of its runs of positions are kept, and no coordinates."""

    def __init__(self, data: bytes, boxes: list | None = None):
        self.data, self.at, self.order, self.boxes = data, 0, "<", boxes

    def take(self, form: str) -> tuple:
        form = self.order + form
        values = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return values

    def geometry(self) -> tuple[str, object]:
        """(type, coordinates or members)."""
        self.order = "<" if self.data[self.at] == 1 else ">"
        self.at += 1
        (code,) = self.take("I")
        if code & 0x20000000:
            self.take("I")
        z, m = bool(code & 0x80000000), bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        z, m, code = z or code // 1000 in (1, 3), m or code // 1000 in (2, 3), code % 1000
        if m:
            raise ValueError("geometries with measures aren't supported")
        if code not in NAMES:
            raise ValueError(f"not a WKB geometry type: {code}")
        kind, width = NAMES[code], 2 + z

        def positions() -> list:
            (n,) = self.take("I")
            flat = self.take(f"{n * width}d")
            if self.boxes is not None:
                xs, ys = flat[::width], flat[1::width]
                if n:
                    self.boxes.append((min(xs), min(ys), max(xs), max(ys)))
                return []
            return [list(flat[i : i + width]) for i in range(0, len(flat), width)]

        if kind == "Point":
            values = list(self.take(f"{width}d"))
            if self.boxes is not None and not math.isnan(values[0]):
                self.boxes.append((values[0], values[1], values[0], values[1]))
            return kind, [] if all(map(math.isnan, values)) else values
        if kind == "LineString":
            return kind, positions()
        (n,) = self.take("I")
        if kind == "Polygon":
            return kind, [positions() for _ in range(n)]
        members = [self.geometry() for _ in range(n)]
        return kind, members if kind == "GeometryCollection" else [c for _, c in members]


def _as_geojson(kind: str, content) -> dict:
    if kind == "GeometryCollection":
        return {"type": kind, "geometries": [_as_geojson(*member) for member in content]}
    return {"type": kind, "coordinates": content}


def decode(data: bytes | None) -> dict | None:
    """GeoJSON geometry of WKB or extended WKB."""
    return None if data is None else _as_geojson(*_Reader(bytes(data)).geometry())


def bounds(data: bytes | None) -> tuple[float, float, float, float] | None:
    """(xmin, ymin, xmax, ymax); None for null and empty geometries."""
    if data is None:
        return None
    boxes: list[tuple[float, float, float, float]] = []
    _Reader(bytes(data), boxes).geometry()
    if not boxes:
        return None
    west, south, east, north = zip(*boxes)
    return min(west), min(south), max(east), max(north)


_dumps = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode

_FLOAT = r"\s*(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*"
#: A point of two numbers, its keys in the usual order.
_POINT_TEXT = re.compile(rf'\s*\{{\s*"type"\s*:\s*"Point"\s*,\s*"coordinates"\s*:\s*\[{_FLOAT},{_FLOAT}\]\s*\}}\s*')
_POINT_HEAD = struct.pack("<BI", 1, 1)


def _matrix(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where its values start and end."""
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    values = data.buffers()[2]
    return np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8), offsets[:-1], offsets[1:]


def _simple(data: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Rows whose WKB is a little-endian point or a polygon of one ring in two dimensions, by length: kind, row numbers,
    coordinates (rows x positions x 2). They are read for all rows of a length at once.
    """
    if not len(data):
        return
    raw, start, end = _matrix(data)
    length = np.where(data.is_valid().to_numpy(zero_copy_only=False), end - start, 0)
    for n in np.unique(length).tolist():
        rings = n > 21 and (n - 13) % 16 == 0
        if n != 21 and not rings:
            continue
        rows = np.flatnonzero(length == n)
        block = raw[start[rows][:, None] + np.arange(n)]
        head = np.frombuffer(_POINT_HEAD if n == 21 else struct.pack("<BIII", 1, 3, 1, (n - 13) // 16), np.uint8)
        fits = (block[:, : len(head)] == head).all(1)
        rows, block = rows[fits], block[fits]
        if len(rows):
            yield "Point" if n == 21 else "Polygon", rows, np.ascontiguousarray(block[:, len(head) :]).view("<f8").reshape(len(rows), -1, 2)


@F.arrow_udf(T.BinaryType())
def wkb_from_geojson(texts: pa.Array) -> pa.Array:
    """Column of GeoJSON texts to WKB; the text ``null`` is null. Plain points are packed for the whole batch at once."""
    given = texts.to_pylist()
    points = [None if t is None else _POINT_TEXT.fullmatch(t) for t in given]
    at = [i for i, m in enumerate(points) if m]
    packed = np.zeros((len(at), 21), np.uint8)
    packed[:, :5] = np.frombuffer(_POINT_HEAD, np.uint8)
    packed[:, 5:] = np.array([(float(points[i][1]), float(points[i][2])) for i in at], "<f8").reshape(-1, 2).view(np.uint8)
    made, out = packed.tobytes(), [None] * len(given)
    for k, i in enumerate(at):
        out[i] = made[21 * k : 21 * k + 21]
    for i, (t, m) in enumerate(zip(given, points)):
        if t is not None and not m:
            out[i] = encode(json.loads(t))
    return pa.array(out, pa.binary())


@F.arrow_udf(T.StringType())
def geojson_from_wkb(data: pa.Array) -> pa.Array:
    """Column of WKB to GeoJSON texts."""
    out: list[str | None] = [None] * len(data)
    rest = data.is_valid().to_numpy(zero_copy_only=False).copy()
    for kind, rows, xy in _simple(data):
        plain = np.isfinite(xy).all((1, 2))
        rows, xy = rows[plain], xy[plain]
        rest[rows] = False
        if kind == "Point":
            for i, (x, y) in zip(rows.tolist(), xy[:, 0].tolist()):
                out[i] = f'{{"type":"Point","coordinates":[{x!r},{y!r}]}}'
        else:
            for i, ring in zip(rows.tolist(), xy.tolist()):
                out[i] = f'{{"type":"Polygon","coordinates":[[{",".join(f"[{x!r},{y!r}]" for x, y in ring)}]]}}'
    for i in np.flatnonzero(rest).tolist():
        out[i] = _dumps(decode(data[i].as_py()))
    return pa.array(out, pa.string())


_BOUNDS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])


@F.arrow_udf(_BOUNDS)
def bounds_of_wkb(data: pa.Array) -> pa.Array:
    """Column of WKB to a struct of bounds; null for null and empty geometries."""
    out, known = np.zeros((len(data), 4)), np.zeros(len(data), bool)
    rest = data.is_valid().to_numpy(zero_copy_only=False).copy()
    for _, rows, xy in _simple(data):
        plain = np.isfinite(xy).all((1, 2))
        rows, xy = rows[plain], xy[plain]
        out[rows], known[rows], rest[rows] = np.concatenate([xy.min(1), xy.max(1)], axis=1), True, False
    for i in np.flatnonzero(rest).tolist():
        if (box := bounds(data[i].as_py())) is not None:
            out[i], known[i] = box, True
    return pa.StructArray.from_arrays([pa.array(c) for c in out.T], _BOUNDS.names, mask=pa.array(~known))
