import base64
import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from skylattice.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:skylattice:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, "u", "x"), (2, "u", "x"), (3, None, None), (4, "a b\r\n", FAKE + FAKE), (5, "u", "é😀"), (6, "u", ""), (None, "u", "x"),
    (7, "u", "pre" + FAKE[:-4]), (8, "u", FAKE * 50), (9, "v", "y" * 70000), (9, "v", "y" * 70000),
]


def _pages(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return frame.withColumns({c: F.lit("?") for c in ("payload", "n", "digest", "head", "value", "file")})


def _expected(rows, least=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, k in rows if (k or "") == (h or "") and j is not None]
        head = max(same, default=i)
        revisit = len([1 for _, _, k in rows if (k or "") == (h or "")]) > 1 and i != head and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("file_bytes,range_bytes", [(warc.FILE_BYTES, 1 << 27), (300, 1 << 20), (1 << 20, 4000)])
def test_round_trip(spark, file_bytes, range_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    try:
        got = warc.round_trip(_pages(spark, ROWS).coalesce(2), 0, file_bytes).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(repr(tuple(r)) for r in got) == _expected(ROWS)


def test_chains_against_following_each():
    import random

    r = random.Random(2)
    for _ in range(30):
        offsets = sorted(r.sample(range(100), 25))
        to = [r.choice([x for x in [*offsets, 100, 101, 150] if x > at]) for at in offsets]
        got, after = warc.chains(offsets, to), dict(zip(offsets, to))
        for start, (leave, first, _) in zip(offsets, got):
            walk, at = set(), start
            while at in after:
                walk.add(at)
                at = after[at]
            assert at == leave and walk == {x for x, (_, a, b) in zip(offsets, got) if a <= first <= b}


def test_small_payloads_are_never_revisits(spark):
    got = warc.round_trip(_pages(spark, ROWS), min_bytes=10).collect()
    assert sorted(repr(tuple(r)) for r in got) == _expected(ROWS, 10)


def test_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    assert sorted(repr(tuple(r)) for r in warc.round_trip(_pages(spark, ROWS)).collect()) == _expected(ROWS)


def test_no_pages(spark):
    assert warc.round_trip(_pages(spark, [])).collect() == []


def test_damage(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(_pages(spark, ROWS[:5]).coalesce(1), path)
    file = glob.glob(f"{path}/part-*")[0]
    data = open(file, "rb").read()
    open(file, "wb").write(data[:-30])
    for crc in glob.glob(f"{path}/.*.crc"):
        import os

        os.remove(crc)
    with pytest.raises(ValueError, match="reach its end"):
        warc.read_archives(spark, path)
    assert warc.read_archives(spark, path, strict=False).count() == 4


def test_candidates_inside_payloads(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(_pages(spark, ROWS), path)
    found = warc.candidates(spark, path).where("jump is not null").collect()
    assert len(found) > 50 + len(ROWS)
    for r in found:
        data = open(r["file"].removeprefix("file:"), "rb").read()
        assert data[r["at"] :].startswith(b"WARC/1.1") and data[r["at"] + r["jump"] - 4 : r["at"] + r["jump"]] == b"\r\n\r\n"
    assert warc.read_archives(spark, path).count() == len(ROWS)
