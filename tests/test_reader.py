"""Depth images through the data source: what is opened, what becomes rows; and the tags of photos."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from plumbline.sources import reader


def png(a):
    step = a.dtype.itemsize
    raw = b"".join(b"\0" + row.astype(">u2" if step == 2 else np.uint8).tobytes() for row in a)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8 * step, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    folder = tmp_path_factory.mktemp("capture")
    (folder / "depth").mkdir()
    (folder / "confidence").mkdir()
    rng = np.random.default_rng(1)
    truth = {}
    for n in range(20):
        z, c = rng.integers(0, 6000, (6, 8)).astype(np.uint16), rng.integers(0, 3, (6, 8)).astype(np.uint8)
        (folder / f"depth/{n:06d}.png").write_bytes(png(z))
        (folder / f"confidence/{n:06d}.png").write_bytes(png(c))
        truth[n] = (z, c)
    for n in (30, 31):  # opening one of these is an error
        (folder / f"depth/{n:06d}.png").write_bytes(b"broken")
    (folder / "depth/notes.txt").write_text("no image")
    return f"file://{folder}", truth


def test_filters_decide_what_is_opened(spark, capture):
    uri, truth = capture
    pixels = reader.read_depth(spark, uri, frames_per_task=3)
    asked = pixels.where("frame >= 4 and frame < 9 and z > 0.15 and z < 5.0 and confidence >= 2 and u % 2 = 0")
    got = {(r.frame, r.u, r.v, r.z, r.confidence) for r in asked.collect()}
    want = {(n, u, v, z[v, u] / 1000.0, 2) for n, (z, c) in truth.items() if 4 <= n < 9 for v in range(6) for u in range(0, 8, 2) if 150 < z[v, u] < 5000 and c[v, u] == 2}
    assert got == want and asked.rdd.getNumPartitions() == 2
    assert pixels.where(F.col("frame").isin(1, 7, 99)).groupBy("frame").count().count() == 2
    assert pixels.where("frame = 5").count() == 48
    with pytest.raises(Exception, match="not a PNG"):
        reader.read_depth(spark, uri).count()
    assert pixels.where("frame = 6").count() == 48 and pixels.where("frame in (7, 8)").count() == 96
    with pytest.raises(Exception, match="not a PNG"):
        pixels.count()


def test_pushed_and_left_filters(capture):
    uri, _ = capture
    r = reader.DepthReader({"path": uri, "frames_per_task": "4"})
    left = list(r.pushFilters([GreaterThanOrEqual(("frame",), 3), GreaterThan(("frame",), 3), LessThanOrEqual(("frame",), 12), IsNotNull(("frame",)), LessThan(("u",), 4), In(("frame",), (1, 4, 5, 12, 40)), EqualTo(("z",), 1.0)]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "LessThan", "EqualTo"]
    assert [p.numbers for p in r.partitions()] == [[4, 5, 12]]
    assert sum(len(p.numbers) for p in reader.DepthReader({"path": uri}).partitions()) == 22


def jpeg(order, entries, folder=()):
    def block(items, start):
        out, tail, at = struct.pack(f"{order}H", len(items)), b"", start + 2 + 12 * len(items) + 4
        for tag, kind, value in items:
            if kind == 5:
                out += struct.pack(f"{order}HHII", tag, 5, 1, at + len(tail))
                tail += struct.pack(f"{order}II", *value)
            else:
                out += struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}H", value) + b"\0\0" if kind == 3 else struct.pack(f"{order}I", value))
        return out + b"\0\0\0\0" + tail

    first = block([*entries, (0x8769, 4, 0)], 8)
    second = 8 + len(first)
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8) + block([*entries, (0x8769, 4, second)], 8) + block(list(folder), second)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_tags_of_photos(spark):
    photos = [("a", jpeg("<", [(0x0112, 3, 6)], [(0x920A, 5, (425, 100)), (0xA405, 3, 26), (0xA002, 4, 4000)])), ("b", jpeg(">", [(0x0112, 3, 1), (0x920A, 5, (7, 2))])), ("none", b"\xff\xd8\xff\xda"), ("png", b"\x89PNG"), ("cut", jpeg("<", [(0x0112, 3, 6)], [(0xA405, 3, 26)])[:40]), ("null", None)]
    got = {r.file: r.asDict() for r in reader.tagged_photos(spark.createDataFrame(photos, "file string, content binary")).collect()}
    assert {k: got["a"][k] for k in ("orientation", "focal_mm", "focal_35mm", "width", "height")} == {"orientation": 6.0, "focal_mm": 4.25, "focal_35mm": 26.0, "width": 4000.0, "height": None}
    assert (got["b"]["orientation"], got["b"]["focal_mm"]) == (1.0, 3.5)
    assert all(got[k]["orientation"] is None for k in ("none", "png", "cut", "null"))
