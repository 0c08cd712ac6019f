"""Zipped manifests and folders of photos."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.sources import captures


def test_manifests_in_archives(spark, tmp_path):
    pose = [[1.0, 0, 0, 1], [0, 1.0, 0, 2], [0, 0, 1.0, 3], [0, 0, 0, 1.0]]
    text = json.dumps({"w": 8, "h": 6, "fl_x": 5.0, "cx": 4.0, "cy": 3.0, "frames": [{"file_path": "images/0001", "transform_matrix": pose, "timestamp": 0.5}, {"file_path": "images/0002.jpg", "transform_matrix": pose, "fl_x": 6.0, "fl_y": 7.0}]})
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("capture/transforms.json", text)
        z.writestr("capture/images/0001.png", b"x")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("other.txt", "nothing here")
    got = captures.read_zipped_manifests(spark, f"file://{tmp_path}").orderBy("frame").collect()
    assert [(r.file, r.fx, r.fy) for r in got] == [("images/0001.png", 5.0, 5.0), ("images/0002.jpg", 6.0, 7.0)] and got[0].pose[5] == -1.0
    assert captures.detect_tier(captures.files(spark, f"file://{tmp_path}/a.zip")).first()[0] == "video"


def test_rooms_without_images_are_an_error(spark):
    photos = spark.createDataFrame([("hall", "1.jpg", 10), ("hall", "2.jpg", 0), ("bath", "1.jpg", 3)], "room string, file string, length long")
    assert {r.room: (r.n, r.bad) for r in captures.checked_rooms(photos, F.col("length") > 0).collect()} == {"hall": (1, 1), "bath": (1, 0)}
    for bad in (photos.where("room = 'none'"), photos.where("length = 0")):
        with pytest.raises(ValueError):
            captures.checked_rooms(bad, F.col("length") > 0)
