"""Capture sources: odometry, posed-image manifests, depth images, photo folders; and what decides between them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measure import quaternion_matrix
from ..functions.text import extension, is_image

ODOMETRY = "ts DOUBLE, frame INT, x DOUBLE, y DOUBLE, z DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE, fx DOUBLE, fy DOUBLE, cx DOUBLE, cy DOUBLE"
VIDEO = ["mov", "mp4", "m4v"]
#: Error terms of each tier.
TIER_ERRORS = [
    ("lidar", 0.008, 0.004, 0.004, 0.002, 0.0004, 0.02), ("video", 0.03, 0.02, 0.01, 0.55, 0.002, 0.05), ("photo", 0.05, 0.03, 0.02, 0.55, 0.0, 0.10), ("video_motion", 0.03, 0.03, 0.02, 0.18, 0.0005, 0.05)]


def tier_errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIER_ERRORS, "tier string, sig_abs double, sig_rel double, plane_bias double, scale_rel double, drift_per_m double, cov_penalty double")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length) of all files under a folder; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def detect_tier(listed: DataFrame) -> DataFrame:
    """(tier): one row for a capture's files. In order: video, a zip archive (of a manifest: video), odometry with depth (lidar), a manifest (video), images (photo), else `unknown`."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = listed.agg(
        any_(extension(F.col("name")).isin(VIDEO)).alias("video"), any_(extension(F.col("name")) == "zip").alias("zip"), any_(F.col("name") == "odometry.csv").alias("odometry"), any_(F.col("path").contains("/depth/")).alias("depth"),
        any_(F.col("name") == "transforms.json").alias("manifest"), any_(is_image(F.col("name"))).alias("images"), F.count(F.lit(1)).alias("n"))
    return found.select(F.when((F.col("n") == 1) & (F.col("video") | F.col("zip")), "video").when(F.col("odometry") & F.col("depth"), "lidar").when(F.col("manifest"), "video").when(F.col("images"), "photo").otherwise("unknown").alias("tier"))


def read_odometry(spark: SparkSession, path: str, fallback: tuple[float, float, float, float], depth_scale: float = 256 / 1920) -> DataFrame:
    """Frames of an odometry CSV (first 13 columns, header skipped) with pose and depth intrinsics. A row with any intrinsic that is not finite takes all four from `fallback`."""
    rows = spark.read.schema(ODOMETRY).option("header", "true").option("enforceSchema", "true").csv(path)
    names = ["fx", "fy", "cx", "cy"]
    good = F.lit(True)
    for n in names:
        good = good & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    k = {n: F.when(good, F.col(n)).otherwise(F.lit(float(v))) for n, v in zip(names, fallback, strict=True)}
    pose = quaternion_matrix(*[F.col(c) for c in ("qx", "qy", "qz", "qw", "x", "y", "z")])
    return rows.select("frame", "ts", pose.alias("pose"), *[v.alias(n) for n, v in k.items()], *[(v * depth_scale).alias(f"d{n}") for n, v in k.items()])


MANIFEST = "w INT, h INT, fl_x DOUBLE, fl_y DOUBLE, cx DOUBLE, cy DOUBLE, frames ARRAY<STRUCT<file_path: STRING, transform_matrix: ARRAY<ARRAY<DOUBLE>>, timestamp: DOUBLE, fl_x: DOUBLE, fl_y: DOUBLE, cx: DOUBLE, cy: DOUBLE>>"


def _manifest_frames(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    rows = rows.select("*", F.posexplode("frames").alias("frame", "f"))
    fx = F.coalesce("f.fl_x", "fl_x")
    flip = lambda row: F.array(row[0], -row[1], -row[2], row[3])
    name = F.when(extension(F.col("f.file_path")) == "", F.concat("f.file_path", F.lit(".png"))).otherwise(F.col("f.file_path"))
    return rows.select(*keys, "frame", "f.timestamp", name.alias("file"), F.flatten(F.transform("f.transform_matrix", flip)).alias("pose"),
                       fx.alias("fx"), F.coalesce("f.fl_y", "fl_y", fx).alias("fy"), F.coalesce("f.cx", "cx").alias("cx"), F.coalesce("f.cy", "cy").alias("cy"), "w", "h")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a posed-image manifest: per-frame intrinsics over global ones, fy from the frame, the manifest or fx; poses with y and z turned; names without a suffix get .png."""
    return _manifest_frames(spark.read.schema(MANIFEST).option("multiLine", "true").json(path))


def zipped(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, member, text): of each zip archive under `path` the first member, in order, called `name`, at any depth. Archives are opened in the tasks that read them."""
    import io
    import zipfile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for where, content in rows[["path", "content"]].itertuples(index=False, name=None):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = sorted(m for m in archive.namelist() if m.rsplit("/", 1)[-1] == name)
                    if members:
                        found.append((where, members[0], archive.read(members[0]).decode("utf-8")))
            yield pd.DataFrame(found, columns=["path", "member", "text"])

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return archives.select("path", "content").mapInPandas(run, "path string, member string, text string")


def read_zipped_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Frames of the manifests in zip archives, with the archive's path."""
    parsed = zipped(spark, path, "transforms.json").select("path", F.from_json("text", MANIFEST).alias("m")).select("path", "m.*")
    return _manifest_frames(parsed, ("path",))


def photo_rooms(listed: DataFrame, root: str) -> DataFrame:
    """(room, file, path) of a folder of rooms: one sub-folder is one room, images in order of their names."""
    rest = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return listed.where(is_image(F.col("name"))).select(F.when(F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1)).otherwise(F.lit("room")).alias("room"), F.col("name").alias("file"), "path")


def checked_rooms(photos: DataFrame, readable: Column) -> DataFrame:
    """(room, n, bad): images of each room that can be read, and those that cannot. No room, or a room without a readable image, is an error; single bad files are only counted."""
    found = photos.groupBy("room").agg(F.count_if(readable).alias("n"), F.count_if(~readable).alias("bad"))
    total, empty = found.agg(F.count(F.lit(1)), F.min(F.when(F.col("n") == 0, F.col("room")))).first()
    if not total:
        raise ValueError("no folder of photos here")
    if empty is not None:
        raise ValueError(f"no readable image in room {empty}")
    return found


def focal_pixels(w: Column, h: Column, mm35: Column, mm: Column, fov_deg: float = 70.0) -> Column:
    """Focal length in pixels: from the 35 mm tag, else from the lens in mm, else from a field of view."""
    side = F.greatest(w, h).cast("double")
    return F.coalesce(mm35 / 36.0 * side, mm / 7.0 * side, side / 2 / F.tan(F.radians(F.lit(fov_deg / 2))))


def decode_png(data: bytes) -> np.ndarray:
    """A grey PNG of 8 or 16 bits, not interlaced, as an array."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    width, height, depth, color, *_, interlaced = head
    if color or interlaced or depth not in (8, 16):
        raise ValueError("only grey, 8 or 16 bits, not interlaced")
    step = depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0).reshape(-1)
        elif kind in (3, 4):
            for x in range(len(line)):
                left, up, corner = (line[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
                if kind == 3:
                    line[x] = (line[x] + (left + up) // 2) & 255
                else:
                    p = left + up - corner
                    line[x] = (line[x] + min((left, up, corner), key=lambda v: abs(p - v))) & 255
        above = line & 255
        out[y] = above
    return out if step == 1 else out.view(">u2").astype(np.uint16)


def depth_pixels(images: DataFrame, least: float = 0.15, most: float = 5.0, confidence: int = 2) -> DataFrame:
    """(frame, u, v, z) of (frame, depth, conf) PNG bytes: metres between the bounds, of at least the given confidence. The test is made in the decoder, so other pixels never become rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for frame, depth, conf in rows[["frame", "depth", "conf"]].itertuples(index=False, name=None):
                z = decode_png(depth) / 1000.0
                good = (z > least) & (z < most)
                if conf is not None:
                    good &= decode_png(conf) >= confidence
                v, u = np.nonzero(good)
                yield pd.DataFrame({"frame": frame, "u": u.astype("int32"), "v": v.astype("int32"), "z": z[v, u]})

    return images.select("frame", "depth", "conf").mapInPandas(run, "frame int, u int, v int, z double")


def write_documents(docs: DataFrame, path: str) -> None:
    """One JSON document a line."""
    docs.write.mode("overwrite").json(path)
