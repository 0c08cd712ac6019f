"""A capture's depth images as a Python data source with its own partitions and filter pushdown, and the tags of photos."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .captures import decode_png

FORM = "frame int, u int, v int, z double, confidence int"
_ARROW = pa.schema([("frame", pa.int32()), ("u", pa.int32()), ("v", pa.int32()), ("z", pa.float64()), ("confidence", pa.int32())])


@dataclass
class Frames(InputPartition):
    """Frames that one task reads."""

    numbers: list[int]


class DepthReader(DataSourceReader):
    """Reads depth/NNNNNN.png (millimetres) and confidence/NNNNNN.png under a folder, of whatever store its URI names.

    Filters on `frame` decide which files are opened at all, those on `z` and `confidence` are made on
    the decoded arrays, so pixels that they refuse never become rows. Other filters stay with Spark.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.each = options["path"], int(options.get("frames_per_task", "64"))
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}
        self.open_low: set[str] = set()
        self.open_high: set[str] = set()
        self.only: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            name = column[0] if len(column) == 1 and column[0] in ("frame", "z", "confidence") else None
            value = getattr(f, "value", None)
            if isinstance(f, In) and name == "frame":
                self._keep({int(v) for v in value if v is not None})
            elif isinstance(f, EqualTo) and name == "frame" and value is not None:
                self._keep({int(value)})
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name and value is not None:
                self._raise(name, float(value), isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name and value is not None:
                self._lower(name, float(value), isinstance(f, LessThan))
            else:
                yield f

    def _keep(self, numbers: set[int]) -> None:
        self.only = numbers if self.only is None else self.only & numbers

    def _raise(self, name: str, value: float, strict: bool) -> None:
        if value > self.low.get(name, -np.inf) or strict and value == self.low[name]:
            self.low[name] = value
            (self.open_low.add if strict else self.open_low.discard)(name)

    def _lower(self, name: str, value: float, strict: bool) -> None:
        if value < self.high.get(name, np.inf) or strict and value == self.high[name]:
            self.high[name] = value
            (self.open_high.add if strict else self.open_high.discard)(name)

    def _passes(self, name: str, x):
        """Whether values (a number or an array) lie within what was pushed for `name`."""
        low, high = self.low.get(name, -np.inf), self.high.get(name, np.inf)
        return (x > low if name in self.open_low else x >= low) & (x < high if name in self.open_high else x <= high)

    def partitions(self) -> list[InputPartition]:
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)
        names = (re.fullmatch(r"(\d+)\.png", f.base_name) for f in store.get_file_info(pyarrow.fs.FileSelector(f"{root}/depth")))
        found = sorted(int(m[1]) for m in names if m)
        found = [n for n in found if (self.only is None or n in self.only) and self._passes("frame", n)]
        return [Frames(found[i : i + self.each]) for i in range(0, len(found), self.each)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(self.path)

        def image(kind: str, number: int) -> np.ndarray | None:
            file = f"{root}/{kind}/{number:06d}.png"
            if store.get_file_info(file).type == pyarrow.fs.FileType.NotFound:
                return None
            with store.open_input_stream(file) as f:
                return decode_png(f.read())

        for number in partition.numbers:
            depth, sure = image("depth", number), image("confidence", number)
            if depth is None:  # named without leading zeros
                continue
            z = depth / 1000.0
            good = self._passes("z", z)
            if sure is not None:
                good &= self._passes("confidence", sure.astype(float))
            elif {"confidence"} & (set(self.low) | set(self.high)):
                good &= False
            v, u = np.nonzero(good)
            columns = [np.full(len(u), number, np.int32), u.astype(np.int32), v.astype(np.int32), z[v, u]]
            told = pa.nulls(len(u), pa.int32()) if sure is None else pa.array(sure[v, u].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), told], schema=_ARROW)


class DepthSource(DataSource):
    """`spark.read.format("capture_depth").load(uri)`: (frame, u, v, z in metres, confidence) of a capture's depth images; option frames_per_task."""

    @classmethod
    def name(cls) -> str:
        return "capture_depth"

    def schema(self) -> str:
        return FORM

    def reader(self, schema) -> DataSourceReader:
        return DepthReader(self.options)


def read_depth(spark: SparkSession, uri: str, frames_per_task: int = 64) -> DataFrame:
    """The pixels of a capture's depth images; filters on frame, z and confidence reach the reader.

    A query without a filter would read with what an earlier query on the same DataFrame has pushed
    (Spark keeps the planned reader), so every query gets one that refuses no row.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DepthSource)
    return spark.read.format("capture_depth").option("frames_per_task", str(frames_per_task)).load(uri).where(F.col("frame").isNotNull())


#: The tags of photos that are read, as in the published format.
TAGS = {0x0112: "orientation", 0x920A: "focal_mm", 0xA405: "focal_35mm", 0xA002: "width", 0xA003: "height"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_FOLDER = 0x8769


def photo_tags(data: bytes) -> dict[str, float]:
    """The TAGS in a JPEG's EXIF block; empty where there is none or it is broken."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return {}
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            try:
                return _folder_tags(data[at + 10 : at + 2 + size])
            except (struct.error, ZeroDivisionError):
                return {}
        at += 2 + size
    return {}


def _folder_tags(block: bytes) -> dict[str, float]:
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None:
        return {}
    found: dict[str, float] = {}
    folders, seen = [struct.unpack(f"{order}I", block[4:8])[0]], set()
    while folders:
        start = folders.pop()
        if start in seen:
            continue
        seen.add(start)
        (n,) = struct.unpack(f"{order}H", block[start : start + 2])
        for k in range(n):
            entry = block[start + 2 + 12 * k : start + 14 + 12 * k]
            tag, kind, count = struct.unpack(f"{order}HHI", entry[:8])
            wide = _SIZES.get(kind, 1) * count > 4
            place = struct.unpack(f"{order}I", entry[8:12])[0]
            if tag == _FOLDER:
                folders.append(place)
            elif tag in TAGS and count:
                value = block[place : place + 8] if wide else entry[8:12]
                if kind in (5, 10):
                    a, b = struct.unpack(f"{order}{'II' if kind == 5 else 'ii'}", value)
                    if b:
                        found[TAGS[tag]] = a / b
                elif kind in (3, 4, 9):
                    found[TAGS[tag]] = float(struct.unpack(f"{order}{ {3: 'H', 4: 'I', 9: 'i'}[kind] }", value[: _SIZES[kind]])[0])
    return found


def tagged_photos(photos: DataFrame, data: str = "content") -> DataFrame:
    """Adds the columns of TAGS (double, null where missing) from the bytes of JPEG files; the bytes themselves go."""
    names = list(TAGS.values())
    others = [c for c in photos.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [photo_tags(x.as_py() or b"") for x in batch.column(data)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array([t.get(n) for t in told], pa.float64()) for n in names)], names=[*others, *names])

    types = dict(photos.dtypes)
    return photos.select(*others, data).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in others), *(f"{n} double" for n in names)]))
