"""Removal of word windows that occur earlier, with a count-min prefilter of merged partition sketches."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, runs, slices, unpacked
from .words import Words, mix

_SENT = "part int, chunk int, data binary"
_SENT_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    part, chunk, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(part, pa.int32()), pa.array(chunk, pa.int32()), pa.array(data, pa.binary())], schema=_SENT_ARROW)


def _packed_cells(cells: np.ndarray) -> bytes:
    """Ascending cell numbers as gaps, of two bytes each where they fit."""
    gaps = np.diff(cells, prepend=0)
    kind = np.uint16 if gaps.max(initial=0) < 1 << 16 else np.uint32
    return bytes([kind().itemsize]) + gaps.astype(kind).tobytes()


def _cells(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint16 if data[0] == 2 else np.uint32, offset=1).astype(np.int64))


class _Chunk:
    """The windows of a chunk's documents, by id and then by place; the same whenever it is made."""

    def __init__(self, packed: pa.ChunkedArray, window: int):
        self.docs = unpacked(packed)
        found, other = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        self.slices: list[tuple[int, Words, np.ndarray]] = []
        for at, texts in slices(self.docs.column("text").combine_chunks()):
            words = Words(texts)
            first, h = words.windows(window)
            self.slices.append((at, words, first))
            found.append(h)
            other.append(words.windows(window, seed=1)[1])
        self.hash, self.other = np.concatenate(found), np.concatenate(other)
        self.distinct, self.first, self.times = np.unique(self.hash, return_index=True, return_counts=True)

    def owners(self) -> np.ndarray:
        """Index of the document of each window."""
        return np.concatenate([np.zeros(0, np.int64), *(at + words.doc[first] for at, words, first in self.slices)])


class Sketch:
    """Geometry of a count-min sketch: `depth` rows of 2**bits cells, in parts of 2**part_bits cells."""

    def __init__(self, windows: float, depth: int, load: float, part_bits: int):
        self.depth = depth
        self.bits = max(10, int(np.ceil(np.log2(max(1.0, windows * load)))))
        self.part_bits = min(part_bits, self.bits)
        self.parts = 1 << self.bits - self.part_bits

    def cells(self, row: int, h: np.ndarray) -> np.ndarray:
        return (mix(h ^ np.uint64(0xA24BAED4963EE407 * (row + 1) % (1 << 64))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pieces(self, cells: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Parts of ascending cells, with cell numbers inside the part."""
        part = cells >> self.part_bits
        return [(int(part[lo]), cells[lo:hi] & (1 << self.part_bits) - 1) for lo, hi in runs(part)]


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
    chunk_mb: float = 4.0, depth: int = 2, load: float = 4.0, part_bits: int = 22,
) -> DataFrame:
    """Removes each word covered by a window of `window` words whose sequence also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start. Whole texts move once,
    compressed, in chunks of about `chunk_mb` by a hash of the id, the same at every size, and all
    passes read that one exchange. A chunk sends each of its windows once at most, whatever the
    number of parts:

    1. each chunk sends the cells that its windows touch in a count-min sketch, as sorted gaps, to
       the part of the sketch that holds them; merged parts answer with one bit a cell. The sketch's
       width follows the input (`load` cells in each of `depth` rows for a window, at 6 bytes a word),
       it is never gathered in one place, and it can only overestimate, so no repeat is lost;
    2. each chunk sends its distinct windows that are estimated to repeat, once each, with 96 bits
       of hash and the first document; groups of equal windows answer whether the chunk has the
       earliest one. A window in a third of all documents gives one entry a chunk;
    3. each chunk marks the windows that start elsewhere earlier, or earlier in itself, and keeps
       the other words.

    Returns (id, n_words, n_removed, kept): the kept words joined by single spaces. Texts that are
    null or blank have no words and keep "". A null id comes after all others. Rows that repeat an
    id are ordered by their text. An empty table gives an empty result. Other columns are not read.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(1, round(total / (chunk_mb * 1e6)))
    sketch = Sketch(total / 6, depth, load, part_bits)
    group_bits = max(0, sketch.bits - 22)  # parts of the exact grouping
    texts = in_chunks(docs, id_col, text_col, chunks)

    def send_cells(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = _Chunk(rows.column("packed"), window)
        out = []
        for r in range(depth):
            for part, cells in sketch.pieces(np.unique(sketch.cells(r, chunk.distinct))):
                out.append((r * sketch.parts + part, key[0].as_py(), _packed_cells(cells)))
        return _sent(out)

    def merge_cells(key: tuple, rows: pa.Table) -> pa.Table:
        times = np.zeros(1 << sketch.part_bits, np.uint8)
        sent = [_cells(x.as_py()) for x in rows.column("data")]
        for cells in sent:  # distinct within a chunk; two are enough to know
            times[cells] = np.minimum(times[cells] + 1, 2)
        return _sent([(key[0].as_py(), c, np.packbits(times[cells] > 1).tobytes()) for c, cells in zip(rows.column("chunk").to_pylist(), sent, strict=True)])

    def estimated(chunk: _Chunk, answers: pa.Table) -> np.ndarray:
        """Whether each distinct window of the chunk may occur twice."""
        told = dict(zip(answers.column("part").to_pylist(), answers.column("data"), strict=True))
        often = np.ones(len(chunk.distinct), bool)
        for r in range(depth):
            mine = sketch.cells(r, chunk.distinct)
            cells, where, times = np.unique(mine, return_inverse=True, return_counts=True)
            flags = [np.unpackbits(np.frombuffer(told[r * sketch.parts + part].as_py(), np.uint8), count=len(x)) for part, x in sketch.pieces(cells)]
            often &= (np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool) | (times > 1))[where]
        return often | (chunk.times > 1)

    def groups_of(chunk: _Chunk, often: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Estimated repeats (indices of distinct windows) by the part that groups them."""
        picked = np.flatnonzero(often)
        part = (chunk.distinct[picked] >> np.uint64(64 - group_bits)).astype(np.int64) if group_bits else np.zeros(len(picked), np.int64)
        return [(int(part[lo]), picked[lo:hi]) for lo, hi in runs(part)]

    def send_windows(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent([])
        chunk = _Chunk(rows.column("packed"), window)
        ids = np.asarray(chunk.docs.column("id").combine_chunks().fill_null(np.iinfo(np.int64).max))
        owner = chunk.owners()
        zstd = pa.Codec("zstd")
        out = []
        for part, picked in groups_of(chunk, estimated(chunk, answers)):
            first = chunk.first[picked]
            raw = chunk.distinct[picked].tobytes() + ids[owner[first]].tobytes() + (chunk.other[first] >> np.uint64(32)).astype(np.uint32).tobytes()
            out.append((part, key[0].as_py(), len(picked).to_bytes(4, "little") + zstd.compress(raw, asbytes=True)))
        return _sent(out)

    def group_windows(key: tuple, rows: pa.Table) -> pa.Table:
        zstd = pa.Codec("zstd")
        h, ids, other, sizes = [], [], [], []
        for x in rows.column("data"):
            data = x.as_py()
            n = int.from_bytes(data[:4], "little")
            raw = zstd.decompress(data[4:], n * 20, asbytes=True)
            h.append(np.frombuffer(raw, np.uint64, n))
            ids.append(np.frombuffer(raw, np.int64, n, 8 * n))
            other.append(np.frombuffer(raw, np.uint32, n, 16 * n))
            sizes.append(n)
        h, ids, other = np.concatenate(h), np.concatenate(ids), np.concatenate(other)
        order = np.lexsort((ids, other, h))
        later = np.zeros(len(h), bool)  # the same window as the one before in this order, whose document is earlier
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
        return _sent([(key[0].as_py(), c, np.packbits(x).tobytes()) for c, x in zip(rows.column("chunk").to_pylist(), np.split(later, np.cumsum(sizes)[:-1]), strict=True)])

    def rewrite(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        if rows.num_rows:
            chunk = _Chunk(rows.column("packed"), window)
            exact = np.asarray(answers.column("exact"))
            later = np.zeros(len(chunk.distinct), bool)
            grouped = answers.filter(pa.array(exact))
            told = dict(zip(grouped.column("part").to_pylist(), grouped.column("data"), strict=True))
            for part, picked in groups_of(chunk, estimated(chunk, answers.filter(pa.array(~exact)))):
                later[picked] = np.unpackbits(np.frombuffer(told[part].as_py(), np.uint8), count=len(picked)).astype(bool)
            where = np.searchsorted(chunk.distinct, chunk.hash)
            gone = later[where]
            gone |= chunk.first[where] != np.arange(len(chunk.hash))
            done = 0
            for at, words, first in chunk.slices:
                edge = np.zeros(len(words.hash) + window + 1, np.int32)
                cut = first[gone[done : done + len(first)]]
                done += len(first)
                edge[cut] += 1
                edge[cut + window] -= 1
                kept = np.cumsum(edge)[: len(words.hash)] == 0
                n_kept = np.diff(np.concatenate([[0], np.cumsum(kept)])[words.first])
                raw, flags = words.raw.tobytes(), kept.tobytes()
                for i, n in enumerate(words.count.tolist()):
                    own = raw[words.at[i] : words.at[i + 1]].split()
                    if n_kept[i] < n:
                        own = compress(own, flags[words.first[i] : words.first[i + 1]])
                    out["kept"].append(b" ".join(own).decode("utf-8"))
                out["doc_id"] += chunk.docs.column("id").slice(at, len(words.count)).to_pylist()
                out["n_words"] += words.count.tolist()
                out["n_removed"] += (words.count - n_kept).tolist()
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    cells = texts.groupBy("chunk").applyInArrow(send_cells, _SENT)
    sketched = cells.groupBy("part").applyInArrow(merge_cells, _SENT)
    sent = texts.groupBy("chunk").cogroup(sketched.groupBy("chunk")).applyInArrow(send_windows, _SENT)
    grouped = sent.groupBy("part").applyInArrow(group_windows, _SENT)
    answers = sketched.withColumn("exact", F.lit(False)).unionByName(grouped.withColumn("exact", F.lit(True)))
    kept = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rewrite, "doc_id long, n_words long, n_removed long, kept string")
    return kept.withColumnRenamed("doc_id", id_col)
