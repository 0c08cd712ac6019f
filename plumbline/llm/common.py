"""Reading tables, cutting lineage in the shared folder, and packing whole texts into chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset a local session gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: lineage ends, no executor owns it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunk_count(docs: DataFrame, text: str, chunk_mb: float) -> int:
    """Chunks that hold about `chunk_mb` MB of text each; follows the whole input."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, round(total / (chunk_mb * 1e6)))


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values; none for an empty array."""
    if not len(values):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def in_chunks(docs: DataFrame, id_col: str, text: str, chunks: int) -> DataFrame:
    """Rows (chunk, ids, texts): the documents whose id hashes to a chunk, compressed (zstd).

    One row holds what one task had for one chunk, so a later grouping by `chunk` moves compressed
    bytes only and a group is about as large as the chunk. Rows with equal ids meet in one chunk.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column("id").combine_chunks()
            key = mix(np.asarray(ids.fill_null(0)).astype(np.uint64) + np.uint64(77)) % np.uint64(chunks)
            order = np.argsort(key, kind="stable")
            out = []
            for lo, hi in runs(key[order]):
                part = whole.take(pa.array(order[lo:hi])).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                out.append((int(key[order[lo]]), sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_pylist([{"chunk": c, "packed": b} for c, b in out], schema=_PACKED)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > 64e6:
                yield from flush()
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield from flush()

    return rows.mapInArrow(pack, "chunk int, packed binary")


_PACKED = pa.schema([("chunk", pa.int32()), ("packed", pa.binary())])


def unpacked(packed: pa.ChunkedArray | pa.Array) -> pa.Table:
    """(id, text) of a group of in_chunks rows, by id (nulls last) and then by text: the same every time."""
    parts = [pa.ipc.open_stream(x.as_py()).read_all() for x in packed]
    whole = pa.concat_tables(parts).combine_chunks()
    ids = whole.column("id").combine_chunks()
    order = np.argsort(np.asarray(ids.fill_null(np.iinfo(np.int64).max)), kind="stable")
    sorted_ids = np.asarray(ids.fill_null(np.iinfo(np.int64).max))[order]
    if (np.diff(sorted_ids) == 0).any():  # repeated ids: the order of their texts decides
        return whole.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
    return whole.take(pa.array(order)).combine_chunks()


def slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about `most` bytes, each with the index of its first text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    lengths = np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64)
    total = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def small(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows (of a few numbers each); as it is beyond, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(df: DataFrame) -> None:
    """Deletes the files of a saved() table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
