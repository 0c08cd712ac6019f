"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as double; null where the vector is null or empty or has a null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def build_block(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Slices of one block: ids in order, the least component `lo`, and bitmaps [component, bit, word] of value - lo."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    lo = int(values.min())
    bits = max(1, int(values.max() - lo).bit_length())
    n = len(ids)
    words = -(-n // 64)
    raised = (values - lo).astype(np.uint64)
    slices = np.zeros((values.shape[1], bits, words), np.uint64)
    for b in range(bits):
        plane = ((raised >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
        padded = np.zeros((plane.shape[0], words * 64), np.uint8)
        padded[:, :n] = plane
        slices[:, b] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    return ids, lo, slices


def add_slices(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bitmaps, lowest first, of the sum of |weight| * slice: a column of bitmaps for each power of two, folded by full adders.

    Where a weight is negative the complement of its slices is added.
    """
    bits = slices.shape[1]
    sides = [(np.flatnonzero(weights > 0), False), (np.flatnonzero(weights < 0), True)]
    size = np.abs(weights)
    top = int(size.max()).bit_length() if len(size) else 0
    chosen = [[(d[(size[d] >> t) & 1 == 1], flip) for d, flip in sides] for t in range(top)]
    out: list[np.ndarray] = []
    carries: list[np.ndarray] = []
    power = 0
    while power < bits + top - 1 or carries:
        column = carries
        for t in range(max(0, power - bits + 1), min(top, power + 1)):
            for d, flip in chosen[t]:
                if len(d):
                    part = slices[d, power - t]
                    column.append(~part if flip else part)
        carries = []
        x = np.concatenate(column) if column else np.zeros((1, slices.shape[2]), np.uint64)
        while len(x) > 2:
            m = len(x) // 3
            a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (c & half))
            x = np.concatenate([half ^ c, x[3 * m :]])
        if len(x) == 2:
            carries.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        out.append(x[0])
        power += 1
    return out


def select_top(total: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Rows (positions, ascending) of the k largest sums, from the most significant slice down; the boundary's ties go to the first rows."""
    sure, open_ = np.zeros_like(alive), alive
    n_sure = 0
    for plane in reversed(total):
        hit = open_ & plane
        n = int(np.bitwise_count(hit).sum())
        if n_sure + n > k:
            open_ = hit
        else:
            sure, n_sure, open_ = sure | hit, n_sure + n, open_ & ~plane
            if n_sure == k:
                return _positions(sure)
    rows = _positions(open_)[: k - n_sure]
    return np.sort(np.concatenate([_positions(sure), rows]))


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, lo: int, slices: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """The block's k best rows for one query, and their exact scores; rows with the query's own id take no part."""
    valid = np.zeros(slices.shape[2] * 64, np.uint8)
    valid[: len(ids)] = ids != query_id
    alive = np.packbits(valid, bitorder="little").view(np.uint64)
    total = add_slices(slices, query)
    rows = select_top(total, alive, k)
    ones = (1 << slices.shape[1]) - 1
    base = sum(int(w) * lo for w in query) + sum(int(w) * ones for w in query if w < 0)
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    scores = [base] * len(rows)
    for p, plane in enumerate(total):
        for i, on in enumerate((plane[word] >> bit) & np.uint64(1)):
            scores[i] += int(on) << p
    return ids[rows], scores


def _matrix(values: pa.ChunkedArray) -> np.ndarray:
    flat = values.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def top_k(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = 10, scale: int = 1024, row_block: int = 16384, query_block: int = 8192,
) -> DataFrame:
    """The k rows with the largest integer inner product for each query: (query_id, rank, id, score).

    Rows are dealt to blocks of about `row_block`; each block becomes one row of an index of bit
    slices. Query blocks meet index blocks in pairs, a block pair is one group, and each gives k
    rows a query, of which a window keeps the best; results carry a query's number instead of its
    vector. Memory follows the block sizes only. What is moved grows with queries times rows, as the
    work does, divided by the block sizes: an index row (about 88 bytes for 64 components) goes to each 8192
    queries, a query to each 16,384 rows.

    Vectors that are null or empty or hold a null or non-finite component take no part, nor do null
    ids; vectors of different lengths don't meet. Rows with the query's own id are not its
    candidates; equal scores go to the smaller id; a query repeated as it is counts once, repeated
    candidates each take a rank. With fewer than k candidates all are returned; an empty table gives
    an empty result. Other columns are not read. Scores must fit in 64 bits.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
    rows = saved(rows.where("v is not null and vec_id is not null").withColumn("dim", F.size("v")), "topk-vectors")
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-m // query_block))

    def index(key: tuple, block: pa.Table) -> pa.Table:
        ids, lo, slices = build_block(np.asarray(block.column("vec_id")), _matrix(block.column("v")))
        return pa.table({"dim": [key[0].as_py()], "rb": [key[1].as_py()], "ids": [ids.tobytes()], "lo": [lo], "bits": [slices.shape[1]], "slices": [slices.tobytes()]}, schema=pa.schema(
            [("dim", pa.int32()), ("rb", pa.int32()), ("ids", pa.binary()), ("lo", pa.int64()), ("bits", pa.int32()), ("slices", pa.binary())]))

    indexed = (
        rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(row_blocks)).cast("int"))
        .select("dim", "rb", "vec_id", "v").groupBy("dim", "rb")
        .applyInArrow(index, "dim int, rb int, ids binary, lo long, bits int, slices binary")
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    )
    asked = (
        rows.where("asks").select("dim", "vec_id", "v", F.xxhash64("v").alias("number")).distinct()
        .withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    )

    def search(key: tuple, block: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "number": [], "vec_id": [], "score": []}
        if block.num_rows and queries.num_rows:
            ids = np.frombuffer(block.column("ids")[0].as_py(), np.int64)
            lo, bits = block.column("lo")[0].as_py(), block.column("bits")[0].as_py()
            slices = np.frombuffer(block.column("slices")[0].as_py(), np.uint64).reshape(key[0].as_py(), bits, -1)
            wanted = _matrix(queries.column("v"))
            for query_id, number, query in zip(queries.column("vec_id").to_pylist(), queries.column("number").to_pylist(), wanted, strict=True):
                found, scores = search_block(ids, lo, slices, query_id, query, k)
                out["query_id"] += [query_id] * len(found)
                out["number"] += [number] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("number", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    keys = ["dim", "rb", "qb"]
    found = indexed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, number long, vec_id long, score long")
    best = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
