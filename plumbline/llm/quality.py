"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, runs, saved, slices, small, unpacked
from .substrings import _SENT, _sent
from .words import mix, text_buffer

#: Bytes of an n-gram; codes of five bytes fit in 40 bits.
ORDER = 5


def byte_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code of the ORDER-gram that ends at each byte of each text, where a text begins with zero bytes; and the offsets of the texts."""
    raw, at, _ = text_buffer(texts)
    code = np.zeros(len(raw), np.int64)
    own = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    for back in range(ORDER):
        shifted = np.concatenate([np.zeros(back, np.int64), raw[: len(raw) - back].astype(np.int64)])[: len(raw)]
        code |= np.where(own >= back, shifted, 0) << 8 * back
    return code, at


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*held, strict=True))
    code, where = np.unique(code, return_inverse=True)
    return code, np.bincount(where, weights=n).astype(np.int64)


def count_grams(trusted: DataFrame, text: str) -> DataFrame:
    """(gram, n): how often each ORDER-gram occurs in the whole trusted text; a task sends each of its grams once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, texts in slices(batch.column("text"), 2_000_000):
                held.append(np.unique(byte_grams(texts)[0], return_counts=True))
                if sum(len(c) for c, _ in held) > 3_000_000:
                    held = [_merged(held)]
        if held:
            code, n = _merged(held)
            for lo in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], names=["gram", "n"])

    return trusted.select(F.col(text).alias("text")).where("text is not null").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The modified discounts of one order, from its counts of counts; 0.5, 1 and 1.5 where these are too few."""
    n1, n2, n3, n4 = (float(x) for x in counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first())
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05 * i), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def train(trusted: DataFrame, text: str = "text") -> tuple[dict[int, DataFrame], dict[int, DataFrame], float]:
    """Tables of the model: probabilities {m: (gram, p)} of seen m-grams and back-off weights {m: (context, weight)}, and the weight of an unseen byte.

    Counts are tables keyed by n-gram code, spread over the cluster. Orders below the highest count
    distinct left neighbours; an order's probability is joined with that of its suffix.
    """
    counts = {ORDER: saved(count_grams(trusted, text), "kn-counts")}
    for m in range(ORDER - 1, 0, -1):
        counts[m] = saved(counts[m + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"kn-counts{m}")
    seen: dict[int, DataFrame] = {}
    weights: dict[int, DataFrame] = {}
    floor = 1.0
    for m in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[m])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.shiftright("gram", 8).alias("context")
        weight = counts[m].groupBy(context).agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("weight"))
        own = counts[m].withColumn("context", context).join(weight, "context").withColumn("own", (F.col("n") - discount) / F.col("total"))
        if m == 1:
            seen[1] = own.select("gram", (F.col("own") + F.col("weight") / 256).alias("p"))
            first = weight.agg(F.max("weight")).first()[0]
            floor = (1.0 if first is None else first) / 256
        else:
            lower = seen[m - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1))).join(lower, "suffix")
            seen[m] = own.select("gram", (F.col("own") + F.col("weight") * F.col("q")).alias("p"))
        seen[m], weights[m] = saved(seen[m], f"kn-seen{m}"), saved(weight.select("context", "weight"), f"kn-weights{m}")
    return seen, weights, floor


def log_probabilities(grams: DataFrame, model: tuple[dict[int, DataFrame], dict[int, DataFrame], float]) -> DataFrame:
    """(gram, logp) of distinct ORDER-grams by joins with the model: the longest seen suffix, times the back-off weights of the contexts above it."""
    seen, weights, floor = model
    rows = grams
    for m in range(ORDER, 0, -1):
        rows = rows.withColumn(f"g{m}", F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1))).withColumn(f"c{m}", F.shiftright(f"g{m}", 8))
        rows = rows.join(seen[m].select(F.col("gram").alias(f"g{m}"), F.col("p").alias(f"p{m}")), f"g{m}", "left")
        if m > 1:
            rows = rows.join(weights[m].select(F.col("context").alias(f"c{m}"), F.col("weight").alias(f"w{m}")), f"c{m}", "left")
    p: Column = F.coalesce("p1", F.lit(floor))
    for m in range(2, ORDER + 1):
        p = F.coalesce(F.col(f"p{m}"), F.coalesce(F.col(f"w{m}"), F.lit(1.0)) * p)
    return rows.select("gram", F.log(F.greatest(p, F.lit(1e-30))).alias("logp"))


def perplexities(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", chunk_mb: float = 16.0) -> DataFrame:
    """(id, n_bytes, perplexity) of every whole text; null perplexity for a null or empty text.

    Texts move once, compressed, in chunks. A chunk asks for each of its distinct n-grams once, by
    shard; the shards' distinct n-grams are joined with the model, and answers go back to the
    chunks, where each document adds up the logarithms over all its bytes.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(1, round(total / (chunk_mb * 1e6)))
    shards = max(1, chunks // 2)
    texts = in_chunks(docs, id_col, text_col, chunks)

    def shard_of(grams: np.ndarray) -> np.ndarray:
        return (mix(grams.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)

    def distinct(table: pa.Table) -> np.ndarray:
        found = np.zeros(0, np.int64)
        for _, part in slices(table.column("text")):
            found = np.union1d(found, byte_grams(part)[0])
        return found

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        grams = distinct(unpacked(rows.column("packed")))
        shard = shard_of(grams)
        order = np.argsort(shard, kind="stable")
        return _sent([(int(shard[order[lo]]), key[0].as_py(), grams[order[lo:hi]].tobytes()) for lo, hi in runs(shard[order])])

    asked = texts.groupBy("chunk").applyInArrow(ask, _SENT)

    def once(key: tuple, rows: pa.Table) -> pa.Table:
        found = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column("data")]))
        return pa.table({"gram": found, "part": np.full(len(found), key[0].as_py(), np.int32)})

    wanted = asked.groupBy("part").applyInArrow(once, "gram long, part int")
    known = log_probabilities(wanted.select("gram"), model)

    known = known.join(wanted, "gram").select("part", "gram", "logp")

    def answer(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent([])
        grams, logp = np.asarray(table.column("gram")), np.asarray(table.column("logp"))
        order = np.argsort(grams)
        grams, logp = grams[order], logp[order]
        out = []
        for chunk, x in zip(rows.column("chunk").to_pylist(), rows.column("data"), strict=True):
            own = np.frombuffer(x.as_py(), np.int64)
            out.append((key[0].as_py(), chunk, np.concatenate([own.view(np.float64), logp[np.searchsorted(grams, own)]]).tobytes()))
        return _sent(out)

    answers = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, _SENT)

    def score(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        ids, sizes, sums = [], [], []
        if rows.num_rows:
            docs_ = unpacked(rows.column("packed"))
            pairs = [np.frombuffer(x.as_py(), np.int64) for x in told.column("data")]
            grams = np.concatenate([np.zeros(0, np.int64), *(p[: len(p) // 2] for p in pairs)])
            logp = np.concatenate([np.zeros(0), *(p[len(p) // 2 :].view(np.float64) for p in pairs)])
            order = np.argsort(grams)
            grams, logp = grams[order], logp[order]
            ids = docs_.column("id").to_pylist()
            for _, part in slices(docs_.column("text"), 1_000_000):
                code, at = byte_grams(part)
                each = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(grams, code)])]) if len(code) else np.zeros(1)
                sums.append(each[at[1:]] - each[at[:-1]])
                sizes.append(np.diff(at))
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        total_ = np.concatenate([np.zeros(0), *sums])
        value = np.exp(-total_ / np.maximum(size, 1))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size.astype(np.int64)), "perplexity": pa.array(value, mask=size == 0)})

    scored = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, n_bytes long, perplexity double")
    return scored.withColumnRenamed("doc_id", id_col)


def trusted_ids(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Ids whose labels all say quality 1 and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select(id_col)


def judge_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reach: float = 3.0,
) -> DataFrame:
    """(id, lang, n_bytes, perplexity, threshold, keep): documents kept where the perplexity is within their language's threshold.

    The model learns from all trusted documents but one in five (by a hash of the id), whose
    perplexities give the thresholds: for each language the upper quartile of log-perplexity plus
    `reach` times the distance of the quartiles. A language without such documents, or a null one, has
    the threshold of all together, and without any trusted document everything with text is kept.
    Null and empty texts have a null perplexity and are not kept. Repeated rows are judged alike;
    rows that repeat an id with another text or language are judged by any one of that id's languages.
    An empty table gives an empty result.
    """
    held = F.xxhash64(id_col, F.lit(5)) % 5 == 0
    trusted = saved(trusted_ids(labels, id_col=id_col), "trusted")
    learn = docs.select(id_col, text_col).join(small(trusted.where(~held)), id_col, "left_semi")
    scored = perplexities(docs, train(learn, text_col), id_col=id_col, text_col=text_col)
    langs = docs.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(lang_col).alias("lang"))
    known = saved(scored.join(langs, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id"), "perplexities")

    basis = known.where("perplexity is not null").join(small(trusted.where(held)), id_col, "left_semi").withColumn("x", F.log("perplexity"))
    quartile = lambda q: F.percentile_approx("x", q, 10_000)
    fence = F.exp(quartile(0.75) + reach * (quartile(0.75) - quartile(0.25)))
    everywhere = basis.agg(fence.alias("t")).first()[0]
    by_lang = basis.where("lang is not null").groupBy("lang").agg(fence.alias("own"))
    threshold = F.coalesce("own", F.lit(everywhere).cast("double"))
    keep = F.coalesce(F.col("perplexity") <= F.coalesce(threshold, F.lit(float("inf"))), F.lit(False))
    return known.join(small(by_lang), "lang", "left").select(id_col, "lang", "n_bytes", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
