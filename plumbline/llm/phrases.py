"""Phrase collocations by stripes: each prefix keys a counter of its next words, and counters are merged elementwise."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, slices
from .words import _hashes, mix, text_buffer

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
#: Entries of a stripe in one row of an exchange, so that no row is large.
_ROW = 512
#: Entries that a task holds before it sends its stripes on.
_HELD = 1_500_000
#: Occurrences of a prefix, as a power of two, beyond which its stripe is divided by next word.
_SLICED = 18


class Pieces:
    """Words of a batch of texts, A-Z lower-cased: spans, hash, text, and whether the next word stands in the same piece."""

    def __init__(self, texts: pa.Array):
        raw, at, _ = text_buffer(texts)
        self.raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
        n = len(raw)
        inside = ~_GAP[raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(at, self.start, "right") - 1
        stops = np.cumsum(_BREAK[raw], dtype=np.int64)[self.start] if n else np.zeros(0, np.int64)
        self.joined = np.zeros(len(self.start), bool)
        self.joined[:-1] = (self.doc[1:] == self.doc[:-1]) & (stops[1:] == stops[:-1])
        self.hash = _hashes(self.raw, self.start, self.end)


def _salts(langs: pa.Array) -> np.ndarray:
    """A number for each text's language."""
    coded = langs.dictionary_encode() if not pa.types.is_dictionary(langs.type) else langs
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    return known[np.asarray(coded.indices)] if len(known) else np.zeros(len(coded), np.uint64)


def _longer(name: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Name of a phrase, from the names of its words but the last and of its words but the first."""
    return mix(name * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def _names(pieces: Pieces, salts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """At each word the name of the phrase of `words` words that starts there, and whether there is one within the piece."""
    name = mix(pieces.hash + salts[pieces.doc])
    whole = np.ones(len(name), bool)
    for j in range(1, words):
        name = _longer(name, np.concatenate([name[1:], np.zeros(1, np.uint64)])[: len(name)])
        whole &= np.concatenate([pieces.joined[j - 1 :], np.zeros(j - 1, bool)])[: len(name)]
    return name, whole


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, np.ndarray, pa.Array]]:
    for batch in batches:
        langs = batch.column("lang")
        for lo, texts in slices(batch.column("text"), 2_000_000):
            own = langs.slice(lo, len(texts))
            yield Pieces(texts), _salts(own), own


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, node, n): the stripe of the empty prefix, by language. A task sends each word that it holds once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            rows = list(held.items())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[1][0] for r in rows], pa.string()), pa.array([r[1][1].decode() for r in rows], pa.string()), pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)), pa.array([r[1][2] for r in rows], pa.int64())],
                names=["lang", "word", "node", "n"])

        for pieces, salts, langs in _parts(batches):
            name, at, n = np.unique(_names(pieces, salts, 1)[0], return_index=True, return_counts=True)
            tongue, raw = langs.to_pylist(), pieces.raw.tobytes()
            for k, i, doc, lo, hi in zip(name.tolist(), n.tolist(), pieces.doc[at].tolist(), pieces.start[at].tolist(), pieces.end[at].tolist(), strict=True):
                own = held.get(k)
                if own is None:
                    held[k] = [tongue[doc], raw[lo:hi], i]
                else:
                    own[2] += i
            if len(held) > 300_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return texts.mapInArrow(count, "lang string, word string, node long, n long").groupBy("lang", "word").agg(F.first("node").alias("node"), F.sum("n").alias("n"))


def magnitudes(grams: DataFrame, most_bits: int = 25) -> tuple[bytes, int]:
    """A table of 2**bits bytes by the upper bits of a phrase's name, with the largest log2(n) + 1 that falls there, 0 for none; and bits.

    It is one-sided: a frequent phrase always has its byte set. It has about 64 cells a phrase up to
    2**most_bits (32 MB), which bounds what the driver gathers and each worker holds; with more
    phrases than that it lets more through, which costs time and changes no count.
    """
    bits = max(10, min(most_bits, int(grams.count() * 64).bit_length()))
    cell = F.shiftrightunsigned("node", 64 - bits)
    cells = grams.groupBy(cell.alias("cell")).agg(F.max(F.floor(F.log2(F.col("n").cast("double"))) + 1).cast("long").alias("m"))
    packed = cells.groupBy(F.shiftright("cell", 3).alias("word")).agg(F.bit_or(F.expr("shiftleft(m, cast(8 * (cell & 7) as int))")).alias("m")).toArrow()
    table = np.zeros(1 << bits - 3, np.int64)
    table[np.asarray(packed.column("word"))] = np.asarray(packed.column("m"))
    return table.tobytes(), bits


def _summed(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (the first leads) and the sums of n."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(n):
        return keys, n
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(n[order], at)


def stripes(texts: DataFrame, grams: DataFrame, words: int, least: int) -> DataFrame:
    """The merged stripes of all frequent prefixes of `words` words: rows (prefix, slice, total, best, next), next an array of (suffix, node, n).

    A stripe counts, for its prefix, each next word whose phrase can still be frequent, which is
    where the phrase's words but the first (`suffix`) are a frequent phrase too; all other
    occurrences (rarer next words, ends of pieces) are counted together under suffix 0. So `total`
    adds up to the prefix's own count; `best` is the largest count of an extension, and `next` holds
    the extensions with at least `least` occurrences, `node` being the longer phrase's name.

    A task merges the stripes of the texts it reads and sends a prefix once; rows of a prefix meet
    sorted in one task, which adds them up elementwise and holds one stripe at a time. The stripe of
    a prefix with more than 2**18 occurrences is divided into slices by next word, as many as its
    count asks for, so that a word found everywhere isn't one task's work.
    """
    table, bits = magnitudes(grams)
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magnitude = np.frombuffer(sent.value, np.uint8)
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            (prefix, part, suffix), n = _summed(tuple(np.concatenate(x) for x in list(zip(*held, strict=True))[:3]), np.concatenate([x[3] for x in held]))
            return prefix, part, suffix, n

        def flush() -> Iterator[pa.RecordBatch]:
            prefix, part, suffix, n = merged()
            new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])
            first = np.flatnonzero(new)
            inside = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
            first = np.flatnonzero(inside % _ROW == 0)
            for lo in range(0, len(first), 20_000):
                at = first[lo : lo + 20_000]
                end = first[lo + 20_000] if lo + 20_000 < len(first) else len(n)
                cuts = np.append(at, end) - at[0]
                packed = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x[at[0] : end]))]) for x in (suffix, n.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(prefix[at].view(np.int64)), pa.array(part[at]), *packed], names=["prefix", "slice", "suffixes", "counts"])

        for pieces, salts, _ in _parts(batches):
            name, whole = _names(pieces, salts, words)
            size = np.where(whole, magnitude[(name >> np.uint64(64 - bits)).astype(np.int64)], 0)
            here = np.flatnonzero(size)
            after = np.append(here[1:], -1)  # the next place that counts, which may not be the next word
            extends = (after == here + 1) & np.append(pieces.joined, False)[np.minimum(here + words - 1, len(pieces.joined))]
            suffix = np.where(extends, name[np.minimum(here + 1, len(name) - 1)], np.uint64(0))
            wide = np.maximum(size[here].astype(np.int64) - 1 - _SLICED, 0)
            part = (suffix & ((np.uint64(1) << wide.astype(np.uint64)) - np.uint64(1))).astype(np.int32)
            keys, n = _summed((name[here], part, suffix), np.ones(len(here), np.int64))
            held.append((*keys, n))
            if sum(len(x[3]) for x in held) > _HELD:
                held[:] = [merged()]
                if len(held[0][3]) > _HELD // 2:
                    yield from flush()
                    held.clear()
        if held and sum(len(x[3]) for x in held):
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None

        def result(prefix: np.ndarray, part: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])[: len(n)])
            often = (n >= least) & (suffix != 0)
            upto = np.concatenate([[0], np.cumsum(often)])
            offsets = upto[np.append(first, len(n))].astype(np.int32)
            best = np.maximum.reduceat(np.where(suffix != 0, n, 0), first) if len(n) else n
            node = _longer(prefix[often], suffix[often])
            inner = pa.StructArray.from_arrays([pa.array(suffix[often].view(np.int64)), pa.array(node.view(np.int64)), pa.array(n[often])], names=["suffix", "node", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array(prefix[first].view(np.int64)), pa.array(part[first]), pa.array(np.add.reduceat(n, first) if len(n) else n), pa.array(best), pa.ListArray.from_arrays(pa.array(offsets), inner)],
                names=["prefix", "slice", "total", "best", "next"])

        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.asarray(pc.binary_length(batch.column("counts"))).astype(np.int64) // 4
            new = (
                np.repeat(np.asarray(batch.column("prefix")).view(np.uint64), size), np.repeat(np.asarray(batch.column("slice")), size),
                np.frombuffer(b"".join(batch.column("suffixes").to_pylist()), np.uint64), np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint32).astype(np.int64))
            (prefix, part, suffix), n = _summed(new[:3], new[3]) if kept is None else _summed(tuple(np.concatenate([a, b]) for a, b in zip(kept[:3], new[:3], strict=True)), np.concatenate([kept[3], new[3]]))
            last = (prefix == new[0][-1]) & (part == new[1][-1])  # the stripe that may go on in the next batch
            kept = tuple(x[last] for x in (prefix, part, suffix, n))
            if not last.all():
                yield result(*(x[~last] for x in (prefix, part, suffix, n)))
        if kept is not None:
            yield result(*kept)

    rows = texts.mapInArrow(count, "prefix long, slice int, suffixes binary, counts binary")
    dealt = rows.repartition("prefix", "slice").sortWithinPartitions("prefix", "slice")
    return dealt.mapInArrow(add, "prefix long, slice int, total long, best long, next array<struct<suffix: long, node: long, n: long>>")


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, most_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to `most_words` words with at least `least` occurrences, and (lang, n), each language's words.

    Phrases are rows (lang, phrase, words, a, lefts, rights, longer): the counts of its first k
    words and of the rest for each cut k, and the largest count of a phrase that is one word longer
    and has it at its begin or end (null for none). One pass over the texts extends the frequent
    phrases by a word: a phrase is frequent only if its words but the last and but the first are.
    """
    texts = _texts(docs, text_col, lang_col)
    words = saved(word_counts(texts), "phrase-words")
    sizes = saved(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    empty = F.array().cast("array<long>")
    grams = saved(words.where(F.col("n") >= least).select("node", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", empty.alias("lefts"), empty.alias("rights")), "phrase-grams1")
    discard(words)
    found: list[DataFrame] = []
    for k in range(1, most_words):
        if not grams.limit(1).count():
            break
        striped = saved(stripes(texts, grams, k, least), f"phrase-stripes{k}")
        heads = striped.groupBy("prefix").agg(F.sum("total").alias("total"), F.max("best").alias("best"))
        entries = striped.select("prefix", F.explode("next").alias("e")).select("prefix", "e.suffix", "e.node", "e.n")
        before = grams.join(heads.withColumnRenamed("prefix", "node"), "node").select(F.col("node").alias("prefix"), "lang", "phrase", "total", F.col("lefts").alias("before"))
        behind = grams.select(F.col("node").alias("suffix"), "last", F.col("n").alias("rest"), F.col("rights").alias("after"))
        new = entries.join(before, "prefix").join(behind, "suffix").select(
            "node", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n",
            F.concat("before", F.array("total")).alias("lefts"), F.concat(F.array("rest"), F.col("after")).alias("rights"))
        if k > 1:
            best = heads.select(F.col("prefix").alias("node"), F.col("best").alias("longer")).unionByName(entries.select(F.col("suffix").alias("node"), F.col("n").alias("longer")))
            longer = saved(best.where(F.col("longer") >= least).groupBy("node").agg(F.max("longer").alias("longer")), f"phrase-longer{k}")
            found.append(grams.join(longer, "node", "left"))
        grams = saved(new, f"phrase-grams{k + 1}")
        discard(striped)
    else:
        found.append(grams.withColumn("longer", F.lit(None).cast("long")))
    out = grams.limit(0).withColumn("longer", F.lit(None).cast("long"))
    for x in found:
        out = out.unionByName(x)
    return out.select("lang", "phrase", (F.size("lefts") + 1).alias("words"), F.col("n").alias("a"), "lefts", "rights", "longer"), sizes


def lowest_cut(n: Column) -> Column:
    """(score, k, l, r) of the cut with the lowest floor(1000 * a * n / (l * r)), ties to the smallest k; decimals of 38 digits."""
    wide = "decimal(18,0)"
    whole = (F.lit(1000).cast(wide) * F.col("a").cast(wide)).cast("decimal(20,0)") * n.cast(wide)

    def cut(left: Column, i: Column) -> Column:
        right = F.get("rights", i)
        return F.struct(F.call_function("div", whole, left.cast(wide) * right.cast(wide)).cast("long").alias("score"), (i + 1).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform("lefts", cut))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, most_words: int = 5, share: int = 100, top: int = 2000, salts: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, then a, both descending, then phrase.

    Texts are lower-cased (A-Z), divided into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
    ``[^\\x20\\x09]+``; all counts are of a language (null: und) and exact. A phrase is dropped if a
    longer frequent one that holds it has at least `share` % of its count; as counts fall with each
    word added, the phrases longer by one word decide. Null and blank texts have no words; repeated
    rows count each time; other columns are not read; an empty table gives an empty result.
    """
    phrases, sizes = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, least=least, most_words=most_words)
    kept = phrases.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).join(sizes, "lang")
    scored = kept.withColumn("cut", lowest_cut(F.col("n"))).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    first = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
