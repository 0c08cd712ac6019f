"""Benchmark decontamination by template windows with typed placeholders and consistent slots."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, small
from .words import Words, _hashes, mix

# Words that name a unit when they follow a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonnes "
    "ml cl l liter liters litre litres gallon gallons cup cups second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters percent degree degrees dollar dollars euro euros cent cents usd eur kmh mph watt watts volt volts"
).split()
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547))
#: Windows up to this number are sent to all tasks, to drop other windows early; beyond it the join alone finds them.
MOST_BROADCAST = 2_000_000
#: Shorter items match by their words only.
LEAST_TEMPLATE = 4


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    words = Words(pa.array([" ".join(UNITS)]))
    return np.sort(_hashes(raw, words.start, words.end))


class Templates:
    """Canonical tokens of texts: a hash of the bare lower-cased word, or of a placeholder's type.

    A word is stripped to its first and last letter or digit; words without either are passed over.
    Numbers, units after a number, and capitalised words inside a sentence (a name: one capital, in
    front, and more than one letter) become placeholders; `value` keeps what filled each slot.
    """

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        raw = words.raw
        wide = raw >= 128
        digit = (raw >= 48) & (raw <= 57)
        small = (raw | 32) - np.uint8(97) < 26
        after = np.concatenate([[False], raw[:-1] == 0xC3])
        capital = small & (raw < 97) | after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        core = np.flatnonzero(wide | digit | small)
        i, j = np.searchsorted(core, words.start), np.searchsorted(core, words.end)
        full = j > i
        start, end = core[i[full]], core[j[full] - 1] + 1
        upto = [np.concatenate([[0], np.cumsum(x)]) for x in (digit, small | wide, capital, raw == 10)]
        digits, letters, capitals = (c[end] - c[start] for c in upto[:3])
        lead = np.zeros(len(start), bool)
        if len(start):
            lead = capital[start] | (raw[start] == 0xC3) & capital[np.minimum(start + 1, len(raw) - 1)]
        self.doc = words.doc[full]
        word = np.flatnonzero(full)
        before = np.maximum(word - 1, 0)
        opening = (word == words.first[self.doc]) | np.isin(raw[words.end[before] - 1] if len(raw) else raw, np.frombuffer(b".!?:;", np.uint8)) | (upto[3][words.start[word]] > upto[3][words.end[before]])
        lower = np.where(capital, raw + 32, raw).astype(np.uint8)
        self.value = _hashes(lower, start, end)
        number = (digits > 0) & ((letters == 0) | (digit[start] if len(start) else False))
        name = lead & (capitals == 1) & (letters > 1) & ~opening & ~number
        units = _unit_hashes()
        unit = np.concatenate([[False], number[:-1] & (self.doc[1:] == self.doc[:-1])])[: len(number)] & (units[np.minimum(np.searchsorted(units, self.value), len(units) - 1)] == self.value) & ~number
        self.slot = number | name | unit
        self.token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, self.value)))
        self.first = np.searchsorted(self.doc, np.arange(len(words.count) + 1))

    def windows(self, length: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, hash and number of literal tokens of windows of `length` tokens in one text.

        `exact`: of every window, by its words. Otherwise by canonical tokens, of windows with a slot
        and a literal token: without a slot the words say the same, without a literal any numbers would match.
        """
        n = len(self.token) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        literals = np.concatenate([[0], np.cumsum(~self.slot)])
        literals = literals[length:] - literals[:-length]
        here = self.doc[:n] == self.doc[length - 1 :]
        if not exact:
            here &= (literals > 0) & (literals < length)
        here = np.flatnonzero(here)
        total = np.zeros(n, np.uint64)
        factors = mix(np.arange(1, length + 1, dtype=np.uint64) + np.uint64(1000 * length + 500 * exact)) | np.uint64(1)
        token = self.value if exact else self.token
        for k in range(length):
            total += token[k : k + n] * factors[k]
        return here, mix(total[here]), literals[here]


_WINDOW = "id long, place int, size int, hash long, exact boolean, literals int, at array<int>, slots array<long>, names array<boolean>"


def _windows_of(rows: DataFrame, lengths: list[int] | None, window: int, wanted: np.ndarray | None) -> DataFrame:
    """Windows of (id, text), by words and by canonical tokens: of the given lengths, or of each text's own (the shorter of `window` and its tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch.column("text"), 1_000_000):
                ids = batch.column("id").slice(lo, len(texts))
                t = Templates(texts)
                count = np.diff(t.first)
                for length, exact in [(x, e) for x in lengths or range(1, window + 1) for e in (True, False) if e or x >= LEAST_TEMPLATE]:
                    first, h, literals = t.windows(length, exact)
                    keep = np.ones(len(h), bool)
                    if lengths is None:
                        keep &= np.minimum(count, window)[t.doc[first]] == length
                    if wanted is not None and len(wanted):
                        keep &= wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                    first, h, literals = first[keep], h[keep], literals[keep]
                    if not len(h):
                        continue
                    spot = [np.flatnonzero(t.slot[i : i + length] & (not exact)) for i in first.tolist()]
                    at = pa.array([x.tolist() for x in spot], pa.list_(pa.int32()))
                    slots = pa.array([t.value[i + x].view(np.int64).tolist() for i, x in zip(first.tolist(), spot, strict=True)], pa.list_(pa.int64()))
                    names = pa.array([(t.token[i + x] == _NAME).tolist() for i, x in zip(first.tolist(), spot, strict=True)], pa.list_(pa.bool_()))
                    doc = t.doc[first]
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(doc)), pa.array((first - t.first[doc]).astype(np.int32)), pa.array(np.full(len(h), length, np.int32)), pa.array(h.view(np.int64)),
                        pa.array(np.full(len(h), exact)), pa.array(literals.astype(np.int32)), at, slots, names], names=["id", "place", "size", "hash", "exact", "literals", "at", "slots", "names"])

    return rows.mapInArrow(run, _WINDOW)


def _agreeing(filled: dict[int, tuple[int, int, bool]]) -> set[int]:
    """The slots of one alignment, place to (item's value, document's, whether a name), that agree with its majority filling.

    Each value of the item is filled by what most of its slots have, itself in a tie; in another tie
    none of them agrees. Two numbers may meet in one; names that would meet in one do not agree.
    """
    votes: dict[int, Counter] = {}
    for b, d, _ in filled.values():
        votes.setdefault(b, Counter())[d] += 1
    best = {b: {d for d, n in v.items() if n == max(v.values())} for b, v in votes.items()}
    best = {b: {b} if b in ds else ds for b, ds in best.items()}
    named = Counter(d for b in {b for b, _, name in filled.values() if name} for d in best[b])
    return {k for k, (b, d, name) in filled.items() if best[b] == {d} and (not name or named[d] == 1)}


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that count in each alignment (id, item_id, shift)."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            same = {w["item_place"] for w in r["hits"] if w["exact"]}
            rich = {w["item_place"] for w in r["hits"] if w["rich"]}
            alike = [w for w in r["hits"] if not w["exact"]]
            filled = {w["item_place"] + k: (b, d, name) for w in alike for k, b, d, name in zip(w["at"], w["item_slots"], w["slots"], w["names"], strict=True)}
            literal = {w["item_place"] for w in r["hits"] if w["literals"]}
            whole = len(literal) >= r["needed"] > 0
            good = _agreeing(filled)
            fit = {w["item_place"] for w in alike if all(w["item_place"] + k in good for k in w["at"])}
            places = same | fit if whole or same or fit & rich else set()
            if whole and places >= literal:
                places |= set(range(r["windows"]))
            if places:
                out.append({"id": r["id"], "item_id": r["item_id"], "places": sorted(places), "rich": sorted(places & rich), "reworded": any(b != d for b, d, _ in filled.values())})
        yield pa.RecordBatch.from_pylist(out, schema=_JUDGED)


_JUDGED = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("places", pa.list_(pa.int32())), ("rich", pa.list_(pa.int32())), ("reworded", pa.bool_())])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 8, coverage: float = 0.5, run: int = 6,
) -> DataFrame:
    """(id, item_id, matched, windows, coverage, reworded): documents that hold a benchmark item, as it is or re-parameterised.

    Every window of `window` tokens of an item is hash-joined twice: by its words, and by its
    canonical tokens if it has a slot and a literal token. Windows with equal words always count.
    Others must fill their slots as most slots of the alignment of document and item do: a value of
    the item by one value of the document, and different names by different ones (different numbers
    may meet in one). A slot filled otherwise costs the windows that hold it. And those with
    fewer than 5 literal tokens in 8 count only at an alignment that has a window with more or with
    equal words, or that matches the whole item (all its windows with a literal token; those
    of slots only then count with them). A pair counts if its windows are at least `coverage` of the item's (or of those of them with 5 literal
    tokens in 8, if that is more), or `run` windows at one alignment. `reworded` tells that some
    slot's value differs.

    Documents' windows are dropped in the scan unless the benchmark has them, so only candidates
    are shuffled, whatever the corpus; equal windows of a benchmark meet documents by hash, not
    each other. Items with fewer than 8 tokens are one window of their own length; with fewer than
    4 they match by their words only, so an item of one common word is found in all its documents.
    Items of slots only match by their words. Null or blank texts and null ids match nothing;
    repeated rows of one id count as one document; empty tables give an empty result. Other columns
    are not read.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null")
    items = saved(_windows_of(items, None, window, None), "leak-items").withColumnsRenamed({"id": "item_id", "place": "item_place", "slots": "item_slots"})
    items = items.withColumn("rich", F.col("literals") * 8 >= F.col("size") * 5)
    lengths = sorted(r[0] for r in items.select("size").distinct().collect())
    wanted = None
    if items.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        wanted = np.sort(np.array([r[0] for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    hits = _windows_of(rows, lengths or [window], window, wanted if lengths else np.array([1], np.uint64)).select("id", "place", "size", "hash", "slots")
    hits = hits.join(small(items, 200_000), ["hash", "size"]).withColumn("shift", F.col("place") - F.col("item_place"))
    sizes = items.where("exact").groupBy("item_id").agg(
        F.countDistinct("item_place").alias("windows"), F.countDistinct(F.when(F.col("rich"), F.col("item_place"))).alias("rich_windows"), F.countDistinct(F.when(F.col("literals") > 0, F.col("item_place"))).alias("needed"))
    aligned = hits.groupBy("id", "item_id", "shift").agg(F.collect_set(F.struct("item_place", "exact", "rich", "literals", "at", "item_slots", "slots", "names")).alias("hits"))
    counted = aligned.join(sizes.select("item_id", "needed", "windows"), "item_id").select("id", "item_id", "hits", "needed", "windows").mapInArrow(_judge, "id long, item_id long, places array<int>, rich array<int>, reworded boolean")
    every = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    found = counted.groupBy("id", "item_id").agg(every("places").alias("matched"), every("rich").alias("rich"), F.max(F.size("places")).alias("longest"), F.max("reworded").alias("reworded"))
    found = found.join(sizes, "item_id").withColumn("coverage", F.greatest(F.col("matched") / F.col("windows"), F.try_divide("rich", "rich_windows")))
    return found.where((F.col("coverage") >= coverage) | (F.col("longest") >= run)).select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "matched", "windows", "coverage", "reworded")


def judged(docs: DataFrame, leaks: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row for each document: (id, contaminated, n_items, first_item)."""
    per = leaks.groupBy(F.col(id_col).alias("_id")).agg(F.countDistinct(item_col).alias("n_items"), F.min(item_col).alias("first_item"))
    return docs.select(id_col).join(per, F.col(id_col) == F.col("_id"), "left").select(
        id_col, F.col("_id").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    gone = find_leaks(docs, benchmark, **options).select(F.col(id_col).alias("_id")).distinct()
    gone = small(saved(gone, "leaks"))
    return docs.join(gone, docs[id_col] == gone["_id"], "left_anti")
