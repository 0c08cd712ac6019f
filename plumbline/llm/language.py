"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

UNDETERMINED = "und"
#: Bytes of text at once; its n-grams take some hundred times as much.
_TEXT = 250_000
_EDGE = (1 << 21) - 1  # stands for the boundary of a word; above all code points


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter; made once in each worker."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text and code of every 1-, 2- and 3-gram, and whether each text has a letter.

    A word is a run of letters, lower-cased, between boundaries; a gram may begin or end with a
    boundary and does not reach over one. A code holds up to three code points of 21 bits.
    """
    joined = "\0".join((t or "").replace("\0", " ") for t in texts).lower() + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    doc = np.cumsum(points == 0) - (points == 0)
    has_letter = np.bincount(doc[letter], minlength=len(texts))[: len(texts)] > 0
    keep = letter | np.concatenate([[False], letter[:-1]])  # a word's letters and one place after it
    s = np.concatenate([[_EDGE], np.where(letter, points, _EDGE)[keep]])
    d = np.concatenate([[0], doc[keep]])
    inner = s != _EDGE
    a, b = s[:-1], s[1:]
    middle = np.flatnonzero(inner[1:-1]) + 1
    owner = np.where(inner[:-1], d[:-1], d[1:])
    return (
        np.concatenate([d[inner], owner, d[middle]]),
        np.concatenate([s[inner] << 42, a << 42 | b << 21, s[middle - 1] << 42 | s[middle] << 21 | s[middle + 1]]),
        has_letter,
    )


def counted(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) in order, with counts; sorts one packed number, over the letters at hand."""
    if not len(code):
        return owner, code, np.zeros(0, np.int64)
    present = np.zeros(1 << 21, bool)
    for shift in (42, 21, 0):
        present[(code >> shift) & _EDGE] = True
    present[0] = True
    letters = np.flatnonzero(present)
    width = max(1, int(len(letters) - 1).bit_length())
    if 3 * width + int(owner.max()).bit_length() > 63:  # a huge alphabet: halves of the owners
        half = owner <= np.median(owner)
        if half.all():
            half = owner < owner.max()
        parts = [counted(owner[half], code[half]), counted(owner[~half], code[~half])]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    dense = np.cumsum(present) - 1
    key = owner << 3 * width | dense[code >> 42] << 2 * width | dense[(code >> 21) & _EDGE] << width | dense[code & _EDGE]
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.concatenate([first, [len(key)]]))
    key, low = key[first], (1 << width) - 1
    return key >> 3 * width, letters[(key >> 2 * width) & low] << 42 | letters[(key >> width) & low] << 21 | letters[key & low], n


def ranked(owner: np.ndarray, code: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, rank from 0, code) of each owner's `most` most frequent grams; ties by code."""
    order = np.lexsort((-n, owner))  # stable: codes are in order within an owner
    owner, code = owner[order], code[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.concatenate([start, [len(owner)]])))
    keep = rank < most
    return owner[keep], rank[keep], code[keep]


def learn_profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", size: int = 300) -> DataFrame:
    """(lang, rank, gram): the `size` most frequent grams of each language, counted over all given texts.

    A task adds up what it reads and sends each of its grams once. Null texts and null languages
    teach nothing; an empty table gives no profile.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size_held = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            owner, code, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((code, owner))
            owner, code, n = owner[order], code[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]))
            return owner[first], code[first], np.add.reduceat(n, first)

        for batch in batches:
            for at, texts in slices(batch.column("text"), _TEXT):
                langs = batch.column("lang").slice(at, len(texts)).to_pylist()
                index = np.array([names.setdefault(x, len(names)) for x in langs])
                owner, code, _ = grams(texts.to_pylist())
                if len(code):
                    held.append(counted(index[owner], code))
                    size_held += len(held[-1][0])
            if size_held > 1_000_000:
                held = [merged()]
                size_held = len(held[0][0])
        if held:
            owner, code, n = merged()
            told = np.array(list(names), object)
            for lo in range(0, len(code), 100_000):
                hi = lo + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(told[owner[lo:hi]], pa.string()), pa.array(code[lo:hi]), pa.array(n[lo:hi])], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < size).select("lang", "rank", "gram")


def identify(docs: DataFrame, profiles: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 300) -> DataFrame:
    """(id, lang_pred, score) of every whole text by the least out-of-place distance to a profile.

    The distance adds up, over a text's `size` most frequent grams, the difference between a gram's
    rank in the text and in the profile, or `size` where the profile lacks it. score is 1 minus the
    distance as a share of its maximum, 0 to 1. Equal distances go to the first language by code
    point. A null text, or one without a letter, is `und` with score 0, as is every text where no
    profile was learned. Profiles are `size` rows for each language, so they are collected and sent
    to all tasks. Repeated rows and null ids pass through; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("row"), F.col(text_col).alias("text"))
    return _judged(rows, profiles, size, None).select(F.col("row.doc_id").alias(id_col), "lang_pred", "score")


def accepted(docs: DataFrame, profiles: DataFrame, *, text_col: str = "text", size: int = 300, least: float = 0.1) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text has a language: not `und`, and a score of at least `least`.

    Whole rows pass through the tasks that judge them, so nothing is shuffled. The rest as in identify.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return _judged(rows, profiles, size, docs.columns.index(text_col)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")


def _judged(rows: DataFrame, profiles: DataFrame, size: int, place: int | None) -> DataFrame:
    """(row, lang_pred, score) of (row, text), or of rows that hold the text as their field number `place`."""
    known: dict[str, list[tuple[int, int]]] = {}
    for lang, rank, gram in profiles.select("lang", "rank", "gram").collect():
        known.setdefault(lang, []).append((gram, rank))
    tables = [(lang, *(np.array(x) for x in zip(*sorted(known[lang]), strict=True))) for lang in sorted(known)]
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def judge(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        owner, code, has_letter = grams(texts)
        owner, rank, code = ranked(*counted(owner, code), size)
        n = np.maximum(1, np.bincount(owner, minlength=len(texts)))
        best, which = np.full(len(texts), np.inf), np.full(len(texts), -1)
        for i, (_, table, place) in enumerate(tables):
            at = np.minimum(np.searchsorted(table, code), len(table) - 1)
            apart = np.where(table[at] == code, np.abs(place[at] - rank), size)
            total = np.bincount(owner, weights=apart, minlength=len(texts))
            better = total < best
            best[better], which[better] = total[better], i
        which[~has_letter] = -1
        score = np.where(which < 0, 0.0, 1 - np.where(which < 0, 0, best) / (size * n))
        names = [*(t[0] for t in tables), UNDETERMINED]
        return [names[i] for i in which], np.clip(score, 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text") if place is None else batch.column("row").field(place)
            for at, texts in slices(column, _TEXT):
                pred, score = judge(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(texts)), pa.array(pred, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
