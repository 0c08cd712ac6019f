"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class BytePairCounter:
    """Counts the tokens of texts. `merges` maps a pair of symbols to its rank and what it becomes."""

    def __init__(self, path: str, remembered: int = 700_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.first = [ids[s] for s in _byte_symbols()]
        self.merges: dict[int, int] = {}  # a pair of ids, each below 2**17: rank and merged id
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 17 | ids[b]] = (rank + 1) << 17 | ids[a + b]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.apart = regex.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
        self.paired = re.compile(r"\s\s")  # white space in its widest sense
        self.known: dict[str, int] = {}  # of pieces that follow a single space
        self.words: dict[str, int] = {}  # of pre-tokens
        self.remembered = remembered

    def merged(self, data: bytes) -> int:
        """Tokens of one pre-token: symbols at first, less one for each merge of the lowest rank, leftmost first."""
        count = n = len(data)
        if n < 2:
            return n
        get, first = self.merges.get, self.first
        symbol = [first[b] for b in data]
        heap = []  # rank and place of a pair, in one number
        a = symbol[0]
        for i in range(1, n):
            b = symbol[i]
            if found := get(a << 17 | b):
                heap.append(found >> 17 << 32 | i - 1)
            a = b
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or not (found := get(symbol[i] << 17 | symbol[j])) or found >> 17 != top >> 32:
                continue  # one of the two was merged meanwhile
            symbol[i] = new = found & 0x1FFFF
            symbol[j] = -1
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := get(new << 17 | symbol[k]):
                    push(heap, found >> 17 << 32 | i)
            h = before[i]
            if h >= 0 and (found := get(symbol[h] << 17 | new)):
                push(heap, found >> 17 << 32 | h)
        return count

    def piece(self, text: str) -> int:
        total, words = 0, self.words
        for x in self.pattern.findall(text):
            n = words.get(x)
            if n is None:
                n = self.merged(x.encode("utf-8", "surrogatepass"))
                if len(x) <= 64:
                    if len(words) >= self.remembered:
                        words.clear()
                    words[x] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """A single space between two other characters always starts a pre-token: pieces between such spaces count alone and are remembered."""
        if not text:
            return 0
        odd = text[0].isspace() or text[-1].isspace() or self.paired.search(text)
        parts = self.apart.split(text) if odd else text.split(" ")
        known, total = self.known, self.piece(parts[0])
        try:
            return total + sum(map(known.__getitem__, parts[1:]))
        except KeyError:
            pass
        for part in parts[1:]:
            n = known.get(part)
            if n is None:
                n = self.piece(" " + part)
                if len(part) <= 64:
                    if len(known) >= self.remembered:
                        known.clear()
                    known[part] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> BytePairCounter:
    """One counter in each Python worker."""
    return BytePairCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: (id, n_bytes, n_tokens), in one pass and without a shuffle.

    `vocabulary` is the path of a byte-level BPE file (.json), the same on every executor. A special
    string inside a text is one token, as in the library's default. Null and empty texts have 0
    bytes and 0 tokens; a text of any length is counted whole; repeated rows and null ids pass
    through; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    schema = rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary)
        for batch in batches:
            counts = np.fromiter((of.count(x.as_py()) for x in batch.column("text")), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
