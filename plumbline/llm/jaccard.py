"""N-gram Jaccard join by prefixes under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, slices, small
from .graph import components
from .words import Words, mix

_CELL_BITS, _SLICE_BITS = 24, 18
#: Bytes of text that a task has in words at a time.
_TEXT = 1_000_000
#: Members of a bucket that all others are paired with in a round.
_PIVOTS = 4


def token_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (64-bit hashes, ascending) of each text, and where each text's begin.

    A text with fewer words has its whole sequence as its only shingle, one without words has none.
    """
    first, h = words.windows(k)
    owner = words.doc[first]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        alone = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            part = words.hash[words.first[d] : words.first[d + 1]]
            factors = mix(np.arange(1, len(part) + 1, dtype=np.uint64) + np.uint64(1000 * len(part))) | np.uint64(1)
            alone[i] = mix((part * factors).sum(keepdims=True))[0]
        owner, h = np.concatenate([owner, short]), np.concatenate([h, alone])
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    cuts = np.searchsorted(owner, np.arange(len(words.count) + 1))
    parts = [np.unique(h[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _ranks(tokens: np.ndarray, heaviness: np.ndarray, order: int) -> np.ndarray:
    """Places of tokens in a global order: light tokens before heavy ones, then by a hash of that order."""
    return (heaviness.astype(np.uint64) << np.uint64(56)) | (mix(tokens ^ np.uint64(0x5851F42D4C957F2D * order % (1 << 64))) >> np.uint64(8))


def prefixes(ranks: np.ndarray, at: np.ndarray, percent: int, share: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(percent n / 100) + m places of each set, ascending, and where each set's begin.

    Two sets that link share at least the smaller m of such tokens: m is 1, or ceil(n / share).
    """
    out, size = [], []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = hi - lo
        m = 1 if share is None else -(-n // share)
        p = min(n, n - -(-percent * n // 100) + m) if n else 0
        own = ranks[lo:hi]
        out.append(np.sort(np.partition(own, p - 1)[:p] if 0 < p < n else own))
        size.append(p)
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def token_weights(docs: DataFrame, text: str, k: int) -> Broadcast:
    """Heaviness class (0: as common as most) of each cell of a fixed table of shingle counts over all texts.

    Tasks count into 2**24 cells (up to 65,535) and send slices, compressed; these are added up in
    two steps, so a group has the slices of one task in 64 (512 KB each at most). 16 MB in all, whatever the input.
    The classes only order the tokens, so collisions cost time and not results: with more shingles
    than cells, tokens less common than about twice the mean of a cell are not told apart.
    """
    cells, per = 1 << _CELL_BITS, 1 << _SLICE_BITS
    form = pa.schema([("slice", pa.int32()), ("salt", pa.int32()), ("n", pa.binary())])
    schema = "slice int, salt int, n binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(cells, np.uint16), 0
        for batch in batches:
            for _, texts in slices(batch.column("text"), _TEXT):
                cell, n = np.unique((Words(texts, lower=True).windows(k)[1] >> np.uint64(64 - _CELL_BITS)).astype(np.int64), return_counts=True)
                total[cell] = np.minimum(total[cell] + n, 65535)
                rows += len(cell)
        if rows:
            zstd = pa.Codec("zstd")
            for i in range(cells // per):
                yield pa.RecordBatch.from_pylist([{"slice": i, "salt": rows % 64, "n": zstd.compress(total[i * per : (i + 1) * per].tobytes(), asbytes=True)}], schema=form)

    def unpack(packed: bytes) -> np.ndarray:
        return np.frombuffer(pa.Codec("zstd").decompress(packed, per * 2, asbytes=True), np.uint16)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for x in rows.column("n"):
            total += unpack(x.as_py())
        packed = pa.Codec("zstd").compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), asbytes=True)
        return pa.Table.from_pylist([{"slice": rows.column("slice")[0].as_py(), "salt": 0, "n": packed}], schema=form)

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, schema)
    added = counted.groupBy("slice", "salt").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    total = np.zeros(cells, np.uint16)
    for row in added.collect():
        total[row["slice"] * per : (row["slice"] + 1) * per] = unpack(bytes(row["n"]))
    over = np.maximum(0, total.astype(np.int32) - 2 * int(total.mean()) - 2)
    classes = np.ceil(np.log2(np.arange(65537) + 1)).astype(np.uint8)[over]
    return docs.sparkSession.sparkContext.broadcast(classes)


def _buckets(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text); described (doc_id, n, node, second, third); members (token, node, n, pos) of the buckets of prefix tokens, those with the same members once.

    Prefix tokens stand as their places in the first order, so a token's number tells which comes
    first; `pos` is the token's index in its set's prefix. Equal sets enter once. Tokens that one
    class only has are dropped by an exact count, whatever the size of the input, and so are those
    that come too late in every class that has them: the smaller set of a pair must have the first
    shared token among its first n - ceil(2 percent n / (100 + percent)) + 1.
    """
    weights = token_weights(docs, text_col, shingle)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch.column("text"), _TEXT):
                tokens, at = token_sets(Words(texts, lower=True), shingle)
                heavy = weights.value[(tokens >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
                chosen, begin = prefixes(_ranks(tokens, heavy, 1), at, percent)
                more = [_signature(*prefixes(_ranks(tokens, heavy, order), at, percent, _SHARE)) for order in (2, 3)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, len(texts)), pa.array(np.diff(at)), pa.array(_sums(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)), at).view(np.int64)),
                    _lists(chosen.view(np.int64), begin), *more], names=["doc_id", "n", "node", "prefix", "second", "third"])

    described = saved(rows.mapInArrow(describe, "doc_id long, n long, node long, prefix array<long>, second binary, third binary"), "jaccard-sets")
    weights.unpersist()
    classes = described.where("n > 0").select("node", F.col("n").cast("int").alias("n"), "prefix").dropDuplicates(["node"])
    index = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    early = (F.col("n") - F.col("pos")).cast("long") * (100 + percent) >= F.col("n").cast("long") * (2 * percent)
    shared = index.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.max(early.cast("int")).alias("early")).where("m > 1 and early = 1").select("token")
    full = saved(index.join(shared, "token", "left_semi").select("token", "node", "n", "pos"), "jaccard-shared")
    alike = full.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    alike = alike.groupBy("m", "members", "lo", "hi").agg(F.min("token").alias("token"))
    live = saved(full.join(alike.select("token"), "token", "left_semi"), "jaccard-buckets")
    discard(full)
    return rows, described.drop("prefix"), live


def _close(percent: int) -> Column:
    """May two members a and b of a bucket link? What follows the bucket's token in both prefixes must suffice for the common part that a link needs.

    Right for the first token that two sets share, which they meet in before any other.
    """
    least = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    return least.cast("long") * (100 + percent) >= (F.col("a_n") + F.col("b_n")).cast("long") * percent


def _side(members: DataFrame, name: str, *more: str) -> DataFrame:
    return members.select("token", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "n", "pos", *more)])


def _pivots(members: DataFrame, seed: int) -> DataFrame:
    """Some members of each bucket, at most _PIVOTS, that are likely to link with the others and few over all buckets.

    Half of them have the bucket's token earliest in their prefix (under as many hashes), so they
    have the least that is rarer than what the bucket shares: in a family of near copies those
    closest to its origin. The others are the least under a hash, which are the same in buckets that overlap.
    """
    def key(k: int) -> Column:
        h = F.xxhash64("node", F.lit(seed + k))
        return F.shiftleft(F.col("pos").cast("long"), 40) + F.shiftrightunsigned(h, 24) if k < _PIVOTS // 2 else h

    least = members.groupBy("token").agg(*[F.min(key(k)).alias(f"_h{k}") for k in range(_PIVOTS)])
    chosen = F.lit(False)
    for k in range(_PIVOTS):
        chosen = chosen | (key(k) == F.col(f"_h{k}"))
    return members.join(least, "token").where(chosen).select(*members.columns)


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a_node", "b_node").alias("x"), F.greatest("a_node", "b_node").alias("y")).distinct()


def _spread(asking: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs of a bucket's `asking` (a_) and `asked` (b_) members, both with the number of `parts` of their bucket: the asked ones are cut in parts, each of which the asking ones visit, so no bucket is one task."""
    b = asked.withColumn("part", F.pmod(F.xxhash64("b_node"), F.col("parts")).cast("int")).drop("parts")
    a = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return a.join(b, ["token", "part"])


def _dealt(asking: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """The same with parts of about `most` members, which are counted first."""
    parts = asked.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    return _spread(asking.join(parts, "token"), asked.join(parts, "token"))


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rounds: int = 3,
) -> DataFrame:
    """Links documents whose sets of word shingles have a Jaccard similarity of percent / 100 or more.

    Words are lower-cased (A-Z). Documents with equal sets form one class first. A class enters the
    buckets of its prefix tokens under the first global order, in which tokens that are common in
    the corpus come last; buckets with the same members count once. Only connectivity is needed,
    so a bucket is not expanded into all its pairs: first its members are paired with four of them,
    and after the links found were joined into components, the members outside a bucket's largest
    component are paired with four of it (up to `rounds` - 2 times, while very many pairs are left), and last with
    every member of another component. The place of the shared token in both prefixes bounds what
    can follow, which ends most pairs before they are made. Pairs must also share prefix tokens
    under a second and a third order; what remains is verified on the whole sets, so every link
    between different components is found and no false one is. For all
    links, those inside a component too, see `similar_links`.

    Returns (id, n_shingles, component_id): component_id is the smallest id reachable by
    links, itself included. Null or blank texts have no
    shingles, link with nothing and are their own component. Rows with a null id or a repeated id
    are documents of their own; a component with null ids only has a null component_id. An empty
    table gives an empty result. Other columns are not read. Sets are identified by 64-bit hashes.
    """
    rows, described, live = _buckets(docs, id_col, text_col, shingle, percent)
    pairs = _unordered(_side(live, "a").join(_side(_pivots(live, 0), "b"), "token").where(_close(percent) & (F.col("a_node") != F.col("b_node"))))
    tried = joined = None
    for turn in range(rounds):
        pairs = saved(pairs, "jaccard-pairs")
        found = _verified(rows, pairs, described, shingle, percent)
        joined = components(found if joined is None else found.unionByName(joined.select(F.col("node").alias("x"), F.col("component").alias("y"))))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if turn == rounds - 1:
            break
        inside = live.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = inside.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
        inside = saved(inside.join(split, "token", "left_semi"), "jaccard-open")
        sizes = inside.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
        most = saved(sizes.groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("top"), F.sum("m").alias("m")), "jaccard-main")
        due, left = most.agg(F.sum((F.col("m") - F.col("top")) * F.col("m")), F.sum("m")).first()
        if not left:
            break
        inside = inside.join(most.select("token", "main", F.ceil(F.col("m") / 4096).cast("int").alias("parts")), "token")
        rest, main = inside.where("component <> main"), inside.where("component = main")
        if turn < rounds - 2 and due > 1000 * left + 10_000_000:
            pairs = _side(rest, "a").join(_side(_pivots(main.select("token", "node", "n", "pos"), 100 * (turn + 1)), "b"), "token").where(_close(percent))
        else:
            rounds = turn + 2
            both = _spread(_side(rest, "a", "component", "parts").withColumnRenamed("a_parts", "parts"), _side(inside, "b", "component", "main", "parts").withColumnRenamed("b_parts", "parts"))
            once = (F.col("b_component") == F.col("b_main")) | (F.col("a_node") < F.col("b_node"))
            pairs = both.where(_close(percent) & (F.col("a_component") != F.col("b_component")) & once)
        pairs = _unordered(pairs).join(tried, ["x", "y"], "left_anti")

    per_class = described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = per_class.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = saved(labelled.select("node", "component", "least"), "jaccard-classes")
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(names, "component").select("node", "component_id")
    some = described.where("n > 0").select("doc_id", "n", "node").join(labelled, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumnRenamed("doc_id", id_col)


def similar_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, n_links): how many other documents each document links with, equal copies included.

    As `similar_groups`, but every pair of a bucket that may link is verified, those inside a
    component too: the number of pairs grows with the square of a family of near copies, as its links do.
    """
    rows, described, live = _buckets(docs, id_col, text_col, shingle, percent)
    pairs = _unordered(_dealt(_side(live, "a"), _side(live, "b"), 512).where(_close(percent) & (F.col("a_node") < F.col("b_node"))))
    links = _verified(rows, saved(pairs, "jaccard-pairs"), described, shingle, percent)
    copies = saved(described.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies")), "jaccard-copies")
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    degree = both.join(copies.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.sum("copies").alias("degree"))
    per_class = copies.join(degree, "node", "left").select("node", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    some = described.where("n > 0").select("doc_id", "n", "node").join(per_class, "node").select("doc_id", F.col("n").alias("n_shingles"), "n_links")
    none = described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none).withColumnRenamed("doc_id", id_col)


#: A share of 8: linked sets have an eighth of the smaller set's tokens in common among the first tokens of the second and the third order.
_SHARE = 8


def _signature(chosen: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Each set's tokens as 16-bit numbers, in order; tokens that fall together stay, so that a match can be counted too often and never too rarely."""
    short = (mix(chosen) >> np.uint64(48)).astype(np.uint16)
    return pa.array([np.sort(short[lo:hi]).tobytes() for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())


def _matches(a: bytes, b: bytes) -> int:
    """Size of the multiset intersection, with the larger count where numbers repeat: at least the number of common tokens."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    return max(int(np.isin(x, y).sum()), int(np.isin(y, x).sum()))


def _whole_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, n, tokens) of the wanted classes (node, doc_id): whole sets, ascending. A repeated id may give a class twice.

    Texts are picked by the class's id; a class of null ids only has none and is picked by node.
    """
    picked = rows.join(small(wanted.select("doc_id")), "doc_id", "left_semi").select("text")
    unnamed = rows.where("doc_id is null").select("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column("text"), _TEXT):
                tokens, at = token_sets(Words(texts, lower=True), shingle)
                node = _sums(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)), at).view(np.int64)
                raw = [tokens[lo:hi].tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.diff(at)), pa.array(raw, pa.binary())], names=["node", "n", "tokens"])

    form = "node long, n long, tokens binary"
    unnamed = unnamed.mapInArrow(whole, form).where("n > 0").join(wanted.where("doc_id is null").select("node"), "node", "left_semi")
    unnamed = unnamed.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("tokens").alias("tokens"))
    return picked.mapInArrow(whole, form).where("n > 0").unionByName(unnamed)


def _verified(rows: DataFrame, pairs: DataFrame, described: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (x, y) that link: with enough common tokens among the first of the second and of the third order, then by exact intersection.

    Whole sets are made, and moved, only for classes in pairs that pass the filters.
    """
    inside = saved(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "jaccard-inside")
    known = described.where("n > 0").join(small(inside), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("second").alias("second"), F.any_value("third").alias("third"))
    known = saved(known, "jaccard-first")

    def side(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    some = pairs.join(side(known, "x", "n", "second", "third"), "x").join(side(known, "y", "n", "second", "third"), "y")

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k) for k in batch.schema.names}
            keep = []
            for i in range(batch.num_rows):
                least = -(-min(c["x_n"][i].as_py(), c["y_n"][i].as_py()) // _SHARE)
                keep.append(all(_matches(c[f"x_{k}"][i].as_py(), c[f"y_{k}"][i].as_py()) >= least for k in ("second", "third")))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    likely = saved(some.mapInArrow(may, "x long, y long"), "jaccard-likely")
    wanted = known.select("node", "doc_id").join(likely.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "node", "left_semi")
    sets = saved(_whole_sets(rows, wanted, shingle), "jaccard-whole")
    whole = likely.join(side(sets, "x", "tokens"), "x").join(side(sets, "y", "tokens"), "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("x_tokens"), batch.column("y_tokens"), strict=True):
                x, y = (np.frombuffer(t.as_py(), np.uint64) for t in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    found = saved(whole.mapInArrow(verify, "x long, y long").distinct(), "jaccard-links")
    for done in (sets, known, likely, inside):
        discard(done)
    return found


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, all columns as they are, without near duplicates: the smallest id of each component stays.

    Rows that repeat an id are one document, of which any one row stays; rows with a null id stay.
    """
    groups = saved(similar_groups(docs, id_col=id_col, **options), "jaccard-groups").select(F.col(id_col).alias("_id"), "component_id")
    groups = groups.where("_id is not null").groupBy("_id").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("n"))
    gone, repeated = groups.where("least <> _id").select("_id"), groups.where("n > 1").select("_id")
    kept = docs.join(small(gone), docs[id_col] == gone["_id"], "left_anti")
    if repeated.limit(1).count():
        some = small(repeated)
        apart = kept.join(some, kept[id_col] == some["_id"], "left_semi").dropDuplicates([id_col])
        kept = kept.join(some, kept[id_col] == some["_id"], "left_anti").unionByName(apart)
    return kept
