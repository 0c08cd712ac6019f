"""Operators against brute force, and on nulls, empty and odd rows, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import jaccard, language, mixing, quality, sharding, substrings, templates, tokens, topk, urls
from plumbline.llm.graph import components
from plumbline.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in each column, blank and long texts, ties, repeated rows, white space that is not a separator.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \t\n ", "en", None, 1), (5, "één twee\u00a0drie\x1cvier", "nl", "b", 1),
    (6, "alpha beta gamma delta epsilon zeta eta theta", None, None, 1), (6, "alpha beta gamma delta epsilon zeta eta theta", None, None, 1), (None, "alpha Beta gamma", "en", "a", 1), (7, "12 34 !!", "en", "c", 1),
    (8, "word " * 3000, "en", "a", 1), (9, "x" * 50_000, "de", "c", 1), (10, "ALPHA beta gamma delta epsilon zeta eta theta", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def clashing(odd):
    """The same rows with columns named as the operators name their own."""
    return odd.select("*", *[F.lit("clash").alias(c) for c in ("size", "shard", "rank", "node", "row", "chunk", "place", "target", "score", "_id", "id", "n")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def generated(n, seed, vocabulary=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.4:
            own = words(texts[rng.randrange(len(texts))])
            for _ in range(rng.randrange(4)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocab)
        else:
            own = [rng.choice(vocab) for _ in range(rng.randrange(0, 70))]
        texts.append(rng.choice([" ", "  ", "\n"]).join(own))
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]


def test_words_are_byte_runs():
    texts = ["a b", None, "", "  x\ty\n", "é\u00a0z w", "q" * 2_500_000 + " r"]
    w = Words(pa.array(texts))
    raw = w.raw.tobytes()
    assert [[raw[s:e].decode() for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)] for i in range(len(texts))] == [words(t) for t in texts]
    assert len(set(w.hash.tolist())) == len({x for t in texts for x in words(t)})


# ---- mixing


def test_mix_targets_and_takings(spark, odd, clashing, none):
    for docs in (odd, clashing):
        rows = mixing.mix_sources(docs).collect()
        assert len(rows) == len(ODD)
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
        total = sum(r.size for r in rows)
        targets = {r.source: r.target for r in rows}
        assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
        assert [r.size for r in rows if r.doc_id == 2] == [0]
        assert sorted(map(tuple, mixing.mix_sources(docs).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.where("doc_id in (2, 3, 4)").count() == 0


def test_mix_reshares_what_caps_leave(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", s, 1) for i, s in enumerate(["a"] * 2 + ["b"] * 50 + ["c"] * 48)], DOCS)
    got = {r.source: r.target for r in mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    # weights 3, 1, 2: a stops at 40; 1460 is left for b and c at 1 to 2; c stops at 960, b takes 500
    assert got == pytest.approx({"a": 40.0, "b": 500.0, "c": 960.0})
    taken = {r.source: r.t for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(taken[s] - got[s]) <= 32 for s in got)


def test_seats_are_the_highest_quotients(spark):
    targets = spark.createDataFrame([("a", 530.0, 1), ("b", 270.0, 2), ("c", 95.0, 3), ("d", 3.0, 4)], "source string, target double, place int")
    got = {r.source: r.seats for r in mixing.block_seats(targets, 16).collect()}
    house = int(sum((530.0, 270.0, 95.0, 3.0)) / 16 + 0.5)
    quotients = sorted(((t / (2 * k + 1), s) for s, t in (("a", 530.0), ("b", 270.0), ("c", 95.0), ("d", 3.0)) for k in range(house)), reverse=True)[:house]
    assert got == {s: sum(x == s for _, x in quotients) for s in "abcd"}


def test_quotas_of_many_shards_add_up(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 90), "en", "abc"[min(2, i % 5)], 1) for i in range(4000)], DOCS)
    for per in (16, 100, 1024):
        got = mixing.mix_sources(docs, docs_per_shard=per).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        shards = {r.source: -(-r.n // per) for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        # a source is at most a seat from its target, and a shard's last block may be short
        assert all(abs(r.taken - r.target) <= 16 + 16 * 2 * shards[r.source] for r in got)
        quotas = mixing.shard_quotas(spark.createDataFrame([(s, k, rng.randrange(1, 5000), seats, 0) for s, seats in ((1, 911), (2, 3)) for k in range(80)], "source_place int, place int, length long, source_seats long, source_size long")
                                     .withColumn("source_size", F.expr("sum(length) over (partition by source_place)")), 16, 2)
        assert {r.source_place: r.n for r in quotas.groupBy("source_place").agg(F.sum("seats").alias("n")).collect()} == {1: 911, 2: 3}


# ---- sharding


@pytest.mark.parametrize("most_rows", [200_000, 64])
def test_shards_by_bytes(spark, most_rows):
    rows = [(i, f"{'hot' if i % 3 == 0 else i % 50} " * 20, "en", "s", 1) for i in range(1200)] + ODD
    docs = spark.createDataFrame(rows, DOCS).where("n_chars is null or n_chars < 100 and coalesce(length(text), 0) < 1000")
    got = sharding.shard_by_bytes(docs, shards=8, ranges=16, sample=400, most_rows=most_rows).toPandas()
    assert len(got) == docs.count()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 0.12 * sums.mean()
    for r in docs.collect():
        crc = None if r.text is None else zlib.crc32(r.text.encode())
        own = got[(got.doc_id == r.doc_id) if r.doc_id is not None else got.doc_id.isna()]
        assert crc is None or (own.text_crc32 == crc).any()


def test_shards_of_odd_tables(odd, clashing, none):
    assert sharding.shard_by_bytes(odd).count() == sharding.shard_by_bytes(clashing).count() == len(ODD)
    assert sharding.shard_by_bytes(none).count() == 0


# ---- top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0]), (403, [float("nan")] * 5), (404, [float("inf")] * 5), (None, [1.0] * 5), (405, [0.0] * 5), (406, [-900.5] * 5), (405, [0.0] * 5), (500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = [tuple(r) for r in topk.top_k(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), row_block=64, query_block=2).collect()]
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, w in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, v in good if i != q and len(v) == len(w))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0


# ---- URLs

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def test_url_parts_and_rules(spark):
    rows = [
        (1, "https://A.Example.ORG/es/x?y#z"), (2, "http://example.org/es"), (3, None), (4, "no scheme"), (5, "x://h.com/de/1?a=1&b=2"), (6, "x://notcom/fr/"), (7, "x://org"), (8, "x://org/#"), (9, "a://b://c/d"), (10, ""),
        (11, "x://b.com\n/fr/"), (12, "https://q.net/" + "a" * 100_000), (13, "x://com/fr/1"), (13, "x://com/fr/1"), (None, "x://com/fr/2")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge_urls(df, RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[3].host, got[3].path, got[3].rule, got[4].host) == ("org/", "", "", None, "")
    assert (got[5].rule, got[5].verdict, got[6].rule, got[7].rule, got[7].path, got[8].rule) == ("com/de/", "block", None, None, "", "org/")
    assert (got[9].host, got[9].path) == ("b:", "//c/d") and got[12].verdict in ("allow", "block") and urls.judge_urls(df, RULES).count() == len(rows)
    assert urls.judge_urls(df.where("false"), RULES).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.5
        rows.append((i, f"https://h{i % 7}.net/" + ("".join(rng.choice("0123456789") for _ in range(20)) if bad else "stories/of/the/day"), float(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label double")
    host, path = urls.host_and_path(F.col("url"))
    x = urls.suffix_statistics(urls.lexical_features(df.withColumn("host", host).withColumn("path", path), "url"))
    scored = urls.probability(x, urls.train(x.where("page_id % 2 = 0"))).where("page_id % 2 = 1").toPandas()
    assert ((scored.p_block > 0.5) == (scored.label == 1)).mean() > 0.95


def test_no_label_tells_of_its_own_host(spark):
    """Flipping a host's labels leaves its own rows' features as they are, and changes those of other hosts."""
    rows = [(i, f"https://h{i % 40}.{'com' if i % 3 else 'net'}/{'ab'[i % 2]}/{i}", float(i % 5 == 0)) for i in range(400)]
    host, path = urls.host_and_path(F.col("url"))
    features = {}
    for flipped in (None, "h7.com", "h9.net"):
        df = spark.createDataFrame(rows, "page_id long, url string, label double").withColumn("host", host).withColumn("path", path)
        df = df.withColumn("label", F.when(F.col("host") == flipped, 1 - F.col("label")).otherwise(F.col("label"))) if flipped else df
        features[flipped] = {r["page_id"]: (r["host"], tuple(r[c] for c in urls.FEATURES)) for r in urls.suffix_statistics(urls.lexical_features(df, "url")).collect()}
    for flipped in ("h7.com", "h9.net"):
        same = {i for i, v in features[None].items() if features[flipped][i] == v}
        assert {i for i, v in features[None].items() if v[0] == flipped} <= same and len(same) < len(rows)


def test_trees_use_the_form_of_urls_of_unseen_hosts(spark):
    """Two kinds of urls that only their form tells apart, under rules by path prefix: the trees use several lexical features, and tell the kinds on hosts that they have not seen."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.4
        tail = "".join(rng.choice("0123456789") for _ in range(rng.randrange(8, 20))) + f"?a={i}&b=2&c=3" if bad else "/".join(rng.choice(["stories", "of", "the", "day", "news"]) for _ in range(rng.randrange(1, 5)))
        rows.append((i, f"https://h{i % 60}.{rng.choice(['com', 'net', 'org'])}/{'x' if bad else 'y'}{rng.randrange(30)}/{tail}"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [(f"{tld}/x", "block") for tld in ("com", "net")] + [(f"{tld}/y", "allow") for tld in ("com", "net")]
    report = urls.held_out_report(pages, rules)
    assert report["n"] > 100 and report["accuracy"] > report["majority"] + 0.25
    judged = urls.judge_urls(pages, rules).where("rule is null").collect()
    assert len(judged) > 200 and sum((r["verdict"] == "block") == r["path"].startswith("/x") for r in judged) > 0.95 * len(judged)
    host, path = urls.host_and_path(F.col("url"))
    labelled = urls.with_rules(pages.withColumn("host", host).withColumn("path", path), rules).withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    weights = dict(zip(urls.FEATURES, urls.train(urls.suffix_statistics(urls.lexical_features(labelled, "url"))).featureImportances, strict=True))
    assert sum(w for f, w in weights.items() if not f.endswith(("_blocked", "_share"))) > 0.5
    assert sum(weights[f] > 0 for f in urls.FEATURES[:10]) >= 2


# ---- tokens


def test_token_counts_equal_the_library(spark, odd, clashing, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "中", "1", "23", "!", "\x1c", "\x85", "\xa0", "'s", "<|endoftext|>", "\r\n", "🙂", "supercalifragilistic"]
    rows = [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(12))), "en", "s", 1) for i in range(2000)]
    for docs in (odd, clashing):
        docs = docs.select(*odd.columns).unionByName(spark.createDataFrame(rows, DOCS))
        got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, path).collect()))
        library = Tokenizer.from_file(path)
        want = sorted((i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD + rows)
        assert got == want
    assert tokens.token_counts(none, path).count() == 0


# ---- language


def test_languages_are_told_apart(spark, odd, clashing, none, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    apart = language.held_out(F.col("doc_id"))
    got = language.identify(docs, language.learn_profiles(docs.where(~apart))).join(docs.where(apart).select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    profiles = language.learn_profiles(odd)
    for d in (odd, clashing):
        found = {r.doc_id: r for r in language.identify(d, profiles).collect()}
        assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (2, 3, 4, 7)) and found[1].lang_pred == "en"
        kept = language.accepted(d, profiles)
        assert kept.columns == d.columns and kept.where("doc_id in (2, 3, 4, 7)").count() == 0
    assert language.identify(none, profiles).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.learn_profiles(none)).collect()} == {"und"}


def test_gram_profile_equals_counting():
    from collections import Counter

    texts = ["Ab ab, c", None, "", "ÉÉ é1é", "\0x"]
    owner, code, has = language.grams(texts)
    assert has.tolist() == [True, False, False, True, True]
    for i, t in enumerate(texts):
        want: Counter = Counter()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            padded = f"_{w}_"
            want.update(w)
            want.update(padded[k : k + 2] for k in range(len(padded) - 1))
            want.update(padded[k : k + 3] for k in range(len(padded) - 2))
        edge = (1 << 21) - 1
        name = lambda c: "".join("_" if x == edge else chr(x) for x in ((c >> 42) & edge, (c >> 21) & edge, c & edge) if x)
        assert Counter(name(int(c)) for c in code[owner == i]) == want


# ---- near duplicates


def brute_groups(rows, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (2, 60)])
def test_similar_groups_equal_brute_force(spark, k, percent):
    rows = generated(160, 6) + [(1000 + i, *r[1:]) for i, r in enumerate(ODD) if len(r[1] or "") < 1000]
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS), shingle=k, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_groups(rows, k, percent)


def brute_links(rows, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [words((r[1] or "").translate(lower)) for r in rows]
    sets = [{tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if len(x) >= k else {tuple(x)} if x else set() for x in w]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= percent * len(a | b)
    return sorted(((r[0], len(sets[i]), sum(linked(sets[i], s) for j, s in enumerate(sets) if j != i)) for i, r in enumerate(rows)), key=repr)


def family(n):
    """Texts of 200 words that differ in one word each, so that all link, and copies of some."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[: 3 * i + 1], f"new{i}", *base[3 * i + 2 :]]) for i in range(n)]
    return [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *texts[:3]])]


def test_all_links_equal_brute_force(spark):
    for rows, k, percent in ((family(40), 5, 80), (generated(120, 6) + [(1000 + i, *r[1:]) for i, r in enumerate(ODD) if len(r[1] or "") < 1000], 2, 60)):
        got = jaccard.similar_links(spark.createDataFrame(rows, DOCS), shingle=k, percent=percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=repr) == brute_links(rows, k, percent)
    a, b = (spark.createDataFrame([(t, x) for t in (1, 2) for x in range(60)], f"token long, {side}_node long") for side in "ab")
    pairs = [tuple(r) for r in jaccard._dealt(a, b, most=7).select("token", "a_node", "b_node").collect()]
    assert sorted(pairs) == [(t, x, y) for t in (1, 2) for x in range(60) for y in range(60)]


def test_near_misses_and_links_of_one_family(spark):
    """Texts of one origin with 1 to 9 of 200 words changed at random: some pairs link, many just do not, and components are not cliques."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(90):
        own = list(base)
        for at in rng.sample(range(200), 1 + i % 9):
            own[at] = f"new{rng.randrange(40)}"
        texts.append(" ".join(own))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    for percent in (80, 85, 90):
        got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS), shingle=4, percent=percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_groups(rows, 4, percent)


def test_a_document_without_id_links_others(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join([f"new{i}x{step}" if i < 9 * step else x for i, x in enumerate(base)]) for step in (0, 1, 2)]
    chain[2] = " ".join([*chain[1].split()[:91], *[f"other{i}" for i in range(9)]])
    rows = [(1, chain[0], "en", "s", 1), (None, chain[1], "en", "s", 1), (2, chain[2], "en", "s", 1)]
    want = brute_groups(rows, 5, 80)
    assert [c for _, _, c in want] == [1, 1, 1]
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want


def test_similar_groups_of_odd_tables(odd, clashing, none):
    want = brute_groups(ODD, 5, 80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(clashing).collect()), key=repr) == want
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0 for r in kept.collect())) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert jaccard.similar_groups(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "x long, y long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# ---- substrings


def brute_repeats(rows, k):
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone[p : p + k] = [True] * k
            seen.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "chunk_mb", "depth"), [(20, 4.0, 2), (5, 0.002, 2), (3, 0.0005, 1)])
def test_repeats_equal_brute_force(spark, k, chunk_mb, depth):
    rows = generated(120, 8, 25) + [(1000 + (i or 0), t, *r) for i, t, *r in ODD]
    got = substrings.remove_repeats(spark.createDataFrame(rows, DOCS), window=k, chunk_mb=chunk_mb, depth=depth, part_bits=6 if chunk_mb < 1 else 22)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, k)


def test_repeats_of_odd_tables(clashing, none):
    assert sorted(map(tuple, substrings.remove_repeats(clashing, window=4).collect()), key=repr) == brute_repeats(ODD, 4)
    assert substrings.remove_repeats(none).count() == 0


# ---- quality


def test_perplexity_equals_direct_kneser_ney(spark):
    trusted = ["abracadabra abra", "cadabra banana", "an abacus", "bandana cabana"]
    asked = [(1, "abra banana"), (2, "zzz"), (3, ""), (4, None), (5, "a"), (5, "a"), (None, "cab")]
    model = quality.train(spark.createDataFrame([(t,) for t in trusted] + [(None,), ("",)], "text string"))
    got = quality.perplexities(spark.createDataFrame(asked, "doc_id long, text string"), model, chunk_mb=0.00001).collect()
    grams = {5: {}}
    for t in trusted:
        padded = b"\0" * 4 + t.encode()
        for i in range(len(t)):
            grams[5][padded[i : i + 5]] = grams[5].get(padded[i : i + 5], 0) + 1
    for m in (4, 3, 2, 1):
        grams[m] = {}
        for g in grams[m + 1]:
            grams[m][g[1:]] = grams[m].get(g[1:], 0) + 1
    discounts = {m: quality._discounts(spark.createDataFrame([(n,) for n in grams[m].values()], "n long")) for m in grams}

    def p(gram):
        m = len(gram)
        if not m:
            return 1 / 256
        d = discounts[m]
        same = [n for g, n in grams[m].items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        cut = lambda n: d[min(n, 3) - 1]
        n = grams[m].get(gram, 0)
        return ((n - cut(n)) if n else 0) / sum(same) + sum(map(cut, same)) / sum(same) * p(gram[1:])

    want = []
    for i, t in asked:
        raw = (t or "").encode()
        padded = b"\0" * 4 + raw
        want.append((i, len(raw), float(np.exp(-sum(np.log(p(padded[k : k + 5])) for k in range(len(raw))) / len(raw))) if raw else None))
    for a, b in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr), strict=True):
        assert a[:2] == b[:2] and (a[2] == b[2] if b[2] is None else a[2] == pytest.approx(b[2], rel=1e-9))
    assert sum(p(b"abra" + bytes([c])) for c in range(256)) == pytest.approx(1.0)


def test_quality_keeps_clean_text(spark, odd, clashing, none, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge_quality(docs, labels).join(labels, "doc_id").toPandas()
    assert got[(got.quality == 1) & (got.toxic == 0)].keep.mean() > 0.95 and got[got.quality == 0].keep.mean() < 0.35
    for d in (odd, clashing):
        rows = {r.doc_id: r for r in quality.judge_quality(d, spark.createDataFrame([(1, 1, 0), (1, 1, None), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
        assert len(rows) == 11 and rows[2].perplexity is None and not rows[2].keep and not rows[3].keep
    assert quality.judge_quality(none, labels).count() == 0


# ---- decontamination

ITEMS = [(1, "If Maria buys 12 apples for 3 dollars each and Peter eats 4 of the apples how much did Maria pay"), (2, "short item"), (3, None), (4, ""), (5, "seven plain words make up this item here today")]
LEAKS = [
    (1, "Intro. If Maria buys 12 apples for 3 dollars each and Peter eats 4 of the apples how much did Maria pay?", {1}),
    (2, "if Joanna buys 15 apples for 7 euros each, and Ahmed eats 9 of the apples: how much did Joanna pay", {1}),  # re-parameterised
    (3, "If Joanna buys 15 apples for 7 euros each and Ahmed eats 9 of the apples how much did Ahmed pay", set()),  # Maria is two people
    (4, "if Maria buys bread and Peter eats 4 of the apples then all is well", set()), (5, None, set()), (6, "", set()), (7, "Seven plain words make up this item here today.", {5}), (None, "seven plain words make up this item here today", set()),
    (8, "SEVEN PLAIN WORDS MAKE UP THIS ITEM HERE TODAY " + "other words follow " * 500, {5}), (9, "one plain text of other words that nobody asked about in any test", set()),
]


def test_leaks_are_found(spark, none):
    docs = spark.createDataFrame([(i, t) for i, t, _ in LEAKS], "doc_id long, text string").withColumn("id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found: dict = {}
    for r in templates.find_leaks(docs, items).collect():
        found.setdefault(r.doc_id, set()).add(r.item_id)
    assert found == {i: want for i, _, want in LEAKS if want}
    judged = templates.judged(docs, templates.find_leaks(docs, items)).collect()
    assert len(judged) == len(LEAKS) and {r.doc_id for r in judged if r.contaminated} == set(found)
    assert sorted(r.doc_id or 0 for r in templates.clean(docs, items).collect()) == [0, 3, 4, 5, 6, 9]
    assert templates.find_leaks(none, items).count() == templates.find_leaks(docs, items.where("false")).count() == 0


def test_leaks_equal_literal_search(spark, small_dir):
    docs, items = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    asked = [tuple(r) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in asked if t in r.text}
    assert {(r.doc_id, r.item_id) for r in templates.find_leaks(docs, items).collect()} == want


DENSE = [
    (1, "A train goes 60 km in 2 hours and 90 km in 3 hours", "a train goes 75 km in 4 hours and 80 km in 5 hours"), (2, "Convert 5 km 300 m to 2 miles 40 yards", "convert 7 kg 200 g to 3 pounds 9 ounces"),
    (3, "What is 12 plus 7?", "what is 31 plus 8?"), (4, "12 7 5 9", None), (5, "prime 12", None), (6, "from 3 km 5 m 7 km 9 m 11 km 2 m 8 km 4 m to 6 km", "from 4 km 6 m 8 km 1 m 12 km 3 m 9 km 5 m to 7 km"),
]


def test_leaks_of_items_full_of_slots(spark):
    items = spark.createDataFrame([x[:2] for x in DENSE], "item_id long, text string")
    docs = [(i, f"so then they asked {t} and more words") for i, t, _ in DENSE] + [(10 + i, f"so then they asked {r} and more words") for i, _, r in DENSE if r]
    docs += [(20, "a table 1 2 3 4 5 6 7 8 km 9 10 11 12"), (21, "convert 5 km 300 m into 2 miles 40 yards"), (22, "prime 13 and what is 12")]
    got = {(r.doc_id, r.item_id): r.reworded for r in templates.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(i, i): False for i, *_ in DENSE} | {(10 + i, i): True for i, _, r in DENSE if r}


def test_one_altered_slot_costs_its_windows_only(spark):
    item = "we know that Maria counts all of the boats near 12 old harbours while the others sleep and that by noon Maria has seen more than 12 of them and 3 of those were painted red"
    docs = [
        (1, item.replace("Maria has", "Peter has")), (2, item.replace("than 12", "than 13")), (3, item.replace("12", "5").replace("3 of", "5 of")),  # 12 and 3 both become 5
        (4, item.replace("Maria", "Joanna").replace("than 12", "than 13")), (5, "we know that Maria counts sheep")]
    found = templates.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: (r.matched, r.windows, r.reworded) for r in found.collect()}
    n = len(item.split()) - 7
    # of the n windows, 8 hold the altered name or number
    assert got == {1: (n - 8, n, True), 2: (n - 8, n, True), 3: (n, n, True), 4: (n - 8, n, True)}
