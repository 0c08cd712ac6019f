"""Whole operators and the pipeline against the plain versions in brute.py, on small inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, mixing, sharding, templates, urls
from plumbline.llm.common import saved

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    odd = spark.createDataFrame([(9001, None, "en", None, 0), (9002, "", None, "src0", 0), (9003, " \t\n ", "en", None, 1), (9004, "12 !!", "en", "zz", 1), (None, "a text without an id here", "en", "src0", 1), (9005, "one", None, "src1", 3)], DOCS)
    return spark.read.parquet(f"{small_dir}/documents.parquet").select(*odd.columns).unionByName(odd)


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


def test_languages_equal_plain_distances(docs, rows):
    apart = {r.doc_id for r in docs.where(language.held_out(F.col("doc_id"))).select("doc_id").collect()}
    got = language.identify(docs, language.learn_profiles(docs.where(~language.held_out(F.col("doc_id"))))).collect()
    known = brute.profiles([(t, lang) for i, t, lang, *_ in rows if i not in apart])
    want = {i: brute.language(t, known) for i, t, *_ in rows}
    assert len(got) == len(rows) and {r.doc_id: r.lang_pred for r in got} == {i: w[0] for i, w in want.items()}
    assert all(r.score == pytest.approx(want[r.doc_id][1], abs=1e-12) for r in got)


@pytest.mark.parametrize("per_shard", [1024, 7])
def test_mix_equals_plain_apportionment(docs, rows, per_shard):
    got = sorted((tuple(r) for r in mixing.mix_sources(docs, docs_per_shard=per_shard).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    want = sorted(brute.mix([(i, t, s) for i, t, _, s, _ in rows], per_shard=per_shard), key=repr)
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_shards_equal_plain_positions(docs, rows):
    got = sharding.shard_by_bytes(docs).collect()
    want = brute.shards([r[:2] for r in rows])
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def _problems(seed):
    rng = random.Random(seed)
    names, nouns = ["Maria", "Peter", "Joanna", "Ahmed", "Élodie"], ["apples", "boats", "km", "hours", "books", "pears", "kg"]
    plain = "the a of buys sees and then walks for each with was many how on to left gives takes".split()

    def sentence(n):
        out = []
        for _ in range(n):
            k = rng.random()
            out.append(rng.choice(plain) if k < 0.6 else rng.choice(names) if k < 0.72 else str(rng.randrange(30)) if k < 0.86 else rng.choice(nouns))
        return out

    items = [(i, " ".join(sentence(rng.choice([2, 3, 5, 9, 16, 25])))) for i in range(25)] + [(98, None), (99, " ")]
    docs = []
    for i in range(60):
        own = sentence(rng.randrange(0, 30))
        item = (items[rng.randrange(25)][1]).split()
        swap = {w: rng.choice(names if w in names else nouns if w in nouns else [str(rng.randrange(30))]) for w in item}
        kind = rng.random()
        put = [swap[w] if (w in names or w.isdigit()) and (kind < 0.5 or rng.random() < 0.3) else w for w in item] if kind < 0.8 else item[: len(item) // 2]
        at = rng.randrange(len(own) + 1)
        docs.append((i, rng.choice([" ", "  ", ". ", "\n"]).join([*own[:at], *put, *own[at:]])))
    return [*docs, (70, None), (71, ""), (None, items[0][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_plain_alignment(spark, seed):
    docs, items = _problems(seed)
    got = templates.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.leaks(docs, items, set(templates.UNITS))
    assert {(r.doc_id, r.item_id): (r.matched, r.windows, r.reworded) for r in got} == want and len(want) > 10


def test_urls_follow_rules_and_held_out_labels(spark, small_dir):
    from plumbline.llm.queries import URL_RULES

    pages = spark.read.parquet(f"{small_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    got = urls.judge_urls(pages, URL_RULES).collect()
    texts = {r.page_id: r.url for r in pages.collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        end = min([rest.find(c, cut) for c in "?#" if c in rest[cut:]] or [len(rest)])
        return rest[:cut].translate(lower), rest[cut:end]

    for r in got:
        host, path = parts(texts[r.page_id])
        fits = [(rule, says) for rule, says in URL_RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[len(rule.split("/")[0]) :])]
        rule, says = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (says or ("block" if r.p_block > 0.5 else "allow"))
    report = urls.held_out_report(pages, URL_RULES)
    assert report["n"] > 20 and report["accuracy"] >= report["majority"]


def test_pipeline_equals_plain_stages(spark, docs, rows, small_dir):
    import corpus_pipeline as c

    benchmark = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    named = docs.where("doc_id is not null")
    kept = named
    plain = {r[0]: r for r in rows if r[0] is not None}
    known = brute.profiles([(t, lang) for _, t, lang, *_ in plain.values()])
    scored = {i: brute.language(r[1], known) for i, r in plain.items()}
    plain = {i: r for i, r in plain.items() if scored[i][0] != "und" and scored[i][1] >= 0.1}
    after = [plain]
    first = brute.first_of_groups([(i, r[1]) for i, r in plain.items()])
    after.append({i: r for i, r in plain.items() if i in first})
    leaks = {d for d, _ in brute.leaks([(i, r[1]) for i, r in after[-1].items()], benchmark, set(templates.UNITS))}
    after.append({i: r for i, r in after[-1].items() if i not in leaks})
    for (_, stage), want in zip(c.STAGES[:3], after, strict=False):
        kept = saved(stage(spark, kept, small_dir), "test-stage")
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want)
    mixed = saved(c.STAGES[3][1](spark, kept, small_dir), "test-stage")
    copies = {i: int(taken / size + 0.5) for i, size, _, _, taken in brute.mix([(i, r[1], r[3]) for i, r in after[-1].items()]) if size}
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {i: n for i, n in copies.items() if n}
    dealt = c.STAGES[4][1](spark, mixed, small_dir).collect()
    want = brute.shards([(i, after[-1][i][1]) for i, n in copies.items() for _ in range(n)])
    assert sorted((tuple(r) for r in dealt), key=repr) == sorted(want, key=repr)
