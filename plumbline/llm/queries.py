"""The registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, language, mixing, pages, phrases, quality, sharding, substrings, templates, tokens, topk, trie, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), k=10, scale=1024)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


#: The rules that op3 judges by.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.similar_groups(table(spark, sf_dir, "documents"), shingle=4, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = tokens.token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"))
    profiles = language.learn_profiles(docs.where(~apart))
    return language.identify(docs, profiles).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return templates.judged(docs, templates.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def op11_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, most_words=5, share=100, top=2000)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, convs = trie.conversation_trie(table(spark, sf_dir, "conversations"))
    nodes = tree.nodes.join(trie.ends_hashes(tree.paths, convs), "node", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.select(*columns, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


QUERIES: dict[str, Query] = {
    "op1_bit_sliced_top_k": op1_bit_sliced_top_k,
    "op2_source_mix": op2_source_mix,
    "op3_url_filter": op3_url_filter,
    "op4_kneser_ney_quality": op4_kneser_ney_quality,
    "op5_byte_shards": op5_byte_shards,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_template_decontamination": op10_template_decontamination,
    "op11_page_differencing": op11_page_differencing,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_bit_sliced_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
            WHERE a.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op2_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place_in
            FROM documents),
        t AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
                   row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
            FROM d GROUP BY source),
        w AS (SELECT *, [3, 1, 2][CAST((place - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 2 AS most FROM t),
        l AS (
            SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
                   coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                   sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
            FROM w),
        f AS (SELECT *, (budget - CAST(capped AS DOUBLE)) / CAST(open AS DOUBLE) AS level FROM l),
        c AS (
            SELECT *, first_value(CASE WHEN weight * level <= most THEN level END IGNORE NULLS)
                      OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common
            FROM f),
        g AS (SELECT *, least(CAST(most AS DOUBLE), coalesce(weight * common, CAST(most AS DOUBLE))) AS target FROM c),
        b AS (
            SELECT *, CAST(floor(target / 16 + 0.5::DOUBLE) AS BIGINT) AS base,
                   CAST(floor(sum(target) OVER () / 16 + 0.5::DOUBLE) - sum(floor(target / 16 + 0.5::DOUBLE)) OVER () AS BIGINT) AS due
            FROM g),
        q AS (
            SELECT place, due, CASE WHEN due > 0 THEN base + j ELSE base - 1 - j END AS seat, target, j
            FROM b, LATERAL (SELECT unnest(range(abs(due))) AS j)),
        k AS (
            SELECT place, sign(due) AS step,
                   row_number() OVER (ORDER BY CASE WHEN due > 0 THEN -target / (seat * 2 + 1) ELSE target / (seat * 2 + 1) END, place, j) AS r, abs(due) AS n
            FROM q WHERE seat >= 0),
        m AS (SELECT place, CAST(sum(step) AS BIGINT) AS moved FROM k WHERE r <= n GROUP BY place),
        p AS (
            SELECT b.*, base + coalesce(moved, 0) AS seats, least(CAST(ceil(n_docs / 1024) AS BIGINT), 65536) AS n_shards
            FROM b LEFT JOIN m USING (place)),
        x AS (
            SELECT d.doc_id, d.size, p.source_size, p.target, p.seats, p.place, d.place_in,
                   CAST(('0x' || substr(place_in, 1, 8)) AS BIGINT) % n_shards AS shard
            FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
        h AS (
            SELECT *, greatest(CAST(ceil(length / 16) AS BIGINT), 1) AS blocks
            FROM (SELECT place, shard, sum(size) AS length, any_value(seats) AS seats, any_value(source_size) AS source_size FROM x GROUP BY place, shard)),
        y AS (
            SELECT *, CAST(seats - sum(base) OVER (PARTITION BY place) AS BIGINT) AS due
            FROM (SELECT *, least(CAST(floor(CAST(seats * length AS DOUBLE) / greatest(source_size, 1) + 0.5::DOUBLE) AS BIGINT), blocks * 2) AS base FROM h)),
        z AS (
            SELECT place, shard, due, length, blocks, j, CASE WHEN due > 0 THEN base + j ELSE base - 1 - j END AS seat
            FROM y, LATERAL (SELECT unnest(range(least(abs(due), 3))) AS j)),
        u AS (
            SELECT place, shard, sign(due) AS step, abs(due) AS n,
                   row_number() OVER (PARTITION BY place ORDER BY CASE WHEN due > 0 THEN -(length / (seat * 2 + 1)) ELSE length / (seat * 2 + 1) END, shard, j) AS r
            FROM z WHERE seat >= 0 AND (due < 0 OR seat < blocks * 2)),
        v AS (SELECT place, shard, CAST(sum(step) AS BIGINT) AS moved FROM u WHERE r <= n GROUP BY place, shard),
        s AS (
            SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY place_in, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
            FROM x),
        o AS (
            SELECT s.*, y.blocks, y.base + coalesce(v.moved, 0) AS quota
            FROM s JOIN y ON y.place = s.place AND y.shard = s.shard LEFT JOIN v ON v.place = s.place AND v.shard = s.shard)
        SELECT doc_id, size, source_size, target,
               CAST(quota // blocks * size + greatest(0, least(stop, quota % blocks * 16) - (stop - size)) AS BIGINT) AS taken
        FROM o
    """,
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS o FROM p),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE o > 1),
        t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
        k AS (
            SELECT t.doc_id, count(c.j) AS n_removed, coalesce(string_agg(CASE WHEN c.j IS NULL THEN word END, ' ' ORDER BY t.j), '') AS kept
            FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.j = c.j GROUP BY t.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
            FROM d),
        x AS (SELECT doc_id, unnest(g) AS t FROM s),
        n AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (
            SELECT a, b FROM n JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
            WHERE 100 * k >= 85 * (len(p.g) + len(q.g) - k)),
        r AS (SELECT doc_id AS v, doc_id AS u FROM s UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
        c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.v = doc_id
    """,
    "op12_phrase_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        s AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS m FROM w),
        p AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM s),
        g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM p GROUP BY ALL),
        f AS (SELECT * FROM g WHERE a >= 100),
        n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
        k AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        c AS (
            SELECT k.lang, k.phrase, k.m, k.a, k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a) AS score
            FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[:k], ' ')
            JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN n ON n.lang = k.lang),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM c),
        x AS (
            SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f t ON t.lang = s.lang AND t.a = s.a AND t.m > s.m
            WHERE contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
        o AS (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
            FROM b ANTI JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE o = 1)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
    """,
    "op13_conversation_trie": r"""
        WITH t AS (
            SELECT conv_id, [coalesce(role, ''), coalesce(text, '')] AS token, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS at
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, (list_reduce(
                list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)),
                lambda crc, byte: list_reduce(range(1, 9), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
                4294967295) & 3) AS low
            FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
        h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, 3 - low AS h FROM c),
        r AS (
            SELECT h.conv_id, 0 AS side, t.at, t.token FROM h JOIN t ON t.conv_id = h.base AND t.at < h.h
            UNION ALL
            SELECT h.conv_id, 1, t.at, t.token FROM h JOIN t USING (conv_id) WHERE t.at >= h.h),
        p AS (SELECT h.conv_id, coalesce(list(r.token ORDER BY side, r.at) FILTER (WHERE r.token IS NOT NULL), []) AS path FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id),
        m AS (SELECT conv_id, path AS whole, unnest(range(0, len(path) + 1)) AS depth FROM p),
        n AS (
            SELECT whole[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(whole) = depth), '') AS ends
            FROM m GROUP BY ALL),
        k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        v AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
                   CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.path[depth][2], '[^\x20\x09-\x0D]+')) END AS own
            FROM n LEFT JOIN k ON n.path = k.path),
        s AS (SELECT path[1:d] AS path, sum(leaf) AS n_leaves, sum(own) AS saved FROM (SELECT path, leaf, own, unnest(range(0, depth + 1)) AS d FROM v) GROUP BY 1)
        SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
        FROM v JOIN s ON s.path = v.path LEFT JOIN n u ON v.depth > 0 AND u.path = v.path[1:v.depth - 1]
    """,
}
