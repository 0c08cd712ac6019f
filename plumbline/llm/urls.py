"""URL filter: path rules, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

#: Columns that lexical_features adds and the trees read.
FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "entropy", "params", "longest_segment", "symbols", "suffix_share", "suffix_blocked", "section_blocked", "extension_share"]

#: Folds of hosts for the label statistics.
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end. Both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds `rule` and `rule_verdict`: the longest rule whose host is the url's or a parent of it, and whose path begins the url's.

    `rules` are (rule, verdict) with rule = host + path, the path from the first `/`; equally long
    rules go by the longer host and then by text. They are a short list that is written into the plan.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    def key(r: tuple[str, str]) -> tuple:
        return len(r[0]), len(r[0].split("/")[0]), r[0]
    for rule, says in sorted(dict(rules).items(), key=key):  # the last that fits is the longest
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return pages.withColumn("rule", found).withColumn("rule_verdict", verdict)


def _entropy(text: Column) -> Column:
    """Bits per character of the text's own characters."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", F.lit(0.0)).otherwise(share(c) * F.log2(F.greatest(share(c), F.lit(1e-12)))))


def lexical_features(pages: DataFrame, url: str) -> DataFrame:
    """Adds the lexical FEATURES of (url, host, path), and `suffix` and `extension` for the statistics."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    parts = F.split(path, "/")
    return pages.select(
        "*",
        F.length(u).cast("double").alias("url_length"), F.length(host).cast("double").alias("host_length"), F.length(path).cast("double").alias("path_length"),
        F.size(F.split(host, r"\.")).cast("double").alias("host_labels"),
        F.size(F.filter(parts, lambda x: x != "")).cast("double").alias("depth"),
        (F.length(F.regexp_replace(u, r"[^0-9]", "")) / F.greatest(F.length(u), F.lit(1))).alias("digit_ratio"),
        _entropy(u).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1.0).alias("params"),
        F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).cast("double").alias("longest_segment"),
        F.length(F.regexp_replace(u, r"[A-Za-z0-9/.:?&=#]", "")).cast("double").alias("symbols"),
        F.substring_index(host, ".", -1).alias("suffix"),
        F.regexp_extract(path, r"^/([^/]*)/", 1).alias("segment"),
        F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1).alias("extension"),
    )


def _blocked_share(rows: DataFrame, keys: list[str], name: str, expected: Column | float = 0.5, weight: int = 2) -> DataFrame:
    """Adds `name`: the share of blocked rows among the labelled ones with the row's keys, from the hosts of the other folds only, smoothed by `weight` rows of the `expected` share."""
    counts = [F.count_if(F.col("label").isNotNull() & (F.col("fold") == f)) for f in range(FOLDS)]
    blocked = [F.count_if((F.col("label") == 1) & (F.col("fold") == f)) for f in range(FOLDS)]
    by_key = rows.groupBy(*keys).agg(F.array(*counts).alias("_n"), F.array(*blocked).alias("_b"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    others = lambda c: total(F.col(c)) - F.get(c, F.col("fold"))
    return rows.join(small(by_key), keys).withColumn(name, (others("_b") + expected * F.lit(weight)) / (others("_n") + weight)).drop("_n", "_b")


def suffix_statistics(pages: DataFrame) -> DataFrame:
    """Adds the share of all rows with the row's host suffix and with its extension, and the shares of blocked rows by host suffix and by section, which is the suffix with the first path segment.

    Hosts are dealt into folds by a hash, and a row's blocked shares come from the other folds. So
    no label tells of its own row or host, and rows to be judged get statistics of the same kind as
    rows to learn from; a section without labels has its segment's share. Suffixes, segments and extensions are sent to all tasks while they are few (a
    checked count); beyond that the joins shuffle.
    """
    suffixes = pages.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    extensions = pages.groupBy("extension").agg(F.count(F.lit(1)).alias("e"))
    total = float(max(1, pages.count()))
    rows = pages.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    rows = _blocked_share(_blocked_share(rows, ["suffix"], "suffix_blocked"), ["segment"], "_segment")
    rows = _blocked_share(rows, ["suffix", "segment"], "section_blocked", F.col("_segment"), 4).drop("_segment")
    joined = rows.join(small(suffixes), "suffix").join(small(extensions), "extension")
    return joined.withColumn("suffix_share", F.col("n") / F.lit(total)).withColumn("extension_share", F.col("e") / F.lit(total)).drop("n", "e", "fold")


def train(labelled: DataFrame, *, sample: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 17) -> GBTClassificationModel | float:
    """Boosted trees from labelled rows (FEATURES, label 0 or 1): the only step on a sample, of at most `sample` rows by hash.

    With one class only, or no labelled row, the share of label 1 (0 for none) stands for the model.
    """
    rows = labelled.where("label is not null").select("label", *FEATURES).orderBy(F.xxhash64(*FEATURES), "label", *FEATURES).limit(sample)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features").coalesce(1)
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        return float(ones or 0) / (n or 1)
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(rows)


def probability(rows: DataFrame, model: GBTClassificationModel | float) -> DataFrame:
    """Adds `p_block`, the model's probability of label 1."""
    if isinstance(model, float):
        return rows.withColumn("p_block", F.lit(model))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return scored.withColumn("p_block", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """(id, host, path, rule, verdict, p_block) of every url: its rule's verdict, else the trees'.

    The rules' verdicts are the labels: trees learn from the lexical form of the urls that a rule
    decides and judge the others; p_block is their probability of `block`. That is a weak ground
    truth, as no labelled urls exist: the trees carry the rules over to urls of the same form, and
    held_out_report measures how well. Suffix statistics cover all rows. A null url, or one without `://`, has an empty host and path, fits no rule and is
    judged as an empty text. Without a labelled url of both kinds the verdict is that of the only
    kind, or allow. Repeated rows and null ids pass through; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = with_rules(rows.withColumn("host", host).withColumn("path", path), rules)
    rows = rows.withColumn("label", F.when(F.col("rule_verdict") == "block", 1.0).when(F.col("rule_verdict") == "allow", 0.0))
    rows = suffix_statistics(saved(lexical_features(rows, "url"), "url-features"))
    scored = probability(rows, train(rows, sample=sample))
    learned = F.when(F.col("p_block") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"), "p_block")


def held_out_report(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", sample: int = 20_000) -> dict[str, float]:
    """How well trees from half of the labelled urls, by a hash of the host, tell the labels of the other half: n, accuracy, and the share of the commoner label there.

    The halves share no host, and all statistics come from the first half's labels only.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = with_rules(rows.withColumn("host", host).withColumn("path", path), rules)
    truth = F.when(F.col("rule_verdict") == "block", 1.0).when(F.col("rule_verdict") == "allow", 0.0)
    apart = F.pmod(F.xxhash64("host", F.lit(1)), F.lit(2)) == 1
    rows = rows.withColumn("truth", truth).withColumn("label", F.when(apart, F.lit(None).cast("double")).otherwise(truth))
    rows = suffix_statistics(saved(lexical_features(rows, "url"), "url-features"))
    scored = probability(rows.where(apart & F.col("truth").isNotNull()), train(rows, sample=sample))
    n, hits, ones = scored.agg(F.count(F.lit(1)), F.avg(((F.col("p_block") > 0.5).cast("double") == F.col("truth")).cast("double")), F.avg("truth")).first()
    return {"n": n, "accuracy": hits or 0.0, "majority": max(ones or 0.0, 1 - (ones or 0.0)) if n else 0.0}
