"""Building, describing and splitting training tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.functions.urls import for_corpus, lexical, with_domain
from lurescope.plans.ranking import buckets_for, running

BASELINE, TOLERANCE = 0.50, 0.15


def balance(df: DataFrame, keys: list[str] | None = None, label: str = "label") -> DataFrame:
    """Rows, phishing and legitimate rows (per KEYS); a null label counts only as a row."""
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("phishing"), F.count_if(F.col(label) == 0).alias("legitimate"))


def drift(df: DataFrame, keys: list[str] | None = None, label: str = "label", baseline: float = BASELINE, tolerance: float = TOLERANCE) -> DataFrame:
    """The phishing ratio of all rows against the baseline; drift beyond the tolerance asks for retraining."""
    counted = balance(df, keys, label)
    ratio = F.col("phishing") / F.col("rows")
    off = F.abs(ratio - baseline) > tolerance
    return counted.select(
        *(keys or []), "rows", F.round(ratio, 6).alias("phishing_ratio"), F.format_string("%.1f%%", F.round(ratio * 100, 1)).alias("ratio_text"), off.alias("drifted"),
        F.when(off, "TRIGGER RETRAINING").otherwise("NO DRIFT DETECTED").alias("action"),
    )


def feature_columns(df: DataFrame, without: tuple[str, ...] = ("url", "label")) -> list[str]:
    return [c for c in df.columns if c not in without]


def preview(df: DataFrame, order: str, first: int = 6) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(order).limit(first)


def by_hash(key: str, seed: int) -> Column:
    """A seeded 60-bit number of KEY from a salted SHA-256 digest, the same on every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def stratified(df: DataFrame, strata: list[str], key: str, per_stratum: int, order: Column | None = None) -> DataFrame:
    """PER_STRATUM rows of each stratum, the first in ORDER (by default a seeded hash of KEY), without replacement.

    The k smallest are kept in every task before the shuffle (a window with a rank limit), so a stratum with a third
    of all rows sends only its candidates.
    """
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order if order is not None else by_hash(key, 42), F.col(key)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= per_stratum).drop("_rank")


def ordered_split(df: DataFrame, key: str, share: float = 0.8, shuffled: int | None = None) -> DataFrame:
    """Adds ``part``: train for the first int(n * SHARE) rows in order of KEY (or of its seeded hash), test for the rest.

    Ranks are counted in buckets between quantiles of the order; no task sorts the whole table, however keys are spread.
    """
    total = df.count()
    sort = F.col(key) if shuffled is None else by_hash(key, shuffled)
    staged = df.withColumn("_all", F.lit(0)).withColumn("_sort", sort)
    b = buckets_for(total)
    bucket = F.lit(0)
    if b > 1:
        cuts = staged.agg(F.percentile_approx("_sort", [k / b for k in range(1, b)], 100 * b)).first()[0]
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_sort")))
    ranked = running(staged, ["_all"], bucket, [F.col("_sort"), F.col(key)], F.lit(1), "_rank").drop("_sort")
    return ranked.withColumn("part", F.when(F.col("_rank") < int(total * share), "train").otherwise("test")).drop("_all", "_rank")


def union_of(frames: dict[str, DataFrame], name: str = "dataset_source") -> DataFrame:
    """All rows of all frames, each with the name of its source; repeats stay."""
    parts = [df.withColumn(name, F.lit(k)) for k, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def corpus_by_class(raw: DataFrame, url: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(bad, good) rows of a raw corpus with labels in any case."""
    rows = raw.select(for_corpus(F.col(url)).alias("url"), F.lower(F.col(label)).alias("_label"))
    return rows.filter("_label = 'bad'").select("url", F.lit(1).alias("label")), rows.filter("_label = 'good'").select("url", F.lit(0).alias("label"))


# How each feature of a synthetic row is drawn, for label 1 and for label 0: a share of ones, a uniform
# number of a range, a whole number of a range without its upper end, or a constant.
DRAWN = [
    ("ssl_state", ("ones", 0.25), ("constant", 1.0)),
    ("domain_registration_length", ("ones", 0.15), ("constant", 1.0)),
    ("favicon", ("ones", 0.6), ("constant", 0.0)),
    ("port", ("constant", 0.0), ("constant", 0.0)),
    ("request_url_ratio", ("uniform", 0.5, 0.95), ("uniform", 0.05, 0.3)),
    ("url_of_anchor_ratio", ("uniform", 0.6, 0.98), ("uniform", 0.02, 0.25)),
    ("links_in_tags_ratio", ("uniform", 0.4, 0.9), ("uniform", 0.05, 0.3)),
    ("sfh_external", ("ones", 0.8), ("constant", 0.0)),
    ("submitting_to_email", ("ones", 0.3), ("constant", 0.0)),
    ("redirect_count", ("whole", 1, 4), ("constant", 0.0)),
    ("on_mouseover", ("ones", 0.4), ("constant", 0.0)),
    ("right_click_disabled", ("ones", 0.3), ("constant", 0.0)),
    ("popup_window", ("ones", 0.2), ("constant", 0.0)),
    ("iframe_hidden", ("ones", 0.6), ("constant", 0.0)),
    ("age_of_domain", ("ones", 0.1), ("constant", 1.0)),
    ("dns_record", ("ones", 0.7), ("constant", 1.0)),
    ("web_traffic", ("uniform", 0.0, 0.3), ("uniform", 0.7, 1.0)),
    ("page_rank", ("uniform", 0.0, 0.2), ("uniform", 0.6, 1.0)),
    ("google_index", ("ones", 0.2), ("constant", 1.0)),
    ("links_pointing_to_page", ("whole", 0, 3), ("whole", 15, 100)),
    ("statistical_report", ("constant", 1.0), ("constant", 0.0)),
    ("dom_node_count", ("whole", 25, 120), ("whole", 150, 600)),
    ("dom_max_depth", ("whole", 3, 7), ("whole", 8, 20)),
    ("graph_avg_degree", ("uniform", 1.2, 2.1), ("uniform", 2.8, 4.5)),
]
# Lexical features that are 0 in every row of label 0.
ZERO_IF_GOOD = ("having_ip_address", "shortening_service", "having_at_symbol", "double_slash_redirecting", "prefix_suffix", "having_sub_domain", "https_token", "abnormal_url")


def drawn(how: tuple, uniform: Column) -> Column:
    """A feature drawn as HOW says from a uniform number."""
    if how[0] == "constant":
        return F.lit(how[1])
    if how[0] == "ones":
        return (uniform < how[1]).cast("double")
    value = how[1] + uniform * (how[2] - how[1])
    return F.floor(value).cast("double") if how[0] == "whole" else F.round(value, 6)


def uniforms(key: str, seed: int, n: int) -> list[Column]:
    """N uniform numbers of a row: pieces of 15 hexadecimal digits of salted SHA-256 digests of its KEY, four a digest."""
    digest = lambda k: F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.lit(k).cast("string"), F.col(key).cast("string")), 256)
    number = lambda k: F.conv(F.substring(digest(k // 4), 1 + 15 * (k % 4), 15), 16, 10).cast("bigint")
    return [(F.pmod(number(k), F.lit(1 << 40)) + 0.5) / float(1 << 40) for k in range(n)]


def synthetic_features(df: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """Adds features drawn from the label: a synthetic table, where any classifier is perfect, for testing only.

    Draws are salted digests of KEY, so a lost task draws the same again. A label other than 1 counts as 0.
    """
    numbers = uniforms(key, seed, len(DRAWN))
    out = {name: F.when(F.col(label) == 1, drawn(bad, u)).otherwise(drawn(good, u)) for (name, bad, good), u in zip(DRAWN, numbers)}
    return df.select(*[c for c in df.columns if c not in out], *[c.alias(k) for k, c in out.items()])


# Sources that a training set is merged from in equal parts: name, kind and weight.
SOURCES = [
    ("structural-features", "structural features", 0.25),
    ("page-benchmark", "labelled pages", 0.25),
    ("raw-addresses", "raw addresses", 0.25),
    ("domain-indicators", "domain indicators", 0.25),
]


def source_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *s) for k, s in enumerate(SOURCES)], "ord int, name string, kind string, weight double")


def training_set(raw: DataFrame, url: str, label: str, total: int = 10_000, seed: int = 42) -> DataFrame:
    """``url, dataset_source, label`` and all features: a training set of TOTAL rows, half of them bad, in equal parts from each source.

    RAW has URLs with the labels bad and good in any case. Each source draws its rows by its own seeded hash, without
    replacement; rows kept per source and class are a few thousand, the first of each found in the tasks before the
    shuffle. Lexical features are computed, but stay 0 in good rows, as the sources have them; the others are drawn.
    """
    half = total // len(SOURCES) // 2
    bad, good = corpus_by_class(raw, url, label)
    numbered = bad.unionByName(good).filter("url is not null").distinct()
    each = numbered.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(s[0]).alias("dataset_source")) for k, s in enumerate(SOURCES)]))).select("url", "label", "_s.*")
    each = each.withColumn("_draw", F.concat_ws(":", "ord", "label", "url"))
    kept = stratified(each, ["ord", "label"], "url", half, by_hash("_draw", seed))
    staged = lexical_features(kept)
    good_row = F.col("label") == 0
    fixed = {c: F.when(good_row, 0.0).otherwise(F.col(c)).alias(c) for c in ZERO_IF_GOOD}
    fixed["url_length_score"] = F.when(good_row, F.when(F.col("url_length") < 54, 0.0).otherwise(0.5)).otherwise(F.col("url_length_score")).alias("url_length_score")
    staged = staged.select(*[fixed.get(c, F.col(c)) for c in staged.columns])
    return synthetic_features(staged, "_draw", seed=seed).drop("_draw", "ord")


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    staged = with_domain(df, url)
    return staged.select(*df.columns, *[c.alias(k) for k, c in lexical(F.col(url), F.col("domain")).items()])


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 42) -> DataFrame:
    """min(BOUND, n) rows, the first by the seeded hash of KEY: each task keeps its first BOUND, so nothing is sorted as a whole."""
    return df.orderBy(by_hash(key, seed), key).limit(bound)


def feature_means(df: DataFrame) -> DataFrame:
    """``feature, mean, missing`` of each feature column, in one pass over the table."""
    names = [c for c, kind in df.dtypes if kind == "double" and c in feature_columns(df)]
    sums = df.agg(*[F.struct(F.lit(c).alias("feature"), F.round(F.avg(c), 6).alias("mean"), F.count_if(F.col(c).isNull()).alias("missing")).alias(c) for c in names])
    return sums.select(F.inline(F.array(*names)))


def fallback_corpus(spark: SparkSession) -> DataFrame:
    """Rows to start with where no corpus is at hand: a bad and a good address for each source."""
    seeds = [("http://paypal-login.example/verify", "bad"), ("https://www.wikipedia.org/", "good")]
    return spark.createDataFrame([(u, label, name) for name, *_ in SOURCES for u, label in seeds], "URL string, Label string, Source string")


def found(df: DataFrame, key: str, value: object) -> DataFrame:
    """The first row with VALUE in KEY, at most one: a filter that reaches the scan, and a limit."""
    return df.filter(F.col(key) == value).limit(1)
