"""Problem 6: mixing sources to target weights, by Efraimidis-Spirakis sampling within each source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.tokens import token_sizes
from lurescope.plans.lineage import cut
from lurescope.plans.ranking import buckets_for, running
from lurescope.session import table


def with_quality(sized: DataFrame) -> DataFrame:
    """SIZED (source, tokens, chars, lang) with ``weight`` between 0.05 and 1: how well the vocabulary covers a text.

    A tokenizer was trained on ordinary language: it takes few tokens for it and many for markup, noise and broken
    words. Languages differ in this, so a text's characters a token are set against those of all texts of its language,
    as far as the language is known; the measure is learned from the corpus, whole texts and all of them.
    """
    lang = F.coalesce(F.nullif(F.substring(F.regexp_replace(F.lower("lang"), "[^a-z]+", ""), 1, 2), F.lit("")), F.lit("?"))
    rows = sized.withColumn("_lang", lang)
    usual = rows.filter("tokens > 0").groupBy("_lang").agg((F.sum("chars") / F.sum("tokens")).alias("_usual"))
    own = F.col("chars") / F.greatest(F.col("tokens"), F.lit(1))
    return rows.join(usual, "_lang", "left").withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.pow(own / F.col("_usual"), 2)))).drop("_lang", "_usual")


def plan_of(available: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per mix and source: ``share, repeats, available, budget, epochs, rest``.

    The total is TOTAL_TOKENS, or else the largest at which every source can reach its share within its repeats, so
    that the shares come out as wanted. A source that has no tokens at all can't limit it and gets none. A source
    that can't reach its part of a given total is used as often as allowed. Shares are taken relative to their sum;
    null or negative shares and repeats count as 0; of repeated rows of a mix and source the largest counts.
    """
    share = F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))
    repeats = F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0))
    wanted = targets.filter("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max(share).alias("share"), F.max(repeats).alias("repeats"))
    sums = wanted.groupBy("mix_name").agg(F.sum("share").alias("_sum"))
    each = wanted.join(sums, "mix_name").join(available, "source", "left")
    each = each.select("mix_name", "source", F.when(F.col("_sum") > 0, F.col("share") / F.col("_sum")).otherwise(0.0).alias("share"), "repeats", F.coalesce("available", F.lit(0)).alias("available"))
    limit = F.when((F.col("share") > 0) & (F.col("available") > 0), F.col("repeats") * F.col("available") / F.col("share"))
    most = each.groupBy("mix_name").agg(F.coalesce(F.lit(total_tokens).cast("double"), F.min(limit), F.lit(0.0)).alias("total"))
    budget = F.least(F.col("share") * F.col("total"), (F.col("repeats") * F.col("available")).cast("double"))
    each = each.join(most, "mix_name").withColumn("budget", budget)
    epochs = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available") + 1e-9), F.col("repeats").cast("bigint"))).otherwise(0)
    return each.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.col("budget") - F.col("epochs") * F.col("available"), F.lit(0.0)))


def sampling_key(seed: int, weight: Column, *of: str) -> Column:
    """An exponential key -ln(u) / WEIGHT with a seeded uniform u of the columns OF: the smallest keys are the sample."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.ln(uniform) / weight


def with_buckets(rows: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """ROWS with ``_quantile``: between which quantiles of its source's keys ``_key`` lies, so that buckets are alike in size whatever the weights."""
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    b = buckets_for(n.agg(F.max("n")).first()[0] or 0, per_bucket)
    if b == 1:
        return rows.withColumn("_quantile", F.lit(0))
    cuts = F.array(*[F.lit(k / b) for k in range(1, b)])
    bounds = rows.groupBy("source").agg(F.percentile_approx("_key", cuts, F.lit(100 * b)).alias("_cuts"))
    return rows.join(bounds, "source").withColumn("_quantile", F.size(F.filter("_cuts", lambda c: c < F.col("_key")))).drop("_cuts")


def filled(candidates: DataFrame) -> DataFrame:
    """``mix_name, id`` of the CANDIDATES (mix_name, source, id, tokens, _key, _gap) that fit, one after the other by key, into what is left of the gap."""
    kind = candidates.schema["id"].dataType.simpleString()

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_key", "id"])
        gap, taken = float(rows["_gap"].iloc[0]), []
        for i, t in zip(rows["id"].tolist(), rows["tokens"].tolist()):
            if t <= gap:
                gap -= t
                taken.append(i)
        return pd.DataFrame({"mix_name": rows["mix_name"].iloc[0], "id": taken})

    return candidates.groupBy("mix_name", "source").applyInPandas(fill, f"mix_name string, id {kind}")


def mixed(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7) -> DataFrame:
    """``mix_name, id, source, tokens, uses`` of all documents that a mix uses, from DOCS (id, source, tokens, weight).

    Each source goes through its complete epochs first. The fraction left is drawn in the order of the sampling keys:
    documents are taken as far as the running sum stays within the token budget, and of those behind each that still
    fits into what is left, one after the other, until no unused document does. A gap is smaller than one document,
    and of documents of t tokens only the first gap / t can ever fit, so few candidates reach this last step however
    large a source is. Running sums are pre-aggregated in buckets of the keys, so that a source with a third of all
    documents is never sorted in one task. Documents without tokens, id or source are not used; a null weight counts
    as 1, one of 0 or less as 1e-6.
    """
    docs = docs.select("id", "source", "tokens", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6)).alias("weight"))
    docs = docs.filter("tokens > 0 and id is not null and source is not null")
    stats = docs.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = cut(plan_of(stats, targets, total_tokens).select("mix_name", "source", "repeats", "epochs", "rest"))
    rows = docs.join(plan, "source").withColumn("_key", sampling_key(seed, F.col("weight"), "mix_name", "id"))
    rows = cut(with_buckets(rows.drop("weight")))
    open_rest = F.when(F.col("epochs") < F.col("repeats"), F.col("rest")).otherwise(0.0)
    group, order = ["mix_name", "source"], [F.col("_key"), F.col("id")]
    ordered = running(rows, group, F.col("_quantile"), order, F.col("tokens"))
    rows = cut(ordered.withColumn("more", (F.col("before") + F.col("tokens") <= open_rest).cast("int")).drop("before"))
    sums = rows.groupBy(*group).agg(F.sum(F.col("tokens") * F.col("more")).alias("_sum"))
    gaps = plan.filter("epochs < repeats").join(sums, group).select(*group, (F.col("rest") - F.col("_sum")).alias("_gap"))
    small = rows.filter("more = 0").join(gaps, group).filter("tokens <= _gap")
    ranked = running(small, [*group, "tokens"], F.col("_quantile"), order, F.lit(1), "_rank")
    late = filled(ranked.filter(F.col("_rank") < F.floor(F.col("_gap") / F.col("tokens"))).select(*group, "id", "tokens", "_key", "_gap")).withColumn("_late", F.lit(1))
    uses = F.col("epochs") + F.col("more") + F.coalesce("_late", F.lit(0))
    return rows.join(late, ["mix_name", "id"], "left").select("mix_name", "id", "source", "tokens", uses.alias("uses")).filter("uses > 0")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keep = {"source": F.col("source"), "lang": F.col("lang"), "chars": F.length("text")}
    sized = cut(token_sizes(table(spark, sf_dir, "documents"), keep=keep))
    return cut(with_quality(sized)), table(spark, sf_dir, "mix_targets")


def p6_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = _inputs(spark, sf_dir)
    return mixed(docs, targets).select("mix_name", F.col("id").alias("doc_id"), "source", "tokens", "uses")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source: the target share, the share reached, tokens, documents and the most uses of one."""
    docs, targets = _inputs(spark, sf_dir)
    used = mixed(docs, targets).groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses")
    )
    totals = used.groupBy("mix_name").agg(F.sum("tokens").alias("_total"))
    wanted = targets.filter("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return wanted.join(used, ["mix_name", "source"], "left").join(totals, "mix_name", "left").select(
        "mix_name", "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("_total"), F.lit(0.0)), 9).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
    )


QUERIES = {"p6_uses": p6_uses, "p6_shares": p6_shares}
