"""Problem 1: one label per item from annotators who disagree, by confidence-aware truth discovery."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lurescope.plans.lineage import cut
from lurescope.session import table

# How the two verdicts are written, after lower case and without anything but letters.
YES = ("phishing", "phish", "malicious", "notlegitimate", "malware", "scam", "fraud", "fraudulent", "unsafe", "notsafe", "notbenign", "bad")
NO = ("legitimate", "legit", "safe", "benign", "notphishing", "notphish", "notmalicious", "clean", "harmless", "good", "ok")
#: Two-sided 95 %: the normal quantile in the chi-squared approximation.
Z = 1.959964


def claim_of(verdict: Column) -> Column:
    """1.0 or 0.0 for a verdict in any spelling, bare or as a JSON object with a ``verdict``; null for anything else."""
    word = F.regexp_replace(F.regexp_replace(F.lower(verdict), r'"?verdict"?\s*:', ""), "[^a-z]+", "")
    read = lambda w: F.when(w.isin(*YES), 1.0).when(w.isin(*NO), 0.0)
    return F.transform(F.array(word), read)[0]


def annotator_of(name: Column) -> Column:
    """An annotator's name without case, blanks and punctuation; null where nothing is left."""
    bare = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")
    return F.nullif(bare, F.lit(""))


def usable(answers: DataFrame, item: str, annotator: str, verdict: str, score: str) -> DataFrame:
    """``item, annotator, x``: the claim of each annotator on each item, between 0 and 1.

    The verdict counts; where it can't be read, the score does, as on which side of the middle of the annotator's own
    scale it lies. An annotator uses the scale 0-1 if most of its scores lie there, else 0-100; values outside are no
    scores. Repeated answers of one annotator on an item count once, with their mean. Rows without item or annotator,
    and answers with neither verdict nor score, are not usable.
    """
    rows = answers.select(F.col(item).alias("item"), annotator_of(F.col(annotator)).alias("annotator"), claim_of(F.col(verdict)).alias("v"), F.col(score).cast("double").alias("s"))
    rows = rows.filter("item is not null and annotator is not null")
    inside = F.col("s").between(0, 100)
    scales = rows.groupBy("annotator").agg((2 * F.count_if(F.col("s").between(0, 1)) > F.count_if(inside)).alias("unit"))
    top = F.when(F.col("unit"), 1.0).otherwise(100.0)
    side = F.when(F.col("s").between(0, top) & (F.col("s") != top / 2), (F.col("s") > top / 2).cast("double"))
    claims = rows.join(scales, "annotator").select("item", "annotator", F.coalesce("v", side).alias("x")).filter("x is not null")
    return claims.groupBy("item", "annotator").agg(F.avg("x").alias("x"))


def upper(errors: Column, n: Column) -> Column:
    """Upper confidence bound of an error variance: squared errors over the lower chi-squared quantile of N degrees."""
    n = F.greatest(n, F.lit(0.5))
    quantile = n * F.pow(F.greatest(1 - 2 / (9 * n) - Z * F.sqrt(2 / (9 * n)), F.lit(1e-3)), 3)
    return (errors + 0.5) / quantile


def bound(errors: Column, n: Column) -> Column:
    """Upper bound of the error variance of an annotator's claims, at most 1/2; of one mostly wrong, with its labels turned."""
    return F.least(upper(F.least(errors, n - errors), n), F.lit(0.5))


def weights(sums: DataFrame, per_label: bool = True) -> DataFrame:
    """Per annotator the bounds of its error variances, and by how much a claim of 1 or 0 brings label 1 nearer than label 0.

    The weight of an annotator is the log odds of being right at the bound: few answers give a bound near 1/2 and no
    weight, however well they agree; many give what they show. A label's distance is the weighted sum of its distances
    to the claims, turned for annotators that are mostly wrong. With PER_LABEL the errors on items of either label have
    a variance of their own, otherwise both have one.
    """
    e1, n1, e0, n0 = (F.col(k) for k in ("e1", "n1", "e0", "n0"))
    if not per_label:
        e1, n1, e0, n0 = e1 + e0, n1 + n0, e1 + e0, n1 + n0
    staged = sums.select("annotator", "answers", "yes", "items", bound(e1, n1).alias("b1"), bound(e0, n0).alias("b0"), (2 * e1 > n1).alias("t1"), (2 * e0 > n0).alias("t0"))
    w = lambda b, turned: F.when(turned, F.log((1 - b) / b)).otherwise(0.0)
    turned = lambda b, t: F.when(t, 1 - b).otherwise(b)
    return staged.select(
        "annotator", "answers", "yes", "items", turned(F.col("b1"), F.col("t1")).alias("miss"), turned(F.col("b0"), F.col("t0")).alias("alarm"),
        (w(F.col("b0"), ~F.col("t0")) - w(F.col("b1"), F.col("t1"))).alias("for_yes"), (w(F.col("b0"), F.col("t0")) - w(F.col("b1"), ~F.col("t1"))).alias("for_no"),
    )


def with_prior(weighted: DataFrame) -> DataFrame:
    """WEIGHTED with ``prior``, the log odds of label 1 among all items: one row beside each, and no number in the plan, so that every round runs the same code."""
    yes, items = F.sum("yes"), F.sum("items")
    return weighted.crossJoin(weighted.agg(F.log((yes + 0.5) / (F.greatest(F.lit(0.0), items - yes) + 0.5)).alias("prior")))


def most_moved(new: DataFrame, old: DataFrame) -> float:
    """The most that a bound of an annotator differs between the two."""
    both = new.join(old.select("annotator", F.col("miss").alias("_m"), F.col("alarm").alias("_a")), "annotator")
    return both.agg(F.max(F.greatest(F.abs(F.col("miss") - F.col("_m")), F.abs(F.col("alarm") - F.col("_a"))))).first()[0] or 0.0


def believed(claims: DataFrame, weighted: DataFrame) -> DataFrame:
    """CLAIMS with ``margin``, by how much label 1 is nearer to all claims on their item, and ``t``, the nearer label; a reviewed one stays."""
    say = F.col("x") * F.col("for_yes") + (1 - F.col("x")) * F.col("for_no")
    margin = F.sum(say).over(Window.partitionBy("item")) + F.col("prior")
    known = F.when(F.col("known") > 0.5, 30.0).when(F.col("known").isNotNull(), -30.0)
    return claims.join(weighted, "annotator").withColumn("margin", F.coalesce(known, margin)).withColumn("t", (F.col("margin") > 0).cast("double"))


def sums_of(labelled: DataFrame) -> DataFrame:
    """Per annotator the distances between its claims and the labels, for both labels; pre-aggregated before the shuffle."""
    t, x, n = F.col("t"), F.col("x"), F.col("n")
    per_item = n / F.count(F.lit(1)).over(Window.partitionBy("item"))
    return labelled.withColumn("_part", per_item).groupBy("annotator").agg(
        F.sum(t * n).alias("n1"), F.sum(t * (1 - x) * n).alias("e1"), F.sum((1 - t) * n).alias("n0"), F.sum((1 - t) * x * n).alias("e0"),
        F.sum(t * F.col("_part")).alias("yes"), F.sum("_part").alias("items"), F.sum("n").alias("answers"),
    )


def by_pattern(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims of one item of each pattern with the number ``n`` of its items, item to ``pattern``).

    Items on which the same annotators claim the same are alike; with few annotators there are far fewer patterns than
    items. A pattern is told by hashes of its claims that are combined before the shuffle, so no item's claims are collected.
    """
    h = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "annotator", "x"))
    items = claims.groupBy("item").agg(h(1).alias("h1"), h(2).alias("h2"), F.count(F.lit(1)).alias("c"), F.max("known").alias("known"))
    kinds = items.groupBy("h1", "h2", "c", "known").agg(F.min("item").alias("pattern"), F.count(F.lit(1)).alias("n"))
    kinds = cut(kinds)
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("c") == F.col("_c")) & F.col("known").eqNullSafe(F.col("_known"))
    of = kinds.select("pattern", *[F.col(k).alias(f"_{k}") for k in ("h1", "h2", "c", "known")])
    one = claims.join(kinds.select(F.col("pattern").alias("item"), "n"), "item")
    return one, items.join(of, same).select("item", "pattern")


class Truth(NamedTuple):
    """What :func:`discover` found: labelled claims, weighted annotators, rounds taken and whether they settled."""

    claims: DataFrame
    annotators: DataFrame
    rounds: int
    moved: float


def discover(claims: DataFrame, known: DataFrame | None = None, rounds: int = 100, settled: float = 1e-9, per_label: bool = True) -> Truth:
    """Labels and weights in turn until no bound moves by more than SETTLED, for CLAIMS (item, annotator, x).

    Confidence-aware truth discovery: an annotator's weight comes from the chi-squared upper confidence bound of its
    error variance, so that a contributor of few answers gets little however well they agree; each label is the one
    with the smallest weighted distance to the claims on its item. PER_LABEL keeps a variance for each label, as
    annotators err in one direction; without it there is one. KNOWN (item, known) has reviewed labels that stay.

    Rounds look at one item of each pattern of claims, partitioned by item once; a round shuffles one row per annotator
    and task. After the mean per annotator an item has one claim per annotator. Annotators may be many: their weights
    are joined as a table that Spark broadcasts only when it is small. Should ROUNDS end first, ``moved`` says how far
    the last one still moved a bound. Empty claims give empty results.
    """
    if known is None:
        known = claims.sparkSession.createDataFrame([], "item bigint, known double")
    one = known.filter("item is not null and known is not null").groupBy("item").agg(F.avg("known").alias("known"))
    claims = cut(claims.join(one, "item", "left").select("item", "annotator", "x", "known"))
    patterns, items = by_pattern(claims)
    held = patterns.repartition("item").sortWithinPartitions("item").persist(StorageLevel.MEMORY_AND_DISK)
    majority = F.coalesce("known", F.avg("x").over(Window.partitionBy("item"))) > 0.5
    sums = cut(sums_of(held.withColumn("t", majority.cast("double"))))
    now, moved, done = weights(sums, per_label), math.inf, 0
    while moved > settled and done < rounds:
        sums = cut(sums_of(believed(held, with_prior(now))))
        new = weights(sums, per_label)
        moved, now, done = most_moved(new, now), new, done + 1
    now = with_prior(now)
    labels = cut(believed(held, now).select(F.col("item").alias("pattern"), "margin", "t").distinct())
    held.unpersist()
    return Truth(claims.join(items, "item").join(labels, "pattern").drop("pattern"), now, done, moved)


def _discovered(spark: SparkSession, sf_dir: str) -> Truth:
    claims = usable(table(spark, sf_dir, "engine_results"), "scan_id", "engine", "verdict", "threat_score")
    reviewed = table(spark, sf_dir, "scan_labels").select(F.col("scan_id").alias("item"), claim_of(F.col("verdict")).alias("known"))
    return discover(claims, reviewed)


def labels_of(labelled_claims: DataFrame) -> DataFrame:
    """One row per item: its label ``t``, the ``probability`` that its margin stands for, ``agreement`` (share of the claims on the side of the label) and ``answers``."""
    side = F.when(F.col("t") > 0.5, F.col("x")).otherwise(1 - F.col("x"))
    probability = 1 / (1 + F.exp(-F.max("margin")))
    return labelled_claims.groupBy("item").agg(F.max("t").alias("t"), probability.alias("probability"), F.avg(side).alias("agreement"), F.count(F.lit(1)).alias("answers"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_of(_discovered(spark, sf_dir).claims).filter("t > 0.5").select(F.col("item").alias("scan_id"))


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("t") > 0.5, "PHISHING").otherwise("LEGITIMATE")
    found = labels_of(_discovered(spark, sf_dir).claims)
    return found.select(F.col("item").alias("scan_id"), verdict.alias("verdict"), F.round("probability", 6).alias("probability"), F.round("agreement", 6).alias("agreement"), "answers")


def p1_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per engine how far it can be trusted: its balanced accuracy under the bounds, beside the reliability it claims."""
    found = _discovered(spark, sf_dir)
    named = table(spark, sf_dir, "engines").select(annotator_of(F.col("name")).alias("annotator"), F.col("name").alias("engine"), F.col("reliability").alias("claimed"))
    trust = 1 - (F.col("miss") + F.col("alarm")) / 2
    return found.annotators.join(named, "annotator", "left").select(
        F.coalesce("engine", "annotator").alias("engine"), "answers", F.round("miss", 6).alias("miss_rate"), F.round("alarm", 6).alias("false_alarm_rate"), F.round(trust, 6).alias("reliability"), "claimed",
        F.lit(found.moved <= 1e-9).alias("settled"),
    )


QUERIES = {"p1_found": p1_found, "p1_consensus": p1_consensus, "p1_engines": p1_engines}
