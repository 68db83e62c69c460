"""Measures of predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.plans.ranking import buckets_for, running


def confusion(df: DataFrame, prob: str, label: str, keys: list[str] | None = None, cut_at: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn and accuracy, precision, recall, F1 in percent (per KEYS), and Matthews' correlation.

    Rows without a label or a probability don't count; empty denominators count as 1.
    """
    p, y = F.col(prob) >= cut_at, F.col(label) == 1
    rows = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(*(keys or [])).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    share = lambda a, b: a / F.greatest(F.lit(1), b) * 100
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    f1 = 2 * precision * recall / F.greatest(F.lit(0.001), precision + recall)
    mcc = (tp * tn - fp * fn) / F.greatest(F.lit(1.0), F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    named = {"accuracy": share(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "f1": f1, "mcc": mcc}
    return counts.select(*(keys or []), "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(k) for k, c in named.items()])


def accuracy_by(df: DataFrame, prob: str, label: str, keys: list[str], cut_at: float = 0.5) -> DataFrame:
    """Correct and all predictions per KEYS."""
    right = (F.col(prob) >= cut_at) == (F.col(label) == 1)
    rows = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(*keys).agg(F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("accuracy", F.round(F.col("correct") / F.col("total") * 100, 6))


def roc_auc(df: DataFrame, prob: str, label: str) -> DataFrame:
    """Area under the ROC curve with ties counted half: one row per distinct score, then sums along the scores in buckets."""
    rows = df.select(F.col(prob).cast("double").alias("_score"), F.col(label).alias("_label")).filter("_score is not null and _label is not null")
    scores = rows.groupBy("_score").agg(F.count_if(F.col("_label") == 1).alias("_yes"), F.count_if(F.col("_label") != 1).alias("_no"))
    b = buckets_for(rows.count())
    bucket = F.lit(0)
    if b > 1:
        cuts = scores.agg(F.percentile_approx("_score", [k / b for k in range(1, b)], 100 * b)).first()[0]
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_score")))
    below = running(scores.withColumn("_all", F.lit(0)), ["_all"], bucket, [F.col("_score")], F.col("_no"), "_below")
    area = below.withColumn("_won", F.col("_yes") * (F.col("_below") + F.col("_no") / 2))
    return area.agg(F.round(F.sum("_won") / F.nullif(F.sum("_yes") * F.sum("_no"), F.lit(0)), 6).alias("roc_auc"))


def epoch_measures(df: DataFrame, epoch: str, prob: str, label: str) -> DataFrame:
    """Mean binary cross-entropy and accuracy in percent of the predictions of each EPOCH; certainty is cut off at 1e-12."""
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col(prob)))
    loss = -F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))
    right = ((F.col(prob) >= 0.5) == (F.col(label) == 1)).cast("double")
    rows = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(epoch).agg(F.count(F.lit(1)).alias("graphs"), F.round(F.avg(loss), 6).alias("loss"), F.round(F.avg(right) * 100, 6).alias("accuracy"))
