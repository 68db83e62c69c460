"""Nearest reference vectors, and the image hash of a URL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.functions import scores
from lurescope.functions.rules import hit
from lurescope.functions.urls import code_sum
from lurescope.plans.lineage import cut

# Reference vectors of the image hash.
REFERENCES = [
    ("PayPal", "phishing", [0.8, 0.2, 0.9, 0.1, 0.7, 0.3, 0.85, 0.15]),
    ("Microsoft", "phishing", [0.9, 0.1, 0.85, 0.2, 0.8, 0.1, 0.9, 0.2]),
    ("Google", "benign", [0.1, 0.9, 0.1, 0.85, 0.2, 0.9, 0.1, 0.8]),
    ("Apple", "benign", [0.2, 0.8, 0.15, 0.9, 0.1, 0.85, 0.2, 0.9]),
    ("Bank of America", "phishing", [0.85, 0.15, 0.95, 0.05, 0.75, 0.25, 0.8, 0.2]),
]
SEEDS, THRESHOLD = 10_000, 0.65


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d))


def nearest(queries: DataFrame, key: str, vector: str, references: DataFrame, ref_order: str, ref_vector: str, ref_name: str, at_most: int = 10_000) -> DataFrame:
    """``KEY, nearest, distance``: the reference with the smallest distance, the first in REF_ORDER on ties.

    The references are the small side: they are counted (more than AT_MOST are refused) and become one array beside
    every query row, so that nothing is shuffled and no pair becomes a row.
    """
    refs = references.select(F.col(ref_order).alias("o"), F.col(ref_name).alias("name"), F.col(ref_vector).alias("v")).filter("v is not null")
    refs = cut(refs)
    if refs.limit(at_most + 1).count() > at_most:
        raise ValueError(f"more than {at_most} reference vectors")
    listed = refs.agg(F.sort_array(F.collect_list(F.struct("o", "name", "v"))).alias("_refs"))
    best = F.array_min(F.transform("_refs", lambda r: F.struct(l2(F.col(vector), r["v"]).alias("distance"), r["o"].alias("o"), r["name"].alias("name"))))
    return queries.filter(F.col(vector).isNotNull()).crossJoin(listed).withColumn("_best", best).select(key, F.col("_best.name").alias("nearest"), F.col("_best.distance").alias("distance"))


def image_table(spark: SparkSession) -> DataFrame:
    """The image hash by seed: 8 pseudo-random numbers, raised for suspicious URLs, and what follows from them.

    A hash depends on the URL only through its character sum modulo SEEDS and one rule, so all of them are one small
    table of 2 * SEEDS rows, built by the rule once a session, and a URL needs no Python.
    """
    held = getattr(spark, "_lurescope_images", None)
    if held is None:
        base = np.stack([np.random.RandomState(s).rand(8) for s in range(SEEDS)]).astype("float32")
        lift = np.zeros(8, "float32")
        lift[[0, 2]] = 0.5, 0.4
        both = np.concatenate([base, base + lift])
        both /= np.linalg.norm(both, axis=1, keepdims=True)
        names, labels, vectors = zip(*REFERENCES)
        far = np.linalg.norm(both[:, None] - np.array(vectors, "float32"), axis=2).astype("float64")
        at, distance = far.argmin(1), far.min(1)
        bad = (distance < THRESHOLD) & (np.array(labels)[at] == "phishing")
        score = np.where(bad, (1 - distance).clip(0, 1) * 100, (distance * 50).clip(0, 40))
        frame = pd.DataFrame({
            "seed": np.tile(np.arange(SEEDS), 2), "raised": np.repeat([False, True], SEEDS), "image_nearest": np.array(names)[at],
            "image_distance": distance.round(4), "image_phishing": bad, "image_score": score.round(2),
        })
        held = spark._lurescope_images = spark.createDataFrame(frame)
    return held


def with_image_hash(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds nearest reference, distance, verdict and score of the image hash of each URL."""
    keyed = df.withColumn("seed", code_sum(F.col(url)) % SEEDS).withColumn("raised", hit("image_hash", F.lower(url)))
    return keyed.join(F.broadcast(image_table(df.sparkSession)), ["seed", "raised"], "left").drop("seed", "raised")


def hybrid_visual(df: DataFrame, key: str, url: str = "url") -> DataFrame:
    """``KEY, verdict, visual_score, brand``: image hash, logo and layout together."""
    staged = with_image_hash(df, url).withColumn("_u", F.lower(url))
    staged = staged.select(key, "image_score", "image_phishing", *scores.columns({**scores.brand_logo(F.col("_u")), **scores.page_layout(F.col("_u"))}))
    bad = F.col("image_phishing") | (F.col("logo_similarity") > 0.85)
    visual = scores.visual_score(F.col("image_score"), F.col("logo_score"), F.col("layout_score"))
    return staged.select(key, F.when(bad, "PHISHING").otherwise("BENIGN").alias("verdict"), visual.alias("visual_score"), F.when(bad, F.col("brand")).otherwise("None").alias("brand"))


def screenshot_report(df: DataFrame, key: str, url: str = "url") -> DataFrame:
    """What a screenshot of each URL would be said to show: score, brand, layout, words read and palette, all by the hybrid verdict."""
    bad = F.col("verdict") == "PHISHING"
    # What is reported for the two verdicts.
    words = F.when(bad, F.array(F.lit("Sign in to your Account"), F.lit("Verification Required"))).otherwise(F.array(F.lit("Home"), F.lit("About"), F.lit("Login")))
    palette = F.when(bad, "96.4% Match to Target Brand Palette").otherwise("Authentic Brand Palette")
    return hybrid_visual(df, key, url).select(
        key, F.col("visual_score").alias("screenshot_score"), F.col("brand").alias("detected_logo"), F.concat(F.lit("hybrid verdict: "), "verdict").alias("layout_verdict"),
        F.array_join(words, " | ").alias("words_read"), palette.alias("palette"), F.lit("HIGH").alias("vision_confidence"),
    )
