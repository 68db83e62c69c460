"""Problem 2: records that are the same but for formatting, by progressive partition refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.urlkeys import decoded, letters, plain, wide_hash, with_key
from lurescope.plans.lineage import cut
from lurescope.session import table


def invariant(url: Column) -> Column:
    """Length and letter histogram of the stripped text in one number: equal for all copies, whatever the order of parts.

    Every letter adds one to the upper part and its own hash to the lower, so the sum depends on the counts of the
    letters alone; it is taken modulo 2^62 after every letter, so that this holds for texts of any length.
    """
    add = lambda total, c: (total + F.xxhash64(c).bitwiseAND((1 << 42) - 1) + (1 << 44)).bitwiseAND((1 << 62) - 1)
    return F.aggregate(F.split(letters(decoded(plain(url))), ""), F.lit(0).cast("bigint"), add)


def refine(rows: DataFrame, classes: list[str]) -> DataFrame:
    """The rows whose class, given by the columns CLASSES, has several members."""
    several = rows.groupBy(*classes).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(several, classes, "left_semi")


def copy_classes(df: DataFrame, id_col: str, url: str, within: list[str] | None = None) -> DataFrame:
    """One row per member of every class of several copies: WITHIN, ``id_a`` (smallest id), ``id_b`` (its id), ``copies``.

    First the rows are split by cheap invariants, counted before they are shuffled; only rows of classes with several
    members get the costly key. Both are written once, as their classes are counted and then looked up. A class of any
    size is handled: its smallest id and size come from pre-aggregated sums, joined back as one row a class (a skewed
    join that adaptive execution splits).

    A row delivered twice under one id counts once. Rows with a null id or URL belong to no class; blank URLs are
    copies of each other. An empty table gives an empty result. Other columns of DF are not looked at.
    """
    within = within or []
    rows = df.select(*within, F.col(id_col).alias("_id"), F.col(url).alias("_url")).filter("_id is not null and _url is not null")
    rows = cut(rows.withColumn("_class", invariant(F.col("_url"))))
    likely = refine(rows, [*within, "_class"])
    classes = [*within, "k1", "k2"]
    members = cut(with_key(likely, "_url", "_key").select(*within, "_id", *wide_hash(F.col("_key"))).distinct())
    sizes = members.groupBy(*classes).agg(F.min("_id").alias("id_a"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return members.join(sizes, classes).select(*within, "id_a", F.col("_id").alias("id_b"), "copies")


def collapsed(df: DataFrame, id_col: str, url: str, within: list[str] | None = None) -> DataFrame:
    """One record per address: WITHIN, ``id`` (smallest of its copies), ``copies`` and ``url`` as that record has it.

    Rows with a null URL stay, each as its own record. A row delivered twice counts once, with the smallest URL text.
    """
    within = within or []
    rows = df.select(*within, F.col(id_col).alias("id"), F.col(url).alias("url")).filter("id is not null")
    records = rows.groupBy(*within, "id").agg(F.min("url").alias("url"))
    classes = copy_classes(df, id_col, url, within)
    others = classes.filter("id_b != id_a").select(*within, F.col("id_b").alias("id")).distinct()
    firsts = classes.filter("id_b = id_a").groupBy(*within, F.col("id_a").alias("id")).agg(F.max("copies").alias("copies"))
    keys = [*within, "id"]
    return records.join(others, keys, "left_anti").join(firsts, keys, "left").select(*within, "id", F.coalesce("copies", F.lit(1)).alias("copies"), "url")


def both_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs of the two tables of problem 2 as ``tbl, id, url``."""
    training = table(spark, sf_dir, "merged_phishing_multimodal_dataset")
    scans = table(spark, sf_dir, "scan_results")
    return training.select(F.lit("merged_phishing_multimodal_dataset").alias("tbl"), F.col("record_id").alias("id"), "url").unionByName(
        scans.select(F.lit("scan_results").alias("tbl"), "id", F.col("target_url").alias("url"))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = copy_classes(both_tables(spark, sf_dir), "id", "url", ["tbl"])
    return classes.filter("id_b != id_a").select("tbl", "id_a", "id_b").distinct()


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(both_tables(spark, sf_dir), "id", "url", ["tbl"])


QUERIES = {"p2_found": p2_found, "p2_records": p2_records}
