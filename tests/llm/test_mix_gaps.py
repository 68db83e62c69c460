"""Problem 6: no gap stays open in which an unused document fits."""

import random

import pytest
from pyspark.sql import functions as F

from lurescope.llm import mixing


def test_no_unused_document_fits(spark):
    """Lengths with a long tail, so that passes end early again and again."""
    docs = [(i, f"s{i % 6}", 1 << (i // 6 % 24), 1.0) for i in range(6 * 48)]
    rows = spark.createDataFrame(docs, "id bigint, source string, tokens bigint, weight double")
    targets = spark.createDataFrame([(f"m{k}", f"s{i}", 1.0, 1) for k in range(4) for i in range(6)], "mix_name string, source string, target_share double, max_repeats int")
    total = 6 * 16_777_215.0
    used = mixing.mixed(rows, targets, total).collect()
    assert all(r.uses == 1 for r in used)
    for mix in {r.mix_name for r in used}:
        for s in {d[1] for d in docs}:
            taken = {r.id for r in used if (r.mix_name, r.source) == (mix, s)}
            gap = total / 6 - sum(t for i, source, t, _ in docs if i in taken)
            assert gap >= 0
            assert not any(t <= gap for i, source, t, _ in docs if source == s and i not in taken)


def greedy(docs, budget):
    """Documents one by one in the order of their keys, each that fits."""
    taken = set()
    for _, i, t in docs:
        if t <= budget:
            budget -= t
            taken.add(i)
    return taken


@pytest.mark.parametrize("heavy, light", [(1.0, 0.05), (1.0, 0.001)])
def test_is_the_sample_of_smallest_keys(spark, heavy, light):
    """The keys of light documents don't run together: the draw is that of -ln(u) / weight in one sort, and quantile buckets hold alike many rows."""
    rng = random.Random(4)
    docs = [(i, "s", rng.randint(1, 40), heavy if i % 4 == 0 else light) for i in range(3000)]
    rows = spark.createDataFrame(docs, "id bigint, source string, tokens bigint, weight double")
    keyed = rows.withColumn("mix_name", F.lit("m")).withColumn("_key", mixing.sampling_key(7, F.col("weight"), "mix_name", "id"))
    keys = keyed.select("_key", "id", "tokens").collect()
    assert len({r[0] for r in keys}) == 3000
    sizes = [r["count"] for r in mixing.with_buckets(keyed, 300).groupBy("_quantile").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 330
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = {r.id for r in mixing.mixed(rows, targets, 9000.0).collect()}
    assert got == greedy(sorted(tuple(r) for r in keys), 9000.0)
    drawn = sum(i % 4 == 0 for i in got) / len(got)
    assert drawn > 0.5


def test_quality_is_learned(spark):
    rows = [(i, "en", 10, 45) for i in range(50)] + [(100, "EN-us", 40, 45), (101, "de", 10, 30), (102, "de", 10, 30), (103, None, 0, 0), (104, None, 5, 500)]
    got = {r.id: r.weight for r in mixing.with_quality(spark.createDataFrame(rows, "id int, lang string, tokens bigint, chars int")).collect()}
    assert got[0] == 1.0 and got[100] < 0.15 and got[101] == 1.0 and got[103] == 0.05 and got[104] == 1.0 and len(got) == 55
