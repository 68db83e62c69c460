"""Plans, lineage and ranking: what reaches the scan, and that running sums need no whole group in a task."""

import random

import pytest
from pyspark.sql import functions as F

from lurescope.plans.catalog import QUERIES
from lurescope.plans.lineage import cut, drop, shared_dir
from lurescope.plans.ranking import running
from lurescope.streaming.scoring import deduplicated_stream, drift_stream, scored_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["url_lexical_features", "whois_rules", "fusion_verdict", "js_signal_counts"])
def test_scores_need_no_shuffle(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text and "Python" not in text


def test_scan_reads_only_what_is_used(spark, sf_dir):
    text = plan(QUERIES["class_balance"](spark, sf_dir))
    assert "ReadSchema: struct<label:int>" in text


def test_running_against_plain(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g string, w bigint")
    got = {r.id: r.before for r in running(df, ["g"], F.floor(F.col("id") / 50), [F.col("id")], F.col("w")).collect()}
    sums = {}
    for i, g, w in rows:
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + w


def test_cut_and_drop(spark, tmp_path):
    df = cut(spark.range(10))
    assert df.count() == 10 and shared_dir(spark) in df._cut_path
    drop(df)
    with pytest.raises(Exception):
        df.count()


def test_streams(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/merged_phishing_multimodal_dataset.parquet").select("record_id", "url", "label", "collected_at")
    rows.limit(200).write.parquet(str(tmp_path / "in"))
    engines = spark.read.parquet(f"{sf_dir}/engines.parquet")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("scored", scored_stream(stream, engines)), ("unique", deduplicated_stream(stream, "record_id", "collected_at"))):
        q = df.select("record_id").writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == 200
    q = drift_stream(stream, "collected_at", "label").writeStream.format("memory").queryName("drifts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("drifts").agg(F.sum("rows")).first()[0] == 200
