"""Tables that cut lineage: where they lie, how long they live."""

import gc
import time

import pytest
from pyspark.sql import functions as F

from lurescope.plans import lineage


def left(spark):
    for _ in range(20):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if lineage.sweep(spark) == 0:
            return 0
        time.sleep(0.2)
    return lineage.sweep(spark)


def test_table_lives_as_long_as_a_plan(spark):
    made = lineage.cut(spark.range(10))
    path = made._cut_path
    derived = made.select((F.col("id") * 2).alias("x")).filter("x > 4").groupBy("x").count()
    del made
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        lineage.sweep(spark)
    assert derived.count() == 7
    del derived
    assert left(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_drop_is_at_once(spark):
    made = lineage.cut(spark.range(3))
    lineage.drop(made)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(made._cut_path)


class Conf:
    def __init__(self, **given):
        self.given = {k.replace("__", "."): v for k, v in given.items()}

    def get(self, key, default=None):
        return self.given.get(key, default)


class Session:
    def __init__(self, master, **conf):
        self.conf = Conf(**conf)
        self.sparkContext = type("Context", (), {"master": master})()


def test_where_tables_lie():
    assert lineage.shared_dir(Session("yarn", spark__checkpoint__dir="hdfs:///x", lurescope__shared__dir="y")) == "hdfs:///x"
    assert lineage.shared_dir(Session("yarn", lurescope__shared__dir="s3a://b/y")) == "s3a://b/y"
    assert lineage.shared_dir(Session("local[4]", spark__sql__warehouse__dir="file:/w/")) == "file:/w/lurescope-cuts"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            lineage.shared_dir(Session(master, spark__sql__warehouse__dir="file:/w"))
