"""Reading and writing training tables: Parquet, ORC, JSON or CSV with a stated schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescope.operators.dataset import fallback_corpus

RAW = T.StructType([T.StructField("URL", T.StringType()), T.StructField("Label", T.StringType())])
# The feature columns of a training table, in order.
_DOUBLES = (
    "having_ip_address", "url_length", "url_length_score", "shortening_service", "having_at_symbol",
    "double_slash_redirecting", "prefix_suffix", "having_sub_domain", "ssl_state", "domain_registration_length",
    "favicon", "port", "https_token", "request_url_ratio", "url_of_anchor_ratio",
    "links_in_tags_ratio", "sfh_external", "submitting_to_email", "abnormal_url", "redirect_count",
    "on_mouseover", "right_click_disabled", "popup_window", "iframe_hidden", "age_of_domain",
    "dns_record", "web_traffic", "page_rank", "google_index", "links_pointing_to_page",
    "statistical_report", "dom_node_count", "dom_max_depth", "graph_avg_degree",
)
TRAINING = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("dataset_source", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in _DOUBLES], T.StructField("label", T.IntegerType())]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType = TRAINING, form: str | None = None) -> DataFrame:
    """A table of any built-in format, by its ending unless FORM says otherwise; never with an inferred schema."""
    form = form or (path.rstrip("/").rpartition(".")[2] if "." in path.rpartition("/")[2] else "parquet")
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if form == "csv" else reader.format(form).load(path)


def raw_corpus(spark: SparkSession, path: str | None) -> DataFrame:
    """The raw corpus (URL, Label) at PATH, or a few stand-in rows without one."""
    return read_table(spark, path, RAW, "csv" if path.endswith("csv") else None) if path else fallback_corpus(spark)


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    writer.csv(path, header=True) if form == "csv" else writer.format(form).save(path)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], schema: T.StructType = TRAINING) -> DataFrame:
    """The table at PATH, which is built and written first where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):  # noqa: SLF001
        write_table(build().select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), path)
    return read_table(spark, path, schema, "parquet")
