"""The registry of deployed models and the scan table, as Parquet tables that are only appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODELS = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("model_name", T.StringType()), T.StructField("version", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("accuracy", "precision", "recall", "f1_score")]
    + [T.StructField("weights_filepath", T.StringType()), T.StructField("deployed_at", T.TimestampType())]
)
SCORES = "graph double, panel double, visual double, classical double, text double, anomaly double, intel double"


def append_models(models: DataFrame, path: str) -> None:
    """Appends measured models (all columns of MODELS but id and deployed_at); the id is a random one, as writers may be many."""
    rows = models.withColumn("id", F.expr("uuid()")).withColumn("deployed_at", F.current_timestamp())
    rows.select(*MODELS.names).write.mode("append").parquet(path)


def listed_models(spark: SparkSession, path: str) -> DataFrame:
    """The registry as shown: accuracy with two digits, time in ISO form."""
    rows = spark.read.schema(MODELS).parquet(path)
    return rows.select("id", "model_name", "version", F.format_string("%.2f%%", "accuracy").alias("accuracy"), F.date_format("deployed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("deployed_at"))


def add_missing(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of WANTED whose KEY does not exist yet, one each: insert if absent."""
    return wanted.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def latest_deliveries(df: DataFrame, key: str, arrived: str) -> DataFrame:
    """One row per KEY, the one that arrived last: rows delivered again replace the earlier ones."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), arrived).alias("_row")).select(key, "_row.*")


def opened_scores(scans: DataFrame) -> DataFrame:
    """Scan rows with the JSON of their modality scores as a map and the number of their evidence rows."""
    parsed = F.from_json("modality_scores", "map<string,double>")
    listed = F.from_json("xai_evidence_matrix", "array<map<string,string>>")
    return scans.select("id", F.map_entries(parsed).alias("scores"), F.coalesce(F.size(listed), F.lit(0)).alias("evidence_rows"))
