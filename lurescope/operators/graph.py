"""Graph message passing: sums over edges as aggregates, and a small attention network over pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.operators.dom import STAND_INS

FEATURES, HIDDEN, HEADS = 14, 64, 2


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, degree`` of the undirected edges; both ends are counted in one pass, combined before the shuffle."""
    return edges.select(F.explode(F.array(src, dst)).alias("node")).filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def density(nodes: Column, edges: Column) -> Column:
    return edges / F.greatest(F.lit(1), nodes * (nodes - 1))


def message_sum(edges: DataFrame, values: DataFrame, src: str, dst: str, node: str, value: str, weight: Column | None = None) -> DataFrame:
    """``DST`` and the sum of the (weighted) values of its neighbours: a join on the source, then a combined sum."""
    joined = edges.join(values.select(F.col(node).alias(src), F.col(value).alias("_value")), src)
    return joined.groupBy(dst).agg(F.sum(F.col("_value") * (weight if weight is not None else F.lit(1.0))).alias("message"))


def pooled_vectors(df: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """Mean and maximum of each dimension, one after the other; SIZE columns of a fixed number, no explode."""
    parts = [F.element_at(vector, k + 1).cast("double") for k in range(size)]
    sums = df.groupBy(*keys).agg(*[F.avg(p).alias(f"_a{k}") for k, p in enumerate(parts)], *[F.max(p).alias(f"_m{k}") for k, p in enumerate(parts)])
    return sums.select(*keys, F.array(*[f"_a{k}" for k in range(size)], *[f"_m{k}" for k in range(size)]).alias("pooled"))


def seeded_weights(seed: int = 42) -> dict[str, np.ndarray]:
    """Weights of the network from a seed, as no trained ones are given: the score has a shape, not a meaning."""
    rng = np.random.default_rng(seed)
    shapes = {"w1": (FEATURES, HEADS, HIDDEN), "w2": (HIDDEN, HEADS, HIDDEN), "s1": (HEADS, HIDDEN), "d1": (HEADS, HIDDEN), "s2": (HEADS, HIDDEN), "d2": (HEADS, HIDDEN), "pool": (2 * HIDDEN, HIDDEN), "c1": (HIDDEN, 32), "c2": (32, 1)}
    return {k: rng.normal(0, (2 / (s[0] + s[-1])) ** 0.5, s).astype("float32") for k, s in shapes.items()}


WEIGHTS = "name string, shape array<int>, values array<float>"


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """Writes a network's weights as Parquet, one row an array, in place of those at PATH."""
    rows = [(k, list(w.shape), w.astype("float32").ravel().tolist()) for k, w in sorted(weights.items())]
    spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str | None, seed: int = 42) -> dict[str, np.ndarray]:
    """The weights stored at PATH, seeded ones without a path. A network is a handful of arrays, so they fit the driver."""
    if path is None:
        return seeded_weights(seed)
    rows = spark.read.schema(WEIGHTS).parquet(path).limit(1000).collect()
    return {r["name"]: np.array(r["values"], "float32").reshape(r["shape"]) for r in rows}


def attention(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, a_src: np.ndarray, a_dst: np.ndarray) -> np.ndarray:
    """One layer: attention along edges relative to the strongest edge, summed at the target, mean of the heads, ELU."""
    h = np.einsum("nf,fhd->nhd", x, w)
    e = (h * a_src).sum(-1)[src] + (h * a_dst).sum(-1)[dst]
    e = np.where(e > 0, e, 0.2 * e)
    alpha = np.exp(e - e.max(0))
    out = np.zeros_like(h)
    np.add.at(out, dst, alpha[:, :, None] * h[src])
    out = out.mean(1)
    return np.where(out > 0, out, np.expm1(np.minimum(out, 0)))


def forward(x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
    """(embedding, probability) of one page."""
    h = attention(attention(x, src, dst, w["w1"], w["s1"], w["d1"]), src, dst, w["w2"], w["s2"], w["d2"])
    embedding = np.maximum(np.concatenate([h.mean(0), h.max(0)]) @ w["pool"], 0)
    score = np.maximum(embedding @ w["c1"], 0) @ w["c2"]
    return embedding, float(1 / (1 + np.exp(-score[0])))


def graph_scores(nodes: DataFrame, key: str, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``KEY, gnn_score, embedding`` of every page from the rows of ``node_features``: at most 200 nodes a page, so groups are small."""
    held = nodes.sparkSession.sparkContext.broadcast(weights or seeded_weights())
    kind = nodes.schema[key].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, items in zip(batch[key], batch["items"]):
                items = sorted(items, key=lambda r: r["idx"])
                x = np.array([r["x"] for r in items], "float32")
                if items[0]["stand_in"] is not None:
                    src, dst = np.array(STAND_INS[items[0]["stand_in"]]["edges"], "int64").T
                else:
                    links = [(r["parent_idx"], r["idx"]) for r in items if not pd.isna(r["parent_idx"])]
                    both = links + [(b, a) for a, b in links] or [(0, 0)]
                    src, dst = np.array(both, "int64").T
                embedding, p = forward(x, src, dst, held.value)
                rows.append((page, p, embedding.tolist()))
            yield pd.DataFrame(rows, columns=[key, "gnn_score", "embedding"])

    grouped = nodes.groupBy(key).agg(F.collect_list(F.struct("idx", "parent_idx", "x", "stand_in")).alias("items"))
    return grouped.mapInPandas(score, f"{key} {kind}, gnn_score double, embedding array<float>")


def template_graph(rows: DataFrame, key: str, size: int = 15) -> DataFrame:
    """``KEY, node, x``: the training graph of a table row, three of its features set into a fixed tree of SIZE nodes."""
    has = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in rows.columns else F.lit(0.0)
    sfh, frame, anchor = has("sfh_external"), has("iframe_hidden"), has("url_of_anchor_ratio")
    each = rows.select(key, sfh.alias("_s"), frame.alias("_f"), anchor.alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("node"))
    hot = F.when(F.col("node") < 4, F.col("node")).otherwise(F.col("node") % 5 + 4)
    value = lambda k: (
        F.when(k == 10, F.when(F.col("node") >= 4, F.col("node") / F.lit(float(size))).otherwise(0.0))
        .when(k == 11, F.when(F.col("node").isin(1, 2), F.col("_s")).when(F.col("node") >= 4, F.col("_a")).otherwise(0.0))
        .when(k == 12, F.when(F.col("node") == 1, F.col("_f")).otherwise(0.0))
        .otherwise((k == F.col("_hot")).cast("double"))
    )
    return each.withColumn("_hot", hot).select(key, "node", F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), value).alias("x"))


def template_edges(size: int = 15) -> list[tuple[int, int]]:
    """The edges of that tree, both ways: root to form, form to its two fields, root to all others."""
    down = [(0, 1), (1, 2), (1, 3), *[(0, k) for k in range(4, size)]]
    return [e for a, b in down for e in ((a, b), (b, a))]
