"""Problem 5: filling containers of fixed capacity, best fit decreasing over the histogram of sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.tokens import token_sizes
from lurescope.plans.lineage import cut
from lurescope.plans.ranking import buckets_for, running
from lurescope.session import table


class Remaining:
    """A segment tree over the remaining capacities 0..C: which of them some open container has."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def push(self, room: int, first: int, count: int) -> None:
        """COUNT containers numbered from FIRST have ROOM left; full ones are not kept."""
        if room and count:
            self.runs.setdefault(room, []).append((first, count))
            at = self.leaves + room
            while at and not self.open[at]:
                self.open[at] = 1
                at >>= 1

    def pop(self, room: int) -> tuple[int, int]:
        runs = self.runs[room]
        run = runs.pop()
        if not runs:
            del self.runs[room]
            at = self.leaves + room
            self.open[at] = 0
            while at > 1 and not (self.open[at] or self.open[at ^ 1]):
                at >>= 1
                self.open[at] = 0
        return run

    def tightest(self, size: int) -> int | None:
        """The smallest room of at least SIZE of any open container, in logarithmic time."""
        at = self.leaves + size
        if self.open[at]:
            return size
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit decreasing of all items at once; items of one size are alike, so their number is enough.

    Returns the steps (size, first rank, first container, items a container) and the number of containers. Each item
    goes to the tightest open container that takes it, as if placed one by one: the tightest one stays the tightest
    until it can't take another item of this size, and containers with the same room are filled as a run.
    """
    rooms, steps, used = Remaining(capacity), [], 0
    for size in sorted(histogram, reverse=True):
        done, number = 0, histogram[size]
        while done < number:
            room = rooms.tightest(size)
            if room is None:
                room, first, count = capacity, used, -(-(number - done) // (capacity // size))
                used += count
            else:
                first, count = rooms.pop(room)
            each = room // size
            full = min(count, (number - done) // each)
            if full:
                steps.append((size, done, first, each))
                rooms.push(room - each * size, first, full)
                done += full * each
            if full < count:
                rest = min(number - done, each)
                if rest:
                    steps.append((size, done, first + full, each))
                    rooms.push(room - rest * size, first + full, 1)
                    done += rest
                    full += 1
                rooms.push(room, first + full, count - full)
    return steps, used


def known_specs(specs: DataFrame, at_most: int = 1000) -> list[tuple[int, int]]:
    """The usable container sizes (at most AT_MOST, else an error): spec_id and a capacity above 0; of repeats the largest."""
    rows = specs.select("spec_id", F.col("capacity_tokens").alias("capacity")).filter("spec_id is not null and capacity > 0")
    rows = rows.groupBy("spec_id").agg(F.max("capacity").alias("capacity")).limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} container sizes")
    return sorted((r.spec_id, r.capacity) for r in rows)


def pieces_of(sizes: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """``spec_id, capacity, id, piece, first_token, size``: a text is cut only where it exceeds the capacity."""
    listed = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity")) for s, c in specs])
    empty = F.array().cast("array<struct<spec_id:int,capacity:int>>")
    each = sizes.select("id", "tokens").filter("id is not null and tokens > 0").withColumn("_spec", F.explode(listed if specs else empty)).select("id", "tokens", "_spec.*")
    each = each.withColumn("piece", F.explode(F.expr("sequence(0, cast((tokens - 1) div capacity as int))")))
    return each.select("spec_id", "capacity", "id", "piece", (F.col("piece") * F.col("capacity")).cast("bigint").alias("first_token"), F.least(F.col("capacity").cast("bigint"), F.expr("tokens - piece * cast(capacity as bigint)")).alias("size"))


def packed(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, capacity, id, piece, first_token, size, container`` for SIZES (id, tokens) and SPECS.

    The packing is the one of best fit decreasing over *all* pieces, not of each partition: only the number of pieces
    of each size reaches the driver, at most one number per size up to the capacity, and the placement of the k-th
    piece of a size follows from its rank, which is counted in buckets without sorting a size in one task. Texts
    without tokens need no container and have no row. The steps of the packing are bounded by the capacities, too.
    """
    spark = sizes.sparkSession
    pieces = pieces_of(sizes, known_specs(specs))
    counted = pieces.groupBy("spec_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    histograms: dict[tuple[int, int], dict[int, int]] = {}
    for r in counted:
        histograms.setdefault((r.spec_id, r.capacity), {})[r["size"]] = r.n
    places = {spec: Places(h, best_fit_decreasing(h, capacity)[0]) for (spec, capacity), h in histograms.items()}
    held = spark.sparkContext.broadcast(places)

    @F.pandas_udf("bigint")
    def place(spec: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(spec), "int64")
        for one in spec.unique():
            mine = (spec == one).to_numpy()
            out[mine] = held.value[one].container(size.to_numpy()[mine], rank.to_numpy()[mine])
        return pd.Series(out)

    b = buckets_for(sum(r.n for r in counted))
    ranked = running(pieces, ["spec_id", "size"], F.pmod(F.xxhash64("id"), F.lit(b)), [F.col("id"), F.col("piece")], F.lit(1), "rank")
    return ranked.select("spec_id", "capacity", "id", "piece", "first_token", "size", place("spec_id", "size", "rank").alias("container"))


class Places:
    """The steps of a packing, to find the container of the RANK-th item of a SIZE.

    Steps are keyed by the number of items of smaller sizes plus their first rank: exact for any sizes and ranks whose
    number of items fits 63 bits.
    """

    def __init__(self, histogram: dict[int, int], steps: list[tuple[int, int, int, int]]) -> None:
        self.sizes = np.array(sorted(histogram), "int64")
        numbers = np.array([histogram[s] for s in self.sizes.tolist()], "int64")
        self.starts = np.cumsum(numbers) - numbers
        size, rank, first, each = np.array(steps, "int64").reshape(-1, 4).T
        keys = self.key(size, rank)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.first, self.each = keys[order], rank[order], first[order], each[order]

    def key(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return self.starts[np.searchsorted(self.sizes, size)] + rank

    def container(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, self.key(size, rank), side="right") - 1
        return self.first[at] + (rank - self.rank[at]) // self.each[at]


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(cut(token_sizes(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "pack_specs"))


def p5_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("spec_id", F.col("id").alias("doc_id"), "piece", "first_token", F.col("size").alias("tokens"), "container")


def p5_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec the containers used, beside the fewest that the tokens could fill, and the share of space used."""
    bins = _packed(spark, sf_dir).groupBy("spec_id", "capacity").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens"), (F.max("container") + 1).alias("containers"))
    space = F.col("containers") * F.col("capacity")
    return bins.select("spec_id", "capacity", "pieces", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest_possible"), F.round(F.col("tokens") / space, 9).alias("fill"))


QUERIES = {"p5_containers": p5_containers, "p5_fill": p5_fill}
