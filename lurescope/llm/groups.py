"""Problem 3: splits that keep related records together."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.urlkeys import site, with_host
from lurescope.plans.lineage import cut, drop
from lurescope.plans.ranking import buckets_for, running
from lurescope.session import table


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected EDGES (u, v of bigint) as ``id, component`` (the smallest id of each).

    Every round hooks each vertex to its smallest neighbour, shortcuts the parent table by joining it with itself
    until all point to roots, and contracts the edges to those between different roots, without repeats. The edges
    left shrink by half or more each round. Hooks are pre-aggregated, so a vertex with a third of all edges costs a
    row per task; each table is written to the shared folder, so a lost executor costs only its running tasks.
    Null ends are dropped, loops keep their vertex, an empty input gives an empty result.
    """
    edges = edges.select("u", "v").filter("u is not null and v is not null")
    pairs = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    loops = pairs.filter("u = v").select(F.col("u").alias("id"))
    rounds, live, made = [], pairs.filter("u != v"), pairs
    while not live.isEmpty():
        ends = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = cut(ends.groupBy(F.col("u").alias("id")).agg(F.least("u", F.min("v")).alias("p")))
        while True:
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("_up"))
            jumped = cut(parent.join(up, "p").select("id", F.col("_up").alias("p"), (F.col("_up") != F.col("p")).alias("_moved")))
            moved = not jumped.filter("_moved").isEmpty()
            drop(parent)
            parent = jumped
            if not moved:
                break
        rounds.append(parent.select("id", "p"))
        for_u = parent.select(F.col("id").alias("u"), F.col("p").alias("_pu"))
        for_v = parent.select(F.col("id").alias("v"), F.col("p").alias("_pv"))
        roots = live.join(for_u, "u").join(for_v, "v").filter("_pu != _pv")
        smaller = cut(roots.select(F.least("_pu", "_pv").alias("u"), F.greatest("_pu", "_pv").alias("v")).distinct())
        if made is not pairs:
            drop(made)
        live, made = smaller, smaller
    if not rounds:
        return loops.select("id", F.col("id").alias("component"))
    labels = rounds[-1].withColumnRenamed("p", "component")
    for parent in reversed(rounds[:-1]):
        later = labels.withColumnRenamed("id", "p")
        labels = parent.join(later, "p", "left").select("id", F.coalesce("component", "p").alias("component"))
    alone = loops.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    return labels.unionByName(alone)


def reachable(sizes: dict[int, int], limit: int) -> list[tuple[int, int, object]]:
    """(size, number taken, totals reachable before) for each step of adding SIZES in chunks of 1, 2, 4 ... of a size.

    Totals up to LIMIT are the bits of one number, or a sorted array where so few are reachable that it is smaller.
    """
    few = 1
    for n in sizes.values():
        few = min(few * (n + 1), 1 << 62)
    steps: list[tuple[int, int, object]] = []
    mask, bits, listed = (1 << (limit + 1)) - 1, 1, np.zeros(1, "int64")
    as_list = 64 * few < limit
    for size in sorted(sizes):
        left, chunk = min(sizes[size], limit // size), 1
        while left > 0:
            take = min(chunk, left)
            steps.append((size, take, listed if as_list else bits))
            if as_list:
                more = listed + size * take
                listed = np.union1d(listed, more[more <= limit])
            else:
                bits |= (bits << (size * take)) & mask
            left, chunk = left - take, chunk * 2
    steps.append((0, 0, listed if as_list else bits))
    return steps


def nearest_total(totals: object, target: int) -> int:
    if isinstance(totals, np.ndarray):
        return int(totals[np.abs(totals - target).argmin()])
    below = (totals & ((1 << (target + 1)) - 1)).bit_length() - 1
    high = totals >> target
    above = target + ((high & -high).bit_length() - 1) if high else None
    return above if above is not None and above - target < target - below else below


def subset_counts(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many items of each size to take so that their total is as near as possible to TARGET.

    SIZES has the multiplicity of each size. Small sizes are taken where they suffice, for variety.
    """
    if target <= 0 or not sizes:
        return {}
    *steps, (_, _, totals) = reachable(sizes, 2 * target)
    total = nearest_total(totals, target)
    counts: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if isinstance(before, np.ndarray):
            at = np.searchsorted(before, total)
            there = at < len(before) and before[at] == total
        else:
            there = before >> total & 1
        if not there:
            counts[size] = counts.get(size, 0) + take
            total -= size * take
    return counts


def _allocated(sizes: dict[int, int], shares: dict[str, float], core: int) -> tuple[dict[str, dict[int, int]], bool]:
    """An allocation in which components beyond CORE rows, the largest, go where most is missing; and whether no other is nearer."""
    total = sum(s * n for s, n in sizes.items())
    missing = {k: v * total / (sum(shares.values()) or 1) for k, v in shares.items()}
    out: dict[str, dict[int, int]] = {k: {} for k in shares}
    pool, left = {}, total
    for size in sorted(sizes, reverse=True):
        now = min(sizes[size], max(0, -(-(left - core) // size)))
        need = sum(max(0, x) for x in missing.values())
        given = {k: int(now * max(0, x) / need) if need > 0 else 0 for k, x in missing.items()}
        for k, n in given.items():
            missing[k] -= n * size
        for _ in range(now - sum(given.values())):
            k = max(missing, key=lambda k: missing[k])
            given[k] += 1
            missing[k] -= size
        for k, n in given.items():
            if n:
                out[k][size] = out[k].get(size, 0) + n
        left -= now * size
        if sizes[size] > now:
            pool[size] = sizes[size] - now
    order, step, best = sorted(shares, key=lambda k: (shares[k], k)), math.gcd(*sizes), True
    for k in order[:-1]:
        for size, n in subset_counts(pool, round(missing[k])).items():
            out[k][size] = out[k].get(size, 0) + n
            pool[size] -= n
            missing[k] -= n * size
        pool = {s: n for s, n in pool.items() if n}
        best = best and abs(missing[k]) <= step / 2 + 1e-6
    for size, n in pool.items():
        out[order[-1]][size] = out[order[-1]].get(size, 0) + n
    return out, best


def allocate(sizes: dict[int, int], shares: dict[str, float], core: int = 1 << 22) -> dict[str, dict[int, int]]:
    """For each split, the number of components of each size, with totals as near as possible to the shares.

    Exact subset sums, from the smallest share up; the largest share takes what remains. They are first tried on the
    smallest components of CORE rows, after the larger ones went where most was missing. All totals are multiples of
    the sizes' common divisor, so one within half of it can't be bettered; where a split is farther off, the core is
    widened, up to all components. So the outcome is the same at any number of rows, and memory grows only as far as
    a table has too few small components to settle the gaps.
    """
    if not shares:
        return {}
    total = sum(s * n for s, n in sizes.items())
    while True:
        out, best = _allocated(sizes, shares, core)
        if best or core >= total:
            return out
        core *= 8


def owner(source: Column) -> Column:
    """The part before the slash, without case and surrounding blanks; null for a null or blank source."""
    return F.nullif(F.regexp_extract(F.lower(source), r"^[\s\p{Z}\p{C}]*([^/]*?)[\s\p{Z}\p{C}]*(?:/|$)", 1), F.lit(""))


def linked(rows: DataFrame, left: str, right: str, anchor: str) -> DataFrame:
    """Components of the values of LEFT and RIGHT that occur in one row, as ``name, component``, for each ANCHOR and value.

    Values are numbered in a written table, so that the graph is one of bigints and no hash can join strangers.
    """
    cells = rows.select(left, right, anchor).distinct()
    names = cells.select(F.explode(F.array(left, right, anchor)).alias("name")).filter("name is not null").distinct()
    numbered = cut(names.withColumn("id", F.monotonically_increasing_id()))
    u = numbered.select(F.col("name").alias(left), F.col("id").alias("u"))
    v = numbered.select(F.col("name").alias(right), F.col("id").alias("v"))
    edges = cells.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right).distinct()
    found = components(edges.join(u, left).join(v, right).select("u", "v"))
    return numbered.join(found, "id", "left").select("name", F.coalesce("component", "id").alias("component"))


def with_anchor(df: DataFrame, id_col: str, url: str, source: str, suffixes: list[str]) -> DataFrame:
    """``_id, _source, _owner, _site, _anchor``: what ties a row to others; the anchor is its owner, else its site, else itself.

    Rows without an id are left out; an id that stands several times gives a row for each.
    """
    rows = with_host(df.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"), F.col(url).alias("_url")).filter("_id is not null"), "_url", "_host")
    rows = rows.select("_id", "_source", F.concat(F.lit("o:"), owner(F.col("_source"))).alias("_owner"), F.concat(F.lit("s:"), site(F.col("_host"), suffixes)).alias("_site"))
    return rows.withColumn("_anchor", F.coalesce("_owner", "_site", F.concat(F.lit("r:"), F.col("_id").cast("string"))))


def known_suffixes(spark: SparkSession, sf_dir: str, at_most: int = 100_000) -> list[str]:
    """The suffixes of ``host_suffixes``; a list beyond AT_MOST is refused, as it becomes part of the plan."""
    rows = table(spark, sf_dir, "host_suffixes").select(F.lower(F.trim("suffix")).alias("s")).filter("s != ''").distinct().limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} host suffixes")
    return [r.s for r in rows]


def grouped_split(rows: DataFrame, labels: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``_id, component, split`` for ROWS of :func:`with_anchor` with the components LABELS of :func:`linked`.

    Only the histogram of component sizes comes to the driver: sizes that sum up to N rows have at most sqrt(2 N)
    distinct values. Which component of a size goes where follows from its rank, counted without sorting a size class
    in one task.
    """
    sizes = rows.groupBy("_anchor").agg(F.count(F.lit(1)).alias("n")).join(labels.withColumnRenamed("name", "_anchor"), "_anchor")
    sizes = cut(sizes.groupBy("component").agg(F.sum("n").alias("size")))
    histogram = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = allocate(histogram, shares)
    ranges, upto = [], {}
    for split in sorted(counts):
        for size, n in counts[split].items():
            ranges.append((size, upto.get(size, 0), upto.get(size, 0) + n, split))
            upto[size] = upto.get(size, 0) + n
    spark = rows.sparkSession
    where = spark.createDataFrame(ranges, "size bigint, low bigint, high bigint, split string")
    b = buckets_for(sum(histogram.values()))
    ranked = running(sizes, ["size"], F.pmod(F.xxhash64("component"), F.lit(b)), [F.col("component")], F.lit(1), "rank")
    chosen = ranked.join(where, "size").filter("rank >= low and rank < high").select("component", "split")
    anchors = labels.join(chosen, "component").select(F.col("name").alias("_anchor"), "component", "split")
    return rows.select("_id", "_anchor").join(anchors, "_anchor").select("_id", "component", "split")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "merged_phishing_multimodal_dataset")
    rows = cut(with_anchor(df, "record_id", "url", "dataset_source", known_suffixes(spark, sf_dir)))
    return rows, linked(rows, "_owner", "_site", "_anchor")


def source_classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per source, as written: ``source, component, members`` (sources of its component, itself included)."""
    sources = rows.filter("_owner is not null").select("_source", "_owner").distinct()
    sources = cut(sources.join(labels.withColumnRenamed("name", "_owner"), "_owner").select("component", F.col("_source").alias("source")))
    return sources.join(sources.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component")


def shared_sources(rows: DataFrame, labels: DataFrame, block: int = 1000) -> DataFrame:
    """Pairs of different sources, as written, of one component: ``source_a, source_b``, smaller first.

    The pairs are the result asked for, so their number is quadratic in a component. No task gets a component, though:
    its sources are dealt into blocks of about BLOCK, and each two blocks are joined on their own.
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = cut(source_classes(rows, labels).filter("members > 1").select("component", "source", blocks.alias("b")).withColumn("i", F.pmod(F.xxhash64("source"), F.col("b")).cast("int")))
    left = dealt.select("component", F.col("source").alias("_x"), "i", F.explode(F.sequence("i", F.col("b") - 1)).alias("j"))
    right = dealt.select("component", F.col("source").alias("_y"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"))
    pairs = left.join(right.hint("shuffle_hash"), ["component", "i", "j"]).filter("i < j or _x < _y")
    return pairs.select(F.least("_x", "_y").alias("source_a"), F.greatest("_x", "_y").alias("source_b"))


def split_shares(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """The wanted shares: a handful of rows by their meaning, one per split."""
    rows = table(spark, sf_dir, "split_targets").groupBy("split").agg(F.sum("share").alias("share")).filter("split is not null").limit(1000).collect()
    return {r["split"]: max(0.0, r["share"] or 0.0) for r in rows}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_sources(*_inputs(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as :func:`p3_found` without pairs: each source, the first source of its class, and how many others it is tied to."""
    classes = source_classes(*_inputs(spark, sf_dir))
    first = classes.groupBy("component").agg(F.min("source").alias("class"))
    return classes.join(first, "component").select(F.col("source").alias("dataset_source"), "class", (F.col("members") - 1).alias("links"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, labels = _inputs(spark, sf_dir)
    made = grouped_split(rows, cut(labels), split_shares(spark, sf_dir))
    return made.select(F.col("_id").alias("record_id"), "split")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, labels = _inputs(spark, sf_dir)
    shares = split_shares(spark, sf_dir)
    made = grouped_split(rows, cut(labels), shares).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("component").alias("groups"))
    made = cut(made)
    total = made.agg(F.sum("rows")).first()[0] or 1
    target = spark.createDataFrame(list(shares.items()), "split string, target_share double")
    return target.join(made, "split", "left").select(
        "split", "target_share", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("groups", F.lit(0)).alias("groups"), F.round(F.coalesce("rows", F.lit(0)) / F.lit(total), 9).alias("actual_share")
    )


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_splits": p3_splits, "p3_shares": p3_shares}
