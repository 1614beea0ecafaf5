"""Bootstrap and permutation inference with hashed randomness, the same in any engine and on any cluster.

A replicate draws units by a hash of seed, replicate and place. Units are clusters already, so their
number is small beside the rows: up to ``BROADCAST_UNITS`` of them are sent to all tasks, which share the
replicates, so that a replicate is one number and no draw leaves its task. Beyond that, draws are rows
that are joined to numbered clusters and summed on the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ids import hash_int
from tessera.functions.md5 import hash_ints
from tessera.session import durable, prepare

#: Most clusters that are broadcast, at some 30 bytes each, and most values of the hierarchical form, at 8 bytes and 12 for each inner unit.
BROADCAST_UNITS, BROADCAST_VALUES = 1_000_000, 4_000_000
#: Outer units of the hierarchical form that are drawn at once.
SLOTS = 20_000
#: Replicates of one task.
REPS = 64


def cluster_sums(df: DataFrame, group: Sequence[str], cluster: str, x: str) -> DataFrame:
    """``group, cluster, s, n`` of finite values."""
    from tessera.functions.numbers import finite

    return df.where(finite(F.col(x))).groupBy(*group, F.col(cluster).alias("cluster")).agg(F.sum(x).alias("s"), F.count("*").alias("n"))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``i``, a row's place in its group from 0, and ``k``, the group's number of rows: from range partitions and their counts."""
    placed = durable(rows.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*group)
    starts = sizes.withColumn("_start", F.sum("_n").over(w.orderBy("_p")) - F.col("_n")).withColumn("k", F.sum("_n").over(w)).drop("_n")
    starts = starts.withColumnsRenamed({c: f"_{c}" for c in group}).withColumnRenamed("_p", "_q")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] + [F.col("_p") == F.col("_q")]
    here = F.row_number().over(W.partitionBy(*group, "_p").orderBy(*order)) - 1
    met = placed.withColumn("_here", here).join(F.broadcast(starts), same)
    return met.select(*rows.columns, (F.col("_start") + F.col("_here")).alias("i"), "k")


def hashed(seed: int, *places: int) -> int:
    """``hash_int`` of whole numbers."""
    return int.from_bytes(hashlib.md5("\x1f".join(map(str, (seed, *places))).encode()).digest()[:4], "big")


def hashes(seed: int, rep: int, n: int) -> np.ndarray:
    """``hash_int(seed, rep, i)`` for each i below ``n``."""
    return hash_ints((seed, rep), np.arange(n)).astype(np.int64)


def replicated(spark: SparkSession, reps: int, of: Callable[[int], list[tuple[int, float]]]) -> DataFrame:
    """``rep, _at, value``: what ``of`` gives for each replicate, in tasks of some ``REPS`` of them."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(rep, g, v) for rep in b.column(0).to_pylist() for g, v in of(rep)]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["rep", "_at", "value"])

    return spark.range(0, reps, 1, max(1, -(-reps // REPS))).mapInArrow(run, "rep bigint, _at bigint, value double")


def by_group(clusters: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[tuple[np.ndarray, np.ndarray]]]:
    """A table ``group, _g`` that numbers the groups, and the ordered clusters' sums and numbers of each."""
    t = clusters.orderBy(*group, "cluster").select(*group, "s", "n").toArrow()
    keys = list(zip(*(t[c].to_pylist() for c in group), strict=True))
    starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]] if keys else []
    s, n = t["s"].to_numpy().astype(float), t["n"].to_numpy().astype(float)
    sums = [(s[a:b], n[a:b]) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
    spark, fields = clusters.sparkSession, [f for f in clusters.schema.fields if f.name in group]
    names = spark.createDataFrame([(*keys[a], g) for g, a in enumerate(starts)], ", ".join(f"`{c}` {dict(clusters.dtypes)[c]}" for c in group) + ", _g bigint") if fields else None
    return names, sums


def draws(clusters: DataFrame, group: Sequence[str], reps: int, seed: int) -> DataFrame:
    """``group, rep, i``: with replacement, as many of the numbered clusters per replicate as there are."""
    slots = clusters.select(*group, "k", F.col("i").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return slots.select(*group, "rep", (hash_int(F.lit(seed), "rep", "slot") % F.col("k")).alias("i"))


def bootstrap(df: DataFrame, group: Sequence[str], cluster: str, x: str, reps: int = 10_000, seed: int = 1729, pooled: bool = False, units: int = BROADCAST_UNITS) -> DataFrame:
    """``group, rep, value``: of each resample of clusters the mean of their means or, ``pooled``, of their rows. At most ``units`` clusters are broadcast."""
    group = list(group)
    c = durable(cluster_sums(df, group, cluster, x))
    if c.count() > units:
        c = durable(numbered(c, group, ["cluster"]))
        met = draws(c, group, reps, seed).join(c.select(*group, "i", "s", "n"), [*group, "i"])
        return met.groupBy(*group, "rep").agg((F.sum("s") / F.sum("n") if pooled else F.avg(F.col("s") / F.col("n"))).alias("value"))
    names, sums = by_group(c, group)
    sent = df.sparkSession.sparkContext.broadcast(sums)

    def of(rep: int) -> list[tuple[int, float]]:
        h = hashes(seed, rep, max(map(len, (s for s, _ in sent.value)), default=0))
        out = []
        for g, (s, n) in enumerate(sent.value):
            i = h[: len(s)] % len(s)
            out.append((g, float(s[i].sum() / n[i].sum() if pooled else (s[i] / n[i]).mean())))
        return out

    return replicated(df.sparkSession, reps, of).join(F.broadcast(names), F.col("_at") == F.col("_g")).select(*group, "rep", "value")


def interval(replicates: DataFrame, group: Sequence[str], level: float = 0.95, by_rank: bool = False) -> DataFrame:
    """Percentile interval of replicates: between neighbours or, ``by_rank``, the value at the rank floor(q n)."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    if not by_rank:
        return replicates.groupBy(*group).agg(F.percentile("value", F.lit(lo)).alias("low"), F.percentile("value", F.lit(hi)).alias("high"))
    w = W.partitionBy(*group)
    r = replicates.withColumn("_r", F.row_number().over(w.orderBy("value", "rep")) - 1).withColumn("_n", F.count("*").over(w))
    pick = lambda q: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * q), F.col("value")))
    return r.groupBy(*group).agg(pick(lo).alias("low"), pick(hi).alias("high"))


def cluster_estimate(df: DataFrame, group: Sequence[str], cluster: str, x: str) -> DataFrame:
    """``group, clusters, rows, pooled, clustered``: both point estimates, which differ when clusters do in size."""
    c = cluster_sums(df, group, cluster, x)
    return c.groupBy(*group).agg(F.count("*").alias("clusters"), F.sum("n").alias("rows"), (F.sum("s") / F.sum("n")).alias("pooled"), F.avg(F.col("s") / F.col("n")).alias("clustered"))


def _runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of lengths ``n`` (1 at least): where each starts, each place's run, and its place in it."""
    starts = np.cumsum(n, dtype=np.int64) - n
    run = np.repeat(np.arange(len(n)), n)
    return starts, run, np.arange(len(run)) - starts[run]


def _drawn(head: Sequence[int], n: np.ndarray, *at: np.ndarray) -> np.ndarray:
    """Hashes modulo ``n``; of 1 there is but one choice."""
    out, some = np.zeros(len(n), np.int64), np.flatnonzero(n > 1)
    out[some] = hash_ints(head, *(x[some] for x in at)) % n[some]
    return out


def hierarchical_bootstrap(df: DataFrame, outer: str, inner: str, x: str, reps: int = 10_000, seed: int = 1729, units: int = BROADCAST_VALUES) -> DataFrame:
    """``rep, value``: outer units are drawn, inner ones within each draw, and values within each of those; mean of means at each level.

    Up to ``units`` values are broadcast, and a task draws from them as arrays; beyond that the draws are
    replicates x rows that are joined and summed on the way.
    """
    from tessera.functions.numbers import finite

    rows = durable(df.where(finite(F.col(x))).select(F.col(outer).alias("o"), F.col(inner).alias("u"), F.col(x).cast("double").alias("x")))
    if rows.count() <= units:
        t = rows.orderBy("o", "u", "x").toArrow()
        code = lambda c: np.diff(t[c].combine_chunks().dictionary_encode("encode").indices.to_numpy(), prepend=-1) != 0
        new = code("o")
        cells = np.flatnonzero(new | code("u"))
        first = np.searchsorted(cells, np.flatnonzero(new)).astype(np.int32)
        sizes = [np.diff(a, append=end).astype(np.uint32) for a, end in ((cells, len(new)), (first, len(cells)))]
        sent = df.sparkSession.sparkContext.broadcast((t["x"].to_numpy(), cells.astype(np.int64), sizes[0], first, sizes[1]))

        def of(rep: int) -> list[tuple[int, float]]:
            values, cells, n_values, first, n_cells = sent.value
            k, total = len(first), 0.0
            for a in range(0, k, SLOTS):
                at = np.arange(a, min(a + SLOTS, k))
                i = hash_ints((seed, rep), at) % np.uint32(k)
                n = n_cells[i]
                starts, run, t = _runs(n)
                slot = at[run]
                cell = first[i][run] + _drawn((seed + 1, rep), n[run], slot, t)
                m = n_values[cell]
                heads, of_cell, z = _runs(m)
                x = values[cells[cell][of_cell] + _drawn((seed + 2, rep), m[of_cell], slot[of_cell], t[of_cell], z)]
                total += float((np.add.reduceat(np.add.reduceat(x, heads) / m, starts) / n).sum())
            return [(0, total / k)] if k else []

        return replicated(df.sparkSession, reps, of).select("rep", "value")
    cell = W.partitionBy("o", "u")
    rows = rows.withColumn("v", F.row_number().over(cell.orderBy("x")) - 1)
    cells = rows.groupBy("o", "u").agg(F.count("*").alias("kv"))
    w = W.partitionBy("o")
    cells = durable(cells.withColumn("j", F.row_number().over(w.orderBy("u")) - 1).withColumn("kj", F.count("*").over(w)))
    outers = numbered(cells.groupBy("o").agg(F.first("kj").alias("kj")).withColumn("all", F.lit(0)), ["all"], ["o"])
    draw = lambda level, n, *at: hash_int(F.lit(seed + level), "rep", *at) % F.col(n)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).alias(name)
    first = outers.select("k", F.col("i").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    first = first.select("rep", "slot", draw(0, "k", "slot").alias("i")).join(outers.select("i", "o", "kj"), "i")
    second = first.select("rep", "slot", "o", "kj", each("kj", "t")).withColumn("j", draw(1, "kj", "slot", "t")).join(cells.select("o", "u", "j", "kv"), ["o", "j"])
    third = second.select("rep", "slot", "t", "o", "u", "kv", each("kv", "z")).withColumn("v", draw(2, "kv", "slot", "t", "z"))
    met = third.join(rows, ["o", "u", "v"]).groupBy("rep", "slot", "t").agg(F.avg("x").alias("m"))
    return met.groupBy("rep", "slot").agg(F.avg("m").alias("m")).groupBy("rep").agg(F.avg("m").alias("value"))


def sign_flip_test(df: DataFrame, group: Sequence[str], cluster: str, x: str, null: float = 0.0, reps: int = 10_000, seed: int = 7, units: int = BROADCAST_UNITS) -> DataFrame:
    """``group, clusters, mean, p_value``: two-sided, (as extreme + 1) / (reps + 1), over sign flips of cluster means less ``null``."""
    group = list(group)
    c = durable(cluster_sums(df, group, cluster, x))
    known = c.groupBy(*group).agg(F.count("*").alias("clusters"), F.avg(F.col("s") / F.col("n") - null).alias("mean"))
    if c.count() > units:
        d = numbered(c, group, ["cluster"]).withColumn("d", F.col("s") / F.col("n") - null)
        flips = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        sign = F.when(hash_int(F.lit(seed), "rep", "i") % 2 == 0, 1).otherwise(-1)
        each = flips.groupBy(*group, "rep").agg(F.avg(sign * F.col("d")).alias("value"))
    else:
        names, sums = by_group(c, group)
        sent = df.sparkSession.sparkContext.broadcast(sums)

        def of(rep: int) -> list[tuple[int, float]]:
            sign = 1 - 2 * (hashes(seed, rep, max(map(len, (s for s, _ in sent.value)), default=0)) % 2)
            return [(g, float((sign[: len(s)] * (s / n - null)).mean())) for g, (s, n) in enumerate(sent.value)]

        each = replicated(df.sparkSession, reps, of).join(F.broadcast(names), F.col("_at") == F.col("_g")).select(*group, "rep", "value")
    each = each.withColumnsRenamed({g: f"_own_{g}" for g in group})
    met = each.join(known, [F.col(f"_own_{g}").eqNullSafe(F.col(g)) for g in group])
    extreme = F.count_if(F.abs(F.col("value")) >= F.abs(F.col("mean")) - 1e-12)
    return met.groupBy(*group, "clusters", "mean").agg(((extreme + 1) / (F.count("*") + 1)).alias("p_value"))


def preference_value(label: Column) -> Column:
    """A is a half, a tie nothing, B minus a half; anything else is an error."""
    return F.when(label == "A", 0.5).when(label == "tie", 0.0).when(label == "B", -0.5).otherwise(F.raise_error(F.lit("unknown preference")).cast("double"))


def success_modes(low: Column, high: Column, margin: float) -> dict[str, Column]:
    """Superior above 0 and not inferior above minus the margin, both strictly; ``at_margin`` is the form with equality that another report uses."""
    return {"superior": low > 0, "non_inferior": low > -margin, "at_margin": low >= -margin, "inferior": high < 0}


def gate(checks: DataFrame, name: str, ok: str) -> DataFrame:
    """``passed, checks, failed``: all checks but diagnostic ones (``_diag_`` in the name) must hold."""
    counts = ~F.col(name).contains("_diag_")
    bad = counts & ~F.coalesce(F.col(ok), F.lit(False))
    return checks.agg((F.count_if(bad) == 0).alias("passed"), F.count_if(counts).alias("checks"), F.array_sort(F.collect_list(F.when(bad, F.col(name)))).alias("failed"))


def within_between(df: DataFrame, group: str, action: str, key: str, items: Column, least_ratio: float = 1.1) -> DataFrame:
    """One row ``n_within, within_distance, n_between, between_distance, ratio, passed``: token distances of the responses of a group.

    Within are all pairs of a group's responses of one action; between are the pairs of two of its
    actions at the same place in key order, as far as both go. Pairs grow with the square of one group's
    responses of one action, which a panel holds to its number of seeds; groups meet by equi-joins only.
    """
    from tessera.functions.text import jaccard_distance

    w = W.partitionBy("g", "a").orderBy("k")
    r = df.select(F.col(group).alias("g"), F.col(action).alias("a"), F.col(key).alias("k"), items.alias("s")).where("a is not null")
    r = r.withColumn("i", F.row_number().over(w))
    other = r.select(*[F.col(c).alias(f"{c}2") for c in ("g", "a", "i", "s")])
    same = F.col("g").eqNullSafe(F.col("g2"))
    within = r.join(other, same & (F.col("a") == F.col("a2")) & (F.col("i") < F.col("i2"))).select(F.lit(True).alias("w"), jaccard_distance(F.col("s"), F.col("s2")).alias("d"))
    between = r.join(other, same & (F.col("i") == F.col("i2")) & (F.col("a") < F.col("a2"))).select(F.lit(False).alias("w"), jaccard_distance(F.col("s"), F.col("s2")).alias("d"))
    out = within.unionByName(between).agg(
        F.count_if(F.col("w")).alias("n_within"),
        F.avg(F.when(F.col("w"), F.col("d"))).alias("within_distance"),
        F.count_if(~F.col("w")).alias("n_between"),
        F.avg(F.when(~F.col("w"), F.col("d"))).alias("between_distance"),
    )
    out = out.withColumn("ratio", F.try_divide("between_distance", "within_distance"))
    return out.withColumn("passed", F.coalesce(F.col("ratio") > least_ratio, F.lit(False)))
