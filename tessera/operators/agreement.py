"""Agreement between raters, and health of rated dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def median_deviation(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """``med`` and ``mad``, the median of absolute deviations from it.

    A group's values are gathered (they are the judges of one item) and reduced in place.
    """
    g = df.groupBy(*group).agg(F.median(x).alias("med"), F.collect_list(x).alias("_x"))
    each = g.select(*group, "med", F.explode("_x").alias("_x"))
    return each.groupBy(*group, "med").agg(F.median(F.abs(F.col("_x") - F.col("med"))).alias("mad"))


def fleiss_kappa(votes: DataFrame, item: str, label: str) -> DataFrame:
    """``items, raters, kappa``; null unless all items have the same number (two or more) of votes, and there are two items."""
    n = votes.groupBy(item, label).agg(F.count("*").alias("n"))
    per = n.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("s"))
    agree = (F.col("s") - F.col("r")) / (F.col("r") * (F.col("r") - 1))
    whole = per.agg(F.count("*").alias("items"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg(agree).alias("p"))
    share = n.groupBy(label).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum("n").alias("t"))
    both = whole.join(F.broadcast(share))
    pe = F.col("sq") / (F.col("t") * F.col("t"))
    fit = (F.col("lo") == F.col("hi")) & (F.col("lo") >= 2) & (F.col("items") >= 2) & (pe < 1)
    return both.select("items", F.col("hi").alias("raters"), F.when(fit, (F.col("p") - pe) / (1 - pe)).alias("kappa"))


def majority(votes: DataFrame, item: str, label: str, tie: str = "tie") -> DataFrame:
    """The most frequent label of each item; several of them make ``tie``."""
    n = votes.groupBy(item, label).agg(F.count("*").alias("n"))
    g = n.groupBy(item).agg(F.max(F.struct("n", label)).alias("best"), F.collect_list("n").alias("ns"), F.sum("n").alias("votes"))
    shared = F.size(F.filter("ns", lambda x: x == F.col("best.n"))) > 1
    return g.select(item, "votes", F.when(shared, F.lit(tie)).otherwise(F.col(f"best.{label}")).alias("majority"))


def unblind(label: Column, swap: Column) -> Column:
    """Undo a swap of the sides."""
    return F.when(swap & (label == "A"), "B").when(swap & (label == "B"), "A").otherwise(label)


def average_rank(df: DataFrame, x: str, group: Sequence[str], name: str) -> DataFrame:
    """Ranks within groups, ties sharing their mean. Ties are counted first, so that the window sees each value once."""
    n = df.groupBy(*group, x).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*group).orderBy(x))
    ranks = n.withColumn(name, upto - (F.col("_n") - 1) / 2).drop("_n")
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*group, x)]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    return df.alias("l").join(ranks.alias("r"), cond).select("l.*", f"r.{name}")


def spearman(df: DataFrame, x: str, y: str, group: Sequence[str]) -> DataFrame:
    """Rank correlation per group; null for fewer than three rows or a constant side."""
    r = average_rank(average_rank(df, x, group, "_rx"), y, group, "_ry")
    fit = (F.count("*") >= 3) & (F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0)
    return r.groupBy(*group).agg(F.count("*").alias("n"), F.when(fit, F.corr("_rx", "_ry")).alias("spearman"))


def weighted_kappa(df: DataFrame, a: str, b: str, group: Sequence[str]) -> DataFrame:
    """Quadratic weighted kappa from first and second moments, which need no confusion matrix."""
    fit = F.avg(F.col(a) * F.col(a)) + F.avg(F.col(b) * F.col(b)) - 2 * F.avg(a) * F.avg(b)
    off = F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.when(fit > 0, 1 - off / fit).alias("kappa"))


def calibration(df: DataFrame, human: str, judge: str, group: Sequence[str]) -> DataFrame:
    """Mean absolute error, share within one, share equal."""
    off = F.abs(F.col(human) - F.col(judge))
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(off).alias("mae"), F.avg((off <= 1).cast("double")).alias("within_one"), F.avg((off == 0).cast("double")).alias("exact")
    )


def dimension_health(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Per dimension: mean, deviation, non-zero share, distinct values, constant; one aggregate over all."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("x")) for c in dims]))
    long = df.select(stack.alias("s")).select("s.*")
    return long.groupBy("dimension").agg(
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.avg((F.col("x") != 0).cast("double")).alias("nonzero"),
        F.count_distinct("x").alias("distinct_values"),
        (F.stddev_pop("x") < 1e-9).alias("constant"),
    )


def duplicate_dimensions(df: DataFrame, dims: Sequence[str], least: float = 0.98) -> DataFrame:
    """Per pair of dimensions: share of equal values, correlation, and whether one is a copy of the other."""
    pairs = [(a, b) for i, a in enumerate(dims) for b in dims[i + 1 :]]
    stack = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = df.select(F.explode(stack).alias("s")).select("s.*")
    same = F.avg((F.col("x") == F.col("y")).cast("double"))
    return long.groupBy("a", "b").agg(same.alias("equal_rate"), F.corr("x", "y").alias("corr"), (same >= least).alias("duplicate"))
