"""Panels of units by conditions: pivots, paired deltas, costs and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import finite


def paired(df: DataFrame, unit: Sequence[str], condition: str, values: Sequence[str], a: str, b: str, strict: bool = False) -> DataFrame:
    """One row per unit that has both conditions: ``<value>_a`` and ``<value>_b``.

    Both conditions are gathered by one aggregate over the unit, with one shuffle, instead of two sides
    of a join. ``strict`` marks nothing away: it raises if a unit has a condition twice.
    """
    rows = df.where(F.col(condition).isin(a, b))
    aggs = [F.any_value(F.when(F.col(condition) == c, F.col(v)), True).alias(f"{v}_{s}") for v in values for c, s in ((a, "a"), (b, "b"))]
    counts = [F.count_if(F.col(condition) == c).alias(f"_n_{s}") for c, s in ((a, "a"), (b, "b"))]
    out = rows.groupBy(*unit).agg(*aggs, *counts).where("_n_a > 0 and _n_b > 0")
    if strict and out.where("_n_a > 1 or _n_b > 1").limit(1).count():
        raise ValueError("a unit has a condition more than once")
    return out.drop("_n_a", "_n_b")


def number_summary(x: Column, name: str = "") -> list[Column]:
    """n, mean, median, least and most of the finite values."""
    f = F.when(finite(x), x)
    p = f"{name}_" if name else ""
    return [F.count(f).alias(p + "n"), F.avg(f).alias(p + "mean"), F.median(f).alias(p + "median"), F.min(f).alias(p + "min"), F.max(f).alias(p + "max")]


def condition_means(df: DataFrame, condition: str, values: Sequence[str]) -> DataFrame:
    cols = [F.avg(F.when(finite(F.col(v)), F.col(v))).alias(v) for v in values]
    return df.groupBy(condition).agg(F.count("*").alias("n"), *cols)


def delta_summary(deltas: DataFrame, delta: str, group: Sequence[str] = ()) -> DataFrame:
    """Number summary, and how many deltas are higher, equal and lower."""
    x = F.col(delta)
    return deltas.groupBy(*group).agg(
        *number_summary(x),
        F.count_if(x > 0).alias("higher"),
        F.count_if(x == 0).alias("ties"),
        F.count_if(x < 0).alias("lower"),
        F.avg((x >= 0).cast("double")).alias("tie_or_higher"),
    )


def subset_summary(df: DataFrame, subsets: dict[str, Column], value: str) -> DataFrame:
    """``delta_summary`` over overlapping subsets: each row is exploded to the subsets it belongs to, and shuffled as partial sums only."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    return delta_summary(df.select(F.explode(names).alias("subset"), F.col(value)), value, ["subset"])


def cost_summary(df: DataFrame, condition: str, fields: Sequence[str], rates: dict[str, Column]) -> DataFrame:
    """Rates of predicates, then mean, median, 95th percentile (linear) and total of each cost field."""
    cols = [F.avg(c.cast("double")).alias(n) for n, c in rates.items()]
    for f in fields:
        cols += [F.avg(f).alias(f + "_mean"), F.median(f).alias(f + "_median"), F.percentile(f, F.lit(0.95)).alias(f + "_p95"), F.sum(f).alias(f + "_total")]
    return df.groupBy(condition).agg(F.count("*").alias("n"), *cols)


def shares(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Histogram of a column within groups, with rates. Counted first, so that the window sees one row per value."""
    from pyspark.sql import Window as W

    n = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy(*group)))


def resource_comparison(summary: DataFrame, condition: str, treatment: str, fields: Sequence[str]) -> DataFrame:
    """Treatment against every other condition of a summary: means, difference, and relative saving (null where the baseline is 0)."""
    long = summary.select(condition, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in fields])).alias("s"))
    long = long.select(condition, "s.field", "s.x")
    t = long.where(F.col(condition) == treatment).select("field", F.col("x").alias("treatment"))
    b = long.where(F.col(condition) != treatment).select(F.col(condition).alias("baseline_condition"), "field", F.col("x").alias("baseline"))
    saving = F.try_divide(F.col("baseline") - F.col("treatment"), F.col("baseline"))
    return b.join(t, "field").withColumn("difference", F.col("treatment") - F.col("baseline")).withColumn("saving", saving)


def win_tie_loss(df: DataFrame, label: Column, group: Sequence[str] = ()) -> DataFrame:
    """Of labels A, B and tie (others are ignored): counts, and (wins + ties / 2) / n, null without any."""
    x = F.when(label.isin("A", "B", "tie"), label)
    wins, ties, n = F.count_if(x == "A"), F.count_if(x == "tie"), F.count(x)
    return df.groupBy(*group).agg(
        wins.alias("wins"), ties.alias("ties"), F.count_if(x == "B").alias("losses"), F.try_divide(wins + ties / 2, n).alias("score")
    )


def target_wins(df: DataFrame, winner: str, target: str, group: Sequence[str] = ()) -> DataFrame:
    """For one target: whatever is neither it nor a tie is a loss."""
    w = F.col(winner)
    wins, ties = F.count_if(w == target), F.count_if(w == "tie")
    return df.groupBy(*group).agg(
        wins.alias("wins"), ties.alias("ties"), (F.count("*") - wins - ties).alias("losses"), F.try_divide(wins + ties / 2, F.count("*")).alias("score")
    )


def top_groups(scored: DataFrame, n: str, score: str, name: str, least: int, most: int) -> DataFrame:
    """Groups of at least ``least`` rows by score, then size, then name; the first ``most``, which is what the report asks for."""
    return scored.where(F.col(n) >= least).orderBy(F.col(score).desc(), F.col(n).desc(), F.col(name)).limit(most)


def entropy_bits(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy of a column's histogram, in bits."""
    p = shares(df, list(group), value)
    return p.groupBy(*group).agg(F.coalesce(F.sum(-F.col("rate") * F.log2("rate")), F.lit(0.0)).alias("entropy"), F.max("rate").alias("top_share"))


def severity_summary(df: DataFrame, fields: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Per risk field: rates above 0 and from 2 on, and the mean."""
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields]))
    long = df.select(*group, stack.alias("s")).select(*group, "s.field", "s.x")
    x = F.col("x")
    return long.groupBy(*group, "field").agg(
        F.count(x).alias("n"), F.count_if(x > 0).alias("positive"), F.count_if(x >= 2).alias("major"), F.avg(x).alias("mean")
    )


def order_stability(df: DataFrame, unit: Sequence[str], variant: str, position: str, values: Sequence[str]) -> DataFrame:
    """Per value: mean absolute difference to the unit's first variant, and the largest deviation of a position's mean from the overall one."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*unit).orderBy(variant)
    parts = []
    for v in values:
        rows = df.withColumn("_d", F.abs(F.col(v) - F.first(v).over(w))).withColumn("_k", F.row_number().over(w))
        drift = rows.where("_k > 1").agg(F.avg("_d").alias("mean_abs_change"))
        total = df.agg(F.avg(v).alias("_all"))
        by = df.groupBy(position).agg(F.avg(v).alias("_m")).join(F.broadcast(total)).agg(F.max(F.abs(F.col("_m") - F.col("_all"))).alias("position_bias"))
        parts.append(drift.join(F.broadcast(by)).withColumn("field", F.lit(v)))
    return reduce(DataFrame.unionByName, parts)


def dual_order(df: DataFrame, unit: Sequence[str], order: str, label: str, tie_absorbs: bool) -> DataFrame:
    """Resolve verdicts of both orders (``AB`` and ``BA``; in the second, labels are of the swapped sides).

    Agreement keeps the label. Otherwise the result is a tie; with ``tie_absorbs``, a tie in one order
    leaves the other's label. Units without both orders are left out.
    """
    flip = F.when(F.col(label) == "A", "B").when(F.col(label) == "B", "A").otherwise(F.col(label))
    both = df.groupBy(*unit).agg(
        F.any_value(F.when(F.col(order) == "AB", F.col(label)), True).alias("forward"), F.any_value(F.when(F.col(order) == "BA", flip), True).alias("backward")
    )
    both = both.where("forward is not null and backward is not null")
    resolved = F.when(F.col("forward") == F.col("backward"), F.col("forward"))
    if tie_absorbs:
        resolved = resolved.when(F.col("forward") == "tie", F.col("backward")).when(F.col("backward") == "tie", F.col("forward"))
    return both.withColumn("winner", resolved.otherwise(F.lit("tie"))).withColumn("consistent", F.col("forward") == F.col("backward"))


def value_shares(df: DataFrame, col: str, **aggs: Column) -> DataFrame:
    """``col``, the aggregates, and the share of all rows that each value has."""
    g = df.groupBy(col).agg(F.count("*").alias("_n"), *[a.alias(n) for n, a in aggs.items()])
    total = g.agg(F.sum("_n").alias("_t"))
    return g.join(F.broadcast(total)).withColumn("share", F.col("_n") / F.col("_t")).drop("_n", "_t")


def dialogue_totals(df: DataFrame, condition: str, dialogue: str, risk: str, tokens: str) -> DataFrame:
    """``condition, dialogues, mean_risk, mean_tokens, mean_turns``: totals of each dialogue, then means over dialogues."""
    g = df.groupBy(condition, dialogue).agg(F.count("*").alias("n"), F.sum(tokens).alias("t"), F.avg(risk).alias("r"))
    return g.groupBy(condition).agg(F.count("*").alias("dialogues"), F.avg("r").alias("mean_risk"), F.avg("t").alias("mean_tokens"), F.avg("n").alias("mean_turns"))
