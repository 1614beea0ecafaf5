"""Ordered sequences: contexts before a turn, rolling prefixes, alternation and rotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dialogue_text(df: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    """One row per dialogue: ``speaker: text`` lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(order, F.concat(F.col(speaker), F.lit(": "), F.col(text)).alias("line"))))
    return df.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("dialogue"))


def preceding_context(df: DataFrame, key: str, order: str, speaker: str, text: str, most: int = 6) -> DataFrame:
    """Add ``context``: up to ``most`` lines before each turn."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-most, -1)
    line = F.concat(F.col(speaker), F.lit(": "), F.col(text))
    return df.withColumn("context", F.array_join(F.collect_list(line).over(w), "\n"))


def last_of_role(df: DataFrame, key: str, order: str, role: str, wanted: str, text: str) -> DataFrame:
    """Add ``last_text``: the latest text of a role before each turn, null if there was none."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("last_text", F.last(F.when(F.col(role) == wanted, F.col(text)), ignorenulls=True).over(w))


def history(df: DataFrame, key: str, order: str, text: str, most: int = 8) -> DataFrame:
    """Add ``history``: of the last ``most`` turns before each, those that are not empty, without a final one that repeats the turn itself."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-most, -1)
    h = F.filter(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(w), lambda x: F.trim(x) != "")
    df = df.withColumn("_h", h)
    repeats = (F.size("_h") > 0) & (F.element_at("_h", -1) == F.col(text))
    return df.withColumn("history", F.when(repeats, F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 1, F.lit(0)))).otherwise(F.col("_h"))).drop("_h")


def checkpoints(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows at half the sequence (the second at least) and at its end, with the number of rows so far."""
    w = W.partitionBy(key)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    rows = df.withColumn("n_rows", n).withColumn("so_far", r.cast("long"))
    return rows.where((F.col("so_far") == F.greatest(F.lit(2), F.floor(F.col("n_rows") / 2))) | (F.col("so_far") == F.col("n_rows")))


def fixed_context(greeting: Column, turns: Column, probes: Sequence[str], before: Column) -> Column:
    """Greeting, then the first ``before`` turns, each followed by the next probe in turn."""
    listed = F.array(*map(F.lit, probes))
    rounds = F.transform(
        F.slice(turns, F.lit(1), before), lambda t, i: F.array(t, F.element_at(listed, (i % len(probes) + 1).cast("int")))
    )
    return F.concat(F.array(greeting), F.flatten(rounds))


def alternated(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``target_first``: true for every other row of a group in the given order, the first included."""
    return df.withColumn("target_first", (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1) % 2 == 0)


def balanced_order(names: Column, ordinal: Column, variant: Column) -> Column:
    """Reverse for odd variants, then rotate by ordinal and variant, so that each name visits each position."""
    n = F.size(names)
    turned = F.when(variant % 2 == 1, F.reverse(names)).otherwise(names)
    k = ((ordinal + variant) % n).cast("int")
    return F.concat(F.slice(turned, k + 1, n - k), F.slice(turned, F.lit(1), k))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def top_gap(df: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """Best, and how far the second best is behind (null without one).

    The rank is limited to two, which Spark applies before the shuffle as well, so that large groups stay small.
    """
    top = df.select(*key, score, F.row_number().over(W.partitionBy(*key).orderBy(F.col(score).desc())).alias("_r")).where("_r <= 2")
    first, second = (F.max(F.when(F.col("_r") == r, F.col(score))) for r in (1, 2))
    return top.groupBy(*key).agg(first.alias("best"), (first - second).alias("gap"))


def near_best(df: DataFrame, key: Sequence[str], score: str, epsilon: float) -> DataFrame:
    """Rows within ``epsilon`` of their group's best."""
    return df.withColumn("_m", F.max(score).over(W.partitionBy(*key))).where(F.col(score) >= F.col("_m") - epsilon).drop("_m")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order, by a combined minimum instead of a sort of each group."""
    rest = [c for c in df.columns if c not in key and c not in order]
    g = df.groupBy(*key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_b"))
    return g.select(*key, "_b.*").select(*df.columns)


def last_writer(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in order."""
    rest = [c for c in df.columns if c not in key and c not in order]
    g = df.groupBy(*key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_b"))
    return g.select(*key, "_b.*").select(*df.columns)
