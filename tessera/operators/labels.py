"""Labels of outcomes: joins, risk and quality of memory and strategy, and response scores from pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(outcomes: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcomes that have labels; the others go silently."""
    return outcomes.join(labels, list(keys))


def labelled_strict(outcomes: DataFrame, labels: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The same, and the outcomes that have none, with a reason."""
    met = outcomes.join(labels.withColumn("_has", F.lit(True)), list(keys), "left")
    failures = met.where("_has is null").select(*keys, F.lit("missing label").alias("reason"))
    return met.where("_has").drop("_has"), failures


def pair_outcomes(pairs: DataFrame, outcomes: DataFrame, card: str, first: str, second: str, value: str, *keep: str) -> DataFrame:
    """Pairs with the value of both their actions, and the columns ``keep`` of the pairs.

    A card's values, at most sixteen, are gathered into a map that its pairs meet by the card alone: pairs
    that are dealt by card already stay where they are, and none is split into sides.
    """
    each = outcomes.where(F.col("action_id").isNotNull()).groupBy(card, "action_id").agg(F.max(value).alias("v"))
    mine = each.groupBy(card).agg(F.map_from_entries(F.collect_list(F.struct("action_id", F.struct("v")))).alias("_values"))
    met = pairs.join(mine, card)
    at = lambda c: F.try_element_at("_values", F.col(c))["v"]
    found = met.select(card, "pair_id", *keep, at(first).alias("value_a"), at(second).alias("value_b"))
    return found.where("value_a is not null and value_b is not null")


def misuse(unused: Column, exposure: Column, stale: Column, most: float = 2.0) -> Column:
    """The worst of an assessment's three fields, as a share."""
    return F.greatest(unused, exposure, stale) / most


def memory_labels(m0: DataFrame, m2: DataFrame, m2b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``misuse, omission, quality`` per outcome.

    Without memory (``m0``): misuse is half the unsupported claims, omission the worse of a missed
    opportunity and inappropriateness. With memory (``m2``, one row per source): misuse is the worst over
    sources and fields, omission 0. Where ``m2b`` has the row, omission rises to its severity and quality
    falls to its sufficiency.
    """
    k = list(keys)
    none = m0.select(*k, (F.col("unsupported") / 2).alias("misuse"), F.greatest(F.col("missed") / 2, 1 - F.col("appropriate") / 2).alias("omission"), (F.col("appropriate") / 2).alias("quality"))
    worst = F.max(misuse(F.col("unused"), F.col("exposure"), F.col("stale")))
    some = m2.groupBy(*k).agg(worst.alias("misuse"), F.lit(0.0).alias("omission"), F.min(F.col("appropriate") / 2).alias("quality"))
    later = m2b.select(*k, (F.col("severity") / 2).alias("_s"), (F.col("sufficiency") / 2).alias("_q"))
    merged = some.join(later, k, "left").select(*k, "misuse", F.greatest("omission", F.coalesce("_s", F.lit(0.0))).alias("omission"), F.least("quality", F.coalesce("_q", "quality")).alias("quality"))
    return none.unionByName(merged)


def strategy_labels(use: DataFrame, omitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``risk, quality``: with a strategy from over-structuring, premature advice, relevance and use; without from what was missed."""
    k = list(keys)
    rs = use.select(*k, (F.greatest("over", "premature") / 2).alias("risk"), ((F.col("relevance") + F.col("used")) / 4).alias("quality"))
    r0 = omitted.select(*k, F.greatest(F.col("missed") / 2, F.col("inappropriate") / 2, 1 - F.col("appropriate") / 2).alias("risk"), (F.col("appropriate") / 2).alias("quality"))
    return rs.unionByName(r0)


def observation_metrics(df: DataFrame, relevance: str, used: str, group: Sequence[str] = ()) -> DataFrame:
    """``recall`` of what is fully relevant, relevance-``weighted`` use and plain ``use``; 0 where there is nothing."""
    r, u = F.col(relevance), F.col(used).cast("double")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return df.groupBy(*group).agg(
        zero(F.avg(F.when(r == 1, u))).alias("recall"), zero(F.try_divide(F.sum(r * u), F.sum(r))).alias("weighted"), zero(F.avg(u)).alias("use")
    )


def solved(matrix: Column, n: Column) -> Column:
    """Solution of a positive definite system of ``n`` rows of ``n`` + 1 numbers, by elimination within the row."""
    # The matrix is bound by a lambda, so that it is made once and not for each of its numbers.
    def step(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        return F.transform(m, lambda row, i: F.when(i == k, F.transform(row, lambda v: v / F.get(pivot, k))).otherwise(F.zip_with(row, pivot, lambda v, q: v - F.get(row, k) * q / F.get(pivot, k))))

    done = F.aggregate(F.sequence(F.lit(0), n - 1), matrix, step)
    return F.transform(done, lambda row: F.get(row, n))


def response_scores(pairs: DataFrame, card: str, first: str, second: str, winner: str, ridge: float = 0.1) -> DataFrame:
    """``card, action_id, score``: mean probability of winning against the card's other actions.

    Per card a ridge system over its (at most sixteen) actions is solved: +1 and -1 for the two sides,
    1, -1 or 0 for the result. A lone action has 0.5. Equal pairs are counted first, so a card's row holds
    its different pairs only; its system is built and solved by array expressions.
    """
    y = F.when(F.col(winner) == "A", 1.0).when(F.col(winner) == "B", -1.0).otherwise(0.0)
    sums = pairs.groupBy(F.col(card).alias("_c"), F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("y"))
    rows = sums.groupBy("_c").agg(F.collect_list(F.struct("a", "b", "n", "y")).alias("_p"))
    rows = rows.withColumn("_v", F.array_sort(F.array_distinct(F.concat(F.transform("_p", lambda p: p["a"]), F.transform("_p", lambda p: p["b"])))))
    total = lambda of: F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + of(p))
    at = lambda hit, x: F.when(hit, x).otherwise(F.lit(0.0))

    def line(v: Column) -> Column:
        def entry(u: Column) -> Column:
            return total(lambda p: F.when(u == v, at(p["a"] == v, p["n"]) + at(p["b"] == v, p["n"])).otherwise(-at((p["a"] == v) & (p["b"] == u) | (p["a"] == u) & (p["b"] == v), p["n"]))) + F.when(u == v, F.lit(ridge)).otherwise(F.lit(0.0))

        return F.concat(F.transform("_v", entry), F.array(total(lambda p: at(p["a"] == v, p["y"]) - at(p["b"] == v, p["y"]))))

    rows = rows.withColumn("_s", solved(F.transform("_v", line), F.size("_v")))
    won = lambda s: F.aggregate("_s", F.lit(0.0), lambda acc, o: acc + 1 / (1 + F.exp(o - s)))
    others = F.size("_v") - 1
    rows = rows.withColumn("_m", F.when(others > 0, F.transform("_s", lambda s: (won(s) - 0.5) / others)).otherwise(F.array(F.lit(0.5))))
    out = rows.select("_c", F.explode(F.arrays_zip("_v", "_m")).alias("e"))
    return out.select(F.col("_c").alias(card), F.col("e._v").alias("action_id"), F.col("e._m").alias("score"))
