"""Deterministic samples, splits and plans, ordered by hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ids import stable_hex


def hash_sample(df: DataFrame, n: int, seed: Column, key: str) -> DataFrame:
    """The first ``n`` rows by a hash of seed and key: a top-n, not a sort of all."""
    return df.orderBy(stable_hex(seed, key), key).limit(n)


def quota_sample(df: DataFrame, stratum: str, n: int, seed: Column, key: str) -> DataFrame:
    """``n`` rows in equal parts of the strata, the rest to the last one; by hash within each."""
    strata = df.select(stratum).distinct()
    k = strata.select(
        F.col(stratum).alias("_s"), F.row_number().over(W.orderBy(F.col(stratum).asc_nulls_last())).alias("_k"), F.count("*").over(W.partitionBy()).alias("_g")
    )
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy(stable_hex(seed, key), key)))
    quota = F.floor(F.lit(n) / F.col("_g")) + F.when(F.col("_k") == F.col("_g"), F.lit(n) % F.col("_g")).otherwise(0)
    met = ranked.where(F.col("_r") <= n).join(F.broadcast(k), F.col(stratum).eqNullSafe(F.col("_s")))
    return met.where(F.col("_r") <= quota).select(*df.columns)


def systematic_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows at the places floor(i N / n) of the order by key.

    Places come from range partitions and their counts, so that no window runs over the whole table.
    """
    from tessera.session import durable

    ordered = df.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    rows = durable(ordered)
    inner = rows.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(key, "_id")) - 1)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = sizes.select(F.col("_p").alias("_q"), (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_start"), F.sum("_c").over(W.partitionBy()).alias("_n"))
    placed = inner.join(F.broadcast(starts), F.col("_p") == F.col("_q")).withColumn("_g", F.col("_start") + F.col("_i"))
    # A place g is taken if some i has floor(i N / n) = g, that is, if the smallest i with i N / n >= g gives it.
    i = F.ceil(F.col("_g") * n / F.col("_n"))
    hit = (F.floor(i * F.col("_n") / n) == F.col("_g")) & (i < n)
    return placed.where(hit).select(*df.columns)


def quantiles_by(df: DataFrame, key: str, x: str, shares: Sequence[float]) -> dict:
    """For each ``key`` (a few of them, as columns of a table are) its quantiles, between neighbours, as the driver's numbers.

    Equal values are counted first, the counts are range-partitioned by key and value and summed, so no
    task holds all values of a key; the driver gets the partitions' sums and two values for each share.
    """
    from tessera.session import durable

    value = F.col(x).cast("double")
    counts = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(F.col(key).alias("k"), value.alias("x")).agg(F.count("*").alias("c"))
    rows = durable(counts.repartitionByRange("k", "x").withColumn("p", F.spark_partition_id()))
    total, starts = {}, []
    for r in sorted(rows.groupBy("k", "p").agg(F.sum("c").alias("c")).collect()):
        starts.append((r.k, r.p, total.get(r.k, 0)))
        total[r.k] = total.get(r.k, 0) + r["c"]
    if not total:
        return {}
    at = {k: [(s * (n - 1) // 1, s * (n - 1) % 1) for s in shares] for k, n in total.items()}
    ranks = [(k, sorted({int(i) + d for i, _ in some for d in (0, 1) if i + d < total[k]})) for k, some in at.items()]
    spark, kind = df.sparkSession, dict(counts.dtypes)["k"]
    base = F.broadcast(spark.createDataFrame(starts, f"bk {kind}, bp int, base long"))
    wanted = F.broadcast(spark.createDataFrame(ranks, f"rk {kind}, ranks array<long>"))
    upto = F.sum("c").over(W.partitionBy("k", "p").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto).join(base, (F.col("k") == F.col("bk")) & (F.col("p") == F.col("bp"))).withColumn("hi", F.col("base") + F.col("upto"))
    found = placed.join(wanted, F.col("k") == F.col("rk")).select("k", "x", F.explode(F.filter("ranks", lambda r: (r >= F.col("hi") - F.col("c")) & (r < F.col("hi")))).alias("r"))
    value = {(r.k, r.r): r.x for r in found.collect()}
    return {k: [value[k, int(i)] + f * (value[k, min(int(i) + 1, total[k] - 1)] - value[k, int(i)]) for i, f in some] for k, some in at.items()}


def exact_quantiles(df: DataFrame, x: str, shares: Sequence[float]) -> list[float | None]:
    """``quantiles_by`` of one column; ``None`` each where there is no value."""
    return quantiles_by(df.select(F.lit(0).alias("k"), x), "k", x, shares).get(0) or [None for _ in shares]


def column_quantiles(df: DataFrame, fields: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """``quantiles_by`` of several columns in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("k"), F.col(f).cast("double").alias("x")) for f in fields])).alias("e")).select("e.*")
    found = quantiles_by(long, "k", "x", shares)
    return {f: found.get(f) or [None for _ in shares] for f in fields}


def stratified_sample(df: DataFrame, key: str, groups: Sequence[str], n: int, seed: Column) -> DataFrame:
    """Cover each value of the first column by its first row in hash order, then of the next, then fill up in hash order.

    Each row counts once, at its first turn.
    """
    h = stable_hex(seed, key)
    rows = df.select(F.col(key).alias("_key"), h.alias("_h"), *groups)
    parts = []
    for turn, g in enumerate(groups):
        first = rows.where(F.col(g).isNotNull()).groupBy(g).agg(F.min(F.struct("_h", "_key")).alias("_b"))
        parts.append(first.select(F.col("_b._key").alias("_key"), F.struct(F.lit(turn).alias("pass"), F.col(g).cast("string").alias("g")).alias("_m")))
    parts.append(rows.orderBy("_h", "_key").limit(n + sum(1 for _ in groups) * n).select("_key", F.struct(F.lit(len(groups)).alias("pass"), F.col("_h").alias("g")).alias("_m")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    chosen = every.groupBy("_key").agg(F.min("_m").alias("_m")).orderBy("_m", "_key").limit(n)
    return df.join(F.broadcast(chosen.select("_key")), F.col(key) == F.col("_key"), "left_semi")


def blinded(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Code, side swap and position of ``n`` pairs in hash order. The key table and the shown table are projections of it."""
    code = stable_hex(F.lit("b"), *keys, n=12)
    top = df.withColumn("pair_code", code).orderBy("pair_code").limit(n)
    swap = F.conv(stable_hex(F.lit("s"), *keys, n=1), 16, 10).cast("int") % 2 == 1
    return top.withColumn("swap", swap).withColumn("position", F.row_number().over(W.orderBy("pair_code")).cast("long"))


def fold_turns(classes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """For classes ``(size, number of groups)``, largest size first: ``size`` and runs ``(first rank, folds in turn)``.

    Each group goes to the lightest fold, then the first. While the lightest folds are within one group
    of each other they take turns; so a class has some k runs, whatever its number of groups.
    """
    loads = [0] * k
    out = []
    for size, n in classes:
        runs, rank = [], 0
        while rank < n:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            turn = [f for f in order if loads[f] < loads[order[0]] + size]
            rounds = (n - rank) // len(turn)
            if len(turn) < k:
                rounds = min(rounds, (loads[order[len(turn)]] - loads[order[0]]) // size)
            runs.append((rank, turn))
            if not rounds:
                turn = turn[: n - rank]
            for f in turn:
                loads[f] += max(1, rounds) * size
            rank += max(1, rounds) * len(turn)
        out.append((size, runs))
    return out


def grouped_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """``group, size, fold``: the largest group first (then by name), each to the lightest fold (then the first).

    Which folds take turns follows from how many groups there are of each size; the driver gets these
    counts, of which there are at most the square root of twice the rows. Groups are ranked within
    their size by range partitions and their counts, so no task holds all. Fewer than two groups fail.
    """
    from tessera.operators.keys import CheckFailed
    from tessera.session import durable

    sizes = df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("size"))
    rows = durable(sizes.repartitionByRange(F.col("size").desc(), F.col("g")).withColumn("p", F.spark_partition_id()))
    places = durable(rows.groupBy("size", "p").agg(F.count("*").alias("n")))
    classes = [(r["size"], r["n"]) for r in places.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.col("size").desc()).collect()]
    if classes and sum(n for _, n in classes) < 2:
        raise CheckFailed(f"{group}: fewer than two groups")
    runs = [(s, [(a, f) for a, f in r]) for s, r in fold_turns(classes, k)]
    turns = df.sparkSession.createDataFrame(runs, "s long, runs array<struct<first: long, folds: array<long>>>")
    starts = places.select(F.col("size").alias("s2"), F.col("p").alias("q"), (F.sum("n").over(W.partitionBy("size").orderBy("p")) - F.col("n")).alias("start"))
    ranked = rows.withColumn("i", F.row_number().over(W.partitionBy("size", "p").orderBy("g")) - 1)
    ranked = ranked.join(starts, (F.col("size") == F.col("s2")) & (F.col("p") == F.col("q"))).withColumn("rank", F.col("start") + F.col("i"))
    met = ranked.join(F.broadcast(turns), F.col("size") == F.col("s"))
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    at = (F.pmod(F.col("rank") - run["first"], F.size(run["folds"])) + 1).cast("int")
    return met.select(F.col("g").alias(group), "size", F.element_at(run["folds"], at).alias("fold"))


def stratum_candidates(df: DataFrame, strata: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Each row once for each of the named ``strata`` (condition, priority) whose condition holds, with ``stratum`` and ``priority``."""
    seats = [F.when(holds, F.struct(F.lit(name).alias("stratum"), rank.cast("double").alias("priority"))) for name, (holds, rank) in strata.items()]
    return df.withColumn("_seat", F.explode(F.array_compact(F.array(*seats)))).select(*df.columns, "_seat.*")


#: The items of a plan are broadcast to what they are joined with.
LARGEST_PLAN = 100_000


def greedy_strata(
    df: DataFrame, key: str, scenario: str, stratum: str, priority: str, quota: int | Mapping[str, int], total: int, counts: str = "running"
) -> DataFrame:
    """A plan of ``total`` items: ``key, scenario, stratum, turn, covered``, each item (of one scenario) once.

    In turn 1 each stratum in order takes its best items of fresh scenarios, in turn 2 its best items of
    any, until ``quota`` is met. Turn 3 fills the plan by (uses of the scenario, priority, key): uses as
    they are after each pick (``counts="running"``), or as they stood before the turn (``"before"``).
    ``quota`` is one number for all strata, in their natural order, or a number for each of the strata
    named, in that order; other strata then take no part. An item can stand in several strata:
    ``covered`` lists those whose search passed it once it was in the plan, its own included.

    Greedy search by priority is a top-n of what is still free, so each turn of a stratum is one such
    query. They run over candidates cut once to the ``total`` best rows of each scenario of a stratum and
    its ``total + quota`` best scenarios by their first row: as no more than ``total`` items are taken,
    nothing beyond can be reached. Higher priorities come first, ties by key; null and NaN priorities last.
    Of repeated rows the highest priority counts; rows without a key take no part, rows without a
    stratum in turn 3 only. A null scenario is one scenario. Without rows the plan is empty.
    """
    from tessera.session import durable

    if not 0 < total <= LARGEST_PLAN:
        raise ValueError(f"a plan has from 1 to {LARGEST_PLAN} items")
    number = F.col(priority).cast("double")
    rank = F.coalesce(F.when(~F.isnan(number), number), F.lit(float("-inf")))
    base = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(scenario).alias("v"), F.col(stratum).alias("s"), rank.alias("p"))
    if isinstance(quota, Mapping):
        base = base.where(F.col("s").isin(*quota))
    most = max(quota.values()) if isinstance(quota, Mapping) else quota
    best = [F.col("p").desc(), F.col("k")]
    rows = base.groupBy("k", "v", "s").agg(F.max("p").alias("p"))
    ranked = rows.withColumn("i", F.row_number().over(W.partitionBy("s", "v").orderBy(*best))).where(F.col("i") <= total)
    firsts = rows.withColumn("i", F.row_number().over(W.partitionBy("s", "v").orderBy(*best))).where("i = 1")
    firsts = firsts.withColumn("j", F.row_number().over(W.partitionBy("s").orderBy(*best))).where(F.col("j") <= total + most)
    firsts = firsts.select(F.col("s").alias("a"), F.col("v").alias("b"))
    cut = durable(ranked.join(firsts, F.col("s").eqNullSafe(F.col("a")) & F.col("v").eqNullSafe(F.col("b")), "left_semi").drop("i"))
    named = cut.where("s is not null").select("s").distinct().orderBy("s")
    quotas = dict(quota) if isinstance(quota, Mapping) else {r["s"]: quota for r in named.collect()}

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    plan = df.sparkSession.createDataFrame([], f"{kinds}, turn long, at long")
    size, searches = 0, []

    def free(of: DataFrame) -> DataFrame:
        return of.join(F.broadcast(plan.select("k")), "k", "left_anti")

    def take(picks: DataFrame, need: int, turn: int, name) -> None:
        nonlocal plan, size
        at = F.lit(len(searches)).cast("long").alias("at")
        plan = durable(plan.unionByName(picks.limit(need).select("k", "v", "s", "p", F.lit(turn).cast("long").alias("turn"), at)))
        before, size = size, plan.count()
        searches.append((len(searches), name, size - before < need))

    for turn in (1, 2):
        for name, most in quotas.items():
            need = min(most - (plan.where(F.col("s") == name).count() if turn == 2 else 0), total - size)
            if need <= 0:
                continue
            rest = free(cut.where(F.col("s") == name))
            if turn == 1:
                met = F.broadcast(plan.select(F.col("v").alias("b")).distinct())
                rest = rest.join(met, F.col("v").eqNullSafe(F.col("b")), "left_anti")
                rest = rest.withColumn("i", F.row_number().over(W.partitionBy("v").orderBy(*best))).where("i = 1")
            take(rest.orderBy(*best), need, turn, name)

    uses = plan.groupBy(F.col("v").alias("b")).agg(F.count("*").alias("n"))

    def used(of: DataFrame) -> DataFrame:
        met = of.join(F.broadcast(uses), F.col("v").eqNullSafe(F.col("b")), "left")
        return met.withColumn("n", F.coalesce("n", F.lit(0))).drop("b")

    fill = None
    if size < total:
        fill = len(searches)
        place = F.coalesce(*[F.when(F.col("s") == name, F.lit(i)) for i, name in enumerate(quotas)], F.lit(len(quotas)))
        rest = free(cut).withColumn("i", F.row_number().over(W.partitionBy("k").orderBy(F.col("p").desc(), place))).where("i = 1")
        rest = used(rest)
        if counts == "running":
            rest = rest.withColumn("n", F.col("n") + F.row_number().over(W.partitionBy("v").orderBy(*best)) - 1)
        take(rest.orderBy("n", *best), total - size, 3, None)

    # A search went to its last pick, or through the whole list; items of the plan are held against that in each of their strata.
    seats = base.join(F.broadcast(plan.select("k", F.col("at").alias("since"))), "k").groupBy("k", "v", "s", "since").agg(F.max("p").alias("p"))
    ends = plan.groupBy("at").agg(F.max_by(F.struct("p", "k"), F.struct(-F.col("p"), "k")).alias("e"))
    lists = df.sparkSession.createDataFrame(searches, f"at long, name {rows.schema['s'].dataType.simpleString()}, whole boolean")
    lists = F.broadcast(lists.join(ends, "at", "left").where("name is not null"))
    reached = F.expr("whole or p > e.p or p = e.p and k <= e.k")
    covers = plan.select("k", "s").union(seats.join(lists, F.col("s") == F.col("name")).where(reached & (F.col("at") >= F.col("since"))).select("k", "s"))
    if fill is not None and counts == "before":
        end = used(plan.where(F.col("at") == fill)).agg(F.max(F.struct("n", -F.col("p"), "k")).alias("e"))
        past = used(seats).join(F.broadcast(end.withColumn("at", F.lit(fill))), F.col("at") >= F.col("since"))
        past = past.where(F.lit(searches[fill][2]) | (F.struct("n", -F.col("p"), "k") <= F.col("e")))
        covers = covers.union(past.select("k", "s"))
    covers = covers.groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("covered"))
    return plan.join(covers, "k").select(F.col("k").alias(key), F.col("v").alias(scenario), F.col("s").alias(stratum), "turn", "covered")


def audit_picks(df: DataFrame, key: str, baseline: str) -> DataFrame:
    """Per state the best, the baseline and the most expensive action, with the ``reason`` of each; one action may have several."""
    best = F.max_by(F.struct("action_id", "cost"), F.struct("response", -F.col("cost"), "action_id")).alias("best")
    dear = F.max_by("action_id", F.struct("cost", "action_id")).alias("dear")
    g = df.groupBy(key).agg(best, dear, F.max(F.when(F.col("action_id") == baseline, F.col("action_id"))).alias("base"))
    picks = F.array(
        F.struct(F.lit("best").alias("reason"), F.col("best.action_id").alias("action_id")),
        F.struct(F.lit("baseline").alias("reason"), F.col("base").alias("action_id")),
        F.struct(F.lit("expensive").alias("reason"), F.col("dear").alias("action_id")),
    )
    return g.select(key, F.explode(picks).alias("p")).select(key, "p.*").where("action_id is not null")
