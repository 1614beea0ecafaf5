"""Pair graphs of actions: edges, orientation, audit rows and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ids import stable_hex
from tessera.operators.actions import actions


def action_edges(df: DataFrame) -> DataFrame:
    """``action_a, action_b, pair_type`` of all sixteen actions, with the masks of both, sorted by id.

    Same memory, other strategy: ``strategy``. Within a strategy, one source more or less: ``memory``
    if one side has none, else ``combination``; equally many sources, two of them exchanged: ``chord``.
    """
    dim = actions(df.sparkSession)
    a, b = dim.alias("a"), dim.alias("b")
    met = a.join(b, F.col("a.action_id") < F.col("b.action_id"))
    differ = F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask")))
    same = F.col("a.strategy") == F.col("b.strategy")
    kind = (
        F.when((differ == 0) & ~same, "strategy")
        .when(same & (differ == 1) & (F.least("a.n_sources", "b.n_sources") == 0), "memory")
        .when(same & (differ == 1), "combination")
        .when(same & (differ == 2) & (F.col("a.n_sources") == F.col("b.n_sources")), "chord")
    )
    return met.select(
        F.col("a.action_id").alias("action_a"), F.col("b.action_id").alias("action_b"), kind.alias("pair_type"), F.col("a.mask").bitwiseOR(F.col("b.mask")).alias("needs")
    ).where("pair_type is not null")


def card_edges(cards: DataFrame, card: str, available: str) -> DataFrame:
    """Edges between each card's legal actions. The edge list has at most 120 rows and is broadcast."""
    e = F.broadcast(action_edges(cards))
    return cards.join(e, F.col("needs").bitwiseAND(F.col(available)) == F.col("needs")).drop("needs")


def oriented_pairs(edges: DataFrame, card: str, seed: Column) -> DataFrame:
    """Add ``pair_id``; within a type, every other pair by hash shows its sides the other way round."""
    pid = F.concat(F.lit("pair_"), stable_hex(seed, card, "action_a", "action_b"))
    e = edges.withColumn("pair_id", pid)
    odd = (F.row_number().over(W.partitionBy(card, "pair_type").orderBy("pair_id")) - 1) % 2 == 1
    return e.withColumn("swap", odd).select(
        card, "pair_id", "pair_type", F.when(F.col("swap"), F.col("action_b")).otherwise(F.col("action_a")).alias("first"), F.when(F.col("swap"), F.col("action_a")).otherwise(F.col("action_b")).alias("second")
    )


def with_audit(pairs: DataFrame, card: str, reversal: float = 0.15, repeat: float = 0.10) -> DataFrame:
    """Add reversals and same-order repeats: disjoint slices of each card's pairs in hash order, their numbers rounded half to even.

    Audit rows are not eligible for training. Pairs are passed once, and each gives its one or two rows.
    """
    w = W.partitionBy(card)
    r = F.row_number().over(w.orderBy(stable_hex(F.lit("audit"), "pair_id"), "pair_id"))
    p = pairs.withColumn("_r", r).withColumn("_n", F.count("*").over(w))
    n_rev, n_rep = F.bround(F.col("_n") * reversal), F.bround(F.col("_n") * repeat)
    row = lambda x, y, role: F.struct(F.col(x).alias("first"), F.col(y).alias("second"), F.lit(role).alias("role"), F.lit(role == "base").alias("training_eligible"))
    later = F.when(F.col("_r") <= n_rev, row("second", "first", "reversal")).when(F.col("_r") <= n_rev + n_rep, row("first", "second", "repeat"))
    rows = F.array_compact(F.array(row("first", "second", "base"), later))
    return p.select(card, "pair_id", "pair_type", F.explode(rows).alias("_e")).select(card, "pair_id", "pair_type", "_e.*")


def graph_audit(cards: DataFrame, edges: DataFrame, card: str, available: str) -> DataFrame:
    """Per card: nodes, edges, isolated nodes, least and most degree, and the number of components.

    A card's graph is small (sixteen nodes), so all is found within its row: each edge in turn gives all
    nodes of the greater label the lesser one. The edges are gathered once.
    """
    from tessera.operators.actions import ACTIONS, allowed_actions

    index = F.create_map(*[x for i, a in enumerate(ACTIONS) for x in (F.lit(a), F.lit(i))])
    listed = edges.groupBy(card).agg(F.collect_list(F.struct(index[F.col("action_a")].alias("a"), index[F.col("action_b")].alias("b"))).alias("e"))
    nodes = F.array_sort(F.transform(allowed_actions(F.col(available)), lambda a: index[a]))
    mine = cards.select(card, nodes.alias("v")).join(listed, card, "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<a:int,b:int>>")))
    label = F.aggregate(
        "e",
        F.sequence(F.lit(0), F.lit(15)),
        lambda acc, x: F.transform(acc, lambda v: F.when(v == F.greatest(acc[x["a"]], acc[x["b"]]), F.least(acc[x["a"]], acc[x["b"]])).otherwise(v)),
    )
    components = F.transform(F.array(label), lambda at: F.size(F.array_distinct(F.transform("v", lambda i: at[i]))))[0]  # the lambda binds the labels, which are else made anew for each node
    ends = F.concat(F.transform("e", lambda x: x["a"]), F.transform("e", lambda x: x["b"]))
    degrees = F.transform(F.array(ends), lambda all_ends: F.transform("v", lambda i: F.size(F.filter(all_ends, lambda x: x == i))))
    facts = F.transform(degrees, lambda d: F.struct(F.size(F.filter(d, lambda n: n == 0)).alias("isolated"), F.array_min(d).alias("least_degree"), F.array_max(d).alias("most_degree")))[0]
    out = mine.select(card, F.size("v").alias("nodes"), F.size("e").alias("edges"), facts.alias("f"), components.alias("components"))
    return out.select(card, *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("nodes", "edges", "f.isolated", "f.least_degree", "f.most_degree", "components")])


def decided_pairs(rows: DataFrame, card: str, value: str) -> DataFrame:
    """``card, a, b, winner``: the edges between a card's labelled actions, and which side has the greater ``value`` (A, B or tie).

    A card's rows, one for each of sixteen actions, meet by card alone, so rows that lie by card are not shuffled; the edge
    list has at most 120 rows and is broadcast.
    """
    edges = F.broadcast(action_edges(rows).select(F.col("action_a").alias("a"), F.col("action_b").alias("b")))
    side = lambda n, x: rows.select(card, F.col("action_id").alias(n), F.col(value).alias(x))
    met = side("a", "_x").join(side("b", "_y"), card).join(edges, ["a", "b"])
    winner = F.when(F.col("_x") > F.col("_y"), "A").when(F.col("_x") < F.col("_y"), "B").otherwise("tie")
    return met.select(card, "a", "b", winner.alias("winner"))


def won_differences(pairs: DataFrame, actions: DataFrame, card: str, features: Sequence[str], **of_card: Column) -> DataFrame:
    """One row for each decided pair: features of the winner less those of the loser, ``weight``, one half over the card's decided pairs, and what ``of_card`` sums up of the card's actions.

    ``pairs`` have ``card, a, b, winner``. A card's pairs and actions are gathered before they meet, so each side passes
    once. A pair that is listed twice, or one of whose actions is missing or stands twice, gives no row.
    """
    mine = actions.groupBy(card).agg(F.collect_list(F.struct("action_id", *features)).alias("_rows"), *[c.alias(n) for n, c in of_card.items()])
    decided = pairs.where("winner in ('A', 'B')").select(card, F.when(F.col("winner") == "A", F.col("a")).otherwise(F.col("b")).alias("won"), F.when(F.col("winner") == "A", F.col("b")).otherwise(F.col("a")).alias("lost"), "winner")
    listed = decided.groupBy(card).agg(F.collect_list(F.struct("won", "lost", "winner")).alias("_pairs"))
    of = lambda action: F.filter("_rows", lambda r: r["action_id"] == action)
    once = F.filter("_pairs", lambda p: F.size(F.filter("_pairs", lambda q: q == p)) == 1)
    sides = F.filter(F.transform(once, lambda p: F.struct(of(p["won"]).alias("x"), of(p["lost"]).alias("y"))), lambda e: (F.size(e["x"]) == 1) & (F.size(e["y"]) == 1))
    met = listed.join(mine, card).select(card, *of_card, sides.alias("_e")).select(card, *of_card, (0.5 / F.size("_e")).alias("weight"), F.explode("_e").alias("_e"))
    x, y = (lambda f: F.col("_e.x")[0][f]), (lambda f: F.col("_e.y")[0][f])
    return met.select(card, *of_card, "weight", *[F.coalesce(x(f) - y(f), x(f), -y(f)).cast("double").alias(f) for f in features])


def pair_rows(pairs: DataFrame, actions: DataFrame, card: str, features: Sequence[str]) -> DataFrame:
    """``won_differences`` and their mirror images with ``label``."""
    d = won_differences(pairs, actions, card, features).withColumn("_s", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    return d.select(card, "weight", (F.col("_s") > 0).cast("double").alias("label"), *[(F.col(f) * F.col("_s")).alias(f) for f in features])
