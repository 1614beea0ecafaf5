"""Decision states from dialogues: memory by role, inventories, variants and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ids import stable_hex
from tessera.functions.text import estimate_tokens
from tessera.operators.actions import MEMORY, SOURCES, allowed_actions

#: Which source a turn feeds, by its role.
SOURCE_OF = {"user": "MP", "system": "MS", "assistant": "ME"}

#: Named plans of the curated expansion: which sources a variant keeps.
PLANS = {"none": 0, "profile": 1, "summary": 2, "episodes": 4, "profile_episodes": 5, "summary_episodes": 6, "all": 7}


def runtime_states(turns: DataFrame) -> DataFrame:
    """One state per user turn: ids, inventory of earlier turns per source (count, ages, tokens), mask and legal actions.

    Only earlier turns count. Running aggregates over the dialogue take the place of a join of states
    with items, and each dialogue is sorted once.
    """
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    t = turns.withColumn("tokens", estimate_tokens(F.col("text")))
    for role, source in SOURCE_OF.items():
        mine = F.col("role") == role
        t = (
            t.withColumn(f"{source}_count", F.count_if(mine).over(w))
            .withColumn(f"{source}_newest", F.col("turn") - F.max(F.when(mine, F.col("turn"))).over(w))
            .withColumn(f"{source}_oldest", F.col("turn") - F.min(F.when(mine, F.col("turn"))).over(w))
            .withColumn(f"{source}_tokens", F.coalesce(F.sum(F.when(mine, F.col("tokens"))).over(w), F.lit(0)))
        )
    mask = sum((F.when(F.col(f"{s}_count") > 0, bit).otherwise(0) for s, bit in SOURCES.items()), F.lit(0))
    states = t.where("role = 'user'").withColumn("available", mask.cast("int"))
    states = states.withColumn("state_id", F.concat(F.lit("state_"), stable_hex("conv_id", "turn")))
    cols = [f"{s}_{c}" for s in SOURCES for c in ("count", "newest", "oldest", "tokens")]
    return states.select("state_id", "conv_id", "turn", "available", *cols, F.size(allowed_actions(F.col("available"))).cast("long").alias("n_actions"))


def variants(states: DataFrame, plans: dict[str, int] | None = None) -> DataFrame:
    """``card_id, state_id, plan, mask``: each plan whose sources are all there; of plans with the same sources, the first."""
    rows = F.array(*[F.struct(F.lit(n).alias("plan"), F.lit(m).alias("mask")) for n, m in (plans or PLANS).items()])
    v = states.select("state_id", "available", F.explode(rows).alias("p")).select("state_id", "available", "p.*")
    v = v.where(F.col("mask").bitwiseAND(F.col("available")) == F.col("mask"))
    return v.select(F.concat(F.lit("card_"), stable_hex("state_id", "plan")).alias("card_id"), "state_id", "plan", "mask")


def every_subset(states: DataFrame) -> DataFrame:
    """The same for all subsets of the three sources."""
    return variants(states, {code: m for m, code in MEMORY.items()})


def timeline_payload(turns: DataFrame) -> DataFrame:
    """``conv_id, payload``: JSON of the turns in order, with which of them are the assistant's."""
    items = F.array_sort(F.collect_list(F.struct("turn", "role", (F.col("role") == "assistant").alias("selected"))))
    return turns.groupBy("conv_id").agg(F.to_json(items).alias("payload"))


def memory_items(turns: DataFrame) -> DataFrame:
    """``conv_id, source, created_session, memory_id``: every turn as an item of its source."""
    names = F.create_map(*[x for r, s in SOURCE_OF.items() for x in (F.lit(r), F.lit(s))])
    return turns.select("conv_id", names[F.col("role")].alias("source"), F.col("turn").alias("created_session"), F.concat(F.lit("mem_"), stable_hex("conv_id", "role", "turn")).alias("memory_id"))


def as_v2(states: DataFrame) -> DataFrame:
    """States in the second schema: a struct per source, tokens zero where the source is not available."""
    per = [
        F.struct((F.col(f"{s}_count") > 0).alias("available"), F.col(f"{s}_count").alias("count"), F.when(F.col(f"{s}_count") > 0, F.col(f"{s}_tokens")).otherwise(0).alias("tokens")).alias(s)
        for s in SOURCES
    ]
    return states.select("state_id", F.struct(*per).alias("inventory"))


def padded(vector, size: int = 64):
    """A vector cut or filled up with zeros to ``size``."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), size)), 1, size)


#: How many rows of the table of vectors serve as catalogs, and how many of their places.
CATALOGS, PLACES = 500, 64


def feature_states(turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """``runtime_states`` with what the feature spaces read: text, session, a catalog for each source that is there, and their ages and likeness.

    A conversation's catalogs are three rows of the table of vectors (a fixed number of them is broadcast).
    """
    states = runtime_states(turns).join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"]).withColumn("session_index", F.col("turn"))
    known = vectors.where(F.col("vec_id") < CATALOGS).select("vec_id", F.slice("embedding", 1, PLACES).cast("array<double>").alias("v"))
    zeros = F.array_repeat(F.lit(0.0), PLACES)
    for k, s in enumerate(SOURCES):
        mine = F.broadcast(known.select(F.col("vec_id").alias(f"_{s}"), F.col("v").alias(f"_v{s}")))
        there = F.col(f"{s}_count") > 0
        states = states.join(mine, F.pmod(F.col("conv_id") * 3 + k, F.lit(CATALOGS)) == F.col(f"_{s}"), "left")
        states = states.withColumns(
            {
                f"{s}_available": there,
                f"{s}_catalog": F.when(there, F.coalesce(f"_v{s}", zeros)).otherwise(zeros),
                f"{s}_median": (F.col(f"{s}_newest") + F.col(f"{s}_oldest")) / 2,
                f"{s}_similarity": F.when(there, F.coalesce(F.col(f"_v{s}")[0], F.lit(0.0))).otherwise(F.lit(0.0)),
                f"{s}_stale": F.coalesce((F.col(f"{s}_oldest") >= 4).cast("double"), F.lit(0.0)),
            }
        ).drop(f"_{s}", f"_v{s}")
    first = known.select(F.col("vec_id").alias("_e"), F.col("v").alias("embedding"))
    states = states.join(F.broadcast(first), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(CATALOGS)) == F.col("_e"), "left").drop("_e")
    return states.withColumn("embedding", F.coalesce("embedding", zeros)).withColumn("strategy_count", F.pmod("conv_id", F.lit(9))).withColumn("strategy_tokens", 40 + F.pmod("conv_id", F.lit(30)))
