"""The strategy bank: turns of the training split with context, first of equal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import split_of, stable_hex
from tessera.functions.text import normalize_for_hash
from tessera.operators.sequence import keep_first, last_of_role, preceding_context


def turn_states(turns: DataFrame) -> DataFrame:
    """Assistant turns that follow some user turn, with ``context`` (six lines before) and ``seeker`` (the latest user text)."""
    t = last_of_role(preceding_context(turns, "conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "user", "text")
    return t.withColumnRenamed("last_text", "seeker").where("role = 'assistant' and seeker is not null")


def strategy_bank(turns: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """One row per different (context, response) of training dialogues that ``excluded`` (``conv_id``) doesn't name."""
    t = turns.where(split_of(F.lit(17), "conv_id") == "train")
    if excluded is not None:
        t = t.join(excluded.select("conv_id"), "conv_id", "left_anti")
    rows = turn_states(t)
    rows = rows.withColumn("_c", F.md5(normalize_for_hash(F.col("context")))).withColumn("_t", F.md5(normalize_for_hash(F.col("text"))))
    first = keep_first(rows, ["_c", "_t"], ["conv_id", "turn"]).drop("_c", "_t")
    return first.withColumn("strategy_id", F.concat(F.lit("strat_"), stable_hex("conv_id", "turn")))
