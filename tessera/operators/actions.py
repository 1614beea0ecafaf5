"""The action dimension: eight subsets of three memory sources, each with and without a strategy hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code of each subset of the sources MP (1), MS (2) and ME (4), in the order of declaration.
MEMORY = {0: "M0", 1: "MP", 2: "MS", 4: "ME", 3: "MPMS", 5: "MPE", 6: "MSE", 7: "MPMSME"}
SOURCES = {"MP": 1, "MS": 2, "ME": 4}
STRATEGIES = ("R0", "RS")


def action_id(mask: int, strategy: str) -> str:
    return f"{MEMORY[mask]}+{strategy}"


ACTIONS = [action_id(m, s) for m in MEMORY for s in STRATEGIES]


def actions(spark: SparkSession) -> DataFrame:
    """``action_id, mem_code, mask, n_sources, strategy``: sixteen rows."""
    rows = [(action_id(m, s), MEMORY[m], m, m.bit_count(), s) for m in MEMORY for s in STRATEGIES]
    return spark.createDataFrame(rows, "action_id string, mem_code string, mask int, n_sources int, strategy string")


def parsed(df: DataFrame, col: str) -> DataFrame:
    """Add the dimension's columns; ids that it doesn't have get nulls. The dimension has sixteen rows."""
    dim = actions(df.sparkSession)
    return df.join(F.broadcast(dim.withColumnRenamed("action_id", col)), col, "left")


def code_of(mask: Column, strategy: Column) -> Column:
    """Id of a subset and a strategy."""
    pairs = [x for m, code in MEMORY.items() for x in (F.lit(m), F.lit(code))]
    return F.concat(F.create_map(*pairs)[mask], F.lit("+"), strategy)


def allowed_actions(available: Column) -> Column:
    """Array of legal ids: every subset of the available sources, with and without a strategy."""
    ids = [F.when(F.lit(m).bitwiseAND(available) == m, F.lit(action_id(m, s))) for m in MEMORY for s in STRATEGIES]
    return F.array_compact(F.array(*ids))


def fixed_action(mask: int, strategy: str, available: Column) -> Column:
    """A constant action, cut to what is available."""
    return code_of(F.lit(mask).bitwiseAND(available), F.lit(strategy))


def combined(mask_a: Column, strategy_a: Column, mask_b: Column, strategy_b: Column, mode: str) -> Column:
    """``memory``: union of memories; ``both``: of strategies too; ``rule``: the second's memory, the first's strategy."""
    either = F.when((strategy_a == "RS") | (strategy_b == "RS"), "RS").otherwise("R0")
    mask, strategy = {"memory": (mask_a.bitwiseOR(mask_b), strategy_a), "both": (mask_a.bitwiseOR(mask_b), either), "rule": (mask_b, strategy_a)}[mode]
    return code_of(mask, strategy)


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_subset(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) == a
