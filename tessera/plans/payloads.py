"""What is shown to a judge: JSON of rows in order, with nothing that tells which system they come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import normalize_space


def context_query(current: Column, history: Column, summary: Column) -> Column:
    """Summary, then the history's texts (an array), then the current text, one to a line, white space made single; empty parts are left out."""
    parts = F.concat(F.array(summary), F.coalesce(history, F.array().cast("array<string>")), F.array(current))
    return normalize_space(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n"))


def items_payload(items: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], selected: Column | None = None, only: bool = False, name: str = "items") -> DataFrame:
    """``key, payload``: a key's items in order, with the named fields; ``selected`` marks some of them, or with ``only`` keeps just those."""
    rows = items
    shown = [F.col(f) for f in fields]
    if selected is not None:
        rows = rows.where(selected) if only else rows
        shown += [] if only else [F.coalesce(selected, F.lit(False)).alias("selected")]
    listed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*shown).alias("x"))))
    return rows.groupBy(key).agg(F.to_json(F.struct(F.transform(listed, lambda r: r["x"]).alias(name)), {"ignoreNullFields": "false"}).alias("payload"))


def blind_pairs(rows: DataFrame, context: str, first: str, second: str, swap: Column) -> Column:
    """The shared context and two responses under neutral names, the other way round where ``swap`` holds."""
    a = F.when(swap, F.col(second)).otherwise(F.col(first))
    b = F.when(swap, F.col(first)).otherwise(F.col(second))
    return F.to_json(F.struct(F.col(context).alias("context"), a.alias("response_A"), b.alias("response_B")))


def fixed_cases(turns: DataFrame, track: str, condition: str, order: str, fields: Sequence[str], response: str, conditions: Sequence[str]) -> DataFrame:
    """``track, payload``: the turns of a track with one response for each of two conditions; tracks whose shared ``fields`` differ between the conditions are left out."""
    a, b = conditions
    pick = lambda c: F.max(F.when(F.col(condition) == c, F.col(response)))
    one = F.count_distinct(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields])) == 1
    cases = turns.where(F.col(condition).isin(a, b)).groupBy(track, order).agg(*[F.first(f).alias(f) for f in fields], pick(a).alias("response_A"), pick(b).alias("response_B"), one.alias("_same"))
    whole = cases.withColumn("_ok", F.min(F.col("_same") & F.col("response_A").isNotNull() & F.col("response_B").isNotNull()).over(W.partitionBy(track)))
    return items_payload(whole.where("_ok"), track, [order], [order, *fields, "response_A", "response_B"], name="cases")
