"""Mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.text import word_count
from tessera.session import durable

#: Bits of a row's random key.
KEY_BITS = 60
#: Bits of a bucket's place on its shelf.
SHELF_BITS = 10


def source_targets(sizes: DataFrame, weights: Sequence[int], share_pct: int, max_epochs: int) -> DataFrame:
    """Add ``rank`` and ``target`` to one row per source with ``source`` and ``source_size``.

    Sources by code point, null last, get ``weights`` in turn and share ``share_pct`` per cent of all
    sizes; no target exceeds ``max_epochs`` times its source, and what is left over is shared again by
    weight. Sorted by the level at which each source is full, the full ones are a prefix, so the level
    that the others get follows from two running sums.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("w", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_level = W.orderBy(F.col("source_size") / F.col("w"), "rank")
    s = (
        s.withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("full_before", F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("w_rest", F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") * share_pct / 100.0 - F.col("full_before")) / F.col("w_rest"))
        .withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
        .withColumn("order", F.row_number().over(by_level))
    )
    everyone = W.partitionBy()
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("order"))).over(everyone)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w"))
    return s.select("source", "source_size", "n_rows", "rank", F.round(target, 6).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share_pct: int = 150,
    max_epochs: int = 2,
    seed: str = "mix",
    rows_per_bucket: int = 4_000,
) -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, taken``.

    ``size`` is the number of words (null text: 0), ``taken`` how many of them the mix takes, repeats
    counted. Each source is taken in the order of a hash of seed and id: whole epochs first, then
    documents until its budget (the target, rounded) is spent; the document at the cut gives just the
    words that are missing. Null is a source of its own, null ids share a key, rows that tie are ordered
    by size, and repeated rows are interchangeable. A source without words takes none; an empty table
    gives an empty result.

    Rows are range-partitioned by key into buckets of about ``rows_per_bucket`` within each source, so a
    source of any size is spread; only within a bucket are rows sorted. Bucket totals are summed on
    shelves of ``2 ** SHELF_BITS`` buckets, and shelf totals within each source, so a task of a source
    of n rows holds n / ``rows_per_bucket`` / ``2 ** SHELF_BITS`` totals. Only sources meet in one task.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))), 1, KEY_BITS // 4), 16, 10)
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.cast("long").alias("key")
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / rows_per_bucket))).cast("int")
    s = durable(source_targets(sizes, weights, share_pct, max_epochs).withColumn("bits", bits))
    placed = rows.join(s.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "bucket", F.expr(f"shiftright(key, {KEY_BITS} - bits)")
    )
    totals = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("in_bucket"))
    totals = durable(totals.withColumn("shelf", F.expr(f"shiftright(bucket, {SHELF_BITS})")))
    shelves = totals.groupBy("rank", "shelf").agg(F.sum("in_bucket").alias("in_shelf"))
    shelf_start = F.sum("in_shelf").over(W.partitionBy("rank").orderBy("shelf")) - F.col("in_shelf")
    shelves = shelves.select(F.col("rank").alias("r"), F.col("shelf").alias("h"), shelf_start.alias("shelf_start"))
    before = F.sum("in_bucket").over(W.partitionBy("rank", "shelf").orderBy("bucket")) - F.col("in_bucket")
    starts = totals.withColumn("before", before).join(shelves, (F.col("rank") == F.col("r")) & (F.col("shelf") == F.col("h")))
    starts = starts.select(F.col("rank").alias("r"), F.col("bucket").alias("b"), (F.col("shelf_start") + F.col("before")).alias("start"))
    inner = W.partitionBy("rank", "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    run = placed.withColumn("upto", F.sum("size").over(inner)).join(
        starts, (F.col("rank") == F.col("r")) & (F.col("bucket") == F.col("b"))
    )
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    first = F.col("start") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - first))
    return run.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )
