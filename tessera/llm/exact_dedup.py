"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import ascii_lower
from tessera.session import durable

#: Most lengths or (length, prefix) classes that are broadcast, at some 40 bytes each.
BROADCAST_KEYS = 1_000_000


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 128,
    digest: bool = False,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept`` and, with ``digest``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest id of a group stays (a null id is smaller than any other); among repeated rows of that id
    one stays. An empty table gives an empty result; other columns are ignored.

    Rows are counted by byte length; those of shared lengths by length and a hash of their prefix; only
    rows that have company in both are hashed whole and grouped (``digest`` asks for the hash of all
    rows, as a column). The shared lengths and (length, prefix) classes are broadcast if there are at
    most ``broadcast_keys``; beyond that hashes are taken before a shuffled join, so that texts never
    move. Groups are sums and maxima, which combine before the shuffle; a group of any size meets in
    no task. Texts of any length are taken whole.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        body.alias("body"),
        F.octet_length(body).alias("len"),
        F.xxhash64(ascii_lower(F.substring(body, 1, prefix_chars))).alias("prefix"),
    )
    lengths = durable(base.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select(F.col("len").alias("l")))
    few = lengths.count() <= broadcast_keys
    alike = base.select("len", "prefix").join(F.broadcast(lengths) if few else lengths, F.col("len") == F.col("l"), "left_semi")
    pairs = alike.groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    pairs = durable(pairs.select(F.col("len").alias("l"), F.col("prefix").alias("p"), F.lit(True).alias("shared")))
    full = F.unhex(F.sha2(ascii_lower(F.col("body")), 256))
    same = (F.col("len") == F.col("l")) & (F.col("prefix") == F.col("p"))
    if pairs.count() <= broadcast_keys:
        met = base.join(F.broadcast(pairs), same, "left")
        rows = met.select("id", F.when(F.lit(digest) | F.col("shared"), full).alias("sha"), "shared")
    else:
        rows = base.select("id", "len", "prefix", full.alias("sha")).join(pairs, same, "left").select("id", "sha", "shared")
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    groups = (
        rows.where("shared")
        .groupBy("sha")
        .agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("sha").alias("group_sha"), "best", "n")
    )
    groups = durable(groups)  # with a plan of its own, the join below can be split where a group is large
    out = rows.join(groups, rows.sha == groups.group_sha, "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n") > 1, F.col("best.id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return out if digest else out.drop("text_sha256")
