"""The reference entities as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.actions import ACTIONS
from tessera.session import table


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Units (user, day) by condition (event type), with mean value and number of events."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("condition")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


PANEL_SQL = "panel AS (SELECT user_id, ts::DATE AS day, event_type AS condition, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3)"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Facts per (card, action): order lines, of which the first by part stands for each action.

    ``response`` and the two risks are shares, ``cost`` is tokens; ``available`` is the card's mask of sources.
    Lines are dealt by card, so that what groups or orders a card's actions later needs no shuffle of its own.
    """
    names = F.array(*map(F.lit, ACTIONS))
    n = F.pmod(F.col("l_linenumber") * 5 + F.col("l_partkey") % 3, F.lit(16)) + 1
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("card_id"),
        F.element_at(names, n.cast("int")).alias("action_id"),
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag").alias("s"),
    )
    first = rows.repartition("card_id").groupBy("card_id", "action_id").agg(F.min("s").alias("s"))
    return first.select(
        "card_id",
        "action_id",
        (F.col("s.l_discount") * 10).alias("response"),
        (F.col("s.l_tax") * 12.5).alias("misuse"),
        (F.pmod(F.col("s.l_suppkey"), F.lit(5)) / 4).alias("omission"),
        F.col("s.l_quantity").alias("cost"),
        F.col("s.l_returnflag").alias("flag"),
        F.pmod(F.col("card_id"), F.lit(8)).cast("int").alias("available"),
        F.pmod(F.col("card_id"), F.lit(12)).alias("user_id"),
    )


_ACTION_LIST = ", ".join(f"'{a}'" for a in ACTIONS)
OUTCOMES_SQL = f"""outcomes AS (
    SELECT card_id, action_id, s.l_discount * 10 AS response, s.l_tax * 12.5 AS misuse, (s.l_suppkey % 5) / 4 AS omission, s.l_quantity AS cost,
           s.l_returnflag AS flag, (card_id % 8)::INT AS available, card_id % 12 AS user_id
    FROM (SELECT l_orderkey AS card_id, [{_ACTION_LIST}][((l_linenumber * 5 + l_partkey % 3) % 16 + 1)::INT] AS action_id,
                 min(struct_pack(l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag)) AS s
          FROM lineitem GROUP BY 1, 2))"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Judged rows per event: unit, condition, order of presentation, position and ratings from 0 to 3 or 1 to 5."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id"),
        (F.col("event_id") % 400).alias("unit"),
        (F.floor(F.col("event_id") / 400) % 4).alias("variant"),
        (F.col("event_id") % 3).alias("position"),
        F.col("event_type").alias("condition"),
        F.col("user_id"),
        (F.floor(F.col("value")) % 4).cast("long").alias("risk"),
        (F.floor(F.col("value") * 10) % 3).cast("long").alias("exposure"),
        (1 + F.floor(F.col("value")) % 5).cast("long").alias("rating"),
        (1 + F.floor(F.col("value") * 100) % 5).cast("long").alias("second"),
    )


SCORES_SQL = """scores AS (SELECT event_id, event_id % 400 AS unit, (event_id // 400) % 4 AS variant, event_id % 3 AS position, event_type AS condition, user_id,
    (floor(value)::BIGINT % 4) AS risk, (floor(value * 10)::BIGINT % 3) AS exposure, (1 + floor(value)::BIGINT % 5) AS rating,
    (1 + floor(value * 100)::BIGINT % 5) AS second FROM events)"""


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise verdicts in both orders per (user, day): the label says which of the two sides shown first has more value."""
    e = table(spark, d, "events")
    day = F.to_date("ts").alias("day")
    g = e.groupBy("user_id", day).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("k"), F.count("*").alias("n"))
    label = lambda x: F.when(x % 7 < 3, "A").when(x % 7 < 5, "B").otherwise("tie")
    k = F.col("k")
    ab = g.select("user_id", "day", F.lit("AB").alias("order"), label(k).alias("label"))
    ba = g.select("user_id", "day", F.lit("BA").alias("order"), label(k + F.col("n")).alias("label"))
    return ab.unionByName(ba)


_LABEL = "CASE WHEN ({x}) % 7 < 3 THEN 'A' WHEN ({x}) % 7 < 5 THEN 'B' ELSE 'tie' END"
VERDICTS_SQL = f"""days AS (SELECT user_id, ts::DATE AS day, sum(round(value * 100)::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2),
    verdicts AS (SELECT user_id, day, 'AB' AS "order", {_LABEL.format(x='k')} AS label FROM days
                 UNION ALL SELECT user_id, day, 'BA', {_LABEL.format(x='k + n')} FROM days)"""
