"""Paired condition deltas with cluster inference, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import inference as inf
from tessera.operators.panel import delta_summary, paired
from tessera.plans.views import panel


def paired_inference(spark: SparkSession, d: str, treatment: str = "purchase", baseline: str = "view", margin: float = 5.0) -> DataFrame:
    """One row: delta summary, pooled and clustered estimates, bootstrap interval, sign-flip p-value and success modes."""
    both = paired(panel(spark, d), ["user_id", "day"], "condition", ["value"], treatment, baseline)
    rows = both.select(F.lit(f"{treatment} - {baseline}").alias("comparison"), "user_id", (F.col("value_a") - F.col("value_b")).alias("delta"))
    g = ["comparison"]
    out = delta_summary(rows, "delta", g)
    out = out.join(inf.cluster_estimate(rows, g, "user_id", "delta").select(*g, "clusters", "pooled", "clustered"), g)
    out = out.join(inf.interval(inf.bootstrap(rows, g, "user_id", "delta"), g), g)
    out = out.join(inf.sign_flip_test(rows, g, "user_id", "delta").select(*g, "p_value"), g)
    return out.select("*", *[c.alias(n) for n, c in inf.success_modes(F.col("low"), F.col("high"), margin).items()])
