"""Streams over event files. The reference has none; its resumable logs are the nearest relative."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import prepare

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_means(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per window and type: number and mean; rows later than the watermark are dropped, as a stream must."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions per user: events no further apart than ``gap``."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once while the watermark remembers it: the streaming form of resuming by key."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def idempotent_sink(df: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Append each key's rows once, over restarts too: a batch leaves out the keys that the log has."""
    from tessera.sources.rows import append_jsonl, resume

    def write(batch: DataFrame, _: int) -> None:
        append_jsonl(resume(batch.dropDuplicates(keys), path, keys), path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a table at ``path``, and return that.

    Each batch is written by the tasks to a folder of its own, which is written anew if the batch is
    repeated; in complete mode the last one is the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def called(
    df: DataFrame,
    column: str,
    call: Callable[[list[str]], list[str]],
    out: str = "reply",
    attempts: int = 1,
    wait: float = 1.0,
    valid: Callable[[str], bool] | None = None,
    fallback: str | None = None,
) -> DataFrame:
    """The seam for calls to a model: batches of a text column go through an injected function, in the tasks.

    The function gets a list and returns one of the same length. Where it raises or a reply is not
    ``valid``, the texts concerned are tried again, ``attempts`` times in all, after ``wait`` seconds that double
    each time. Then what it raised is raised, or, with a ``fallback``, that stands for the reply.
    ``attempts`` and ``error`` tell how each reply came about.
    """
    prepare(df.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` string, attempts long, error string"

    def run(batches):
        for pdf in batches:
            texts = pdf[column].tolist()
            replies, tries, errors = [None] * len(texts), [0] * len(texts), [None] * len(texts)
            left = list(range(len(texts)))
            for attempt in range(1, attempts + 1):
                if attempt > 1:
                    time.sleep(wait * 2 ** (attempt - 2))
                try:
                    got = call([texts[i] for i in left])
                    found = [None if valid is None or valid(r) else "invalid reply" for r in got]
                except Exception as e:  # noqa: BLE001  a failed call is tried again
                    if attempt == attempts and fallback is None:
                        raise
                    got, found = [None] * len(left), [f"{type(e).__name__}: {e}"] * len(left)
                for i, r, error in zip(left, got, found, strict=True):
                    replies[i], tries[i], errors[i] = r, attempt, error
                left = [i for i in left if errors[i]]
                if not left:
                    break
            if left and fallback is None:
                raise ValueError(f"{len(left)} replies are not valid after {attempts} attempts")
            for i in left:
                replies[i] = fallback
            yield pdf.assign(**{out: replies, "attempts": tries, "error": errors})

    return df.mapInPandas(run, schema)


def closed_loop(df: DataFrame, key: str, order: str, step: Callable[[dict, dict], tuple[dict, dict]], start: dict, schema: str) -> DataFrame:
    """Each key's rows in order through ``step(state, row)``, which gives the next state and the row's result, with columns of ``schema``.

    Keys run in parallel, a key's rows one after the other, as each needs what the one before it left.
    A key's rows meet in one task, so a key is one dialogue, not a user of any length.
    """
    prepare(df.sparkSession)
    kinds = dict(df.dtypes)
    names = [p.split()[0] for p in schema.split(",")]

    def run(pdf):
        state, out = dict(start), []
        for row in pdf.sort_values(order, kind="stable").to_dict("records"):
            state, result = step(state, row)
            out.append([row[key], row[order], *[result[n] for n in names]])
        return pd.DataFrame(out, columns=[key, order, *names])

    return df.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, {schema}")
