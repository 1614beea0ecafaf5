"""Requests of a stream that are answered, refused, put off and given up."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.queries.registry import Registry
from tessera.queries.states import stream_folders
from tessera.session import ensure_checkpoint_dir
from tessera.streaming import calls

Q = Registry()


def _measured(body: str, structured: bool, note: str | None) -> calls.Reply:
    """Stands for a server that measures a text: some ids it refuses, some in structured mode only, some it answers badly at first."""
    number, text = body.split(" ", 1)
    i = int(number)
    if i % 11 == 0:
        return calls.Reply(503)
    if i % 13 == 0:
        return calls.Reply(429, retry_after=0.01)
    if i % 5 == 0 and structured:
        return calls.Reply(400)
    if i % 7 == 0 and note is None:
        return calls.Reply(200, f"some {len(text)}")
    return calls.Reply(200, json.dumps({"chars": len(text)}))


def _is_object(text: str) -> str | None:
    try:
        return None if isinstance(json.loads(text), dict) else "not an object"
    except ValueError:
        return "not JSON"


@Q.query("""
    SELECT doc_id, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS ok, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 3 ELSE 1 + (doc_id % 5 = 0)::INT + (doc_id % 7 = 0)::INT END::BIGINT AS attempts,
           CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN '{"chars": ' || length(coalesce(text, '')) || '}' END AS reply, CASE WHEN doc_id % 11 = 0 THEN '503: refused' WHEN doc_id % 13 = 0 THEN '429: busy' END AS error
    FROM documents
""")
def resumed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text is sent to a function that stands for a server, over keyed state with timers, until each request has ended."""
    ensure_checkpoint_dir(spark)
    docs = spark.readStream.schema("doc_id long, text string").parquet(f"{d}/documents.parquet*")
    asked = docs.select("doc_id", F.concat_ws(" ", "doc_id", F.coalesce("text", F.lit(""))).alias("body"))
    log = calls.run_calls(calls.attempts_of(asked, "doc_id", "body", _measured, _is_object, calls.Retries(unit=0.001)), *stream_folders(spark))
    return calls.outcomes_of(log).withColumnRenamed("key", "doc_id")
