"""Calls as keyed state of a stream: attempts, waits and replies survive a restart.

Requests are dealt to buckets by their key, and a bucket's state is two lists: the requests that wait, and the keys that have
ended. So state is read and written once for all of a bucket's requests of a batch. Attempts run in the task that holds the
bucket; what has to wait is a timer, so no task sleeps, and a stream that is stopped or loses an executor goes on where its last
finished batch left off.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.session import prepare

#: One row for each attempt, as its log keeps it. ``wait_ms`` is set where another attempt is due after a wait, ``resumed`` where a
#: wait went before, ``final`` on the key's last one.
LOG = "attempt long, request_id string, structured boolean, status int, reply string, error string, wait_ms long, resumed boolean, final boolean"
_STATE = "body string, tried long, structured boolean, note string, due long"
#: Log rows of one batch that a task hands to Spark.
_ROWS = 1_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Reply:
    """What a call gave: an HTTP-like status, the text, and the seconds that the server asks to wait."""

    status: int
    text: str | None = None
    retry_after: float = 0.0


@dataclass(frozen=True)
class Retries:
    """When to try again. Waits are in seconds; ``unit`` scales those that the server did not ask for.

    A busy server (429) is left alone for what it asks, at least 30 units times the attempt, up to 120. A refusal of the
    structured mode (400 and above) drops that mode and tries at once. Other failures wait 1, 2, 4 and then 8 units.
    A reply that isn't ``valid`` is tried at once, with the reason as the note that the call gets.
    """

    attempts: int = 3
    unit: float = 1.0

    def wait(self, attempt: int, reply: Reply | None) -> float:
        if reply is not None and reply.status == 429:
            return max(reply.retry_after, self.unit * min(30 * attempt, 120))
        return self.unit * min(2 ** (attempt - 1), 8)


def request_id(body: str, structured: bool, note: str | None) -> str:
    """Digest of what is asked: equal for a repeated attempt, so that a server or proxy can tell one."""
    return hashlib.sha256(json.dumps([body, structured, note]).encode()).hexdigest()


class _Calls(StatefulProcessor):
    def __init__(self, call, valid, retries: Retries, kind: str):
        self.call, self.valid, self.retries, self.kind = call, valid, retries, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"key {self.kind}, {_STATE}")
        self.ended = handle.getListState("ended", f"key {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = {}
        for pdf in rows:
            for k, body in zip(pdf["key"].tolist(), pdf["body"].tolist(), strict=True):
                body = body or ""
                asked[k] = min(asked.get(k, body), body)
        waiting = list(self.waiting.get())
        for k in [*(r[0] for r in waiting), *(r[0] for r in self.ended.get())]:
            asked.pop(k, None)
        yield from self._run([(k, body, 0, True, None, None) for k, body in asked.items()], waiting, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = list(self.waiting.get())
        due = [r for r in waiting if r[-1] <= now]
        if due:  # another timer may have had them
            yield from self._run(due, [r for r in waiting if r[-1] > now], timerValues, True)

    def close(self) -> None:
        pass

    def _run(self, requests, waiting, timers, resumed) -> Iterator[pd.DataFrame]:
        """Attempts of all ``requests``; the bucket's state is ``waiting`` and what has to wait of them."""
        now, log, ended, dues = timers.getCurrentProcessingTimeInMs(), [], [], set()
        for r in requests:
            rows, again = self._attempts(*r[:-1], resumed)
            log += rows
            if again is None:
                ended.append((r[0],))  # a finished request is remembered by its key alone
            else:
                dues.add(now + again[-1])
                waiting.append((*again[:-1], now + again[-1]))
            if len(log) >= _ROWS:
                yield self._frame(log)
                log = []
        for due in sorted(dues):
            self.handle.registerTimer(due)
        if ended:
            self.ended.appendList(ended)
        if waiting:
            self.waiting.put(waiting)
        elif resumed:
            self.waiting.clear()
        if log:
            yield self._frame(log)

    @staticmethod
    def _frame(log) -> pd.DataFrame:
        return pd.DataFrame(log, columns=["key", *(f.split()[0] for f in LOG.split(", "))]).astype({"status": "Int32", "wait_ms": "Int64"})

    def _attempts(self, key, body, tried, structured, note, resumed) -> tuple[list[tuple], tuple | None]:
        """A request's attempts until one is final or a wait is due: their rows, and the request with its wait."""
        out = []
        while True:
            tried += 1
            asked = (tried, request_id(body, structured, note), structured)
            reply, error, wait = None, None, None
            try:
                reply = self.call(body, structured, note)
            except Exception as e:  # noqa: BLE001  a failed call is an attempt
                error = f"{type(e).__name__}: {e}"
            last = tried >= self.retries.attempts
            if reply is None:
                wait = self.retries.wait(tried, None)
            elif reply.status == 429:
                error, wait = "429: busy", self.retries.wait(tried, reply)
            elif reply.status >= 400:
                error = f"{reply.status}: {'structured mode refused' if structured else 'refused'}"
                structured, wait = False, None if structured else self.retries.wait(tried, reply)
            else:
                problem = "empty reply" if not (reply.text or "").strip() else self.valid(reply.text) if self.valid else None
                if problem:
                    error, note = f"invalid: {problem}", problem
            final = error is None or last
            wait_ms = None if final or wait is None else max(1, int(wait * 1000))
            out.append((key, *asked, reply.status if reply else None, reply.text.strip() if error is None else None, error, wait_ms, resumed, final))
            resumed = False
            if final:
                return out, None
            if wait_ms is not None:
                return out, (key, body, tried, structured, note, wait_ms)


def attempts_of(
    requests: DataFrame, key: str, body: str, call: Callable[[str, bool, str | None], Reply], valid: Callable[[str], str | None] | None = None, retries: Retries = Retries(), buckets: int = 1024
) -> DataFrame:
    """A stream's requests as a stream of ``key`` and the columns of ``LOG``, one row for each attempt.

    ``call(body, structured, note)`` gives a ``Reply`` or raises; ``valid(text)`` gives what is wrong with a reply, or none. A key is
    asked for once: later rows of a key, in any batch, are passed over; of rows in one batch the least body counts, and a null
    body is empty. Rows with a null key are left out. A key whose attempts are used up has a final row with its error.
    """
    prepare(requests.sparkSession)
    kind = dict(requests.dtypes)[key]
    rows = requests.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(body).cast("string").alias("body"))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(_Calls(call, valid, retries, kind), f"key {kind}, {LOG}", "append", "processingTime")


def run_calls(attempts: DataFrame, path: str, checkpoint: str, interval: str = "200 milliseconds", stop_after: int | None = None) -> DataFrame:
    """Run the stream of ``attempts_of`` until nothing is left to read and no wait is open; the log at ``path``.

    Started again on the same folders it goes on: finished attempts are neither made again nor logged again. A batch that was cut
    off is made again as a whole, with the same request ids. ``stop_after`` ends it after so many batches, as a failure would.
    """
    spark = attempts.sparkSession
    counts = {"open": 0, "batches": 0}

    def logged(at: str = path) -> DataFrame:
        try:
            return spark.read.schema(attempts.schema).option("recursiveFileLookup", True).parquet(at)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], attempts.schema)

    def open_waits(df: DataFrame) -> int:
        r = df.agg(F.count("wait_ms").alias("w"), F.count_if("resumed").alias("r")).first()
        return r.w - r.r

    def write(batch: DataFrame, number: int) -> None:
        if stop_after is not None and counts["batches"] >= stop_after:
            raise RuntimeError("stopped")  # before the batch's rows are asked for, so none of its calls is made
        at = f"{path}/batch={number}"
        before = 0 if counts["batches"] else open_waits(logged(at))  # the first batch after a restart may have been written already
        batch.write.mode("overwrite").parquet(at)
        counts["open"] += open_waits(logged(at)) - before
        counts["batches"] += 1

    counts["open"] = open_waits(logged())
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        q = attempts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    try:
        while q.isActive:
            seen = q.lastProgress
            if seen and seen["numInputRows"] == 0 and counts["batches"] and counts["open"] == 0:
                break
            time.sleep(0.1)
        if q.exception() and not (stop_after is not None and counts["batches"] >= stop_after):
            raise q.exception()
    finally:
        q.stop()
    return logged()


def outcomes_of(log: DataFrame) -> DataFrame:
    """``key, ok, attempts, reply, error``: how each key's request ended; keys that still wait are not there."""
    return log.where("final").select("key", F.col("error").isNull().alias("ok"), F.col("attempt").alias("attempts"), "reply", "error")
