"""Calls kept as state: rules for another attempt, and restarts."""

import json
import uuid

import pytest

from tessera.streaming import calls


def requests(spark, folder, rows):
    """A stream over a folder that the rows are added to."""
    spark.createDataFrame(rows, "id long, body string").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema("id long, body string").option("maxFilesPerTrigger", 1).parquet(str(folder))


def counted(folder, answer):
    """``answer``, with a file for each call that is made."""
    folder.mkdir()

    def call(body, structured, note):
        (folder / uuid.uuid4().hex).write_text(json.dumps([body, structured, note]))
        return answer(body, structured, note)

    return call, lambda: [json.loads(f.read_text()) for f in folder.iterdir()]


def answer(body, structured, note):
    if body == "raises":
        raise OSError("no route")
    if body == "busy":
        return calls.Reply(429, retry_after=0.05)
    if body == "plain" and structured:
        return calls.Reply(400)
    if body == "loose" and note is None:
        return calls.Reply(200, "maybe")
    if body == "empty":
        return calls.Reply(200, "  ")
    return calls.Reply(200, f" {body}! ")


def no_maybe(text):
    return "not an answer" if text == "maybe" else None


def test_rules_for_another_attempt(spark, tmp_path):
    call, made = counted(tmp_path / "made", answer)
    bodies = ["fine", "raises", "busy", "plain", "loose", "empty", None]
    rows = [*enumerate(bodies), (None, "no key"), (0, "fine"), (0, "finer")]
    s = calls.attempts_of(requests(spark, tmp_path / "in", rows), "id", "body", call, no_maybe, calls.Retries(unit=0.001))
    log = calls.run_calls(s, str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    got = {r.key: (r.ok, r.attempts, r.reply, r.error) for r in calls.outcomes_of(log).collect()}
    assert got == {
        0: (True, 1, "fine!", None),
        1: (False, 3, None, "OSError: no route"),
        2: (False, 3, None, "429: busy"),
        3: (True, 2, "plain!", None),
        4: (True, 2, "loose!", None),
        5: (False, 3, None, "invalid: empty reply"),
        6: (True, 1, "!", None),
    }
    waits = {(r.key, r.attempt): r.wait_ms for r in log.where("wait_ms is not null").collect()}
    assert waits == {(1, 1): 1, (1, 2): 2, (2, 1): 50, (2, 2): 60}
    assert ["loose", True, "not an answer"] in made() and ["plain", False, None] in made()
    assert len(made()) == log.count() == 15


def test_waits_of_the_rules():
    r = calls.Retries()
    assert [r.wait(n, None) for n in (1, 2, 3, 4, 5)] == [1, 2, 4, 8, 8]
    assert [r.wait(n, calls.Reply(429)) for n in (1, 2, 5)] == [30, 60, 120]
    assert r.wait(1, calls.Reply(429, retry_after=200)) == 200
    assert calls.request_id("a", True, None) != calls.request_id("a", False, None)


def test_a_restart_makes_no_call_twice(spark, tmp_path):
    call, made = counted(tmp_path / "made", answer)
    where = str(tmp_path / "log"), str(tmp_path / "checkpoint")

    def stream(rows):
        return calls.attempts_of(requests(spark, tmp_path / "in", rows), "id", "body", call, no_maybe, calls.Retries(unit=0.05))

    log = calls.run_calls(stream([(1, "raises"), (2, "fine"), (3, "busy")]), *where, stop_after=1)
    assert calls.outcomes_of(log).count() == 1 and len(made()) == 3
    log = calls.run_calls(stream([(2, "fine"), (4, "plain")]), *where)
    assert {(r.key, r.ok, r.attempts) for r in calls.outcomes_of(log).collect()} == {(1, False, 3), (2, True, 1), (3, False, 3), (4, True, 2)}
    assert len(made()) == log.count() == 9
    assert log.groupBy("key", "attempt").count().where("count > 1").isEmpty()
    again = calls.run_calls(stream([(4, "plain")]), *where)
    assert len(made()) == again.count() == 9


def test_a_bucket_holds_many_requests(spark, tmp_path):
    """All keys share one bucket's state: later rows of waiting and ended keys are passed over, and each wait has its own time."""
    call, made = counted(tmp_path / "made", answer)
    bodies = ["fine", "busy", "raises"]
    requests(spark, tmp_path / "in", [(i, bodies[i % 3]) for i in range(60)])
    s = calls.attempts_of(requests(spark, tmp_path / "in", [(i, "plain") for i in range(50, 65)]), "id", "body", call, no_maybe, calls.Retries(unit=0.001), buckets=1)
    got = {r.key: (r.ok, r.attempts) for r in calls.outcomes_of(calls.run_calls(s, str(tmp_path / "log"), str(tmp_path / "checkpoint"))).collect()}
    assert got == {i: (True, 1) if i % 3 == 0 else (False, 3) for i in range(60)} | {i: (True, 2) for i in range(60, 65)}
    assert len(made()) == 20 + 40 * 3 + 5 * 2


def test_no_requests(spark, tmp_path):
    s = calls.attempts_of(requests(spark, tmp_path / "in", [(None, "x")]), "id", "body", answer)
    assert calls.run_calls(s, str(tmp_path / "log"), str(tmp_path / "checkpoint")).isEmpty()


def test_what_the_function_breaks_is_raised(spark, tmp_path):
    def broken(text):
        raise KeyError("broken check")

    s = calls.attempts_of(requests(spark, tmp_path / "in", [(1, "fine")]), "id", "body", answer, broken)
    with pytest.raises(Exception, match="broken check"):
        calls.run_calls(s, str(tmp_path / "log"), str(tmp_path / "checkpoint"))
