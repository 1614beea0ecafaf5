"""Row files, lineage and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.keys import CheckFailed
from tessera.sources import lineage, rows
from tessera.streaming import events


def test_strict_json_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n\n{"b": "y", "a": 2}\n')
    bad.write_text('{"a": 1}\n{"a": \n')
    assert rows.read_jsonl(spark, str(good), "a int, b string").count() == 2
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        rows.read_jsonl(spark, str(bad), "a int, b string").collect()
    assert rows.read_keyed(spark, str(good), "a int, b string", ["a"]).count() == 2


def test_records_in_three_shapes(spark, tmp_path):
    kind = T.StructType([T.StructField("a", T.IntegerType())])
    for name, body in {"l.json": '[{"a": 1}, {"a": 2}]', "o.json": '{"dialogues": [{"a": 3}]}', "j.jsonl": '{"a": 4}\n\n{"a": 5}\n'}.items():
        (tmp_path / name).write_text(body)
    assert sorted(r.a for r in rows.read_records(spark, str(tmp_path), kind).collect()) == [1, 2, 3, 4, 5]
    (tmp_path / "doc.json").write_text('[{"a": 1}]')
    assert rows.read_json_document(spark, str(tmp_path / "doc.json"), kind).first().a == 1


def test_canonical_rows_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(2, ("y", 1), None)], "b int, a struct<z:string,k:int>, c string")
    assert json.loads(rows.canonical_json(df).first().json) == {"a": {"k": 1, "z": "y"}, "b": 2, "c": None}
    assert list(json.loads(rows.canonical_json(df).first().json)) == ["a", "b", "c"]
    log, jobs = str(tmp_path / "log"), spark.range(5).toDF("k")
    assert rows.resume(jobs, log, ["k"]).count() == 5
    rows.append_jsonl(jobs.where("k < 2"), log)
    rows.append_jsonl(jobs.where("k = 4"), log)
    assert sorted(r.k for r in rows.resume(jobs, log, ["k"]).collect()) == [2, 3]
    rows.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_annotations_and_summary(spark, tmp_path):
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "rater1.csv").write_text("﻿pair_code,preference,notes\np1,A,ok\np2,tie,\n")
    got = rows.read_annotations(spark, str(tmp_path / "ann")).collect()
    assert {(r.pair_code, r.preference, r.annotator) for r in got} == {("p1", "A", "rater1"), ("p2", "tie", "rater1")}
    (tmp_path / "ann" / "rater2.csv").write_text("pair_code,preference,notes\np1,C,\n")
    with pytest.raises(Exception, match="outside the domain"):
        rows.read_annotations(spark, str(tmp_path / "ann")).collect()
    rows.write_summary_csv(spark.createDataFrame([("a", 1.23456)], "c string, x double"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().x == "1.235"
    usage = spark.createDataFrame([((10, 5, None),), ((None, 5, 2),)], "u struct<prompt_tokens:int,completion_tokens:int,cached_tokens:int>")
    r = rows.usage_totals(usage, "u", 1.0, 2.0).first()
    assert (r.prompt_tokens, r.completion_tokens, r.cached_tokens, r.cost) == (10, 10, 2, pytest.approx(3e-5))


def test_lineage_notices_changes(spark, tmp_path):
    data = tmp_path / "data"
    (data / "sub").mkdir(parents=True)
    (data / "a.txt").write_text("one")
    (data / "sub" / "b.txt").write_text("two")
    m = {r.path: r.bytes for r in lineage.manifest(spark, str(data)).collect()}
    assert m == {"a.txt": 3, "sub/b.txt": 3}
    a = lineage.attest(spark, "label", [str(data)], [], {"n": 1}, {"rows": 5})
    assert lineage.verify(spark, a, stage="label", counts={"rows": spark.range(5)}) == []
    frozen = lineage.freeze(spark, {"data": str(data)}, {"x": 1})
    lineage.require_frozen(spark, frozen, {"data": str(data)}, {"x": 1})
    (data / "a.txt").write_text("changed")
    assert lineage.verify(spark, a, stage="other", counts={"rows": spark.range(4)}) != []
    assert lineage.verify(spark, a | {"stage": "x"})[0].startswith("attestation")
    for check in (lambda: lineage.require(spark, a), lambda: lineage.require_frozen(spark, frozen, {"data": str(data)}, {"x": 1})):
        with pytest.raises(CheckFailed):
            check()
    run = str(tmp_path / "run")
    assert lineage.ensure_run(spark, run, {"seed": 1}) == lineage.ensure_run(spark, run, {"seed": 1})
    with pytest.raises(CheckFailed):
        lineage.ensure_run(spark, run, {"seed": 2})


def test_sink_writes_each_key_once(spark, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(20)
    for start in ("a", "b"):
        e.write.mode("append").parquet(src)
        events.idempotent_sink(events.event_stream(spark, src), log, str(tmp_path / f"cp_{start}"), ["event_id"]).awaitTermination()
    assert spark.read.json(log).count() == 20


def test_call_seam(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    got = events.called(df, "text", lambda xs: [x.upper() for x in xs]).where(F.col("reply").isNotNull()).collect()
    assert {(r.id, r.reply) for r in got} == {(1, "A"), (2, "B")}


def test_nothing_in_the_library_imports_the_text_operators():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1]
    for p in root.joinpath("tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessera.llm" not in p.read_text(), p
