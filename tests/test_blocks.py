"""Files in blocks against plain reads of the same files."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import blocks, lineage


def odd_records(n, seed=1):
    rng = random.Random(seed)
    words = ['a', '"', '\\', '{', '}', '[', ']', ':', ',', 'é', '\n', '\\"', '"items": [', '\\\\']
    return [{"id": i, "text": "".join(rng.choice(words) for _ in range(rng.randrange(30))), "inner": {"l": [[i], {"x": "]"}]}} for i in range(n)]


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_items_of_lists_whatever_the_blocks(spark, tmp_path, size):
    records = odd_records(60)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.json").write_text(json.dumps(records))
    (tmp_path / "plain" / "b.json").write_text(json.dumps(records[:5], indent=2, ensure_ascii=False))
    (tmp_path / "plain" / "none.json").write_text("[]")
    (tmp_path / "plain" / "empty.json").write_text("")
    got = blocks.list_items(spark, str(tmp_path / "plain"), size=size).collect()
    assert sorted(json.loads(r.value)["id"] for r in got) == sorted([*range(60), *range(5)])
    assert all(json.loads(r.value) == records[json.loads(r.value)["id"]] for r in got)
    (tmp_path / "wrapped").mkdir()
    body = {"note": {"items": [{"id": -1}]}, "before": [{"id": -2}], "items": records, "after": [{"id": -3}, [{"id": -4}]], "n": 3}
    (tmp_path / "wrapped" / "a.json").write_text(json.dumps(body, indent=1))
    got = blocks.list_items(spark, str(tmp_path / "wrapped"), "items", size=size).collect()
    assert sorted((json.loads(r.value) for r in got), key=lambda r: r["id"]) == records
    rows = blocks.read_list(spark, str(tmp_path / "wrapped"), "id long, text string", "items", size=size)
    assert {(r.id, r.text) for r in rows.collect()} == {(r["id"], r["text"]) for r in records}


def test_a_bad_item_is_named_by_its_offset(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": "x"}]')
    with pytest.raises(Exception, match="a.json at byte 12"):
        blocks.read_list(spark, str(tmp_path), "id long").collect()


@pytest.mark.parametrize("size", [1, 5, 4096])
def test_lines_are_numbered_and_bad_ones_named(spark, tmp_path, size):
    lines = ["{}", "", '{"a": 1}', "x" * 17, '{"a": 2}\r', "é", "last"]
    for name, end in (("a.jsonl", ""), ("b.jsonl", "\n")):
        (tmp_path / name).write_bytes(("\n".join(lines) + end).encode())
    got = blocks.numbered_lines(spark, str(tmp_path), size=size).collect()
    want = [(i + 1, x.removesuffix("\r")) for i, x in enumerate(lines)]
    assert sorted((r.line, r.value) for r in got) == sorted(want * 2)
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert {(r.line, r.a) for r in blocks.read_jsonl_numbered(spark, str(good), "a long", size=size).collect()} == {(1, 1), (3, 2)}
    (good / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception, match="a.jsonl:3: not a row"):
        blocks.read_jsonl_numbered(spark, str(good), "a long", size=size).collect()


def test_long_list_is_read_by_many_tasks(spark, tmp_path):
    record = {"id": 0, "text": "word " * 400}
    (tmp_path / "a.json").write_text(json.dumps({"items": [record | {"id": i} for i in range(6000)]}))
    rows = blocks.read_list(spark, str(tmp_path), "id long, text string", "items", size=1 << 20)
    assert rows.groupBy(F.spark_partition_id().alias("p")).count().count() > 2
    assert rows.agg(F.countDistinct("id"), F.sum(F.length("text"))).first()[:] == (6000, 6000 * 2000)


def test_block_hashes_name_what_changed(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    raw = random.Random(2).randbytes(2500)
    (data / "a.bin").write_bytes(raw)
    (data / "empty.bin").write_bytes(b"")
    files = blocks.listed(spark, str(data))
    old = blocks.block_hashes(files, 1000)
    assert [r.sha256 for r in old.orderBy("block").collect()] == [hashlib.sha256(raw[i : i + 1000]).hexdigest() for i in (0, 1000, 2000)]
    old = spark.createDataFrame(old.collect(), old.schema)
    (data / "a.bin").write_bytes(raw[:1500] + b"!" + raw[1501:] + b"more" * 300)
    new = blocks.block_hashes(blocks.listed(spark, str(data)), 1000)
    got = {(r.block, r.start, r.change) for r in blocks.changed_blocks(old, new).collect()}
    assert got == {(1, 1000, "changed"), (2, 2000, "changed"), (3, 3000, "added")}


def test_manifest_of_a_file_above_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((2 << 30) + 5)
    (tmp_path / "small.bin").write_bytes(b"one")
    got = {r.path: (r.bytes, r.sha256) for r in lineage.manifest(spark, str(tmp_path)).collect()}
    assert got["small.bin"] == (3, hashlib.sha256(b"one").hexdigest())
    whole, tail = hashlib.sha256(bytes(blocks.HASHED)).hexdigest(), hashlib.sha256(bytes(5)).hexdigest()
    assert got["large.bin"] == ((2 << 30) + 5, hashlib.sha256((whole * 32 + tail).encode()).hexdigest())
    assert lineage.digest(lineage.manifest(spark, str(tmp_path))).first().files == 2
