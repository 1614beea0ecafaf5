"""Large files in blocks: hashes of ranges, numbered lines, and the items of one long JSON list.

Spark splits files of lines by itself, but gives neither line numbers nor pieces of a JSON list, and reads a
binary file as one row. Here a file is a row for each block of it; tasks read their ranges as streams. What a
block needs to know of those before it (how many lines, whether a string is open, how deep the brackets are)
is a running sum over a small table with one row for each block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import durable, prepare

#: Bytes of a block that is hashed, and of one that is parsed (its structure takes some 40 times that in a task).
HASHED, PARSED = 64 << 20, 4 << 20
_CHUNK = 4 << 20
#: Most tasks that blocks are dealt to; beyond, a task gets several.
TASKS = 10_000


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes`` of every file below ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))


def cut(files: DataFrame, size: int) -> DataFrame:
    """``path, bytes, block, start, length``: each file's blocks of ``size`` bytes; an empty file has none."""
    blocks = files.where("bytes > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / size))))
    return blocks.withColumn("start", F.col("block") * size).withColumn("length", F.least(F.lit(size), F.col("bytes") - F.col("start")))


def _tasks(files: DataFrame, size: int) -> int:
    """A task for each 64 MB, four for each core if there are so many blocks. The table of blocks is so small that Spark by itself would put it into one."""
    r = files.agg(F.sum(F.ceil(F.col("bytes") / size)), F.sum(F.ceil(F.col("bytes") / HASHED))).first()
    return max(1, min(TASKS, r[0] or 1, max(r[1] or 1, 4 * files.sparkSession.sparkContext.defaultParallelism)))


def _file(path: str):
    """A file as Spark names it: local, or on a file system that Arrow knows by its address."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _per_block(blocks: DataFrame, n: int, schema: str, rows) -> DataFrame:
    """``rows(file, block)`` of every block, as rows of ``schema``, in ``n`` tasks and batches of some megabytes."""
    prepare(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                with _file(block["path"]) as f:
                    held, weight = [], 0
                    for row in rows(f, block):
                        held.append(row)
                        weight += 64 + len(row.get("value") or "")
                        if weight > _CHUNK:
                            yield pa.RecordBatch.from_pylist(held, schema=kind)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(T._parse_datatype_string(schema))
    return blocks.repartition(n).mapInArrow(run, schema)


def block_hashes(files: DataFrame, size: int = HASHED) -> DataFrame:
    """``path, bytes, block, start, length, sha256`` of each block of ``files`` (path, bytes)."""

    def rows(f, b):
        import hashlib

        h, at, end = hashlib.sha256(), b["start"], b["start"] + b["length"]
        while at < end:
            some = f.read_at(min(_CHUNK, end - at), at)
            if not some:
                raise OSError(f"{b['path']}: shorter than listed")
            h.update(some)
            at += len(some)
        yield {**b, "sha256": h.hexdigest()}

    return _per_block(cut(files, size), _tasks(files, size), "path string, bytes long, block long, start long, length long, sha256 string", rows)


def tree_hashes(files: DataFrame, size: int = HASHED) -> DataFrame:
    """``path, bytes, sha256``: for files of several blocks the hash of their blocks' hashes in order, so that no file is too large."""
    order = F.array_sort(F.collect_list(F.struct("block", "sha256")))
    return block_hashes(files, size).groupBy("path", "bytes").agg(F.sha2(F.array_join(F.transform(order, lambda x: x["sha256"]), ""), 256).alias("sha256"))


def changed_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, block, start, change`` (added, removed, changed) between two tables of ``block_hashes``."""
    both = before.select("path", "block", F.col("start").alias("s0"), F.col("sha256").alias("h0")).join(
        after.select("path", "block", F.col("start").alias("s1"), F.col("sha256").alias("h1")), ["path", "block"], "full"
    )
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("h0").eqNullSafe(F.col("h1"))).select("path", "block", F.coalesce("s0", "s1").alias("start"), change.alias("change"))


def _until(f, at: int, size: int, stop: bytes) -> bytes:
    """Bytes from ``at`` to the first ``stop``, it included, or to the end of the file."""
    out = b""
    while at < size:
        some = f.read_at(min(_CHUNK, size - at), at)
        cut_at = some.find(stop)
        if cut_at >= 0:
            return out + some[: cut_at + 1]
        out, at = out + some, at + len(some)
    return out


def numbered_lines(spark: SparkSession, root: str, size: int = PARSED) -> DataFrame:
    """``path, line, value``: the lines of the files below ``root``, numbered from 1; a line belongs to the block it starts in. No order of rows."""

    def count(f, b):
        yield {"path": b["path"], "block": b["block"], "n": f.read_at(b["length"], b["start"]).count(b"\n")}

    def rows(f, b):
        raw = f.read_at(b["length"], b["start"])
        line, at = b["line"], 0
        if b["start"] and f.read_at(1, b["start"] - 1) != b"\n":
            at = raw.find(b"\n") + 1
            line += 1
            if not at:
                return
        if not raw.endswith(b"\n"):
            raw += _until(f, b["start"] + b["length"], b["bytes"], b"\n")
        for k, text in enumerate(raw[at:].removesuffix(b"\n").split(b"\n") if at < len(raw) else []):
            yield {"path": b["path"], "line": line + k, "value": text.decode(errors="replace").removesuffix("\r")}

    files = listed(spark, root)
    blocks, n = cut(files, size), _tasks(files, size)
    counts = durable(_per_block(blocks, n, "path string, block long, n long", count))
    before = F.sum("n").over(W.partitionBy("path").orderBy("block")) - F.col("n") + 1
    return _per_block(blocks.join(counts.select("path", "block", before.alias("line")), ["path", "block"]), n, "path string, line long, value string", rows)


def read_jsonl_numbered(spark: SparkSession, root: str, schema: T.StructType | str, size: int = PARSED) -> DataFrame:
    """JSON lines of a schema with ``path`` and ``line``; blank lines are skipped, and a line that doesn't fit fails the read by file and number."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    lines = numbered_lines(spark, root, size).where(F.trim("value") != "")
    rows = lines.withColumn("r", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad"}))
    where = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": not a row of the schema"))
    checked = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.raise_error(where).cast(wide)).otherwise(F.col("r"))
    return rows.withColumn("r", checked).select("path", "line", *[F.col("r")[f.name].alias(f.name) for f in kind.fields])


def _structure(raw: bytes, inside: bool, escapes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: +1 and -1 at brackets outside strings, and whether it is a quote that opens or closes a string.

    ``inside`` says whether the bytes start in a string, ``escapes`` how many backslashes stand just before them.
    """
    b = np.frombuffer(raw, np.uint8)
    i = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != 92, i, -1 - escapes))
    run = i - 1 - np.concatenate([[-1 - escapes], plain[:-1]])
    quote = (b == 34) & (run % 2 == 0)
    outside = ((np.cumsum(quote) - quote + inside) % 2) == 0
    step = np.isin(b, (91, 123)).astype(np.int8) - np.isin(b, (93, 125)).astype(np.int8)
    return step * outside, quote


def _read(f, b) -> tuple[bytes, int]:
    raw, n = f.read_at(b["length"], b["start"]), 0
    while n < b["start"] and f.read_at(1, b["start"] - 1 - n) == b"\\":
        n += 1
    return raw, n


def list_items(spark: SparkSession, root: str, field: str | None = None, size: int = PARSED) -> DataFrame:
    """``path, offset, value``: the objects of one JSON list a file, or of the list that an object's ``field`` wraps, as JSON texts.

    A file is parsed by many tasks. A first pass tells of each block how many quotes it has and how the
    depth changes in it, for both cases, that it starts within a string or not; running sums give each
    block its start. For a ``field`` a second pass finds where the outermost object's values open. An item
    belongs to the block it starts in. Files are UTF-8; an item that is no object is left out, and files of other shapes give no rows.
    """
    files = listed(spark, root)
    blocks, n = cut(files, size), _tasks(files, size)

    def summary(f, b):
        raw, escapes = _read(f, b)
        steps, quote = _structure(raw, False, escapes)
        other, _ = _structure(raw, True, escapes)
        yield {"path": b["path"], "block": b["block"], "quotes": int(quote.sum()), "d0": int(steps.sum()), "d1": int(other.sum())}

    w = W.partitionBy("path").orderBy("block")
    found = durable(_per_block(blocks, n, "path string, block long, quotes long, d0 long, d1 long", summary))
    found = found.withColumn("inside", (F.sum("quotes").over(w) - F.col("quotes")) % 2 == 1).withColumn("d", F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0")))
    begun = durable(found.select("path", "block", "inside", (F.sum("d").over(w) - F.col("d")).alias("depth")))
    blocks = blocks.join(begun, ["path", "block"])

    def opens(f, b):
        raw, escapes = _read(f, b)
        steps, _ = _structure(raw, b["inside"], escapes)
        before = b["depth"] + np.cumsum(steps, dtype=np.int64) - steps
        for at in np.flatnonzero((steps == 1) & (before == 1)):
            head = f.read_at(min(4096, b["start"] + int(at)), max(0, b["start"] + int(at) - 4096))
            key = re.search(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', head)
            yield {"path": b["path"], "offset": b["start"] + int(at), "field": json.loads(key[1]) if key else None, "kind": chr(raw[at])}

    if field is None:
        spans = files.select("path", F.lit(-1).cast("long").alias("low"), F.col("bytes").alias("high"))
    else:
        marks = _per_block(blocks, n, "path string, offset long, field string, kind string", opens)
        marks = marks.withColumn("high", F.lead("offset").over(W.partitionBy("path").orderBy("offset")))
        spans = durable(marks.where((F.col("field") == field) & (F.col("kind") == "[")).select("path", F.col("offset").alias("low"), "high"))
    base = 1 if field is None else 2

    def items(f, b):
        raw, escapes = _read(f, b)
        steps, _ = _structure(raw, b["inside"], escapes)
        after = b["depth"] + np.cumsum(steps, dtype=np.int64)
        starts = np.flatnonzero((steps == 1) & (after == base + 1) & (np.frombuffer(raw, np.uint8) == 123))
        ends = np.flatnonzero((steps == -1) & (after == base))
        high = b["bytes"] if b["high"] is None else b["high"]
        if field is None and f.read_at(64, 0).lstrip()[:1] != b"[":
            return
        for s in starts[(b["start"] + starts > b["low"]) & (b["start"] + starts < high)]:
            e = np.searchsorted(ends, s)
            text = raw[s : ends[e] + 1] if e < len(ends) else raw[s:] + _rest(f, b["start"] + b["length"], b["bytes"], raw[s:])
            yield {"path": b["path"], "offset": b["start"] + int(s), "value": text.decode(errors="replace")}

    return _per_block(blocks.join(spans, "path"), n, "path string, offset long, value string", items)


def _rest(f, at: int, size: int, head: bytes) -> bytes:
    """What follows ``head``, the start of an object, up to its end."""
    steps, quote = _structure(head, False, 0)
    depth, inside, out = int(steps.sum()), bool(quote.sum() % 2), b""
    escapes = len(head) - len(head.rstrip(b"\\"))
    while at < size:
        some = f.read_at(min(_CHUNK, size - at), at)
        steps, quote = _structure(some, inside, escapes)
        closed = np.flatnonzero(depth + np.cumsum(steps, dtype=np.int64) == 0)
        if len(closed):
            return out + some[: closed[0] + 1]
        depth, inside, at = depth + int(steps.sum()), inside ^ bool(quote.sum() % 2), at + len(some)
        escapes = len(some) - len(some.rstrip(b"\\")) if some.strip(b"\\") else escapes + len(some)
        out += some
    raise ValueError("an item of the list has no end")


def read_list(spark: SparkSession, root: str, record: T.StructType | str, field: str | None = None, size: int = PARSED) -> DataFrame:
    """The rows of long lists, each file read by many tasks; an item that doesn't fit the record fails the read by file and offset."""
    kind = T._parse_datatype_string(record) if isinstance(record, str) else record
    wide = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    rows = list_items(spark, root, field, size).withColumn("r", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad"}))
    where = F.concat(F.col("path"), F.lit(" at byte "), F.col("offset").cast("string"), F.lit(": not a record of the schema"))
    checked = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.raise_error(where).cast(wide)).otherwise(F.col("r"))
    return rows.withColumn("r", checked).select(*[F.col("r")[f.name].alias(f.name) for f in kind.fields])
