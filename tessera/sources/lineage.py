"""Content-addressed lineage: manifests, attestations and freezes of file trees."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.keys import CheckFailed
from tessera.sources.blocks import HASHED, tree_hashes


def manifest(spark: SparkSession, root: str, exclude: str = r"/(?:__pycache__|\.[^/]*|_[^/]*)(?:/|$)") -> DataFrame:
    """``path, bytes, sha256`` of every file below ``root``, relative to it; hashes are taken where the files are read.

    Files of up to one block (64 MB) are hashed whole. Larger ones are read by many tasks, and their hash
    is that of their blocks' hashes in order, whatever their size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    small = files.where(F.col("length") <= HASHED).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = tree_hashes(files.where(F.col("length") > HASHED).select("path", F.col("length").alias("bytes")))
    base = F.regexp_replace(F.lit(root), r"^\w+:/*|^/+|/+$", "")
    path = F.regexp_replace("path", r"^\w+:/*", "")
    rel = F.regexp_replace(F.substr(path, F.length(base) + 1), "^/+", "")
    rows = small.unionByName(large).withColumn("path", rel)
    return rows.where(~F.concat(F.lit("/"), F.col("path")).rlike(exclude))


def digest(files: DataFrame) -> DataFrame:
    """One row: number of files, bytes, and the hash of their sorted list (paths and hashes, not contents).

    Files are dealt to 4,096 lists by a hash of their path, and the digest is the hash of these lists'
    hashes, so no row holds the paths of a whole tree.
    """
    line = F.concat_ws("\x1f", "path", F.col("bytes").cast("string"), "sha256")
    parts = files.groupBy(F.substring(F.md5("path"), 1, 3).alias("part")).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h")
    )
    lists = F.array_sort(F.collect_list(F.concat("part", "h")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return parts.agg(total("files"), total("bytes"), F.sha2(F.array_join(lists, "\n"), 256).alias("digest"))


def _hash(obj: object) -> str:
    return hashlib.sha256(json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def attest(spark: SparkSession, stage: str, inputs: Sequence[str], outputs: Sequence[str], parameters: Mapping[str, object], rows: Mapping[str, int]) -> dict:
    """Bind a stage to the digests of its inputs and outputs, its parameters and row counts, under a hash of it all."""
    body = {
        "stage": stage,
        "inputs": {p: digest(manifest(spark, p)).first().digest for p in inputs},
        "outputs": {p: digest(manifest(spark, p)).first().digest for p in outputs},
        "parameters": dict(parameters),
        "rows": dict(rows),
    }
    return body | {"self": _hash(body)}


def verify(spark: SparkSession, attestation: Mapping[str, object], stage: str | None = None, counts: Mapping[str, DataFrame] | None = None) -> list[str]:
    """What doesn't hold: the attestation's own hash, the stage, digests of files, and row counts."""
    body = {k: v for k, v in attestation.items() if k != "self"}
    errors = [] if _hash(body) == attestation.get("self") else ["attestation: hash differs"]
    if stage and stage != body["stage"]:
        errors.append(f"stage: {body['stage']} instead of {stage}")
    for side in ("inputs", "outputs"):
        for path, want in body[side].items():
            try:
                got = digest(manifest(spark, path)).first().digest
            except Exception as e:  # noqa: BLE001  a missing tree is a finding, not a crash
                got = type(e).__name__
            if got != want:
                errors.append(f"{side}: {path} differs")
    errors += [f"rows: {k}" for k, df in (counts or {}).items() if df.count() != body["rows"].get(k)]
    return errors


def require(spark: SparkSession, attestation: Mapping[str, object], **checks) -> None:
    if errors := verify(spark, attestation, **checks):
        raise CheckFailed("; ".join(errors))


def freeze(spark: SparkSession, sections: Mapping[str, str], config: Mapping[str, object]) -> dict:
    """Digests of several trees (data, code, checkpoints and so on) and of a configuration."""
    body = {"config": _hash(dict(config)), "sections": {k: digest(manifest(spark, p)).first().digest for k, p in sections.items()}}
    return body | {"self": _hash(body)}


def require_frozen(spark: SparkSession, frozen: Mapping[str, object], sections: Mapping[str, str], config: Mapping[str, object]) -> None:
    """Fail unless the same trees and the same configuration are frozen."""
    now = freeze(spark, sections, config)
    if now != dict(frozen):
        changed = [k for k in now["sections"] if now["sections"][k] != frozen["sections"].get(k)]
        raise CheckFailed(f"freeze differs: {changed or 'config'}")


def ensure_run(spark: SparkSession, path: str, metadata: Mapping[str, object]) -> str:
    """Record a run's metadata at ``path``, or check that what is recorded there is the same; returns its hash."""
    h = _hash(dict(metadata))
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        if [r.value for r in spark.read.text(path).collect()] != [h]:
            raise CheckFailed(f"{path}: another run's manifest")
    else:
        spark.createDataFrame([(h,)], "value string").coalesce(1).write.text(path)
    return h
