"""Saved models: a folder of parameters and arrays, bound by an attestation that is checked when it is loaded.

A model is a dataclass; its plain fields are one JSON line, its arrays rows of a table. Both are bounded by
the model's own parameters, not by the data that it was fitted on. The attestation lies in the folder under
a name that manifests leave out, and holds the folder's digest and those of the inputs.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.boosting import Boosted
from tessera.operators.chain import ActionModel
from tessera.operators.keys import CheckFailed
from tessera.operators.vectors import JointSpace, RobustSpace
from tessera.sources.lineage import _hash, digest, manifest

#: What can be saved, under the name that stands in the folder.
KINDS = {c.__name__: c for c in (ActionModel, Boosted, JointSpace, RobustSpace)}
VERSION = "tessera-model-1"
#: Bytes of one row of an array's table.
PIECE = 1 << 20
_ARRAYS = "name string, part int, dtype string, shape array<long>, bytes binary"


def save(spark: SparkSession, model: object, path: str, inputs: Sequence[str] = (), parameters: Mapping[str, object] | None = None) -> dict:
    """Write ``model`` to a new folder and return the attestation that binds it, its ``parameters`` and the digests of the ``inputs`` it was fitted on."""
    kind = type(model).__name__
    if kind not in KINDS:
        raise ValueError(f"cannot save a {kind}")
    plain, arrays = {}, []
    for f in dataclasses.fields(model):
        v = getattr(model, f.name)
        if isinstance(v, np.ndarray):
            raw = np.ascontiguousarray(v).tobytes()
            arrays += [(f.name, k, v.dtype.str, list(v.shape), bytearray(raw[at : at + PIECE])) for k, at in enumerate(range(0, max(1, len(raw)), PIECE))]
        else:
            plain[f.name] = v
    line = json.dumps({"version": VERSION, "kind": kind, "fields": plain}, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/parameters")
    spark.createDataFrame(arrays, _ARRAYS).coalesce(1).write.parquet(f"{path}/arrays")
    body = {"stage": VERSION, "kind": kind, "model": digest(manifest(spark, path)).first().digest, "inputs": {p: digest(manifest(spark, p)).first().digest for p in inputs}, "parameters": dict(parameters or {})}
    attestation = body | {"self": _hash(body)}
    spark.createDataFrame([(json.dumps(attestation, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{path}/_attestation")
    return attestation


def attestation_of(spark: SparkSession, path: str) -> dict:
    """The attestation of a saved model, if its own hash holds."""
    try:
        lines = [r.value for r in spark.read.text(f"{path}/_attestation").collect()]
    except Exception as e:  # noqa: BLE001  a missing file is a failed check
        raise CheckFailed(f"{path}: no attestation ({type(e).__name__})") from e
    if len(lines) != 1:
        raise CheckFailed(f"{path}: no attestation")
    found = json.loads(lines[0])
    if found.get("self") != _hash({k: v for k, v in found.items() if k != "self"}):
        raise CheckFailed(f"{path}: the attestation's hash differs")
    return found


def load(spark: SparkSession, path: str, kind: type | None = None, inputs: Sequence[str] | None = None) -> object:
    """Read a model; fails unless its files are those that were attested, of this version and ``kind``, and fitted on just these ``inputs`` (if given) as they are now."""
    found = attestation_of(spark, path)
    if found["stage"] != VERSION:
        raise CheckFailed(f"{path}: version {found['stage']} instead of {VERSION}")
    if kind is not None and found["kind"] != kind.__name__:
        raise CheckFailed(f"{path}: a {found['kind']}, not a {kind.__name__}")
    if digest(manifest(spark, path)).first().digest != found["model"]:
        raise CheckFailed(f"{path}: files differ from what was attested")
    if inputs is not None:
        now = {p: digest(manifest(spark, p)).first().digest for p in inputs}
        if now != found["inputs"]:
            raise CheckFailed(f"{path}: inputs differ: {sorted(k for k in {**now, **found['inputs']} if now.get(k) != found['inputs'].get(k))}")
    said = json.loads(spark.read.text(f"{path}/parameters").first().value)
    parts: dict[str, list] = {}
    for r in sorted(spark.read.schema(_ARRAYS).parquet(f"{path}/arrays").collect(), key=lambda r: (r.name, r.part)):
        parts.setdefault(r.name, []).append(r)
    arrays = {name: np.frombuffer(b"".join(bytes(r.bytes) for r in some), some[0].dtype).reshape(some[0].shape) for name, some in parts.items()}
    return KINDS[said["kind"]](**said["fields"], **arrays)


class Scorer(Transformer):
    """A saved or fresh model as a stage: actions are scored, cells predicted, or states and actions turned into vectors."""

    def __init__(self, model: object) -> None:
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for name in ("score_actions", "predict", "transform"):
            if hasattr(self.model, name):
                return getattr(self.model, name)(dataset)
        raise TypeError(f"{type(self.model).__name__} has nothing to apply")

    def save(self, path: str, **kw) -> dict:
        return save(SparkSession.active(), self.model, path, **kw)

    @classmethod
    def load(cls, path: str, **kw) -> Scorer:
        return cls(load(SparkSession.active(), path, **kw))
