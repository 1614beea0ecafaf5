"""Near-dedup of embeddings: int8 tiles with error bounds, full precision where the bound leaves it open."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import is_finite, matrix
from tessera.operators.graph import connected_components
from tessera.session import prepare, removed, stored

#: Members that a bucket should have, most of one half of a cell, rows of a tile, and pairs that are recomputed together.
BUCKET, CELL, TILE, PIECE = 2_048, 4_096, 512, 1 << 15
#: Float products of codes of so many places are exact integers (places x 127^2 below 2^24).
FLOAT_PLACES = (1 << 24) // 127**2


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit rows, the step of each row, and the length of what the codes miss, rounded up."""
    step = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / step[:, None]).astype(np.int8)
    missed = u - codes * step[:, None]
    return codes, step, np.sqrt((missed * missed).sum(axis=1)) + 1e-12


def close_pairs(u: np.ndarray, left: int, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``i, j`` of unit rows with a cosine of at least ``cosine``: of the first ``left`` rows with the rest, or (``same``) of all rows with each other.

    With codes a, b, steps s, t and missed parts p, q, the cosine is s t (a . b) + s (a . q) + (p . v): it
    differs from s t (a . b) by at most (1 + |p|) |q| + |p|. Pairs that this bound settles need no more;
    the others are computed in double precision.
    """
    codes, step, miss = quantised(u)
    wide = codes.astype(np.float32 if u.shape[1] <= FLOAT_PLACES else np.float64)
    for a in range(0, left, TILE):
        b = min(left, a + TILE)
        cols = slice(a, len(u)) if same else slice(left, len(u))
        about = (wide[a:b] @ wide[cols].T) * step[a:b, None] * step[None, cols]
        slack = miss[a:b, None] + (1 + miss[a:b, None]) * miss[None, cols] + 1e-6
        possible = about + slack >= cosine
        if same:
            possible &= np.arange(a, b)[:, None] < np.arange(a, len(u))
        for at in np.array_split(np.flatnonzero(possible), -(-np.count_nonzero(possible) // PIECE) or 1):
            i, j = np.unravel_index(at, possible.shape)
            sure = about[i, j] - slack[i, j] >= cosine
            i, j = i + a, j + cols.start
            open_ = np.flatnonzero(~sure)
            sure[open_] = np.einsum("ij,ij->i", u[i[open_]], u[j[open_]]) >= cosine
            yield i[sure], j[sure]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of linked rows in place: a class is its smallest row."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def bucket_plan(n: int, cosine: float, miss: float, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a bucket and number of tables, so that ``n`` vectors fill buckets of some ``bucket`` and a pair at ``cosine`` shares none with probability at most ``miss``."""
    bits = max(1, round(math.log2(max(2, n) / bucket)))
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - met))


def close_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, miss: float = 1e-5, seed: int = 12, bucket: int = BUCKET, cell: int = CELL
) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept`` (other rows with at least this cosine; the smallest id reachable; whether that is the row's own).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay.
    Shorter vectors count as padded with zeros. Repeated rows are rows of their own and link with each
    other; a null id names a component only where it has no other. Other columns are ignored; an empty
    table gives an empty result.

    Equal vectors fall together before anything is compared. The others go to one bucket of each of
    several tables, named by the sides of random planes that they lie on; a pair at ``cosine`` shares
    none with probability ``miss`` at most, a nearer one with less, and no other pair is lost. Members
    of a bucket are compared in tiles (see ``close_pairs``); buckets of more than ``cell`` are cut into
    chunks, of which each pair makes a cell. A pair that meets in several tables counts in the first. Of
    a cell only link counts and the members' classes leave.
    """
    spark = rows.sparkSession
    prepare(spark)
    own = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    fine = is_finite("v") & F.exists("v", lambda x: x != 0)
    own = own.withColumn("v", F.when(fine, F.col("v"))).withColumn("d1", F.xxhash64(F.lit(1), "v")).withColumn("d2", F.xxhash64(F.lit(2), "v"))
    classes = own.where("v is not null").groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes, path = stored(classes.withColumn("k", F.monotonically_increasing_id()))
    n, dim = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    bits, tables = bucket_plan(n, cosine, miss, bucket)
    planes = np.random.default_rng(seed).standard_normal((dim or 1, tables * bits))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = unit_rows(matrix(b.column(2), dim, np.float64)) @ planes > 0
            key = side.reshape(b.num_rows, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            key = pa.ListArray.from_arrays(np.arange(0, key.size + 1, tables, dtype=np.int32), key.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), key], ["k", "n", "v", "keys"])

    kind = dict(classes.dtypes)["v"]
    keyed, keyed_path = stored(classes.select("k", "n", "v").mapInArrow(keys, f"k bigint, n bigint, v {kind}, keys array<bigint>"))
    met = keyed.select("k", "n", "v", "keys", F.posexplode("keys").alias("t", "key"))
    counts = met.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    counts = counts.select(F.col("t").alias("ct"), F.col("key").alias("ckey"), F.ceil(F.col("size") / cell).cast("int").alias("chunks"))
    met = met.join(counts, (F.col("t") == F.col("ct")) & (F.col("key") == F.col("ckey"))).withColumn("c", F.expr("pmod(xxhash64(k), chunks)").cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d"))
    met = met.select("t", "key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "c", "k", "n", "v", "keys")

    def compare(group: pa.Table) -> pa.Table:
        t, i, j = (group[c][0].as_py() for c in ("t", "i", "j"))
        group = group.sort_by([("c", "ascending"), ("k", "ascending")])
        same = i == j
        left = group.num_rows if same else int((group["c"].to_numpy() == i).sum())
        k, weight, key = group["k"].to_numpy(), group["n"].to_numpy(), matrix(group["keys"], tables, np.int64)
        links, label = np.zeros(len(k), np.int64), np.arange(len(k))
        for a, b in close_pairs(unit_rows(matrix(group["v"], dim, np.float64)), left, cosine, same):
            new = ~(key[a, :t] == key[b, :t]).any(axis=1)
            a, b = a[new], b[new]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            joined(label, a, b)
        some = np.flatnonzero(links)
        return pa.table({"k": k[some], "links": links[some], "other": k[label[some]]})

    found, found_path = stored(met.groupBy("t", "key", "i", "j").applyInArrow(compare, "k bigint, links bigint, other bigint"))
    links = found.groupBy("k").agg(F.sum("links").alias("links")).withColumnRenamed("k", "lk")
    parts = connected_components(found.where("k <> other").select(F.col("k").alias("src"), F.col("other").alias("dst")))
    whole = classes.select("k", "d1", "d2", "n", "first").join(parts, F.col("k") == F.col("node"), "left").withColumn("component", F.coalesce("component", "k"))
    least = whole.groupBy("component").agg(F.min("first").alias("best")).withColumnRenamed("component", "of")
    whole = whole.join(least, F.col("component") == F.col("of")).join(links, F.col("k") == F.col("lk"), "left")
    whole = whole.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "best", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = own.select("id", "d1", "d2", F.col("v").isNotNull().alias("fine")).join(whole, F.col("fine") & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    best = F.when(F.col("fine"), F.col("best")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).alias("n_links"), best.alias("component_id"), F.col("id").eqNullSafe(best).alias("kept"))
    out, _ = stored(out)
    for p in (path, keyed_path, found_path):
        removed(spark, p)
    return out
