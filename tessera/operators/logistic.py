"""Weighted ridge logistic fits by Newton's steps from sums of gradients and curvatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import prepare

#: Up to so many columns the matrix of curvatures is summed; beyond, only its products with a direction are.
DENSE = 256
#: Numbers of one row of partial sums on the way to their total.
CHUNK = 4_096


def newton(loss_of: Callable, slope_of: Callable, size: int, tol: float = 1e-10, rounds: int = 60) -> np.ndarray:
    """The weights at which a strictly convex loss is least.

    ``slope_of(w)`` gives the gradient and a function that solves the curvature at ``w`` for a vector;
    a step that does not lower ``loss_of`` is halved.
    """
    w, loss = np.zeros(size), loss_of(np.zeros(size))
    for _ in range(rounds):
        gradient, solved = slope_of(w)
        move = solved(gradient)
        if np.abs(move).max() < tol:
            return w - move
        for _ in range(40):
            new = loss_of(w - move)
            if new <= loss + 1e-12 * abs(loss):
                break
            move = move / 2
        w, loss = w - move, new
    raise RuntimeError("newton: no fixed point within the rounds")


def fit_columns(rows: DataFrame, features: Sequence[str], label: str = "label", weight: str = "weight", c: float = 1.0) -> np.ndarray:
    """Weights of a few named columns, without intercept: each step is one aggregate of sums that combine on the way.

    The loss is the weighted log-loss plus the squared weights over ``2 c``.
    """
    x, d = [F.col(f).cast("double") for f in features], len(features)
    y, wt = F.col(label).cast("double"), F.col(weight).cast("double")

    def sums(w: np.ndarray) -> np.ndarray:
        z = sum((float(v) * f for v, f in zip(w, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        t = rows.select(*[f.alias(f"x{i}") for i, f in enumerate(x)], (wt * (p - y)).alias("g"), (wt * p * (1 - p)).alias("h"), (wt * (F.greatest(-z * (2 * y - 1), F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))).alias("l"))
        xs = [F.col(f"x{i}") for i in range(d)]
        row = t.agg(F.sum("l"), *[F.sum(F.col("g") * a) for a in xs], *[F.sum(F.col("h") * a * b) for i, a in enumerate(xs) for b in xs[: i + 1]]).first()
        return np.array([v or 0.0 for v in row])

    seen: dict[bytes, np.ndarray] = {}

    def at(w: np.ndarray) -> np.ndarray:
        if w.tobytes() not in seen:
            seen[w.tobytes()] = sums(w)
        return seen[w.tobytes()]

    def slope(w: np.ndarray) -> tuple[np.ndarray, Callable]:
        s = at(w)
        h = np.zeros((d, d))
        h[np.tril_indices(d)] = s[d + 1 :]
        h = h + np.tril(h, -1).T + np.eye(d) / c
        return s[1 : d + 1] + w / c, lambda g: np.linalg.solve(h, g)

    return newton(lambda w: at(w)[0] + w @ w / (2 * c), slope, d)


def partial_sums(rows: DataFrame, columns: Sequence[str], run: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all partitions of a vector that ``run`` makes of each one's batches, cut in chunks so that no task holds all partitions' vectors."""
    prepare(rows.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        for k in range(0, len(total), CHUNK):
            piece = total[k : k + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.ListArray.from_arrays([0, len(piece)], pa.array(piece))], ["k", "v"])

    def merged(group: pa.Table) -> pa.Table:
        whole = group["v"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"k": [group["k"][0].as_py()], "v": [whole.tolist()]}, pa.schema([("k", pa.int64()), ("v", pa.list_(pa.float64()))]))

    out = rows.select(*columns).mapInArrow(parts, "k bigint, v array<double>").groupBy("k").applyInArrow(merged, "k bigint, v array<double>").collect()
    return np.concatenate([r["v"] for r in sorted(out)]) if out else np.zeros(0)


def sparse_rows(b: pa.RecordBatch, x: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, column and value of each entry of a batch's sparse vectors."""
    v = b.column(b.schema.get_field_index(x))
    at, values = v.field("indices"), v.field("values")
    n = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(len(n)), n), at.flatten().to_numpy(), values.flatten().to_numpy()


def fit_sparse(rows: DataFrame, size: int, x: str = "x", label: str = "label", weight: str = "weight", c: float = 1.0, tol: float = 1e-8) -> np.ndarray:
    """Weights of ``size`` columns of sparse vectors (``struct<indices, values>``), as ``fit_columns`` gives them for named ones.

    ``rows`` should be stored: each step passes them once. Up to ``DENSE`` columns the curvatures are
    summed as a matrix; with more, each step solves for its direction by conjugate gradients, whose
    products are passes of their own. What reaches the driver is as long as the vectors.
    """
    cols = [x, label, weight]

    def each(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[tuple]:
        for b in batches:
            r, k, v = sparse_rows(b, x)
            y, t = (b.column(i).cast(pa.float64()).to_numpy() for i in (1, 2))
            z = np.bincount(r, v * w[k], b.num_rows)
            yield r, k, v, y, t, z, 1 / (1 + np.exp(-z))

    def loss(w: np.ndarray) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            return np.array([sum(float((t * np.logaddexp(0, -z * (2 * y - 1))).sum()) for _, _, _, y, t, z, _ in each(batches, w))])

        return partial_sums(rows, cols, run)[0] + w @ w / (2 * c)

    def gradient(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(size)
            for r, k, v, y, t, _, p in each(batches, w):
                total += np.bincount(k, v * (t * (p - y))[r], size)
            return total

        return partial_sums(rows, cols, run) + w / c

    def curved(w: np.ndarray, move: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(size)
            for r, k, v, _, t, _, p in each(batches, w):
                along = np.bincount(r, v * move[k], len(t)) * t * p * (1 - p)
                total += np.bincount(k, v * along[r], size)
            return total

        return partial_sums(rows, cols, run) + move / c

    def matrix(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((size, size))
            for r, k, v, _, t, _, p in each(batches, w):
                dense = np.zeros((len(t), size))
                dense[r, k] = v
                total += (dense * (t * p * (1 - p))[:, None]).T @ dense
            return total.ravel()

        return partial_sums(rows, cols, run).reshape(size, size) + np.eye(size) / c

    def slope(w: np.ndarray) -> tuple[np.ndarray, Callable]:
        if size <= DENSE:
            h = matrix(w)
            return gradient(w), lambda g: np.linalg.solve(h, g)
        return gradient(w), lambda g: conjugate(lambda m: curved(w, m), g)

    return newton(loss, slope, size, tol)


def conjugate(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, tol: float = 1e-10, rounds: int = 500) -> np.ndarray:
    """Solve a positive definite system of which only products are known."""
    x, r = np.zeros(len(b)), b.copy()
    d, rr = r.copy(), float(r @ r)
    for _ in range(rounds):
        if rr <= tol * tol * max(1e-300, float(b @ b)):
            break
        q = product(d)
        a = rr / float(d @ q)
        x, r = x + a * d, r - a * q
        rr, last = float(r @ r), rr
        d = r + rr / last * d
    return x


def log_loss(label: Column, p: Column) -> Column:
    """Log-loss of a probability, which is kept away from 0 and 1 by 1e-9."""
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return -F.when(label == 1, F.log(q)).otherwise(F.log(1 - q))
