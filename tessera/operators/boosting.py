"""Histogram boosting of many heads and bootstrap members at once, from sums over cells of binned features.

Squared loss needs of rows in one cell of the bins only sums of weights and of weighted targets, for
each member and head, so one aggregate over all rows is all that the fit reads. Cells are few where
features are few; then each task fits some of the models on all cells. Beyond ``CELLS`` cells the
levels of all models' trees grow together, each by one aggregate of the histograms of them all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import hash_int
from tessera.operators.keys import CheckFailed
from tessera.operators.logistic import partial_sums
from tessera.operators.sampling import column_quantiles
from tessera.session import prepare, removed, stored

#: Most cells that are sent to all tasks: some 120 numbers each for 91 models, so at most some 20 MB.
CELLS = 20_000
#: Trees after which the distributed fit writes its predictions down.
WRITE_EVERY = 20
DEPTH = 4
NODES = (1 << (DEPTH + 1)) - 1


def multiplicity(seed: int, member: int, group: str) -> Column:
    """How often a bootstrap member draws a group: Poisson(1) by a hash, the usual limit of drawing with replacement, which needs no list of all groups."""
    u = hash_int(F.lit(seed), F.lit(member), group) / float(1 << 32)
    return F.when(u < 0.36788, 0.0).when(u < 0.73576, 1.0).when(u < 0.91970, 2.0).when(u < 0.98101, 3.0).otherwise(4.0)


def best_splits(hist: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, bin (the last that goes left) and whether it gains, for each node of (nodes, features, bins, 3) sums of residual, weight and rows.

    The gain is the fall of the ridge loss; both sides need ``least`` rows. Ties go to the first feature and bin.
    """
    left = hist.cumsum(axis=2)[:, :, :-1]
    whole = hist.sum(axis=2)[:, :, None]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    gain = score(left) + score(right) - score(whole)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), np.round(gain, 12), -np.inf)
    flat = gain.reshape(len(hist), -1)
    at = flat.argmax(axis=1)
    return at // gain.shape[2], at % gain.shape[2], flat[np.arange(len(hist)), at] > 1e-12


def histograms(bins: np.ndarray, node: np.ndarray, sums: np.ndarray, first: int, n_bins: int) -> np.ndarray:
    """(nodes of a level, features, bins, 3) sums of cells by node, feature and bin."""
    n, d = bins.shape
    at = ((node - first)[:, None] * d + np.arange(d)) * n_bins + bins
    size = (first + 1) * d * n_bins
    use = node >= first
    out = np.stack([np.bincount(at[use].ravel(), np.repeat(sums[use, k], d), size) for k in range(3)], axis=1)
    return out.reshape(first + 1, d, n_bins, 3)


def grown(hist_of, l2: float, least: float, rate: float, models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree for each model: (models, ``NODES``) features (-1: leaf), bins and values. ``hist_of(level, feature, bin)`` gives (models, nodes, features, bins, 3)."""
    feature, at, value = np.full((models, NODES), -1, np.int16), np.zeros((models, NODES), np.int16), np.zeros((models, NODES))
    for level in range(DEPTH + 1):
        first = (1 << level) - 1
        hist = hist_of(level, feature, at)
        total = hist[:, :, 0].sum(axis=2)
        value[:, first : 2 * first + 1] = rate * total[..., 0] / (total[..., 1] + l2)
        if level < DEPTH:
            f, b, fine = best_splits(hist.reshape(-1, *hist.shape[2:]), l2, least)
            fine = fine.reshape(models, -1)
            feature[:, first : 2 * first + 1] = np.where(fine, f.reshape(models, -1), -1)
            at[:, first : 2 * first + 1] = np.where(fine, b.reshape(models, -1), 0)
            if not fine.any():
                break
    return feature, at, value


def stepped(bins: np.ndarray, node: np.ndarray, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where cells go from their nodes in one tree; those at a leaf stay."""
    f = feature[node]
    inner = np.flatnonzero(f >= 0)
    out = node.copy()
    out[inner] = 2 * node[inner] + 1 + (bins[inner, f[inner]] > at[node[inner]])
    return out


def leaves(bins: np.ndarray, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    for _ in range(DEPTH):
        node = stepped(bins, node, feature, at)
    return node


def fit_local(bins: np.ndarray, w: np.ndarray, s: np.ndarray, n: np.ndarray, n_bins: int, trees: int, rate: float, l2: float, least: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """One model on all cells: its mean and (trees, ``NODES``) features, bins and values."""
    base = float(s.sum() / w.sum()) if w.sum() else 0.0
    guess = np.full(len(bins), base)
    out = []
    for _ in range(trees):
        sums = np.stack([s - w * guess, w, n], axis=1)
        node = np.zeros(len(bins), np.int64)

        def hist(level: int, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
            nonlocal node
            if level:
                node = stepped(bins, node, feature[0], at[0])
            return histograms(bins, node, sums, (1 << level) - 1, n_bins)[None]

        tree = grown(hist, l2, least, rate, 1)
        guess += tree[2][0][leaves(bins, tree[0][0], tree[1][0])]
        out.append([x[0] for x in tree])
    return base, *(np.stack(x) for x in zip(*out, strict=True))


@dataclass
class Boosted:
    """Trees of all heads and members over common bins: ``base`` (models), ``feature``, ``at`` and ``value`` (models, trees, nodes); models go by head, then member."""

    features: list[str]
    edges: dict[str, list[float]]
    heads: list[str]
    members: int
    base: np.ndarray
    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def bins(self) -> Column:
        return binned(self.features, self.edges)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``predictions``, an array of structs ``head, mean, std`` (population, over members).

        The different cells of the rows are looked up once each.
        """
        prepare(rows.sparkSession)
        heads, members, base, feature, at, value = self.heads, self.members, self.base, self.feature, self.at, self.value
        sent = rows.sparkSession.sparkContext.broadcast((feature, at, value))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feature, at, value = sent.value
            for b in batches:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(np.int64) if b.num_rows else np.zeros((0, 1), np.int64)
                out = np.repeat(base[:, None], b.num_rows, axis=1)
                for m in range(len(base)):
                    for t in range(feature.shape[1]):
                        out[m] += value[m, t][leaves(x, feature[m, t], at[m, t])]
                out = out.reshape(len(heads), members, -1)
                means, stds = out.mean(axis=1), out.std(axis=1)
                rows = [[{"head": h, "mean": means[i, r], "std": stds[i, r]} for i, h in enumerate(heads)] for r in range(b.num_rows)]
                kind = pa.list_(pa.struct([("head", pa.string()), ("mean", pa.float64()), ("std", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["cell", "predictions"])

        placed = rows.withColumn("_cell", self.bins())
        cells = placed.select("_cell").distinct().mapInArrow(run, "cell array<int>, predictions array<struct<head: string, mean: double, std: double>>")
        return placed.join(cells, F.col("_cell") == F.col("cell")).drop("_cell", "cell")


def binned(features: Sequence[str], edges: dict[str, list[float]]) -> Column:
    """A row's bins: for each feature the number of edges below its value; null counts as below all."""
    def below(f: str) -> Column:
        passed = F.filter(F.array(*[F.lit(e) for e in edges[f]]).cast("array<double>"), lambda e: e < F.col(f))
        return F.when(F.col(f).isNull(), F.lit(0)).otherwise(F.size(passed))

    return F.array(*[below(f) for f in features])


def bin_edges(rows: DataFrame, features: Sequence[str], n_bins: int) -> dict[str, list[float]]:
    """Edges between ``n_bins`` bins of about equal size; fewer where values repeat."""
    q = column_quantiles(rows, features, [k / n_bins for k in range(1, n_bins)])
    return {f: sorted({v for v in some if v is not None}) for f, some in q.items()}


def boosted(
    rows: DataFrame,
    group: str,
    features: Sequence[str],
    heads: dict[str, tuple[str, int]],
    weight: str | None = None,
    members: int = 7,
    trees: int = 180,
    rate: float = 0.05,
    l2: float = 1.0,
    least: float = 20,
    n_bins: int = 32,
    cells_at_once: int = CELLS,
) -> Boosted:
    """Fit ``members`` group-bootstrap members for each head (name to target column and seed) of trees of depth ``DEPTH``.

    Rows of weight zero or null do not count; targets must not be null on others. Fails where fewer than
    three groups count.
    """
    spark, features = rows.sparkSession, list(features)
    prepare(spark)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = rows.withColumn("_w", w).where("_w > 0")
    if rows.select(group).distinct().limit(3).count() < 3:
        raise CheckFailed("a group bootstrap needs three groups")
    edges = bin_edges(rows, features, n_bins)
    seeds = sorted({seed for _, seed in heads.values()})
    draws = {(s, m): multiplicity(s, m, group) for s in seeds for m in range(members)}
    x = rows.select(binned(features, edges).alias("cell"), "_w", *[F.col(c).cast("double").alias(f"y{i}") for i, (c, _) in enumerate(heads.values())], *[d.alias(f"d_{s}_{m}") for (s, m), d in draws.items()])
    each = lambda s, m: F.col(f"d_{s}_{m}") * F.col("_w")
    sums = [F.sum(each(s, m)) for s in seeds for m in range(members)] + [F.sum((F.col(f"d_{s}_{m}") > 0).cast("double")) for s in seeds for m in range(members)]
    targets = [F.sum(each(seed, m) * F.col(f"y{i}")) for i, (_, seed) in enumerate(heads.values()) for m in range(members)]
    cells, path = stored(x.groupBy("cell").agg(F.array(*sums).alias("w"), F.array(*targets).alias("s")))
    place = np.array([seeds.index(seed) * members + m for _, seed in heads.values() for m in range(members)])
    k, models = len(seeds) * members, len(place)
    most = max(len(e) for e in edges.values()) + 1

    def unpacked(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
        stack = lambda c: np.stack([np.asarray(v) for v in t.column(c).to_numpy(zero_copy_only=False)]) if t.num_rows else np.zeros((0, 1))
        bins, both, s = (stack(t.schema.get_field_index(c)) for c in ("cell", "w", "s"))
        return bins.astype(np.int64), both[:, :k][:, place], s, both[:, k:][:, place]

    if cells.count() <= cells_at_once:
        whole = spark.sparkContext.broadcast(unpacked(cells.orderBy("cell").toArrow().combine_chunks()))

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins, w, s, n = whole.value
            for b in batches:
                for m in b.column(0).to_pylist():
                    base, *tree = fit_local(bins, w[:, m], s[:, m], n[:, m], most, trees, rate, l2, least)
                    yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([base]), *[pa.array([v.astype(t).tobytes()]) for v, t in zip(tree, (np.int16, np.int16, np.float64), strict=True)]], ["model", "base", "feature", "at", "value"])

        found = spark.range(0, models, 1, models).mapInArrow(fit, "model bigint, base double, feature binary, at binary, value binary").orderBy("model").toArrow()
        unpack = lambda c, t: np.stack([np.frombuffer(v, t).reshape(trees, NODES) for v in found[c].to_pylist()])
        out = found["base"].to_numpy(), unpack("feature", np.int16), unpack("at", np.int16), unpack("value", np.float64)
        whole.unpersist()
    else:
        out = fit_spread(cells, unpacked, models, len(features), most, trees, rate, l2, least)
    removed(spark, path)
    return Boosted(features, edges, list(heads), members, *out)


def fit_spread(cells: DataFrame, unpacked, models: int, d: int, n_bins: int, trees: int, rate: float, l2: float, least: float) -> tuple[np.ndarray, ...]:
    """All models on cells that stay where they lie: each level is one aggregate of the histograms of all models.

    Predictions are written to the cells' table every ``WRITE_EVERY`` trees, so a pass looks up as many trees at most.
    """
    spark = cells.sparkSession

    def means(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, models))
        for b in batches:
            _, w, s, _ = unpacked(b)
            total += [s.sum(axis=0), w.sum(axis=0)]
        return total.ravel()

    s, w = partial_sums(cells, ["cell", "w", "s"], means).reshape(2, models)
    base = np.divide(s, w, out=np.zeros(models), where=w > 0)
    state, path = cells.withColumn("guess", F.array(*[F.lit(float(v)) for v in base])), None
    done: list[tuple[np.ndarray, ...]] = []
    late: list[tuple[np.ndarray, ...]] = []

    def guesses(b: pa.RecordBatch, bins: np.ndarray) -> np.ndarray:
        out = np.stack([np.asarray(v) for v in b.column(b.schema.get_field_index("guess")).to_numpy(zero_copy_only=False)])
        for feature, at, value in late:
            for m in range(models):
                out[:, m] += value[m][leaves(bins, feature[m], at[m])]
        return out

    for t in range(trees):

        def hist_of(level: int, feature: np.ndarray, at: np.ndarray) -> np.ndarray:
            first = (1 << level) - 1

            def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                total = np.zeros((models, first + 1, d, n_bins, 3))
                for b in batches:
                    bins, w, s, n = unpacked(b)
                    guess = guesses(b, bins)
                    for m in range(models):
                        node = np.zeros(len(bins), np.int64)
                        for _ in range(level):
                            node = stepped(bins, node, feature[m], at[m])
                        total[m] += histograms(bins, node, np.stack([s[:, m] - w[:, m] * guess[:, m], w[:, m], n[:, m]], axis=1), first, n_bins)
                return total.ravel()

            return partial_sums(state, ["cell", "w", "s", "guess"], run).reshape(models, first + 1, d, n_bins, 3)

        tree = grown(hist_of, l2, least, rate, models)
        late.append(tree)
        done.append(tree)
        if len(late) == WRITE_EVERY and t + 1 < trees:

            def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    bins = unpacked(b)[0]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(guesses(b, bins).tolist(), pa.list_(pa.float64()))], ["cell", "w", "s", "guess"])

            before = path
            state, path = stored(state.select("cell", "w", "s", "guess").mapInArrow(written, "cell array<int>, w array<double>, s array<double>, guess array<double>"))
            if before:
                removed(spark, before)
            late = []
    if path:
        removed(spark, path)
    return base, *(np.stack(x, axis=1) for x in zip(*done, strict=True))
