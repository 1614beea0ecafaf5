"""Hard negatives by product quantisation with residual bounds and an exact integer rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.vectors import is_finite, matrix
from tessera.session import prepare, removed, stored

#: Places of a subspace, centroids of each, rows that the codebook is fitted on, and rounds of its fit.
PLACES, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 4_096, 6
#: Anchors that are sent to all tasks at once (at 64 places some 8 MB), those that share a look-up table, and rows scored together.
ANCHORS, GROUP, ROWS = 16_384, 64, 8_192
#: A null id in arrays: after all others.
LAST = np.int64((1 << 63) - 1)


def codebook(sample: np.ndarray, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """(subspaces, centroids, places) of whole numbers, fitted by Lloyd's rounds to an integer sample whose width is a multiple of ``PLACES``."""
    parts = sample.reshape(len(sample), -1, PLACES).transpose(1, 0, 2).astype(np.float64)
    books = []
    for x in parts:
        book = np.unique(x, axis=0)
        book = book[np.linspace(0, len(book) - 1, min(centroids, len(book))).astype(int)]
        for _ in range(rounds):
            near = nearest(x, book)
            n = np.bincount(near, minlength=len(book))
            total = np.stack([np.bincount(near, x[:, p], len(book)) for p in range(PLACES)], axis=1)
            book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
        books.append(np.resize(np.rint(book), (centroids, PLACES)))
    return np.stack(books).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    return ((book * book).sum(axis=1) - 2 * (x @ book.T)).argmin(axis=1)


def encoded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each subspace of each row, and the length of what the codes miss, rounded up."""
    parts = x.reshape(len(x), -1, PLACES)
    codes = np.stack([nearest(parts[:, m].astype(np.float64), books[m].astype(np.float64)) for m in range(len(books))], axis=1)
    missed = (parts - books[np.arange(len(books)), codes]).reshape(len(x), -1).astype(np.float64)
    return codes.astype(np.uint8), np.sqrt((missed * missed).sum(axis=1)) * (1 + 1e-12)


def scored(codes: np.ndarray, books: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """(rows, anchors) sums of the look-up tables of whole numbers that hold each centroid's product with each anchor's part."""
    tables = np.einsum("mkp,amp->mka", books, anchors.reshape(len(anchors), -1, PLACES)).astype(np.float64)
    out = np.zeros((len(codes), len(anchors)))
    for m, table in enumerate(tables):
        out += table[codes[:, m]]
    return out


def best_of(order: tuple[np.ndarray, ...], key: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` of each ``key`` by ``order`` (keys as of ``lexsort``: the last one counts first)."""
    at = np.lexsort((*order, key))
    key = key[at]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    rank = np.arange(len(key)) - np.repeat(new, np.diff(np.r_[new, len(key)]))
    return at[rank < n]


def largest(x: np.ndarray, n: int) -> np.ndarray:
    """The ``n``-th largest value of each column; minus infinity where there are fewer rows."""
    return np.partition(x, -n, axis=0)[-n] if len(x) >= n else np.full(x.shape[1], -np.inf)


def row_blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``r, id, label, codes, missed, x`` of blocks of rows, larger than Spark's batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= ROWS:
            yield unpacked(held, dim)
            held = []
    if held:
        yield unpacked(held, dim)


def unpacked(held: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, ...]:
    t = pa.Table.from_batches(held).combine_chunks()
    ids = np.where(t["id"].is_null().to_numpy(), LAST, t["id"].fill_null(0).to_numpy())
    codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    return t["r"].to_numpy(), ids, t["label"].to_numpy(), codes, t["missed"].to_numpy(), matrix(t["x"], dim, np.int64)


def exact(x: np.ndarray, i: np.ndarray, a: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of rows ``i`` of ``x`` and ``j`` of ``a``, in pieces."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), ROWS):
        piece = slice(at, at + ROWS)
        out[piece] = np.einsum("ij,ij->i", x[i[piece]], a[j[piece]])
    return out


def nearest_alike(blocks: Iterator[tuple[np.ndarray, ...]], books: np.ndarray, anchors: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, ...]:
    """``anchor, score, id, r`` of each anchor's first ``n`` other rows of its label.

    ``anchors`` are ``r, label, x`` arrays. A score lies within |anchor| x |missed| of its look-up sum.
    A row can be among the first only if its upper bound reaches the ``n``-th best lower bound, or the
    ``n``-th best score so far; only such rows are multiplied out.
    """
    ar, al, ax = anchors
    length = np.sqrt((ax.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    kept = tuple(np.empty(0, np.int64) for _ in range(4))
    floor = np.full(len(ar), -np.inf)
    for r, ids, label, codes, missed, x in blocks:
        fresh = [kept]
        for value in np.unique(label):
            mine, theirs = np.flatnonzero(label == value), np.flatnonzero(al == value)
            for at in range(0, len(theirs), GROUP):
                a = theirs[at : at + GROUP]
                about, bound = scored(codes[mine], books, ax[a]), missed[mine, None] * length[a] + 1
                other = r[mine, None] != ar[a]
                least = np.maximum(floor[a], largest(np.where(other, about - bound, -np.inf), n))
                i, j = np.nonzero((about + bound >= least) & other)
                fresh.append((a[j], exact(x, mine[i], ax, a[j]), ids[mine[i]], r[mine[i]]))
        anchor, score, i, rr = (np.concatenate(c) for c in zip(*fresh, strict=True))
        at = best_of((rr, i, -score), anchor, n)
        kept = anchor[at], score[at], i[at], rr[at]
        full = np.bincount(kept[0], minlength=len(ar)) >= n
        worst = np.full(len(ar), np.inf)
        np.minimum.at(worst, kept[0], kept[1].astype(np.float64))
        floor = np.where(full, worst, -np.inf)
    return kept


def hardest_unlike(blocks: Iterator[tuple[np.ndarray, ...]], books: np.ndarray, anchors: tuple[np.ndarray, ...], windows: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, ...]:
    """``window, score, id, r`` of each window's first ``n`` rows of another label.

    ``windows`` are ``anchor`` (place in ``anchors``), ``low`` and ``high`` arrays, by anchor. A row can be among a window's first only if its bounds
    meet the window and its upper bound reaches the ``n``-th best lower bound of those surely below ``high``, or the ``n``-th best score so far.
    """
    _, al, ax = anchors
    length = np.sqrt((ax.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    wa, low, high = windows
    kept = tuple(np.empty(0, np.int64) for _ in range(4))
    floor = low.astype(np.float64)
    of = np.unique(wa)
    for r, ids, label, codes, missed, x in blocks:
        fresh = [kept]
        for at in range(0, len(of), GROUP):
            a = of[at : at + GROUP]
            about, bound = scored(codes, books, ax[a]), missed[:, None] * length[a] + 1
            upper, lower = about + bound, about - bound
            upper[label[:, None] == al[a]] = -np.inf
            first, end = np.searchsorted(wa, a), np.searchsorted(wa, a, side="right")
            for k in range((end - first).max()):
                some = np.flatnonzero(first + k < end)
                w = first[some] + k
                up, lo = upper[:, some], lower[:, some]
                sure = largest(np.where((up <= high[w]) & (up > -np.inf), lo, -np.inf), n)
                i, j = np.nonzero((lo <= high[w]) & (up >= np.maximum(floor[w], sure)))
                score = exact(x, i, ax, wa[w[j]])
                inside = (score >= low[w[j]]) & (score <= high[w[j]])
                i, j, score = i[inside], j[inside], score[inside]
                fresh.append((w[j], score, ids[i], r[i]))
        window, score, i, rr = (np.concatenate(c) for c in zip(*fresh, strict=True))
        at = best_of((rr, i, -score), window, n)
        kept = window[at], score[at], i[at], rr[at]
        full = np.bincount(kept[0], minlength=len(wa)) >= n
        worst = np.full(len(wa), np.inf)
        np.minimum.at(worst, kept[0], kept[1].astype(np.float64))
        floor = np.where(full, np.maximum(worst, low), low)
    return kept


def indexed(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> tuple[DataFrame, np.ndarray, int, str]:
    """Every row that takes part, with codes and the length of what they miss; the codebook, the width, and the path of the table."""
    whole = F.transform(F.col(vec_col), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    x = rows.where(F.col(label_col).isNotNull() & is_finite(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("x"))
    x, raw_path = stored(x.withColumn("r", F.monotonically_increasing_id()))
    widest = max(1, x.agg(F.max(F.size("x"))).first()[0] or 1)
    dim = -(-widest // PLACES) * PLACES
    drawn = x.select("x").orderBy(F.xxhash64("id", "x"), "r").limit(SAMPLE).toArrow()["x"]
    books = codebook(matrix(drawn, dim, np.int64)) if len(drawn) else np.zeros((dim // PLACES, CENTROIDS, PLACES), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, missed = encoded(matrix(b.column(2), dim, np.int64), books)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), b.column(1), pa.array(map(bytes, codes), pa.binary()), pa.array(missed), b.column(2)], ["r", "id", "label", "codes", "missed", "x"])

    coded, path = stored(x.mapInArrow(run, "r bigint, id bigint, label bigint, codes binary, missed double, x array<bigint>"))
    removed(rows.sparkSession, raw_path)
    return coded, books, dim, path


def first_of(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key by score, then id (null last), with ``rank``."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(
    rows: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low_pct: int = 50,
    high_pct: int = 95,
    scale: int = 256,
    anchors_at_once: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    Components become whole numbers, ``floor(scale x)``; a score is the integer product with the anchor.
    Anchors are the rows whose id is divisible by ``every``; their positives are the first ``positives``
    other rows of their label, and the negatives of a positive the first ``negatives`` rows of another
    label with a score between ``low_pct`` and ``high_pct`` per cent of the positive's. Higher scores
    come first, ties by smaller id (null last). Rows with a null label, a null vector or a null or
    non-finite component take no part; an empty vector has the score 0, shorter ones count as padded
    with zeros. Repeated rows are rows of their own, also as anchors. A positive with no such row gives
    none, an empty table an empty result; other columns are ignored. Products must fit in 64 bits.

    The codebook is fitted on ``SAMPLE`` rows drawn by hash; every row gets codes and the exact length of
    what they miss. Anchors go out in blocks of ``anchors_at_once``, and each block passes all rows
    where they lie: a task keeps only the first few of each anchor (``nearest_alike``) or window
    (``hardest_unlike``), and those are all that is shuffled. Bounds drop only rows that cannot be
    among the first, so results are those of a search without codes.
    """
    spark = rows.sparkSession
    prepare(spark)
    coded, books, dim, path = indexed(rows, id_col, label_col, vec_col, scale)
    chosen, chosen_path = stored(coded.where(F.col("id") % every == 0).select("r", "id", "label", "x"))
    n_blocks = -(-chosen.count() // anchors_at_once)
    results = []
    for block in range(n_blocks):
        one = chosen.where(F.pmod(F.xxhash64("r"), F.lit(n_blocks)) == block).orderBy("r").toArrow()
        anchors = spark.sparkContext.broadcast((one["r"].to_numpy(), one["label"].to_numpy(), matrix(one["x"], dim, np.int64)))
        anchor_ids = one["id"].to_numpy()

        def alike(batches: Iterator[pa.RecordBatch], anchors=anchors) -> Iterator[pa.RecordBatch]:
            kept = nearest_alike(row_blocks(batches, dim), books, anchors.value, positives)
            yield pa.RecordBatch.from_arrays([*map(pa.array, kept[:2]), pa.array(kept[2], mask=kept[2] == LAST), pa.array(kept[3])], ["anchor", "score", "id", "r"])

        schema = "bigint, score bigint, id bigint, r bigint"
        found = first_of(coded.mapInArrow(alike, f"anchor {schema}"), ["anchor"], positives).orderBy("anchor", "rank").toArrow()
        anchor, score = found["anchor"].to_numpy(), found["score"].to_numpy()
        low, high = -(-low_pct * score // 100), high_pct * score // 100
        use = low <= high
        windows = spark.sparkContext.broadcast((anchor[use], low[use], high[use]))
        ends = pa.table({"window": np.arange(use.sum()), "anchor_id": anchor_ids[anchor[use]], "positive_id": found["id"].filter(pa.array(use)), "positive_score": score[use]})

        def unlike(batches: Iterator[pa.RecordBatch], anchors=anchors, windows=windows) -> Iterator[pa.RecordBatch]:
            kept = hardest_unlike(row_blocks(batches, dim), books, anchors.value, windows.value, negatives)
            yield pa.RecordBatch.from_arrays([*map(pa.array, kept[:2]), pa.array(kept[2], mask=kept[2] == LAST), pa.array(kept[3])], ["window", "score", "id", "r"])

        mined = first_of(coded.mapInArrow(unlike, f"window {schema}"), ["window"], negatives)
        named = spark.createDataFrame(ends).withColumnRenamed("window", "w")
        mined = mined.join(named, F.col("window") == F.col("w"))
        mined = mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        results.append(stored(mined))
        anchors.unpersist()
        windows.unpersist()
    removed(spark, path)
    removed(spark, chosen_path)
    if not results:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    out = results[0][0]
    for more, _ in results[1:]:
        out = out.unionByName(more)
    return out
