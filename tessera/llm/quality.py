"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable, prepare

#: Byte classes whose share of a text is a statistic.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "quote": b"\"'`",
    "bracket": b"()[]{}",
    "markup": b"<>|\\/",
    "symbol": b"#$%&*+=@^_~",
    "dash": b"-",
}
FEATURES = [
    *CLASSES, "other", "log_bytes", "log_words", "word_mean", "word_std", "word_max", "distinct_words", "distinct_triples", "top_word",
    "upper_words", "lines", "distinct_lines", "line_mean", "closed_lines", "short_words", "symbols_per_word",
]

_WEIGHTS = np.zeros((256, len(CLASSES)))
for _k, _chars in enumerate(CLASSES.values()):
    _WEIGHTS[list(_chars), _k] = 1


def statistics(text: str) -> list[float]:
    """The statistics named in ``FEATURES``; all are finite, and those of an empty text are zero."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _WEIGHTS / len(raw)
    words = text.split()
    n = len(words)
    if not n:
        return [*share, 1 - share.sum(), np.log1p(len(raw)), *[0.0] * (len(FEATURES) - len(CLASSES) - 2)]
    size = np.fromiter(map(len, words), np.int32, n)
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    closed = sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / len(lines)
    symbols = share[list(CLASSES).index("symbol")] * len(raw) / n
    return [
        *share, 1 - share.sum(), np.log1p(len(raw)), np.log1p(n), size.mean(), size.std(), float(min(size.max(), 1000)), len(kinds) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2), max(kinds.values()) / n, sum(map(str.isupper, words)) / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)), closed, float((size < 4).mean()), symbols,
    ]


@dataclass
class Forest:
    """Trees of equal depth as flat arrays: node i has children 2i + 1 and 2i + 2."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all trees of all rows step down together."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            right = np.take_along_axis(x, self.feature[tree, node], axis=1) > self.threshold[tree, node]
            node = 2 * node + 1 + right
        leaf = node - (2**self.depth - 1)
        return 1 / (1 + np.exp(-(self.base + self.value[tree, leaf].sum(axis=1))))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Forest:
    """Logistic boosting on binned features: per level one histogram of gradients by node, feature and bin."""
    n, d = x.shape
    p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    feature = np.zeros((trees, 2**depth - 1), np.int64)
    threshold = np.full((trees, 2**depth - 1), np.inf)
    value = np.zeros((trees, 2**depth))
    if not n or y.min() == y.max():
        return Forest(base, depth, feature[:0], threshold[:0], value[:0])
    edges = np.stack([np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]) for f in range(d)])
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(d)], axis=1)
    flat = binned + np.arange(d) * bins
    raw = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (d * bins) + flat).ravel()
            g = np.bincount(at, np.repeat(grad, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2)
            c = np.bincount(at, minlength=width * d * bins).reshape(width, d, bins).cumsum(axis=2)
            gr, hr, cr = g[:, :, -1:] - g, h[:, :, -1:] - h, c[:, :, -1:] - c
            gain = g**2 / (h + l2) + gr**2 / (hr + l2) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + l2)
            gain[(c < least) | (cr < least)] = 0
            gain = gain[:, :, :-1].reshape(width, -1)
            best = gain.argmax(axis=1)
            f, b = np.divmod(best, bins - 1)
            cut = np.where(gain.max(axis=1) > 1e-9, edges[f, b], np.inf)
            feature[t, first : first + width], threshold[t, first : first + width] = f, cut
            mine = node - first
            node = 2 * node + 1 + (x[np.arange(n), f[mine]] > cut[mine])
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        value[t] = rate * g / (h + l2)
        raw += value[t, leaf]
    return Forest(base, depth, feature, threshold, value)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Callable[[str], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train: int = 20_000,
    **boosting,
) -> DataFrame:
    """One row per input row: ``id_col, score, predicted`` (score: probability of label 1; predicted: 1 from 0.5).

    Statistics of every whole text (null counts as empty) are taken in one pass and kept; of rows where
    ``learn`` (given the name of the id's column) holds and that have labels (several for one id are averaged, null ones ignored), about
    ``max_train``, drawn by a hash of the id, reach the driver for fitting. Without labels the score
    is 0.5; with one kind of label it is close to that label. Neither the id nor any column but the text is an input: rows of equal texts
    have equal scores, and other columns are ignored, whatever their names. Texts of any length are
    read whole; repeated rows stay; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py() or "") for t in b.column(1)], np.float32).reshape(b.num_rows, len(FEATURES))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["id", "x"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = durable(rows.mapInArrow(run, f"id {kind}, x array<float>"))
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.avg(label_col).alias("y"))
    marks = marks.where(learn("label_id"))
    known = durable(stats.join(marks, stats.id == marks.label_id).select("id", "x", "y"))
    share = min(1.0, max_train / max(1, known.count()))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = known.where(drawn).toPandas().sort_values("id", kind="stable", ignore_index=True)
    x = np.array(sample["x"].tolist(), np.float64).reshape(len(sample), len(FEATURES))
    y = sample["y"].to_numpy(np.float64)
    forest = boost(x, y, **boosting)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, len(FEATURES))
            s = sent.value.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    scored = stats.mapInArrow(score, f"id {kind}, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), "score", "predicted")

