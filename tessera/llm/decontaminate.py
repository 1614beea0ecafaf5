"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.simhash import mixed
from tessera.session import prepare

#: Bytes that part words: all of ASCII but letters, digits and the underscore.
PARTS = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
#: Fingerprints are cut into this many blocks of eight bits.
BLOCKS = 8
#: Windows are fingerprinted in runs of at most so many shingles, which bounds memory for very long texts.
RUN = 1 << 14
#: Items and windows that are compared at once: a million pairs, and tables of 8 MB.
ITEMS, WINDOWS = 1 << 12, 1 << 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text, parted at ASCII white space and punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(PARTS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for k in range(width):
        g = g * _BASE + h[k : k + n]
    return mixed(g, width)


def window_prints(grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` grams from each start on (ascending), by running sums of each bit."""
    low, high = int(starts[0]), int(starts[-1]) + size
    bits = np.unpackbits(grams[low:high].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.concatenate([np.zeros((1, 64), np.int32), bits.cumsum(axis=0, dtype=np.int32)])
    at = starts - low
    return np.packbits((sums[at + size] - sums[at]) * 2 > size, axis=1)


class ItemIndex:
    """Items by their number of words, each class with its fingerprints.

    The blocks guarantee that no fingerprint within the radius is lost: of ``BLOCKS`` blocks that together
    differ in at most ``radius`` bits, at least ``least`` differ in at most ``radius // BLOCKS``, as every other
    one takes more. At 20 of 64 bits that rules out two thirds of unlike items; what keeps the work small
    is that only windows are looked up whose shingles could make up the similarity.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int, radius: int) -> None:
        self.width, self.radius = width, radius
        self.ids = [i for i, _ in items]
        self.grams: list[Counter] = []
        wanted: dict[int, list[np.ndarray]] = defaultdict(list)
        by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for n, (_, words) in enumerate(items):
            k = min(width, len(words))
            g = gram_hashes(word_hashes(words), k)
            self.grams.append(Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)))
            wanted[k].append(g)
            by_length[len(words)].append((n, window_prints(g, np.array([0]), len(g))[0]))
        self.wanted = {k: np.unique(np.concatenate(v)) for k, v in wanted.items()}
        self.quick = {}
        for k, v in self.wanted.items():
            self.quick[k] = np.zeros(1 << 20, bool)
            self.quick[k][v >> np.uint64(44)] = True
        each = radius // BLOCKS
        self.least = BLOCKS - radius // (each + 1)
        self.alike = (np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= each).astype(np.uint8)
        self.classes = [(length, np.array([n for n, _ in members]), np.stack([fp for _, fp in members])) for length, members in sorted(by_length.items())]

    def near(self, prints: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (window, item) within the radius, in pieces of bounded size."""
        for first in range(0, len(fps), ITEMS):
            some = fps[first : first + ITEMS]
            tables = [self.alike[:, some[:, b]] for b in range(BLOCKS)] if len(prints) >= WINDOWS else None
            for at in range(0, len(prints), WINDOWS):
                part = prints[at : at + WINDOWS]
                met = np.zeros((len(part), len(some)), np.uint8)
                for b in range(BLOCKS):
                    met += tables[b][part[:, b]] if tables else self.alike[part[:, b][:, None], some[:, b]]
                w, i = np.nonzero(met >= self.least)
                d = np.bitwise_count(part[w].view(np.uint64)[:, 0] ^ some[i].view(np.uint64)[:, 0])
                hit = d <= self.radius
                if hit.any():
                    yield w[hit] + at, i[hit] + first


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def matches(words: list[bytes], index: ItemIndex, threshold: float) -> dict[int, tuple[float, int, int]]:
    """For each item found: the best similarity, the window's first word and its number of words.

    Windows are as long as the item, or the text if that is shorter. A window of a shingles reaches the
    threshold t with an item of b only if they share t (a + b) / (1 + t), so windows with fewer shingles
    that any item has are not fingerprinted.
    """
    best: dict[int, tuple[float, int, int]] = {}
    hashes = word_hashes(words)
    for k, wanted in index.wanted.items():
        grams = gram_hashes(hashes, k)
        hit = np.nonzero(index.quick[k][grams >> np.uint64(44)])[0]
        hit = hit[wanted[np.minimum(np.searchsorted(wanted, grams[hit]), len(wanted) - 1)] == grams[hit]]
        if not len(hit):
            continue
        upto = np.zeros(len(grams) + 1, np.int64)
        upto[hit + 1] = 1
        upto = upto.cumsum()
        for whole, members, fps in index.classes:
            if min(index.width, whole) != k:
                continue
            length = min(whole, len(words))
            size = length - k + 1
            need = np.ceil(threshold * (size + whole - k + 1) / (1 + threshold) - 1e-6)
            starts = np.nonzero(upto[size:] - upto[: len(upto) - size] >= max(1, need))[0]
            cuts = np.nonzero(np.diff(starts) > size)[0] + 1
            for run in np.split(starts, cuts):
                for at in range(0, len(run), RUN):
                    part = run[at : at + RUN]
                    if not len(part):
                        continue
                    last, have = -1, Counter()
                    for ws, items in index.near(window_prints(grams, part, size), fps):
                        for w, i in zip(ws.tolist(), items.tolist(), strict=True):
                            start, item = int(part[w]), int(members[i])
                            if start != last:
                                last, have = start, Counter(tuple(words[j : j + k]) for j in range(start, start + size))
                            s = similarity(have, index.grams[item])
                            if s >= threshold and (item not in best or (-s, start) < (-best[item][0], best[item][1])):
                                best[item] = (s, start, length)
    return best


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    radius: int = 20,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``id_col, item_col, similarity, start, n_words``: the best window of each item in each row's text.

    Words are in lower case and parted at ASCII white space and punctuation. A window of an item's length counts if the weighted
    Jaccard similarity of its ``width``-word shingles with the item's is at least ``threshold`` (items
    with fewer words are one shingle). Candidates are windows whose 64-bit SimHash is at most ``radius``
    bits from the item's; at similarity 0.8 that is 3.6 standard deviations above the mean distance. Ties
    go to the first window. Null, empty and wordless texts and items match nothing; repeated rows and
    items each give their rows; an empty table gives an empty result. Ids may be of any type; other columns
    are ignored, whatever their names. Texts of any length are read whole, in runs of bounded size.

    Items are read in blocks of about ``block_bytes`` of text by a hash of their id, one index at a time
    being broadcast; each block is one pass over the texts, which stay where they are.
    """
    prepare(docs.sparkSession)
    kinds = dict(docs.dtypes), dict(benchmark.dtypes)
    schema = f"id {kinds[0][id_col]}, item {kinds[1][item_col]}, similarity double, start bigint, n_words bigint"
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_type = to_arrow_type(items.schema["item"].dataType)
    found = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        split = [(r["item"], words_of(r["text"])) for r in mine]
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex([x for x in split if x[1]], width, radius))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    words = words_of(t.as_py())
                    if not words or not index.value.ids:
                        continue
                    got = matches(words, index.value, threshold)
                    out += [(d, index.value.ids[i], *v) for i, v in sorted(got.items())]
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], item_type), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    ["id", "item", "similarity", "start", "n_words"],
                )

        found.append(rows.mapInArrow(run, schema))
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity", "start", "n_words")
