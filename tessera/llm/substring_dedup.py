"""Substring dedup: matching statistics of documents against suffix automata of reference shards."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.decontaminate import gram_hashes
from tessera.llm.filters import broadcast_filter, in_filter
from tessera.session import durable, prepare, stored

#: Words of an anchor.
ANCHOR = 5
#: Passages of a reference shard, and the number of passages (different ones of a text) from which an anchor is hot.
SHARD_ROWS, HOT = 8_000, 2_000


class SuffixAutomaton:
    """Online suffix automaton of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _copy(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        """Add one sequence; its substrings are matched from now on."""
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._copy(last, c, q)
                continue
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
            last = new

    def statistics(self, words: list[int]) -> Iterator[int]:
        """For each place, how many words up to it are the longest match with a substring that was added."""
        state = n = 0
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                n = 0
            yield n


def anchors(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, anchor hash, first and last window of each run of windows with the same anchor, and a sum over the hashes of its words.

    A window's anchor is its run of ``ANCHOR`` words of least hash, the leftmost of equal ones. It
    depends on the window's words alone, so that equal windows have equal anchors, wherever they stand.
    The texts are laid end to end, and windows across an end are left out.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(size.sum()) - window + 1
    if n <= 0:
        return tuple(np.empty(0, k) for k in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    words = itertools.chain.from_iterable(texts)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n + window - 1)
    g = gram_hashes(h, ANCHOR)
    least, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - ANCHOR + 1):
        other = g[j : j + n]
        at[other < least] = j
        np.minimum(least, other, out=least)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), size)[:n]
    own = np.nonzero(np.arange(n) + window <= (begin + size)[owner])[0]
    place = own + at[own]
    first = np.nonzero(np.diff(place, prepend=-1))[0]
    last = np.append(first[1:], len(own)) - 1
    if not len(own):
        first = last = first[:0]
    text = owner[own[first]]
    sums = np.concatenate((np.zeros(1, np.uint64), h.cumsum(dtype=np.uint64)))
    return text, least[own[first]], own[first] - begin[text], own[last] - begin[text], sums[own[last] + window] - sums[own[first]]


def in_chunks(column, words: int = 1 << 17) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Split texts, gathered until they have about so many words; with the number of the first."""
    at, held, n = 0, [], 0
    for i, t in enumerate(column):
        held.append((t.as_py() or b"").split())
        n += len(held[-1])
        if n >= words:
            yield at, held
            at, held, n = i + 1, [], 0
    if held:
        yield at, held


def shard_masks(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """For passages of one shard, a mask of the windows that a passage of a smaller id holds.

    Different passages pass in the order of their smallest ids: each is matched against the automaton
    of all smaller ids, then added to it. Anchors with one passage have nothing to match. A passage of
    an id that is not its smallest is repeated as a whole.
    """
    rows = rows.assign(first=rows.groupby("piece")["id"].transform("min"))
    pieces = rows.drop_duplicates("piece")
    pieces = pieces[pieces.groupby("m")["m"].transform("size") > 1].sort_values("first", kind="stable")
    automaton, code, masks = SuffixAutomaton(), {}, {}
    waiting, held = [], None
    for piece, first in zip(pieces["piece"], pieces["first"], strict=True):
        if first != held:
            for w in waiting:
                automaton.add(w)
            waiting, held = [], first
        words = [code.setdefault(w, len(code)) for w in piece.split(b" ")]
        waiting.append(words)
        masks[piece] = sum(1 << (i - window + 1) for i, n in enumerate(automaton.statistics(words)) if n >= window)
    whole = [(1 << (p.count(b" ") + 2 - window)) - 1 for p in rows["piece"]]
    own = [masks.get(p, 0) for p in rows["piece"]]
    mask = np.where(rows["id"] > rows["first"], np.array(whole, np.int64), np.array(own, np.int64))
    return rows.assign(mask=mask)[["id", "h", "starts", "mask"]][mask != 0]


def hot_masks(rows: DataFrame, window: int) -> DataFrame:
    """The same for hot anchors: passages are collapsed by a combined aggregate, then compared window by window."""
    rows = rows.withColumn("p", F.unhex(F.md5("piece")))
    distinct = rows.groupBy("p", "piece").agg(F.min("id").alias("first"))
    words = F.split(F.col("piece").cast("string"), " ")
    spread = distinct.select("p", "first", words.alias("w"))
    spread = spread.select("p", "first", "w", F.explode(F.sequence(F.lit(0), F.size("w") - window)).alias("i"))
    spread = spread.select("p", "first", "i", F.unhex(F.md5(F.array_join(F.slice("w", F.col("i") + 1, window), " "))).alias("win"))
    least = spread.groupBy("win").agg(F.min("first").alias("least"))
    met = spread.join(least.withColumnRenamed("win", "w2"), F.col("win") == F.col("w2"))
    bit = F.expr("if(least < first, shiftleft(1L, i), 0L)")
    masks = met.groupBy("p").agg(F.bit_or(bit).alias("own"), F.min("first").alias("first"), F.max("i").alias("last"))
    masks = durable(masks.withColumnRenamed("p", "mp"))
    mask = F.when(F.col("id") > F.col("first"), F.expr("shiftleft(1L, last + 1) - 1")).otherwise(F.col("own"))
    found = rows.select("id", "h", "starts", "p").join(masks, F.col("p") == F.col("mp"))
    return found.select("id", "h", "starts", mask.alias("mask")).where("mask <> 0")


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``id, h, places``: for each text with windows that a smaller id's text holds, their first words.

    ``h`` is a hash of the text, which tells rows of the same id apart.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("binary").alias("text")
    )

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in in_chunks(b.column(1)):
                text, m, _, _, piece = anchors(texts, window)
                every = pd.DataFrame({"t": text + at, "m": m.view(np.int64), "piece": piece}).drop_duplicates()
                each = every.groupby(["t", "m"], sort=False).size().reset_index(name="n")
                ids = b.column(0).take(pa.array(each["t"].to_numpy()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(each["m"].to_numpy()), pa.array(each["n"].to_numpy(), pa.int32())], ["id", "h", "n"])

    listed = rows.select("id", "text").mapInArrow(list_anchors, f"id {kind}, h bigint, n int")
    repeated = listed.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.sum("n").alias("n"))
    repeated = durable(repeated.where("a < b").select("h", "n"))
    total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > HOT)).first()
    known, bits = broadcast_filter(repeated, total[0])
    hot, hot_bits = broadcast_filter(repeated.where(F.col("n") > HOT), total[2])

    def passages(want_hot: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, texts in in_chunks(b.column(2)):
                    text, m, lo, hi, _ = anchors(texts, window)
                    some = in_filter(known.value, bits, m)
                    some[some] = in_filter(hot.value, hot_bits, m[some]) == want_hot
                    found: dict[tuple[int, int, bytes], list[int]] = {}
                    for t, a, x, y in zip(text[some].tolist(), m[some].view(np.int64).tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                        found.setdefault((t, a, b" ".join(texts[t][x : y + window])), []).append(x)
                    t, a, piece = zip(*found, strict=True) if found else ((), (), ())
                    take = pa.array([at + x for x in t], pa.int64())
                    cols = [pa.array(a, pa.int64()), pa.array(piece, pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *cols], ["id", "h", "m", "piece", "starts"])

        return rows.mapInArrow(run, f"id {kind}, h bigint, m bigint, piece binary, starts array<int>")

    shards = max(1, -(-total[1] // SHARD_ROWS))
    out = f"id {kind}, h bigint, starts array<int>, mask bigint"
    shard = F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard")
    found = passages(False).groupBy(shard).applyInPandas(lambda rows: shard_masks(rows, window), out)
    if total[2]:
        found = found.unionByName(hot_masks(stored(passages(True))[0], window))
    return found.groupBy("id", "h").agg(F.collect_list(F.struct("starts", "mask")).alias("places"))


def repeated_words(places: pa.ListArray, size: np.ndarray, window: int) -> np.ndarray:
    """For texts laid end to end, which of their words a repeated window covers."""
    begin, total = np.cumsum(size) - size, int(size.sum())
    text = np.repeat(np.arange(len(size)), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    entries = places.flatten()
    if not len(entries):
        return np.zeros(total, bool)
    starts = entries.field("starts")
    entry = np.repeat(np.arange(len(entries)), starts.value_lengths().to_numpy(zero_copy_only=False))
    mask = entries.field("mask").to_numpy(zero_copy_only=False)[entry]
    at = begin[text[entry]] + starts.flatten().to_numpy(zero_copy_only=False)
    edge = np.zeros(total + 1, np.int64)
    for j in range(int(mask.max()).bit_length()):
        p = at[mask >> j & 1 == 1] + j
        edge += np.bincount(p, minlength=total + 1) - np.bincount(p + window, minlength=total + 1)
    return edge.cumsum()[:-1] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_removed, kept_text``.

    Words are split at ASCII white space and kept as they are. A word goes if a window of ``window``
    words of its text covers it whose words also stand, in that order, in a text with a smaller id; all
    windows are judged on the input. What stays is joined by single spaces. Null counts as empty; rows
    with a null id are smaller than nothing and lose nothing; repeated rows of an id don't count against
    each other; an empty table gives an empty result.

    Each window has an anchor that its words alone decide, so that equal windows share one. Anchors of
    two ids or more are found by a map-side combined aggregate. The passages around those (told by a
    filter of bounded size, whose false hits do no harm) are dealt by anchor to reference shards of
    bounded size. A shard's task holds its suffix automaton and lets the shard's passages pass in the
    order of their ids for matching statistics. Anchors of more than ``HOT`` passages would not
    fit a shard; theirs are collapsed to different ones and compared window by window instead. Only texts
    that lose words are shuffled (and the few that the second filter lets through). Texts of any length
    are read whole; other columns are ignored, whatever their names. A window is of ``ANCHOR`` to 64 words.
    """
    if not ANCHOR <= window <= 64:
        raise ValueError(f"window must be {ANCHOR} to 64 words")
    prepare(docs.sparkSession)
    found = durable(repeated_windows(docs, id_col, text_col, window))
    touched = found.select(F.xxhash64("id", "h").alias("h"))
    sure, bits = broadcast_filter(touched, found.count())
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("h"),
        F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))).alias("k"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )

    def part(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k = b.column(2).to_numpy().view(np.uint64)
                b = b.filter(pa.array(in_filter(sure.value, bits, k) == hit))
                if hit:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3)], ["id", "h", "text"])
                    continue
                for at, words in in_chunks(b.column(3)):
                    n = pa.array(map(len, words), pa.int64())
                    text = pa.array(map(b" ".join, words), pa.binary()).view(pa.string())
                    none = pa.array(np.zeros(len(n), np.int64))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), n, none, text], names)

        return run

    names = ["id", "n_words", "n_removed", "kept_text"]
    out_schema = f"id {kind}, n_words bigint, n_removed bigint, kept_text string"
    whole = rows.mapInArrow(part(False), out_schema)
    f = found.select(F.col("id").alias("fid"), F.col("h").alias("fh"), "places")
    met = rows.mapInArrow(part(True), f"id {kind}, h bigint, text binary")
    met = met.join(f, (F.col("id") == F.col("fid")) & (F.col("h") == F.col("fh")), "left").select("id", "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in in_chunks(b.column(1)):
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                gone = repeated_words(b.column(2).slice(at, len(texts)), size, window)
                ends = np.cumsum(size)
                lost = np.concatenate(([0], gone.cumsum()))
                keep = (~gone).tolist()
                kept = [b" ".join(itertools.compress(w, keep[e - len(w) : e])) for w, e in zip(texts, ends.tolist(), strict=True)]
                cols = [pa.array(size), pa.array(lost[ends] - lost[ends - size], pa.int64()), pa.array(kept, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *cols], names)

    out = whole.unionByName(met.mapInArrow(cut, out_schema))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text")
