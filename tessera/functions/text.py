"""Text expressions: normal forms, tokens, shingles, overlap and cues. All are columns, but for the hashed shingles, which are made in Arrow batches."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a run of these; the class is ASCII on purpose, so that accented words split.
TOKEN = r"([A-Za-z0-9']+)"

#: Words that mark a turn as advice, distress or reflection.
CUES = {
    "advice": r"(?i)\b(should|could|try|maybe|perhaps|recommend|suggest|advice)\b",
    "distress": r"(?i)\b(sad|afraid|worried|anxious|alone|hurt|tired|stressed)\b",
    "reflection": r"(?i)\b(feel|feeling|think|believe|remember|realize|understand)\b",
}


def normalize_space(t: Column) -> Column:
    """Null to empty; runs of Unicode white space to one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " "))


def normalize_text(t: Column) -> Column:
    """Lower-cased, trimmed, white space collapsed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"(?U)\s+", " "))


def tokens(t: Column) -> Column:
    """Lower-cased tokens, repeats included; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(TOKEN), F.lit(1))


def normalize_for_hash(t: Column) -> Column:
    """Tokens joined by one space. Two texts with the same form are copies."""
    return F.array_join(tokens(t), " ")


def token_set(t: Column) -> Column:
    return F.array_distinct(tokens(t))


def estimate_tokens(t: Column) -> Column:
    """A quarter of the code points, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(t, F.lit(""))) / 4)).cast("long")


def grams(words: Column, n: int) -> Column:
    """Contiguous n-grams of an array of words, joined by a space; none where there are fewer words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    built = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, built).otherwise(F.array().cast("array<string>"))


def shingles(words: Column, n: int = 5) -> Column:
    """As ``grams``, but fewer words than ``n`` make one shingle of them all."""
    whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) >= n, grams(words, n)).otherwise(whole)


#: For each byte what it is in a normal form: itself, or a space.
_WORD_BYTES = np.frombuffer(bytes(c if chr(c) in "'abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256)), np.uint8)


def word_lists(lowered: pa.Array, kept: np.ndarray = _WORD_BYTES) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-cased texts, end to end, and where each text's tokens begin and end. ``kept`` gives for each byte itself, or a space."""
    lowered = pc.fill_null(lowered.cast(pa.string()), "")
    _, offsets, data = lowered.buffers()
    spaced = pa.py_buffer(kept[np.frombuffer(data or b"", np.uint8)])
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(lowered), [None, offsets, spaced], offset=lowered.offset))
    words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    return words.filter(pa.array(some)), before[np.concatenate([[0], np.cumsum(counts)])]


#: Two keys for hashes of words; the first is the usual one.
WORD_KEYS = "0123456789123456", "6543219876543210"


def hashed_words(words: pa.Array, key: str = WORD_KEYS[0]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    coded = words.dictionary_encode()
    return pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), hash_key=key, categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]


def run_hashes(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each place."""
    h = np.zeros(len(at), np.uint64)
    for k in range(int(size.max(initial=0))):
        whole = size > k
        x = (h[whole] ^ words[at[whole] + k]) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h[whole] = (x ^ (x >> np.uint64(31))) + np.uint64(k + 1)
    return h.view(np.int64)


#: The digest of a normal form without a token.
NO_TOKEN = hashlib.md5(b"").hexdigest()


def form_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, form``: the MD5 of each row's normal form, made in Arrow batches."""
    texts = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = word_lists(batch.column(1))
            forms = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words), " ").cast(pa.binary())
            got = [hashlib.md5(x.as_buffer()).hexdigest() for x in forms]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["id", "form"])

    return texts.mapInArrow(digests, f"id {texts.schema['id'].dataType.simpleString()}, form string")


def shingle_rows(df: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """``id, shingles``: each row's distinct shingles as sorted 64-bit hashes; rows without a token are left out. Hashed in Arrow batches where the rows lie."""
    texts = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = word_lists(batch.column(1))
            some = np.diff(ends) > 0
            length, ends = np.diff(ends)[some], ends[:-1][some]
            count = np.maximum(length - n + 1, 1)
            edges = np.concatenate([[0], np.cumsum(count)])
            at = np.arange(edges[-1]) + np.repeat(ends - edges[:-1], count)
            h = run_hashes(hashed_words(words), at, np.repeat(np.minimum(length, n), count))
            sets = [np.unique(h[a:b]) for a, b in itertools.pairwise(edges)]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))], ["id", "shingles"])

    return texts.mapInArrow(hashed, f"id {texts.schema['id'].dataType.simpleString()}, shingles array<bigint>")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """``id, shingles``, one row for each id. Only ids that several rows have are grouped: nothing of the others is shuffled."""
    from tessera.operators.keys import alone_and_shared

    alone, shared = alone_and_shared(df, id_col)
    out = shingle_rows(alone, id_col, text_col, n)
    if shared is None:
        return out
    both = F.array_sort(F.array_distinct(F.flatten(F.collect_list("shingles"))))
    return out.unionByName(shingle_rows(shared, id_col, text_col, n).groupBy("id").agg(both.alias("shingles")))


def exploded_shingles(df: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """Distinct ``(id, shingle)`` with the shingle as a 64-bit hash."""
    return shingle_sets(df, id_col, text_col, n).select("id", F.explode("shingles").alias("shingle"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have similarity 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_distance(a: Column, b: Column) -> Column:
    """One less the similarity, so that two empty sets have distance 0."""
    return 1 - jaccard(a, b)


def clip_text(t: Column, most: int, marker: str = " ... ") -> Column:
    """Head and tail around a marker where a text is longer than ``most`` code points."""
    head, tail = most // 2, most - most // 2
    cut = F.concat(F.substring(t, 1, head), F.lit(marker), F.right(t, F.lit(tail)))
    return F.when(F.length(t) > most, cut).otherwise(t)


def strip_prefixes(t: Column, *groups: list[str]) -> Column:
    """Drop each prefix once, in order, whatever its case, after ``normalize_space``."""
    out = normalize_space(t)
    for group in groups:
        for p in group:
            cut = F.trim(F.substring(out, len(p) + 1, (1 << 31) - 1))
            out = F.when(F.lower(F.substring(out, 1, len(p))) == p.lower(), cut).otherwise(out)
    return out


def bin_of(n: Column, bounds: list[int], names: list[str]) -> Column:
    """The name of the first bound that ``n`` doesn't exceed; the last name beyond them."""
    out = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(n <= bound, F.lit(name)).otherwise(out)
    return out


def depth_bin(turn: Column) -> Column:
    return bin_of(turn, [2, 4, 8], ["opening", "early", "middle", "late"])


def length_bin(t: Column) -> Column:
    return bin_of(F.size(F.filter(F.split(normalize_space(t), " "), lambda x: x != "")), [8, 20], ["short", "medium", "long"])


def has_action_code(t: Column) -> Column:
    """Whether a text names an action by its code, in any case; false for null."""
    from tessera.operators.actions import MEMORY, STRATEGIES

    return F.coalesce(t.rlike(rf"(?i)\b({'|'.join(MEMORY.values())})\+({'|'.join(STRATEGIES)})\b"), F.lit(False))
