"""Corpus text metrics: distinct-n, BLEU and ROUGE-L."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import WORD_KEYS, hashed_words, normalize_for_hash, run_hashes, word_lists


def ngram_rows(df: DataFrame, keep: Sequence[str], text: str, n: int) -> DataFrame:
    """``keep, g``: each n-gram of each text, repeats included."""
    w = df.select(*keep, F.split(normalize_for_hash(F.col(text)), " ").alias("_w")).where(f"_w[0] <> '' and size(_w) >= {n}")
    return w.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, F.lit(n)), " "))).alias("g"))


def distinct_n(df: DataFrame, group: str, text: str, ns: Sequence[int]) -> DataFrame:
    """``group, n, total, uniq, rate``: distinct over all n-grams of a group's texts, told apart by two 64-bit hashes and counted within each Arrow batch first."""
    texts = df.select(F.col(group).alias("_g"), F.lower(text).alias("_l"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = word_lists(batch.column(1))
            groups = batch.column(0).dictionary_encode(null_encoding="encode")
            code, length = groups.indices.to_numpy(), np.diff(ends)
            for n in ns:
                count = np.maximum(length - n + 1, 0)
                at = np.arange(count.sum()) + np.repeat(ends[:-1] - (np.cumsum(count) - count), count)
                one, two = (run_hashes(hashed_words(words, key), at, np.full(len(at), n)) for key in WORD_KEYS)
                of = np.repeat(code, count)
                for g in range(len(groups.dictionary)):
                    mine = of == g
                    x, first, c = np.unique(one[mine], return_index=True, return_counts=True)
                    names = groups.dictionary.take(pa.array(np.full(len(x), g)))
                    yield pa.RecordBatch.from_arrays([names, *map(pa.array, (np.full(len(x), n), x, two[mine][first], c))], ["_g", "n", "_a", "_b", "c"])

    kind = texts.schema["_g"].dataType.simpleString()
    per = texts.mapInArrow(counted, f"_g {kind}, n bigint, _a bigint, _b bigint, c bigint").groupBy("_g", "n", "_a", "_b").agg(F.sum("c").alias("c"))
    out = per.groupBy(F.col("_g").alias(group), "n").agg(F.sum("c").alias("total"), F.count("*").alias("uniq"))
    return out.withColumn("rate", F.round(F.col("uniq") / F.col("total"), 9))


def clipped_precision(df: DataFrame, key: str, hyp: str, ref: str, n: int) -> DataFrame:
    """``key, matched, total``: n-grams of the hypothesis, and those that the reference has, each as often as it has it."""
    h = ngram_rows(df, [key], hyp, n).groupBy(key, "g").agg(F.count("*").alias("h"))
    r = ngram_rows(df, [key], ref, n).groupBy(key, "g").agg(F.count("*").alias("r"))
    met = h.join(r, [key, "g"], "left")
    return met.groupBy(key).agg(F.sum(F.least("h", F.coalesce("r", F.lit(0)))).alias("matched"), F.sum("h").alias("total"))


def bleu(df: DataFrame, key: str, hyp: str, ref: str, most: int = 2) -> DataFrame:
    """``key, bleu``: clipped precisions up to ``most`` (one added above 1), brevity penalty; 0 where any is 0."""
    size = lambda c: F.size(F.filter(F.split(normalize_for_hash(F.col(c)), " "), lambda x: x != ""))
    out = df.select(key, size(hyp).alias("_h"), size(ref).alias("_r"))
    logs = []
    for n in range(1, most + 1):
        p = clipped_precision(df, key, hyp, ref, n).select(key, F.col("matched").alias(f"_m{n}"), F.col("total").alias(f"_t{n}"))
        out = out.join(p, key, "left").fillna(0, [f"_m{n}", f"_t{n}"])
        add = 0 if n == 1 else 1
        logs.append(F.try_divide(F.col(f"_m{n}") + add, F.col(f"_t{n}") + add))
    score = F.exp(sum((F.log(x) for x in logs[1:]), F.log(logs[0])) / most)
    brevity = F.when(F.col("_h") > F.col("_r"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("_r"), F.col("_h"))))
    zero = (F.col("_h") == 0) | F.least(*[F.coalesce(x, F.lit(0.0)) for x in logs]).isNull() | (F.least(*[F.coalesce(x, F.lit(0.0)) for x in logs]) <= 0)
    return out.select(key, F.when(zero, F.lit(0.0)).otherwise(brevity * score).alias("bleu"))


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence by bit rows: one big integer is a row of the table."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = row | places.get(w, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def rouge_l(df: DataFrame, key: str, hyp: str, ref: str) -> DataFrame:
    """``key, rouge_l``: F1 of the longest common subsequence of tokens; 0 where a side has none. Arrow batches; nothing is shuffled."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            out = []
            for h, r in zip(pdf["h"], pdf["r"], strict=True):
                a, b = (h or "").split(), (r or "").split()
                n = lcs_length(a, b)
                out.append(2 * n / (len(a) + len(b)) if n else 0.0)
            yield pd.DataFrame({key: pdf[key], "rouge_l": out})

    rows = df.select(key, normalize_for_hash(F.col(hyp)).alias("h"), normalize_for_hash(F.col(ref)).alias("r"))
    return rows.mapInPandas(run, f"`{key}` {kind}, rouge_l double")
