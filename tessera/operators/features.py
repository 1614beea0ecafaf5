"""Feature tables: weights, caps, bands, sparse text vectors and catalog statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ids import hash_int
from tessera.functions.numbers import cosine, finite
from tessera.functions.text import normalize_for_hash, word_lists
from tessera.operators.keys import alone_and_shared
from tessera.operators.sampling import column_quantiles, exact_quantiles
from tessera.session import durable

#: Words of the sparse text vectors: two or more of these.
TERM = r"([a-z0-9_][a-z0-9_]+)"


def group_weights(df: DataFrame, group: str) -> DataFrame:
    """Add ``weight``, so that each group's rows sum to 1."""
    return df.withColumn("weight", 1.0 / F.count("*").over(W.partitionBy(group)))


def mirrored_pairs(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Decided pairs and their mirror images, with ``diff``, ``label`` and a weight of one half over the group's pairs."""
    d = df.where(F.col(a) != F.col(b)).withColumn("weight", 0.5 / F.count("*").over(W.partitionBy(group)))
    both = d.withColumn("_s", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("diff", F.col("_s") * (F.col(a) - F.col(b)))
    return both.withColumn("label", (F.col("diff") > 0).cast("int")).drop("_s")


def capped(df: DataFrame, train: DataFrame, group: str, x: str) -> DataFrame:
    """Add ``capped``: the value, at most the group's greatest in training. One small table of caps is joined."""
    caps = train.where(finite(F.col(x))).groupBy(group).agg(F.max(x).alias("_cap"))
    return df.join(caps, group).withColumn("capped", F.least(F.col(x), F.col("_cap"))).drop("_cap")


def envelope_report(df: DataFrame, train: DataFrame, fields: Sequence[str], group: str, slack: float = 1e-12) -> DataFrame:
    """Share of values outside the training range and largest margin, per group; severe beyond a tenth, or a margin of 1.

    The range is one row and is broadcast.
    """
    ends = train.agg(*[f(c).alias(f"_{n}_{c}") for c in fields for n, f in (("lo", F.min), ("hi", F.max))])
    met = df.join(F.broadcast(ends))
    out = [((F.col(c) < F.col(f"_lo_{c}") - slack) | (F.col(c) > F.col(f"_hi_{c}") + slack)).cast("double") for c in fields]
    margins = [x for c in fields for x in (F.col(f"_lo_{c}") - F.col(c), F.col(c) - F.col(f"_hi_{c}"))]
    share = sum(out[1:], out[0]) / len(fields)
    g = met.groupBy(group).agg(F.count("*").alias("n"), F.avg(share).alias("outside"), F.max(F.greatest(*margins, F.lit(0.0))).alias("margin"))
    return g.withColumn("severe", (F.col("outside") > 0.1) | (F.col("margin") > 1))


def centroid(df: DataFrame, vector: str, group: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean of vectors: exploded by place, so that partial sums combine."""
    means = df.select(*group, F.posexplode(vector).alias("_i", "_x")).groupBy(*group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"])
    return means.groupBy(*group).agg(ordered.alias("centre"))


def centroid_report(df: DataFrame, train: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine distance to the training centroid; severe beyond 0.45 and twice the training's 95th percentile."""
    c = F.broadcast(centroid(train, vector))
    far = (1 - cosine(F.col(vector), F.col("centre"))).alias("distance")
    most = exact_quantiles(train.join(c).select(far), "distance", [0.95])[0]
    return df.join(c).select(key, far).select(key, "distance", (F.col("distance") > max(0.45, 2 * (most or 0.0))).alias("severe"))


def catalog_summary(df: DataFrame, group: str, vector: str, conflict: float = 0.1) -> DataFrame:
    """Per group: size, mean, greatest and 90th percentile of similarity to its centroid, and the share below ``conflict``."""
    s = df.join(centroid(df, vector, [group]), group).withColumn("_s", cosine(F.col(vector), F.col("centre")))
    return s.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg("_s").alias("mean_similarity"),
        F.max("_s").alias("max_similarity"),
        F.percentile("_s", F.lit(0.9)).alias("p90_similarity"),
        F.avg((F.col("_s") < conflict).cast("double")).alias("conflict"),
    )


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, n``: words and word pairs of each text."""
    # Words and pairs are made in one pass; the split is a column of its own, which the lambda must not evaluate again at each place.
    words = df.select(key, F.split(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1)), " "), " ").alias("_w"))
    pairs = F.zip_with(F.slice("_w", F.lit(1), F.size("_w") - 1), F.slice("_w", F.lit(2), F.size("_w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    terms = words.where("_w[0] <> ''").select(key, F.explode(F.concat(F.col("_w"), pairs)).alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("n"))


def vocabulary(tf: DataFrame, max_terms: int, min_df: int) -> DataFrame:
    """``term, _df``: the ``max_terms`` most frequent terms of at least ``min_df`` texts, a fixed bound."""
    found = tf.groupBy("term").agg(F.count("*").alias("_df"), F.sum("n").alias("_t")).where(F.col("_df") >= min_df)
    return found.orderBy(F.col("_t").desc(), "term").limit(max_terms).select("term", "_df")


#: Letters of a term: words of two or more of these, as ``TERM`` has it.
_TERM_BYTES = np.frombuffer(bytes(c if c == 95 or chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256)), np.uint8)


def _coded_terms(lowered: pa.Array, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A row's number and a code for each of its words in order, and the words of the codes; words that are not among ``known`` have code -1."""
    words, ends = word_lists(lowered, _TERM_BYTES)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    long = pc.greater(pc.binary_length(words), 1)
    words, row = words.filter(long), row[long.to_numpy(zero_copy_only=False)]
    if known is not None:
        return row, pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False).astype(np.int64), known
    coded = words.dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _coded_pairs(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes (first times n plus second) of neighbouring words that both have a code."""
    both = (row[:-1] == row[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)
    return row[:-1][both], code[:-1][both] * n + code[1:][both]


def _row_counts(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's different codes below n, and how often it has each."""
    keys, c = np.unique(row * n + code, return_counts=True)
    return keys // n, keys % n, c


def _batch_totals(texts: DataFrame, counted: Callable) -> DataFrame:
    """``term, _df, _t``: rows that have a term, and its places, from each batch's sums. ``counted`` gives each row's codes, their counts, and the names of codes."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, c, names = counted(batch.column(0))
            some, at = np.unique(code, return_inverse=True)
            yield pa.RecordBatch.from_arrays([names(some), pa.array(np.bincount(at, minlength=len(some)).astype(np.int64)), pa.array(np.bincount(at, c, len(some)).astype(np.int64))], ["term", "_df", "_t"])

    return texts.select("_l").mapInArrow(totals, "term string, _df bigint, _t bigint")


def row_vocabulary(texts: DataFrame, shared: DataFrame | None, max_terms: int, min_df: int) -> list[tuple[str, int]]:
    """``vocabulary`` of lower-cased texts ``_l``, each a key of its own, and of the ``shared`` term counts: words first, then pairs.

    A pair stands no more often than its words. So of the pairs only those are counted whose words both are
    among the first ``max_terms`` words, or as frequent as the last of these: some ``max_terms`` squared at most, but for ties.
    """

    def words_of(lowered):
        row, code, names = _coded_terms(lowered)
        _, code, c = _row_counts(row, code, max(len(names), 1))
        return code, c, lambda some: names.take(pa.array(some))

    def found(new: DataFrame, old: DataFrame | None) -> DataFrame:
        if old is not None:
            new = new.unionByName(old.groupBy("term").agg(F.count("*").alias("_df"), F.sum("n").alias("_t")))
        return new.groupBy("term").agg(F.sum("_df").alias("_df"), F.sum("_t").alias("_t")).where(F.col("_df") >= min_df)

    one = None if shared is None else shared.where(~F.col("term").contains(" "))
    words = durable(found(_batch_totals(texts, words_of), one))
    first = words.orderBy(F.col("_t").desc(), "term").limit(max_terms)
    least = first.agg(F.min("_t"), F.count("*")).first()
    kept = words.where(F.col("_t") >= least[0]) if least[1] == max_terms else words
    known = texts.sparkSession.sparkContext.broadcast(sorted(r.term for r in kept.select("term").collect()))

    def pairs_of(lowered):
        names = pa.array(known.value, pa.string())
        n = max(len(names), 1)
        row, code, _ = _coded_terms(lowered, names)
        _, code, c = _row_counts(*_coded_pairs(row, code, n), n * n)
        return code, c, lambda some: pc.binary_join_element_wise(names.take(pa.array(some // n)), names.take(pa.array(some % n)), " ")

    two = None if shared is None else shared.where(F.col("term").contains(" "))
    every = words.unionByName(found(_batch_totals(texts, pairs_of), two))
    return [(r.term, r._df) for r in every.orderBy(F.col("_t").desc(), "term").limit(max_terms).collect()]


def tfidf(df: DataFrame, key: str, text: str, max_terms: int = 2048, min_df: int = 2) -> DataFrame:
    """``key, term, weight``: words and word pairs, sublinear counts, smoothed idf plus 1, unit length, over the texts' own ``vocabulary``.

    A text's terms are counted where it lies. Only keys that several rows have are met by a shuffle.
    """
    alone, many = alone_and_shared(df, key)
    texts = alone.select(F.col(key).alias("_k"), F.lower(text).alias("_l"))
    shared = None if many is None else durable(term_counts(many, key, text))
    terms = row_vocabulary(texts, shared, max_terms, min_df)
    size = df.count()
    idf = {t: math.log((1 + size) / (1 + n)) + 1 for t, n in terms}
    names = sorted(idf)
    kind = df.schema[key].dataType.simpleString()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(sorted({w for t in names for w in t.split(" ")}), pa.string())
        place = {w: i for i, w in enumerate(words.to_pylist())}
        n = max(len(words), 1)
        # A word's code is its place, a pair's comes after all words.
        codes = np.array([place[t] if " " not in t else n + place[t.split(" ")[0]] * n + place[t.split(" ")[1]] for t in names], np.int64)
        order = np.argsort(codes)
        codes, weights = codes[order], np.array([idf[t] for t in names])[order]
        named = pa.array(names, pa.string()).take(pa.array(order))
        for batch in batches:
            row, code, _ = _coded_terms(batch.column(1), words)
            prow, pair = _coded_pairs(row, code, n)
            row, code = np.concatenate([row, prow]), np.concatenate([code, n + pair])
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            met = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            row, at, c = _row_counts(row[met], at[met], max(len(codes), 1))
            x = (1 + np.log(c)) * weights[at]
            norm = np.sqrt(np.bincount(row, x * x, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), named.take(pa.array(at)), pa.array(x / norm[row])], [key, "term", "weight"])

    out = texts.mapInArrow(weighed, f"{key} {kind}, term string, weight double")
    if shared is None:
        return out
    known = F.broadcast(df.sparkSession.createDataFrame(list(idf.items()), "term string, _i double"))
    x = shared.join(known, "term").withColumn("_x", (1 + F.log("n")) * F.col("_i"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(W.partitionBy(key)))
    return out.unionByName(x.withColumn("weight", F.col("_x") / norm).select(key, "term", "weight"))


def hashed_fingerprint(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """``key, vector``: counts of words and word pairs in hashed places, unit length, rounded to eight digits; zeros for no words."""
    words = df.select(key, F.split(normalize_for_hash(F.col(text)), " ").alias("_w"))
    pairs = F.zip_with(F.slice("_w", F.lit(1), F.size("_w") - 1), F.slice("_w", F.lit(2), F.size("_w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    terms = F.when(F.col("_w")[0] == "", F.array().cast("array<string>")).otherwise(F.concat(F.col("_w"), pairs))
    at = words.select(key, F.explode_outer(terms).alias("t")).select(key, (hash_int("t") % size).alias("i"), F.col("t").isNotNull().cast("double").alias("x"))
    n = at.groupBy(key, "i").agg(F.sum("x").alias("x"))
    n = n.withColumn("x", F.coalesce(F.try_divide(F.col("x"), F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))), F.lit(0.0)))
    m = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), F.round("x", 8)))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def robust_scaled(df: DataFrame, train: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each field less its training median, over its interquartile range (over 1 where that is 0). The statistics are the driver's numbers."""
    q = {c: [v or 0.0 for v in some] for c, some in column_quantiles(train, fields, [0.25, 0.5, 0.75]).items()}
    return df.withColumns({c: (F.col(c) - b) / ((d - a) or 1.0) for c, (a, b, d) in q.items()})


def gated_terms(terms: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """``key, gate, term, weight``: a text's terms once for each source that the state's mask has, and once for a strategy.

    A term counts under the gates that an action opens, so that one linear head can weigh a text
    differently by what is retrieved.
    """
    gates = F.array_compact(
        F.array(*[F.when(F.col("available").bitwiseAND(F.lit(bit)) > 0, F.lit(name)) for name, bit in (("MP", 1), ("MS", 2), ("ME", 4))], F.lit("RS"))
    )
    return terms.join(states.select(key, F.explode(gates).alias("gate")), key).select(key, "gate", "term", "weight")


def char_gram_hashes(df: DataFrame, key: str, text: str, size: int = 256, lo: int = 3, hi: int = 5) -> DataFrame:
    """``key, bucket, weight``: runs of ``lo`` to ``hi`` characters within words (a space on either side) in hashed places, of unit length for each key."""
    words = df.select(key, F.explode(F.split(normalize_for_hash(F.col(text)), " ")).alias("w")).where("w <> ''").withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1)))
        return F.when(F.length("w") >= n, F.transform(starts, lambda i: F.substr("w", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = words.select(key, F.explode(F.concat(*map(runs, range(lo, hi + 1)))).alias("g"))
    c = grams.groupBy(key, (hash_int("g") % size).alias("bucket")).agg(F.count("*").alias("c"))
    return c.select(key, "bucket", (F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(W.partitionBy(key)))).alias("weight"))


def band_report(df: DataFrame, train: DataFrame, fields: Sequence[str], lo: float = 0.01, hi: float = 0.99, severe: float = 0.25) -> DataFrame:
    """Add ``excess``, the mean over ``fields`` of how far a value lies outside the training band, in units of the band's nearer end (1 at least), and ``severe``."""
    ends = column_quantiles(train, fields, [lo, hi])
    over = [F.greatest((a - F.col(c)) / max(abs(a), 1.0), (F.col(c) - b) / max(abs(b), 1.0), F.lit(0.0)) for c, (a, b) in ends.items()]
    return df.withColumn("excess", sum(over[1:], over[0]) / len(over)).withColumn("severe", F.col("excess") > severe)
