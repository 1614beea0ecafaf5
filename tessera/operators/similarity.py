"""Similarity joins and lexical retrieval through inverted indexes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StructType

from tessera.functions.text import NO_TOKEN, form_digests, hashed_words, normalize_for_hash, shingle_sets, word_lists
from tessera.operators.graph import connected_components
from tessera.operators.keys import SENT_KEYS
from tessera.session import durable


def copy_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, form, has, rep``: a digest of the normal form, whether it has a token, and the smallest id with the same form."""
    forms = durable(form_digests(df, id_col, text_col).withColumn("has", F.col("form") != NO_TOKEN))
    least = forms.groupBy(F.col("form").alias("f")).agg(F.min("id").alias("rep"))
    return forms.join(least, F.col("form") == F.col("f")).select("id", "form", "has", "rep")


def copy_reps(forms: DataFrame) -> DataFrame:
    """``id, rep`` of rows of ``id, form``: the smallest id whose shingles are the same. An id of several rows has those of all, so it stands for itself."""
    own = forms.groupBy("id").agg(F.min("form").alias("form"), F.when(F.count("*") > 1, F.col("id")).alias("own"))
    least = own.where("own is null").groupBy(F.col("form").alias("f")).agg(F.min("id").alias("least"))
    return own.join(least, (F.col("form") == F.col("f")) & F.col("own").isNull(), "left").select("id", F.coalesce("own", "least").alias("rep"))


#: Shingles that many sets have: at most so many are told from the others, and so many sets are looked at for them.
FREQUENT, LOOKED_AT = 1_000_000, 40_000


def frequent_shingles(*sides: DataFrame, seen: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least ``seen`` of some ``LOOKED_AT`` sets, drawn by hash, have, in order, and how many of those sets have each.

    They only order the prefixes, which may follow any order, so no pair depends on the draw.
    """
    both = reduce(DataFrame.unionByName, [s.select("id", "shingles") for s in sides])
    found = both.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= seen)
    top = found.orderBy(F.col("c").desc(), "s").limit(FREQUENT).toPandas().sort_values("s")
    return top["s"].to_numpy(np.int64), top["c"].to_numpy(np.int64)


def prefixes(sets: DataFrame, threshold: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``id, n, place, shingle``: of each set of n the first n - ceil(t n) + 1 shingles, rare before frequent, with their places in that order from 0."""
    kind = sets.schema["id"].dataType.simpleString()
    sent = sets.sparkSession.sparkContext.broadcast(frequent)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in batches:
            lists = batch.column(1)
            h = lists.flatten().to_numpy(zero_copy_only=False)
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            c = np.zeros(len(h), np.int64)
            if len(known):
                near = np.minimum(np.searchsorted(known, h), len(known) - 1)
                c = np.where(known[near] == h, counts[near], 0)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, c, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            size = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            in_prefix = place < np.repeat(size, n)
            kept = order[in_prefix]
            at = row[kept]
            ids = batch.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n[at], place[in_prefix], h[kept]))], ["id", "n", "place", "shingle"])

    return sets.select("id", "shingles").mapInArrow(first, f"id {kind}, n bigint, place bigint, shingle bigint")


#: So many shingles a pair must share before it is looked at, where its prefixes are long enough to hold them.
SHARED = 2


def candidate_pairs(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """``a, b``: pairs of ``prefixes`` that can still reach the threshold; without ``right``, pairs a < b of one side.

    Sets that need m common shingles have l of them among the first n - m + l of both, as behind these at most m - l can
    follow in the set whose prefix ends first. Only those are counted, for the greatest l up to ``SHARED`` that the given prefixes allow.
    """
    named = lambda df, x: df.select(F.col("id").alias(x), "shingle", *[F.col(c).alias(c + x) for c in ("n", "place")])
    met = named(left, "a").join(named(left if right is None else right, "b"), "shingle")
    met = met.where((F.col("a") < F.col("b")) if right is None else F.lit(True)).where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    need = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6)
    least = F.least(F.lit(SHARED), need - F.ceil(F.greatest("na", "nb") * threshold - 1e-9) + 1)
    early = met.where(F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb")) > need - least)
    return early.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("a", "b")


#: Sets of one side that are compared together with those of the other.
CELL = 64


def cells(cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, lead, part`` and ``lead, part, b, those``: the one cell of each left set, and for each cell the right sets it asks for, with the left ids of their pairs.

    Left sets with the same last candidate make cells of about ``CELL``, so a group of n near copies asks for its right sets some n / ``CELL`` times, and not n times.
    """
    last = cand.groupBy("a").agg(F.max("b").alias("lead"))
    sizes = last.groupBy("lead").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    dealt = durable(last.join(sizes, "lead").select("a", "lead", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")))
    return dealt, durable(cand.join(dealt, "a").groupBy("lead", "part", "b").agg(F.collect_list("a").alias("those")))


def verified_pairs(cand: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the candidates at or above the threshold, from ``id, shingles`` of both sides. Sets are sent to the cells that need them, not for each pair."""
    dealt, asked = cells(cand)
    few = cand.count() <= SENT_KEYS
    x = left.select(F.col("id").alias("a"), F.col("shingles").alias("x")).join(F.broadcast(dealt) if few else dealt, "a")
    y = right.select(F.col("id").alias("b"), F.col("shingles").alias("y")).join(F.broadcast(asked) if few else asked, "b")
    met = y.join(x, ["lead", "part"]).where(F.array_contains("those", F.col("a")))
    shared = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("n"))
    return shared.select("a", "b", (F.col("k") / (F.col("n") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)


def shingle_pairs(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """``a, b, similarity`` of all pairs of sets at or above a Jaccard threshold; without ``right``, pairs a < b of one side. Sides are distinct ``(id, shingle)``."""
    gathered = lambda df: durable(df.groupBy("id").agg(F.collect_list(F.col("shingle").cast("long")).alias("shingles")))
    a = gathered(left)
    b = None if right is None else gathered(right)
    drawn = lambda df: df.where(_drawn("id", df.count()))
    frequent = frequent_shingles(*[drawn(x) for x in (a, b) if x is not None])
    cand = durable(candidate_pairs(prefixes(a, threshold, frequent), None if b is None else prefixes(b, threshold, frequent), threshold))
    return verified_pairs(cand, a, a if b is None else b, threshold)


def text_pairs(left: DataFrame, right: DataFrame | None, id_col: str, text_col: str, threshold: float, width: int) -> DataFrame:
    """``shingle_pairs`` of texts. Their sets are made where the texts lie, and only prefixes are shuffled.

    Each set's shingles are ordered from rare to common, and only a prefix of n - ceil(t n) + 1 is indexed: two
    sets that agree in enough shingles share one of both prefixes. Frequent shingles thus fall out of the index;
    sizes must fit too, and enough of the prefixes must agree. Only the texts of candidates are hashed again, to count
    exactly. No pair is lost, and none is made twice.
    """
    sets = lambda df: shingle_sets(df, id_col, text_col, width)
    sides = [left] if right is None else [left, right]
    frequent = frequent_shingles(*[sets(x.where(_drawn(id_col, x.count()))) for x in sides])
    first = [prefixes(sets(x), threshold, frequent) for x in sides]
    cand = durable(candidate_pairs(first[0], None if right is None else first[1], threshold))
    if right is None:
        both = sets(_with_ids(left, id_col, cand.select("a").union(cand.select("b"))))
        return verified_pairs(cand, both, both, threshold)
    return verified_pairs(cand, sets(_with_ids(left, id_col, cand.select("a"))), sets(_with_ids(right, id_col, cand.select("b"))), threshold)


def _drawn(id_col: str, n: int) -> Column:
    """About ``LOOKED_AT`` of n ids."""
    return F.pmod(F.xxhash64(id_col), F.lit(max(1, n // LOOKED_AT))) == 0


def _with_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows that have one of the ids. The ids go to all tasks, or those of the other rows do, if they are few; else texts are shuffled."""
    ids = durable(ids.toDF("_id").distinct())
    if ids.count() <= SENT_KEYS:
        return df.join(F.broadcast(ids), F.col(id_col) == F.col("_id"), "left_semi")
    others = durable(df.select(F.col(id_col).alias("_id")).join(ids, "_id", "left_anti").distinct())
    if others.count() <= SENT_KEYS:
        return df.where(F.col(id_col).isNotNull()).join(F.broadcast(others), F.col(id_col) == F.col("_id"), "left_anti")
    return df.join(ids, F.col(id_col) == F.col("_id"), "left_semi")


def overlap_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.88, width: int = 5) -> DataFrame:
    """One row per document: ``id_col, component, n_links, best``.

    Copies (same normal form) fall together before any pair is made; representatives are joined by
    shingle similarity. ``n_links`` counts the documents that are linked to this one, its copies
    included, ``best`` is its greatest similarity. Texts without a token are linked to nothing.
    """
    classes = durable(copy_classes(df, id_col, text_col))
    size = durable(classes.groupBy("rep").agg(F.count("*").alias("size"), F.max("has").alias("has")))
    pairs = durable(text_pairs(_with_ids(df, id_col, size.select("rep")), None, id_col, text_col, threshold, width))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    links = both.join(size.select(F.col("rep").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("outer"), F.max("similarity").alias("best"))
    comp = connected_components(pairs, "a", "b").select(F.col("node").alias("rep"), "component")
    out = classes.drop("has").join(size, "rep").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(comp, "rep", "left")
    inner = F.when(F.col("has"), F.col("size") - 1).otherwise(0)
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("has"), F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component"),
        (inner + F.coalesce("outer", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("has") & (F.col("size") > 1), F.lit(1.0)).otherwise(F.col("best")).alias("best"),
    )


def overlaps(left: DataFrame, right: DataFrame, id_col: str, text_col: str, threshold: float = 0.88, width: int = 5) -> DataFrame:
    """``id_col, reason, similarity`` of the left rows that the right side has: ``exact`` in normal form, else ``similar`` with the greatest similarity.

    What is found exactly is not compared further; texts without a token are found nowhere. Copies of each
    side fall together first.
    """
    mine, theirs = (durable(form_digests(x, id_col, text_col).where(F.col("form") != NO_TOKEN)) for x in (left, right))
    exact = durable(mine.join(theirs.select("form").distinct(), "form", "left_semi").select("id").distinct())
    found = F.broadcast(exact) if exact.count() <= SENT_KEYS else exact
    rest = durable(copy_reps(mine.join(found, "id", "left_anti")))
    sides = [_with_ids(x, id_col, r.select("rep")) for x, r in ((left, rest), (right, copy_reps(theirs)))]
    best = text_pairs(*sides, id_col, text_col, threshold, width).groupBy(F.col("a").alias("rep")).agg(F.max("similarity").alias("similarity"))
    near = rest.join(best, "rep").select("id", F.lit("similar").alias("reason"), "similarity")
    return exact.select("id", F.lit("exact").alias("reason"), F.lit(1.0).alias("similarity")).unionByName(near).withColumnRenamed("id", id_col)


def containment(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``a, b, contained``: pairs in which at least this share of the right set's shingles is in the left set.

    Each right set is indexed by its rarest shingles only: a set of n that must share ceil(t n) has one
    of any n - ceil(t n) + 1 of them in common. Of the left sets only what stands in some right set is
    kept, before anything is counted.
    """
    left = durable(left.join(right.select("shingle").distinct(), "shingle", "left_semi").select("id", "shingle"))
    freq = left.groupBy("shingle").agg(F.count("*").alias("df")).select(F.col("shingle").alias("s"), "df")
    w = W.partitionBy("id")
    r = right.join(freq, F.col("shingle") == F.col("s"), "left").withColumn("n", F.count("*").over(w))
    r = r.withColumn("r", F.row_number().over(w.orderBy(F.coalesce("df", F.lit(0)), "shingle")))
    prefix = r.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    cand = left.select(F.col("id").alias("a"), "shingle").join(prefix.select(F.col("id").alias("b"), "shingle", "n"), "shingle").select("a", "b", "n").distinct()
    mine = cand.join(right.select(F.col("id").alias("b"), "shingle"), "b")
    hits = mine.join(left.select(F.col("id").alias("a"), "shingle"), ["a", "shingle"])
    met = hits.groupBy("a", "b", "n").agg((F.count("*") / F.first("n")).alias("contained"))
    return met.where(F.col("contained") >= threshold).select("a", "b", "contained")


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf, norm`` of a text's tokens."""
    words = df.select(F.col(id_col).alias("id"), F.explode(F.split(normalize_for_hash(F.col(text_col)), " ")).alias("term")).where("term <> ''")
    tf = words.groupBy("id", "term").agg(F.count("*").alias("tf"))
    return tf.withColumn("norm", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(W.partitionBy("id"))))


def lexical_scores(queries: DataFrame, items: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """``q, d, score``: cosine of raw term counts of all pairs that share a term (others score 0), from two ``term_counts``.

    The items' rows are broadcast if there are at most ``broadcast_rows``, so that a term that many queries
    have is no hot key; beyond that the join is shuffled, and adaptive execution splits such terms.
    """
    q = queries.select(F.col("id").alias("q"), "term", F.col("tf").alias("qt"), F.col("norm").alias("qn"))
    i = durable(items.select(F.col("id").alias("d"), "term", F.col("tf").alias("dt"), F.col("norm").alias("dn")))
    i = F.broadcast(i) if i.count() <= broadcast_rows else i
    met = q.join(i, "term").groupBy("q", "d", "qn", "dn").agg(F.sum(F.col("qt") * F.col("dt")).alias("dot"))
    return met.select("q", "d", (F.col("dot") / (F.col("qn") * F.col("dn"))).alias("score"))


def top_k(scored: DataFrame, k: int, q: str = "q", d: str = "d", score: str = "score", places: int = 9) -> DataFrame:
    """Per query the ``k`` best by score, then id, both descending, with ``rank`` from 1. Scores are rounded, so that ties are ties in any engine."""
    s = scored.withColumn(score, F.round(score, places))
    r = F.row_number().over(W.partitionBy(q).orderBy(F.col(score).desc(), F.col(d).desc()))
    return s.withColumn("rank", r.cast("long")).where(F.col("rank") <= k)


def retrieve(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``q, d, score, rank``: for each of ``queries`` (``id, text``) the ``k`` best of ``items`` (``id, text``), those of score 0 too.

    A query always gets the smaller of k and the number of items. What shares no term with it comes
    last, in descending order of ids: of those only the 2k - 1 greatest can be needed, a list of fixed
    size that is added to each query's scored items.
    """
    scored = lexical_scores(term_counts(queries, "id", "text"), term_counts(items, "id", "text"))
    last = [r[0] for r in items.select("id").distinct().orderBy(F.col("id").desc()).limit(2 * k - 1).collect()]
    if not last:
        return top_k(scored, k)
    fill = queries.select(F.col("id").alias("q")).distinct().select("q", F.explode(F.array(*map(F.lit, last))).alias("d"), F.lit(0.0).alias("score"))
    return top_k(scored.unionByName(fill).groupBy("q", "d").agg(F.max("score").alias("score")), k)


def counted_words(df: DataFrame, text_col: str) -> DataFrame:
    """``text_col`` replaced by ``words``, its different tokens as sorted 64-bit hashes, their ``counts``, and the ``norm`` of these."""
    kept = [c for c in df.columns if c != text_col]
    lists = [("words", ArrayType(LongType())), ("counts", ArrayType(LongType())), ("norm", DoubleType())]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = word_lists(batch.column(len(kept)))
            h = hashed_words(words).view(np.int64)
            some = [np.unique(h[a:b], return_counts=True) for a, b in itertools.pairwise(ends)]
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in some])]).astype(np.int32))
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in zip(*some)] if some else [pa.array([], pa.int64())] * 2
            norm = pa.array(np.sqrt([float((c * c).sum()) for _, c in some]), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.ListArray.from_arrays(cuts, x) for x in flat), norm], [*kept, *(n for n, _ in lists)])

    source = df.select(*kept, F.lower(text_col).alias(text_col))
    return source.mapInArrow(counted, _with_fields(source.drop(text_col), lists))


def dots(df: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Two pairs of columns of ``counted_words`` replaced by ``dot``, the product of the counts of common words: both sides' words of a batch are sorted together."""
    kept = [c for c in df.columns if c not in (*a, *b)]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns[len(kept) :]
            h, c = (np.concatenate([lists[k].flatten().to_numpy(), lists[k + 2].flatten().to_numpy()]) for k in (0, 1))
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists[k]).to_numpy()) for k in (0, 2)])
            order = np.lexsort((h, row))
            h, c, row = h[order], c[order], row[order]
            same = (h[:-1] == h[1:]) & (row[:-1] == row[1:])
            dot = np.bincount(row[:-1][same], (c[:-1] * c[1:])[same], batch.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(dot)], [*kept, "dot"])

    source = df.select(*kept, *a, *b)
    return source.mapInArrow(met, _with_fields(df.select(*kept), [("dot", DoubleType())]))


def _with_fields(df: DataFrame, more: list[tuple[str, DataType]]) -> StructType:
    """The columns of ``df`` and some more."""
    return reduce(lambda s, f: s.add(*f), more, StructType(list(df.schema.fields)))


def retrieve_by_source(queries: DataFrame, items: DataFrame, scope: str, most: dict[str, int]) -> DataFrame:
    """``q, source, d, created_session, score, rank``: of each source the best items of the query's scope that are older than it.

    ``queries`` have ``id, created_session, text`` and the scope, ``items`` the same and ``source``. Each source
    gives as many as ``most`` says, or all it has; ties go to the later session, then to the greater id.
    A scope (a dialogue, a user) is small, and its queries and items meet by an equi-join.
    """
    q = counted_words(queries.select(scope, F.col("id").alias("q"), F.col("created_session").alias("at"), "text"), "text")
    i = counted_words(items.select(scope, F.col("id").alias("d"), "source", "created_session", "text"), "text").withColumnsRenamed({"words": "w", "counts": "c", "norm": "n"})
    met = dots(q.join(i, scope).where(F.col("created_session") < F.col("at")), ("words", "counts"), ("w", "c"))
    score = F.round(F.coalesce(F.try_divide("dot", F.col("norm") * F.col("n")), F.lit(0.0)), 9)
    r = F.row_number().over(W.partitionBy("q", "source").orderBy(F.col("score").desc(), F.col("created_session").desc(), F.col("d").desc()))
    ranked = met.select("q", "source", "d", "created_session", score.alias("score")).withColumn("rank", r.cast("long"))
    limit = F.create_map(*[x for s, n in most.items() for x in (F.lit(s), F.lit(n))])
    return ranked.where(F.col("rank") <= limit[F.col("source")])
