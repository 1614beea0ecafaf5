"""Joint sparse vectors of a state and an action: dense columns, text opened by the action, and fitted bounds carried along.

A vector is a struct of ``indices`` and ``values``, ordered and without zeros. Its parts are column
expressions, which are laid out in Arrow batches; what a space carries from its fit (terms, caps, bounds, medians) is bounded by the number
of columns, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from tessera.functions.numbers import cosine
from tessera.operators.actions import ACTIONS, MEMORY, SOURCES, STRATEGIES, allowed_actions
from tessera.operators.features import char_gram_hashes, hashed_fingerprint, term_counts, vocabulary
from tessera.operators.keys import CheckFailed
from tessera.operators.sampling import quantiles_by
from tessera.session import durable, prepare

#: The modes, and which of text, inventory metadata and catalog each has.
MODES = {
    "full": (True, True, True),
    "text_only": (True, False, False),
    "metadata_only": (False, True, False),
    "text_metadata": (True, True, False),
    "text_metadata_stable": (True, True, False),
    "catalog_only": (False, False, True),
}
FIELDS = ("count", "newest", "oldest", "tokens")
#: Most items that are taken from each source.
TAKEN = {"MP": 2, "MS": 2, "ME": 3}
ENTRY = "array<struct<i: int, v: double>>"


def with_action(rows: DataFrame) -> DataFrame:
    """Add ``_mask`` and ``_rs`` of ``action_id``; fails where an action is not one of the sixteen."""
    masks = F.create_map(*[x for m, code in MEMORY.items() for x in (F.lit(code), F.lit(m))])
    known = F.col("action_id").isin(*ACTIONS)
    checked = F.when(known, F.col("action_id")).otherwise(F.raise_error(F.concat(F.lit("no such action: "), F.coalesce("action_id", F.lit("null")))))
    return rows.withColumn("_mask", masks[F.split_part(checked, F.lit("+"), F.lit(1))]).withColumn("_rs", (F.split_part("action_id", F.lit("+"), F.lit(2)) == STRATEGIES[1]).cast("double"))


def legal_rows(states: DataFrame, available: str = "available") -> DataFrame:
    """Each state with each of its legal actions."""
    return states.withColumn("action_id", F.explode(allowed_actions(F.col(available))))


def chosen(source: str) -> Column:
    return (F.col("_mask").bitwiseAND(F.lit(SOURCES[source])) != 0).cast("double")


def n_sources() -> Column:
    return F.bit_count("_mask").cast("double")


def shifted(entries: Column, by: int) -> Column:
    return F.transform(entries, lambda e: F.struct((e["i"] + by).cast("int").alias("i"), e["v"].alias("v")))


def entries_of(dense: Column) -> Column:
    """Entries of an array of numbers that are not zero."""
    return F.filter(F.transform(dense, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0)


def _dense(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column ``k``, arrays of one length, as a matrix, and which of its values are null."""
    flat = batch.column(k).flatten()
    width = len(flat) // max(1, batch.num_rows)
    shape = (batch.num_rows, width)
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(shape), flat.is_null().to_numpy(zero_copy_only=False).reshape(shape)


def column_ranges(rows: DataFrame, dense: Column) -> tuple[list[float], list[float]]:
    """Least and greatest value of each place of an array of numbers: one row of a task's batches for each place."""
    prepare(rows.sparkSession)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = known = None
        for batch in batches:
            if batch.num_rows:
                d, null = _dense(batch, 0)
                low, high, some = np.fmin.reduce(np.where(null, np.inf, d)), np.maximum.reduce(np.where(null, -np.inf, d)), ~null.all(axis=0)
                lo, hi, known = (low, high, some) if lo is None else (np.fmin(lo, low), np.maximum(hi, high), known | some)
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lo))), pa.array(lo, mask=~known), pa.array(hi, mask=~known)], ["i", "lo", "hi"])

    found = rows.select(dense.alias("d")).mapInArrow(ends, "i bigint, lo double, hi double").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    got = sorted(found.collect())
    return [r.lo for r in got], [r.hi for r in got]


def laid_out(rows: DataFrame, key: str, dense: Column, text: Column | None = None, at: int = 0, gates_at: int = 0, width: int = 0, limits: tuple[Sequence[float], Sequence[float]] | None = None) -> DataFrame:
    """``key, action_id, x`` of rows with ``_mask`` and ``_rs``: ``text`` before ``at`` if there is room, ``dense`` from ``at`` on, and ``text`` again from ``gates_at`` on, ``width`` columns for each gate that the action opens.

    Gates are the three sources and the strategy. Dense values are cut to ``limits`` (a null is the lower one); zeros and nulls are left out.
    """
    prepare(rows.sparkSession)
    kept = rows.select(key, "action_id")
    schema = StructType(list(kept.schema.fields)).add("x", StructType().add("indices", ArrayType(IntegerType())).add("values", ArrayType(DoubleType())))
    names = schema.names
    bits, ends = list(SOURCES.values()), None if limits is None else tuple(np.array(x, float) for x in limits)
    has_text = text is not None

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            d, null = _dense(batch, 4)
            if ends is None:
                d[null] = 0
            else:
                d = np.fmin(np.maximum(np.where(null, ends[0], d), ends[0]), ends[1])
            row, col = np.nonzero(d)
            parts = [(row, col + at, d[row, col])]
            if has_text:
                lists = batch.column(5)
                flat = lists.flatten()
                i, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("i", "v"))
                row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                if at:
                    parts.insert(0, (row, i, v))
                mask, strategy = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
                for k, gate in enumerate([*((mask & bit) != 0 for bit in bits), strategy != 0]):
                    some = gate[row]
                    parts.append((row[some], i[some] + (gates_at + k * width), v[some]))
            row, col, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(row, kind="stable")
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
            x = [pa.ListArray.from_arrays(cuts, pa.array(a)) for a in (col[order].astype(np.int32), v[order])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.StructArray.from_arrays(x, ["indices", "values"])], names)

    return rows.select(key, "action_id", "_mask", "_rs", dense.alias("_d"), *([text.alias("_t")] if has_text else [])).mapInArrow(laid, schema)


def numbers(values: Sequence[float]) -> Column:
    """A constant array: one literal, which Spark folds, whatever its length."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>") if values else F.array().cast("array<double>")


@dataclass
class JointSpace:
    """Columns of one of the ``MODES``, fitted on training states.

    States have ``key``, ``text``, ``session_index``, ``available`` (a mask) and for each source
    ``{S}_available``, ``_count``, ``_newest``, ``_oldest``, ``_tokens`` and ``_catalog`` (an array).
    The text's own catalog, to which a source's is compared, has as many hashed places as the longest one.
    Order: for each source whether it is read, its metadata, its catalog's similarity to the text; the
    strategy and the number of sources; the session; catalogs and the read ones; the text under each gate.
    """

    mode: str
    key: str
    terms: list[tuple[str, float]] = field(default_factory=list)
    caps: dict[str, float] = field(default_factory=dict)
    catalog: int = 0
    low: list[float] = field(default_factory=list)
    high: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, states: DataFrame, key: str, mode: str = "full", max_terms: int = 2048) -> JointSpace:
        """Learn the terms, the caps of ``text_metadata_stable``, and the range of each dense column over all legal actions."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        n = states.count()
        if not n:
            raise CheckFailed("no states to fit on")
        text, _, catalog = MODES[mode]
        space = cls(mode, key)
        if text:
            found = vocabulary(term_counts(states, key, "text"), max_terms, 2 if n > 1 else 1)
            idf = F.log((1 + F.lit(n)) / (1 + F.col("_df"))) + 1
            space.terms = sorted((r.term, r.idf) for r in found.select("term", idf.alias("idf")).collect())
        if mode == "text_metadata_stable":
            names = ["session_index", *[f"{s}_{f}" for s in SOURCES for f in FIELDS]]
            space.caps = states.agg(*[F.coalesce(F.max(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in names]).first().asDict()
        if catalog:
            space.catalog = states.agg(F.max(F.greatest(*[F.size(f"{s}_catalog") for s in SOURCES]))).first()[0] or 0
        space.low, space.high = column_ranges(with_action(legal_rows(space.prepared(states))), space.dense())
        return space

    @property
    def size(self) -> int:
        return len(self.low) + len(self.terms) * (len(SOURCES) + 1)

    def number(self, name: str) -> Column:
        x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return F.log1p(F.least(x, F.lit(self.caps[name])) if name in self.caps else x)

    def dense(self) -> Column:
        """The dense columns of a row with ``_mask``, ``_rs`` and, where the mode has catalogs, ``_query``."""
        _, metadata, catalog = MODES[self.mode]
        out: list[Column] = []
        for s in SOURCES:
            out.append(chosen(s))
            if metadata:
                count, tokens = self.number(f"{s}_count"), self.number(f"{s}_tokens")
                out += [F.col(f"{s}_available").cast("double"), count, self.number(f"{s}_newest"), self.number(f"{s}_oldest"), tokens, chosen(s) * count, chosen(s) * tokens]
            if catalog:
                out += [F.col(f"_near_{s}"), chosen(s) * F.col(f"_near_{s}")]
        out += [F.col("_rs"), n_sources(), n_sources() * n_sources()]
        if metadata:
            out.append(self.number("session_index"))
        parts = [F.array(*out)]
        for s in SOURCES if catalog else ():
            whole = F.slice(F.concat(F.col(f"{s}_catalog").cast("array<double>"), F.array_repeat(F.lit(0.0), self.catalog)), 1, self.catalog)
            read = chosen(s)
            parts += [whole, F.when(read != 0, whole).otherwise(F.array_repeat(F.lit(0.0), self.catalog))]
        return F.concat(*parts)

    def prepared(self, states: DataFrame) -> DataFrame:
        """Add each state's text entries and its catalogs' similarity to the text: joins by key of one row each."""
        text, _, catalog = MODES[self.mode]
        if text:
            rows = [(t, i, idf) for i, (t, idf) in enumerate(self.terms)]
            known = F.broadcast(states.sparkSession.createDataFrame(rows, "term string, i int, idf double"))
            x = term_counts(states, self.key, "text").join(known, "term").withColumn("x", (1 + F.log("n")) * F.col("idf"))
            x = x.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("e"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
            unit = F.transform("e", lambda e: F.struct(e["i"].alias("i"), (e["x"] / F.col("norm")).alias("v")))
            states = states.join(x.select(self.key, unit.alias("_text")), self.key, "left").withColumn("_text", F.coalesce("_text", F.array().cast(ENTRY)))
        if catalog:
            states = states.join(hashed_fingerprint(states, self.key, "text", max(1, self.catalog)).withColumnRenamed("vector", "_query"), self.key)
            near = {f"_near_{s}": F.coalesce(cosine(F.col("_query"), F.transform(f"{s}_catalog", lambda v: v.cast("double"))), F.lit(0.0)) for s in SOURCES}
            states = states.withColumns(near)
        return states

    def transform(self, rows: DataFrame, clip: bool = True) -> DataFrame:
        """``key, action_id, x`` of rows of states with ``action_id``; dense columns are cut to the fitted range unless ``clip`` is off."""
        states = self.prepared(rows.drop("action_id").dropDuplicates([self.key])).drop("action_id")
        met = with_action(rows.select(self.key, "action_id").join(states, self.key))
        text = F.col("_text") if MODES[self.mode][0] else None
        return laid_out(met, self.key, self.dense(), text, gates_at=len(self.low), width=len(self.terms), limits=(self.low, self.high) if clip else None)


@dataclass
class RobustSpace:
    """The second schema's columns: hashed words and characters and an embedding, scaled metadata, the action, and the text under each gate.

    States have ``key``, ``text``, ``session_index``, ``available``, ``embedding``, ``strategy_count``,
    ``strategy_tokens`` and for each source ``{S}_available``, ``_count``, ``_newest``, ``_median``,
    ``_oldest``, ``_tokens``, ``_similarity``, ``_stale`` and ``_catalog``.
    """

    key: str
    words: int = 256
    chars: int = 256
    embedding: int = 0
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    band: list[tuple[float, float]] = field(default_factory=list)

    @classmethod
    def fit(cls, states: DataFrame, key: str, words: int = 256, chars: int = 256) -> RobustSpace:
        """Learn medians, interquartile ranges (1 where that is 0) and the 1-99 % band of the metadata."""
        sizes = states.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
        if not sizes.n:
            raise CheckFailed("no states to fit on")
        if sizes.lo != sizes.hi:
            raise CheckFailed(f"embeddings of different lengths: {sizes.lo} to {sizes.hi}")
        space = cls(key, words, chars, max(0, sizes.hi or 0))
        q = quantiles_by(states.select(F.posexplode(space.metadata()).alias("k", "x")), "k", "x", [0.25, 0.5, 0.75, 0.01, 0.99])
        for i in sorted(q):
            a, b, c, lo, hi = q[i]
            space.centre.append(b)
            space.scale.append((c - a) or 1.0)
            space.band.append((lo, hi))
        return space

    @property
    def text_size(self) -> int:
        return self.words + self.chars + self.embedding

    @property
    def size(self) -> int:
        return self.text_size * (len(SOURCES) + 2) + len(self.centre) + 8

    @staticmethod
    def log(name: str) -> Column:
        return F.log1p(F.greatest(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)))

    def metadata(self) -> Column:
        out = [self.log("session_index")]
        for s in SOURCES:
            x = F.col(f"{s}_catalog")
            n = F.greatest(F.size(x), F.lit(1)).cast("double")
            x = F.coalesce(F.transform(x, lambda v: v.cast("double")), F.array().cast("array<double>"))
            mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
            squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
            out.append(F.col(f"{s}_available").cast("double"))
            out += [self.log(f"{s}_{f}") for f in ("count", "newest", "median", "oldest", "tokens")]
            out += [F.coalesce(F.col(f"{s}_{f}").cast("double"), F.lit(0.0)) for f in ("similarity", "stale")]
            out += [F.sqrt(squares), mean, F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))]
        return F.array(*out, self.log("strategy_count"), self.log("strategy_tokens"))

    def action(self) -> Column:
        tokens = F.col("_rs") * F.coalesce(F.col("strategy_tokens").cast("double"), F.lit(0.0))
        for s, most in TAKEN.items():
            count = F.coalesce(F.col(f"{s}_count").cast("double"), F.lit(0.0))
            tokens = tokens + chosen(s) * F.coalesce(F.col(f"{s}_tokens").cast("double"), F.lit(0.0)) / F.greatest(count, F.lit(1.0)) * F.least(count, F.lit(float(most)))
        n = n_sources()
        return F.array(*[chosen(s) for s in SOURCES], F.col("_rs"), n, n * n, F.log1p(F.greatest(tokens, F.lit(0.0))), n + F.col("_rs"))

    def prepared(self, states: DataFrame) -> DataFrame:
        """Add ``_text``: the entries of the hashed words and word pairs, characters and embedding, each of unit length."""
        words = hashed_fingerprint(states, self.key, "text", self.words).select(self.key, entries_of(F.col("vector")).alias("_words"))
        chars = char_gram_hashes(states, self.key, "text", self.chars)
        chars = chars.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct(F.col("bucket").cast("int").alias("i"), F.col("weight").alias("v")))).alias("_chars"))
        met = states.join(words, self.key).join(chars, self.key, "left").withColumn("_chars", F.coalesce("_chars", F.array().cast(ENTRY)))
        x = F.transform("embedding", lambda v: v.cast("double"))
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
        met = met.withColumn("_norm", F.when(norm > 0, norm).otherwise(F.lit(1.0)))
        unit = entries_of(F.transform(x, lambda v: v / F.col("_norm")))
        return met.withColumn("_text", F.concat(F.col("_words"), shifted(F.col("_chars"), self.words), shifted(unit, self.words + self.chars))).drop("_words", "_chars", "_norm")

    def transform(self, rows: DataFrame) -> DataFrame:
        """``key, action_id, x`` of rows of states with ``action_id``; fails on an action that the state's mask does not allow."""
        states = self.prepared(rows.drop("action_id").dropDuplicates([self.key]))
        scaled = F.zip_with(F.zip_with(self.metadata(), numbers(self.centre), lambda v, m: v - m), numbers(self.scale), lambda v, s: v / s)
        states = states.withColumn("_scaled", scaled)
        met = with_action(rows.select(self.key, "action_id").join(states, self.key))
        fine = F.col("_mask").bitwiseAND(F.col("available")) == F.col("_mask")
        met = met.withColumn("_mask", F.when(fine, F.col("_mask")).otherwise(F.raise_error(F.concat(F.lit("action not allowed: "), F.col("action_id")))))
        at = self.text_size
        return laid_out(met, self.key, F.concat("_scaled", self.action()), F.col("_text"), at, at + len(self.centre) + 8, at)


def pair_differences(vectors: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Decided pairs and their mirror images: ``x``, the difference of the two actions' vectors, ``label``, ``weight`` (one half over the key's decided pairs) and ``key``.

    ``pairs`` have ``key, a, b, winner``. A pair's vectors meet by key and action.
    """
    from pyspark.sql import Window as W

    p = pairs.where("winner in ('A', 'B')").withColumn("weight", 0.5 / F.count("*").over(W.partitionBy(key)))
    one = vectors.select(key, F.col("action_id").alias("a"), F.col("x").alias("_x"))
    two = vectors.select(key, F.col("action_id").alias("b"), F.col("x").alias("_y"))
    met = p.join(one, [key, "a"]).join(two, [key, "b"])
    pack = lambda v, s: F.zip_with(F.col(f"{v}.indices"), F.col(f"{v}.values"), lambda i, x: F.struct(i.alias("i"), (s * x).alias("v")))
    met = met.withColumn("_e", merged(pack("_x", F.lit(1.0)), pack("_y", F.lit(-1.0))))
    met = met.withColumn("_s", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    x = F.struct(F.transform("_e", lambda e: e["i"]).alias("indices"), F.transform("_e", lambda e: e["v"] * F.col("_s")).alias("values"))
    return met.select(key, x.alias("x"), ((F.col("winner") == "A") == (F.col("_s") > 0)).cast("int").alias("label"), "weight")


def merged(a: Column, b: Column) -> Column:
    """Sum of two ordered lists of entries: both are sorted together, and neighbours of one column are added."""
    both = F.array_sort(F.concat(a, b))
    added = F.transform(both, lambda e, i: F.struct(e["i"].alias("i"), e["v"].alias("v"), i.alias("at")))
    return F.transform(
        F.array(added),
        lambda s: F.filter(
            F.transform(
                s,
                lambda e: F.struct(
                    e["i"].alias("i"),
                    F.when(F.coalesce(F.get(s, e["at"] - 1)["i"] == e["i"], F.lit(False)), F.lit(0.0)).otherwise(e["v"] + F.coalesce(F.when(F.get(s, e["at"] + 1)["i"] == e["i"], F.get(s, e["at"] + 1)["v"]), F.lit(0.0))).alias("v"),
                ),
            ),
            lambda e: e["v"] != 0,
        ),
    )[0]


def fit_ranker(vectors: DataFrame, pairs: DataFrame, key: str, size: int, c: float = 1.0) -> list[float]:
    """Weights of a pairwise logistic ranker on joint vectors."""
    from tessera.operators.logistic import fit_sparse

    rows = durable(pair_differences(vectors, pairs, key).select("x", "label", "weight"))
    return fit_sparse(rows, size, c=c).tolist()


def dot(x: str, weights: Sequence[float]) -> Column:
    """Score of a vector by constant weights."""
    w = numbers(weights)
    products = F.zip_with(F.col(f"{x}.indices"), F.col(f"{x}.values"), lambda i, v: v * F.get(w, i))
    return F.aggregate(products, F.lit(0.0), lambda a, v: a + v)
