"""A corpus from ``documents``: languages, exact copies, near copies, benchmark passages, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contaminated
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.language_id import identify_languages
from tessera.llm.mixing import mix_sources
from tessera.llm.simhash import near_duplicates
from tessera.llm.text import ascii_lower, id_slice
from tessera.session import durable, prepare, removed, stored, table

#: Most keys of dropped rows that are broadcast, at some 60 bytes each; beyond that the join is shuffled.
BROADCAST_KEYS = 500_000
#: Name of a row's key while a stage decides on it.
KEY = "key of the row"


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``KEY`` is in ``dropped``."""
    dropped = durable(dropped.distinct())
    few = dropped.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(dropped) if few else dropped, KEY, "left_anti").drop(KEY)


def _keyed(docs: DataFrame) -> DataFrame:
    """A key of id and text, so that rows of the same id are told apart."""
    return docs.withColumn(KEY, F.struct("doc_id", F.xxhash64("text").alias("h")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language: null, without a letter, or of no language with a posterior of one half.

    Equal texts are decided alike, repeated rows all stay or all go, and languages that tie at one half
    go to the first by name. Without rows that name a language nothing is kept; an empty table stays
    empty. Texts of any length are read whole; all columns pass through, whatever their names.
    """
    prepare(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c: n for n, c in zip(names, docs.columns, strict=True)}
    found = identify_languages(
        docs.toDF(*names),
        ~id_slice(place["doc_id"], 4, 2),
        id_col=place["doc_id"],
        text_col=place["text"],
        lang_col=place["lang"],
        keep=[n for n in names if n != place["doc_id"]],
    )
    return found.where("lang_pred <> 'und' and score >= 0.5").select(*names).toDF(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the largest doc_id stays; of repeated rows, one.

    Null counts as empty, a null doc_id as smaller than any other. An empty table stays empty; texts of
    any length are taken whole; all columns pass through, whatever their names.
    """
    rows = durable(exact_duplicates(docs, digest=True).select("doc_id", "text_sha256", "kept"))
    key = F.struct("doc_id", F.col("text_sha256").alias("h")).alias(KEY)
    each = rows.groupBy(key).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    left = _without(docs.withColumn(KEY, F.struct("doc_id", sha.alias("h"))), each.where("not kept").select(KEY))
    if each.where("kept and n > 1").isEmpty():
        return left
    return left.withColumn(KEY, sha).dropDuplicates(["doc_id", KEY]).drop(KEY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8): the smallest doc_id; of repeated rows, one.

    Null, empty and blank texts have no shingles and are copies of each other; a null doc_id is smaller
    than any other, and of rows of one doc_id the text's hash decides. An empty table stays empty; texts
    of any length are read whole; all columns pass through, whatever their names.
    """
    keyed = _keyed(docs)
    each = durable(near_duplicates(keyed, id_col=KEY).groupBy(KEY).agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    left = _without(keyed, each.where("not kept").select(KEY))
    if each.where("kept and n > 1").isEmpty():
        return left
    return _keyed(left).dropDuplicates([KEY]).drop(KEY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    Null, empty and wordless texts hold none and stay, as do all where the benchmark is empty; repeated
    rows all stay or all go. An empty table stays empty; texts of any length are read whole; all columns
    pass through, whatever their names.
    """
    keyed = _keyed(docs)
    return _without(keyed, contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY).select(KEY))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of each document that is left.

    Null texts have none; a null source is one of its own; rows that tie are ordered by size, and repeated
    rows are interchangeable. An empty table gives an empty result; other columns are ignored.
    """
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: SQL can express neither the language model nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            removed(spark, before)
        before = path
    return docs
