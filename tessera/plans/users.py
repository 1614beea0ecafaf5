"""Users with a profile and past sessions: what a policy may see of them, and what only an evaluator may."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import stable_hex
from tessera.functions.text import normalize_space
from tessera.operators.keys import require_cardinalities
from tessera.sources.rows import read_json_document

USER = (
    "id string, basic_info map<string,string>,"
    " dialog_history array<struct<id: string, timestamp: string, summary: string, dialogue: array<struct<role: string, content: string>>>>,"
    " subsequent_topics array<struct<topic: string, gold_reference: string>>, event_timeline array<string>"
)
#: What a policy may read of a user.
VISIBLE = ("id", "basic_info", "dialog_history")
#: Words in names of fields that no policy may see.
HIDDEN = ("gold", "topic", "timeline", "reference", "answer", "evidence")


def read_users(spark: SparkSession, path: str, users: int, sessions: int, topics: int) -> DataFrame:
    """Users of a file, which must hold exactly so many of them, of their sessions and of their later topics."""
    df = read_json_document(spark, path, USER)
    require_cardinalities({"users": (df, users), "sessions": (df.select(F.explode("dialog_history")), sessions), "topics": (df.select(F.explode("subsequent_topics")), topics)})
    return df


def policy_view(users: DataFrame) -> DataFrame:
    """The columns that a policy may see: what is not named here does not get in."""
    return users.select(*VISIBLE)


def evaluator_view(users: DataFrame) -> DataFrame:
    """The truth that answers are held against."""
    return users.select("id", *[c for c in users.columns if c not in VISIBLE])


def memory_of(users: DataFrame) -> DataFrame:
    """``user_id, memory_id, source, created_session, timestamp, text``: a user's profile fields, session summaries and seeker turns as items.

    Built from ``policy_view`` alone. Sessions count from 1, the profile is of session 0; empty texts make no item.
    """
    u = policy_view(users)
    item = lambda source, key, at, when, text: F.struct(
        F.concat(F.lit("mem_"), stable_hex(F.lit("evo"), F.col("id").cast("string"), F.lit(source), key, n=20)).alias("memory_id"),
        F.lit(source).alias("source"), at.cast("long").alias("created_session"), when.alias("timestamp"), text.alias("text"),
    )
    facts = u.select("id", F.explode("basic_info").alias("k", "v")).where("v <> ''")
    facts = facts.select("id", item("MP", F.col("k"), F.lit(0), F.lit(None).cast("string"), F.concat(F.initcap(F.replace("k", F.lit("_"), F.lit(" "))), F.lit(": "), F.col("v"))).alias("m"))
    key = F.coalesce(F.when(F.col("s_id") != "", F.col("s_id")), F.concat(F.lit("session_"), F.col("i").cast("string")))
    s = u.select("id", F.posexplode("dialog_history").alias("i", "s")).select("id", (F.col("i") + 1).alias("i"), F.col("s.id").alias("s_id"), "s.timestamp", "s.summary", "s.dialogue")
    said = F.filter(F.transform(F.filter("dialogue", lambda t: t["role"] == "seeker"), lambda t: normalize_space(t["content"])), lambda t: t != "")
    when = F.when(F.col("timestamp") != "", F.col("timestamp"))
    items = F.array(item("MS", key, F.col("i"), when, normalize_space(F.col("summary"))), item("ME", key, F.col("i"), when, F.array_join(said, " ")))
    past = s.select("id", F.explode(items).alias("m")).where(F.coalesce(F.col("m.text"), F.lit("")) != "")
    return facts.unionByName(past).select(F.col("id").alias("user_id"), "m.*")


def users_of(turns: DataFrame, per_session: int = 4) -> DataFrame:
    """Dialogues as users: sessions of ``per_session`` turns each, whose first turn is the summary; the last turn is a hidden topic."""
    t = turns.withColumn("s", F.floor(F.col("turn") / per_session)).withColumn("seeker", F.when(F.col("role") == "user", "seeker").otherwise("supporter"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "seeker", "text"))), lambda x: F.struct(x["seeker"].alias("role"), x["text"].alias("content")))
    s = t.groupBy("conv_id", "s").agg(said.alias("dialogue"), F.count("*").alias("n"), F.max("turn").alias("last"))
    session = F.struct(F.concat(F.lit("s"), F.col("s").cast("string")).alias("id"), F.lit("").alias("timestamp"), F.col("dialogue")[0]["content"].alias("summary"), "dialogue")
    u = s.groupBy(F.col("conv_id").cast("string").alias("id")).agg(
        F.map_from_arrays(F.array(F.lit("turn_count"), F.lit("first_role")), F.array(F.sum("n").cast("string"), F.min_by(F.col("dialogue")[0]["role"], "s"))).alias("basic_info"),
        F.transform(F.array_sort(F.collect_list(F.struct("s", session.alias("x")))), lambda r: r["x"]).alias("dialog_history"),
        F.max_by(F.element_at("dialogue", -1)["content"], "last").alias("topic"),
    )
    hidden = F.array(F.struct(F.col("topic"), F.lit("kept back").alias("gold_reference")))
    return u.select("id", "basic_info", "dialog_history", hidden.alias("subsequent_topics"), F.array().cast("array<string>").alias("event_timeline"))
