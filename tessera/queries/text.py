"""Normal forms, hashes, tokens and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, numbers, text
from tessera.operators.features import hashed_fingerprint
from tessera.operators.textmetrics import distinct_n
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9'']+')"


@Q.query(f"""
    SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct,
           greatest(1, ceil(length(coalesce(text, '')) / 4))::BIGINT AS estimate,
           md5(array_to_string(t, ' ')) AS hash_form, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS space_form,
           md5(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS text_form
    FROM (SELECT doc_id, text, {_TOK} AS t FROM documents)
""")
def text_profile(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.size(text.tokens(t)).cast("long").alias("n_tokens"),
        F.size(text.token_set(t)).cast("long").alias("n_distinct"),
        text.estimate_tokens(t).alias("estimate"),
        F.md5(text.normalize_for_hash(t)).alias("hash_form"),
        F.md5(text.normalize_space(t)).alias("space_form"),
        F.md5(text.normalize_text(t)).alias("text_form"),
    )


@Q.query("""
    SELECT doc_id, 'doc_' || substr(sha256('seed' || chr(31) || doc_id || chr(31) || coalesce(source, 'None')), 1, 16) AS opaque_id,
           round(('0x' || substr(sha256('17' || chr(31) || doc_id), 1, 12))::BIGINT / 281474976710656.0, 9) AS u,
           CASE WHEN ('0x' || substr(sha256('17' || chr(31) || doc_id), 1, 12))::BIGINT / 281474976710656.0 < 0.70 THEN 'train'
                WHEN ('0x' || substr(sha256('17' || chr(31) || doc_id), 1, 12))::BIGINT / 281474976710656.0 < 0.85 THEN 'validation' ELSE 'test' END AS split
    FROM documents
""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), ids.stable_hex(F.lit("seed"), "doc_id", "source")).alias("opaque_id"),
        F.round(ids.stable_unit(F.lit(17), "doc_id"), 9).alias("u"),
        ids.split_of(F.lit(17), "doc_id").alias("split"),
    )


@Q.query("""
    SELECT conv_id, turn, regexp_matches(lower(text), '\\b(should|could|try|maybe|perhaps|recommend|suggest|advice)\\b') AS advice,
           regexp_matches(lower(text), '\\b(sad|afraid|worried|anxious|alone|hurt|tired|stressed)\\b') AS distress,
           regexp_matches(lower(text), '\\b(feel|feeling|think|believe|remember|realize|understand)\\b') AS reflection, contains(text, '?') AS question,
           CASE WHEN turn <= 2 THEN 'opening' WHEN turn <= 4 THEN 'early' WHEN turn <= 8 THEN 'middle' ELSE 'late' END AS depth,
           CASE WHEN n <= 8 THEN 'short' WHEN n <= 20 THEN 'medium' ELSE 'long' END AS length
    FROM (SELECT *, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM conversations)
""")
def cue_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        *[t.rlike(p).alias(k) for k, p in text.CUES.items()],
        t.contains("?").alias("question"),
        text.depth_bin(F.col("turn")).alias("depth"),
        text.length_bin(t).alias("length"),
    )


@Q.query("""
    SELECT doc_id, CASE WHEN length(text) > 101 THEN substr(text, 1, 50) || ' ... ' || right(text, 51) ELSE text END AS clipped,
           length(text)::BIGINT AS n, length(text) > 101 AS was_clipped,
           CASE WHEN starts_with(lower(s), 'the ') THEN trim(substr(s, 5)) ELSE s END AS stripped
    FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
""")
def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        text.clip_text(t, 101).alias("clipped"),
        F.length(t).cast("long").alias("n"),
        (F.length(t) > 101).alias("was_clipped"),
        text.strip_prefixes(t, ["the "]).alias("stripped"),
    )


@Q.query(f"""
    WITH w AS (SELECT doc_id, {_TOK} AS t FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM w WHERE len(t) > 0))
    SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id
""")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return text.shingle_sets(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.size("shingles").cast("long").alias("n_shingles"))


@Q.query(f"""
    WITH w AS (SELECT lang, {_TOK} AS t FROM documents),
    g AS (SELECT lang, 1 AS n, unnest(t) AS g FROM w
          UNION ALL SELECT lang, 2, array_to_string(t[i:i + 1], ' ') FROM (SELECT lang, t, unnest(range(1, len(t))) AS i FROM w))
    SELECT lang, n::BIGINT AS n, count(*) AS total, count(DISTINCT g) AS uniq, round(count(DISTINCT g) / count(*), 9) AS rate FROM g GROUP BY 1, 2
""")
def distinct_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return distinct_n(table(spark, d, "documents"), "lang", "text", [1, 2])


@Q.query("""
    SELECT event_id, (props->>'k')::BIGINT AS k, coalesce((props->>'missing')::DOUBLE, (props->>'k')::DOUBLE, 0) AS first_of,
           TRY_CAST(event_type AS DOUBLE) AS no_number, coalesce(TRY_CAST(props->>'k' AS DOUBLE) / 100, 0) AS share,
           (regexp_extract('note ' || props::VARCHAR || ' end', '(\\{.*\\})', 1)::JSON->>'k')::BIGINT AS salvaged
    FROM (SELECT event_id, event_type, props::JSON AS props FROM events)
""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    noisy = F.concat(F.lit("note "), F.col("props"), F.lit(" end"))
    salvaged = F.from_json(F.regexp_extract(noisy, r"(?s)(\{.*\})", 1), "k long", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").select(
        "event_id",
        k.cast("long").alias("k"),
        F.coalesce(F.get_json_object("props", "$.missing").cast("double"), k.cast("double"), F.lit(0.0)).alias("first_of"),
        numbers.safe_double(F.col("event_type")).alias("no_number"),
        numbers.as_unit(k, 100).alias("share"),
        salvaged["k"].alias("salvaged"),
    )


@Q.query("""
    SELECT event_id, round(1 / (1 + exp(-greatest(-30, least(30, value - 50)))), 9) AS p, round(ln(1 + value), 9) AS logged,
           round(least(1, greatest(0, value / 80)), 9) AS clipped, round(greatest(0, value - 60) / 60, 9) AS violation,
           round(least(100, greatest(0, value - 1.64 * 7)), 9) AS low, round(least(100, greatest(0, value + 1.64 * 7)), 9) AS high,
           round(.30 * (s - 1) / 4 + .20 * (s - 1) / 4 + .15 * (6 - s - 1) / 4 + .15 * (s - 1) / 4 + .10 * 2 / 4 + .10 * (s - 1) / 4, 9) AS composite
    FROM (SELECT event_id, value, 1 + event_id % 5 AS s FROM events)
""")
def scalar_scores(spark: SparkSession, d: str) -> DataFrame:
    v, s = F.col("value"), 1 + F.col("event_id") % 5
    low, high = numbers.interval(v, F.lit(7.0), 1.64, 0, 100)
    dims = {"empathy": s, "fit": s, "guidance": 6 - s, "restraint": s, "coherence": F.lit(3), "safety": s}
    cols = {
        "p": numbers.sigmoid(v - 50),
        "logged": F.log1p(v),
        "clipped": numbers.clip_unit(v / 80),
        "violation": numbers.violation(v, 60.0),
        "low": low,
        "high": high,
        "composite": numbers.composite_score(dims),
    }
    return table(spark, d, "events").select("event_id", *[F.round(c, 9).alias(k) for k, c in cols.items()])


@Q.query("""
    WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (
                 SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)
    SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS cosine FROM embeddings JOIN c USING (label)
""")
def centroid_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", "label", F.round(numbers.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


FINGERPRINT_SQL = """w AS (SELECT {key} AS id, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9'']+') AS w FROM {rows}),
    g AS (SELECT id, unnest(w) AS t FROM w UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM w)),
    c AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {size} AS i, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2),
    fp AS (SELECT w.id, list_transform(range(0, {size}), lambda i: round(coalesce(m[i] / z, 0), 8)) AS vector FROM w LEFT JOIN (SELECT id, map_from_entries(list((i, n))) AS m, sqrt(sum(n * n)) AS z FROM c GROUP BY 1) USING (id))"""


@Q.query(f"WITH {FINGERPRINT_SQL.format(key='item_id', text='text', rows='benchmark', size=64)} SELECT id AS item_id, vector FROM fp")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of hashed words and word pairs."""
    return hashed_fingerprint(table(spark, d, "benchmark"), "item_id", "text", 64)
