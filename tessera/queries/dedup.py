"""Overlap between texts, retrieval, sampling, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import sampling, similarity
from tessera.queries.panel import rounded
from tessera.queries.registry import Registry
from tessera.plans.audit import UNIT_QUOTAS, UNITS_SQL, unit_conditions, unit_strata
from tessera.session import durable, table

Q = Registry()

_FORM = "array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9'']+'), ' ')"
_GRAMS = """SELECT DISTINCT id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i
    FROM (SELECT {id} AS id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9'']+') AS t FROM {table}) WHERE len(t) > 0)"""


@Q.query(f"""
    WITH RECURSIVE f AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5({_FORM})) AS rep, count(*) OVER (PARTITION BY md5({_FORM})) AS size, {_FORM} <> '' AS has FROM documents),
    g AS ({_GRAMS.format(id='doc_id', table='(SELECT * FROM documents WHERE doc_id IN (SELECT rep FROM f))')}),
    n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
    e AS (SELECT a, b, k / (x.n + y.n - k) AS j FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k / (x.n + y.n - k) >= 0.88),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY 1),
    s AS (SELECT DISTINCT rep, size FROM f),
    l AS (SELECT a, sum(size) AS outer_links, max(j) AS best FROM e JOIN s ON s.rep = e.b GROUP BY 1)
    SELECT f.id AS doc_id, CASE WHEN has THEN coalesce(c.component, f.rep) ELSE f.id END AS component,
           (CASE WHEN has THEN size - 1 ELSE 0 END + coalesce(outer_links, 0))::BIGINT AS n_links, round(CASE WHEN has AND size > 1 THEN 1.0 ELSE l.best END, 6) AS best
    FROM f LEFT JOIN c ON c.a = f.rep LEFT JOIN l ON l.a = f.rep
""")
def overlap_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(similarity.overlap_classes(table(spark, d, "documents"), "doc_id", "text"))


@Q.query(f"""
    WITH g AS ({_GRAMS.format(id='doc_id', table='documents')}), h AS ({_GRAMS.format(id='item_id', table='benchmark')}), n AS (SELECT id, count(*) AS n FROM h GROUP BY 1)
    SELECT a, b, round(k / n, 6) AS contained FROM (SELECT g.id AS a, h.id AS b, count(*) AS k FROM g JOIN h USING (s) GROUP BY 1, 2) JOIN n ON n.id = b WHERE k / n >= 0.8
""")
def benchmark_containment(spark: SparkSession, d: str) -> DataFrame:
    left = text.exploded_shingles(table(spark, d, "documents"), "doc_id", "text")
    right = durable(text.exploded_shingles(table(spark, d, "benchmark"), "item_id", "text"))
    return rounded(similarity.containment(left, right, 0.8))


_TF = "SELECT id, term, count(*) AS tf FROM (SELECT {id} AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9'']+')) AS term FROM {table}) GROUP BY 1, 2"
_SCORES = f"""q AS ({_TF.format(id='conv_id * 100 + turn', table="(SELECT * FROM conversations WHERE role = 'user')")}), i AS ({_TF.format(id='item_id', table='benchmark')}),
    qn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM q GROUP BY 1), dn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM i GROUP BY 1),
    sc AS (SELECT q.id AS q, i.id AS d, round(sum(q.tf * i.tf) / (any_value(qn.n) * any_value(dn.n)), 9) AS score FROM q JOIN i USING (term) JOIN qn ON qn.id = q.id JOIN dn ON dn.id = i.id GROUP BY 1, 2)"""


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'").withColumn("q", F.col("conv_id") * 100 + F.col("turn"))
    return similarity.lexical_scores(similarity.term_counts(turns, "q", "text"), similarity.term_counts(table(spark, d, "benchmark"), "item_id", "text"))


@Q.query(f"""
    WITH {_SCORES}, u AS (SELECT conv_id * 100 + turn AS q FROM conversations WHERE role = 'user'),
    a AS (SELECT u.q, b.item_id AS d, coalesce(sc.score, 0) AS score FROM u CROSS JOIN benchmark b LEFT JOIN sc ON sc.q = u.q AND sc.d = b.item_id)
    SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d DESC) AS rank FROM a QUALIFY rank <= 3
""")
def retrieval_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn gets three items, also where it shares a term with fewer."""
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return similarity.retrieve(turns, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 3)


@Q.query("""
    WITH t AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'MP' WHEN 'system' THEN 'MS' ELSE 'ME' END AS source,
                      regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9'']+') AS w FROM conversations),
    n AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(w) AS term FROM t) GROUP BY 1, 2, 3),
    l AS (SELECT conv_id, turn, sqrt(sum(tf * tf)) AS norm FROM n GROUP BY 1, 2),
    k AS (SELECT a.conv_id, a.turn AS q, b.turn AS d, sum(a.tf * b.tf) AS dot FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.term = b.term AND b.turn < a.turn GROUP BY 1, 2, 3),
    s AS (SELECT x.conv_id, x.turn, y.source, y.turn AS item, round(coalesce(k.dot / (lx.norm * ly.norm), 0), 9) AS score
          FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn < x.turn AND x.role = 'user' LEFT JOIN k ON k.conv_id = x.conv_id AND k.q = x.turn AND k.d = y.turn
          LEFT JOIN l lx ON lx.conv_id = x.conv_id AND lx.turn = x.turn LEFT JOIN l ly ON ly.conv_id = y.conv_id AND ly.turn = y.turn)
    SELECT conv_id, turn, source, item, score, row_number() OVER (PARTITION BY conv_id, turn, source ORDER BY score DESC, item DESC) AS rank FROM s
    QUALIFY rank <= CASE source WHEN 'ME' THEN 3 ELSE 2 END
""")
def memory_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """For each user turn the best two or three earlier turns of each source."""
    from tessera.plans.states import SOURCE_OF

    names = F.create_map(*[x for r, s in SOURCE_OF.items() for x in (F.lit(r), F.lit(s))])
    t = table(spark, d, "conversations").select("conv_id", F.struct("conv_id", "turn").alias("id"), F.col("turn").alias("created_session"), "role", "text", names[F.col("role")].alias("source"))
    got = similarity.retrieve_by_source(t.where("role = 'user'"), t, "conv_id", {"MP": 2, "MS": 2, "ME": 3})
    return got.select("q.conv_id", "q.turn", "source", F.col("created_session").alias("item"), "score", "rank")


@Q.query(f"WITH {_SCORES}, m AS (SELECT q, max(score) AS confidence FROM sc GROUP BY 1) SELECT conv_id * 100 + turn AS q, coalesce(confidence, 0) AS confidence FROM conversations LEFT JOIN m ON q = conv_id * 100 + turn WHERE role = 'user'")
def retrieval_confidence(spark: SparkSession, d: str) -> DataFrame:
    best = _retrieved(spark, d).groupBy("q").agg(F.max(F.round("score", 9)).alias("confidence"))
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("q"))
    return turns.join(best, "q", "left").fillna(0.0, ["confidence"])


@Q.query("""SELECT doc_id, source FROM documents ORDER BY substr(sha256('11' || chr(31) || doc_id), 1, 16), doc_id LIMIT 50""")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_sample(table(spark, d, "documents").select("doc_id", "source"), 50, F.lit(11), "doc_id")


@Q.query("""
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('3' || chr(31) || doc_id), 1, 16), doc_id) AS r FROM documents),
    s AS (SELECT lang, row_number() OVER (ORDER BY lang) AS k, count(*) OVER () AS g FROM (SELECT DISTINCT lang FROM documents))
    SELECT doc_id, r.lang FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang WHERE r <= 42 // g + CASE WHEN k = g THEN 42 % g ELSE 0 END
""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", 42, F.lit(3), "doc_id")


@Q.query("""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
    SELECT doc_id FROM r WHERE r IN (SELECT i * n // 40 FROM range(40) t(i), (SELECT count(*) AS n FROM documents))
""")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.systematic_sample(table(spark, d, "documents").select("doc_id"), 40, "doc_id")


@Q.query("""
    WITH p AS (SELECT doc_id, lang, source, substr(sha256('9' || chr(31) || doc_id), 1, 16) AS h FROM documents),
    a AS (SELECT doc_id, 0 AS pass, lang AS g FROM p WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) = 1
          UNION ALL SELECT doc_id, 1, source FROM p WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY h, doc_id) = 1
          UNION ALL SELECT doc_id, 2, h FROM p),
    b AS (SELECT doc_id, min((pass, g)) AS m FROM a GROUP BY 1)
    SELECT doc_id FROM b ORDER BY m, doc_id LIMIT 30
""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, d, "documents"), "doc_id", ["lang", "source"], 30, F.lit(9)).select("doc_id")


@Q.query("""
    SELECT conv_id, turn, substr(sha256('b' || chr(31) || conv_id || chr(31) || turn), 1, 12) AS pair_code, ('0x' || substr(sha256('s' || chr(31) || conv_id || chr(31) || turn), 1, 1))::INT % 2 = 1 AS swap,
           row_number() OVER (ORDER BY substr(sha256('b' || chr(31) || conv_id || chr(31) || turn), 1, 12)) AS position FROM conversations QUALIFY position <= 60
""")
def blinded_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sampling.blinded(table(spark, d, "conversations").select("conv_id", "turn"), 60, ["conv_id", "turn"])


@Q.query("""
    WITH RECURSIVE s AS (SELECT user_id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, user_id) AS i FROM events GROUP BY 1),
    f AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0::BIGINT AS fold
          UNION ALL SELECT i, [CASE WHEN j = pos THEN loads[j] + size ELSE loads[j] END FOR j IN range(1, 6)], pos - 1
          FROM (SELECT s.i, s.size, f.loads, list_position(f.loads, list_min(f.loads))::BIGINT AS pos FROM f JOIN s ON s.i = f.i + 1))
    SELECT user_id, size, fold FROM s JOIN f USING (i)
""")
def grouped_folds(spark: SparkSession, d: str) -> DataFrame:
    """Groups go, largest first, to the lightest of five folds."""
    return sampling.grouped_folds(table(spark, d, "events"), "user_id", 5)


def plan_sql(quotas: dict[str, int], total: int, running: bool) -> str:
    """Common tables ``picks(k, v, s, p, turn, seq)`` and ``covers(k, covered)`` of a greedy plan over ``cand(k, v, s, p)``: a table for each search."""
    out, before, lists = ["g0 AS (SELECT k, v, s, p, 0 AS turn, 0 AS seq FROM cand WHERE false)"], "g0", []
    for turn in (1, 2):
        for name, quota in quotas.items():
            at = len(lists)
            fresh = f"AND v NOT IN (SELECT v FROM {before}) QUALIFY row_number() OVER (PARTITION BY v ORDER BY p DESC, k) = 1" if turn == 1 else ""
            got = f"(SELECT count(*) FROM {before} WHERE s = '{name}')" if turn == 2 else "0"
            out.append(f"n{at} AS MATERIALIZED (SELECT greatest(0, least({quota} - {got}, {total} - (SELECT count(*) FROM {before}))) AS n)")
            out.append(f"""t{at} AS MATERIALIZED (SELECT k, v, s, p, {turn} AS turn, {at} AS seq FROM (SELECT *, row_number() OVER (ORDER BY p DESC, k) AS r FROM
                (SELECT * FROM cand WHERE s = '{name}' AND k NOT IN (SELECT k FROM {before}) {fresh})) WHERE r <= (SELECT n FROM n{at}))""")
            out.append(f"g{at + 1} AS MATERIALIZED (SELECT * FROM {before} UNION ALL SELECT * FROM t{at})")
            lists.append(f"""SELECT {at} AS seq, '{name}' AS s, n > (SELECT count(*) FROM t{at}) AS whole, (SELECT min(p) FROM t{at}) AS ep,
                (SELECT max(k) FROM t{at} WHERE p = (SELECT min(p) FROM t{at})) AS ek FROM n{at} WHERE n > 0""")
            before = f"g{at + 1}"
    at = len(lists)
    place = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(quotas))
    step = "+ row_number() OVER (PARTITION BY v ORDER BY p DESC, k) - 1" if running else ""
    fill = "" if running else f"""UNION SELECT c.k, c.s FROM cand c JOIN picks USING (k) JOIN uses u ON u.v = c.v
            WHERE {total} > (SELECT count(*) FROM {before}) AND ({total} > (SELECT count(*) FROM picks) OR (u.n, -c.p, c.k) <= (SELECT max((n, -p, k)) FROM picks JOIN uses USING (v) WHERE seq = {at}))"""
    return ",\n".join(out) + f""",
        uses AS MATERIALIZED (SELECT v, count(*) FILTER (turn > 0) AS n FROM (SELECT v, turn FROM {before} UNION ALL SELECT v, 0 FROM cand) GROUP BY 1),
        rest AS (SELECT c.*, n {step} AS n FROM (SELECT * FROM cand WHERE k NOT IN (SELECT k FROM {before})
                 QUALIFY row_number() OVER (PARTITION BY k ORDER BY p DESC, CASE s {place} END) = 1) c JOIN uses USING (v)),
        picks AS MATERIALIZED (SELECT * FROM {before} UNION ALL SELECT k, v, s, p, 3, {at} FROM (SELECT *, row_number() OVER (ORDER BY n, p DESC, k) AS r FROM rest)
                 WHERE r <= {total} - (SELECT count(*) FROM {before})),
        lists AS ({" UNION ALL ".join(lists)}),
        covers AS (SELECT k, string_agg(s, ',' ORDER BY s) AS covered FROM (SELECT k, s FROM picks
            UNION SELECT c.k, c.s FROM cand c JOIN picks USING (k) JOIN lists l ON l.s = c.s AND l.seq >= picks.seq AND (whole OR c.p > ep OR c.p = ep AND c.k <= ek) {fill}) GROUP BY 1)"""


_EACH = {s: 4 for s in ("click", "error", "purchase", "signup", "view")}


@Q.query(f"""
    WITH cand AS (SELECT event_id AS k, user_id AS v, event_type AS s, value AS p FROM events), {plan_sql(_EACH, 30, running=True)}
    SELECT k AS event_id, v AS scenario, s AS stratum, turn, covered FROM picks JOIN covers USING (k)
""")
def strata_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each stratum's best items, of fresh scenarios first; then the least used scenarios fill the plan."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("scenario"), F.col("event_type").alias("stratum"), F.col("value").alias("priority"))
    return sampling.greedy_strata(e, "event_id", "scenario", "stratum", "priority", quota=4, total=30).withColumn("covered", F.concat_ws(",", "covered"))


@Q.query(f"""
    WITH {UNITS_SQL}, cand AS (SELECT unit_id AS k, user_id AS v, stratum AS s, priority AS p FROM unit_strata), {plan_sql(UNIT_QUOTAS, 50, running=False)}
    SELECT k AS unit_id, v AS user_id, s AS stratum, turn, covered, condition, tokens, overall
    FROM picks JOIN covers USING (k) JOIN unit_conditions ON unit_id = k
""")
def balanced_plan(spark: SparkSession, d: str) -> DataFrame:
    """50 units in four overlapping strata (20, 15, 10, 5), every condition on the same units."""
    facts = unit_conditions(spark, d)
    seats = unit_strata(facts)
    plan = sampling.greedy_strata(seats, "unit_id", "user_id", "stratum", "priority", UNIT_QUOTAS, total=50, counts="before")
    return plan.withColumn("covered", F.concat_ws(",", "covered")).join(facts.drop("user_id"), "unit_id")


@Q.query("""
    WITH a AS (SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')), b AS (SELECT doc_id, lang FROM documents WHERE source < 'src5')
    SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)
    UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))
""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = docs.where("lang in ('en', 'de')").select("doc_id", "lang")
    b = docs.where("source < 'src5'").select("doc_id", "lang")
    parts = {"intersect": a.intersect(b), "except": a.exceptAll(b), "union": a.union(b).distinct(), "union all": a.union(b), "symmetric": a.exceptAll(b).union(b.exceptAll(a))}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@Q.query(f"""
    SELECT doc_id, source, lang FROM documents WHERE {_FORM} <> '' QUALIFY row_number() OVER (PARTITION BY source, md5({_FORM}) ORDER BY doc_id) = 1
""")
def first_variants(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.sequence import keep_first

    docs = table(spark, d, "documents").select("doc_id", "source", "lang", text.normalize_for_hash(F.col("text")).alias("form")).where("form <> ''")
    return keep_first(docs.withColumn("form", F.md5("form")), ["source", "form"], ["doc_id"]).select("doc_id", "source", "lang")


@Q.query("""
    WITH t AS (SELECT conv_id, turn, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS seeker,
                      coalesce(array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), chr(10)), '') AS context, role
               FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT *, array_to_string(regexp_extract_all(lower(context), '[A-Za-z0-9'']+'), ' ') AS cf, array_to_string(regexp_extract_all(lower(text), '[A-Za-z0-9'']+'), ' ') AS rf FROM t WHERE role = 'assistant' AND seeker IS NOT NULL)
    SELECT 'strat_' || substr(sha256(conv_id || chr(31) || turn), 1, 16) AS strategy_id, conv_id, turn, md5(context) AS context, md5(seeker) AS seeker FROM k
    WHERE ('0x' || substr(sha256('17' || chr(31) || conv_id), 1, 12))::BIGINT / 281474976710656.0 < 0.70
    QUALIFY row_number() OVER (PARTITION BY md5(cf), md5(rf) ORDER BY conv_id, turn) = 1
""")
def strategy_bank(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.bank import strategy_bank as build

    return build(table(spark, d, "conversations")).select("strategy_id", "conv_id", "turn", F.md5("context").alias("context"), F.md5("seeker").alias("seeker"))


@Q.query("""SELECT lang, source, count(*) AS n FROM (SELECT lang, source, CASE WHEN ('0x' || substr(sha256('17' || chr(31) || doc_id), 1, 12))::BIGINT / 281474976710656.0 < 0.70 THEN 'train' END AS s FROM documents) WHERE s = 'train' GROUP BY 1, 2""")
def training_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(ids.split_of(F.lit(17), "doc_id") == "train")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
