"""The queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contaminated
from tessera.llm.embedding_dedup import close_vectors
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.html_text import extract_text
from tessera.llm.language_id import identify_languages
from tessera.llm.mixing import mix_sources
from tessera.llm.prefix_trie import prefix_trie
from tessera.llm.quality import score_quality
from tessera.llm.secrets import scan_secrets
from tessera.llm.simhash import simhash_components
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.text import id_slice
from tessera.llm.tokens import count_tokens
from tessera.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: ~id_slice(c, 3, 1))
    return scored.select("doc_id", id_slice("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), digest=True)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(table(spark, sf_dir, "documents"), ~id_slice("doc_id", 4, 2))
    return found.select("doc_id", id_slice("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_vectors(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_text": op4_html_text,
    "op5_mix_sources": op5_mix_sources,
    "op6_token_counts": op6_token_counts,
    "op7_decontaminate": op7_decontaminate,
    "op8_secrets": op8_secrets,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op5_mix_sources": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 ('0x' || substr(md5('mix|' || doc_id), 1, 15))::BIGINT AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
                     row_number() OVER (ORDER BY source IS NULL, source) AS r FROM d GROUP BY source),
        w AS (SELECT *, [3, 1, 2][((r - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
        l AS (SELECT *, sum(cap) OVER (ORDER BY source_size / w, r) - cap AS full_before,
                     sum(w) OVER (ORDER BY source_size / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM w),
        f AS (SELECT *, (total - full_before) / w_rest AS level, (total - full_before) / w_rest * w >= cap AS is_full FROM l),
        g AS (SELECT *, (SELECT level FROM f WHERE NOT is_full ORDER BY source_size / w, r LIMIT 1) AS shared FROM f),
        t AS (SELECT source, source_size, round(CASE WHEN is_full THEN cap::DOUBLE ELSE shared * w END, 6) AS target FROM g),
        b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget,
                     CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
        p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
                     (sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY 1),
        g AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT x.doc_id, x.i FROM x JOIN f USING (s) WHERE first < x.doc_id), (SELECT unnest(range(13)) AS k)),
        n AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
        k AS (SELECT n.doc_id, string_agg(word, ' ' ORDER BY n.j) AS kept, count(*) AS n_kept FROM n ANTI JOIN g ON n.doc_id = g.doc_id AND n.j = g.j GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op11_prefix_trie": r"""
        WITH b AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS t FROM conversations WHERE conv_id IS NOT NULL),
        y AS (SELECT c, flatten(list_transform(string_split(t, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))::BIGINT[] AS bits FROM b),
        h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, bits), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM y),
        t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
        r AS (SELECT h.c, 0 AS part, pos, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 AND pos <= h UNION ALL SELECT h.c, 1, pos, role, text FROM h JOIN t ON t.c = h.c AND pos > h),
        p AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM r),
        l AS (SELECT c, list({'role': role, 'text': text} ORDER BY depth) AS l FROM p GROUP BY c),
        n AS (SELECT h.c, l, coalesce(len(l), 0) AS n FROM h LEFT JOIN l USING (c)),
        m AS (SELECT c, depth, n, CASE WHEN depth = 0 THEN [] ELSE l[1:depth] END AS seq FROM (SELECT *, unnest(range(0, n + 1)) AS depth FROM n)),
        g AS (SELECT depth, seq, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = depth), '') AS ends FROM m GROUP BY ALL),
        o AS (SELECT m.c, m.depth, g.conv_id FROM m JOIN g ON m.depth = g.depth AND m.seq IS NOT DISTINCT FROM g.seq),
        a AS (SELECT g.conv_id, g.depth, n_convs, ends, o.conv_id AS parent_conv_id,
                     CASE WHEN g.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(seq[g.depth].text, '[^ 	-]+')) END AS saved
              FROM g LEFT JOIN o ON o.c = g.conv_id AND o.depth = g.depth - 1),
        k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM a WHERE parent_conv_id IS NOT NULL GROUP BY ALL),
        s AS (SELECT o.conv_id, o.depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
              FROM a LEFT JOIN k USING (conv_id, depth) JOIN o ON o.c = a.conv_id AND o.depth <= a.depth GROUP BY ALL)
        SELECT a.conv_id, a.depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
        FROM a JOIN s USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth)
    """,
    "op12_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        f AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.r AS a, b.r AS b FROM f a JOIN f b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.95),
        w AS (SELECT r, r AS t FROM v UNION SELECT w.r, l.b FROM w JOIN l ON w.t = l.a),
        c AS (SELECT w.r, min(v.vec_id) AS component_id FROM w JOIN v ON v.r = w.t GROUP BY w.r),
        n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
    """,
    "op13_hard_negatives": """
        WITH x AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS alike, list_dot_product(a.x, b.x)::BIGINT AS score FROM x a JOIN x b ON a.vec_id % 50 = 0 AND a.r <> b.r),
        p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
              QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
}
