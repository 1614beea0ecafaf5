"""Operators on small cases: golden values, brute force and properties."""

import itertools
import math
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import ids, numbers, text
from tessera.operators import actions, agreement, features, inference, keys, labels, pairgraph, panel, policy, sampling, sequence, similarity, textmetrics
from tessera.operators.graph import connected_components


def one(df):
    (row,) = df.collect()
    return row


def test_golden_observation_metrics(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (0.5, True), (0.0, True)], "r double, u boolean")
    m = one(labels.observation_metrics(df, "r", "u"))
    assert (m.recall, m.weighted, m.use) == (0.5, pytest.approx(0.6), 0.75)
    assert one(labels.observation_metrics(df.limit(0), "r", "u")).recall == 0.0


def test_golden_win_tie_loss(spark):
    df = spark.createDataFrame([("A",), ("tie",), ("B",), ("other",), (None,)], "l string")
    assert one(panel.win_tie_loss(df, F.col("l"))).score == 0.5
    assert one(panel.win_tie_loss(df.where("l = 'other'"), F.col("l"))).score is None


def test_golden_omission_merge(spark):
    m2 = spark.createDataFrame([("c", "a", 0, 0, 0, 2)], "card string, action string, unused int, exposure int, stale int, appropriate int")
    m2b = spark.createDataFrame([("c", "a", 2, 0)], "card string, action string, severity int, sufficiency int")
    m0 = spark.createDataFrame([], "card string, action string, unsupported int, missed int, appropriate int")
    before = one(labels.memory_labels(m0, m2, m2b.limit(0), ["card", "action"]))
    after = one(labels.memory_labels(m0, m2, m2b, ["card", "action"]))
    assert (before.omission, before.quality, after.omission, after.quality) == (0.0, 1.0, 1.0, 0.0)


def test_golden_actions(spark):
    row = spark.range(1).select(
        actions.fixed_action(7, "RS", F.lit(5)).alias("cut"), actions.fixed_action(7, "R0", F.lit(5)).alias("full"), actions.allowed_actions(F.lit(5)).alias("legal"), actions.allowed_actions(F.lit(0)).alias("least")
    )
    r = one(row)
    assert (r.cut, r.full, len(r.legal), r.least) == ("MPE+RS", "MPE+R0", 8, ["M0+R0", "M0+RS"])
    assert len(set(actions.ACTIONS)) == 16
    parsed = actions.parsed(spark.createDataFrame([("MSE+RS",), ("FULL_HISTORY+RS",)], "action_id string"), "action_id").orderBy("action_id").collect()
    assert parsed[0]["mask"] is None and parsed[1]["mask"] == 6


def test_golden_unblinding(spark):
    votes = spark.createDataFrame([("p", "B")] * 3 + [("q", "A"), ("q", "B")], "item string, label string")
    m = {r.item: r.majority for r in agreement.majority(votes, "item", "label").collect()}
    assert m == {"p": "B", "q": "tie"}
    assert spark.range(1).select(agreement.unblind(F.lit("B"), F.lit(True))).first()[0] == "A"


def test_golden_rotation_visits_every_position(spark):
    df = spark.range(6).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = df.select("v", sequence.balanced_order(F.array(*map(F.lit, "abcdef")), F.col("id"), F.col("v")).alias("o")).collect()
    for v, p in itertools.product((0, 1), range(6)):
        assert {r.o[p] for r in rows if r.v == v} == set("abcdef")


def test_golden_reconciliation(spark):
    want = spark.createDataFrame([(u, c) for u in range(3) for c in "ab"], "u int, c string")
    r = one(keys.reconcile(want, want.where("not (u = 1 and c = 'b')"), ["u", "c"]))
    assert not r.ok and r.missing == 1 and r.extra == 0
    keys.require_reconciled(want, want, ["u", "c"])
    with pytest.raises(keys.CheckFailed):
        keys.require_reconciled(want, want.limit(5), ["u", "c"])
    keys.require_reconciled(want, want.limit(5), ["u", "c"], allow_missing=True)


def test_weights_sum_to_one(spark):
    from tessera.operators.features import group_weights

    df = spark.createDataFrame([("c", a) for a in "abcdefgh"], "card string, action string")
    assert one(group_weights(df, "card").agg(F.sum("weight").alias("s"))).s == pytest.approx(1)
    with pytest.raises(ValueError):
        numbers.composite_score({"empathy": F.lit(1)}, {"empathy": 0.9})


def test_gates_raise(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 2)], "a int, b int")
    assert {r.reason for r in keys.key_violations(df, ["a", "b"]).collect()} == {"null", "duplicate"}
    with pytest.raises(keys.CheckFailed):
        keys.unique_index(df, ["a", "b"])
    bad = keys.rule_violations(df, F.col("b"), {"a is there": F.col("a").isNotNull(), "b small": F.col("b") < 2})
    assert sorted((r.rule, r.key) for r in bad.collect()) == [("a is there", "2"), ("b small", "2")]
    with pytest.raises(keys.CheckFailed):
        keys.require_valid(bad)
    assert keys.schema_fields(df.selectExpr("struct(a as gold_x, b) as s"), ["gold"]) == ["s.gold_x"]


def brute_components(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            for x in (a, b):
                if label[x] != m:
                    label[x], changed = m, True
    return label


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_of_any_graph(spark, edges):
    df = spark.createDataFrame(edges or [(None, 1)], "src int, dst int")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


def test_components_of_a_long_path(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "src int, dst int")
    got = connected_components(df).collect()
    assert len(got) == n and {r.component for r in got} == {0}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=8), min_size=2, max_size=10), st.sampled_from([0.5, 0.75, 1.0]))
def test_similarity_join_loses_no_pair(spark, sets, t):
    rows = [(i, x) for i, s in enumerate(sets) for x in s]
    df = spark.createDataFrame(rows, "id int, shingle int")
    got = {(r.a, r.b) for r in similarity.shingle_pairs(df, None, t).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t}
    assert got == want
    held = {(r.a, r.b) for r in similarity.containment(df, df, t).collect()}
    assert held == {(i, j) for i in range(len(sets)) for j in range(len(sets)) if len(sets[i] & sets[j]) / len(sets[j]) >= t}


def test_shingles_of_a_text_are_not_shuffled(spark):
    """Only ids are; an id that several rows have gets the shingles of all of them."""
    rows = [(1, "a b c d e f"), (1, "b c d e f g"), (2, "A b, c d e f a b c d e"), (3, "a b"), (4, "..."), (5, None), (None, "x"), (None, "X y")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: set(r.shingles) for r in text.shingle_sets(df, "id", "text").collect()}
    assert {i: len(s) for i, s in got.items()} == {1: 3, 2: 6, 3: 1, None: 2}
    assert len(got[1] & got[2]) == 2 and not got[3] & got[2]
    alone = text.exploded_shingles(df.where("id > 1"), "id", "text")
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 7


def test_overlap_classes_count_copies(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    near = " ".join([*base, "more"])
    rows = [(1, " ".join(base)), (2, " ".join(base).upper() + "!"), (3, near), (4, "something else altogether here now"), (5, None), (6, "")]
    got = {r.doc_id: r for r in similarity.overlap_classes(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text").collect()}
    assert {i: (r.component, r.n_links) for i, r in got.items()} == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
    assert got[1].best == 1.0 and got[3].best == pytest.approx(12 / 13)


def near_copies(seed, n=60):
    """Texts of one frequent passage and words of their own, every third near the one before, some with an id that another row has."""
    r = random.Random(seed)
    passage = [f"common{i}" for i in range(30)]
    rows, words = [], []
    for i in range(n):
        words = [w if r.random() > 0.01 else "other" for w in words] if i % 3 == 1 else [f"w{r.randrange(500)}" for _ in range(60)] + passage[: r.randrange(31)]
        rows.append((i if i % 20 else 0, " ".join(words)))
    return rows


def jaccards(rows, width=5):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(i, set()).update(" ".join(w[k : k + width]) for k in range(max(len(w) - width + 1, 1)))
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a != b}


def test_pairs_of_texts_pass_prefixes_only(spark):
    """All pairs of brute force, though only n - ceil(t n) + 1 shingles of a text are dealt, and rare ones first."""
    rows = near_copies(5)
    df = spark.createDataFrame(rows, "id int, text string")
    for t in (0.5, 0.88):
        got = {(r.a, r.b): r.similarity for r in similarity.text_pairs(df, None, "id", "text", t, 5).collect()}
        assert got and got == pytest.approx({p: j for p, j in jaccards(rows).items() if p[0] < p[1] and j >= t})
    sets = text.shingle_sets(df, "id", "text")
    frequent = similarity.frequent_shingles(sets)
    assert len(frequent[0]) > 0
    n = {r.id: len(r.shingles) for r in sets.collect()}
    dealt = similarity.prefixes(sets, 0.88, frequent).collect()
    assert {i: sum(r.id == i for r in dealt) for i in n} == {i: k - math.ceil(k * 0.88 - 1e-9) + 1 for i, k in n.items()}
    common = set(frequent[0].tolist())
    assert sum(r.shingle in common for r in dealt) < sum(s in common for r in sets.collect() for s in r.shingles) / 10


def test_overlaps_of_two_sides(spark):
    rows = near_copies(6)
    sides = [[x for x in rows if x[0] % 2 == k] for k in (0, 1)]
    copied = [*sides[0], (100, sides[1][3][1].upper()), (102, None), (104, "...")]
    left, right = (spark.createDataFrame(x, "id int, text string") for x in (copied, [*sides[1], (103, "!")]))
    got = {r.id: (r.reason, r.similarity) for r in similarity.overlaps(left, right, "id", "text", 0.6).collect()}
    best = {}
    for (a, b), j in jaccards(rows).items():
        if a % 2 == 0 and b % 2 == 1 and j >= 0.6:
            best[a] = max(best.get(a, 0), j)
    theirs = {t for _, t in sides[1]}
    exact = {i for i, t in sides[0] if t in theirs} | {100}
    assert best and got == {a: ("similar", pytest.approx(j)) for a, j in best.items()} | dict.fromkeys(exact, ("exact", 1.0))


def test_copies_of_both_sides_fall_together(spark, monkeypatch):
    """Copies that only one side has are compared once for all; an id of several rows stands for no other."""
    base = [f"w{i}" for i in range(40)]
    near, far = " ".join([*base[:-1], "other"]), " ".join(f"x{i}" for i in range(40))
    left = [*((2 * i, " ".join(base) + "!" * i) for i in range(1, 30)), (70, far), (72, "?")]
    right = [(1, near), (1, far + " more"), (3, near), (5, near.upper()), (7, None)]
    seen = []
    monkeypatch.setattr(similarity, "verified_pairs", lambda cand, *a, f=similarity.verified_pairs: seen.append(cand.count()) or f(cand, *a))
    got = {r.id: (r.reason, r.similarity) for r in similarity.overlaps(*(spark.createDataFrame(x, "id int, text string") for x in (left, right)), "id", "text", 0.88).collect()}
    assert got == {2 * i: ("similar", pytest.approx(35 / 37)) for i in range(1, 30)}
    assert seen == [1]


def test_sets_are_not_sent_for_each_pair(spark, monkeypatch):
    """A group of near copies sends each set once for each cell, and no pair is lost or made twice, in cells of any size."""
    r = random.Random(8)
    sets = {i: sorted({*range(100), *(r.randrange(100, 120) for _ in range(5))}) for i in range(60)}
    want = {(a, b): len(x & y) / len(x | y) for a in sets for b in sets if a < b and len((x := {*sets[a]}) & (y := {*sets[b]})) >= 0.93 * len(x | y)}
    held = spark.createDataFrame(list(sets.items()), "id int, shingles array<bigint>")
    cand = spark.createDataFrame([p for p in itertools.combinations(sets, 2)], "a int, b int")
    for cell, limit in ((1, 10_000), (7, 0), (64, 10_000)):
        monkeypatch.setattr(similarity, "CELL", cell)
        monkeypatch.setattr(similarity, "SENT_KEYS", limit)
        pairs = [(p.a, p.b, p.similarity) for p in similarity.verified_pairs(cand, held, held, 0.93).collect()]
        assert want and len(pairs) == len(want) and {(a, b): s for a, b, s in pairs} == pytest.approx(want)
    dealt, asked = similarity.cells(cand)
    assert cand.count() == 1770 and dealt.count() == dealt.select("a").distinct().count() == 59 and asked.count() == 59


def test_tfidf_counts_pairs_of_frequent_words_only(spark):
    """Equal to plain counts, in any size of vocabulary; a key of several rows counts as one text, and no pair crosses rows."""
    r = random.Random(3)
    rows = [(i if i % 9 else 0, " ".join(r.choice(["aa", "bb", "a", "cc_1", "Dd", "e!", "ff", "gé", f"x{r.randrange(40)}"]) for _ in range(r.randrange(40)))) for i in range(50)] + [(99, None), (98, "!")]
    counts = {}
    for i, t in rows:
        w = re.findall("[a-z0-9_]{2,}", (t or "").lower())
        counts.setdefault(i, Counter()).update([*w, *(f"{a} {b}" for a, b in itertools.pairwise(w))])
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    for most in (3, 12, 10_000):
        top = sorted((t for t in total if df[t] >= 2), key=lambda t: (-total[t], t))[:most]
        x = {(i, t): (1 + math.log(c[t])) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for i, c in counts.items() for t in top if c[t]}
        norm = Counter()
        for (i, _), v in x.items():
            norm[i] += v * v
        got = {(q.id, q.term): q.weight for q in features.tfidf(spark.createDataFrame(rows, "id int, text string"), "id", "text", most, 2).collect()}
        assert got == pytest.approx({(i, t): v / norm[i] ** 0.5 for (i, t), v in x.items()})
    alone = spark.createDataFrame([x for x in rows if x[0]], "id int, text string")
    assert "Exchange" not in features.tfidf(alone, "id", "text", 12, 2)._jdf.queryExecution().executedPlan().toString()


def test_distinct_n_makes_no_string_of_an_ngram(spark):
    """A null group is one too, and a text shorter than n has none; what is dealt are hashes, each once for a batch."""
    rows = [("a", "x y x y"), ("a", "x y z"), ("b", "one"), (None, "p q p q"), ("c", None), ("c", "?")]
    out = textmetrics.distinct_n(spark.createDataFrame(rows, "g string, t string"), "g", "t", [1, 2])
    got = {(r.g, r.n): (r.total, r.uniq, r.rate) for r in out.collect()}
    assert got == {("a", 1): (7, 3, round(3 / 7, 9)), ("a", 2): (5, 3, 0.6), ("b", 1): (1, 1, 1.0), (None, 1): (4, 2, 0.5), (None, 2): (3, 2, round(2 / 3, 9))}
    assert "array_join" not in out._jdf.queryExecution().executedPlan().toString()


def test_retrieval_by_source_counts_words_once(spark):
    """Words of long texts are counted in one pass, not once for each of them; texts without a word score 0."""
    long = " ".join(f"w{i} w{i}" for i in range(8_000))
    items = [(1, 10, "A", 1, long), (1, 11, "A", 2, "w1 W2!"), (1, 12, "B", 3, None), (2, 13, "A", 0, long)]
    df = spark.createDataFrame(items, "scope int, id int, source string, created_session int, text string")
    asked = spark.createDataFrame([(1, 20, 9, long), (1, 21, 2, "w1 w1 zz")], "scope int, id int, created_session int, text string")
    started = time.time()
    got = {(r.q, r.source, r.d): (r.score, r["rank"]) for r in similarity.retrieve_by_source(asked, df, "scope", {"A": 1, "B": 2}).collect()}
    assert got == {(20, "A", 10): (1.0, 1), (20, "B", 12): (0.0, 1), (21, "A", 10): (round(4 / (5 * 32_000) ** 0.5, 9), 1)}
    assert time.time() - started < 60


def test_empty_set_conventions(spark):
    e = F.array().cast("array<string>")
    r = one(spark.range(1).select(text.jaccard(e, e).alias("j"), text.jaccard_distance(e, e).alias("d"), numbers.cosine(F.array(), F.array(F.lit(1.0))).alias("c")))
    assert (r.j, r.d, r.c) == (1.0, 0.0, 0.0)
    s = one(spark.createDataFrame([(None,)], "t string").select(text.normalize_space(F.col("t")).alias("n"), text.estimate_tokens(F.col("t")).alias("e"), F.size(text.shingles(text.tokens(F.col("t")))).alias("s")))
    assert (s.n, s.e, s.s) == ("", 1, 0)
    assert one(spark.createDataFrame([("a  b",)], "t string").select(text.normalize_space(F.col("t")).alias("n"))).n == "a b"


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(10)], "g string, x double")
    assert one(numbers.percentile_lower(df, ["g"], "x", 0.95, "p")).p == 8.0
    assert one(df.groupBy("g").agg(numbers.percentile_linear("x", 0.95).alias("p"))).p == pytest.approx(8.55)


def test_threshold_choice_falls_back(spark):
    rows = [("c", "M0+R0", 0.2, 0.9, 0.9, 1.0), ("c", "MP+R0", 0.9, 0.6, 0.9, 2.0), ("d", "M0+R0", 0.50, 0.0, 0.0, 5.0), ("d", "MP+R0", 0.52, 0.0, 0.0, 1.0), ("d", "MS+R0", 0.9, 0.9, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "card string, action_id string, response double, misuse double, omission double, cost double")
    got = {r.card: (r.action_id, r.fallback) for r in policy.threshold_choice(df, ["card"], F.lit(0.3), F.lit(0.5), F.lit(0.05)).collect()}
    assert got == {"c": ("MP+R0", True), "d": ("MP+R0", False)}


def test_pair_graph_is_connected(spark):
    cards = spark.createDataFrame([(i, i) for i in range(8)], "card int, available int")
    e = pairgraph.card_edges(cards, "card", "available")
    audit = pairgraph.graph_audit(cards, e, "card", "available").collect()
    assert all(r.components == 1 and r.isolated == 0 and r.nodes == 2 * 2 ** bin(r.card).count("1") for r in audit)
    pairs = pairgraph.with_audit(pairgraph.oriented_pairs(e, "card", F.lit(1)), "card").cache()
    n = pairs.where("role = 'base' and card = 7").count()
    assert pairs.where("role = 'reversal' and card = 7").count() == round(n * 0.15)
    assert not pairs.where("role <> 'base' and training_eligible").count()


def test_dual_order_forms_differ(spark):
    df = spark.createDataFrame([(1, "AB", "A"), (1, "BA", "tie"), (2, "AB", "A"), (2, "BA", "B"), (3, "AB", "A")], "u int, order string, label string")
    strict = {r.u: r.winner for r in panel.dual_order(df, ["u"], "order", "label", False).collect()}
    loose = {r.u: r.winner for r in panel.dual_order(df, ["u"], "order", "label", True).collect()}
    assert strict == {1: "tie", 2: "A"} and loose == {1: "A", 2: "A"}


def test_response_scores_of_a_card(spark):
    df = spark.createDataFrame([("c", "x", "y", "A"), ("c", "y", "z", "A"), ("c", "x", "z", "A")], "card string, a string, b string, w string")
    s = {r.action_id: r.score for r in labels.response_scores(df, "card", "a", "b", "w").collect()}
    assert s["x"] > 0.5 > s["z"] and s["y"] == pytest.approx(0.5)


def test_inference_on_known_deltas(spark):
    rows = [("g", f"u{i}", float(1 + (i % 3))) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, u string, x double")
    est = one(inference.cluster_estimate(df, ["g"], "u", "x"))
    ci = one(inference.interval(inference.bootstrap(df, ["g"], "u", "x"), ["g"]))
    assert est.pooled == est.clustered == 2.0 and 1.5 < ci.low < 2.0 < ci.high < 2.5
    assert one(inference.sign_flip_test(df, ["g"], "u", "x")).p_value == pytest.approx(1 / 10001)
    with pytest.raises(Exception, match="unknown preference"):
        df.select(inference.preference_value(F.col("g"))).collect()


def test_lcs_against_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert textmetrics.lcs_length(a, b) == t[-1][-1]


def test_samples_are_deterministic(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("s"), (F.col("id") % 50).alias("u"))
    a = sampling.hash_sample(df, 20, F.lit(1), "k").collect()
    assert sorted(a) == sorted(sampling.hash_sample(df.repartition(9), 20, F.lit(1), "k").collect())
    assert sorted(r.k for r in sampling.systematic_sample(df.repartition(5), 40, "k").collect()) == [i * 1000 // 40 for i in range(40)]
    folds = {r.u: r.fold for r in sampling.grouped_folds(df, "u", 5).collect()}
    assert len(folds) == 50 and {list(folds.values()).count(f) for f in range(5)} == {10}
    split = df.groupBy(ids.split_of(F.lit(1), "k").alias("s")).count().collect()
    assert {r.s: r["count"] for r in split}["train"] == pytest.approx(700, abs=60)


def uncut_plan(rows, quota, total):
    """The greedy plan over all rows ``(key, scenario, stratum, priority)``."""
    rows = sorted(rows, key=lambda r: (r[2], -r[3], r[0]))
    used, taken = {}, []

    def take(r, turn):
        used[r[1]] = used.get(r[1], 0) + 1
        taken.append((r[0], turn))

    for turn in (1, 2):
        for stratum in sorted({r[2] for r in rows}):
            n = sum(r[2] == stratum and any(r[0] == k for k, _ in taken) for r in rows)
            for r in (r for r in rows if r[2] == stratum):
                if n < quota and len(taken) < total and all(r[0] != k for k, _ in taken) and not (turn == 1 and r[1] in used):
                    take(r, turn)
                    n += 1
    while len(taken) < total and len(taken) < len(rows):
        take(min((r for r in rows if all(r[0] != k for k, _ in taken)), key=lambda r: (used.get(r[1], 0), -r[3], r[0])), 3)
    return sorted(taken)


def test_strata_plan_takes_what_the_uncut_greedy_takes(spark):
    import random

    from tessera.operators.sampling import greedy_strata

    rng = random.Random(5)
    rows = []
    for stratum, scenarios in enumerate((1, 2, 3, 40)):
        rows += [(100 * stratum + i, f"u{rng.randrange(scenarios)}", f"s{stratum}", rng.randrange(50)) for i in range(60)]
    for some in (rows[:60], rows[:180], rows):
        df = spark.createDataFrame(some, "item long, user string, kind string, size long")
        got = greedy_strata(df, "item", "user", "kind", "size", quota=4, total=30).collect()
        assert sorted((r["item"], r["turn"]) for r in got) == uncut_plan(some, 4, 30)
