"""The chains of training, scoring and choosing, users' views, calls and steps in order."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import chain, keys, sampling
from tessera.plans import users as us
from tessera.streaming.events import called, closed_loop


def actions(spark, n=40):
    rows = []
    for c in range(n):
        for k, a in enumerate(("M0+R0", "MP+R0", "MP+RS")):
            x, y = float(k), float((c * 7 + k * 3) % 5) / 5
            rows.append((c, c % 8, a, x, y, 0.2 * k, 0.5 - 0.1 * k, 0.3 + 0.2 * k, 0.1 * k, 0.9 - 0.3 * k))
    return spark.createDataFrame(rows, "card long, state long, action_id string, x double, y double, " + ", ".join(f"{h} double" for h in chain.HEADS))


def pairs_of(spark, n=40):
    rows = [(c, "M0+R0", "MP+R0", "B") for c in range(n)] + [(c, "MP+R0", "MP+RS", "B" if c % 4 else "A") for c in range(n)] + [(c, "M0+R0", "MP+RS", "tie") for c in range(n)]
    return spark.createDataFrame(rows, "card long, a string, b string, winner string")


def test_chain_scores_in_range_and_fails_out_of_it(spark):
    a, p = actions(spark), pairs_of(spark)
    model = chain.train_actions(a, p, "card", F.col("card") < 30, ["x", "y"], alpha=1e-6)
    got = model.score_actions(a.where("card >= 30")).toPandas()
    assert got[["response", *chain.HEADS]].to_numpy().min() >= 0 and got[["response", *chain.HEADS]].to_numpy().max() <= 1
    assert (abs(got["misuse"] - 0.2 * got["x"]) < 1e-4).all()
    assert model.ranker[0] > 0 and model.report == {"cards": 30, "pairs": 60}
    with pytest.raises(keys.CheckFailed, match="outside"):
        model.score_actions(a.withColumn("x", F.lit(9.0)))
    e = chain.evaluate_actions(model, a.where("card >= 30"), p.where("card >= 30"), "card").first()
    assert e.pairs == 20 and 0.6 < e.accuracy < 1 and e.mae_misuse < 1e-3


def test_chain_gates(spark):
    a, p = actions(spark), pairs_of(spark)
    with pytest.raises(keys.CheckFailed, match="no training card"):
        chain.train_actions(a, p, "card", F.lit(False), ["x"])
    with pytest.raises(keys.CheckFailed, match="incomplete"):
        chain.train_actions(a.withColumn("misuse", F.when(F.col("card") > 3, F.col("misuse"))), p, "card", F.lit(True), ["x"])
    with pytest.raises(keys.CheckFailed, match="both sides"):
        chain.train_actions(a, p, "card", F.col("card") < 30, ["x"], state="state")
    with pytest.raises(keys.CheckFailed, match="two classes"):
        chain.train_actions(a, p.where("winner = 'tie'"), "card", F.lit(True), ["x"])


def test_cross_validation_has_a_row_for_each_setting(spark):
    a, p = actions(spark), pairs_of(spark)
    folds = sampling.grouped_folds(a, "state", 2).select("state", "fold")
    got = chain.cross_validated(a, p, folds, "card", "state", {"one": ["x"], "two": ["x", "y"]}).collect()
    assert sorted((r.mode, r.fold, r.pairs) for r in got) == [("one", 0, 40), ("one", 1, 40), ("two", 0, 40), ("two", 1, 40)]


def test_cross_validation_says_what_each_fit_says_and_shuffles_no_actions_for_pairs(spark):
    from tessera.operators.pairgraph import decided_pairs

    a, p = actions(spark), pairs_of(spark)
    folds = sampling.grouped_folds(a, "state", 2).select("state", "fold")
    got = {r.fold: r for r in chain.cross_validated(a, p, folds, "card", "state", {"two": ["x", "y"]}).collect()}
    rows = a.join(folds, "state")
    for f in (0, 1):
        model = chain.train_actions(rows, p, "card", F.col("fold") != f, ["x", "y"], "state")
        held = rows.where(F.col("fold") == f)
        e = chain.evaluate_actions(model, held, p.join(held.select("card").distinct(), "card", "left_semi"), "card").first()
        assert all(got[f][c] == pytest.approx(e[c]) for c in e.asDict())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = decided_pairs(a.repartition("card"), "card", "y")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert met.count() > 0 and plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ensembles_learn_from_reliable_rows(spark):
    rows = [
        (s, a, float(k), True, *[1.0 + k + s % 2] * len(chain.RATINGS), *[float(k)] * len(chain.RISKS)) for s in range(8) for k, a in enumerate(("M0+R0", "MP+R0"))
    ]
    cols = "state long, action_id string, x double, reliable boolean, " + ", ".join(f"{h} double" for h in chain.RATINGS + tuple(f"r_{h}" for h in chain.RISKS))
    df = spark.createDataFrame(rows, cols).withColumnsRenamed({f"r_{h}": h for h in chain.RISKS})
    got = chain.train_ensembles(df, "state", ["x"], members=2, trees=300, least=1, l2=0.0).collect()
    assert len(got) == 16 * 13
    assert all(r["mean"] == pytest.approx(0.0 if r.action_id == "M0+R0" else 1 / 3, abs=1e-5) for r in got if r["head"] == "misuse")
    with pytest.raises(keys.CheckFailed, match="without a labelled"):
        chain.train_ensembles(df.where("action_id <> 'M0+R0'"), "state", ["x"])
    with pytest.raises(keys.CheckFailed, match="no reliable"):
        chain.train_ensembles(df.withColumn("reliable", F.lit(False)), "state", ["x"])
    b = chain.action_bounds(spark.createDataFrame(got), "state", dict.fromkeys(chain.RATINGS, 1 / 6))
    assert b.where("quality_lcb <= quality_mean and quality_mean <= quality_ucb").count() == 16


def test_gates_and_fallbacks(spark):
    row = lambda s, a, lcb, ucb, risk, mo=0.0, so=0.0, cost=1.0: (s, a, lcb, lcb, ucb, risk, mo, so, cost)
    rows = [
        row("gain", "M0+R0", 0.4, 0.5, 0.1), row("gain", "MP+R0", 0.6, 0.7, 0.1),
        row("none", "M0+R0", 0.4, 0.5, 0.1), row("none", "MP+R0", 0.505, 0.9, 0.1),
        row("trigger", "M0+R0", 0.4, 0.5, 0.1, mo=0.6), row("trigger", "MP+R0", 0.45, 0.9, 0.1),
        row("risky", "M0+R0", 0.4, 0.5, 0.9), row("risky", "MP+R0", 0.9, 0.9, 0.8),
        row("strategy", "M0+R0", 0.4, 0.5, 0.1), row("strategy", "M0+RS", 0.51, 0.6, 0.1),
        row("cheapest", "MP+R0", 0.9, 0.9, 0.9, cost=2.0), row("cheapest", "MS+R0", 0.1, 0.2, 0.9),
    ]
    cols = "s string, action_id string, quality_mean double, quality_lcb double, quality_ucb double, risk_ucb double, memory_omission_ucb double, strategy_omission_ucb double, cost double"
    df = spark.createDataFrame(rows, cols)
    got = {r.s: (r.action_id, r.reason) for r in chain.gated_choice(df, "s").collect()}
    assert got == {
        "gain": ("MP+R0", "chosen"), "none": ("M0+R0", "chosen"), "trigger": ("MP+R0", "chosen"), "risky": ("M0+R0", "no action passed"),
        "strategy": ("M0+R0", "chosen"), "cheapest": ("MS+R0", "no action passed"),
    }
    assert {(r.action_id, r.reason) for r in chain.gated_choice(df.where("s = 'gain'"), "s", F.lit(True)).collect()} == {("M0+R0", "ood")}


def test_hidden_fields_never_reach_the_policy(spark, tmp_path):
    user = {
        "id": "u1", "basic_info": {"first_name": "Ann", "age": "", "job": None}, "event_timeline": ["secret"], "subsequent_topics": [{"topic": "gold thing", "gold_reference": "g"}],
        "dialog_history": [
            {"id": "a", "timestamp": "t1", "summary": " was  sad ", "dialogue": [{"role": "seeker", "content": "hi  there"}, {"role": "supporter", "content": "no"}, {"role": "seeker", "content": " "}]},
            {"id": "", "timestamp": "", "summary": "", "dialogue": [{"role": "supporter", "content": "x"}]},
        ],
    }
    (tmp_path / "u.json").write_text(json.dumps([user]))
    df = us.read_users(spark, str(tmp_path / "u.json"), users=1, sessions=2, topics=1)
    assert keys.schema_fields(us.policy_view(df), us.HIDDEN) == []
    assert set(keys.schema_fields(df, us.HIDDEN)) == set(keys.schema_fields(us.evaluator_view(df), us.HIDDEN)) != set()
    got = {(r.source, r.created_session, r.text, r.timestamp) for r in us.memory_of(df).collect()}
    assert got == {("MP", 0, "First Name: Ann", None), ("MS", 1, "was sad", "t1"), ("ME", 1, "hi there", "t1")}
    with pytest.raises(keys.CheckFailed, match="sessions: 2 instead of 401"):
        us.read_users(spark, str(tmp_path / "u.json"), users=1, sessions=401, topics=1)


def test_roles_must_be_of_different_families(spark):
    df = spark.createDataFrame([("judge", "a"), ("simulator", "b"), ("generator", " A ")], "role string, family string")
    assert [(r.role_a, r.role_b) for r in keys.shared_families(df, "role", "family").collect()] == [("generator", "judge")]
    with pytest.raises(keys.CheckFailed, match="share a"):
        keys.require_independent(df, "role", "family")
    with pytest.raises(keys.CheckFailed, match="without a family"):
        keys.require_independent(df.withColumn("family", F.lit(None).cast("string")), "role", "family")
    keys.require_independent(df.where("role <> 'judge'"), "role", "family")


def test_calls_are_tried_again(spark):
    def flaky(texts):
        if "seen" not in flaky.__dict__:
            flaky.seen = True
            raise OSError("down")
        return [t.upper() if t != "bad" else "" for t in texts]

    df = spark.createDataFrame([("a",), ("bad",)], "t string").coalesce(1)
    got = {r.t: (r.reply, r.attempts, r.error) for r in called(df, "t", flaky, attempts=3, wait=0.01, valid=bool, fallback="none").collect()}
    assert got == {"a": ("A", 2, None), "bad": ("none", 3, "invalid reply")}
    with pytest.raises(Exception, match="not valid after 1"):
        called(df, "t", lambda x: [""] * len(x), valid=bool).collect()


def test_steps_see_what_the_last_one_left(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 1, 3), ("b", 1, 9)], "k string, i long, x long").repartition(3)
    got = closed_loop(df, "k", "i", lambda s, r: ({"sum": s["sum"] * 2 + r["x"]}, {"y": s["sum"] * 2 + r["x"]}), {"sum": 1}, "y long").collect()
    assert sorted((r.k, r.i, r.y) for r in got) == [("a", 1, 5), ("a", 2, 15), ("b", 1, 11)]


def test_folds_match_the_greedy_choice(spark):
    import random

    rng = random.Random(4)
    for k in (2, 3, 5):
        sizes = [rng.choice([1, 1, 1, 2, 3, 7, 20]) for _ in range(60)]
        df = spark.createDataFrame([(g, i) for g, n in enumerate(sizes) for i in range(n)], "g long, i long")
        loads, want = [0] * k, {}
        for g in sorted(range(60), key=lambda g: (-sizes[g], g)):
            want[g] = loads.index(min(loads))
            loads[want[g]] += sizes[g]
        assert {r.g: r.fold for r in sampling.grouped_folds(df, "g", k).collect()} == want
    with pytest.raises(keys.CheckFailed, match="two groups"):
        sampling.grouped_folds(spark.createDataFrame([(1, 1)], "g long, i long"), "g", 2)


def test_exact_quantiles_match_numpy(spark):
    import random

    import numpy as np

    rng = random.Random(8)
    for values in ([3.0], [1.0, 2.0], [rng.choice([0.0, 1.5, rng.random()]) for _ in range(301)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
        shares = [0, 0.05, 0.25, 0.5, 0.95, 1.0]
        assert sampling.exact_quantiles(df, "x", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert sampling.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_sides_and_wanted_keys(spark):
    want = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    got = {r.side: (r.missing, r.extra, r.duplicates, r.ok) for r in keys.reconcile_sides(want, {"a": want, "b": spark.createDataFrame([(1,), (1,), (3,)], "k int")}, ["k"]).collect()}
    assert got == {"a": (0, 0, 0, True), "b": (2, 1, 1, False)}
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (4, "w")], "k int, v string")
    assert {r.v for r in keys.require_all(rows, want.where("k is null or k = 1"), ["k"]).collect()} == {"x", "y", "z"}
    with pytest.raises(keys.CheckFailed, match="no row for"):
        keys.require_all(rows, want, ["k"])


def test_a_gain_just_as_large_as_asked_for_passes(spark):
    # 0.42 - 0.4 is 0.02 but for the last bit.
    rows = [(1, "M0+R0", 1.0, 0.2, 0.4, 0.0), (1, "MP+R0", 1.0, 0.42, 0.5, 0.0), (2, "M0+R0", 1.0, 0.1, 0.4, 0.0), (2, "M0+RS", 1.0, 0.42, 0.5, 0.0)]
    df = spark.createDataFrame([(*r, 0.1, 0.1) for r in rows], "card long, action_id string, cost double, quality_lcb double, quality_ucb double, risk_ucb double, memory_omission_ucb double, strategy_omission_ucb double")
    assert 0.42 - 0.4 < 0.02
    assert {(r.card, r.action_id, r.reason) for r in chain.gated_choice(df, "card").collect()} == {(1, "MP+R0", "chosen"), (2, "M0+RS", "chosen")}
