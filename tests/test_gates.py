"""Grids against plain loops, and gates on tables made to fail them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates, grids
from tessera.operators.actions import ACTIONS, MEMORY
from tessera.operators.chain import gated_choice
from tessera.operators.keys import CheckFailed

BOUNDS = "card long, action_id string, cost double, quality_lcb double, quality_ucb double, risk_ucb double, memory_omission_ucb double, strategy_omission_ucb double, quality double, risk double, tokens double"


def bounds(spark, n=30, seed=3):
    rng = random.Random(seed)
    rows = []
    for card in range(n):
        for a in rng.sample(ACTIONS, rng.randrange(1, 16)):
            low = rng.randrange(8) / 10
            rows.append((card, a, float(rng.randrange(40)), low, low + rng.randrange(3) / 50, rng.randrange(6) / 10, rng.randrange(7) / 10, rng.randrange(7) / 10, rng.randrange(10) / 10, rng.randrange(10) / 10, float(rng.randrange(90))))
    return spark.createDataFrame(rows, BOUNDS)


def test_gated_grid_is_the_choice_at_each_setting(spark):
    df = bounds(spark)
    settings = {"cost_weight": (0.05, 0.3), "risk_weight": (0.15,), "resource_gain": (-0.03, 0.02), "strategy_gain": (0.0,), "max_risk": (0.3, 0.5)}
    got = {tuple(r[n] for n in grids.GATED): r for r in grids.gated_grid(df, "card", settings, states_per_task=7).collect()}
    assert len(got) == 8
    scale = df.agg(F.avg("tokens")).first()[0]
    for cw, rw, mg, sg, mr in itertools.product(*settings.values()):
        c = gated_choice(df, "card", max_risk=mr, resource_gain=mg, strategy_gain=sg, risk_weight=rw, cost_weight=cw).join(df, ["card", "action_id"])
        want = c.agg(F.count("*").alias("n"), F.avg("quality").alias("q"), F.avg("risk").alias("r"), F.avg("tokens").alias("t"), F.avg((F.col("reason") != "chosen").cast("double")).alias("f")).first()
        r = got[cw, rw, mg, sg, mr]
        assert r.states == want.n == 30
        assert (r.quality, r.risk, r.tokens, r.fallback_rate) == pytest.approx((want.q, want.r, want.t, want.f))
        assert r.objective == pytest.approx(want.q - rw * want.r - cw * want.t / scale)


def test_gated_grid_tries_states_where_they_lie(spark, monkeypatch):
    plans, keep = [], grids.durable
    monkeypatch.setattr(grids, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    grids.gated_grid(bounds(spark).repartition("card"), "card")
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1


def test_best_settings_keep_the_quality(spark):
    grid = grids.gated_grid(bounds(spark), "card")
    assert grid.count() == 432
    middle = grid.agg(F.median("quality")).first()[0]
    best = grids.best_settings(grid, middle, best=5).collect()
    rows = sorted((r for r in grid.collect() if r.quality >= middle), key=lambda r: (-r.objective, -r.quality, r.risk, r.tokens, *[r[n] for n in grids.GATED]))
    assert [r.objective for r in best] == [r.objective for r in rows[:5]]


def test_rule_grid_leaves_out_settings_that_miss_cards(spark):
    cards = spark.createDataFrame([(1, 0.1, 0.0, 0.0, 0.1), (2, 0.2, 0.15, 0.05, 0.0), (3, 0.0, 0.0, 0.0, 0.0)], "card long, a double, b double, c double, conf double")
    rows = [(card, a, 0.5 + 0.01 * i, 0.1, 0.1, float(i)) for card in (1, 2, 3) for i, a in enumerate(ACTIONS) if (card, a) != (2, "MP+R0")]
    out = spark.createDataFrame(rows, "card long, action_id string, response double, misuse double, omission double, cost double")
    grid = grids.rule_grid(cards, out, "card", {"MP": F.col("a"), "MS": F.col("b"), "ME": F.col("c")}, F.col("conf"))
    got = {(r.threshold, r.strategy_threshold, r.most): r for r in grid.collect()}
    assert len(got) == 75 and all(r.cards == 3 for r in got.values())
    r = got[0.08, 0.08, 2]  # the cards' actions: MP+RS, MPMS+R0, M0+R0
    costs = [ACTIONS.index(a) for a in ("MP+RS", "MPMS+R0", "M0+R0")]
    assert r.complete and r.cost == pytest.approx(sum(costs) / 3) and r.entropy == pytest.approx(1.584962500721156)
    assert not got[0.18, 0.18, 3].complete and got[0.18, 0.18, 3].covered == 2
    assert grids.best_rule(grid).count() == 1
    assert grids.best_rule(grid.where("not complete")).isEmpty()


LABELS = "state long, action_id string, quality double, risk double, cost double, reliable boolean, regime string"


def good_labels():
    """Nine regimes, four states each, whose best action is what the regime asks for."""
    wanted = {"m0": "M0+R0", "mp": "MP+RS", "ms": "MS+R0", "me": "ME+RS", "multi": "MPE+R0", "rs": "MSE+RS", "r0": "MP+R0", "ambiguous": "M0+RS"}
    rows = []
    for s in range(36):
        regime = list(gates.EXPECTED)[s % 9]
        best = wanted[gates.EXPECTED[regime]]
        rows += [(s, a, 0.9 if a == best else 0.85 if regime == "ambiguous" else 0.2, 0.1, 10.0, True, regime) for a in ACTIONS]
    return rows


def test_label_gates_pass_and_each_fails(spark):
    rows = good_labels()
    make = lambda rs: spark.createDataFrame(rs, LABELS)
    r = gates.require_label_gates(make(rows), "state").first()
    assert (r.states, r.labels, r.status, r.failures, r.actions) == (36, 576, "PASS", "", 8)
    unreliable = [(*x[:5], x[0] % 2 == 0, x[6]) for x in rows]
    assert gates.label_gates(make(unreliable), "state").first().failures == "reliable_label_rate"
    assert gates.label_gates(make([x for x in rows if x[6] != "ambiguous"]), "state").first().missing_regimes == "ambiguous"
    one = [(*x[:2], 0.9 if x[1] == "M0+R0" else 0.1, *x[3:]) for x in rows]
    r = gates.label_gates(make(one), "state").first()
    assert r.failures == "distinct_oracle_actions,single_action_dominance,rs_oracle_coverage,regime_alignment"
    assert r.low_regimes == "ambiguous,event_needed,multi_source_needed,profile_needed,strategy_helpful,summary_needed"
    with pytest.raises(CheckFailed, match="single_action_dominance"):
        gates.require_label_gates(make(one), "state")
    r = gates.label_gates(make([]), "state").first()
    assert r.status == "FAIL" and (r.states, r.labels) == (0, 0)


def test_ties_of_best_labels(spark):
    rows = [(1, "M0+R0", 0.5, 0.1, 5.0, True, None), (1, "MP+R0", 0.5, 0.1, 5.0, True, None), (2, "ME+RS", 0.5, None, 5.0, True, "x")]
    got = {r.state: (r.action_id, r.gap) for r in gates.best_labels(spark.createDataFrame(rows, LABELS), "state").collect()}
    assert got == {1: ("MP+R0", 0.0), 2: ("ME+RS", 0.0)}
    assert {r.regime: r.pass_rate for r in gates.regime_rates(gates.best_labels(spark.createDataFrame(rows, LABELS), "state")).collect()} == {"unknown": 1.0, "x": 1.0}
    assert len(MEMORY) == 8


def test_units_need_every_condition_once_in_one_context(spark):
    schema = "user long, turn long, condition string, said string, before array<string>, reply string"
    rows = [(1, 1, c, "hi", b, f"r{c}") for c, b in (("pm", None), ("rule", []), ("full", None))]
    rows += [(2, 1, "pm", None, ["a", None], "x"), (2, 1, "rule", None, ["a", None], "y"), (2, 1, "full", None, ["a"], "z")]
    rows += [(3, 1, "pm", "s", [], "x"), (3, 1, "pm", "s", [], "x"), (3, 1, "other", "t", [], "x"), (4, 1, "rule", "s", [], "x")]
    df = spark.createDataFrame(rows, schema)
    args = ["user", "turn"], "condition", ["pm", "rule", "full"], ["said", "before"], ["reply"]
    got = {r.user: r for r in gates.unit_rows(df, *args).collect()}
    assert {u: (r.missing, r.repeated, r.differs) for u, r in got.items()} == {1: ("", "", ""), 2: ("", "", "full"), 3: ("rule,full", "pm", "")}
    assert got[1].before == [] and {c: x.reply for c, x in got[1].candidates.items()} == {"pm": "rpm", "rule": "rrule", "full": "rfull"}
    assert gates.require_units(df.where("user = 1"), *args).columns == ["user", "turn", "said", "before", "candidates"]
    with pytest.raises(CheckFailed, match="full"):
        gates.require_units(df, *args)


def test_bundles(spark):
    schema = "bundle string, text string, regime string, family string, MP long, MS long, ME long"
    whole = [("good", f"text {i}", r, "work", 1, 1, 1) for i, r in enumerate(gates.EXPECTED)]
    rows = whole + [("twice", "Text  0" if r == "ambiguous" else x, r, f, *n) for _, x, r, f, *n in whole]
    rows += [("pool", x, r, "other" if r == "ambiguous" else f, *n) for _, x, r, f, *n in whole]
    rows += [("bare", x, r, f, 0, 0, None) if r == "ambiguous" else ("bare", x, r, f, *n) for _, x, r, f, *n in whole]
    rows += [("few", x, r, f, *n) for _, x, r, f, *n in whole[:3]] + [(None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.bundle: r.failures for r in gates.bundle_gates(df, "bundle", ["work"]).collect()}
    assert got == {
        "good": "",
        "twice": "repeated_text",
        "pool": "family_outside_pool",
        "bare": "no_inventory,missing_source",
        "few": "missing_regimes,one_case_per_regime",
        None: "missing_regimes,no_inventory,one_case_per_regime,family_outside_pool,missing_source",
    }
    assert {r.bundle: r.failures for r in gates.bundle_gates(df, "bundle", ["work"], strict=False).collect()}["pool"] == ""


def test_grids_are_the_choices_at_each_setting_in_one_shuffle(spark):
    from tessera.operators import policy as po

    rng = random.Random(4)
    rows = [(c, a, rng.randrange(10) / 10, rng.randrange(9) / 8, rng.randrange(5) / 4, float(rng.randrange(1, 9))) for c in range(60) for a in rng.sample(ACTIONS, rng.randrange(1, 16))]
    df = spark.createDataFrame(rows, "card long, action_id string, response double, misuse double, omission double, cost double").repartition(4, "card").withColumn("std", F.col("cost") / 50)
    limits, margins = {"misuse": [0.1, 0.3, 0.6], "omission": [0.25, 0.5]}, [0.0, 0.05]
    grid = po.grid_metrics(df, "card", limits, margins, entropy=True, cards_at_once=7)
    bound = po.lcb_grid(df, ["card"], {"z": [0.5, 1.6], "mr": [0.5, 0.7], "cw": [0.001, 0.04]}, "M0+R0")
    # Rows that are dealt by card already are dealt no second time; the other two shuffles are of sums.
    for frame, most in ((po.grid_metrics(df, "card", limits, margins), 3), (bound, 1)):
        assert frame._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") <= most
    got = {(r.max_misuse, r.max_omission, r.epsilon): r for r in grid.collect()}
    assert len(got) == 12
    for (m, o, e), r in got.items():
        want = po.policy_metrics(po.threshold_choice(df, ["card"], F.lit(m), F.lit(o), F.lit(e))).first()
        assert r.states == want.states == 60
        assert all(r[c] == pytest.approx(want[c]) for c in ("response", "misuse", "omission", "cost", "fallback_rate", "entropy"))
    picked = {(r.card, r.z, r.mr, r.cw): (r.action_id, r.fallback, r.utility) for r in bound.collect()}
    assert len(picked) == 60 * 8
    for z, mr, cw in itertools.product([0.5, 1.6], [0.5, 0.7], [0.001, 0.04]):
        for r in po.lcb_choice(df, ["card"], z, mr, cw, "M0+R0").collect():
            assert picked[r.card, z, mr, cw] == (r.action_id, r.fallback, pytest.approx(r.utility))


def test_pairs_of_a_card_are_dealt_once(spark):
    from tessera.operators import labels as lab
    from tessera.operators import pairgraph as pg

    cards = spark.createDataFrame([(c, c % 8) for c in range(24)], "card long, available int")
    pairs = pg.oriented_pairs(pg.card_edges(cards.repartition(4, "card"), "card", "available"), "card", F.lit(7))
    audited = pg.with_audit(pairs, "card")
    values = [(c, a, (c * 5 + i * 3) % 7 / 2) for c in range(24) for i, a in enumerate(ACTIONS) if (c + i) % 3]
    out = spark.createDataFrame(values, "card long, action_id string, x double").repartition(4, "card")
    met = lab.pair_outcomes(pairs, out, "card", "first", "second", "x", "first", "second")
    for frame, most in ((audited, 1), (met, 2)):
        assert frame._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") <= most
    at = {(c, a): x for c, a, x in values}
    want = {(r.card, r.pair_id): (at[r.card, r["first"]], at[r.card, r["second"]]) for r in pairs.collect() if (r.card, r["first"]) in at and (r.card, r["second"]) in at}
    assert {(r.card, r.pair_id): (r.value_a, r.value_b) for r in met.collect()} == want and want
    roles = [r.role for r in audited.collect()]
    assert roles.count("base") == pairs.count() and roles.count("reversal") and roles.count("repeat")
