"""Plans of items from strata that overlap, against a plain search."""

import random

import pytest

from tessera.operators.sampling import greedy_strata

SCHEMA = "item long, user string, kind string, size double"


def plain_plan(rows, quotas, total):
    """Search one item after the other; scenario uses as they stand before the last turn. Item to (stratum, turn, covered)."""
    best = {}
    for item, user, kind, size in rows:
        if item is not None and kind in quotas:
            size = float("-inf") if size is None else size
            best[item, kind] = max(best.get((item, kind), (float("-inf"), user)), (size, user))
    lists = {s: sorted((-size, item, user) for (item, kind), (size, user) in best.items() if kind == s) for s in quotas}
    plan, used = {}, {}

    def pick(item, user, kind, turn):
        plan[item] = [kind, turn, {kind}]
        used[user] = used.get(user, 0) + 1

    for turn in (1, 2):
        for s, quota in quotas.items():
            need = min(quota - (sum(p[0] == s for p in plan.values()) if turn == 2 else 0), total - len(plan))
            for _, item, user in lists[s] if need > 0 else []:
                if item in plan:
                    plan[item][2].add(s)
                elif turn == 2 or not used.get(user):
                    pick(item, user, s, turn)
                    need -= 1
                    if not need:
                        break
    order = list(quotas)
    last = sorted((used.get(user, 0), size, item, order.index(s), user) for s in quotas for size, item, user in lists[s])
    if len(plan) < total:
        for _, _, item, s, user in last:
            if item in plan:
                plan[item][2].add(order[s])
            else:
                pick(item, user, order[s], 3)
                if len(plan) == total:
                    break
    return {item: (s, turn, sorted(covered)) for item, (s, turn, covered) in plan.items()}


@pytest.mark.parametrize("users, quotas, total", [(3, {"b": 6, "a": 4, "c": 2}, 12), (30, {"b": 6, "a": 4, "c": 2}, 25), (6, {"a": 3, "b": 2}, 400)])
def test_overlapping_strata_against_a_plain_search(spark, users, quotas, total):
    rng = random.Random(users)
    rows = []
    for item in range(60):
        for kind in rng.sample(["a", "b", "c", "d"], rng.randrange(1, 5)):
            rows.append((item, f"u{item % users}", kind, rng.choice([None, float(rng.randrange(12))])))
    rows += rows[:20] + [(None, "u0", "a", 99.0), (500, "u0", None, 99.0)]
    got = greedy_strata(spark.createDataFrame(rows, SCHEMA), "item", "user", "kind", "size", quotas, total, counts="before").collect()
    assert len(got) == len({r["item"] for r in got})
    assert {r["item"]: (r["kind"], r["turn"], r["covered"]) for r in got} == plain_plan(rows, quotas, total)


def test_plan_of_no_rows_and_of_bad_size(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert greedy_strata(empty, "item", "user", "kind", "size", {"a": 2}, 5).collect() == []
    assert greedy_strata(empty, "item", "user", "kind", "size", 2, 5).collect() == []
    with pytest.raises(ValueError):
        greedy_strata(empty, "item", "user", "kind", "size", 2, 0)
    one = spark.createDataFrame([(1, None, None, float("nan"))], SCHEMA)
    assert [(r["item"], r["user"], r["turn"], r["covered"]) for r in greedy_strata(one, "item", "user", "kind", "size", 2, 5).collect()] == [(1, None, 3, [])]
