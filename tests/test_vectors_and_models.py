"""Logistic fits, joint vectors, boosting and saved models against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting, keys, logistic
from tessera.operators import vectors as ve


def plain_fit(x, y, w, c=1.0):
    v = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(v)) / c, x.T @ (w * (p - y)) + v / c)
    return v


def sparse_table(spark, x, y, w):
    rows = [((np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()), int(a), float(b)) for r, a, b in zip(x, y, w, strict=True)]
    return spark.createDataFrame(rows, "x struct<indices: array<int>, values: array<double>>, label int, weight double").repartition(3)


@pytest.mark.parametrize("dense", [256, 2])
def test_logistic_fits_equal_plain_newton(spark, monkeypatch, dense):
    monkeypatch.setattr(logistic, "DENSE", dense)
    monkeypatch.setattr(logistic, "CHUNK", 3)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5)) * (rng.random((60, 5)) < 0.5)
    y, w = (rng.random(60) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int), rng.uniform(0.1, 2, 60)
    want = plain_fit(x, y, w, 2.0)
    assert logistic.fit_sparse(sparse_table(spark, x, y, w), 5, c=2.0) == pytest.approx(want, abs=1e-6)
    if dense > 2:
        named = spark.createDataFrame([(*map(float, r), int(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], "a double, b double, c double, d double, e double, label int, weight double")
        assert logistic.fit_columns(named, list("abcde"), c=2.0) == pytest.approx(want, abs=1e-8)


def test_a_separable_set_has_finite_weights(spark):
    named = spark.createDataFrame([(1.0, 1, 1.0), (-1.0, 0, 1.0)] * 50, "a double, label int, weight double")
    assert logistic.fit_columns(named, ["a"], c=100.0) == pytest.approx(plain_fit(np.array([[1.0], [-1.0]] * 50), np.array([1, 0] * 50), np.ones(100), 100.0), abs=1e-6)


def grid(spark, n=240):
    rng = np.random.default_rng(8)
    x, z = rng.integers(0, 9, n), rng.integers(0, 4, n)
    y = 0.3 * (x > 4) + 0.1 * z + 0.05 * rng.standard_normal(n)
    return spark.createDataFrame([(i // 3, f"a{i % 3}", float(a), float(b), float(c), float(1 - c), 1.0 if i % 7 else 0.0) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "g long, action_id string, x double, z double, y double, v double, w double")


def test_boosting_is_the_same_where_cells_lie_and_on_all_of_them(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    df, heads = grid(spark), {"y": ("y", 3), "v": ("v", 5)}
    kw = {"weight": "w", "members": 2, "trees": 5, "rate": 0.3, "least": 4}
    one = boosting.boosted(df, "g", ["x", "z"], heads, **kw)
    two = boosting.boosted(df.repartition(3), "g", ["x", "z"], heads, cells_at_once=1, **kw)
    assert (one.feature == two.feature).all() and (one.at == two.at).all()
    assert two.value == pytest.approx(one.value, abs=1e-9) and two.base == pytest.approx(one.base)


def test_boosting_equals_rows_in_plain_python(spark):
    df = grid(spark)
    model = boosting.boosted(df, "g", ["x", "z"], {"y": ("y", 3)}, "w", members=2, trees=4, rate=0.3, least=4)
    t = df.withColumn("b", model.bins()).withColumns({f"d{m}": boosting.multiplicity(3, m, "g") for m in range(2)}).toPandas()
    bins, y = np.stack(t["b"]), t["y"].to_numpy()
    for m in range(2):
        w = (t["w"] * t[f"d{m}"]).to_numpy()
        guess = np.full(len(y), (w * y).sum() / w.sum())

        def leaf(rows, depth, rate=0.3, guess=guess, w=w):
            r, h = (w * (y - guess))[rows].sum(), w[rows].sum()
            best = None
            for f in range(2):
                for b in range(bins[:, f].max()):
                    left = rows & (bins[:, f] <= b)
                    right = rows & (bins[:, f] > b)
                    if min((w[left] > 0).sum(), (w[right] > 0).sum()) < 4:
                        continue
                    gain = sum((w * (y - guess))[s].sum() ** 2 / (w[s].sum() + 1) for s in (left, right)) - r * r / (h + 1)
                    if round(gain, 12) > (best or (1e-12,))[0]:
                        best = round(gain, 12), left, right
            if depth == 0 or best is None:
                return [(rows, rate * r / (h + 1))]
            return leaf(best[1], depth - 1, rate, guess, w) + leaf(best[2], depth - 1, rate, guess, w)

        for _ in range(4):
            for rows, v in leaf(np.ones(len(y), bool), boosting.DEPTH, 0.3, guess.copy()):
                guess[rows] += v
        t[f"p{m}"] = guess
    got = model.predict(df).select("g", "action_id", F.col("predictions")[0]["mean"].alias("mean")).toPandas().sort_values(["g", "action_id"])
    want = t.assign(mean=(t["p0"] + t["p1"]) / 2).sort_values(["g", "action_id"])
    assert got["mean"].to_numpy() == pytest.approx(want["mean"].to_numpy(), abs=1e-9)


def test_boosting_needs_three_groups(spark):
    with pytest.raises(keys.CheckFailed, match="three groups"):
        boosting.boosted(grid(spark).where("g < 2"), "g", ["x"], {"y": ("y", 1)})


def states(spark, n=8):
    rows = []
    for i in range(n):
        r = {"id": i, "text": None if i == 3 else f"some words here {i % 3} words", "session_index": i, "available": i % 8, "embedding": [1.0, float(i)], "strategy_count": 3, "strategy_tokens": 50}
        for k, s in enumerate(("MP", "MS", "ME")):
            there = bool(i >> k & 1)
            r |= {f"{s}_available": there, f"{s}_count": i if there else 0, f"{s}_newest": 1 if there else None, f"{s}_median": 1.5, f"{s}_oldest": 2, f"{s}_tokens": 10 * i, f"{s}_similarity": 0.5, f"{s}_stale": 0.0, f"{s}_catalog": [1.0, 2.0, float(k)]}
        rows.append(r)
    kinds = ", ".join(f"{s}_available boolean, {s}_count int, {s}_newest int, {s}_median double, {s}_oldest int, {s}_tokens int, {s}_similarity double, {s}_stale double, {s}_catalog array<double>" for s in ("MP", "MS", "ME"))
    return spark.createDataFrame(rows, f"id int, text string, session_index int, available int, embedding array<double>, strategy_count int, strategy_tokens int, {kinds}")


def test_joint_vectors_open_text_by_action_and_keep_to_the_fitted_range(spark):
    s = states(spark)
    space = ve.JointSpace.fit(s.where("id < 6"), "id", "full", 10)
    got = {(r.id, r.action_id): dict(zip(r.x.indices, r.x["values"], strict=True)) for r in space.transform(ve.legal_rows(s)).collect()}
    assert len(got) == 2 * sum(2 ** bin(i).count("1") for i in range(8))
    d, n = len(space.low), len(space.terms)
    assert n and space.size == d + 4 * n and all(max(x, default=0) < space.size for x in got.values())
    both, none = got[7, "MPMSME+RS"], got[7, "M0+R0"]
    assert not any(i >= d for i in none) and all(sum(d + g * n <= i < d + (g + 1) * n for i in both) == sum(d <= i < d + n for i in both) > 0 for g in range(4))
    assert all(i >= d or space.low[i] <= v <= space.high[i] for x in got.values() for i, v in x.items())
    assert not any(i >= d for i in got[3, "MPMS+RS"])
    with pytest.raises(ValueError, match="unknown mode"):
        ve.JointSpace.fit(s, "id", "other")
    with pytest.raises(keys.CheckFailed, match="no states"):
        ve.JointSpace.fit(s.where("false"), "id")
    with pytest.raises(Exception, match="no such action"):
        space.transform(s.withColumn("action_id", F.lit("MX+R0"))).collect()


def test_vectors_are_laid_out_in_batches_with_nulls_and_limits(spark):
    df = spark.createDataFrame([(1, "a", 5, 1.0, [1.0, None, -3.0], [(0, 2.0)]), (2, "b", 0, 0.0, [0.0, 4.0, 7.0], [(1, 3.0)])], "id int, action_id string, _mask int, _rs double, d array<double>, t array<struct<i: int, v: double>>")
    assert ve.column_ranges(df, F.col("d")) == ([0.0, 4.0, -3.0], [1.0, 4.0, 7.0])
    plain = {r.id: (r.x.indices, r.x["values"]) for r in ve.laid_out(df, "id", F.col("d"), F.col("t"), 2, 5, 2).collect()}
    assert plain == {1: ([0, 2, 4, 5, 9, 11], [2.0, 1.0, -3.0, 2.0, 2.0, 2.0]), 2: ([1, 3, 4], [3.0, 4.0, 7.0])}
    cut = {r.id: (r.x.indices, r.x["values"]) for r in ve.laid_out(df, "id", F.col("d"), limits=([0.0, 1.0, 0.0], [0.5, 2.0, 9.0])).collect()}
    assert cut == {1: ([0, 1], [0.5, 1.0]), 2: ([1, 2], [2.0, 7.0])}


def test_robust_vectors_fail_on_what_is_not_allowed(spark):
    s = states(spark)
    space = ve.RobustSpace.fit(s, "id", 8, 8)
    assert len(space.centre) == 36 and space.size == 18 * 5 + 36 + 8
    got = space.transform(ve.legal_rows(s)).collect()
    assert all(r.x.indices == sorted(set(r.x.indices)) and max(r.x.indices) < space.size for r in got)
    with pytest.raises(Exception, match="not allowed"):
        space.transform(s.where("id = 1").withColumn("action_id", F.lit("MS+R0"))).collect()
    with pytest.raises(keys.CheckFailed, match="different lengths"):
        ve.RobustSpace.fit(s.withColumn("embedding", F.slice("embedding", 1, F.col("id") % 2 + 1)), "id")


def test_ranker_on_joint_vectors_equals_a_plain_one(spark):
    s = states(spark)
    space = ve.JointSpace.fit(s, "id", "text_metadata", 5)
    x = space.transform(ve.legal_rows(s))
    pairs = spark.createDataFrame([(i, "M0+R0", "M0+RS", "AB"[i % 2]) for i in range(8)] + [(7, "MP+R0", "ME+RS", "A"), (7, "MP+R0", "MP+RS", "tie")], "id int, a string, b string, winner string")
    rows = ve.pair_differences(x, pairs, "id").collect()
    dense = np.zeros((len(rows), space.size))
    for k, r in enumerate(rows):
        dense[k, r.x.indices] = r.x["values"]
    v = {(r.id, r.action_id): dict(zip(r.x.indices, r.x["values"], strict=True)) for r in x.collect()}
    a, b = v[7, "MP+R0"], v[7, "ME+RS"]
    want = np.array([a.get(i, 0.0) - b.get(i, 0.0) for i in range(space.size)])
    assert any(np.allclose(row, want) for row in dense) and any(np.allclose(row, -want) for row in dense) and len(rows) == 18
    got = ve.fit_ranker(x, pairs, "id", space.size)
    assert got == pytest.approx(plain_fit(dense, np.array([r.label for r in rows]), np.array([r.weight for r in rows])), abs=1e-5)
    score = x.where("id = 7 and action_id = 'MP+R0'").select(ve.dot("x", got).alias("s")).first().s
    assert score == pytest.approx(sum(got[i] * q for i, q in a.items()))


@pytest.mark.parametrize("units", [10**6, 1])
def test_resampling_is_the_same_with_and_without_a_broadcast(spark, units):
    from tessera.operators import inference as inf

    rng = np.random.default_rng(6)
    rows = [(f"g{i % 2}", f"u{i % 11}", i % 3, float(v)) for i, v in enumerate(rng.standard_normal(90))] + [(None, "u1", 0, 1.0), (None, "u2", 1, 2.0), ("g0", "u0", 1, None)]
    df = spark.createDataFrame(rows, "g string, u string, s int, x double")
    clusters = {}
    for g, u, _, x in rows:
        if x is not None:
            clusters.setdefault(g, {}).setdefault(u, []).append(x)
    for pooled in (False, True):
        got = {(r.g, r.rep): r.value for r in inf.bootstrap(df.where("g is not null"), ["g"], "u", "x", 20, pooled=pooled, units=units).collect()}
        assert len(got) == 40
        for (g, rep), v in got.items():
            c = [clusters[g][u] for u in sorted(clusters[g])]
            some = [c[inf.hashed(1729, rep, i) % len(c)] for i in range(len(c))]
            want = sum(map(sum, some)) / sum(map(len, some)) if pooled else np.mean([np.mean(s) for s in some])
            assert v == pytest.approx(want)
    for r in inf.sign_flip_test(df, ["g"], "u", "x", reps=50, units=units).collect():
        d = np.array([np.mean(clusters[r.g][u]) for u in sorted(clusters[r.g])])
        flips = [np.mean([x if inf.hashed(7, rep, i) % 2 == 0 else -x for i, x in enumerate(d)]) for rep in range(50)]
        assert r.clusters == len(d) and r["mean"] == pytest.approx(d.mean())
        assert r.p_value == pytest.approx((sum(abs(f) >= abs(d.mean()) - 1e-12 for f in flips) + 1) / 51)
    once = [tuple(r) for r in inf.hierarchical_bootstrap(df, "u", "s", "x", 15, units=units).orderBy("rep").collect()]
    other = [tuple(r) for r in inf.hierarchical_bootstrap(df, "u", "s", "x", 15, units=10**6 if units == 1 else 1).orderBy("rep").collect()]
    assert once == [(k, pytest.approx(v)) for k, v in other] and len(once) == 15


def test_saved_models_score_alike_and_fail_when_a_byte_changes(spark, tmp_path):
    import pathlib

    from tessera.operators.chain import ActionModel
    from tessera.sources import models as saved

    df = grid(spark)
    model = boosting.boosted(df, "g", ["x", "z"], {"y": ("y", 3), "v": ("v", 4)}, "w", members=2, trees=3, least=4)
    data = tmp_path / "data"
    df.write.parquet(str(data))
    path = str(tmp_path / "model")
    said = saved.Scorer(model).save(path, inputs=[str(data)], parameters={"trees": 3})
    again = saved.Scorer.load(path, kind=boosting.Boosted, inputs=[str(data)])
    score = lambda m: sorted((r.g, r.action_id, [tuple(p) for p in r.predictions]) for r in m.transform(df).collect())
    assert score(again) == score(saved.Scorer(model)) and said["parameters"] == {"trees": 3}
    with pytest.raises(keys.CheckFailed, match="not a ActionModel"):
        saved.load(spark, path, ActionModel)
    df.limit(1).write.mode("append").parquet(str(data))
    with pytest.raises(keys.CheckFailed, match="inputs differ"):
        saved.load(spark, path, inputs=[str(data)])
    space = ve.JointSpace.fit(states(spark), "id", "text_metadata_stable", 5)
    saved.save(spark, space, str(tmp_path / "space"))
    assert saved.load(spark, str(tmp_path / "space")) == space.__class__(**{**vars(space), "terms": [list(t) for t in space.terms]})
    part = next(pathlib.Path(path, "arrays").glob("part-*"))
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2] ^= 1
    part.write_bytes(bytes(raw))
    for crc in pathlib.Path(path, "arrays").glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(keys.CheckFailed, match="files differ"):
        saved.load(spark, path)
    line = next(pathlib.Path(path, "_attestation").glob("part-*"))
    line.write_text(line.read_text().replace('"trees": 3', '"trees": 4'))
    for crc in pathlib.Path(path, "_attestation").glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(keys.CheckFailed, match="hash differs"):
        saved.load(spark, path)
    with pytest.raises(keys.CheckFailed, match="no attestation"):
        saved.load(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="cannot save"):
        saved.save(spark, object(), str(tmp_path / "other"))


def test_arrays_of_hashes_are_hash_int():
    from tessera.functions.md5 import hash_ints
    from tessera.operators import inference as inf

    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 10 ** rng.integers(1, 13, 3000)) for _ in range(3)] + [np.arange(3000)]
    for head, some in (((1729, 7), columns[:1]), ((1731, 9999), columns), ((2**40, 10**12, 10**12), columns)):
        assert hash_ints(head, *some).tolist() == [inf.hashed(*head, *r) for r in zip(*(c.tolist() for c in some), strict=True)]
    assert hash_ints((1,), np.arange(0)).tolist() == []


def test_hierarchical_bootstrap_draws_in_nested_order(spark, monkeypatch):
    from tessera.operators import inference as inf

    monkeypatch.setattr(inf, "SLOTS", 7)  # more than one piece of slots
    tree = {u: {s: [(u * 7 + s * 5 + z * 3) % 11 / 4 for z in range(1 + (u + s) % 12)] for s in range(1 + u % 3)} for u in range(20)}
    df = spark.createDataFrame([(u, s, x) for u, cells in tree.items() for s, v in cells.items() for x in v], "u long, s long, x double")
    for r in inf.hierarchical_bootstrap(df, "u", "s", "x", 5).collect():
        means = []
        for slot in range(20):
            cells = [sorted(v) for _, v in sorted(tree[inf.hashed(1729, r.rep, slot) % 20].items())]
            inner = []
            for t in range(len(cells)):
                v = cells[inf.hashed(1730, r.rep, slot, t) % len(cells)]
                inner.append(np.mean([v[inf.hashed(1731, r.rep, slot, t, z) % len(v)] for z in range(len(v))]))
            means.append(np.mean(inner))
        assert r.value == pytest.approx(np.mean(means))
