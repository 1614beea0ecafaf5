"""The prefix trie, near-dedup of embeddings and hard negatives against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import prefix_trie as trie_module
from tessera.llm.embedding_dedup import bucket_plan, close_pairs, close_vectors, quantised, unit_rows
from tessera.llm.hard_negatives import codebook, encoded, hard_negatives, scored
from tessera.llm.prefix_trie import peeled, prefix_trie
from tests.llm.helpers import words_of

CONV = "conv_id long, turn long, role string, text string, c long, h1 string"


def brute_trie(rows, every=20, most=4):
    def tie(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=tie):
        own[r[0]].append((r[2] or "", r[3] or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[d, tuple(turns[:d])].append(c)
    children, below = defaultdict(int), {k: [0, 0] for k in members}
    for d, turns in members:
        if d:
            children[d - 1, turns[:-1]] += 1
    for (d, turns), some in members.items():
        saved = (len(some) - 1) * len(words_of(turns[-1][1])) if d else 0
        for up in range(d + 1):
            below[up, turns[:up]][0] += not children[d, turns]
            below[up, turns[:up]][1] += saved
    out = []
    for (d, turns), some in members.items():
        ends = ",".join(str(c) for c in sorted(some) if len(whole[c]) == d)
        parent = min(members[d - 1, turns[:-1]]) if d else None
        out.append((min(some), d, parent, len(some), children[d, turns], *below[d, turns], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def talk(rng, n, many=400):
    """Conversations over few different turns, so that they share prefixes, with odd rows."""
    said = ["", None, "one two", "One two", "a b\tc d", "x " * 3000]
    rows = []
    for c in [*range(n), -5, -20, 1 << 40]:
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(said[:3] if rng.random() < 0.8 else said)) for t in range(rng.randint(1, 6))]
    rows += [(7, None, "user", "first"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "bot", "tie"), (None, 0, "user", "nobody")]
    rows += [(23, t, "user", f"turn {t}") for t in range(10, many)]
    return [(*r, i, "other") for i, r in enumerate(rows)]


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = talk(random.Random(3), 60)
    want = brute_trie(rows)
    df = spark.createDataFrame(rows, CONV).repartition(3)
    assert trie_rows(prefix_trie(df)) == want
    monkeypatch.setattr(trie_module, "PIECE_BITS", 2)
    monkeypatch.setattr(trie_module, "LIST_BITS", 1)
    assert trie_rows(prefix_trie(df)) == want


def test_trie_of_nothing_and_of_one(spark):
    assert prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    rows = [(1, 0, "user", "only", 0, "")]
    assert trie_rows(prefix_trie(spark.createDataFrame(rows, CONV))) == brute_trie(rows)


def test_caterpillar_takes_few_rounds(spark):
    """Conversation k leaves a common path after k turns: a trie as deep as it is wide."""
    rows = [(c * 20, t, "user", f"step {t}", 0, "") for c in range(64) for t in range(c)] + [(c * 20, c, "user", f"end of {c}", 0, "") for c in range(64)]
    assert trie_rows(prefix_trie(spark.createDataFrame(rows, CONV))) == brute_trie(rows)
    spines = spark.createDataFrame([(k, k - 1 if k else None, k, 1, 1) for k in range(12)], "s long, up long, at long, saved long, leaves long")
    totals, _ = peeled(spines)
    assert {r["s"]: r["saved"] for r in totals.collect()} == {k: 12 - k for k in range(12)}


VEC = "vec_id long, embedding array<float>, label int, k long, component string"


def near_vectors(rng, n, dim=16):
    base = rng.standard_normal((n, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(0, n, 4):
        for step in (0.05, 0.1, 0.2, 0.25, 0.3):
            rows.append((len(rows), (base[i] * rng.uniform(0.1, 9) + step * np.linalg.norm(base[i]) * rng.standard_normal(dim) / dim**0.5).tolist()))
    rows += [(len(rows) + k, rows[k % 3][1]) for k in range(6)] + [(5, rows[5][1]), (None, rows[1][1]), (None, [0.5] * dim)]
    odd = [None, [], [0.0] * dim, [1.0, None], [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0], [1.0, 0.0], [1e30] * dim, [1e-30] * dim]
    rows += [(len(rows) + 100 + k, v) for k, v in enumerate(odd)]
    return [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], None, 0, "x") for i, v in rows]


def brute_links(rows, dim, cosine):
    ids = [r[0] for r in rows]
    fine = [r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    x = np.array([(r[1] + [0.0] * dim)[:dim] if f else [0.0] * dim for r, f in zip(rows, fine, strict=True)], float)
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), where=np.array(fine)[:, None], out=np.zeros_like(x))
    link = (u @ u.T >= cosine) & np.array(fine) & np.array(fine)[:, None]
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(link, label, len(rows)).min(axis=1))
        if (new == label).all():
            break
        label = new
    out = []
    for i, k in enumerate(ids):
        named = [ids[j] for j in np.flatnonzero(label == label[i]) if ids[j] is not None]
        best = min(named) if named and fine[i] else k
        out.append((k, int(link[i].sum()), best, k == best))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket,cell", [(2048, 4096), (64, 8)])
def test_close_vectors_equal_brute_force(spark, bucket, cell):
    rows = near_vectors(np.random.default_rng(1), 80)
    got = close_vectors(spark.createDataFrame(rows, VEC).repartition(3), bucket=bucket, cell=cell, miss=1e-9)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_links(rows, 16, 0.95)


def test_close_vectors_of_nothing(spark):
    assert close_vectors(spark.createDataFrame([], VEC)).count() == 0
    got = close_vectors(spark.createDataFrame([(4, None, 1, 0, "")], VEC)).collect()
    assert [tuple(r) for r in got] == [(4, 0, 4, True)]


def test_int8_bound_holds_and_pairs_at_the_edge_are_right():
    rng = np.random.default_rng(5)
    u = unit_rows(rng.standard_normal((150, 64)))
    turned = unit_rows(rng.standard_normal((150, 64)))
    turned = unit_rows(turned - (turned * u).sum(axis=1, keepdims=True) * u)
    cos = np.linspace(0.94, 0.96, 150)[:, None]
    both = np.concatenate([u, cos * u + np.sqrt(1 - cos * cos) * turned])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    codes, step, miss = quantised(both)
    about = (codes.astype(int) @ codes.astype(int).T) * step[:, None] * step
    assert (np.abs(about - both @ both.T) <= miss[:, None] + (1 + miss[:, None]) * miss).all()
    want = {(i, j) for i, j in zip(*np.nonzero(both @ both.T >= 0.95), strict=True) if i < j}
    for left, same in ((300, True), (150, False)):
        got = {(int(i), int(j)) for a, b in close_pairs(both, left, 0.95, same) for i, j in zip(a, b, strict=True)}
        assert got == (want if same else {(i, j) for i, j in want if i < 150 <= j})


def test_tables_grow_with_the_vectors():
    for n in (500, 50_000, 10**8):
        bits, tables = bucket_plan(n, 0.95, 1e-5)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= 1e-5
        assert n / 2**bits <= 2 * 2048


def mined_rows(rng, n, dim=7):
    rows = [(i, rng.standard_normal(dim).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(i, rows[i][1], rows[i][2]) for i in (0, 3, 50, 51)] + [(n + k, rows[k][1], (rows[k][2] + 1) % 3) for k in range(20)]
    rows += [(None, rows[2][1], 0), (None, rows[2][1], 1), (1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * dim, 1), (1150, [1.0] * dim, None)]
    rows += [(1200, [], 1), (1250, [3.0, 1.0], 2), (1300, [900.0] * dim, 1), (1350, [0.0] * dim, 0)]
    return [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], y, 0, "x") for i, v, y in rows]


def brute_mined(rows, every=50, positives=5, negatives=3):
    part = [(i, [math.floor(256 * x) for x in v], y) for i, v, y, *_ in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, x, y) in enumerate(part):
        if a is None or a % every:
            continue
        score = [(sum(p * q for p, q in zip(x, z, strict=False)), i, k) for i, (k, z, _) in enumerate(part)]
        key = lambda s: (-s[0], s[2] is None, s[2] or 0)
        alike = sorted((s for s in score if part[s[1]][2] == y and s[1] != n), key=key)[:positives]
        unlike = sorted((s for s in score if part[s[1]][2] != y), key=key)
        for ps, _, p in alike:
            some = [s for s in unlike if 50 * ps <= 100 * s[0] <= 95 * ps][:negatives]
            out += [(a, p, r, k, ps, ns) for r, (ns, _, k) in enumerate(some, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [16_384, 2])
def test_hard_negatives_equal_brute_force(spark, at_once):
    rows = mined_rows(np.random.default_rng(2), 400)
    got = hard_negatives(spark.createDataFrame(rows, VEC.replace("label", "kind")).withColumnRenamed("kind", "label").repartition(3), anchors_at_once=at_once)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_mined(rows)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives(spark.createDataFrame([], VEC)).count() == 0
    assert hard_negatives(spark.createDataFrame([(50, [1.0], 1, 0, ""), (1, None, 1, 0, "")], VEC)).count() == 0


def test_look_up_sums_lie_within_the_residual_bound():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.standard_normal((500, 8))).astype(np.int64)
    books = codebook(x[:300], centroids=16)
    codes, missed = encoded(x, books)
    about, true = scored(codes, books, x[:40]), x @ x[:40].T
    assert (np.abs(about - true) <= missed[:, None] * np.linalg.norm(x[:40], axis=1) + 1e-6).all()
    assert (missed < np.linalg.norm(x, axis=1)).mean() > 0.99
