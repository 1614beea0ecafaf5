"""Exact dedup, SimHash and mixing against brute force."""

import hashlib
import itertools
import re

import xxhash

from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.mixing import mix_sources
from tessera.llm.simhash import cross_links, near_duplicates, near_links, simhash_components, sliced_pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def test_simhash_matches_brute_force(docs):
    got = simhash_components(docs).collect()
    rows = docs.collect()
    fp = {(r.doc_id, r.text): brute_fingerprint(r.text) for r in rows}
    assert len(got) == len(rows)
    assert sorted(r.fingerprint for r in got) == sorted(f"{fp[r.doc_id, r.text]:016x}" for r in rows)
    label = components(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), f in fp.items():
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    want = sorted((str(i), f"{f:016x}", least.get(label[f]) or -1) for (i, _), f in fp.items())
    assert sorted({(str(r.doc_id), r.fingerprint, r.component_id or -1) for r in got}) == want


def test_simhash_ignores_other_columns_and_empty_tables(docs, no_docs):
    assert simhash_components(no_docs).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as id", "2 as fp", "3 as key", "4 as component_id")
    assert simhash_components(clash).count() == docs.count()


def test_bit_sliced_links_are_complete():
    import random

    rng = random.Random(3)
    for n_bytes, radius in ((8, 3), (32, 48)):
        bits = n_bytes * 8
        centres = [rng.getrandbits(bits) for _ in range(9)]
        group = list({c ^ sum(1 << i for i in rng.sample(range(bits), rng.randint(0, radius))) for c in centres for _ in range(25)})
        rng.shuffle(group)
        left, right, tree = near_links([[x.to_bytes(n_bytes) for x in group]], radius)
        seen = components([x.to_bytes(n_bytes) for x in group], lambda a, b: False)
        for a, b in zip(left, right, strict=True):
            old, new = seen[a], seen[b]
            seen = {k: new if v == old else v for k, v in seen.items()}
        want = components(group, lambda a, b: (a ^ b).bit_count() <= radius)
        assert len(left) == len(group) - len(set(want.values())) and len(set(tree)) == len({want[int.from_bytes(a)] for a in left})
        for a, b in itertools.combinations(group, 2):
            assert (want[a] == want[b]) == (seen[a.to_bytes(n_bytes)] == seen[b.to_bytes(n_bytes)])


def test_bit_sliced_pairs_of_many_groups_match_brute_force():
    import random

    import numpy as np

    rng = random.Random(9)
    sizes = [1, 2, 2, 3, 1, 70, 2, 130, 5, 64, 65, 2, 1, 200, 2]
    names = [rng.getrandbits(24).to_bytes(3) for _ in range(sum(sizes))]
    flat = np.frombuffer(b"".join(names), np.uint8).reshape(-1, 3)
    group = np.repeat(np.arange(len(sizes)), sizes)
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    label = np.array([rng.randrange(40) for _ in names], np.int32)
    for radius in (0, 5, 7, 8, 24):
        got = {(int(a), int(b), int(x)) for d, i, j in sliced_pairs(flat, rest, radius, label) for x, a, b in zip(d, i, j, strict=True)}
        away = lambda a, b: (int.from_bytes(names[a]) ^ int.from_bytes(names[b])).bit_count()
        pairs = [(a, b) for a, b in itertools.combinations(range(len(names)), 2) if group[a] == group[b] and label[a] != label[b]]
        assert got == {(a, b, away(a, b)) for a, b in pairs if away(a, b) <= radius}


def test_near_duplicates_keep_one_of_each_group(docs, spark, prose_of):
    import random

    rng = random.Random(5)
    base = [prose_of(rng, 200).split() for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        for c in range(1, 4):
            v = list(w)
            for at in rng.sample(range(200), 3):
                v[at] = "other"
            rows.append((100 * c + i, " ".join(v)))
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.kept} == set(range(12))
    assert all(r.component_id == i % 100 for i, r in got.items())
    out = near_duplicates(docs)
    assert out.count() == docs.count()
    assert out.where("kept").count() == out.select("component_id").distinct().count()


def test_near_duplicates_match_brute_force(spark, prose_of):
    import random

    rng = random.Random(31)
    base = [prose_of(rng, rng.randint(20, 220)).split() for _ in range(25)]
    texts = [" ".join(w) for w in base]
    for w in base:
        for _ in range(6):
            v = list(w)
            for at in rng.sample(range(len(v)), rng.randint(1, max(1, len(v) // 20))):
                v[at] = "other"
            texts.append(" ".join(v))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t in texts for w in [t.split()]]
    want = components(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    together = lambda label: {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if label[a] == label[b]}
    assert together(got) <= together(want)
    assert len(together(got)) >= 0.98 * len(together(want))


def test_copies_less_like_each_other_than_their_origin_stay_together(spark, prose_of):
    import random

    rng = random.Random(17)
    rows = []
    for copies, edits in ((12, 4), (90, 4)):
        origin = prose_of(rng, 200).split()
        group = [origin]
        for c in range(copies):
            v = list(origin)
            for at in rng.sample(range(200), edits):
                v[at] = f"other{c}x{at}"
            group.append(v)
        rng.shuffle(group)
        rows += [" ".join(w) for w in group]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for t in rows for w in [t.split()]]
    want = components(list(range(len(rows))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(set(want.values())) == 2
    got = near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.kept} == {0, 13}


def test_texts_of_one_repeated_ending_are_no_copies(spark, prose_of):
    import random

    rng = random.Random(41)
    ends = ["- " * 400, "| " * 400, "word " * 400, ". " * 400]
    rows = [(10 * e + i, prose_of(rng, 120) + " " + end) for e, end in enumerate(ends) for i in range(4)]
    rows += [(1000 + i, t.replace(" ", "  ")) for i, t in rows]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.kept} == {i for i, _ in rows if i < 1000}
    assert all(r.component_id == i % 1000 for i, r in got.items())


def test_copies_with_repeated_passages_match_brute_force(spark, prose_of):
    import random

    rng = random.Random(43)
    texts = []
    for i in range(12):
        w = prose_of(rng, rng.randint(150, 300)).split()
        v = list(w)
        v[rng.randrange(len(v))] = "other"
        texts += [" ".join(w), " ".join(w + ["-"] * 400), " ".join(w + w[20:40] * (3 * i)), " ".join(v + v[-12:] * 60)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for t in texts for w in [t.split()]]
    want = components(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(set(want.values())) == 12
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in itertools.combinations(range(len(texts)), 2))


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    rows = [(1, "one two three four five six", "x"), (1, "one two three four five six", "x"), (2, "one two  three four five six", "x"), (None, "seven", "x"), (None, "seven", "x")]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(map(tuple, left.collect()), key=str) == [(1, *rows[0][1:]), (None, "seven", "x")]


def test_equal_fingerprints_of_other_sets_are_compared():
    names = [bytes(32) + bytes([i]) * 8 for i in range(100)]
    for group in (names[:5], names):
        left, right, _ = near_links([group], 0, n_bytes=32)
        assert len(left) == len(group) - 1
        assert len(set(components(group, lambda a, b: (a, b) in zip(left, right) or (b, a) in zip(left, right)).values())) == 1


def test_cross_links_connect_what_all_pairs_connect():
    import random

    import numpy as np

    rng = random.Random(3)
    for nearest in (0, 1000):
        sets, fps, label = [], [], []
        for group in range(6):
            origin = rng.sample(range(10_000), 60)
            for _ in range(rng.randint(1, 12)):
                s = set(origin)
                for x in rng.sample(origin, rng.randint(0, 9)):
                    s.remove(x)
                sets.append(np.array(sorted(s), np.uint32))
                fps.append([rng.randrange(4) for _ in range(4)])
                label.append(rng.randrange(8))
        have = [set(s.tolist()) for s in sets]
        bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True))
        near = lambda a, b: bits(a, b) <= 4 and len(have[a] & have[b]) >= 0.8 * len(have[a] | have[b])
        found = list(cross_links(np.array(fps, np.uint8), np.array(label), sets, 4, 0.8, nearest))
        assert all(near(a, b) and label[a] != label[b] for a, b in found)
        nodes = list(range(len(sets)))
        want = components(nodes, lambda a, b: label[a] == label[b] or near(a, b))
        got = components(nodes, lambda a, b: label[a] == label[b] or (a, b) in found or (b, a) in found)
        assert all((want[a] == want[b]) == (got[a] == got[b]) for a, b in itertools.combinations(nodes, 2))


def test_exact_dedup_both_ways(docs, no_docs):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(LOWER), []).append(r.doc_id)
    want = sorted(
        (str(r.doc_id), str(max((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest())
        for r in rows
        for t in [(r.text or "").translate(LOWER)]
        for g in [groups[t]]
    )
    for most in (1_000_000, 0):
        got = exact_duplicates(docs, digest=True, broadcast_keys=most).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_duplicates(no_docs).count() == 0
    assert exact_duplicates(docs.selectExpr("*", "1 as id", "2 as sha", "3 as n")).columns == ["doc_id", "keep_id", "group_size", "kept"]


def test_mixing_meets_targets(docs, no_docs):
    got = mix_sources(docs, rows_per_bucket=5).collect()
    again = mix_sources(docs.repartition(7), rows_per_bucket=1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {str(r.doc_id): len(WORD.findall(r.text or "")) for r in docs.collect()}
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == size[str(r.doc_id)]
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.5
    assert sum(t for _, t in by) == sum(r.size for r in got) * 1.5
    assert mix_sources(no_docs).count() == 0
    assert mix_sources(docs.limit(0).union(no_docs)).count() == 0


def test_one_large_group_of_near_copies_is_one_class(spark, prose_of):
    import random

    rng = random.Random(23)
    origin = prose_of(rng, 120).split()
    texts = []
    for c in range(3_000):
        v = list(origin)
        for at in rng.sample(range(120), 2):
            v[at] = f"other{c}x{at}"
        texts.append(" ".join(v))
    texts += [" ".join(origin)] + [prose_of(rng, 120) for _ in range(50)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for t in texts for w in [t.split()]]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(alike(c, 3_000) for c in range(3_000)) and sum(alike(0, c) for c in range(1, 3_000)) < 300
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()}
    assert {i for i, r in got.items() if r.kept} == {0, *range(3_001, 3_051)}
    assert {r.component_id for i, r in got.items() if i <= 3_000} == {0}
