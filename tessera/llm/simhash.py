"""SimHash fingerprints and their bit-sliced comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.filters import broadcast_filter, in_filter
from tessera.operators.graph import connected_components
from tessera.session import durable, prepare, removed, stored

#: Shingles are hashed as the contract of the query says: XXH64 with this seed.
HASH_SEED = 42
#: Bytes of a set's hash, which follow its fingerprint where rows are told apart by their shingles.
SET_BYTES = 8
#: Hashes are summed in pieces of so many, which bounds memory for very long texts.
PIECE = 1 << 15
#: Largest group that one cell of the comparison holds twice.
CELL = 1 << 14
#: Shingles of such a cell where members carry them, and how many near members are tried before all are.
SET_CELL, NEAREST = 1 << 21, 16

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; fewer words make one shingle, none make none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    n = len(words) - width + 1
    h = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((h(joined[a:b], HASH_SEED) for a, b in spans), np.uint64, n)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each hash (the public splitmix64 finaliser)."""
    z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(h: np.ndarray, n_bytes: int = 8) -> bytes:
    """Fingerprint of hashes, highest bit first: a bit is 1 if set in over half of them; none give zero."""
    counts = np.zeros(n_bytes * 8, np.int64)
    for at in range(0, len(h), PIECE):
        piece = h[at : at + PIECE]
        wide = np.stack([piece if k == 0 else mixed(piece, k) for k in range(n_bytes // 8)], axis=1)
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(piece), n_bytes), axis=1)
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, n_bytes * 8).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h)).tobytes()


def min_hashes(h: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit key for each band of ``rows`` minimum hashes; no hashes, no keys."""
    if not len(h):
        return []
    distinct = np.unique(h)
    out = []
    for band in range(bands):
        key = np.zeros(1, np.uint64)
        for r in range(rows):
            key = mixed(key ^ mixed(distinct, 1000 + band * rows + r).min(keepdims=True), band + 1)
        out.append(int(key.view(np.int64)[0]))
    return out


def set_name(distinct: np.ndarray, n_bytes: int) -> bytes:
    """Name of a set of shingles: the fingerprint of its ordered hashes, then ``SET_BYTES`` of a hash of them all."""
    return simhash(distinct, n_bytes) + xxhash.xxh64_digest(distinct.tobytes(), HASH_SEED)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, n_bytes: int = 8, bands: int = 0, rows: int = 2) -> DataFrame:
    """``id, fp binary`` of each row's whole text; with ``bands``, that of the distinct shingles: ``fp`` is their ``set_name``, with ``keys array<long>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = [], []
            for t in b.column(1).cast(pa.binary()):
                h = shingle_hashes(t.as_py(), width)
                h = np.unique(h) if bands else h
                fps.append(set_name(h, n_bytes) if bands else simhash(h, n_bytes))
                if bands:
                    keys.append(min_hashes(h, bands, rows))
            cols = [b.column(0), pa.array(fps, pa.binary())] + ([pa.array(keys, pa.list_(pa.int64()))] if bands else [])
            yield pa.RecordBatch.from_arrays(cols, ["id", "fp"] + ["keys"] * bool(bands))

    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, fp binary" + (", keys array<bigint>" if bands else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def sliced_pairs(flat: np.ndarray, rest: np.ndarray, radius: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``d, i, j``: pairs of members of one group at most ``radius`` bits apart and of different ``label``, tile by tile.

    ``flat`` is (members, bytes), groups one after the other; ``rest`` counts a member's group from it
    on. Bit k of all members, whatever their groups, is one plane. A tile holds each member against
    those up to 64 places on, by planes shifted so many bits. Differences are added into vertical
    counters by carry-save steps; counters start so that they overflow just beyond the radius, pairs
    of two groups or of one label start as overflowed, and blocks of 64 members in which all have
    overflowed are abandoned. ``label`` is read anew for each tile.
    """
    n, n_bytes = flat.shape
    words = -(-n // 64)
    padded = np.zeros((n_bytes * 8, (words + 2) * 64), np.uint8)
    padded[:, :n] = np.unpackbits(flat, axis=1).T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    ahead = np.zeros(words * 64, np.int64)
    ahead[:n] = rest
    longest = ahead.reshape(words, 64).max(axis=1)
    place = np.arange(64)
    depth = max(1, radius.bit_length())
    spare = (1 << depth) - 1 - radius
    for w in range(-(-int(rest.max()) // 64)):
        live = np.nonzero(longest > max(1, 64 * w))[0]
        shift = np.arange(min(64, int(rest.max()) - 64 * w))
        i = (live[:, None] * 64 + place).ravel()
        j = np.minimum(i + 64 * w + shift[:, None], n - 1)
        met = (ahead[i] > 64 * w + shift[:, None]) & (label[np.minimum(i, n - 1)] != label[j])
        over = ~np.packbits(met.reshape(len(shift), -1), axis=1, bitorder="little").view(np.uint64)
        right, left = shift.astype(np.uint64)[:, None], (63 - shift).astype(np.uint64)[:, None]
        counters = [np.full(over.shape, ALL if spare >> c & 1 else np.uint64(0)) for c in range(depth)]
        for k in range(n_bytes * 8):
            if k % 16 == 0:
                keep = (over != ALL).any(axis=0)
                if not keep.all():
                    live, over, counters = live[keep], over[:, keep], [c[:, keep] for c in counters]
                if not len(live):
                    break
            plane = planes[k]
            carry = plane[live + w] >> right | plane[live + w + 1] << np.uint64(1) << left
            carry ^= plane[live]
            for c in counters:
                both = c & carry
                c ^= carry
                carry = both
            over |= carry
        if not len(live):
            continue
        hits = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little").reshape(len(shift), len(live), 64)
        r, block, bit = np.nonzero(hits)
        i = live[block] * 64 + bit
        j = i + 64 * w + r
        yield np.bitwise_count(flat[i] ^ flat[j]).sum(axis=1, dtype=np.int64), i, j


def near_links(groups: list[list[bytes]], radius: int, steps: int = 1, n_bytes: int | None = None) -> tuple[list[bytes], list[bytes], list[int]]:
    """For each group of fingerprints, pairs at most ``radius`` bits apart that connect all that such pairs connect, and a name of each pair's tree.

    With ``n_bytes`` only so many first bytes are compared; the rest tells members of equal ones apart.
    Groups of any size go through the same planes. Nearer pairs are taken first: by ``steps`` growing
    radii, and by distance in each tile. Trees of the same members have the same name.
    """
    groups = [sorted(g) for g in groups if len(g) > 1]  # so that ties are broken alike in any run
    if not groups:
        return [], [], []
    names = list(itertools.chain.from_iterable(groups))
    size = np.fromiter(map(len, groups), np.int64, len(groups))
    flat = np.ascontiguousarray(np.frombuffer(b"".join(names), np.uint8).reshape(len(names), -1)[:, :n_bytes])
    rest = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    label = np.arange(len(flat), dtype=np.int32)
    parent = label.tolist()
    links: list[tuple[int, int]] = []
    for step in range(1, steps + 1):
        for d, i, j in sliced_pairs(flat, rest, radius * step // steps, label):
            order = np.lexsort((j, i, d))
            joined = len(links)
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                a, b = x, y
                while parent[a] != a:
                    parent[a] = a = parent[parent[a]]
                while parent[b] != b:
                    parent[b] = b = parent[parent[b]]
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((x, y))
            if len(links) > joined:
                roots = np.array(parent, np.int32)
                while (roots[roots] != roots).any():
                    roots = roots[roots]
                label[:] = roots
    order = np.argsort(label, kind="stable")
    trees = np.split(order, np.nonzero(np.diff(label[order]))[0] + 1)
    tree = {int(label[t[0]]): np.int64(xxhash.xxh64_intdigest(b"".join(names[k] for k in t.tolist())) - (1 << 63)) for t in trees if len(t) > 1}
    return [names[x] for x, _ in links], [names[y] for _, y in links], [int(tree[int(label[x])]) for x, _ in links]


def pigeonhole_keys(fp: str, n_bytes: int, radius: int) -> F.Column:
    """Array of keys such that two fingerprints within ``radius`` bits share one: all bytes but ``radius`` of them."""
    keys = []
    for t, out in enumerate(itertools.combinations(range(n_bytes), radius)):
        kept = [F.substring(fp, i + 1, 1) for i in range(n_bytes) if i not in out]
        keys.append(F.concat(F.lit(bytes([t])), *kept))
    return F.array(*keys)


def near_edges(members: DataFrame, key: F.Column, radius: int, steps: int = 1, cell: int = CELL, n_bytes: int | None = None) -> DataFrame:
    """``(src, dst, tree)``, written down: links within ``radius`` bits between fingerprints that share a key, as ``near_links`` gives them for each cell.

    ``members`` has a distinct ``fp`` a row, and ``key`` gives the array of its keys. Members of a key are
    gathered in cells; keys with more than ``cell`` members are cut into chunks, of which each pair
    makes a cell of its own, so that no task holds more than two chunks and no pair is lost.
    """
    keyed = members.select("fp", F.explode(key).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counts, path = stored(counts.select(F.col("key").alias("k"), F.ceil(F.col("n") / cell).cast("int").alias("chunks")))
    met = keyed.join(counts, F.col("key") == F.col("k")).withColumn("c", F.expr("pmod(xxhash64(fp), chunks)").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = met.select("key", "fp", "c", other.alias("d"))
    cells = (
        met.groupBy("key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right, tree = near_links(b.column(0).to_pylist(), radius, steps, n_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(tree, pa.int64())], ["src", "dst", "tree"])

    out = durable(cells.mapInArrow(run, "src binary, dst binary, tree bigint").distinct())
    removed(members.sparkSession, path)
    return out


def label_rows(prints: DataFrame, members: DataFrame, components: DataFrame) -> DataFrame:
    """Add ``best``, the least ``first`` of the row's component, to ``id, fp`` rows; ``members`` has ``fp, first``."""
    c = components.select(F.col("node").alias("f"), "component")
    whole = members.join(c, F.col("fp") == F.col("f"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = whole.groupBy("component").agg(F.min("first").alias("best"))
    named = whole.select(F.col("fp").alias("f"), F.col("component").alias("c")).join(least, F.col("c") == F.col("component")).select("f", "best")
    return prints.join(named, F.col("fp") == F.col("f")).drop("f")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id`` (64-bit SimHash of word shingles, radius in bits).

    A-Z are lower-cased; words are split at ASCII white space. Null, empty and blank texts have
    fingerprint zero and are linked like others; repeated rows stay, with equal results; a null id is
    no component's name unless it has no other. Other columns are ignored; an empty table gives an
    empty result.

    Copies fall together as one fingerprint before anything is compared. Fingerprints within the radius
    agree in all but ``radius`` of their eight bytes, so each is sent to one key per choice of the other
    bytes; a key's members are at most 256 to the power ``radius`` different fingerprints. They are
    compared bit-sliced, and only the links of a spanning forest leave a cell.
    """
    prints = durable(fingerprints(docs, id_col, text_col, width))
    members, path = stored(prints.groupBy("fp").agg(F.min("id").alias("first")))
    links = near_edges(members, pigeonhole_keys("fp", 8, radius), radius)
    out = label_rows(prints, members, connected_components(links))
    out, _ = stored(out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.col("best").alias("component_id")))
    removed(docs.sparkSession, path)
    return out


def shingle_sets(members: DataFrame, docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """``fp, s``: the distinct shingles, in order, of each of ``members`` (``fp, h``), whose texts all have the same.

    ``h`` is a hash of the one text that is read into shingles, told by a filter of bounded size.
    Shingles are kept as the low 32 bits of their hashes: two different ones of a pair of texts of n
    shingles each fall together with probability n^2 / 2^32.
    """
    known, bits = broadcast_filter(members.select("h"), members.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_filter(known.value, bits, b.column(0).to_numpy().view(np.uint64))))
            sets = [np.unique(shingle_hashes(t.as_py(), width).astype(np.uint32)).view(np.int32) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32()))], ["h", "s"])

    rows = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h bigint, s array<int>")
    found = rows.join(members.select(F.col("h").alias("g"), "fp"), F.col("h") == F.col("g"))
    return found.groupBy("fp").agg(F.first("s").alias("s"))


def judged(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``src, dst, ok``: whether the texts have at least this Jaccard similarity of distinct shingles."""
    met = edges.join(sets.select(F.col("fp").alias("src"), F.col("s").alias("s_src")), "src")
    met = met.join(sets.select(F.col("fp").alias("dst"), F.col("s").alias("s_dst")), "dst")
    shared = F.size(F.array_intersect("s_src", "s_dst"))
    every = F.size("s_src") + F.size("s_dst") - shared
    return met.select("src", "dst", (shared >= similarity * every).alias("ok"))


def cross_links(fps: np.ndarray, label: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, nearest: int = 0) -> Iterator[tuple[int, int]]:
    """Links of at least ``similarity`` between members of different classes that connect all that such pairs within ``radius`` bits connect.

    Each member outside of the largest class is held against the members of other classes, nearest
    first: all of them, or the ``nearest``. ``sets`` are ordered and without repeats.
    """
    _, label, n = np.unique(label, return_inverse=True, return_counts=True)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    for q in np.nonzero(label != n.argmax())[0].tolist():
        d = np.bitwise_count(fps ^ fps[q]).sum(axis=1, dtype=np.int64)
        alike = np.minimum(size, size[q]) >= similarity * np.maximum(size, size[q])
        near = np.nonzero((d <= radius) & (label != label[q]) & alike)[0]
        near = near[np.argsort(d[near], kind="stable")]
        near = near[:nearest] if nearest else near
        while len(near):
            at = max(1, int(np.searchsorted(size[near].cumsum(), PIECE, side="right")))
            some, near = near[:at], near[at:]
            flat = np.concatenate([sets[m] for m in some])
            place = np.minimum(np.searchsorted(sets[q], flat), size[q] - 1)
            shared = np.bincount(np.repeat(np.arange(len(some)), size[some]), sets[q][place] == flat, len(some))
            for m in some[shared >= similarity * (size[q] + size[some] - shared)].tolist():
                if label[m] != label[q]:
                    yield q, m
                    label[label == label[m]] = label[q]
            near = near[label[near] != label[q]]


def missed_links(trees: DataFrame, classes: DataFrame, sets: DataFrame, radius: int, similarity: float, nearest: int = NEAREST, cell: int = SET_CELL) -> DataFrame:
    """``(src, dst)``: links between different ``classes`` (``node, component``) of the members of one of ``trees`` (``tree, fp``).

    Trees of one class are left out; those with more than ``cell`` shingles are cut into chunks, of
    which each pair makes a cell of its own. A task holds the shingles of two chunks. Members are tried
    with the ``nearest`` others first, so that most fall together, then with all.
    """
    c = classes.select(F.col("node").alias("f"), "component")
    sizes = sets.select(F.col("fp").alias("g"), F.size("s").alias("n"))
    rows = trees.join(c, F.col("fp") == F.col("f"), "left").join(sizes, F.col("fp") == F.col("g")).select("tree", "fp", F.coalesce("component", "fp").alias("component"), "n")
    rows, path = stored(rows)
    several = rows.groupBy("tree").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.sum("n").alias("n")).where("a < b")
    several, several_path = stored(several.select(F.col("tree").alias("t"), F.ceil(F.col("n") / cell).cast("int").alias("chunks")))
    rows = rows.join(several, F.col("tree") == F.col("t")).withColumn("c", F.expr("pmod(xxhash64(fp), chunks)").cast("int"))
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.join(sets.withColumnRenamed("fp", "g"), F.col("fp") == F.col("g")).select("tree", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "fp", "component", "s")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("fp")
        names = rows["fp"].to_pylist()
        fps = np.frombuffer(b"".join(names), np.uint8).reshape(len(names), -1)[:, :-SET_BYTES]
        _, label = np.unique(np.array([x.hex() for x in rows["component"].to_pylist()]), return_inverse=True)
        sets = [s.values.to_numpy().view(np.uint32) for s in rows["s"]]
        found = [pair for some in (nearest, 0) for pair in cross_links(fps, label, sets, radius, similarity, some)]
        return pa.table({"src": pa.array([names[q] for q, _ in found], pa.binary()), "dst": pa.array([names[m] for _, m in found], pa.binary())})

    out = durable(rows.groupBy("tree", "i", "j").applyInArrow(run, "src binary, dst binary"))
    for p in (path, several_path):
        removed(sets.sparkSession, p)
    return out


def similar_links(edges: DataFrame, members: DataFrame, docs: DataFrame, text_col: str, width: int, similarity: float, radius: int) -> DataFrame:
    """Links of texts of at least this Jaccard similarity that connect all that such candidates connect.

    ``edges`` (``src, dst, tree``) are trees of what lies within the radius and shares a key. Where all
    of a tree's links hold, it is done. The members of the other trees that are still of different
    classes are compared by their shingles.
    """
    pairs = edges.select("src", "dst").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("f")).distinct()
    sets, path = stored(shingle_sets(durable(members.join(ends, F.col("fp") == F.col("f"), "left_semi").select("fp", "h")), docs, text_col, width))
    links = durable(judged(pairs, sets, similarity))
    good, bad = links.where("ok").select("src", "dst"), links.where("not ok").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    if not bad.isEmpty():
        classes = connected_components(good)
        failed, failed_path = stored(edges.join(bad, (F.col("src") == F.col("x")) & (F.col("dst") == F.col("y"))).select(F.col("tree").alias("t")).distinct())
        trees = edges.join(failed, F.col("tree") == F.col("t"), "left_semi").select("tree", F.explode(F.array("src", "dst")).alias("fp")).distinct()
        more = missed_links(trees, classes, sets, radius, similarity)
        removed(docs.sparkSession, failed_path)
        good = classes.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more)
    removed(docs.sparkSession, path)
    return good


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    n_bytes: int = 32,
    slack: float = 5.0,
    bands: int = 12,
) -> DataFrame:
    """One row per input row: ``id_col, component_id, kept``; near copies by word shingles of ``width``.

    Rows of the same distinct shingles fall together before anything is compared. Between the others that
    share the minimum hashes of a band, wide SimHashes of the distinct shingles are compared,
    bit-sliced, equal ones too. Two sets of Jaccard similarity s are at an angle of at most
    acos(2s / (1 + s)); the radius is the expected number of differing bits at ``similarity`` plus
    ``slack`` standard deviations. With twelve bands of two minimum hashes, a pair at 0.8 meets with
    probability 1 - 5e-6. The links of each cell's trees, nearest pairs first, are then held against
    the texts' distinct shingles. Where some are below ``similarity``, the other pairs within the radius
    between the classes that are left of the tree are held against them too, so that copies of one
    text that are less like each other still meet through it. One row of each component stays: the
    smallest id (a null id last; among repeated rows of it, one). Null, empty and blank texts have no
    shingles and are copies of each other. Texts of any length are read whole. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = n_bytes * 8
    radius = int(bits * p + slack * (bits * p * (1 - p)) ** 0.5)
    keyed_docs = docs.withColumn("id and hash", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    prints = fingerprints(keyed_docs, "id and hash", text_col, width, n_bytes, bands)
    prints = durable(prints.select("id.id", "id.h", "fp", "keys").withColumn("row", F.monotonically_increasing_id()))
    first = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    members, path = stored(prints.groupBy("fp").agg(F.min(first).alias("first"), F.min("h").alias("h"), F.first("keys").alias("keys")))
    edges = near_edges(members, F.col("keys"), radius, steps=4, n_bytes=n_bytes)
    links = similar_links(edges, members, docs, text_col, width, similarity, radius)
    out = label_rows(prints.select("id", "fp", "row"), members.select("fp", "first"), connected_components(links))
    out, _ = stored(out.select(F.col("id").alias(id_col), F.col("best.id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("kept")))
    removed(docs.sparkSession, path)
    return out
