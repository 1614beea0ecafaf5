"""The prefix trie of conversations, its totals by peeling off finished leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.text import word_count
from tessera.session import prepare, removed, stored

#: Places of a path that one task sums, and ids that one string of an end list holds at most, as bits.
PIECE_BITS, LIST_BITS = 12, 10
#: A path of n conversations is crossed by some ln(n) spines; so many rounds are never needed.
MAX_ROUNDS = 400


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, str]:
    """``c, pos, key, words``: each conversation's turns, numbered from 1, and the path of the table behind them.

    Turns go by ``turn`` (null first), then role, then the MD5 of role and text; null role or text is
    empty; rows without ``conv_id`` are left out. Places come from range partitions and their counts:
    a conversation of any length is numbered in pieces. Only the first conversation of a partition can
    have begun in an earlier one, so there are at most as many starts as partitions.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), key.alias("key"), word_count(text).alias("words"))
    rows = rows.where("c is not null").withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("tie")]
    rows, path = stored(rows.repartitionByRange("c", *order).withColumn("p", F.spark_partition_id()))
    starts = rows.groupBy("c", "p").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("c").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    starts = starts.select(F.col("c").alias("sc"), F.col("p").alias("sp"), before.alias("start")).where("start > 0")
    here = F.row_number().over(W.partitionBy("c", "p").orderBy(*order))
    met = rows.withColumn("here", here).join(F.broadcast(starts), (F.col("c") == F.col("sc")) & (F.col("p") == F.col("sp")), "left")
    return met.select("c", (F.col("here") + F.coalesce("start", F.lit(0))).alias("pos"), "key", "words"), path


def rebuilt(turns: DataFrame, every: int, most: int) -> DataFrame:
    """``c, depth, key, words, len``: the turns of each rebuilt conversation, with a row of depth 0 for each, and its length.

    The first h turns are those of conversation ``c - c % every`` (all if it has fewer), then come the
    own turns after the first h; h is crc32 of the id as text modulo ``most``.
    """
    own = turns.groupBy("c").agg(F.count("*").alias("n"))
    own = own.withColumn("h", (F.crc32(F.col("c").cast("string")) % most).cast("int")).withColumn("base", F.col("c") - F.col("c") % every)
    first = turns.where((F.col("c") % every == 0) & (F.col("pos") < most))
    lead = first.groupBy(F.col("c").alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("lead"))
    each = own.join(lead, F.col("base") == F.col("b"), "left").withColumn("lead", F.slice(F.coalesce("lead", F.array().cast(dict(lead.dtypes)["lead"])), F.lit(1), F.col("h")))
    each = each.withColumn("m", F.size("lead")).withColumn("len", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    shared = each.select("c", F.explode("lead").alias("t"), "len").select("c", F.col("t.pos").alias("depth"), "t.key", "t.words", "len")
    ends = each.select(F.col("c").alias("e"), "h", "m", "len")
    rest = turns.join(ends, (F.col("c") == F.col("e")) & (F.col("pos") > F.col("h")))
    rest = rest.select("c", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "key", "words", "len")
    roots = each.select("c", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("key"), F.lit(0).alias("words"), "len")
    parts = [x.select("c", F.col("depth").cast("long").alias("depth"), "key", F.col("words").cast("long").alias("words"), F.col("len").cast("long").alias("len")) for x in (shared, rest, roots)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def along(rows: DataFrame, path: str, values: dict[str, Column], down: bool) -> DataFrame:
    """Add running aggregates over the rows of each ``path`` by ``depth``, from its top (``down``) or from its end.

    Paths are cut in pieces of ``2 ** PIECE_BITS`` places; what earlier pieces give is joined to them, so
    that no task holds more than a piece, or a row for each piece of one path.
    """
    rows = rows.withColumn("piece", F.shiftright("depth", PIECE_BITS))
    turned = (lambda c: F.col(c).asc()) if down else (lambda c: F.col(c).desc())
    within = W.partitionBy(path, "piece").orderBy(turned("depth")).rowsBetween(W.unboundedPreceding, 0)
    kinds = {n: F.bit_xor if down else F.sum for n in values}
    pieces = rows.groupBy(path, "piece").agg(*[kinds[n](v).alias(n) for n, v in values.items()])
    earlier = W.partitionBy(path).orderBy(turned("piece")).rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(F.col(path).alias("of"), F.col("piece").alias("at piece"), *[kinds[n](F.col(n)).over(earlier).alias(f"{n} before") for n in values])
    pieces = pieces.where(" or ".join(f"`{n} before` is not null" for n in values))
    met = rows.select("*", *[kinds[n](v).over(within).alias(f"{n} here") for n, v in values.items()])
    met = met.join(pieces, (F.col(path) == F.col("of")) & (F.col("piece") == F.col("at piece")), "left")
    both = {n: (F.col(f"{n} here"), F.coalesce(F.col(f"{n} before"), F.lit(0))) for n in values}
    for n, (here, before) in both.items():
        met = met.withColumn(n, here.bitwiseXOR(before.cast("long")) if down else here + before)
    return met.drop("piece", "of", "at piece", *[f"{n} {w}" for n in values for w in ("here", "before")])


def end_lists(rows: DataFrame) -> DataFrame:
    """``depth, h1, h2, ends``: the SHA-256 of the ids of the conversations that end at a node, in order, joined by commas.

    Ids of one range make one string, so that no list of a node is gathered; SHA-256 takes a text from
    front to back, so the strings of a node, each of some 10 KB, stream through one task in order.
    """
    parts = rows.where("depth = len").groupBy("depth", "h1", "h2", F.shiftright("c", LIST_BITS).alias("part"))
    parts = parts.agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []
        for b in batches:
            for *at, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "h1", "h2", "ids")), strict=True):
                if at == node:
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256()
                digest.update(ids.encode())
            yield batch(done)
            done = []
        if node:
            yield batch([(*node, digest.hexdigest())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True)], ["depth", "h1", "h2", "ends"])

    dealt = parts.repartition("depth", "h1", "h2").sortWithinPartitions("depth", "h1", "h2", "part")
    return dealt.mapInArrow(run, "depth bigint, h1 bigint, h2 bigint, ends string")


def peeled(spines: DataFrame) -> tuple[DataFrame, list[str]]:
    """``s, up, at, saved, leaves`` with the totals of all that hangs on a spine, and the paths of the tables behind them.

    ``spines`` has these columns (``up`` and ``at`` are the spine and depth that it hangs on). A spine counts the spines that
    hang on it; when the counter is zero, it sends its totals up and is done, until only the root's is left and finishes.
    """
    spark = spines.sparkSession
    counts = spines.where("up is not null").groupBy(F.col("up").alias("u")).agg(F.count("*").alias("waiting"))
    state, path = stored(spines.join(counts, F.col("s") == F.col("u"), "left").drop("u").fillna(0, ["waiting"]))
    done, paths = [], [path]
    for _ in range(MAX_ROUNDS):
        ended = state.where("waiting = 0").drop("waiting")
        done.append(ended)
        sent = ended.where("up is not null").groupBy(F.col("up").alias("u"))
        sent = sent.agg(F.count("*").alias("n"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        left = state.where("waiting > 0").join(sent, F.col("s") == F.col("u"), "left").fillna(0, ["n", "more_saved", "more_leaves"])
        left = left.select("s", "up", "at", (F.col("saved") + F.col("more_saved")).alias("saved"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("waiting") - F.col("n")).alias("waiting"))
        state, path = stored(left)
        if state.isEmpty():
            removed(spark, path)
            break
        paths.append(path)
    else:
        raise RuntimeError("peeled: the root has not finished")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, paths


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a sequence of (role, text) that a rebuilt conversation starts with (see ``rebuilt``), from
    the textless root on; ``conv_id`` is its smallest member. Conversations are ordered as
    ``numbered_turns`` says; null role or text is empty, repeated rows are turns of their own, rows
    without ``conv_id`` are left out, texts are read whole, other columns are ignored. A conversation
    none of whose turns is left is a member of the root. An empty table gives an empty result.

    A sequence is known by its depth and 128 bits, the exclusive or of a hash of each turn and its
    place. Of a node's members the one with the least hash of its id names the node's spine. A
    conversation's nodes at and below the place where it takes the lead are one spine; by the hash a
    path of n conversations changes spines some ln(n) times, so leaves are peeled off in so many
    rounds, however deep the trie is: a finished spine sends its totals to the node it hangs on. Totals
    within a spine are running sums from its end.
    """
    spark = conversations.sparkSession
    prepare(spark)
    turns, turns_path = numbered_turns(conversations)
    turns, numbered_path = stored(turns)
    removed(spark, turns_path)
    rows = rebuilt(turns, every, most)
    x = {f"h{k}": F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "key")) for k in (1, 2)}
    rows = rows.select("*", *[v.alias(f"x{k[1]}") for k, v in x.items()])
    rows = along(rows, "c", {"h1": F.col("x1"), "h2": F.col("x2")}, down=True)
    rows, rows_path = stored(rows.select("c", "depth", "h1", "h2", "x1", "x2", "words", "len"))
    removed(spark, numbered_path)
    nodes = rows.groupBy("depth", "h1", "h2").agg(
        F.min("c").alias("m"), F.min(F.xxhash64("c")).alias("s"), F.count("*").alias("n"), F.max("x1").alias("x1"), F.max("x2").alias("x2"), F.max("words").alias("words")
    )
    ends = end_lists(rows).select(F.col("depth").alias("d"), F.col("h1").alias("e1"), F.col("h2").alias("e2"), "ends")
    nodes = nodes.join(ends, (F.col("depth") == F.col("d")) & (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")), "left").drop("d", "e1", "e2")
    nodes, nodes_path = stored(nodes)
    above = nodes.select((F.col("depth") + 1).alias("d"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("m").alias("pm"), F.col("s").alias("ps"))
    parent = (F.col("depth") == F.col("d")) & (F.col("h1").bitwiseXOR(F.col("x1")) == F.col("p1")) & (F.col("h2").bitwiseXOR(F.col("x2")) == F.col("p2"))
    tree, tree_path = stored(nodes.join(above, parent, "left").select("s", "depth", "m", "n", "words", "ends", "pm", "ps"))
    kids = tree.where("ps is not null").groupBy(F.col("ps").alias("ks"), (F.col("depth") - 1).alias("kd")).agg(F.count("*").alias("n_children"))
    tree = tree.join(kids, (F.col("s") == F.col("ks")) & (F.col("depth") == F.col("kd")), "left").drop("ks", "kd").fillna(0, ["n_children"])
    tree = tree.withColumn("saved", (F.col("n") - 1) * F.col("words")).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    tree, known_path = stored(tree)
    up = F.col("ps").isNotNull() & (F.col("ps") != F.col("s"))
    spines = tree.groupBy("s").agg(
        F.max(F.when(up, F.col("ps"))).alias("up"), F.max(F.when(up, F.col("depth") - 1)).alias("at"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    )
    totals, paths = peeled(spines)
    hung = totals.where("up is not null").groupBy(F.col("up").alias("us"), F.col("at").alias("ud")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    tree = tree.join(hung, (F.col("s") == F.col("us")) & (F.col("depth") == F.col("ud")), "left").drop("us", "ud").fillna(0, ["more_saved", "more_leaves"])
    tree = along(tree, "s", {"saved_tokens": F.col("saved") + F.col("more_saved"), "n_leaves": F.col("leaves") + F.col("more_leaves")}, down=False)
    none = hashlib.sha256(b"").hexdigest()
    out, _ = stored(
        tree.select(
            F.col("m").alias("conv_id"),
            "depth",
            F.col("pm").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
        )
    )
    for p in (rows_path, nodes_path, tree_path, known_path, *paths):
        removed(spark, p)
    return out
