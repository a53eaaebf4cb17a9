"""Trie of shared conversation prefixes, with subtree sums by pointer jumping.

A node is a distinct sequence of first turns. Every turn is hashed together with
its place, the digest of a prefix is the exclusive or of its turns' hashes
(two seeds, 128 bits), so that a running aggregate gives all prefixes, in blocks,
and a node's parent is its digest without the last turn's hash: edges need
no join. Leaves and savings then go up by doubling: in round r every node hands
its sum over 2^r levels to the ancestor 2^r levels above and takes over that
ancestor's pointer. A tree of depth d takes log2(d) rounds, each a written table.

Digests are taken as equal only if texts are; two different prefixes meet
with a chance of about n^2 / 2^129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, stage

#: Turns of a block of the running aggregates, and ids (by value) of a piece of a list of ends.
BLOCK, IDS = 4096, 1024


def numbered(turns: DataFrame) -> DataFrame:
    """``c``, ``p`` (its place from 1), ``k1``, ``k2`` (hashes of role and text) and ``bytes`` of every turn.

    Turns are in order of turn (null first), then role, then text; null roles and texts are empty; rows
    of null conv_id are left out. Places come from a range sort and the counts of each
    partition, so a conversation may be as long as it likes.
    """
    full = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["c", F.col("turn").asc_nulls_first(), "role", "text"]
    hashes = [F.xxhash64(F.lit(s), "role", "text").alias(f"k{s}") for s in (1, 2)]
    ranged = full.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stage(ranged.select("c", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), *hashes, F.octet_length("text").cast("long").alias("bytes")), "turns")
    # a conversation's rows of one partition stand at consecutive places
    runs = kept.groupBy("c", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select("c", "part", (F.coalesce(before, F.lit(0)) - F.col("low") + 1).alias("shift"))
    return kept.join(offsets, ["c", "part"]).select("c", (F.col("at") + F.col("shift")).alias("p"), "k1", "k2", "bytes")


def rebuild(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """All conversation ids ``c``, and the rebuilt turns ``c, d, k1, k2, bytes``: the first h turns
    of conversation c - c % ``family``, h = crc32(c) % ``heads``, then c's own after its first h."""
    with_h = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) % heads).alias("h")
    ids = turns.select("c").distinct().select("c", (F.col("c") - F.col("c") % family).alias("s"), with_h("c"))
    tops = turns.where(F.col("p") < heads).select(F.col("c").alias("s"), "p", "k1", "k2", "bytes")
    head = ids.join(tops, "s").where("p <= h").select("c", F.col("p").alias("d"), "k1", "k2", "bytes")
    lengths = tops.groupBy("s").agg(F.count(F.lit(1)).alias("size"))
    cut = ids.join(lengths, "s", "left").select("c", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("given"))
    tail = turns.join(cut, "c").where("p > h").select("c", (F.col("p") - F.col("h") + F.col("given")).alias("d"), "k1", "k2", "bytes")
    return ids.select("c"), head.union(tail)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """``c``, ``d``, ``bytes``, the digests ``x1, x2`` of the first d turns and ``y1, y2`` of the d - 1 before."""
    placed = rebuilt.select("c", "d", "bytes", F.expr(f"d div {BLOCK}").alias("b"), *[F.xxhash64(F.lit(s), "d", f"k{s}").alias(f"e{s}") for s in (1, 2)])
    within = Window.partitionBy("c", "b").orderBy("d")
    runs = placed.select("*", *[_xor(f"e{s}").over(within).alias(f"r{s}") for s in (1, 2)])
    upto = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("c", "b").agg(*[_xor(f"e{s}").alias(f"t{s}") for s in (1, 2)])
    blocks = blocks.select("c", "b", *[F.coalesce(_xor(f"t{s}").over(upto), F.lit(0)).alias(f"t{s}") for s in (1, 2)])
    whole = runs.join(blocks, ["c", "b"]).select("c", "d", "bytes", "e1", "e2", *[F.col(f"r{s}").bitwiseXOR(F.col(f"t{s}")).alias(f"x{s}") for s in (1, 2)])
    return whole.select("c", "d", "bytes", "x1", "x2", *[F.col(f"x{s}").bitwiseXOR(F.col(f"e{s}")).alias(f"y{s}") for s in (1, 2)])


def _xor(name: str) -> Column:
    return F.expr(f"bit_xor({name})")


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over each node's subtree. ``nodes`` has the digest ``d, x1, x2``, the
    parent's ``y1, y2`` and the values; the root has depth 0. Rounds go on while a pointer is left."""
    state = stage(nodes.select("d", "x1", "x2", F.when(F.col("d") > 0, F.col("y1")).alias("y1"), F.when(F.col("d") > 0, F.col("y2")).alias("y2"), *values), "round")
    deepest = state.agg(F.max("d")).first()[0] or 0
    step = 1
    while step <= deepest:
        sent = state.where(F.col("d") >= step)
        sums = sent.groupBy((F.col("d") - step).alias("d"), F.col("y1").alias("x1"), F.col("y2").alias("x2")).agg(*[F.sum(v).alias(f"s_{v}") for v in values])
        # below depth 2 * step nobody has an ancestor that far
        jump = state.where(F.col("d") >= step).select((F.col("d") + step).alias("d"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("y1").alias("z1"), F.col("y2").alias("z2"))
        near = state.where(F.col("d") < 2 * step).withColumns({"y1": F.lit(None).cast("long"), "y2": F.lit(None).cast("long")})
        far = state.where(F.col("d") >= 2 * step).join(jump, ["d", "y1", "y2"]).select("d", "x1", "x2", F.col("z1").alias("y1"), F.col("z2").alias("y2"), *values)
        moved = near.select(*far.columns).union(far).join(sums, ["d", "x1", "x2"], "left")
        after = stage(moved.select("d", "x1", "x2", "y1", "y2", *[(F.col(v) + F.coalesce(f"s_{v}", F.lit(0))).alias(v) for v in values]), "round")
        drop_stage(state)
        state, step = after, 2 * step
    return state.select("d", "x1", "x2", *values)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; only the running hash is held."""
    key, running = None, None
    for batch in batches:
        done = []
        for d, x1, x2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if (d, x1, x2) != key:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (d, x1, x2), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield _rows(done)
    if key is not None:
        yield _rows([(*key, running.hexdigest())])


def _rows(done: list[tuple]) -> pa.RecordBatch:
    d, x1, x2, sha = zip(*done) if done else ([],) * 4
    return pa.record_batch([pa.array(d, pa.int64()), pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(sha, pa.string())], ["d", "x1", "x2", "ends_sha256"])


def ends(ids: DataFrame, steps: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end in a node, in order, joined by commas.

    Ids are gathered in pieces of at most ``IDS`` distinct values and hashed piece after
    piece, so a node where a third of all conversations end is a stream, never a list.
    """
    last = steps.groupBy("c").agg(F.max(F.struct("d", "x1", "x2")).alias("e")).select("c", "e.d", "e.x1", "e.x2")
    whole = ids.join(last, "c", "left").select("c", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("d", "x1", "x2")])
    piece = F.shiftright("c", IDS.bit_length() - 1)
    pieces = whole.groupBy("d", "x1", "x2", piece.alias("piece")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string"))).alias("ids"))
    return pieces.repartition("d", "x1", "x2").sortWithinPartitions("d", "x1", "x2", "piece").mapInArrow(_digests, "d long, x1 long, x2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node with its members, children and sums over its subtree.

    An empty table has no conversation and gives no node, not even the root.
    """
    ids, rebuilt = rebuild(stage(numbered(turns), "numbered"))
    ids = stage(ids, "ids")
    steps = stage(prefixes(rebuilt), "prefixes")
    inner = steps.groupBy("d", "x1", "x2").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"), F.min("bytes").alias("bytes"), F.min("y1").alias("y1"), F.min("y2").alias("y2"))
    none = F.lit(0).cast("long")
    root = ids.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 0").select(none.alias("d"), none.alias("x1"), none.alias("x2"), "c", "n", none.alias("bytes"), none.alias("y1"), none.alias("y2"))
    nodes = stage(inner.union(root), "nodes")
    family = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("y1").alias("x1"), F.col("y2").alias("x2")).agg(F.count(F.lit(1)).alias("children"))
    nodes = nodes.join(family, ["d", "x1", "x2"], "left").withColumn("children", F.coalesce("children", none))
    nodes = stage(nodes.withColumns({"leaves": (F.col("children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("bytes")}), "children")
    sums = roll_up(nodes, ["leaves", "saved"])
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("c").alias("parent_conv_id"))
    keyed = nodes.drop("leaves", "saved")
    out = keyed.where("d > 0").join(above, ["d", "y1", "y2"]).select(*keyed.columns, "parent_conv_id").union(keyed.where("d = 0").select("*", F.lit(None).cast("long")))
    out = out.join(sums, ["d", "x1", "x2"]).join(ends(ids, steps), ["d", "x1", "x2"], "left")
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), sha.alias("ends_sha256"))
