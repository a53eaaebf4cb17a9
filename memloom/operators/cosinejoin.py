"""Exact join of vectors above a cosine, within a label, and what stands on it.

Angles between unit vectors obey the triangle inequality, so two vectors whose
angles to any third one, a pivot, differ by more than the threshold's angle are not
similar. Vectors go to the cell of their nearest pivot and, within it, to blocks of
a bounded number of rows; blocks whose intervals of angles to any pivot are
too far apart never meet. What meets is multiplied block by block in Arrow batches.

Vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do null labels; vectors of different lengths are never similar. Equal ids make no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import fresh_path

#: Added to bounds, which are angles of rounded products.
SLACK = 1e-6
KEY = ["label", "dim"]
#: Pairs that wait before only the best are kept.
TOP = 1_000_000


def _stage(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _measured(vectors: DataFrame) -> DataFrame:
    """``id``, ``label``, ``dim``, the vector ``v`` (of floats, or of doubles) and its length ``norm``, where it takes part."""
    kind = "array<float>" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "array<double>"
    whole = vectors.select("id", "label", F.size("v").alias("dim"), F.col("v").cast(kind).alias("v")).where("label IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e150D)")
    square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    return whole.withColumn("norm", F.sqrt(square)).where("norm > 0")


def usable(vectors: DataFrame) -> DataFrame:
    """``id``, ``label``, ``dim`` and ``u``, the vector at length 1."""
    return _measured(vectors).select("id", "label", "dim", F.transform(F.col("v").cast("array<double>"), lambda x: x / F.col("norm")).alias("u"))


def _pivots(vectors: DataFrame, most: int) -> list[np.ndarray]:
    """At most ``most`` vectors, the same ones whatever the partitions: a bounded sample, which only moves the bounds."""
    return [np.array(r.u) for r in vectors.orderBy(F.xxhash64("id", "label"), "id", "u").limit(most).select("u").collect()]


def _angles(pivots: list[np.ndarray], u: np.ndarray) -> np.ndarray:
    """Angles of unit vectors to all pivots; a pivot of another length is cut or repeated to fit, any point serves."""
    p = np.array([np.resize(x, u.shape[1]) for x in pivots])
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)
    return np.arccos(np.clip(u @ p.T, -1, 1))


def _units(v: pa.ListArray, norm: np.ndarray) -> np.ndarray:
    return v.flatten().to_numpy().astype(float).reshape(len(norm), -1) / norm[:, None]


def _near(pivots: list[np.ndarray], cells: int):
    """The nearest of the first ``cells`` pivots, and the band of the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, norm = batch.column("dim").to_numpy(), batch.column("norm").to_numpy()
            cell, band = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                angles = _angles(pivots[:cells], _units(batch.column("v").take(pa.array(at)), norm[at]))
                cell[at] = angles.argmin(axis=1)
                band[at] = np.floor(angles[np.arange(len(at)), cell[at]] * 16)
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(band)], [*batch.schema.names, "cell", "band"])

    return run


def _block(pivots: list[np.ndarray]):
    """One row for a block: ids, vectors as they are given with their lengths, and the least and greatest angle to each pivot."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        v, norm = rows["v"].combine_chunks(), rows["norm"].to_numpy()
        angles = _angles(pivots, _units(v, norm))
        one = lambda name: rows[name].slice(0, 1).combine_chunks()
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (rows["id"].to_numpy().astype(np.int64), v.flatten().to_numpy(), norm)]
        return pa.table([one("label"), one("dim"), one("cell"), *packed, pa.array([angles.min(axis=0)]), pa.array([angles.max(axis=0)])], ["label", "dim", "cell", "ids", "vectors", "norms", "low", "high"])

    return run


def _unpacked(dim: int, ids: bytes, vectors: bytes, norms: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids and unit vectors."""
    norm = np.frombuffer(norms)
    kind = np.float32 if len(vectors) == 4 * dim * len(norm) else np.float64
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).astype(float).reshape(-1, dim) / norm[:, None]


def blocks(vectors: DataFrame, rows: int | None = None) -> DataFrame:
    """Blocks of at most about ``rows`` vectors of a label, length and cell; larger cells are split into
    bands of angles to their pivot, larger bands by hash. The number of cells follows the rows, so that blocks are full.
    By default a block has 512 rows, or more where there would be over some 2048 blocks, since pairs of blocks are compared.
    Vectors are shuffled once, as they are given; angles stay where they are computed."""
    kept = _measured(vectors)
    n = kept.count()
    rows = rows or max(512, n // 2048)
    pivots = _pivots(usable(vectors), min(256, max(16, math.isqrt(n) // 4)))
    placed = kept.mapInArrow(_near(pivots, max(1, math.isqrt(n // rows))), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", cell int, band int")
    counts = placed.groupBy(*KEY, "cell", "band").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy(*KEY, "cell"))
    counts = counts.select("*", F.when(size > rows, F.col("band")).otherwise(0).alias("own"))
    place = [*KEY, "cell", "own"]
    parts = _stage(counts.select(*place, "band", F.ceil(F.sum("n").over(Window.partitionBy(*place)) / rows).alias("parts")), "parts")
    split = placed.join(parts, [*KEY, "cell", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    label = kept.schema["label"].dataType.simpleString()
    packed = split.select("id", "v", "norm", *place, "part").groupBy(*place, "part").applyInArrow(_block(pivots), f"label {label}, dim int, cell int, ids binary, vectors binary, norms binary, low array<double>, high array<double>")
    return _stage(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _meet(reach: float):
    """Pairs ``x <= y`` of a label's blocks whose angles to no pivot are further apart than ``reach``."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        block = np.sort(rows["block"].to_numpy())
        order = np.argsort(rows["block"].to_numpy())
        low, high = (np.stack(rows[c].to_numpy(zero_copy_only=False))[order] for c in ("low", "high"))
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(len(block)):
            gap = np.maximum(low[k] - high[k:], low[k:] - high[k]).max(axis=1, initial=-np.inf)
            y = block[k:][gap <= reach]
            pairs.append((np.full(len(y), block[k]), y))
        x, y = map(np.concatenate, zip(*pairs, strict=True))
        return pa.table([pa.array(x), pa.array(y)], ["x", "y"])

    return run


def meeting(packed: DataFrame, least: float) -> DataFrame:
    """Pairs ``x <= y`` of blocks that no pivot keeps apart. Only the blocks' angles travel, and a label's are compared
    in one task: blocks are some thousands in all, whatever the number of vectors."""
    reach = math.acos(max(-1.0, min(1.0, least))) + SLACK
    return packed.select(*KEY, "block", "low", "high").groupBy(*KEY).applyInArrow(_meet(reach), "x long, y long")


def tiles(packed: DataFrame, near: DataFrame) -> DataFrame:
    """What tasks read: blocks in up to six tiles a label (4 to 256 blocks each), and every pair of tiles with blocks that meet once, whatever the number of pairs of blocks.

    A row is a block (``side`` 1 or 2) of the pair ``ta, tb`` of tiles, or the list of its blocks that meet (``side`` 0)."""
    own = Window.partitionBy(*KEY)
    lean = packed.select(*KEY, "cell", "block").select(*KEY, "block", F.row_number().over(own.orderBy("cell", "block")).alias("r"), F.count(F.lit(1)).over(own).alias("n"))
    lean = lean.select(*KEY, "block", F.floor((F.col("r") - 1) / F.greatest(F.lit(4), F.least(F.lit(256), F.ceil(F.col("n") / 6)))).alias("t"))
    tile = lean.select("block", F.min("block").over(Window.partitionBy(*KEY, "t")).alias("tile"))
    of = lambda s: tile.select(F.col("block").alias(s), F.col("tile").alias(f"t{s}"))
    met = near.join(of("x"), "x").join(of("y"), "y")
    flip = F.col("tx") > F.col("ty")
    met = met.select(F.least("tx", "ty").alias("ta"), F.greatest("tx", "ty").alias("tb"), F.when(flip, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(flip, F.col("x")).otherwise(F.col("y")).alias("y"))
    lists = _stage(met.groupBy("ta", "tb").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys")), "tiles")
    first = lists.select("ta", "tb", F.lit(1).alias("side"), F.explode(F.array_distinct(F.when(F.col("ta") == F.col("tb"), F.concat("xs", "ys")).otherwise(F.col("xs")))).alias("block"))
    second = lists.where("ta < tb").select("ta", "tb", F.lit(2).alias("side"), F.explode(F.array_distinct("ys")).alias("block"))
    sent = first.union(second).join(packed.select("block", "dim", "ids", "vectors", "norms"), "block")
    rows = sent.unionByName(lists.withColumn("side", F.lit(0)), True).select("ta", "tb", "side", "block", "dim", "ids", "vectors", "norms", "xs", "ys")
    return rows.repartition("ta", "tb").sortWithinPartitions("ta", "tb", "side", "block")


def _best(pairs: list[tuple[np.ndarray, ...]], hits: int) -> tuple[np.ndarray, ...]:
    """Of pairs (a, b, s) the ``hits`` of greatest s of each b, then of least a."""
    a, b, s = map(np.concatenate, zip(*pairs, strict=True))
    order = np.lexsort((a, -s, b))
    a, b, s = a[order], b[order], s[order]
    keep = np.arange(len(b)) - np.searchsorted(b, b) < hits
    return a[keep], b[keep], s[keep]


def _products(least: float, forest: bool = False, hits: int | None = None):
    """Similar pairs of every block with those before it; with ``forest``, of each part of a pair of tiles that they connect,
    a star from its smallest id: no more rows than ids, and no long ways between them. With ``hits``, of a pair of tiles
    only so many pairs of each greater id."""

    def root(parent: dict, k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(parent: dict, i: np.ndarray, j: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        p, q = (np.array([root(parent, parent.setdefault(int(k), int(k))) for k in ids]) for ids in (i, j))
        p, q = p[at], q[to]
        for x, y in np.unique(np.column_stack([p[p != q], q[p != q]]), axis=0).tolist():
            x, y = root(parent, x), root(parent, y)
            parent[max(x, y)] = min(x, y)

    def stars(parent: dict) -> Iterator[pa.RecordBatch]:
        ends = np.array([(root(parent, k), k) for k in parent if parent[k] != k], np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.nulls(len(ends), pa.float64())], ["a", "b", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, meets, stored, parent, top = None, {}, {}, {}, []
        for batch in batches:
            for row in range(batch.num_rows):
                ta, tb, side, block, dim, ids, vectors, norms, xs, ys = (c[row].as_py() for c in batch.columns)
                if side == 0 or held != (ta, tb):
                    if parent:
                        yield from stars(parent)
                    if top:
                        yield pa.record_batch([*map(pa.array, _best(top, hits))], ["a", "b", "s"])
                    held, meets, stored, parent, top = (ta, tb), {}, {}, {}, []
                    for x, y in zip(xs, ys):
                        meets.setdefault(y, set()).add(x)
                        if ta == tb:
                            meets.setdefault(x, set()).add(y)
                    continue
                j, w = _unpacked(dim, ids, vectors, norms)
                if side == 1:
                    stored[block] = (j, w)
                    if ta != tb:
                        continue
                found = []
                for x in sorted(meets.get(block, ())):
                    if x not in stored:
                        continue
                    i, u = stored[x]
                    s = u @ w.T
                    at, to = np.nonzero(s >= least)
                    keep = i[at] != j[to]
                    if x == block:
                        keep &= at < to
                    at, to = at[keep], to[keep]
                    if forest:
                        join(parent, i, j, at, to)
                        continue
                    pair = np.minimum(i[at], j[to]), np.maximum(i[at], j[to]), s[at, to]
                    if hits is None:
                        found.append(pa.record_batch([*map(pa.array, pair)], ["a", "b", "s"]))
                        continue
                    top.append(pair)
                    if sum(len(a) for a, _, _ in top[1:]) > max(TOP, len(top[0][0])):
                        top = [_best(top, hits)]
                if found:
                    yield from pa.Table.from_batches(found).combine_chunks().to_batches()
        if parent:
            yield from stars(parent)
        if top:
            yield pa.record_batch([*map(pa.array, _best(top, hits))], ["a", "b", "s"])

    return run


def similar(vectors: DataFrame, least: float, forest: bool = False, hits: int | None = None) -> DataFrame:
    """Pairs ``a < b`` of ids of a label with cosine ``s`` >= ``least``. A repeated row pairs anew; an empty table gives none.
    With ``forest``, pairs (without ``s``) that connect the same ids, at most some seven times as many as there are rows.
    With ``hits``, the pairs among which are the so many best of each ``b`` (ties to the smaller ``a``), no more than some seven times these."""
    packed = blocks(vectors)
    near = _stage(meeting(packed, least), "meeting")
    return tiles(packed, near).mapInArrow(_products(least, forest, hits), "a long, b long, s double")


def pairs(vectors: DataFrame, least: float = 0.3) -> DataFrame:
    return similar(vectors, least).select("a", "b", F.round("s", 8).alias("s"))


def write_gate(vectors: DataFrame, dup: float = 0.3, skip: float = 0.4, hits: int = 10) -> DataFrame:
    """What to do with each vector, given those of smaller id: among its ``hits`` best, those above ``dup`` are duplicates.
    None: store; exactly one, above ``skip``: skip; else update. Vectors that take no part are stored."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("s"), "a"))
    best = similar(vectors, dup, hits=hits).where(F.col("s") > dup).select("b", "s", rank.alias("r")).where(F.col("r") <= hits)
    found = best.groupBy(F.col("b").alias("id")).agg(F.max("s").alias("top"), F.count(F.lit(1)).alias("n"))
    action = F.when(F.col("n").isNull(), "store").when((F.col("n") == 1) & (F.col("top") > skip), "skip").otherwise("update")
    return vectors.select("id").join(found, "id", "left").select("id", action.alias("action"))


def service_gate(vectors: DataFrame, exact: float = 0.4, near: float = 0.3) -> DataFrame:
    """The same for the service, for each vector that has an earlier one of its label: at ``exact`` skip, at ``near`` update, else store."""
    first = Window.partitionBy("label")
    later = usable(vectors).select("id", F.min("id").over(first).alias("low")).where("id > low").select("id").distinct()
    top = similar(vectors, near).groupBy(F.col("b").alias("id")).agg(F.max("s").alias("top"))
    action = F.when(F.col("top") >= exact, "skip").when(F.col("top") >= near, "update").otherwise("store")
    return later.join(top, "id", "left").select("id", action.alias("action"))


def near_duplicates(vectors: DataFrame, low: float = 0.3, high: float = 0.5) -> DataFrame:
    return similar(vectors, low).where(F.col("s") < high).select("a", "b", F.round("s", 8).alias("s"), F.least("a", "b").alias("keep"))


def relations(vectors: DataFrame, least: float = 0.3, close: float = 0.4) -> DataFrame:
    return similar(vectors, least).select("a", "b", F.when(F.col("s") >= close, "similar_to").otherwise("related_to").alias("relation"))


def warnings(vectors: DataFrame, low: float = 0.3, high: float = 0.45) -> DataFrame:
    sure = (F.col("s") - low) / F.lit(0.15)
    return similar(vectors, low).where(F.col("s") < high).select("a", "b", F.round(sure, 8).alias("confidence"))


def quality(vectors: DataFrame) -> DataFrame:
    """Mean cosine of all pairs of each label, without a pair: |sum of unit vectors|^2 = n + 2 x the sum over pairs."""
    units = usable(vectors)
    sums = units.select("label", F.posexplode("u").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("t"))
    squares = sums.groupBy("label").agg(F.sum(F.col("t") * F.col("t")).alias("q"))
    n = units.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mean = (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    pairs_ = F.expr("n * (n - 1) div 2").alias("pairs")
    return n.join(squares, "label").select("label", pairs_, F.round(mean, 8).alias("cohesion"), F.round(1 - mean, 8).alias("diversity"))
