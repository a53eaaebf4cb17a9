"""Exact top-k search by inner product (operator 9): a vector-approximation file.

Every vector is approximated by the cell it falls in: one byte per dimension
names one of 256 intervals between marks that all vectors share. The cells are
written as a file of their own, a small part of the exact vectors. From a cell
alone follows the inner product with a query up to a distance that depends on
the query only, so one product bounds it from both sides. The search

1. scans the cells: a task bounds a block of candidates for a block of queries
   and returns, for each query, what its own k-th lower bound does not rule out;
2. takes each query's k-th lower bound over all blocks and drops what lies below;
3. reads exact vectors in descending order of bound: the first k of each query,
   then those whose upper bound reaches the k-th exact score. Nothing unseen can
   then enter.

Queries and cells meet in blocks of fixed size, so no task holds more than two
blocks. Equal vectors are one class: only its k + 1 smallest ids can be among a
query's k best (one of them may be the query itself), the others are beaten by
them in every tie, so a vector that fills a third of the table costs no more than
k + 1 rows. Every query meets every block of cells, as an exact search without an
index of another kind must: the work is the product of their numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: A cell number fits a byte.
CELLS = 256
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 65_536
#: Distances bounded at once in a task.
_AT_ONCE = 4_000_000
#: Float64 sums of integer products are exact below this.
_EXACT = float(1 << 53)


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``id`` long and ``v`` array<long> of floor(scale * x).

    A row with a null id or vector, a null or non-finite component, or an empty
    vector takes no part.
    """
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    keep = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & ~bad
    return table.where(keep).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(scale))).alias("v"))


def cell_marks(vectors: DataFrame) -> DataFrame:
    """(d, low, width): for each dimension number the marks' start and distance, by coordinate."""
    at = vectors.select(F.size("v").alias("d"), F.posexplode("v").alias("p", "x")).groupBy("d", "p").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    at = at.withColumn("width", F.expr(f"greatest(1L, (high - low + {CELLS}) DIV {CELLS})"))
    row = F.array_sort(F.collect_list(F.struct("p", "low", "width")))  # one entry a coordinate
    return at.groupBy("d").agg(F.transform(row, lambda x: x["low"]).alias("low"), F.transform(row, lambda x: x["width"]).alias("width"))


def scan_block(a: np.ndarray, b: np.ndarray, h: np.ndarray, own: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int):
    """(query position, candidate position, twice the middle of the bounds) of what each
    query's k-th lower bound in the block does not rule out.

    Twice an inner product lies within ``h`` of ``a . cell + b``, for every query of the block."""
    if len(a) and len(cells) and float(np.abs(a).max()) * CELLS * a.shape[1] + float(np.abs(b).max()) >= _EXACT:
        raise ValueError("components are too large for exact inner products")
    cells = cells.astype(np.float64).T
    out = []
    step = max(1, _AT_ONCE // max(1, len(ids)))
    for s in range(0, len(a), step):
        mid = a[s : s + step].astype(np.float64) @ cells + b[s : s + step, None]
        mid[own[s : s + step, None] == ids[None, :]] = -np.inf
        n = mid.shape[1]
        least = np.partition(mid, n - k, axis=1)[:, n - k] if n > k else np.full(len(mid), -np.inf)
        q, c = np.nonzero((mid >= (least - 2 * h[s : s + step])[:, None]) & (mid > -np.inf))
        out.append((q + s, c, mid[q, c].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def _exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs with their exact inner products; reads the vectors of these pairs."""
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return pairs.join(queries.select("q", "qh", F.col("v").alias("qv")), ["q", "qh"]).join(vectors.select("id", "h", "v"), ["id", "h"]).select("q", "qh", "id", "h", "mid", "half", "r", dot.alias("score"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Each query's k highest inner products among all rows of another id.

    ``vectors`` and ``queries`` have ``id`` long and ``v`` array<long>. Result:
    ``query_id`` long, ``rank`` int from 1, ``vec_id`` long, ``score`` long; ties
    go to the smaller id. Fewer than k rows come back when fewer exist; a query
    meets only vectors of its own dimension. Rows that repeat an id of the same
    vector count once. Products must sum to less than 2**53.
    """
    hashed = F.struct(F.xxhash64("v"), F.xxhash64(F.lit(7), F.col("v")))
    vectors = vectors.withColumn("h", hashed)
    asked = queries.select(F.col("id").alias("q"), hashed.alias("qh"), "v").dropDuplicates(["q", "qh"])
    marks = stage(cell_marks(vectors.union(asked.select(F.col("q").alias("id"), "v", F.col("qh").alias("h")))), "marks")

    # the file of cells
    cell = F.transform(F.arrays_zip("v", "low", "width"), lambda x: ((x["v"] - x["low"]) / x["width"]).cast("int").cast("short"))
    celled = vectors.withColumn("d", F.size("v")).join(marks, "d").select("id", "h", "d", cell.alias("cells")).dropDuplicates(["id", "h"])
    first = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    cells = stage(celled.withColumn("r", first).where(F.col("r") <= k + 1).drop("r"), "cells")

    q = asked.withColumn("d", F.size("v")).join(marks, "d")
    z = F.arrays_zip("v", "low", "width")
    total = lambda f: F.aggregate(F.transform(z, f), F.lit(0).cast("long"), lambda acc, x: acc + x)
    q = q.select("q", "qh", "d", F.transform(z, lambda x: 2 * x["v"] * x["width"]).alias("a"), total(lambda x: x["v"] * (2 * x["low"] + x["width"] - 1)).alias("b"), total(lambda x: F.abs(x["v"]) * (x["width"] - 1)).alias("half"))
    n_c = max(1, -(-cells.count() // candidate_block))
    n_q = max(1, -(-asked.count() // query_block))
    left = q.select("*", F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    right = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_c)).cast("int").alias("cb"))

    def matrix(column, d: int) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten()).reshape(-1, d)

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return empty
        d = ours.column("d")[0].as_py()
        own, ids = np.asarray(ours.column("q")), np.asarray(theirs.column("id"))
        at, c, mid = scan_block(matrix(ours.column("a"), d), np.asarray(ours.column("b")), np.asarray(ours.column("half")), own, matrix(theirs.column("cells"), d), ids, k)
        ours, theirs = ours.take(at), theirs.take(c)
        return pa.table({"q": ours.column("q"), "qh": ours.column("qh").cast(hash_type), "id": theirs.column("id"), "h": theirs.column("h").cast(hash_type), "mid": pa.array(mid), "half": ours.column("half")})

    kind = "struct<col1:bigint,col2:bigint>"
    hash_type = pa.struct([("col1", pa.int64()), ("col2", pa.int64())])
    empty = pa.schema([("q", pa.int64()), ("qh", hash_type), ("id", pa.int64()), ("h", hash_type), ("mid", pa.int64()), ("half", pa.int64())]).empty_table()
    found = left.groupBy("d", "qb", "cb").cogroup(right.groupBy("d", "qb", "cb")).applyInArrow(meet, f"q long, qh {kind}, id long, h {kind}, mid long, half long")
    order = Window.partitionBy("q", "qh").orderBy(F.col("mid").desc(), "id")
    found = stage(found.withColumn("r", F.row_number().over(order)), "bounds")
    kth = found.where(F.col("r") == k).select("q", "qh", F.col("mid").alias("least"))
    found = found.join(kth, ["q", "qh"], "left").where(F.col("least").isNull() | (F.col("mid") >= F.col("least") - 2 * F.col("half"))).drop("least")

    sure = stage(_exact(found.where(F.col("r") <= k), asked, vectors), "first")
    reached = sure.groupBy("q", "qh").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
    maybe = found.where(F.col("r") > k).join(reached, ["q", "qh"]).where(F.col("mid") + F.col("half") >= 2 * F.col("least")).drop("least")
    every = sure.union(_exact(maybe, asked, vectors)).select(F.col("q").alias("query_id"), F.col("id").alias("vec_id"), "score").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
