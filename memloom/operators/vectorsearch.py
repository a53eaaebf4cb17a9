"""Cosine search of queries against all vectors, block by block in Arrow batches.

Similarities are rounded to nine digits before they rank, ties go to the smaller id. A pair with a vector that
is null, zero or holds null or non-finite components, or of two lengths, has no similarity and ranks last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import fresh_path
from .grouppairs import TILES, product

#: Stands for no similarity.
NONE = -2.0


def _stage(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _block(rows: pa.Table) -> pa.Table:
    """One row for a block: ids, lengths (0 for a vector that takes no part) and vectors at length 1."""
    rows = rows.sort_by("id").combine_chunks()
    lengths = rows["dim"].to_numpy().astype(np.int32)
    flat = rows["u"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pa.table([pa.array([rows["id"].to_numpy().astype(np.int64).tobytes()]), pa.array([lengths.tobytes()]), pa.array([flat.tobytes()])], ["ids", "lengths", "vectors"])


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks of at most about ``rows`` rows, each packed by one task."""
    n = vectors.count()
    v = F.col("v").cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    good = F.expr("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e150)")
    whole = vectors.select("id", F.coalesce(F.when(good, v), F.array().cast("array<double>")).alias("v")).select("id", "v", norm.alias("norm"))
    units = whole.select("id", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.array().cast("array<double>")).alias("u"))
    dealt = units.select("id", F.size("u").alias("dim"), "u", F.pmod(F.xxhash64("id"), F.lit(-(-n // rows) or 1)).alias("part"))
    return _stage(dealt.groupBy("part").applyInArrow(_block, "ids binary, lengths binary, vectors binary"), name)


def _unpack(ids: bytes, lengths: bytes, vectors: bytes) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids, and for each length the places and vectors of that length."""
    ids, lengths, flat = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int32), np.frombuffer(vectors)
    starts = np.cumsum(lengths) - lengths
    of = {}
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        of[int(dim)] = at, flat.reshape(-1, dim) if len(at) == len(ids) else flat[starts[at][:, None] + np.arange(dim)]
    return ids, of


def _found(k: int | None, least: float | None, cells: int = 4_000_000):
    """Of each query and block the ``k`` best rows, or all at ``least`` and over; ``cells`` similarities at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, of = _unpack(*(c[row].as_py() for c in batch.columns[:3]))
                asked, queries = _unpack(*(c[row].as_py() for c in batch.columns[3:]))
                step = max(1, cells // max(1, len(ids)))
                for start in range(0, len(asked), step):
                    own = asked[start : start + step]
                    s = np.full((len(own), len(ids)), NONE)
                    for dim in of.keys() & queries.keys():
                        (at, v), (to, q) = of[dim], queries[dim]
                        here = (to >= start) & (to < start + step)
                        if here.any():
                            s[np.ix_(to[here] - start, at)] = np.round(q[here] @ v.T, 9)
                    other = own[:, None] != ids[None, :]
                    if k is None:
                        i, j = np.nonzero((s >= least) & other)
                    else:
                        # ids ascend within a block, so a stable sort breaks ties by id
                        masked = np.where(other, -s, np.inf)
                        if k < len(ids):
                            bound = np.partition(masked, k - 1, axis=1)[:, k - 1 : k]
                            i, j = np.nonzero((masked <= bound) & other)
                            order = np.lexsort((j, masked[i, j], i))
                            i, j = i[order], j[order]
                            place = np.arange(len(i)) - np.searchsorted(i, i)
                            i, j = i[place < k], j[place < k]
                        else:
                            i, j = np.nonzero(other)
                    yield pa.record_batch([pa.array(own[i]), pa.array(ids[j]), pa.array(s[i, j])], ["qid", "id", "sim"])

    return run


def _search(queries: DataFrame, vectors: DataFrame, k: int | None, least: float | None) -> DataFrame:
    n = vectors.count()
    packed, asked = _blocks(vectors, min(32768, max(1024, n // 64)), "vectors"), _blocks(queries, 4096, "queries")
    both = packed.repartition(max(1, min(4096, n // 1024))).crossJoin(asked.toDF("q_ids", "q_lengths", "q_vectors"))
    return both.mapInArrow(_found(k, least), "qid long, id long, sim double")


def top(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(qid, id, sim) of the ``k`` most similar rows of each query, its own id left out. Both: id, v."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id"))
    best = _search(queries, vectors, k, None).withColumn("r", rank).where(F.col("r") <= k)
    return best.select("qid", "id", F.round(F.when(F.col("sim") > NONE, F.col("sim")), 8).alias("sim"))


def above(queries: DataFrame, vectors: DataFrame, least: float = 0.2) -> DataFrame:
    """(qid, id, sim) of all rows at least as similar to a query, its own id left out."""
    return _search(queries, vectors, None, least).select("qid", "id", F.round("sim", 8).alias("sim"))


def dispatch(vectors: DataFrame, tiles: int = TILES) -> DataFrame:
    """(qid, id, mode) of each vector with all others of its label. The result is quadratic; ids alone travel, in blocks
    of up to ``tiles`` tiles a label, each sent to all of them."""
    ids = vectors.select("label", "id")
    mode = F.when(F.col("a") % 3 == 0, "vector_only").when(F.col("a") % 3 == 1, "keyword_only").otherwise("hybrid").alias("mode")
    return product(ids, ids, "label", mode, tiles=tiles).where("a <> b").select(F.col("a").alias("qid"), F.col("b").alias("id"), "mode")
