"""Shared pieces of the training-data operators: storage, Arrow batches, crc folds.

Conventions of every operator in this package:

* it reads only the id and text columns it is told to read, so extra columns
  of the input, whatever their names, neither clash nor travel along;
* a null text counts as the empty text, a null id is kept as null;
* a repeated row gives a repeated result row unless the docstring says
  otherwise, and an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import fresh_path


def stage_path(spark: SparkSession, name: str) -> str:
    return fresh_path(spark, name)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the
    lineage, and a lost executor costs no recomputation of what came before."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files behind a staged frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        break


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest(table: DataFrame, group: str, order: list[str], n: int, salts: int = 16) -> DataFrame:
    """The first ``n`` rows of each group by ``order``. A group is cut into salted
    parts first, so no task gets more than salts x n rows of it at the end."""
    part = F.pmod(F.xxhash64(F.lit(3), *order), F.lit(salts))
    for by in ([group, part], [group]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        table = table.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return table


def crc_fold(col: str, mod: int) -> Column:
    """crc32 of the column as text, modulo ``mod``; a null counts as ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def slices(batch: pa.RecordBatch, column: str, chars: int = 1_000_000, rows: int = 512):
    """(start, texts) of runs of rows with about ``chars`` bytes of text at most,
    so that the memory of a task does not grow with the size of an Arrow batch."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    i, n = 0, len(size)
    while i < n:
        j, total = i, 0
        while j < n and j - i < rows and (j == i or total + size[j] <= chars):
            total += int(size[j])
            j += 1
        yield i, [x or "" for x in col.slice(i, j - i).to_pylist()]
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class HashIndex:
    """Exact map from uint64 keys to int32 values for whole numpy arrays.

    Open addressing with linear probing; unknown keys give -1.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            slot = at[todo]
            free = self.values[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = todo[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[first]] = False
            todo = todo[left]
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        at = self._slot(keys)
        value = self.values[at]
        out = np.where(self.keys[at] == keys, value, -1)
        todo = np.flatnonzero((out < 0) & (value >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            slot = at[todo]
            hit = self.keys[slot] == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit & (self.values[slot] >= 0)]
        return out
