"""Reading and writing memories: JSON, JSON lines, Parquet, CSV, upserts, graphs, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY_COLUMNS = ("id", "user_id", "type", "text", "importance", "confidence", "tag1", "tag2", "access_count", "created_at")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one
    the session was given by ``setCheckpointDir``. A local session without either gets
    a folder of its own; a cluster without either is an error, since no machine's own
    folder would do."""
    sc = spark.sparkContext
    found, given = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if found or given.isDefined():
        return (found or given.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="memloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for each use, below the shared folder."""
    return f"{shared_folder(spark)}/memloom-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """The frame written once, in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def export_json(mem: DataFrame, path: str, compressed: bool = False) -> None:
    """One JSON object per line (SRC7, SRC8); gzip on request."""
    mem.select(*MEMORY_COLUMNS).write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)


def export_parquet(mem: DataFrame, path: str) -> None:
    """Snappy Parquet, tags as a JSON string (SRC9)."""
    mem.select(*MEMORY_COLUMNS, F.to_json(F.array("tag1", "tag2")).alias("tags")).write.mode("overwrite").option("compression", "snappy").parquet(path)


def export_csv(mem: DataFrame, path: str) -> None:
    """CSV with a header, nulls as '' (SRC10)."""
    mem.select(*MEMORY_COLUMNS).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def import_records(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Read an export of any kind back with a stated schema (SRC12)."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path) if kind == "parquet" else reader.json(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", strategy: str = "replace") -> DataFrame:
    """Merge by key (SRC4, SRC12): ``replace`` takes new rows, ``skip`` keeps old
    ones, ``merge`` keeps the old row with the greater importance."""
    if strategy == "skip":
        return old.unionByName(new.join(old.select(key), key, "left_anti"))
    if strategy == "merge":
        more = new.select(F.col(key), F.col("importance").alias("_i"))
        kept = old.join(more, key, "left").withColumn("importance", F.greatest("importance", F.coalesce("_i", "importance"))).drop("_i")
        return kept.unionByName(new.join(old.select(key), key, "left_anti"))
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def export_graph(links: DataFrame, path: str) -> None:
    """Edges and nodes of a graph as JSON lines (SRC13)."""
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    nodes.select(F.lit("node").alias("kind"), "id", *[F.lit(None).cast(t).alias(c) for c, t in (("src", "int"), ("dst", "int"), ("relation", "string"), ("weight", "double"))]).unionByName(
        links.select(F.lit("link").alias("kind"), F.lit(None).cast("int").alias("id"), "src", "dst", "relation", F.col("weight").cast("double").alias("weight"))
    ).write.mode("overwrite").json(path)


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema("kind string, id int, src int, dst int, relation string, weight double").json(path)
    return rows.where("kind = 'node'").select("id"), rows.where("kind = 'link'").select("src", "dst", "relation", "weight")
