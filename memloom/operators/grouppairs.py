"""Products of the ids of a group, dealt to tasks in blocks. What is shuffled follows the ids; no row stands for more than a block of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a block, and of the part of one that a row of the join multiplies with a block: Spark holds what a row is exploded to
#: until it is read. Tiles of blocks a group and side, each sent once for each tile of the other side. Pairs a task.
BLOCK, PART, TILES, TOGETHER = 512, 8, 8, 8_000_000


def meeting(left: DataFrame, right: DataFrame, group: str, tiles: int = TILES) -> DataFrame:
    """Lists (a, b) whose products are all pairs of an id of ``left`` and one of ``right`` of a group, at most ``PART`` and ``BLOCK``
    ids. The ids of a group are dealt to blocks and these to at most ``tiles`` tiles a side; a pair of tiles meets in one task."""
    both = [df.where(F.col(group).isNotNull() & F.col("id").isNotNull()) for df in (left, right)]
    n, m = (df.groupBy(group).agg(F.count(F.lit(1)).alias(c)) for df, c in zip(both, ("_n", "_m"), strict=True))
    sizes = n.join(m, group)
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
    tasks = int(min(4096, pairs // TOGETHER + 1))
    sizes = sizes.select(group, *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("_n", "_m")])

    def side(ids: DataFrame, own: str, other: str, x: str, y: str, most: int, name: str) -> DataFrame:
        placed = ids.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64("id"), F.col(own)))
        lists = placed.groupBy(group, "_n", "_m", "_block").agg(F.collect_list("id").alias("ids"))
        sent = lists.select(group, F.pmod("_block", F.least(F.lit(tiles), F.col(own))).cast("int").alias(x), F.explode(F.sequence(F.lit(0), F.least(F.lit(tiles), F.col(other)) - 1)).alias(y), "ids")
        # ids that occur often are in one block, so blocks are cut as well
        parts = F.transform(F.sequence(F.lit(0), F.size("ids") - 1, F.lit(most)), lambda i: F.slice("ids", i + 1, most))
        return sent.repartition(tasks, group, "_x", "_y").select(group, "_x", "_y", F.explode(parts).alias(name))

    met = side(both[0], "_n", "_m", "_x", "_y", PART, "a").join(side(both[1], "_m", "_n", "_y", "_x", BLOCK, "b").hint("shuffle_hash"), [group, "_x", "_y"])
    return met.select("a", "b")


def product(left: DataFrame, right: DataFrame, group: str, *more: Column, tiles: int = TILES) -> DataFrame:
    """(a, more, b) of every id of ``left`` with every id of ``right`` of its group; columns of ``more`` are of ``a`` alone.
    Both: group, id. Null ids and groups take no part."""
    return meeting(left, right, group, tiles).select(F.explode("a").alias("a"), "b").select("a", *more, F.explode("b").alias("b"))
