"""Phrase collocations per language, by weighted counts of distinct pieces.

Texts are cut at punctuation and line ends into pieces. Identical pieces of a
language become one row with a multiplicity, and rows become blocks of a few MB.
Most n-grams are too rare to matter, so blocks ask first: a request holds the
hashed cells of a block's n-grams with their weights, shuffled to where a range of
cells is summed; the answer names the cells that reach the limit. A cell's sum is
at least that of any n-gram in it, so nothing frequent is lost. The n-grams
left are counted exactly, by duckdb per hash bucket, which spills to Spark's own
scratch folders beyond a memory limit. Candidates then send lookup requests, shuffled
to where the counts of their parts are; the answers come back as the least
favourable cut's score.
"""

from __future__ import annotations

import math
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, mix64, smallest, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTED = "lang string, gram string, f long"
ROWS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())])
PIECES = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("n", pa.int64())])
#: Bytes of pieces in a block, bits of a cell, and duckdb's memory in a task.
FLUSH_BYTES, CELL_BITS, MEMORY = 8 << 20, 40, "600MB"
#: Hash buckets for a table of one block; four times the blocks have twice as many.
BUCKETS = 64
#: Added before each word of an n-gram is hashed in.
STEP = np.uint64(0x9E3779B97F4A7C15)
CODEC = "zstd"

SUMS = "SELECT lang, gram, CAST(sum(f) AS BIGINT) AS f FROM held GROUP BY lang, gram"


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``piece`` (its words joined by single spaces) and ``n``, how often it occurs.

    A null text is empty, a null language is ``und``; pieces without words are left out.
    """
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    cut = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    clean = cut.select("lang", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece")).where("piece <> ''")
    return clean.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


def _stream(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec(CODEC, compression_level=5))) as stream:
        stream.write(rows)
    return sink.getvalue().to_pybytes()


def _blocks(flush: int):
    """Pieces as compressed Arrow streams of about ``flush`` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = 1 + batch.num_rows * flush // max(1, 4 * batch.nbytes)
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows).cast(PIECES)
                held.append(part)
                size += part.nbytes
                if size >= flush:
                    yield _stream_row(held)
                    held, size = [], 0
        if held:
            yield _stream_row(held)

    return run


def _stream_row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([_stream(pa.Table.from_batches(held))], pa.binary())], ["pieces"])


class _Block:
    """The words of a block's pieces with the cells of the n-grams that begin at them."""

    def __init__(self, packed: pa.Scalar):
        table = pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()
        split = pc.split_pattern(table["piece"].combine_chunks(), " ")
        self.words, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        self.lengths = np.diff(ends)
        row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.left = ends[1:][row] - ends[0] - np.arange(len(row))
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.langs, self.row_lang, self.n = langs.dictionary, langs.indices.to_numpy().astype(np.int64), table["n"].to_numpy()
        self.lang, self.weight = self.row_lang[row], self.n[row]
        coded = self.words.dictionary_encode()
        self.code, self.kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        self.lang_hash = _hashes(self.langs)
        word = _hashes(coded.dictionary)[self.code]
        self.hash = [mix64(self.lang_hash[self.lang] ^ word)]
        for j in (1, 2):
            after = np.concatenate([word[j:], np.zeros(min(j, len(word)), np.uint64)])
            self.hash.append(mix64(self.hash[-1] + STEP ^ after))

    def starts(self, words: int) -> np.ndarray:
        return np.flatnonzero(self.left >= words)

    def cells(self, words: int) -> np.ndarray:
        return (self.hash[words - 1] >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _hashes(strings: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def _requests(buckets: int, at_least: int):
    """For every block and range of cells: the cells, as packed differences, and their weights up to ``at_least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC, compression_level=3)
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = _Block(packed)
                at = [block.starts(j) for j in (1, 2, 3)]
                cells = np.concatenate([block.cells(j)[a] for j, a in zip((1, 2, 3), at)])
                order = np.argsort(cells)
                cells, weight = cells[order], np.concatenate([block.weight[a] for a in at])[order]
                first = np.flatnonzero(np.diff(cells, prepend=-1))
                cells, weight = cells[first], np.minimum(np.add.reduceat(weight, first), at_least).astype(np.uint8)
                cuts = np.searchsorted(cells, -(-(np.arange(buckets + 1) << CELL_BITS) // buckets))
                rows = []
                for bucket, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if j > i:
                        planes = np.diff(cells[i:j], prepend=0).view(np.uint8).reshape(-1, 8).T
                        rows.append((number, bucket, int(j - i), codec.compress(planes.tobytes() + weight[i:j].tobytes(), asbytes=True)))
                del block, order, cells, weight
                yield _table(rows)

    return run


REQUEST = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("size", pa.int64()), ("cells", pa.binary())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, REQUEST)], schema=REQUEST)


def _answers(at_least: int):
    """For every request of one range, the cells whose weights over all requests reach ``at_least``."""

    def run(asked: pa.Table) -> pa.Table:
        codec, cells, weights = pa.Codec(CODEC), [], []
        for size, packed in zip(asked["size"].to_pylist(), asked["cells"].combine_chunks()):
            raw = np.frombuffer(codec.decompress(packed.as_buffer(), 9 * size), np.uint8)
            cells.append(np.cumsum(np.ascontiguousarray(raw[: 8 * size].reshape(8, size).T).view(np.int64).ravel()))
            weights.append(raw[8 * size :])
        every, place = np.unique(np.concatenate(cells), return_inverse=True)
        enough = every[np.bincount(place, np.concatenate(weights), len(every)) >= at_least]
        own = [c[np.isin(c, enough, assume_unique=True)] for c in cells]
        rows = [(block, bucket, len(c), c.tobytes()) for block, bucket, c in zip(asked["block"].to_pylist(), asked["bucket"].to_pylist(), own)]
        return pa.Table.from_batches([_table(rows)])

    return run


def _kept(buckets: int):
    """A block's counts of the n-grams in the cells that it was answered, and its words of each language as the gram ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, answers in zip(batch.column(0), batch.column(1).to_pylist()):
                block = _Block(packed)
                enough = np.sort(np.frombuffer(b"".join(answers or []), np.int64))
                total = np.bincount(block.row_lang, block.n * block.lengths, len(block.langs)).astype(np.int64)
                out = [(block.lang_hash, block.langs, pa.array([""] * len(total)), total)]
                for j in (1, 2, 3):
                    at = block.starts(j)
                    cells = block.cells(j)[at]
                    near = np.searchsorted(enough, cells)
                    at = at[(near < len(enough)) & (np.append(enough, -1)[near] == cells)]
                    # equal n-grams have equal codes: word by word, so that a key stays small
                    key = block.lang[at]
                    for k in range(j):
                        first, key = np.unique(key * block.kinds + block.code[at + k], return_index=True, return_inverse=True)[1:]
                    f = np.bincount(key, block.weight[at], len(first)).astype(np.int64)
                    at = at[first]
                    words = [block.words.take(pa.array(at + k)) for k in range(j)]
                    out.append((block.hash[j - 1][at], block.langs.take(pa.array(block.lang[at])), pc.binary_join_element_wise(*words, " ") if j > 1 else words[0], f))
                bucket = np.concatenate([h % np.uint64(buckets) for h, *_ in out]).astype(np.int32)
                found = pa.table([pa.array(bucket), *[pa.concat_arrays([o[i] for o in out]) for i in (1, 2)], pa.array(np.concatenate([o[3] for o in out]))], ["bucket", *ROWS.names])
                found = found.sort_by([("bucket", "ascending"), ("lang", "ascending"), ("gram", "ascending")]).combine_chunks()
                del block, out, words, key, at
                for part in found.to_batches():
                    yield from _packed(part)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a bucket's packed rows, by duckdb, which spills beyond its memory."""
    import duckdb

    scratch = tempfile.mkdtemp(prefix="duckdb-", dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None)
    db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False})
    try:
        db.execute("CREATE TABLE held (lang VARCHAR, gram VARCHAR, f BIGINT)")
        for batch in batches:
            for pack in batch.column(1):
                db.register("batch", pa.ipc.open_stream(pack.as_buffer()).read_all())
                db.execute("INSERT INTO held SELECT * FROM batch")
                db.unregister("batch")
        for found in db.sql(SUMS).to_arrow_reader(50_000):
            yield found.cast(ROWS)
    finally:
        db.close()
        shutil.rmtree(scratch, ignore_errors=True)


def _packed(found: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row for each bucket's stretch of ordered rows: the bucket and the rows as a compressed Arrow stream."""
    if not found.num_rows:
        return
    buckets = found.column(0).to_numpy()
    rows = pa.record_batch(found.columns[1:], found.schema.names[1:]).cast(ROWS)
    cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
    packs = [_stream(rows.slice(i, j - i)) for i, j in zip(cuts, cuts[1:])]
    yield pa.record_batch([pa.array(buckets[cuts[:-1]], pa.int32()), pa.array(packs, pa.binary())], ["bucket", "rows"])


def count_grams(found: DataFrame, at_least: int = 10) -> DataFrame:
    """``lang``, ``gram``, ``f`` of all n-grams of up to three words that occur ``at_least``
    times in ``pieces``; the gram '' has the number of words of the language.

    The number of hash buckets follows the square root of the size of the blocks, as blocks times buckets
    are the rows that are shuffled; it is stated, since packed rows are many times larger once a task holds them.
    """
    packed = found.mapInArrow(_blocks(FLUSH_BYTES), "pieces binary")
    blocks = stage(packed.select(F.monotonically_increasing_id().alias("block"), "pieces", F.octet_length("pieces").alias("bytes")), "blocks")
    size = blocks.agg(F.sum(F.col("bytes").cast("long"))).first()[0] or 0
    buckets = BUCKETS * math.ceil(math.sqrt(size / FLUSH_BYTES) or 1)
    blocks = blocks.select("block", "pieces")
    request = "block long, bucket int, size long, cells binary"
    asked = blocks.mapInArrow(_requests(buckets, at_least), request)
    answers = stage(asked.groupBy("bucket").applyInArrow(_answers(at_least), request), "answers")
    own = answers.where("size > 0").groupBy("block").agg(F.collect_list("cells").alias("cells"))
    parts = blocks.join(own, "block", "left").select("pieces", "cells").mapInArrow(_kept(buckets), "bucket int, rows binary")
    counts = stage(parts.repartition(buckets, "bucket").mapInArrow(_sums, COUNTED).where((F.col("f") >= at_least) | (F.col("gram") == "")), "grams")
    drop_stage(answers)
    drop_stage(blocks)
    return counts


def collocations(counts: DataFrame, top: int = 2000, inside: int = 50) -> DataFrame:
    """The best ``top`` phrases of each language with their counts.

    ``counts`` comes from ``count_grams``: a part occurs at least as often as its
    phrase, so all parts of candidates are in it. A candidate goes if one that is
    longer holds it with at least ``inside`` percent of its count. Ties are broken
    by count, then by the bytes of the phrase; cuts of equal score by the shorter
    first part.
    """
    words = F.size(F.split("gram", " "))
    grams = counts.where("gram <> ''")
    phrases = grams.where(words > 1).select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.split("gram", " ").alias("w"))
    # one request for each part of each cut
    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), F.concat_ws(" ", F.slice("w", F.lit(1), k)).alias("first"), F.concat_ws(" ", F.slice("w", k + 1, F.size("w") - k)).alias("rest")))
    asked = phrases.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", F.explode(F.array(F.struct(F.lit(True).alias("head"), F.col("c.first").alias("part")), F.struct(F.lit(False).alias("head"), F.col("c.rest").alias("part")))).alias("q"))
    asked = asked.select("lang", "phrase", "a", "k", "q.head", F.col("q.part").alias("gram"))
    answers = asked.join(grams, ["lang", "gram"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    square, product = wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)"), wide["l"] * wide["r"]
    scored = answers.select("*", square.alias("_s"), product.alias("_p")).select("lang", "phrase", "a", "k", "l", "r", F.expr("_s div _p").alias("score"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # what stands inside a longer candidate: the most frequent one decides
    pairs = F.array(F.concat_ws(" ", F.slice("w", 1, 2)), F.concat_ws(" ", F.slice("w", 2, 2)))
    longer = phrases.where(F.size("w") == 3).select("lang", F.explode(pairs).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * F.col("f") < inside * F.col("a")))
    best = smallest(kept.select("lang", (-F.col("c.score")).alias("s"), (-F.col("a")).alias("m"), "phrase", "c.l", "c.r"), "lang", ["s", "m", "phrase"], top)
    totals = counts.where("gram = ''").select("lang", F.col("f").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("s", "m", "phrase")).cast("long")
    out = best.select("*", rank.alias("rank")).join(totals, "lang")
    return out.select("lang", "rank", "phrase", (-F.col("m")).alias("a"), "l", "r", "n", (-F.col("s")).alias("score"))


def mine(docs: DataFrame, at_least: int = 10, top: int = 2000) -> DataFrame:
    """Collocations of ``docs``. An empty table gives none."""
    return collocations(count_grams(pieces(docs), at_least), top)
