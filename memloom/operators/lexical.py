"""BM25 search of queries against all documents of their part, block by block in Arrow batches.

Words are 64-bit hashes. Documents are packed where they are read into inverted blocks of one part; a part's blocks
are dealt to slots, and each slot's task holds a bounded group of queries with their best documents so far. Words that many
documents of a block have are multiplied as a matrix, the others are summed by their postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectorsearch import _stage

# BM25's k1, b and the share of the mean idf that replaces a negative one.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents and words of a block at most, and words that a task packs at once (of all parts).
ROWS, WORDS, HELD = 4096, 2_000_000, 4_000_000
#: Queries that a task holds, and slots of a part.
QUERIES, SLOTS = 8192, 64
#: Scores at a time; words in more than one of so many documents of a block are multiplied as a matrix.
CELLS, RARE = 1_000_000, 8

_BLOCK = "part string, n long, total long, ids binary, lens binary, vocab binary, starts binary, docs binary, tfs binary"
_NAMES = ["part", "n", "total", "ids", "lens", "vocab", "starts", "docs", "tfs"]
#: Stands for a null id: such a document counts in the statistics and is never found.
_NO_ID = np.iinfo(np.int64).min


def _pack(part: str, ids: list[np.ndarray], lens: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
    """One row for a block: documents by id, and for each word the documents that have it, and how often."""
    ids, lens, words = np.concatenate(ids), np.concatenate(lens), np.concatenate(words)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    owner = np.repeat(place, lens)
    vocab, word = np.unique(words, return_inverse=True)
    cell, tf = np.unique(word * len(ids) + owner, return_counts=True)
    starts = np.searchsorted(cell, np.arange(len(vocab) + 1) * len(ids)).astype(np.int32)
    packed = [ids[order], lens[order].astype(np.int32), vocab, starts, (cell % len(ids)).astype(np.int32), tf.astype(np.int32)]
    return pa.record_batch([pa.array([part]), pa.array([len(ids)]), pa.array([int(lens.sum())]), *[pa.array([x.tobytes()]) for x in packed]], _NAMES)


def blocks(tok: DataFrame) -> DataFrame:
    """Blocks of the documents (id, part, t: hashed words in order) of a task and part. No row is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting = 0
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy()
            parts = batch.column(1).dictionary_encode()
            codes, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
            t = batch.column(2)
            lens = t.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            flat, ends = t.flatten().to_numpy(), np.cumsum(lens)
            for code, name in enumerate(names):
                at = np.flatnonzero(codes == code)
                # cut where a block is full
                for i in range(0, len(at), ROWS):
                    rows = at[i : i + ROWS]
                    while len(rows):
                        own = held.setdefault(name, [[], [], [], 0, 0])
                        fits = int(np.searchsorted(np.cumsum(lens[rows]), WORDS - own[4], side="right"))
                        take = rows[: min(max(fits, 0 if own[3] else 1), ROWS - own[3])]
                        if len(take):
                            of = np.concatenate([flat[ends[r] - lens[r] : ends[r]] for r in take])
                            own[0].append(ids[take]), own[1].append(lens[take]), own[2].append(of)
                            own[3] += len(take)
                            own[4] += len(of)
                            waiting += len(of)
                            rows = rows[len(take) :]
                        if own[3] >= ROWS or len(rows):
                            waiting -= own[4]
                            yield _pack(name, *held.pop(name)[:3])
            if waiting > HELD:
                for name in list(held):
                    yield _pack(name, *held.pop(name)[:3])
                waiting = 0
        for name, own in held.items():
            yield _pack(name, *own[:3])

    return _stage(tok.mapInArrow(run, _BLOCK), "blocks")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, w, df) of every block."""
    for batch in batches:
        for row in range(batch.num_rows):
            part, vocab, starts = batch.column(0)[row].as_py(), np.frombuffer(batch.column(1)[row].as_py(), np.int64), np.frombuffer(batch.column(2)[row].as_py(), np.int32)
            yield pa.record_batch([pa.array([part]).take(pa.array(np.zeros(len(vocab), np.int32))), pa.array(vocab), pa.array(np.diff(starts).astype(np.int64))], ["part", "w", "df"])


def weights(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, n, mean) of the documents and their length, and (part, w, idf) of every word."""
    size = packed.groupBy("part").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    spread = packed.select("part", "vocab", "starts").mapInArrow(_spread, "part string, w long, df long")
    df = spread.groupBy("part", "w").agg(F.sum("df").alias("df"))
    raw = _stage(df.join(size.select("part", "n"), "part").select("part", "w", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw")), "idf")
    floor = raw.groupBy("part").agg((F.avg("raw") * EPSILON).alias("floor"))
    return size, raw.join(floor, "part").select("part", "w", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


class _Block:
    """A block with its words' weights, ready to be met by queries."""

    def __init__(self, mean: float, ids: bytes, lens: bytes, vocab: bytes, starts: bytes, docs: bytes, tfs: bytes):
        self.ids, self.vocab = np.frombuffer(ids, np.int64), np.frombuffer(vocab, np.int64)
        n, length = len(self.ids), np.frombuffer(lens, np.int32) / (mean or 1.0)
        starts, self.docs, tf = np.frombuffer(starts, np.int32).astype(np.int64), np.frombuffer(docs, np.int32).astype(np.int64), np.frombuffer(tfs, np.int32)
        self.w = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length))[self.docs])
        self.starts, self.df = starts[:-1], np.diff(starts)
        many = np.flatnonzero(self.df * RARE > n)
        self.column = np.full(len(self.vocab), -1)
        self.column[many] = np.arange(len(many))
        self.dense = np.zeros((len(many), n))
        for k, m in enumerate(many):
            at = slice(starts[m], starts[m + 1])
            self.dense[k, self.docs[at]] = self.w[at]

    def scores(self, owner: np.ndarray, words: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` queries, given as words with their weight."""
        if not len(self.vocab):
            return np.zeros((n, len(self.ids)))
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        met = self.vocab[at] == words
        owner, at, weight = owner[met], at[met], weight[met]
        often = self.column[at] >= 0
        asked = np.zeros((n, len(self.dense)))
        asked[owner[often], self.column[at[often]]] = weight[often]
        owner, at, weight = owner[~often], at[~often], weight[~often]
        df = self.df[at]
        step = np.arange(df.sum()) - np.repeat(np.cumsum(df) - df, df)
        post = np.repeat(self.starts[at], df) + step
        cells = np.repeat(owner * len(self.ids), df) + self.docs[post]
        rest = np.bincount(cells, np.repeat(weight, df) * self.w[post], n * len(self.ids))
        return np.round(asked @ self.dense + rest.reshape(n, -1), 9)


class _Best:
    """The ``k`` best documents so far of a group of queries: (ids, owner, words, weight), words by owner."""

    def __init__(self, k: int, qids: list[int], words: list[np.ndarray], weight: list[np.ndarray]):
        self.k, self.qids = k, np.array(qids, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.words, self.weight = np.concatenate([np.zeros(0, np.int64), *words]), np.concatenate([np.zeros(0), *weight])
        self.owner = np.repeat(np.arange(len(words)), sizes)
        self.bound = np.full(len(words), -np.inf)
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, block: _Block) -> None:
        keep = block.ids != _NO_ID
        new = [self.found]
        step = max(1, CELLS // max(1, len(block.ids)))
        for s in range(0, len(self.qids), step):
            e = min(len(self.qids), s + step)
            own = slice(self.ends[s], self.ends[e])
            score = block.scores(self.owner[own] - s, self.words[own], self.weight[own], e - s)[:, keep]
            if not score.shape[1]:
                continue
            # an equal score may still win by its id
            rows = np.flatnonzero(score.max(axis=1) >= self.bound[s:e])
            score = score[rows]
            least = np.partition(score, -self.k, axis=1)[:, -self.k] if self.k < score.shape[1] else np.full(len(rows), -np.inf)
            i, j = np.nonzero(score >= np.maximum(least, self.bound[s:e][rows])[:, None])
            # ids ascend within a block: of equal scores the first k are enough
            order = np.lexsort((j, -score[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < self.k], j[place < self.k]
            new.append((rows[i] + s, block.ids[keep][j], score[i, j]))
        q, d, x = (np.concatenate(c) for c in zip(*new, strict=True))
        order = np.lexsort((d, -x, q))
        q, d, x = q[order], d[order], x[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.bound[q[place == self.k - 1]] = x[place == self.k - 1]
        self.found = q[place < self.k], d[place < self.k], x[place < self.k]

    def rows(self) -> pa.RecordBatch:
        q, d, x = self.found
        return pa.record_batch([pa.array(self.qids[q]), pa.array(d), pa.array(x)], ["qid", "id", "score"])


def _search(k: int):
    """Of each query and slot the ``k`` best documents: rows by part, slot and group, queries before blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, best = None, ([], [], []), None
        for batch in batches:
            for row in range(batch.num_rows):
                part, slot, group, block, qid, words, weight, mean = (batch.column(c)[row].as_py() for c in range(8))
                if key != (part, slot, group):
                    if best:
                        yield best.rows()
                    key, asked, best = (part, slot, group), ([], [], []), None
                if not block:
                    asked[0].append(qid), asked[1].append(np.frombuffer(words, np.int64)), asked[2].append(np.frombuffer(weight))
                elif asked[0]:
                    best = best or _Best(k, *asked)
                    best.meet(_Block(mean, *(batch.column(c)[row].as_py() for c in range(8, 14))))
        if best:
            yield best.rows()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query's words and weights as bytes."""
    for batch in batches:
        words, weight = (batch.column(c).to_pylist() for c in (2, 3))
        packed = [[np.array(x or [], t).tobytes() for x in xs] for xs, t in ((words, np.int64), (weight, float))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], ["qid", "part", "words", "weight"])


def top(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, id, score) of each query's ``k`` best documents of its part; those without a common word score zero.
    Queries: qid, part, t. Corpus: id, part, t; t holds hashed words, a word for each time it occurs."""
    packed = blocks(corpus.select(F.col("id").cast("long"), F.col("part").cast("string"), "t"))
    size, idf = weights(packed)
    queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("part").cast("string").alias("part"), "t")
    # a word repeated in the query counts as often
    times = queries.select("qid", "part", F.explode("t").alias("w")).groupBy("qid", "part", "w").agg(F.count(F.lit(1)).alias("q"))
    words = times.join(idf, ["part", "w"]).groupBy("qid", "part").agg(F.array_sort(F.collect_list(F.struct("w", (F.col("q") * F.col("idf")).alias("x")))).alias("a"))
    asked = queries.select("qid", "part").distinct().join(words, ["qid", "part"], "left").select("qid", "part", F.col("a.w").alias("words"), F.col("a.x").alias("weight"))
    asked = _stage(asked.mapInArrow(_packed, "qid long, part string, words binary, weight binary"), "queries")
    # slots of a part follow its blocks, groups its queries
    slots = packed.groupBy("part").agg(F.least(F.lit(SLOTS), F.ceil(F.count(F.lit(1)) / 4)).cast("int").alias("slots"))
    plan = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("groups")).join(slots, "part").join(size.select("part", "mean"), "part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = asked.join(plan, "part").withColumn("group", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int")).withColumn("slot", every("slots"))
    held = held.select("part", "slot", "group", F.lit(False).alias("block"), "qid", "words", "weight", "mean")
    met = packed.join(plan, "part").withColumn("slot", F.pmod(F.xxhash64("ids"), F.col("slots")).cast("int")).withColumn("group", every("groups"))
    met = met.select("part", "slot", "group", F.lit(True).alias("block"), "mean", *_NAMES[3:])
    both = held.unionByName(met, True).repartition("part", "slot", "group").sortWithinPartitions("part", "slot", "group", "block")
    best = both.mapInArrow(_search(k), "qid long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return best.withColumn("r", rank).where(F.col("r") <= k).select("qid", "id", "score")
