"""Hybrid retrieval over a frame of queries: routing, intent, cosine and BM25 rankings, rank fusion, weighted scores."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from . import lexical
from . import understanding as und

# BM25's k1, b and the share of the mean idf that replaces a negative one; the constant of rank fusion.
K1, B, EPSILON, FUSION = 1.5, 0.75, 0.25, 60
# Half-lives of recency in days, 30 for all others; types that the preferences' collection holds.
HALF_LIVES = {"preference": 90.0, "goal": 90.0, "habit": 90.0, "event": 14.0}
PREFS = ("preference", "goal", "habit")


def _tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def _set(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _counted(tok: DataFrame) -> DataFrame:
    """(id, part, len, w, tf) of every text's tokens: counted where the text is, without a shuffle."""

    def run(batches):
        for batch in batches:
            ids, parts, own = (batch.column(k).to_pylist() for k in range(3))
            rows = [(i, p, len(t), w, n) for i, p, t in zip(ids, parts, own, strict=True) if t for w, n in Counter(t).items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "part", "len", "w", "tf"), r, strict=True)) for r in rows], schema=kind)

    kind = pa.schema([("id", pa.int64()), ("part", pa.string()), ("len", pa.int64()), ("w", pa.string()), ("tf", pa.int64())])
    return tok.select(F.col("id").cast("long"), F.col("part").cast("string"), "t").mapInArrow(run, "id long, part string, len long, w string, tf long")


def bm25(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, id, score) of the documents that share a token with a query of their
    corpus (``part``); every other one scores zero. Scores are rounded, so that ties
    do not hang on the order of sums. Queries: qid, part, text. Corpus: id, part, text."""
    tok = corpus.select("id", "part", _tokens("text").alias("t"))
    size = tok.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.size("t"), F.lit(0))).alias("mean"))
    tf = _counted(tok)
    df = tf.groupBy("part", "w").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(size, "part").withColumn("raw", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    floor = raw.groupBy("part").agg((F.avg("raw") * EPSILON).alias("floor"))
    idf = raw.join(floor, "part").select("part", "w", "mean", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    # a token repeated in the query counts as often
    asked = queries.select("qid", "part", F.explode(_tokens("text")).alias("w")).groupBy("qid", "part", "w").agg(F.count(F.lit(1)).alias("q"))
    weight = F.col("q") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return asked.join(idf, ["part", "w"]).join(tf, ["part", "w"]).groupBy("qid", "part", "id").agg(F.round(F.sum(weight), 9).alias("score"))


def lexical_top(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, score) of each query's ``k`` best documents of its corpus. Documents
    without a common token score zero and fill up, the smaller ids first."""
    hashed = F.transform(_tokens("text"), lambda w: F.xxhash64(w)).alias("t")
    return lexical.top(queries.select("qid", "part", hashed), corpus.select("id", "part", hashed), k)


def retrieve(queries: DataFrame, memories: DataFrame, k: int = 10, depth: int = 200, fused: int = 60, kept: int = 50) -> DataFrame:
    """The ``k`` best memories of a user for each query.

    A query goes to the collections its words ask for. In each the ``depth`` best by
    cosine (here of word sets) and by BM25 are fused by their first ``fused`` ranks,
    and only hits of the cosine stay. Of all candidates the first ``kept``, facts
    before preferences, get the weighted mean of similarity, rerank (no model: one
    half), recency and importance, with the weights of the query's intent. Ties go
    to the smaller id everywhere.

    Queries: qid, user_id, text. Memories: id, user_id, type, age, importance, text.
    A query meets the memories of its own user; a memory of the query's id is none.
    """
    half = reduce(lambda acc, kv: acc.when(F.col("type") == kv[0], kv[1]), list(HALF_LIVES.items())[1:], F.when(F.col("type") == "preference", 90.0)).otherwise(30.0)
    m = memories.select("id", "user_id", "text", F.when(F.col("type").isin(*PREFS), "prefs").otherwise("facts").alias("collection"), _set("text").alias("w"), F.exp(-0.693 * F.col("age") / half).alias("recency"), (F.col("importance") / 10.0).alias("imp"))
    m = m.withColumn("part", F.concat_ws("/", F.col("user_id").cast("string"), "collection"))
    named = queries.select(F.col("qid").alias("id"), "text")
    q = queries.join(und.route(named).withColumnRenamed("id", "qid"), "qid").join(und.intent_weights(named).withColumnRenamed("id", "qid"), "qid")
    q = q.withColumn("collection", F.explode(F.when(F.col("route") == "both", F.array(F.lit("facts"), F.lit("prefs"))).otherwise(F.array("route"))))
    q = q.withColumn("part", F.concat_ws("/", F.col("user_id").cast("string"), "collection")).withColumn("qw", _set("text"))

    cosine = F.round(F.size(F.array_intersect("qw", "w")) / F.sqrt(F.size("qw") * F.size("w")), 9)
    hits = q.select("qid", "part", "collection", "qw").join(m.select("part", "id", "w"), "part").where("id <> qid").select("qid", "collection", "part", "id", F.coalesce(cosine, F.lit(0.0)).alias("sim"))
    by = lambda c: Window.partitionBy("qid", "part").orderBy(F.col(c).desc(), "id")
    vector = hits.withColumn("r", F.row_number().over(by("sim"))).where(F.col("r") <= depth)
    lexical = hits.select("qid", "part", "id").join(bm25(q.select("qid", "part", "text"), m.select("id", "part", "text")), ["qid", "part", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    lexical = lexical.withColumn("r", F.row_number().over(by("score"))).where(F.col("r") <= fused)
    ranks = vector.where(F.col("r") <= fused).select("qid", "part", "id", "r").union(lexical.select("qid", "part", "id", "r"))
    rrf = ranks.groupBy("qid", "part", "id").agg(F.round(F.sum(1 / (F.lit(FUSION) + F.col("r"))), 12).alias("rrf"))
    found = rrf.join(vector.select("qid", "part", "collection", "id", "sim"), ["qid", "part", "id"])
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("collection", F.col("rrf").desc(), "id"))).where(F.col("place") <= kept)
    weights = q.select("qid", "w_sim", "w_rerank", "w_recency", "w_importance").distinct()
    x = found.join(weights, "qid").join(m.select("id", "recency", "imp"), "id")
    total = F.col("w_sim") + F.col("w_rerank") + F.col("w_recency") + F.col("w_importance")
    score = F.round((F.col("w_sim") * F.col("sim") + F.col("w_rerank") * 0.5 + F.col("w_recency") * F.col("recency") + F.col("w_importance") * F.col("imp")) / total, 9)
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return x.select("qid", "id", score.alias("score")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
