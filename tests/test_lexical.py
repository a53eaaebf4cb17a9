"""The blocked BM25 search against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memloom.operators import hybrid, lexical


def by_hand(queries, corpus, k):
    out = {}
    for part in {p for _, p, _ in corpus}:
        docs = [(i, Counter((t or "").lower().split())) for i, p, t in corpus if p == part]
        n, mean = len(docs), sum(c.total() for _, c in docs) / len(docs)
        df = Counter(w for _, c in docs for w in c)
        raw = {w: math.log((n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw) if raw else 0
        idf = {w: r if r >= 0 else floor for w, r in raw.items()}
        for q, p, text in queries:
            if p == part:
                score = lambda c: sum(m * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w, m in Counter((text or "").lower().split()).items() if c[w])
                out[q] = sorted((-round(score(c), 9), i) for i, c in docs if i is not None)[:k]
    return out


@pytest.mark.parametrize("rows,queries,slots", [(3, 2, 64), (4096, 8192, 64)])
def test_blocks_equal_brute_force(spark, monkeypatch, rows, queries, slots):
    monkeypatch.setattr(lexical, "ROWS", rows)
    monkeypatch.setattr(lexical, "QUERIES", queries)
    monkeypatch.setattr(lexical, "WORDS", 60 if rows == 3 else 2_000_000)
    rng = random.Random(3)
    text = lambda: " ".join(f"{rng.choice('wW')}{int(40 * rng.random() ** 2)}" for _ in range(rng.randint(0, 30)))
    corpus = [(i, "a" if i % 3 else "b", text()) for i in range(120)] + [(200, "a", None), (201, "b", ""), (None, "a", "w1 w2 w39"), (300, "c", None), (203, "a", "w7 " * 200)]
    asked = [r for r in corpus if r[0] is not None and r[0] % 10 == 0]
    frame = lambda r, key: spark.createDataFrame(r, f"{key} long, part string, text string")
    got = {}
    for r in hybrid.lexical_top(frame(asked, "qid"), frame(corpus, "id"), 7).collect():
        got.setdefault(r.qid, []).append((-r.score, r.id))
    want = by_hand(asked, corpus, 7)
    assert got.keys() == want.keys() and len(want) > 10
    for q, best in want.items():
        assert [i for _, i in sorted(got[q])] == [i for _, i in best]
        assert [s for s, _ in sorted(got[q])] == pytest.approx([s for s, _ in best], abs=2e-9)


def test_search_shuffles_no_row_for_each_query_document_and_word(spark):
    """A block holds many documents, and queries travel once a slot."""
    frame = spark.range(400, numPartitions=2).select("id", F.lit("a").alias("part"), F.array(*[F.xxhash64(F.lit(str(k))) for k in range(20)]).alias("t"))
    assert lexical.blocks(frame).count() == 2
