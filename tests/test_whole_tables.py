"""Queries over a small fixture with large ids, against plain Python: no row of a table is left out."""

import datetime
import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from memloom.operators import understanding
from memloom.plans import registry
from memloom.plans.views import load

EVENTS = [(i, 41 + i % 3, ("view", "click", "error")[i % 3 if i % 5 else 0], i % 4) for i in range(6001, 6041)]


@pytest.fixture(scope="module")
def large_ids(tmp_path_factory):
    folder = tmp_path_factory.mktemp("large_ids")
    start = datetime.datetime(2024, 1, 1)
    events = {"event_id": [i for i, *_ in EVENTS], "ts": [start + datetime.timedelta(hours=i) for i, *_ in EVENTS], "user_id": [u for _, u, *_ in EVENTS], "event_type": [t for *_, t, _ in EVENTS], "value": [float(i % 90) for i, *_ in EVENTS], "props": [f'{{"k": {k}}}' for *_, k in EVENTS]}
    pq.write_table(pa.table(events).cast(pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])), os.path.join(folder, "events.parquet"))
    vectors = {"vec_id": pa.array([200, 301, 402, 503], pa.int64()), "embedding": pa.array([[1.0, 0.0], [1.0, 0.5], [0.0, 1.0], [1.0, 1.0]], pa.list_(pa.float32())), "label": pa.array([1, 1, 1, 2], pa.int32())}
    pq.write_table(pa.table(vectors), os.path.join(folder, "embeddings.parquet"))
    words = "ab cd ef gh ij kl mn op qr st uv wx yz".split()
    texts = {100: "  ab  cd " * 60 + "zz", 200: "only here", 301: "ab cd", 402: " ".join(words * 20), 503: " ".join(words)}
    pq.write_table(pa.table({"doc_id": pa.array(list(texts), pa.int64()), "text": list(texts.values()), "lang": ["en"] * 5, "source": ["x"] * 5, "n_chars": pa.array(map(len, texts.values()), pa.int64())}), os.path.join(folder, "documents.parquet"))
    pq.write_table(pa.table({"l_suppkey": pa.array([1, 1, 1, 2], pa.int64()), "l_partkey": pa.array([7, 7, 20, 13], pa.int64())}), os.path.join(folder, "lineitem.parquet"))
    return str(folder)


def rows(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def test_every_memory_is_covered(spark, large_ids):
    ids = [i for i, *_ in EVENTS]
    assert sorted(r.id for r in rows(spark, large_ids, "str8")) == ids[:-1]
    notes = {r.id: (r.user_id, r.type) for r in load(spark, large_ids, "note")[0].collect()}
    assert len(rows(spark, large_ids, "str11")) == len(ids) - len(set(notes.values()))  # all but the first of a user and type
    assert sorted(r.id for r in rows(spark, large_ids, "tms3")) == ids
    assert sorted(r.id for r in rows(spark, large_ids, "flt12")) == ids
    story = rows(spark, large_ids, "tmp7")
    assert {r.user_id for r in story} == {41, 42, 43}


def test_similarity_covers_all_texts_of_a_user(spark, large_ids):
    cls = {}
    for r in load(spark, large_ids, "note")[0].collect():
        cls.setdefault((r.user_id, r.text), []).extend([r.id, 16010] if r.id == 6010 else [r.id])
    stop, groups = set(understanding.STOP_WORDS), [set(g.split()) for g in understanding.SYNONYMS]
    want = {}
    for (ua, ta), ia in cls.items():
        for (ub, tb), ib in cls.items():
            x, y = (set(re.findall(r"\w+", t.lower())) - stop for t in (ta, tb))
            if ua == ub and min(ia) < min(ib) and x and y:
                s = min(1.0, len(x & y) / len(x | y) + 0.2 * sum(bool(x & g) and bool(y & g) for g in groups))
                if ta.lower() in tb.lower() or tb.lower() in ta.lower():
                    s = max(s, 0.8)
                if s >= 0.2:
                    want[min(ia), min(ib)] = (len(ia), len(ib), s)
    notes = load(spark, large_ids, "note")[0]
    got = {(r.a, r.b): (r.n_a, r.n_b, r.s) for r in understanding.lexical_likeness(notes.union(notes.where("id = 6010").withColumn("id", F.col("id") + 10000)), least=0.2).collect()}
    assert want and got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-7) for p in want)


def test_dispatch_covers_all_queries(spark, large_ids):
    got = {(r.qid, r.id) for r in rows(spark, large_ids, "ret6")}
    assert got == {(a, b) for a in (200, 301, 402) for b in (200, 301, 402) if a != b}


def test_texts_of_any_length_are_covered(spark, large_ids):
    assert {(r.a, r.b, round(r.jaccard, 6)) for r in rows(spark, large_ids, "sim3")} == {(100, 301, round(2 / 3, 6)), (402, 503, 1.0)}
    assert {r.id: r.text for r in rows(spark, large_ids, "str6")}[100] == "ab cd " * 60 + "zz"


def test_edges_cover_all_parts(spark, large_ids):
    assert {tuple(r) for r in rows(spark, large_ids, "gra8")} == {(1, 2, 7), (2, 1, 13)}


def test_search_covers_every_hundredth_id_and_whole_texts(spark, large_ids):
    assert {(r.qid, r.id) for r in rows(spark, large_ids, "ret1")} == {(200, 301), (200, 402), (200, 503)}
    assert {(r.qid, r.id) for r in rows(spark, large_ids, "src2")} == {(200, 301), (200, 503)}
    # "zz" stands at the end of text 100 only, far behind its sixtieth character
    top = {r.id: r.score for r in rows(spark, large_ids, "ret2") if r.qid == 100}
    short = {r.id: r.score for r in rows(spark, large_ids, "ret2") if r.qid == 200}
    # documents without a common token fill up with zero scores
    assert max(top, key=top.get) == 100 and short.keys() == {100, 200, 301, 402, 503} and {i for i, s in short.items() if s > 0} == {200}
