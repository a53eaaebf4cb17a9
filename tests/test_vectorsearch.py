"""The blocked search against brute force."""

import numpy as np

from memloom.operators import cosinejoin, vectorsearch


def test_search_equals_brute_force_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectorsearch, "_search", lambda q, v, k, least: vectorsearch._blocks(v, 40, "v").crossJoin(vectorsearch._blocks(q, 7, "q").toDF("a", "b", "c")).mapInArrow(vectorsearch._found(k, least, 64), "qid long, id long, sim double"))
    v = np.random.default_rng(5).normal(size=(200, 6))
    v[100:120] = v[40:60]
    rows = [(i, v[i].tolist()) for i in range(200)] + [(200, None), (300, [0.0] * 6), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (402, [None, 1.0])]
    frame = spark.createDataFrame(rows, "id long, v array<float>")
    f = v.astype(np.float32).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    top, above = vectorsearch.top(frame.where("id % 20 = 0"), frame, 9).collect(), vectorsearch.above(frame.where("id % 20 = 0"), frame, 0.5).collect()
    for q in range(0, 200, 20):
        s = np.round(u @ u[q], 9)
        order = sorted((-s[i], i) for i in range(200) if i != q)
        assert {r.id for r in top if r.qid == q} == {i for _, i in order[:9]}
        assert {r.id for r in above if r.qid == q} == {i for t, i in order if -t >= 0.5}
    assert [(r.id, r.sim) for r in top if r.qid == 200][0] == (0, None) and sum(r.qid == 200 for r in top) == 9
    assert [r.id for r in above if r.qid == 400] == [401] and [r.id for r in top if r.qid == 400 and r.sim] == [401]


def test_tiles_send_a_block_once_for_many_pairs_and_forests_connect_the_same(spark):
    v = np.random.default_rng(6).normal(size=(700, 4))
    frame = spark.createDataFrame([(i, v[i].tolist(), i % 2) for i in range(700)], "id long, v array<double>, label int")
    packed = cosinejoin.blocks(frame, rows=8)
    near = cosinejoin.meeting(packed, 0.7).localCheckpoint()
    assert cosinejoin.tiles(packed, near).where("side > 0").count() < near.count() / 2
    of = lambda sent: {(r.a, r.b) for r in sent.collect()}
    every, few = (of(cosinejoin.tiles(packed, near).mapInArrow(cosinejoin._products(0.7, forest), "a long, b long, s double")) for forest in (False, True))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    assert every == {(i, j) for i in range(700) for j in range(i + 1, 700) if i % 2 == j % 2 and s[i, j] >= 0.7}

    def parts(edges):
        label = list(range(700))
        for _ in range(700):
            old = list(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if old == label:
                return label

    assert len(few) < len(every) / 2 and parts(few) == parts(every)


def test_dispatch_deals_a_label_to_many_keys(spark):
    frame = spark.createDataFrame([(i, [1.0], 1 if i < 40 else None if i < 43 else 2) for i in range(50)] + [(None, [1.0], 1)], "id long, v array<float>, label int")
    got = vectorsearch.dispatch(frame, tiles=3)
    ids = [range(40), range(43, 50)]
    want = {(a, b, ("vector_only", "keyword_only", "hybrid")[a % 3]) for own in ids for a in own for b in own if a != b}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
