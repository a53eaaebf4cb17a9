"""The cosine join against brute force, its pruning, and the queries on it."""

import numpy as np
import pytest

from memloom.operators import cosinejoin

SCHEMA = "id long, v array<float>, label int, block long, angles string"


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 6
    return [(i, (centres[i % 12] + rng.normal(size=8)).astype(np.float32).tolist(), i % 12 // 6, i, "x") for i in range(n)]


def by_hand(rows, least):
    found = {}
    for n, (i, v, p, *_) in enumerate(rows):
        for j, w, q, *_ in rows[n + 1 :]:
            if None in (v, w, p, q) or p != q or i == j or len(v) != len(w) or not v or None in v or None in w:
                continue
            x, y = np.array(v, float), np.array(w, float)
            if not np.isfinite([*x, *y]).all() or not x.any() or not y.any():
                continue
            s = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)
            if s >= least:
                found[min(i, j), max(i, j)] = s
    return found


ODD = [(900, None, 0, 0, ""), (901, [], 0, 0, ""), (902, [0.0] * 8, 0, 0, ""), (903, [1.0, None], 0, 0, ""), (904, [float("nan")] * 8, 0, 0, ""), (905, [1.0, 2.0], 0, 0, ""), (906, [1.0, 2.1], 0, 0, ""), (907, [1.0, 2.0], None, 0, "")]


@pytest.mark.parametrize("least", [0.3, 0.95])
def test_pairs_equal_brute_force(spark, least):
    rows = clustered(240) + ODD
    got = {(r.a, r.b): r.s for r in cosinejoin.similar(spark.createDataFrame(rows, SCHEMA), least).collect()}
    want = by_hand(rows, least)
    assert got.keys() == want.keys() and (905, 906) in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_apart_never_meet(spark):
    packed = cosinejoin.blocks(spark.createDataFrame(clustered(600), SCHEMA), rows=16)
    of = packed.groupBy("label").count().collect()
    every = sum(r["count"] * (r["count"] + 1) // 2 for r in of)
    near, far = cosinejoin.meeting(packed, 0.95).count(), cosinejoin.meeting(packed, -1.0).count()
    assert far == every and near < every / 2


def test_equal_vectors_split_and_empty_table(spark):
    same = [(i, [1.0, 2.0, 3.0], 1, 0, "") for i in range(60)]
    frame = spark.createDataFrame(same, SCHEMA)
    assert cosinejoin.blocks(frame, rows=8).count() > 4
    assert cosinejoin.similar(frame, 0.999).count() == 60 * 59 // 2
    assert {r.action for r in cosinejoin.write_gate(frame, 0.88, 0.95).where("id > 1").collect()} == {"update"}
    assert {r.id: r.action for r in cosinejoin.write_gate(frame, 0.88, 0.95).where("id < 2").collect()} == {0: "store", 1: "skip"}
    assert cosinejoin.similar(frame.limit(0), 0.5).count() == 0


def test_quality_is_the_mean_of_all_pairs(spark):
    rows = clustered(100)
    got = {r.label: (r.pairs, r.cohesion) for r in cosinejoin.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    for label in (0, 1):
        own = [r for r in rows if r[2] == label]
        s = list(by_hand(own, -2).values())
        assert got[label][0] == len(s) and abs(got[label][1] - np.mean(s)) < 1e-7


def test_vectors_are_shuffled_once_as_given_and_no_pairs_but_the_best(spark):
    rows = clustered(480)
    frame = spark.createDataFrame(rows, SCHEMA)
    packed = cosinejoin.blocks(frame, rows=32)
    # floats stay floats, and no row carries angles
    assert all(len(r.vectors) == 4 * r.dim * len(r.norms) // 8 for r in packed.collect())
    every = by_hand(rows, 0.3)
    best = {}
    for (a, b), s in every.items():
        best.setdefault(b, []).append((-s, a))
    best = {(a, b) for b, xs in best.items() for _, a in sorted(xs)[:3]}
    got = [(r.a, r.b) for r in cosinejoin.similar(frame, 0.3, hits=3).collect()]
    assert best <= set(got) <= every.keys() and len(got) == len(set(got)) <= 6 * len(best) < len(every)
