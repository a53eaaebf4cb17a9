"""Known numbers, properties, and brute-force twins of the ordered operators."""

import numpy as np
import random

import pytest

import __spark_entry__
from memloom.operators import components, greedy
from memloom.plans.dialect import Op, spell
from memloom.sources import storage


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dialect_spells_nested_calls():
    assert spell("SELECT #us(#hours(ts, 1)) + 0.5 FROM t WHERE x = '0.5'", 1) == "SELECT epoch_us((ts + to_hours(1))) + 0.5e0 FROM t WHERE x = '0.5'"


def test_rank_fusion_known_numbers(spark):
    fuse = Op("f", "SELECT id, sum(1.0 / (60 + r)) AS s FROM @t GROUP BY id", ("t",))
    got = {r.id: r.s for r in fuse(spark.createDataFrame([("doc1", 1), ("doc2", 2), ("doc3", 3), ("doc2", 1), ("doc1", 2), ("doc4", 3)], "id string, r int")).collect()}
    assert got["doc1"] == pytest.approx(1 / 61 + 1 / 62) == got["doc2"] and got["doc3"] == pytest.approx(1 / 63)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    parent = list(range(61))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_budget_skips_what_does_not_fit(spark):
    rows = [(1, k, float(10 - k), 1.0, "x" * n) for k, n in enumerate([100, 400, 60, 4])]
    got = {r.id for r in greedy.budget(spark.createDataFrame(rows, "user_id long, id long, importance double, confidence double, text string"), tokens=45).collect()}
    assert got == {0, 2, 3}


def test_upsert_strategies(spark):
    old = spark.createDataFrame([(1, 5.0), (2, 1.0)], "id long, importance double")
    new = spark.createDataFrame([(2, 9.0), (3, 2.0)], "id long, importance double")
    rows = {s: sorted((r.id, r.importance) for r in storage.upsert(old, new, strategy=s).collect()) for s in ("replace", "skip", "merge")}
    assert rows == {"replace": [(1, 5.0), (2, 9.0), (3, 2.0)], "skip": [(1, 5.0), (2, 1.0), (3, 2.0)], "merge": [(1, 5.0), (2, 9.0), (3, 2.0)]}


def test_graph_files(spark, tmp_path):
    links = spark.createDataFrame([(1, 2, "knows", 0.5), (2, 3, "manages", 0.7)], "src int, dst int, relation string, weight double")
    storage.export_graph(links, f"file://{tmp_path}/graph")
    nodes, back = storage.import_graph(spark, f"file://{tmp_path}/graph")
    assert sorted(r.id for r in nodes.collect()) == [1, 2, 3] and sorted(back.collect()) == sorted(links.collect())


def test_star_clusters_are_not_transitive(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.5], 0), (3, [0.6, 1.0], 0), (4, [0.0, 1.0], 0)]
    got = {r.id: r.seed for r in greedy.star_clusters(spark.createDataFrame(rows, "id long, v array<double>, label int"), least=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_disjoint_merges_take_the_closest_pair_first(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [1.0, 0.15], 0)]
    got = [(r.a, r.b) for r in greedy.disjoint_merges(spark.createDataFrame(rows, "id long, v array<double>, label int"), least=0.5).collect()]
    assert got == [(2, 3)]


def test_anchored_windows_measure_from_the_start(spark):
    rows = [(1, k, int(h * 3.6e9)) for k, h in enumerate([0, 3, 4, 5, 8.5, 13])]
    got = [r.win for r in greedy.anchored_windows(spark.createDataFrame(rows, "user_id long, id long, us long")).orderBy("id").collect()]
    assert got == [0, 0, 0, 1, 1, 2]


def test_assembled_context_states_reasons(spark):
    rows = [(1, 0, 9.0, 1.0, 0.0, "alpha beta gamma"), (1, 1, 8.9, 1.0, 0.0, "alpha beta gamma"), (1, 2, 0.1, 0.1, 90.0, "low"), (1, 3, 8.0, 1.0, 0.0, "x" * 900)]
    got = {r.id: r.state for r in greedy.assembled_context(spark.createDataFrame(rows, "user_id long, id long, importance double, confidence double, age double, text string")).collect()}
    assert got == {0: "kept", 1: "duplicate", 2: "low_relevance", 3: "budget"}


def test_sequence_ratio_and_facts(spark):
    pairs = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    assert [r.ratio for r in greedy.sequence_ratio(pairs, "a", "b").collect()] == [0.75, 0.0, 1.0]


def test_greedy_clusters_in_small_products_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 5))
    v[50:60] = v[10:20]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(int(i), v[i].tolist(), 1) for i in rng.permutation(90)], "id long, v array<double>, label int")
    whole, small = greedy._best(u, np.arange(90), np.arange(90)), greedy._best(u, np.arange(90), np.arange(90), 64)
    assert (whole[0] == small[0]).all() and np.allclose(whole[1], small[1])
    s = np.round(u @ u.T, 12)
    pairs, used, want = sorted((-s[i, j], i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.25), set(), set()
    for _, i, j in pairs:
        if not used & {i, j}:
            used |= {i, j}
            want.add((i, j))
    assert {(r.a, r.b) for r in greedy.disjoint_merges(frame).collect()} == want
    groups = [[i] for i in range(90)]
    while True:
        score, i, j = max((s[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if score < 0.6:
            break
        groups[-i] += groups.pop(-j)
    assert {r.id: r.cluster for r in greedy.agglomerative(frame, 0.6).collect()} == {i: min(g) for g in groups for i in g}
