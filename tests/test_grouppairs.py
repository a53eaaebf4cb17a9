"""Products of ids of groups against plain loops."""

from pyspark.sql import functions as F

from memloom.operators import grouppairs, vectorsearch


def test_product_equals_all_pairs(spark, monkeypatch):
    left = [(i, i % 3) for i in range(60)] + [(7, 1)] * 9 + [(None, 1), (5, None), (900, 9)]
    right = [(i, i % 2) for i in range(50)] + [(8, 1)] * 30 + [(None, 1), (800, 8)]
    want = sorted((a, b) for a, g in left for b, h in right if g == h and None not in (a, b, g, h))
    frame = lambda rows: spark.createDataFrame(rows, "id long, g int")
    for block, part, tiles, together in [(512, 64, 8, 8_000_000), (4, 2, 3, 50), (1, 1, 1, 10**9)]:
        monkeypatch.setattr(grouppairs, "BLOCK", block)
        monkeypatch.setattr(grouppairs, "PART", part)
        monkeypatch.setattr(grouppairs, "TOGETHER", together)
        assert sorted((r.a, r.b) for r in grouppairs.product(frame(left), frame(right), "g", tiles=tiles).collect()) == want


def test_no_row_stands_for_many_pairs_however_large_a_label_or_frequent_an_id(spark, monkeypatch):
    met = []
    meeting = grouppairs.meeting
    monkeypatch.setattr(grouppairs, "meeting", lambda *a: met.append(meeting(*a)) or met[-1])
    ids = spark.range(6000).union(spark.range(3000).selectExpr("7")).select("id", F.lit(1).alias("label"), F.array(F.lit(1.0)).alias("v"))
    got = vectorsearch.dispatch(ids)
    assert got.count() == 9000 * 9000 - 5999 - 3001 * 3001
    lists = met[0].select(F.size("a").alias("a"), F.size("b").alias("b"))
    most = lists.agg(F.max("a"), F.max("b"), F.sum(F.col("a") * F.col("b"))).first()
    assert most[0] <= 8 and most[1] <= 512 and most[2] == 9000 * 9000
