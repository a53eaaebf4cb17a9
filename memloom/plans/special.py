"""Queries that are more than one SQL template: ordered folds, iteration, streams, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, cosinejoin, greedy
from ..sources import storage
from ..streaming import streams
from .views import load


def _one(view: str, build):
    return lambda spark, sf_dir: build(load(spark, sf_dir, view)[0])


def gra4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(load(spark, sf_dir, "links")[0].where("src <> dst"))


def sim5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate clusters: components of similar pairs, with their size."""
    found = components.components(cosinejoin.similar(load(spark, sf_dir, "vec")[0], 0.3, forest=True), "a", "b")
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("node")).cast("array<string>"), ",").alias("members"))


def str8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mem = load(spark, sf_dir, "mem")[0]
    pairs = mem.select("id", "user_id", F.col("text").alias("a")).join(mem.select((F.col("id") - 1).alias("id"), F.col("text").alias("b")), "id")
    return greedy.sequence_ratio(pairs, "a", "b").select("id", "ratio")


def _round_trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mem = load(spark, sf_dir, "mem")[0]
        path = storage.fresh_path(spark, f"export-{kind}")
        {"json": storage.export_json, "parquet": storage.export_parquet, "csv": storage.export_csv}[kind](mem, path)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mem.select(*storage.MEMORY_COLUMNS).schema)
        back = storage.import_records(spark, path, kind, schema)
        return back.select("id", "type", F.round("importance", 6).alias("importance"), "tag1", "access_count")

    return run


_BACK = "WITH {views} SELECT id, type, round(importance, 6) AS importance, tag1, access_count FROM mem"

QUERIES = {
    "win4": _one("mem", greedy.anchored_windows),
    "win6": _one("mem", greedy.interval_patterns),
    "win15": _one("mem", greedy.budget),
    "sim6": _one("vec", greedy.star_clusters),
    "sim11": _one("vec", greedy.agglomerative),
    "sim14": _one("vec", greedy.disjoint_merges),
    "sim17": _one("mem", greedy.reconcile),
    "lif4": _one("mem", greedy.compressed),
    "ret14": _one("mem", greedy.assembled_context),
    "tmp4": _one("mem", greedy.interval_patterns),
    "mig1": _one("vec", greedy.migrated),
    "cmp4": _one("doc", greedy.pruned_text),
    "str8": str8,
    "gra4": gra4,
    "sim5": sim5,
    "src7": _round_trip("json"),
    "src9": _round_trip("parquet"),
    "src10": _round_trip("csv"),
    "stm1": lambda spark, sf: streams.replay(spark, sf, lambda e: streams.fired_triggers(e, spark.createDataFrame([("purchase", 200.0, "notify"), ("error", 0.0, "page")], "event_type string, least double, action string")), "append"),
    "stm2": lambda spark, sf: streams.replay(spark, sf, streams.access_patterns, "update", ["user_id", "event_type"]),
    "stm3": lambda spark, sf: streams.replay(spark, sf, streams.sessions),
    "stm5": lambda spark, sf: streams.replay(spark, sf, streams.feedback_scores, "update", ["user_id"]),
    "stm6": lambda spark, sf: streams.replay(spark, sf, streams.first_of_kind, "append"),
    "stm7": lambda spark, sf: streams.effectiveness(streams.read_events(spark, sf, False)),
    "stm10": lambda spark, sf: streams.replay(spark, sf, streams.tumbling, "append"),
    "stm_w3": lambda spark, sf: streams.replay(spark, sf, streams.sessions),
    "stm_w1": lambda spark, sf: streams.replay(spark, sf, streams.tumbling, "update", ["start", "event_type"]),
    "stm_w2": lambda spark, sf: streams.replay(spark, sf, streams.sliding, "update", ["start"]),
}

_COMPONENTS = """WITH RECURSIVE {views}, e AS (SELECT src AS u, dst AS v FROM links WHERE src <> dst UNION SELECT dst AS u, src AS v FROM links WHERE src <> dst),
  reach(v, u) AS (SELECT u AS v, u FROM e UNION SELECT e.v, r.u FROM reach r JOIN e ON e.u = r.v) SELECT v AS node, min(u) AS component FROM reach GROUP BY v"""

#: Twins over the views named in braces' place.
ORACLE = {
    "win4": ("mem", """WITH RECURSIVE {views}, r AS (SELECT user_id, id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, id) AS k FROM mem),
      w AS (SELECT user_id, id, k, us AS start, 0::BIGINT AS win FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.id, r.k, CASE WHEN r.us - w.start > 14400000000 THEN r.us ELSE w.start END, CASE WHEN r.us - w.start > 14400000000 THEN w.win + 1 ELSE w.win END FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
      SELECT user_id, id, win FROM w"""),
    "gra4": ("links", _COMPONENTS),
    "sim5": ("vec", """WITH RECURSIVE {views}, e AS (SELECT a.id AS a, b.id AS b FROM vec a JOIN vec b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) >= 0.3),
      reach(v, u) AS (SELECT a, a FROM e UNION SELECT e.b, r.u FROM reach r JOIN e ON e.a = r.v) SELECT component, count(*) AS n, string_agg(v::VARCHAR, ',' ORDER BY v) AS members FROM (SELECT v, min(u) AS component FROM reach GROUP BY v) x GROUP BY component"""),
    "win15": ("mem", """WITH RECURSIVE {views}, r AS (SELECT user_id, id, length(text) // 4 + 1 AS n, row_number() OVER (PARTITION BY user_id ORDER BY importance * confidence DESC, id) AS k FROM mem),
      w AS (SELECT user_id, id, k, n <= 60 AS kept, 60 - CASE WHEN n <= 60 THEN n ELSE 0 END AS room FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.id, r.k, r.n <= w.room, w.room - CASE WHEN r.n <= w.room THEN r.n ELSE 0 END FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
      SELECT user_id, id FROM w WHERE kept"""),
    "stm10": ("mem", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 HOUR"),
    "lif4": ("mem", "WITH {views} SELECT id, 'ok' AS state FROM mem"),
    "src7": ("mem", _BACK),
    "src9": ("mem", _BACK),
    "src10": ("mem", _BACK),
    "stm1": ("mem", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'notify' ELSE 'page' END AS action FROM events WHERE (event_type = 'purchase' AND value >= 200) OR event_type = 'error'"),
    "stm2": ("mem", "SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id, event_type"),
    "stm5": ("mem", "SELECT user_id, round(avg(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.6 WHEN 'view' THEN 0.1 ELSE 0.0 END), 8) AS score FROM events GROUP BY user_id"),
    "stm6": ("mem", "SELECT DISTINCT user_id, event_type, props FROM events"),
    "stm3": ("mem", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) a) b GROUP BY user_id, run"""),
    "stm_w3": ("mem", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) a) b GROUP BY user_id, run"""),
    "stm7": ("mem", """WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS x FROM events),
      f AS (SELECT user_id, k, 0.5::DOUBLE * 0.9::DOUBLE + x * 0.1::DOUBLE AS ema FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, f.ema * 0.9::DOUBLE + r.x * 0.1::DOUBLE FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
      SELECT user_id, round(max_by(ema, k), 8) AS ema FROM f GROUP BY user_id"""),
    "stm_w2": ("mem", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS start, count(*) AS n, round(sum(value), 4) AS v FROM events CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) t GROUP BY time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE"),
    "mig1": ("vec", "WITH {views}, n AS (SELECT id, CAST(v AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS norm FROM vec) SELECT id, round(norm, 6) AS norm, round(v[1] / norm, 6) AS first FROM n"),
    "stm_w1": ("mem", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type"),
}
