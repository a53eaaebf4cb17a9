"""The driver's tables as memories, documents, turns, facts, edges and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dialect import NOW, bind, spell

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")

#: Each view as SQL over the tables, or over views named before it.
VIEWS = {
    "mem": """
      SELECT event_id AS id, user_id, ts AS created_at, #us(ts) AS us,
        (#us(@now) - #us(ts)) / 86400000000.0 AS age, CAST(floor((#us(@now) - #us(ts)) / 86400000000.0) AS BIGINT) AS days,
        CASE event_type WHEN 'signup' THEN 'fact' WHEN 'view' THEN 'context' WHEN 'click' THEN 'habit' WHEN 'purchase' THEN 'preference' ELSE 'event' END AS type,
        least(10.0, value / 20.0) AS importance, 0.5 + (event_id % 50) / 100.0 AS confidence, CAST(event_id % 12 AS BIGINT) AS access_count,
        event_type AS tag1, concat('k', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS STRING)) AS tag2,
        concat(event_type, ' event with key k', regexp_extract(props, '([0-9]+)', 1), ' of user ', CAST(user_id AS STRING)) AS text,
        CAST(event_id % 7 AS BIGINT) AS session_id, event_id % 17 = 0 AS is_archived
      FROM events""",
    "note": """
      SELECT id, user_id, CAST(#us(@now) - 15 * (#us(@now) - us) AS BIGINT) AS us, 15 * age AS age, CAST(floor(15 * age) AS BIGINT) AS days, 15 * age * (id % 7) / 7.0 AS idle, CAST(floor(15 * age * (id % 7) / 7.0) AS BIGINT) AS idle_days,
        CASE id % 24 WHEN 0 THEN 'preference' WHEN 1 THEN 'preference' WHEN 2 THEN 'fact' WHEN 3 THEN 'goal' WHEN 4 THEN 'habit' WHEN 5 THEN 'event' WHEN 6 THEN 'fact' WHEN 7 THEN 'fact' WHEN 8 THEN 'fact' WHEN 9 THEN 'fact' WHEN 10 THEN 'habit' WHEN 11 THEN 'habit' WHEN 12 THEN 'fact' WHEN 13 THEN 'event' WHEN 14 THEN 'context' WHEN 15 THEN 'goal' WHEN 16 THEN 'goal' WHEN 17 THEN 'context' WHEN 18 THEN 'preference' WHEN 19 THEN 'preference' WHEN 20 THEN 'fact' WHEN 21 THEN 'fact' WHEN 22 THEN 'context' WHEN 23 THEN 'fact' END AS type, importance, confidence, access_count, tag1, tag2, CAST(id % 4 AS BIGINT) AS n_tags, CAST(id % 5 AS BIGINT) AS n_meta, id % 3 = 0 AS has_entities, session_id,
        concat(CASE id % 24 WHEN 0 THEN 'I love coffee and I prefer tea at home' WHEN 1 THEN 'I hate coffee and do not like it at home' WHEN 2 THEN 'My name is Alex and I work at Google' WHEN 3 THEN 'I want to learn Python and machine learning this year' WHEN 4 THEN 'I usually go to the gym every day' WHEN 5 THEN 'Yesterday I met Jane Smith in San Francisco' WHEN 6 THEN 'John Baker works at Acme Corp' WHEN 7 THEN 'Mary Jones lives in Boston' WHEN 8 THEN 'I am 30 years old' WHEN 9 THEN 'I am 41 years old' WHEN 10 THEN 'I always eat meat' WHEN 11 THEN 'I never eat meat' WHEN 12 THEN 'Anna Miller studied at Stanford University' WHEN 13 THEN 'The project meeting is on 2024-01-15 at 10:30' WHEN 14 THEN 'ok' WHEN 15 THEN 'Remind me every week to review the budget!' WHEN 16 THEN 'When we talk about travel plans remind me' WHEN 17 THEN 'Call 555-123-4567 or write to bob@example.com' WHEN 18 THEN 'I am vegetarian now' WHEN 19 THEN 'I am not vegetarian' WHEN 20 THEN 'We use Docker, Kubernetes and React with AWS' WHEN 21 THEN 'The office is located in Seattle, Washington' WHEN 22 THEN 'maybe I will buy a new phone, price 250' WHEN 23 THEN 'I have worked as an engineer for 5 years and I was born in 1990' END, CASE id % 24 WHEN 14 THEN '' ELSE concat(CASE WHEN id % 2 = 0 THEN '. Key ' ELSE ' ' END, tag2) END) AS text
      FROM @mem""",
    "tag": "SELECT id, user_id, created_at, us, age, type, importance, session_id, tag1 AS tag FROM @mem UNION ALL SELECT id, user_id, created_at, us, age, type, importance, session_id, tag2 AS tag FROM @mem",
    "doc": "SELECT doc_id AS id, lang AS user_id, text, source, n_chars, CAST(length(text) AS BIGINT) AS text_length FROM documents",
    "pair": "SELECT id, old_id, old, text AS new, idle_days, confidence FROM (SELECT id, text, lag(id) OVER w AS old_id, lag(text) OVER w AS old, lag(idle_days) OVER w AS idle_days, lag(confidence) OVER w AS confidence FROM @note WINDOW w AS (PARTITION BY user_id, type ORDER BY us, id)) x WHERE old IS NOT NULL",
    "intent": """
      SELECT id, user_id, CASE id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'time' ELSE 'hybrid' END AS trigger, CASE id % 4 WHEN 0 THEN split('Coffee,budget', ',') WHEN 1 THEN split('boston', ',') WHEN 2 THEN split('opera,zebra', ',') END AS keywords, CASE id % 5 WHEN 0 THEN 'meat|tea' WHEN 1 THEN 'WORKS? at [A-Z]' END AS pattern,
        CASE id % 3 WHEN 0 THEN NULL ELSE us + (id % 11) * 864000000000 END AS due_us, CASE id % 13 WHEN 0 THEN #us(@now) - 86400000000 WHEN 1 THEN #us(@now) + 86400000000 END AS until_us, CASE id % 7 WHEN 0 THEN 86400000000 WHEN 1 THEN 604800000000 WHEN 2 THEN 2592000000000 END AS every_us, CASE id % 2 WHEN 0 THEN id % 6 END AS remaining, CASE id % 5 WHEN 0 THEN #us(@now) - 3600000000 WHEN 1 THEN #us(@now) + 864000000000 END AS expires_us
      FROM @note""",
    "space": """
      SELECT concat('r', CAST(r_regionkey AS STRING)) AS path, CAST(r_regionkey AS BIGINT) AS owner_id, r_regionkey % 2 = 1 AS is_public, true AS inherits FROM region
      UNION ALL SELECT concat('r', CAST(n_regionkey AS STRING), '/n', CAST(n_nationkey AS STRING)) AS path, CAST(n_nationkey + 100 AS BIGINT) AS owner_id, n_nationkey % 4 = 0 AS is_public, n_nationkey % 3 <> 0 AS inherits FROM nation
      UNION ALL SELECT concat('r', CAST(n_regionkey AS STRING), '/n', CAST(n_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING)) AS path, s_suppkey AS owner_id, s_suppkey % 10 = 0 AS is_public, s_suppkey % 5 <> 0 AS inherits FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "grants": "SELECT concat('r', CAST(n_regionkey AS STRING), '/n', CAST(n_nationkey AS STRING)) AS path, c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'admin' END AS permission FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0",
    "request": "SELECT concat('r', CAST(n_regionkey AS STRING), '/n', CAST(n_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING)) AS path, c_custkey AS user_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey",
    "request_place": "SELECT n_nationkey AS grp, concat('r', CAST(n_regionkey AS STRING), '/n', CAST(n_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING)) AS path FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    "request_member": "SELECT n_nationkey AS grp, c_custkey AS user_id FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "relation": """
      SELECT src, dst, relation FROM @links UNION ALL SELECT CAST(s_suppkey AS INT) AS src, s_nationkey AS dst, CASE s_suppkey % 6 WHEN 0 THEN 'works_at' WHEN 1 THEN 'studied_at' WHEN 2 THEN 'manages' WHEN 3 THEN 'knows' WHEN 4 THEN 'founded_by' ELSE 'part_of' END AS relation FROM supplier
      UNION ALL SELECT CAST(s_suppkey AS INT) AS src, s_nationkey + 5 AS dst, 'located_in' AS relation FROM supplier""",
    "parent": "SELECT id AS child, parent FROM (SELECT id, lag(id) OVER (PARTITION BY user_id, type ORDER BY us, id) AS parent FROM @note) x WHERE id % 5 <> 0 AND parent IS NOT NULL",
    "owned_note": "SELECT id, user_id % 10 AS user_id, CASE WHEN id % 5 <> 0 THEN id % 7 END AS agent_id, CASE id % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'public' ELSE 'shared' END AS visibility FROM @note",
    "agent": "SELECT CAST(n_nationkey AS BIGINT) AS agent_id, CAST(n_nationkey % 10 AS BIGINT) AS user_id FROM nation",
    "agent_grant": "SELECT CAST(src AS BIGINT) AS grantor, CAST(dst AS BIGINT) AS grantee, weight >= 0.6 AS active, CASE src % 4 WHEN 0 THEN #us(@now) - 1 WHEN 1 THEN #us(@now) + 1 END AS expires_us FROM @links",
    "entity_query": "SELECT CAST(n_nationkey AS BIGINT) AS qid, CAST(n_nationkey % 3 AS BIGINT) AS user_id, n_nationkey AS entity, 0.8 AS confidence FROM nation",
    "entity_owner": "SELECT n_nationkey AS id, CAST(n_nationkey % 3 AS BIGINT) AS user_id FROM nation",
    "doc_note": "SELECT doc_id AS id, text, source AS type FROM documents WHERE text IS NOT NULL",
    "vec": "SELECT vec_id AS id, embedding AS v, label FROM embeddings",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
    "facts": """
      SELECT o_orderkey AS id, o_custkey AS fact_id, o_orderdate AS valid_from, #us(o_orderdate) AS from_us, o_totalprice AS value, o_orderstatus AS status,
        lead(#us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS to_us
      FROM orders""",
    "edges": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem",
    "links": "SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, CASE n_nationkey % 5 WHEN 0 THEN 'works_at' WHEN 3 THEN 'located_in' WHEN 1 THEN 'manages' WHEN 4 THEN 'knows' ELSE 'part_of' END AS relation, 0.5 + (n_nationkey % 5) / 10.0 AS weight FROM nation",
    "usage": "SELECT o.o_orderkey AS id, o.o_custkey AS key_id, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS day, o.o_totalprice AS response_ms, CASE o.o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 ELSE 500 END AS status_code, CAST(o.o_orderkey % 100 AS BIGINT) AS tokens FROM orders o",
    "events": "SELECT * FROM main.events",
    "nation": "SELECT * FROM main.nation",
    "region": "SELECT * FROM main.region",
    "users": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS tier, c_nationkey AS nation, c_acctbal AS balance FROM customer",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views; each is built from its Parquet tables alone."""
    import re

    made: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name in made:
            return made[name]
        if name in TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return made[name]
        sql = VIEWS[name]
        for other in re.findall(r"@(\w+)", sql):
            if other in VIEWS:
                get(other).createOrReplaceTempView(f"_{other}")
        for table in TABLES:
            if re.search(rf"\b(FROM|JOIN) {table}\b", sql):
                get(table).createOrReplaceTempView(f"_t_{table}")
                sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 _t_{table}", sql)
        made[name] = spark.sql(spell(bind(sql, {"now": NOW} | {v: f"_{v}" for v in VIEWS}), 0))
        return made[name]

    return [get(n) for n in names]
