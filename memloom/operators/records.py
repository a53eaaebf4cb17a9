"""Record keeping and composite operators: versions, provenance, namespaces, intents,
consolidation reports, rule-based extraction, graph population, combined health."""

from __future__ import annotations

from ..plans.dialect import Op

OPS = [
    Op("src8", "SELECT concat('{\"id\":', CAST(id AS STRING), ',\"type\":\"', type, '\",\"tag\":\"', tag2, '\"}') AS line FROM @mem", ("mem",), "JSON lines, one record each."),
    Op("src13", "SELECT src AS id, 'link' AS kind, CAST(count(*) AS BIGINT) AS n FROM @links GROUP BY src UNION ALL SELECT dst AS id, 'target' AS kind, CAST(count(*) AS BIGINT) AS n FROM @links GROUP BY dst", ("links",), "Counts of an exported graph."),
    Op("src14", "SELECT tier, count(*) AS n, round(avg(balance), 6) AS balance FROM @users GROUP BY tier", ("users",), "Side tables."),
    Op("flt7", "SELECT id FROM @facts WHERE status IN ('F', 'O') AND from_us <= @at AND coalesce(to_us, 9000000000000000000) > @at", ("facts",), "Bi-temporal predicate with a status.", {"at": 820000000000000}),
    Op("joi5", "SELECT r.qid, r.id, m.type FROM (SELECT id % 5 AS qid, id FROM @mem WHERE importance > 9.9) r JOIN @mem m ON m.id = r.id", ("mem",), "Lookup of retrieved ids."),
    Op("joi6", "SELECT a.src, b.dst, a.relation AS first_relation, b.relation AS second_relation FROM @links a JOIN @links b ON a.dst = b.src AND a.src <> b.dst", ("links",), "Two-hop adjacency."),
    Op("top6", "SELECT tag, n FROM (SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag) AS r FROM (SELECT tag, count(*) AS n FROM @tag GROUP BY tag) x) y WHERE r <= 5", ("tag",), "Most used saved searches."),
    Op("set1", "SELECT id, 'facts' AS collection FROM @mem WHERE type NOT IN ('preference', 'habit') UNION ALL SELECT id, 'prefs' AS collection FROM @mem WHERE type IN ('preference', 'habit')", ("mem",), "Union of two collections."),
    Op("set4", "SELECT user_id, #joined(tag) AS tags FROM @tag GROUP BY user_id", ("tag",), "Union of tags on a merge."),
    Op("str10", "SELECT a.fact_id, a.id AS old_id, b.id AS new_id, CASE WHEN a.status = b.status THEN 'same' ELSE concat(a.status, '->', b.status) END AS status_change, round(b.value - a.value, 6) AS delta FROM @facts a JOIN @facts b ON b.fact_id = a.fact_id AND b.from_us = a.to_us AND b.id <> a.id", ("facts",), "Difference between consecutive versions."),
    Op("dat1", "SELECT id, round(age, 9) AS fractional_days, days FROM @mem", ("mem",), "Age in fractional and in whole days."),
    Op("mth3", "SELECT a.id, b.id AS other, round(#dot(a.v, b.v) / (sqrt(#dot(a.v, a.v)) * sqrt(#dot(b.v, b.v))), 8) AS cosine FROM @vec a JOIN @vec b ON b.id = a.id + 1", ("vec",), "Cosine similarity."),
    Op("arr1", "SELECT user_id, tag, share FROM (SELECT user_id, tag, round(n / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE), 8) AS share, n FROM (SELECT user_id, tag, count(*) AS n FROM @tag GROUP BY user_id, tag) x) y WHERE n >= 2 AND share > 0.1", ("tag",), "Common tags by share."),
    Op("ret6", "SELECT q.id AS qid, v.id, CASE WHEN q.id % 3 = 0 THEN 'vector_only' WHEN q.id % 3 = 1 THEN 'keyword_only' ELSE 'hybrid' END AS mode FROM @vec q JOIN @vec v ON v.label = q.label AND v.id <> q.id", ("vec",), "Dispatch by mode."),
    Op("ret8", "SELECT id, round(greatest(0.0, least(1.0, (importance * 4 - 20 + 10) / 20.0)), 9) AS rerank FROM @mem", ("mem",), "Normalised rerank score."),
    Op("ret17", "SELECT m.id, round(0.9 * m.confidence + 0.1 * f.score, 9) AS score FROM @mem m JOIN (SELECT user_id, avg(CASE WHEN tag1 = 'purchase' THEN 1.0 ELSE 0.3 END) AS score FROM @mem GROUP BY user_id) f ON f.user_id = m.user_id", ("mem",), "Recall with feedback."),
    Op("hlt14", "SELECT user_id, id, action FROM (SELECT user_id, id, action, row_number() OVER (PARTITION BY user_id ORDER BY action, id) AS r FROM (SELECT user_id, id, CASE WHEN importance < 1 AND access_count = 0 THEN 'cleanup' WHEN access_count > 9 AND importance < 4 THEN 'raise' WHEN access_count = 0 AND importance > 9 THEN 'lower' END AS action FROM @mem) x WHERE action IS NOT NULL) y WHERE r <= 20", ("mem",), "Healing actions, up to a limit."),
    Op("hlt16", "SELECT m.user_id, count(*) AS n, CAST(sum(CASE WHEN m.age > 20 AND m.access_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS stale, count(*) - count(DISTINCT m.text) AS copies, count(DISTINCT m.tag2) AS topics FROM @mem m GROUP BY m.user_id", ("mem",), "Combined quality report."),
    Op("ins7", "SELECT tag, CAST(sum(CASE WHEN age > 20 THEN 1 ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN age <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS late FROM @tag GROUP BY tag", ("tag",), "Tag trends."),
    Op("prd3", "SELECT user_id, kind, n FROM (SELECT user_id, 'refresh' AS kind, count(*) AS n FROM @mem WHERE age > 20 AND importance > 7 GROUP BY user_id UNION ALL SELECT user_id, 'consolidate' AS kind, count(*) AS n FROM @mem WHERE type = 'context' GROUP BY user_id HAVING count(*) >= 10 UNION ALL SELECT user_id, 'reinforce' AS kind, count(*) AS n FROM @mem WHERE type = 'habit' AND access_count > 8 GROUP BY user_id) x", ("mem",), "Recommendations by rule."),
    Op("gra7", "SELECT l.src, l.relation, count(*) AS n FROM (SELECT src, dst, relation FROM @links UNION ALL SELECT a.src, b.dst, 'related_to' AS relation FROM @links a JOIN @links b ON b.src = a.dst) l GROUP BY l.src, l.relation", ("links",), "Connections by relation."),
    Op("gra10", "SELECT concat('memory_', CAST(id AS STRING)) AS src, concat('topic_', tag) AS dst, 'about' AS relation FROM @tag UNION ALL SELECT concat('memory_', CAST(id AS STRING)) AS src, concat('entity_', CAST(user_id AS STRING)) AS dst, 'mentions' AS relation FROM @mem", ("tag", "mem"), "Links that populate the graph."),
    Op("gra17", "SELECT tag, CAST(CAST(created_at AS DATE) AS STRING) AS day, count(*) AS n FROM @tag GROUP BY tag, CAST(CAST(created_at AS DATE) AS STRING)", ("tag",), "Mentions over time."),
    Op("txt3", "SELECT tag AS entity, count(*) AS mentions, min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT user_id) AS users FROM @tag GROUP BY tag", ("tag",), "Entity profiles."),
    Op("txt16", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS context_chars FROM @turns", ("turns",), "Running context."),
    Op("cmp5", "SELECT id, #size(#tokens(text)) AS before_n, CAST(floor(#size(#tokens(text)) * 0.5) AS BIGINT) AS after_n, round(#size(#distinct(#tokens(text))) / greatest(1.0, #size(#tokens(text))), 8) AS preserved FROM @doc", ("doc",), "Token pruning metrics."),
    Op("cmp6", "SELECT user_id, tag, count(*) AS episodes, round(avg(importance), 8) AS confidence, CASE WHEN count(*) >= 10 THEN 'abstract' WHEN count(*) >= 5 THEN 'general' ELSE 'specific' END AS level FROM @tag GROUP BY user_id, tag", ("tag",), "Episodic to semantic, by topic."),
    Op("con3", "SELECT user_id, CAST(CAST(created_at AS DATE) AS STRING) AS night, count(*) AS reviewed, CAST(sum(CASE WHEN importance < 2 THEN 1 ELSE 0 END) AS BIGINT) AS dropped, CAST(sum(CASE WHEN importance >= 8 THEN 1 ELSE 0 END) AS BIGINT) AS promoted FROM @mem WHERE age <= 12 GROUP BY user_id, CAST(CAST(created_at AS DATE) AS STRING)", ("mem",), "Sleep-phase report by user and night."),
    Op("con5", "SELECT user_id, type, #joined(tag2) AS key_facts, round(max(importance), 8) AS best FROM @mem GROUP BY user_id, type", ("mem",), "Key facts of a cluster."),
    Op("con6", "SELECT tag2, type, count(*) AS n, count(DISTINCT user_id) AS users FROM @mem GROUP BY tag2, type HAVING count(DISTINCT user_id) >= 2", ("mem",), "Groups across users."),
    Op("con7", "SELECT user_id, count(*) AS n, count(DISTINCT type) AS types, CASE WHEN count(DISTINCT type) <= 2 THEN true ELSE false END AS may_run FROM @mem WHERE age <= 3 GROUP BY user_id", ("mem",), "Gate of a consolidation group."),
    Op("prv2", "SELECT id, #hits(text, 'https?://[^ ]+') AS citations FROM @doc", ("doc",), "Citations."),
    Op("tms3", "SELECT id, confidence FROM @mem", ("mem",), "Belief lookup."),
    Op("rtn5", "SELECT id FROM @mem WHERE age > CASE tag1 WHEN 'error' THEN 29 WHEN 'purchase' THEN 25 ELSE 15 END", ("mem",), "Audit retention by severity."),
    Op("rtn6", "SELECT user_id, max(created_at) AS last_run, CASE WHEN min(age) > 1 THEN true ELSE false END AS due FROM @mem WHERE tag1 = 'signup' GROUP BY user_id", ("mem",), "Maintenance that is due."),
    Op("stm8", "SELECT job, n FROM (SELECT 'expire' AS job, count(*) AS n FROM @mem WHERE age > 28 UNION ALL SELECT 'decay' AS job, count(*) AS n FROM @mem WHERE age > 1 UNION ALL SELECT 'dedup' AS job, count(*) - count(DISTINCT text) AS n FROM @mem) x", ("mem",), "What the scheduled jobs would touch."),
    Op("stm9", "SELECT id, CAST(row_number() OVER (ORDER BY us, id) AS BIGINT) AS place FROM @mem WHERE tag1 = 'error'", ("mem",), "Replay order of an offline queue."),
    Op("stm11", "SELECT tag1, id FROM (SELECT tag1, id, row_number() OVER (PARTITION BY tag1 ORDER BY us DESC, id DESC) AS r FROM @mem) x WHERE r <= 10", ("mem",), "Fire history, newest first."),
    Op("stm12", "SELECT id, CASE WHEN tag1 = 'purchase' THEN 'completed' WHEN tag1 = 'error' THEN 'cancelled' ELSE 'active' END AS state FROM @mem", ("mem",), "Intent states."),
    Op("stm13", "SELECT user_id, id, tag1 FROM (SELECT user_id, id, tag1, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, id DESC) AS r FROM @mem WHERE tag1 IN ('click', 'purchase')) x WHERE r <= 5", ("mem",), "Latest feedback."),
    Op("agt2", "SELECT session_id, user_id, count(*) AS transfers, max(created_at) AS last FROM @mem WHERE tag1 = 'click' GROUP BY session_id, user_id", ("mem",), "Transfers."),
    Op("agt3", "SELECT session_id, id, tag1 FROM (SELECT session_id, id, tag1, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, id DESC) AS r FROM @mem WHERE tag1 <> 'view') x WHERE r <= 20", ("mem",), "Notifications of a space."),
    Op("mon4", "SELECT tag1, CAST(CAST(created_at AS DATE) AS STRING) AS day, count(*) AS n, round(sum(importance), 6) AS total FROM @mem WHERE age <= 20 GROUP BY tag1, CAST(CAST(created_at AS DATE) AS STRING)", ("mem",), "Counters by day, old ones purged."),
    Op("svc1", "SELECT user_id, count(*) AS n, round(avg(importance), 8) AS importance, round(avg(exp(-age / 30.0)), 8) AS freshness, count(DISTINCT tag2) AS topics FROM @mem GROUP BY user_id", ("mem",), "Service summary."),
    Op("cru1", "SELECT session_id, min(created_at) AS started, max(created_at) AS ended, CASE WHEN min(age) > 0.1 THEN 'completed' ELSE 'active' END AS state FROM @mem GROUP BY session_id", ("mem",), "Session records."),
    Op("src17", "SELECT CAST(CAST(created_at AS DATE) AS STRING) AS snapshot, count(*) AS n, max(id) AS last_id FROM @mem GROUP BY CAST(CAST(created_at AS DATE) AS STRING)", ("mem",), "Rows of each daily snapshot."),
    Op("set3", "SELECT a.id, round(#common(a.t, b.t) / CAST(#size(a.t) + #size(b.t) - #common(a.t, b.t) AS DOUBLE), 9) AS jaccard FROM (SELECT id, #distinct(#tokens(text)) AS t FROM @mem) a JOIN (SELECT id, #distinct(#tokens(text)) AS t FROM @mem) b ON b.id = a.id + 1", ("mem",), "Jaccard similarity of token sets."),
    Op("dat3", "SELECT id, CASE WHEN h >= 5 AND h < 8 THEN 'early_morning' WHEN h >= 8 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 21 THEN 'evening' WHEN h >= 21 OR h = 0 THEN 'night' ELSE 'late_night' END AS period FROM (SELECT id, hour(created_at) AS h FROM @mem) x", ("mem",), "Period of the day."),
    Op("mth2", "SELECT id, round(exp(-age / 30.0), 9) AS e, round(pow(0.5, age / 30.0), 9) AS p, round(1.0 / (1 + ln(1 + age)), 9) AS l FROM @mem", ("mem",), "The decay family."),
    Op("ret7", "SELECT k.id, round(v.s, 8) AS sim FROM (SELECT id FROM @mem WHERE tag1 = 'click') k JOIN (SELECT m.id, #dot(q.v, m.v) / (sqrt(#dot(q.v, q.v)) * sqrt(#dot(m.v, m.v))) AS s FROM @vec m CROSS JOIN (SELECT v FROM @vec WHERE id = 0) q WHERE m.id <> 0) v ON v.id = k.id", ("mem", "vec"), "Candidates: only ids among one query's vector hits."),
    Op("sim20", "SELECT id, CASE WHEN score >= 0.98 THEN 'exact' WHEN score >= 0.85 THEN 'soft' WHEN score >= 0.75 THEN 'paraphrase' ELSE 'different' END AS kind FROM (SELECT id, confidence AS score FROM @mem) x", ("mem",), "Kinds of duplicates from a given pair score."),
    Op("lif5", "SELECT tier, low, high FROM (SELECT 'hot' AS tier, 0 AS low, 30 AS high UNION ALL SELECT 'warm' AS tier, 30 AS low, 90 AS high UNION ALL SELECT 'cold' AS tier, 90 AS low, 365 AS high) c WHERE EXISTS (SELECT 1 FROM @mem m WHERE m.age >= c.low AND m.age < c.high)", ("mem",), "Configured tiers in use."),
    Op("txt17", "SELECT id, kind, CASE WHEN hits >= 3 THEN 1.0 WHEN hits = 2 THEN 0.8 WHEN hits = 1 THEN 0.6 ELSE 0.3 END AS confidence FROM (SELECT id, CASE WHEN #like(text, 'purchase') THEN 'preference' WHEN #like(text, 'click') THEN 'habit' ELSE 'fact' END AS kind, #hits(text, '(purchase|click|key|user)') AS hits FROM @mem) x", ("mem",), "Classifier's fallback with confidence by hits."),
    Op("mon5", "SELECT concat('memloom_events_total{kind=\"', tag1, '\"} ', CAST(count(*) AS STRING)) AS line FROM @mem GROUP BY tag1", ("mem",), "Text export of counters."),
    Op("svc2", "SELECT type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CASE WHEN age > 25 THEN 1 ELSE 0 END) AS BIGINT) AS expired FROM @mem GROUP BY type", ("mem",), "Facade analytics."),
    Op("svc3", "SELECT user_id, count(*) - count(DISTINCT text) AS to_dedup, CAST(sum(CASE WHEN importance < 1 THEN 1 ELSE 0 END) AS BIGINT) AS to_clean, CAST(sum(CASE WHEN age > 28 THEN 1 ELSE 0 END) AS BIGINT) AS to_expire FROM @mem GROUP BY user_id", ("mem",), "What the batch jobs find for each user."),
]
