"""Filters, projections, joins, aggregates and set operations."""

from __future__ import annotations

from ..plans.dialect import Op

OPS = [
    Op("src1", "SELECT id, user_id, type FROM @mem WHERE (user_id = @user OR session_id = @user) AND type IN ('fact', 'habit', 'context') AND (tag1 = 'click' OR tag2 = 'k1' OR type = 'fact') AND NOT is_archived", ("mem",), "Filtered scan.", {"user": 3}),
    Op("src3", "SELECT m.id, m.type, round(m.importance, 7) AS importance FROM @mem m WHERE m.id IN (1, 5, 77, 500000001)", ("mem",), "Get by ids; missing ones are skipped."),
    Op("src4", "SELECT id, type, round(importance, 7) AS importance FROM @mem WHERE id % 10 <> 0 UNION ALL SELECT id, 'updated' AS type, 1.0 AS importance FROM @mem WHERE id % 10 = 0", ("mem",), "Upsert: new versions replace rows of equal id."),
    Op("src5", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS r FROM @mem WHERE type = 'habit' AND importance BETWEEN 2 AND 9 AND (tag1 = 'click' OR tag2 = 'k3')) x WHERE r <= @k", ("mem",), "List with filters, newest first.", {"k": 100}),
    Op("src6", "SELECT id, access_count FROM (SELECT id, access_count, row_number() OVER (ORDER BY access_count DESC, id) AS r FROM @mem WHERE tag2 = 'k5') x WHERE r <= @k", ("mem",), "List by metadata equality and a sort key.", {"k": 50}),
    Op("src11", "SELECT id, #sub(#sub(#sub(text, '[A-Za-z0-9._%+-]+[@at][A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[EMAIL]'), '[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}', '[PHONE]'), '[0-9]{3}-[0-9]{2}-[0-9]{4}', '[SSN]') AS text FROM @doc WHERE user_id = 'en'", ("doc",), "Export with personal data masked.", {"at": "@"}),
    Op("src15", "SELECT tag, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM @tag GROUP BY tag", ("tag",), "Inverted index of tags."),
    Op("src16", "SELECT id, r FROM (SELECT id, CAST(row_number() OVER (ORDER BY importance DESC, created_at, id) AS BIGINT) AS r FROM @mem WHERE tag1 = 'error' AND access_count < 3) x WHERE r <= 200", ("mem",), "Pending operations by priority, with attempts left."),
    Op("flt1", "SELECT id FROM @mem WHERE user_id IN (1, 2, 3, 4, 5) AND tag1 = 'view' AND tag2 <> 'k0' AND importance BETWEEN 1 AND 8 AND confidence >= 0.6", ("mem",), "Conjunctive batch filter."),
    Op("flt2", "SELECT DISTINCT id FROM @tag WHERE tag IN ('signup', 'k7')", ("tag",), "Any of several tags."),
    Op("flt3", "SELECT id FROM @mem WHERE age > 21", ("mem",), "Past their time to live."),
    Op("flt4", "SELECT id FROM @doc WHERE lower(text) LIKE '%licen%'", ("doc",), "Case-insensitive substring."),
    Op("flt5", "SELECT CAST(sum(CASE WHEN age * 24 <= 72 THEN 1 ELSE 0 END) AS BIGINT) AS last_3_days, CAST(sum(CASE WHEN age <= 7 THEN 1 ELSE 0 END) AS BIGINT) AS last_week, CAST(sum(CASE WHEN age <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS last_month, CAST(sum(CASE WHEN created_at >= TIMESTAMP '2024-01-29 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS this_week FROM @mem", ("mem",), "Named time ranges."),
    Op("flt8", "SELECT id FROM @usage WHERE status_code >= 400 AND response_ms > 100000 AND tokens BETWEEN 10 AND 60", ("usage",), "Trace query."),
    Op("flt9", "SELECT id, text_length, CAST(floor(text_length / 4.0) AS BIGINT) AS token_count FROM @doc", ("doc",), "Size columns."),
    Op("flt11", "SELECT id, replace(replace('User {user} did {what}', '{user}', CAST(user_id AS STRING)), '{what}', tag1) AS text FROM @mem", ("mem",), "Template instantiation."),
    Op("flt12", "SELECT id, CASE WHEN tag1 = 'error' THEN least(10.0, greatest(0.0, importance + 2.5)) ELSE importance END AS importance, least(1.0, greatest(0.0, confidence * 1.5)) AS confidence FROM @mem", ("mem",), "Batch update with clamps."),
    Op("joi1", "SELECT u.name, u.tier, count(*) AS n, round(sum(g.response_ms), 5) AS ms FROM @usage g JOIN @users u ON g.key_id = u.id GROUP BY u.name, u.tier", ("usage", "users"), "Usage with its users."),
    Op("joi2", "SELECT u.id, count(g.id) AS n, CAST(coalesce(sum(g.tokens), 0) AS BIGINT) AS tokens, max(g.day) AS last_day FROM @users u LEFT JOIN @usage g ON g.key_id = u.id GROUP BY u.id", ("users", "usage"), "Left join and aggregate."),
    Op("joi4", "SELECT id FROM @mem m WHERE EXISTS (SELECT 1 FROM @users u WHERE u.id = m.user_id AND u.tier = 'BUILDING')", ("mem", "users"), "Semi join."),
    Op("joi7", "SELECT user_id, tag1, next_tag, count(*) AS n FROM (SELECT user_id, tag1, lead(tag1) OVER w AS next_tag, (lead(us) OVER w) - us AS gap FROM @mem WINDOW w AS (PARTITION BY user_id ORDER BY us, id)) x WHERE gap <= 3600000000 GROUP BY user_id, tag1, next_tag", ("mem",), "Consecutive events within an hour."),
    Op("joi8", "SELECT a.id, b.id AS other FROM @facts a JOIN @facts b ON a.fact_id = b.fact_id AND a.id < b.id AND a.from_us < coalesce(b.to_us + 864000000000, 9000000000000000000) AND coalesce(a.to_us + 864000000000, 9000000000000000000) > b.from_us", ("facts",), "Overlapping validity intervals of a fact, with ten days of grace."),
    Op("joi9", "SELECT m.id FROM @mem m LEFT JOIN (SELECT id, balance FROM @users WHERE balance > 5000) p ON p.id = m.user_id WHERE m.tag1 = 'signup' OR p.id IS NOT NULL", ("mem", "users"), "Access by ownership or permission."),
    Op("agg1", "SELECT type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(floor(length(text) / 4.0)) AS BIGINT) AS tokens, CAST(floor(avg(length(text))) AS BIGINT) AS avg_chars, CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars FROM @mem GROUP BY type", ("mem",), "Memory sizes."),
    Op("agg2", "SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE tag1 <> 'error') AS completed, count(*) FILTER (WHERE tag1 = 'error') AS failed, round(avg(importance), 8) AS mean, round(min(importance), 8) AS low, round(max(importance), 8) AS high FROM @mem GROUP BY user_id", ("mem",), "Conditional counts by user."),
    Op("agg3", "SELECT u.tier, count(DISTINCT u.id) AS users, count(DISTINCT g.id) AS calls, CAST(coalesce(sum(g.tokens), 0) AS BIGINT) AS tokens, max(g.day) AS last_day FROM @users u LEFT JOIN @usage g ON g.key_id = u.id GROUP BY u.tier", ("users", "usage"), "Distinct counts over a fan-out join."),
    Op("agg4", "SELECT key_id, count(*) AS calls, round(avg(response_ms), 7) AS latency, CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(100.0 * sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) / count(*), 7) AS error_rate FROM @usage GROUP BY key_id", ("usage",), "API-key statistics."),
    Op("agg5", "SELECT day, count(*) AS calls, count(DISTINCT key_id) AS active FROM @usage GROUP BY day", ("usage",), "Daily counts."),
    Op("agg6", "SELECT user_id, concat(type, '_', tag2) AS grp, count(*) AS n FROM @mem GROUP BY user_id, concat(type, '_', tag2) HAVING count(*) >= 2", ("mem",), "Consolidation groups."),
    Op("agg7", "SELECT user_id, tag, n FROM (SELECT user_id, tag, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) AS r FROM (SELECT user_id, tag, count(*) AS n FROM @tag GROUP BY user_id, tag) x) y WHERE r <= 10", ("tag",), "Top tags."),
    Op("agg8", "SELECT user_id, type FROM (SELECT user_id, type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, type) AS r FROM (SELECT user_id, type, count(*) AS n FROM @mem GROUP BY user_id, type) x) y WHERE r = 1", ("mem",), "Dominant type, ties by name."),
    Op("agg9", "SELECT user_id, round(var_pop(importance), 8) AS var, round(stddev_pop(importance), 8) AS sd, round(stddev_pop(importance) / avg(importance), 8) AS cv FROM @mem GROUP BY user_id", ("mem",), "Population moments."),
    Op("agg10", "SELECT status_code, round(#percentile(response_ms, 0.5), 7) AS p50, round(#percentile(response_ms, 0.95), 7) AS p95, round(#percentile(response_ms, 0.99), 7) AS p99 FROM @usage GROUP BY status_code", ("usage",), "Exact percentiles, interpolated."),
    Op("agg11", "SELECT user_id, round(-sum(p * ln(p)) / ln(2.0) / (ln(9.0) / ln(2.0)), 8) AS entropy FROM (SELECT user_id, n / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS p FROM (SELECT user_id, type, count(*) AS n FROM @mem GROUP BY user_id, type) x) y GROUP BY user_id", ("mem",), "Shannon entropy of types over log2(9)."),
    Op("agg12", "SELECT user_id, round(coalesce(sum(w * s) / sum(w), 0.5), 8) AS score FROM (SELECT user_id, pow(0.5, age / 30.0) AS w, CASE tag1 WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.6 WHEN 'view' THEN 0.1 ELSE 0.0 END AS s FROM @mem) x GROUP BY user_id", ("mem",), "Decayed weighted mean of feedback."),
    Op("agg13", "SELECT user_id, CAST(sum(CASE WHEN tag1 = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS relevant, CAST(sum(CASE WHEN tag1 = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS partly, CAST(sum(CASE WHEN tag1 = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS outdated, CAST(sum(CASE WHEN tag1 IN ('error', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS irrelevant FROM @mem GROUP BY user_id", ("mem",), "Feedback counts."),
    Op("agg14", "SELECT session_id, round(avg(importance), 8) AS mean, count(*) AS n FROM @mem GROUP BY session_id", ("mem",), "Session means."),
    Op("agg15", "SELECT user_id, type, count(*) AS n, #joined(tag2) AS shared FROM @mem GROUP BY user_id, type", ("mem",), "Agent statistics."),
    Op("agg16", "SELECT CASE WHEN days <= 7 THEN 'hot' WHEN days <= 30 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n, CAST(sum(#bytes(text)) AS BIGINT) AS bytes, min(created_at) AS oldest, max(created_at) AS newest FROM @mem GROUP BY CASE WHEN days <= 7 THEN 'hot' WHEN days <= 30 THEN 'warm' ELSE 'cold' END", ("mem",), "Tier statistics."),
    Op("agg17", "SELECT tag1 AS action, count(*) AS n, CAST(sum(CASE WHEN age <= 7 THEN 1 ELSE 0 END) AS BIGINT) AS last_7d, CAST(sum(CASE WHEN age <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS last_30d, CAST(sum(CASE WHEN access_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(100.0 - 100.0 * sum(CASE WHEN access_count = 0 THEN 1 ELSE 0 END) / count(*), 7) AS success FROM @mem GROUP BY tag1", ("mem",), "Audit statistics."),
    Op("agg18", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT type) AS types, count(*) AS n, CAST(sum(access_count) AS BIGINT) AS uses FROM @mem", ("mem",), "Store statistics."),
    Op("agg19", "SELECT user_id, tokens_in, tokens_out, round(tokens_out / CAST(tokens_in AS DOUBLE), 8) AS ratio, round(tokens_in * 0.00003 + tokens_out * 0.00006, 8) AS cost, (tokens_in - tokens_out) * 6 AS saved FROM (SELECT user_id, CAST(sum(floor(length(text) / 4.0)) AS BIGINT) AS tokens_in, CAST(sum(floor(length(text) / 10.0)) AS BIGINT) AS tokens_out FROM @mem GROUP BY user_id) x", ("mem",), "Compaction metrics."),
    Op("set2", "SELECT a.user_id, a.tag FROM (SELECT DISTINCT user_id, tag FROM @tag WHERE age <= 15) a WHERE NOT EXISTS (SELECT 1 FROM @tag b WHERE b.age > 15 AND b.user_id = a.user_id AND b.tag = a.tag)", ("tag",), "Tags gained in the newer half."),
    Op("set5", "SELECT u.user_id, t.type FROM (SELECT DISTINCT user_id FROM @mem) u CROSS JOIN (SELECT DISTINCT type FROM @mem) t WHERE NOT EXISTS (SELECT 1 FROM @mem m WHERE m.user_id = u.user_id AND m.type = t.type AND m.importance > 5)", ("mem",), "Types a user lacks among important memories; both sides are few."),
    Op("set6", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'graph only' ELSE 'store only' END AS side FROM (SELECT id FROM @mem WHERE id % 3 <> 0) a FULL OUTER JOIN (SELECT id FROM @mem WHERE id % 5 <> 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL", ("mem",), "Drift between two stores, both directions."),
    Op("top2", "SELECT node, n FROM (SELECT node, n, row_number() OVER (ORDER BY n DESC, node) AS r FROM (SELECT node, count(DISTINCT other) AS n FROM (SELECT src AS node, dst AS other FROM @links UNION ALL SELECT dst AS node, src AS other FROM @links) x GROUP BY node) y) z WHERE r <= 10", ("links",), "Most connected nodes."),
    Op("top3", "SELECT tag, round(0.6 * n / CAST(max(n) OVER () AS DOUBLE) + 0.4 * greatest(0.1, 1 - age / 90.0), 8) AS score FROM (SELECT tag, count(*) AS n, min(age) AS age FROM @tag GROUP BY tag) x", ("tag",), "Suggested queries by popularity and recency."),
    Op("top4", "SELECT user_id, id, heat FROM (SELECT user_id, id, 'hot' AS heat, row_number() OVER (PARTITION BY user_id ORDER BY access_count DESC, id) AS r FROM @mem WHERE access_count > 0 UNION ALL SELECT user_id, id, 'cold' AS heat, row_number() OVER (PARTITION BY user_id ORDER BY importance, id) AS r FROM @mem WHERE access_count = 0) x WHERE r <= CASE heat WHEN 'hot' THEN 10 ELSE 20 END", ("mem",), "Hot and cold memories."),
    Op("top5", "SELECT id, round(response_ms, 5) AS ms FROM @usage WHERE response_ms > 300000", ("usage",), "Slow queries."),
    Op("ses1", "SELECT session_id, count(*) AS n, count(DISTINCT user_id) AS users, round((max(us) - min(us)) / 1000000.0, 3) AS seconds, #joined(tag1) AS tags FROM @mem GROUP BY session_id", ("mem",), "Session statistics."),
    Op("mon1", "SELECT status_code, count(*) AS n, round(avg(response_ms), 7) AS mean, round(min(response_ms), 7) AS low, round(max(response_ms), 7) AS high FROM @usage GROUP BY status_code", ("usage",), "Metric summary."),
    Op("mon2", "SELECT user_id, tag1 AS event, count(*) AS n, max(created_at) AS last FROM @mem GROUP BY user_id, tag1", ("mem",), "Event statistics by user."),
    Op("mon3", "SELECT key_id, round(100.0 * avg(CASE WHEN response_ms > 200000 THEN 1.0 ELSE 0.0 END), 7) AS slow_share, round(0.6 * (1 - avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END)) + 0.4 * (1 - least(1.0, avg(response_ms) / 500000.0)), 8) AS score FROM @usage GROUP BY key_id", ("usage",), "Performance snapshot."),
    Op("quo2", "SELECT key_id, day, count(*) AS n, CASE WHEN count(*) > 1 THEN 'limited' ELSE 'ok' END AS state FROM @usage GROUP BY key_id, day", ("usage",), "Rate limits in tumbling windows."),
    Op("sch1", "SELECT id, concat(CASE WHEN importance < 0.5 THEN 'importance below 0.5;' ELSE '' END, CASE WHEN confidence > 0.95 THEN 'confidence above 0.95;' ELSE '' END, CASE WHEN length(text) < 38 THEN 'text too short;' ELSE '' END) AS errors FROM @mem", ("mem",), "Validation messages."),
    Op("aud1", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS r FROM @mem WHERE tag1 = 'error' AND importance > 5) x WHERE r > 20 AND r <= 70", ("mem",), "Audit page."),
    Op("sof1", "SELECT session_id, count(*) AS n, CAST(sum(CASE WHEN is_archived THEN 1 ELSE 0 END) AS BIGINT) AS deleted FROM @mem GROUP BY session_id", ("mem",), "Soft deletes by session."),
    Op("ver1", "SELECT fact_id, id, version FROM (SELECT fact_id, id, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY from_us, id) AS BIGINT) AS version, row_number() OVER (PARTITION BY fact_id ORDER BY from_us DESC, id DESC) AS r FROM @facts) x WHERE r <= 10", ("facts",), "Last ten versions, numbered from the first."),
]
