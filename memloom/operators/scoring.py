"""Importance, decay, health, lifecycle and policy operators: one pass of column expressions."""

from __future__ import annotations

from ..plans.dialect import Op

#: Half-lives in days by memory type, of the engine's decay (fixed values).
HALF_LIFE = "CASE type WHEN 'preference' THEN 90.0 WHEN 'fact' THEN 30.0 WHEN 'goal' THEN 60.0 WHEN 'habit' THEN 90.0 WHEN 'event' THEN 14.0 WHEN 'context' THEN 30.0 ELSE 30.0 END"
HEALTH = "(0.4 * importance + 10 * 0.25 * exp(-age / 30.0) + 10 * 0.2 * least(access_count / 20.0, 1.0) + 10 * 0.15 * confidence)"
VERDICT = "CASE WHEN h >= 7 THEN 'keep' WHEN h >= 5 THEN 'decay' WHEN h >= 3 THEN 'archive' ELSE 'prune' END"

OPS = [
    Op("dec3", f"SELECT id, round(importance * pow(0.5, age / {HALF_LIFE}), 9) AS importance FROM @mem WHERE importance - importance * pow(0.5, age / {HALF_LIFE}) > 0.1", ("mem",), "Nightly decay: rows that change by more than 0.1."),
    Op("dec4", "SELECT id, round(greatest(0.1, pow(0.5, days / 90.0)), 9) AS exponential, round(greatest(0.1, 1 - 0.01 * days), 9) AS linear, round(greatest(0.1, 1 - ln(1 + days) / ln(1 + 180)), 9) AS logarithmic, CASE WHEN days <= 7 THEN 1.0 WHEN days <= 30 THEN 0.8 WHEN days <= 90 THEN 0.6 WHEN days <= 180 THEN 0.4 WHEN days <= 365 THEN 0.2 ELSE 0.1 END AS step FROM @mem", ("mem",), "Registered decay multipliers on whole days, with floors."),
    Op("dec5", "SELECT id, round(importance * pow(0.95, days), 9) AS importance FROM @mem", ("mem",), "Policy decay by day."),
    Op("dec6", "SELECT id, round(pow(0.5, age / 30.0), 9) AS factor FROM @mem", ("mem",), "Plain decay factor."),
    Op("hlt1", f"SELECT id, round(h, 9) AS health, {VERDICT} AS verdict FROM (SELECT id, {HEALTH} AS h FROM @mem) x", ("mem",), "Health of each memory, 0 to 10, and its verdict."),
    Op("hlt2", f"SELECT user_id, id, round(h, 9) AS health FROM (SELECT user_id, id, h, row_number() OVER (PARTITION BY user_id ORDER BY h, id) AS r FROM (SELECT user_id, id, {HEALTH} AS h FROM @mem) x) y WHERE r <= @k AND h < 5", ("mem",), "Pruning candidates: each user's least healthy.", {"k": 5}),
    Op("hlt3", f"SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN h >= 7 THEN 1 ELSE 0 END) AS BIGINT) AS keep, CAST(sum(CASE WHEN h >= 5 AND h < 7 THEN 1 ELSE 0 END) AS BIGINT) AS decay, CAST(sum(CASE WHEN h >= 3 AND h < 5 THEN 1 ELSE 0 END) AS BIGINT) AS archive, CAST(sum(CASE WHEN h < 3 THEN 1 ELSE 0 END) AS BIGINT) AS prune, CAST(sum(CASE WHEN importance < 2 THEN 1 ELSE 0 END) AS BIGINT) AS band1, CAST(sum(CASE WHEN importance >= 2 AND importance < 4 THEN 1 ELSE 0 END) AS BIGINT) AS band2, CAST(sum(CASE WHEN importance >= 4 AND importance < 6 THEN 1 ELSE 0 END) AS BIGINT) AS band3, CAST(sum(CASE WHEN importance >= 6 AND importance < 8 THEN 1 ELSE 0 END) AS BIGINT) AS band4, CAST(sum(CASE WHEN importance >= 8 THEN 1 ELSE 0 END) AS BIGINT) AS band5 FROM (SELECT user_id, importance, {HEALTH} AS h FROM @mem) x GROUP BY user_id", ("mem",), "Maintenance report: verdicts and importance bands by user."),
    Op("hlt6", "SELECT user_id, tag, n, CASE WHEN n >= 1.5 * mean THEN 'over' WHEN n < 0.5 * mean THEN 'under' ELSE 'balanced' END AS level FROM (SELECT user_id, tag, n, avg(n) OVER (PARTITION BY user_id) AS mean FROM (SELECT user_id, tag, count(*) AS n FROM @tag GROUP BY user_id, tag) a) b", ("tag",), "Topic coverage against the user's mean."),
    Op("hlt8", "SELECT id, round(least(1.0, 0.5 * least(age / 180.0, 1.0) + 0.3 * (CASE WHEN access_count = 0 THEN 1.0 ELSE 1.0 / (1 + access_count) END) + 0.2 * (1 - confidence)), 9) AS staleness, CASE WHEN importance >= 7 THEN 'review' WHEN access_count = 0 AND importance < 3 THEN 'delete' WHEN age > 25 THEN 'archive' ELSE 'refresh' END AS advice FROM @mem", ("mem",), "Staleness score and advice."),
    Op("hlt9", "SELECT user_id, tag, n, CASE WHEN n >= 10 THEN 'comprehensive' WHEN n >= 5 THEN 'good' WHEN n >= 2 THEN 'moderate' WHEN n = 1 THEN 'minimal' ELSE 'none' END AS level, round(q, 7) AS quality FROM (SELECT user_id, tag, count(*) AS n, avg(importance) / 10.0 AS q FROM @tag GROUP BY user_id, tag) x", ("tag",), "Coverage level and quality of each topic."),
    Op("hlt13", "SELECT id, round(0.35 * exp(-age / 60.0) + 0.35 * (CASE WHEN access_count = 0 THEN 0.0 ELSE least(1.0, ln(1 + access_count) / ln(21)) END) + 0.3 * (CASE WHEN type IN ('event', 'context') THEN exp(-age / 14.0) ELSE 1.0 END), 9) AS freshness FROM @mem", ("mem",), "Freshness, 0 to 1."),
    Op("con2", "SELECT user_id, n, tokens, CASE WHEN n >= 100 THEN 'count' WHEN tokens >= 10000 THEN 'tokens' ELSE 'no' END AS due, CAST(floor(n * 0.6) AS BIGINT) AS after_n FROM (SELECT user_id, count(*) AS n, CAST(sum(floor(length(text) / 4.0)) AS BIGINT) AS tokens FROM @mem GROUP BY user_id) x", ("mem",), "Is a consolidation due, and what would it leave."),
    Op("con4", "SELECT id, CASE WHEN importance < 1 AND access_count = 0 AND age > 7 THEN 'delete' WHEN age > 20 AND importance < 3 THEN 'archive' WHEN access_count >= 9 AND importance >= 5 THEN 'promote' ELSE 'keep' END AS action FROM @mem", ("mem",), "Policy decisions in order of precedence."),
    Op("rtn1", "SELECT id FROM @mem WHERE age >= @days AND importance < @importance AND access_count < @accesses AND tag1 NOT IN ('purchase')", ("mem",), "Memories that a retention policy lets go.", {"days": 20, "importance": 5.0, "accesses": 5}),
    Op("rtn2", "SELECT id, created_at FROM @mem WHERE age > @ttl", ("mem",), "Expired memories.", {"ttl": 25}),
    Op("rtn3", "SELECT id FROM @mem WHERE (age > 25 OR importance < 1 OR access_count = 0 OR confidence < 0.55) AND NOT is_archived AND type <> 'fact'", ("mem",), "Memories that an archival policy takes."),
    Op("rtn4", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY importance, id) AS r FROM @mem WHERE importance < 3 AND access_count < 3 AND age > @days) x WHERE r <= @most", ("mem",), "Garbage, least important first, up to a limit.", {"days": 7, "most": 1000}),
    Op("adp2", "SELECT id, CASE WHEN access_count = 0 AND age > 20 THEN 'archive' WHEN access_count = 0 THEN 'aggressive' WHEN access_count < 4 AND age > 10 THEN 'medium' WHEN importance >= 8 THEN 'none' ELSE 'light' END AS compression, CASE WHEN importance >= 7 AND age > 20 THEN 'high' WHEN access_count >= 8 AND age > 15 THEN 'medium' ELSE 'low' END AS refresh FROM @mem", ("mem",), "Compression level and refresh priority."),
    Op("cmp1", "SELECT id, CASE WHEN age < 7 THEN 'recent' WHEN age < 30 THEN 'short' WHEN age < 90 THEN 'medium' ELSE 'archive' END AS tier, CASE WHEN age < 7 THEN 1.0 WHEN age < 30 THEN 0.75 WHEN age < 90 THEN 0.5 ELSE 0.25 END AS ratio FROM @mem", ("mem",), "Tier and compression ratio."),
    Op("aut1", "SELECT user_id, n, CASE WHEN n >= 50 THEN true ELSE false END AS summarise, CASE WHEN n >= 100 THEN true ELSE false END AS consolidate, CASE WHEN chars >= 5000 THEN true ELSE false END AS compress FROM (SELECT user_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM @mem GROUP BY user_id) x", ("mem",), "Which automations are due for each user."),
    Op("top7", "SELECT user_id, id, CASE WHEN tag1 = 'error' THEN 'delete' ELSE 'archive' END AS action FROM (SELECT user_id, id, tag1, row_number() OVER (PARTITION BY user_id ORDER BY importance, created_at DESC, id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM @mem) x WHERE r <= n - @most", ("mem",), "Evictions beyond a user's limit.", {"most": 50}),
]
