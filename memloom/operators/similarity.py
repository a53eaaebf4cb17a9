"""Duplicates, clusters, conflicts, graphs and inference."""

from __future__ import annotations

from ..plans.dialect import Op

_NORMED = "(SELECT id, label, v, sqrt(#dot(v, v)) AS norm FROM @vec)"
_PAIRS = f"SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, #dot(a.v, b.v) / (a.norm * b.norm) AS s FROM {_NORMED} a JOIN {_NORMED} b ON a.label = b.label AND a.id < b.id"
_BOTH = "SELECT src AS u, dst AS v FROM @links WHERE src <> dst UNION SELECT dst AS u, src AS v FROM @links WHERE src <> dst"
_STRENGTH = "0.4 * avg(confidence) + 0.3 * least(count(*) / 10.0, 1.0) + 0.2 * exp(-min(age) / 365.0) + 0.1 * least(count(DISTINCT session_id) / 5.0, 1.0)"

OPS = [
    Op("joi3", f"SELECT a, b, round(s, 8) AS s FROM ({_PAIRS}) p WHERE s >= @least", ("vec",), "Pairs above a similarity within a block.", {"least": 0.3}),
    Op("sim1", f"SELECT id, CASE WHEN top IS NULL OR top <= @dup THEN 'store' WHEN n = 1 AND top > @skip THEN 'skip' ELSE 'update' END AS action FROM (SELECT v.id, max(p.s) AS top, count(p.s) AS n FROM @vec v LEFT JOIN (SELECT b AS id, s FROM ({_PAIRS}) x WHERE s > @dup) p ON p.id = v.id GROUP BY v.id) y", ("vec",), "Duplicate gate of the write path.", {"dup": 0.3, "skip": 0.4}),
    Op("sim2", f"SELECT b AS id, CASE WHEN max(s) >= @exact THEN 'skip' WHEN max(s) >= @near THEN 'update' ELSE 'store' END AS action FROM ({_PAIRS}) x GROUP BY b", ("vec",), "Duplicate gate of the service.", {"exact": 0.4, "near": 0.3}),
    Op("sim4", f"SELECT a, b, round(s, 8) AS s, least(a, b) AS keep FROM ({_PAIRS}) x WHERE s >= @low AND s < @high", ("vec",), "Near duplicates with a merge suggestion.", {"low": 0.3, "high": 0.5}),
    Op("sim7", "SELECT user_id, sha, n, n * (n - 1) / 2 AS pairs, keep FROM (SELECT user_id, #sha(lower(trim(text))) AS sha, count(*) AS n, min(id) AS keep FROM @doc GROUP BY user_id, #sha(lower(trim(text)))) x WHERE n > 1", ("doc",), "Exact duplicates by normalised text."),
    Op("sim10", "SELECT user_id, type, n FROM (SELECT user_id, type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, type) AS r FROM (SELECT user_id, type, count(*) AS n FROM @mem GROUP BY user_id, type) x) y WHERE r <= 3", ("mem",), "Largest topic clusters."),
    Op("sim12", f"SELECT la AS label, count(*) AS pairs, round(avg(s), 8) AS cohesion, round(1 - avg(s), 8) AS diversity FROM ({_PAIRS}) x GROUP BY la", ("vec",), "Cluster quality."),
    Op("sim13", f"SELECT a, b, CASE WHEN s >= @close THEN 'similar_to' ELSE 'related_to' END AS relation FROM ({_PAIRS}) x WHERE s >= @least", ("vec",), "Suggested relationships.", {"least": 0.3, "close": 0.4}),
    Op("sim18", "SELECT least(a.tag2, b.tag2) AS a, greatest(a.tag2, b.tag2) AS b, count(*) AS n FROM @mem a JOIN @mem b ON a.user_id = b.user_id AND a.session_id = b.session_id AND a.id < b.id AND b.us - a.us BETWEEN -3600000000 AND 3600000000 GROUP BY least(a.tag2, b.tag2), greatest(a.tag2, b.tag2)", ("mem",), "Co-accessed keys."),
    Op("sim19", f"SELECT a, b, round((s - 0.3) / 0.15, 8) AS confidence FROM ({_PAIRS}) x WHERE s >= 0.3 AND s < 0.45", ("vec",), "Near-duplicate warnings."),
    Op("con1", "SELECT user_id, tag2, max(CASE WHEN r = 1 THEN text END) AS text, round(max(importance), 8) AS importance, round(min(confidence), 8) AS confidence, CAST(sum(access_count) AS BIGINT) AS uses, #joined(tag1) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY user_id, tag2 ORDER BY importance DESC, id) AS r FROM @mem) x GROUP BY user_id, tag2", ("mem",), "Heuristic consolidation."),
    Op("sim15", "SELECT user_id, type, max(CASE WHEN a = 1 THEN id END) AS newest, max(CASE WHEN b = 1 THEN id END) AS surest, max(CASE WHEN c = 1 THEN id END) AS longest FROM (SELECT user_id, type, id, row_number() OVER (PARTITION BY user_id, type ORDER BY us DESC, id) AS a, row_number() OVER (PARTITION BY user_id, type ORDER BY confidence DESC, id) AS b, row_number() OVER (PARTITION BY user_id, type ORDER BY length(text) DESC, id) AS c FROM @mem) x GROUP BY user_id, type", ("mem",), "The survivor of a merge under three strategies."),
    Op("gra2", "SELECT src, dst, relation FROM @links WHERE src = @node OR dst = @node", ("links",), "Related nodes: direct edges.", {"node": 3}),
    Op("gra5", "SELECT n, m, round(m / CAST(n * (n - 1) AS DOUBLE), 9) AS density, round(2.0 * m / n, 9) AS degree FROM (SELECT count(*) AS n FROM (SELECT src AS x FROM @links UNION SELECT dst AS x FROM @links) u) a CROSS JOIN (SELECT count(*) AS m FROM @links) b", ("links",), "Graph statistics."),
    Op("gra6", f"WITH e AS ({_BOTH}), ball AS (SELECT CAST(@node AS INT) AS x UNION SELECT v AS x FROM e WHERE u = @node UNION SELECT b.v AS x FROM e a JOIN e b ON b.u = a.v WHERE a.u = @node) SELECT l.src, l.dst, l.relation FROM @links l JOIN ball p ON p.x = l.src JOIN ball q ON q.x = l.dst", ("links",), "Ego subgraph of radius two.", {"node": 3}),
    Op("gra8", "SELECT s.src, count(*) AS parts, min(s.dst) AS first_part FROM @edges s GROUP BY s.src", ("edges",), "Lookups over the bipartite graph."),
    Op("gra11", f"SELECT user_id, tag1, tag2, round({_STRENGTH}, 9) AS strength, CASE WHEN {_STRENGTH} >= 0.8 THEN 'very_strong' WHEN {_STRENGTH} >= 0.6 THEN 'strong' WHEN {_STRENGTH} >= 0.4 THEN 'moderate' WHEN {_STRENGTH} >= 0.2 THEN 'weak' ELSE 'very_weak' END AS level FROM @mem GROUP BY user_id, tag1, tag2", ("mem",), "Strength of relationships."),
    Op("gra12", f"WITH RECURSIVE hop(v, depth, w, path) AS (SELECT CAST(@node AS INT) AS v, 0 AS depth, 1.0 AS w, concat(',', CAST(@node AS STRING), ',') AS path UNION ALL SELECT l.v, h.depth + 1, h.w * l.weight, concat(h.path, CAST(l.v AS STRING), ',') FROM hop h JOIN (SELECT src AS u, dst AS v, weight FROM @links UNION ALL SELECT dst AS u, src AS v, weight FROM @links) l ON l.u = h.v WHERE h.depth < 3 AND h.path NOT LIKE concat('%,', CAST(l.v AS STRING), ',%')) SELECT v, CAST(min(depth) AS BIGINT) AS depth, round(max(w), 9) AS strength FROM hop GROUP BY v", ("links",), "Paths up to three hops with the product of weights.", {"node": 1}),
    Op("gra13", "SELECT node, round(sum(w) / (0.5 * 25), 9) AS centrality FROM (SELECT src AS node, weight AS w FROM @links UNION ALL SELECT dst AS node, weight AS w FROM @links) x GROUP BY node", ("links",), "Centrality."),
    Op("gra15", "SELECT src, dst FROM @links WHERE src <> @node AND dst <> @node", ("links",), "A node and its edges removed.", {"node": 3}),
    Op("gra16", "SELECT src, dst, relation, round(weight, 6) AS weight FROM @links WHERE weight >= 0.7 AND relation IN ('knows', 'manages', 'part_of')", ("links",), "Relationships by type and strength."),
]
