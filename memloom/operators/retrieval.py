"""Hybrid retrieval: vector and BM25 rankings, rank fusion, weighted scores, context budgets."""

from __future__ import annotations

from ..plans.dialect import Op

# every score that ranks is rounded first: equal ones must not differ by the order of a sum
_COS = "round(#dot(q.v, m.v) / (sqrt(#dot(q.v, q.v)) * sqrt(#dot(m.v, m.v))), 9)"
_VECTOR = f"SELECT q.id AS qid, m.id, {_COS} AS sim FROM (SELECT id, v FROM @vec WHERE id % 100 = 0) q JOIN @vec m ON m.id <> q.id"
_TOKEN = "SELECT id, user_id, word, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT id, user_id, #each(#tokens(text)) AS word FROM @doc) w GROUP BY id, user_id, word"
_LENGTH = "SELECT id, user_id, CAST(#size(#tokens(text)) AS DOUBLE) AS len FROM @doc"
_IDF = "SELECT d.user_id, d.word, ln((c.n - d.df + 0.5) / (d.df + 0.5)) AS raw FROM (SELECT user_id, word, count(*) AS df FROM tok GROUP BY user_id, word) d JOIN (SELECT user_id, count(*) AS n FROM @doc GROUP BY user_id) c ON c.user_id = d.user_id"
_QUERY = "SELECT id AS qid, user_id, word, count(*) AS times FROM (SELECT id, user_id, #each(#tokens(text)) AS word FROM @doc WHERE id % 100 = 0) q GROUP BY id, user_id, word"
#: The first k documents without a common token fill up with zero scores: they stand in the gaps between the others' places.
#: Documents of a language are one user's memories; a query is a document's whole text, of every id divisible by 100.
BM25 = f"""WITH tok AS ({_TOKEN}), len AS ({_LENGTH}), raw AS ({_IDF}),
  idf AS (SELECT r.user_id, r.word, CASE WHEN r.raw < 0 THEN 0.25 * a.mean ELSE r.raw END AS idf FROM raw r JOIN (SELECT user_id, avg(raw) AS mean FROM raw GROUP BY user_id) a ON a.user_id = r.user_id),
  mean AS (SELECT user_id, avg(len) AS avgdl FROM len GROUP BY user_id),
  query AS ({_QUERY}),
  scored AS (SELECT q.qid, t.id, round(sum(q.times * i.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.len / a.avgdl))), 9) AS score
    FROM query q JOIN tok t ON t.user_id = q.user_id AND t.word = q.word JOIN idf i ON i.user_id = t.user_id AND i.word = t.word JOIN len l ON l.id = t.id JOIN mean a ON a.user_id = t.user_id GROUP BY q.qid, t.id),
  place AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM @doc),
  hit AS (SELECT s.qid, p.user_id, p.r FROM scored s JOIN place p ON p.id = s.id UNION ALL SELECT id AS qid, user_id, n + 1 AS r FROM place WHERE id % 100 = 0),
  gap AS (SELECT qid, user_id, r, coalesce(lag(r) OVER (PARTITION BY qid ORDER BY r), 0) AS before, row_number() OVER (PARTITION BY qid ORDER BY r) - 1 AS met FROM hit),
  zero AS (SELECT qid, user_id, #each(#span(before + 1, least(r - 1, met + @k))) AS r FROM gap WHERE r - 1 > before AND before < met + @k),
  every AS (SELECT qid, id, score FROM scored UNION ALL SELECT z.qid, p.id, 0.0 AS score FROM zero z JOIN place p ON p.user_id = z.user_id AND p.r = z.r),
  ranked AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM every)"""
_RECENCY = "exp(-0.693 * age / 30.0)"
OPS = [
    Op("ret1", f"SELECT qid, id, round(sim, 8) AS sim FROM (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS r FROM ({_VECTOR}) h) x WHERE r <= @k", ("vec",), "Vector top-k by cosine.", {"k": 20}),
    Op("ret2", f"{BM25} SELECT qid, id, round(score, 6) AS score FROM ranked WHERE r <= @k", ("doc",), "BM25 top-k within a language, negative idf raised to a quarter of the mean.", {"k": 10}),
    Op("ret3", "SELECT qid, id, round(sum(1.0 / (60 + r)), 9) AS rrf FROM (SELECT session_id AS qid, id, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, id) AS r FROM @mem UNION ALL SELECT session_id AS qid, id, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, id) AS r FROM @mem) x WHERE r <= 60 GROUP BY qid, id", ("mem",), "Reciprocal rank fusion of two rankings."),
    Op("ret9", f"SELECT id, round((0.55 * confidence + 0.20 * 0.5 + 0.15 * {_RECENCY} + 0.10 * importance / 10.0) / (0.55 + 0.20 + 0.15 + 0.10), 9) AS score FROM @mem", ("mem",), "Weighted score fusion."),
    Op("ret10", f"SELECT id, round({_RECENCY}, 9) AS recency FROM @mem", ("mem",), "Recency with the literal 0.693."),
    Op("ret13", "SELECT id, round((confidence + 0.5 * importance / 10.0 + 0.25 * least(1.0, access_count / 10.0)) / 1.75, 9) AS score FROM @mem", ("mem",), "Plugin scorers."),
    Op("ret15", "SELECT id, concat(CASE WHEN confidence > 0.7 THEN 'semantic;' ELSE '' END, CASE WHEN importance > 7 THEN 'important;' ELSE '' END, CASE WHEN age < 5 THEN 'recent;' ELSE '' END, CASE WHEN access_count > 10 THEN 'popular;' ELSE '' END) AS why FROM @mem", ("mem",), "Explanation of a result."),
    Op("ret15_histogram", "SELECT bin, count(*) AS n FROM (SELECT CAST(least(4.0, floor(confidence * 5)) AS BIGINT) AS bin FROM @mem) x GROUP BY bin", ("mem",), "Score histogram in five bins."),
    Op("src2", f"SELECT qid, id, round(sim, 8) AS sim FROM ({_VECTOR}) h WHERE sim >= @least", ("vec",), "Neighbours above a similarity.", {"least": 0.2}),
    Op("mth1", "SELECT id, round(CASE WHEN hi = lo THEN 0.5 ELSE (importance - lo) / (hi - lo) END, 9) AS scaled FROM (SELECT id, importance, min(importance) OVER (PARTITION BY user_id) AS lo, max(importance) OVER (PARTITION BY user_id) AS hi FROM @mem) x", ("mem",), "Min-max scaling within a user."),
    Op("top1", "SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY confidence * importance DESC, id) AS r FROM @mem) x WHERE r <= 5", ("mem",), "Top k by score within a user."),
]
