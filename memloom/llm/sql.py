"""SQL twins of the queries that SQL can express."""

OP9 = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10 = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g
  FROM cut
), sizes AS (
  SELECT cut.doc_id, count(grams.g) AS n FROM cut LEFT JOIN grams ON grams.doc_id = cut.doc_id GROUP BY cut.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b AS a, a AS b FROM links
), reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b AS other FROM reach r JOIN both_ways e ON e.a = r.other
)
SELECT s.doc_id, s.n AS n_shingles, coalesce(min(r.other), s.doc_id) AS component_id
FROM sizes s LEFT JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
"""

OP13 = r"""
WITH p AS (
  SELECT lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda t: t <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)
), spots AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p
), f1 AS (
  SELECT lang, w[i] AS g, count(*) AS f FROM spots GROUP BY ALL
), f2 AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM spots WHERE i + 1 <= len(w) GROUP BY ALL
), f3 AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM spots WHERE i + 2 <= len(w) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.g = c.x JOIN f1 r ON r.lang = c.lang AND r.g = c.y WHERE c.f >= 10
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, l.f, r.f
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.g = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z WHERE c.f >= 10
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, l.f, r.f
  FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.g = c.z WHERE c.f >= 10
), scored AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), gone AS (
  SELECT DISTINCT s.lang, s.x || ' ' || s.y AS phrase
  FROM f2 s JOIN f3 b ON b.lang = s.lang AND ((b.x = s.x AND b.y = s.y) OR (b.y = s.x AND b.z = s.y))
  WHERE s.f >= 10 AND b.f >= 10 AND 100 * b.f >= 50 * s.f
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = c.lang AND g.phrase = c.phrase)
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op9_vector_topk": OP9, "op10_jaccard_join": OP10, "op13_collocations": OP13}
