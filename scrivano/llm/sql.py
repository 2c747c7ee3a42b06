"""DuckDB SQL of the rows of those operators that SQL can express, over whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
owners AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN owners USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5('7:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) AS m FROM documents),
u AS (SELECT doc_id, source, size, length(bin(size)) AS class, (('0x' || m[1:13])::bigint::double + 0.5) * 2.220446049250313e-16 AS u FROM d),
s AS (SELECT source, sum(size)::bigint AS source_size FROM u GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::double AS weight, source_size * 2.0::double AS most, (sum(source_size) OVER ())::double * 1.5::double AS total FROM s),
levels AS (SELECT *, most / weight AS room, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, least(most, max(CASE WHEN level <= room THEN level END) OVER () * weight) AS target FROM levels),
kinds AS (SELECT source, class, sum(size)::double AS words FROM u WHERE size > 0 GROUP BY source, class),
weighed2 AS (SELECT kinds.source, class, words, target AS total, class * words AS weight, words * 2.0::double AS most FROM kinds JOIN targets ON kinds.source IS NOT DISTINCT FROM targets.source),
levels2 AS (SELECT *, most / weight AS room, (total - coalesce(sum(most) OVER (PARTITION BY source ORDER BY most / weight, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY source ORDER BY most / weight, class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed2),
expected AS (SELECT source, class, words, least(most, max(CASE WHEN level <= room THEN level END) OVER (PARTITION BY source) * weight) / words AS e FROM levels2),
chances AS (SELECT source, class, words, floor(e + 1e-9) AS certain, CASE WHEN e - floor(e + 1e-9) > 1e-9 THEN e - floor(e + 1e-9) END AS p FROM expected),
rests AS (SELECT *, coalesce(sum(p * words) OVER (PARTITION BY source), 0) AS rest FROM chances),
drawn AS (SELECT u.doc_id, u.source, u.size, certain, rest, (u.u / (1 - u.u)) / (p / (1 - p)) AS rank FROM u JOIN rests ON u.source IS NOT DISTINCT FROM rests.source AND u.class = rests.class WHERE size > 0),
summed AS (SELECT *, CASE WHEN rank IS NOT NULL THEN sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank) END AS run FROM drawn),
gaps AS (SELECT *, rest - coalesce(max(CASE WHEN run <= rest THEN run END) OVER (PARTITION BY source), 0) AS gap FROM summed),
closing AS (SELECT source, min({{'off': abs(size - gap), 'rank': rank}}).rank AS rank FROM gaps WHERE run > rest AND abs(size - gap) < gap GROUP BY source),
copies AS (SELECT gaps.doc_id, gaps.size, certain + CASE WHEN run <= rest OR gaps.rank = closing.rank THEN 1 ELSE 0 END AS n FROM gaps LEFT JOIN closing ON gaps.source IS NOT DISTINCT FROM closing.source)
SELECT u.doc_id, u.size, source_size, target, coalesce(n * u.size, 0)::bigint AS taken
FROM u JOIN targets ON u.source IS NOT DISTINCT FROM targets.source LEFT JOIN copies ON u.doc_id = copies.doc_id
"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::integer AS rank, vec_id, score FROM scores
QUALIFY rank <= 10
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS body FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

SQL = {"op6_substring": SUBSTRING, "op7_mixing": MIXING, "op9_topk": TOPK, "op10_warc": WARC}
