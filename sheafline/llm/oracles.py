"""SQL counterparts of the operators that SQL can express."""

_SPACES = "[\\x20\\x09-\\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP6 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT item_id, list_aggregate(list_slice(w, i, i + 9), 'string_agg', ' ') AS g, least(len(w), 10) AS n
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT doc_id, i, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), met AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.g = x.g AND p.n = x.n),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM met, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, i, md5(list_aggregate(list_slice(w, i, i + 34), 'string_agg', ' ')) AS g
  FROM d, unnest(range(1, len(w) - 33)) AS t(i)
), often AS (SELECT g FROM places GROUP BY g HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM places SEMI JOIN often USING (g), unnest(range(i, i + 35)) AS t(k) GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, count(*) AS n, string_agg(w[k], ' ' ORDER BY k) AS line
  FROM d LEFT JOIN gone USING (doc_id), unnest(range(1, len(w) + 1)) AS t(k)
  WHERE ks IS NULL OR NOT list_contains(ks, k) GROUP BY d.doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_BREAKS = "[.,;:!?\\x0A-\\x0D]"

OP11 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_BREAKS}')) AS p
  FROM documents
), d AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM d GROUP BY lang),
often AS (
  SELECT lang, m AS size, list_aggregate(list_slice(w, i, i + m - 1), 'string_agg', ' ') AS phrase, count(*)::HUGEINT AS f
  FROM d, unnest(range(1, 6)) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i) GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT o.lang, o.phrase, o.f AS a, k, x.f AS l, y.f AS r, n, (1000 * o.f * n) // (x.f * y.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM often WHERE size > 1) o, unnest(range(1, o.size)) AS t(k)
  JOIN often x ON x.lang = o.lang AND x.phrase = list_aggregate(list_slice(o.w, 1, k), 'string_agg', ' ')
  JOIN often y ON y.lang = o.lang AND y.phrase = list_aggregate(list_slice(o.w, k + 1, o.size), 'string_agg', ' ')
  JOIN totals z ON z.lang = o.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT o.lang, list_aggregate(list_slice(w, i, i + m - 1), 'string_agg', ' ') AS phrase, f
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM often WHERE size > 2) o, unnest(range(2, o.size)) AS s(m), unnest(range(1, o.size - m + 2)) AS t(i)
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
       r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""

ORACLES = {"op6_decontaminate": OP6, "op9_substring": OP9, "op11_collocations": OP11, "op13_warc": OP13}
