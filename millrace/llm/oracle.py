"""DuckDB SQL with the rows of those queries that SQL can express; the others are held against plain versions in the tests."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of shingles, links wherever two sets share one, and what is reachable over links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common >= 75 * (x.n + y.n - common)),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN least ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

#: All windows of 20 words by their place; those that are not the first of their kind cover words.
SUBSTRINGS = rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, range(0, 20) t(k)),
spans AS (SELECT doc_id, min(p) - 1 AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gone) GROUP BY doc_id, g),
cut AS (SELECT doc_id, sum(b - a) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS removed FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM words) e
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = e.doc_id AND g.p = e.p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, cast(coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(removed, '') AS removed
FROM words LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: All strings of 200 bytes, cut out of blocks of the text in hexadecimal; those that occur twice cover bytes.
LONG_MATCHES = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT doc_id, j, substr(x, 2 * j + 1, 2398) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2, 1000)) AS j FROM bytes)),
windows AS (SELECT doc_id, j + i AS p, md5(substr(y, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, j, y, unnest(range(0, least(1000, len(y) // 2 - 199))) AS i FROM blocks)),
twice AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
steps AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, true) AS new FROM twice),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT doc_id, p, sum(new::int) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM steps) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (coalesce(to_, len(x) // 2) - from_)), '' ORDER BY from_) AS k FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, string_agg(a || ':' || b, ',' ORDER BY a) AS removed FROM spans GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, cast(coalesce(n, 0) AS bigint) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256, coalesce(removed, '') AS removed
FROM bytes LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_minhash_dedup": NEAR_DUPLICATES, "op4_substring_dedup": SUBSTRINGS, "op5_run_length_index": LONG_MATCHES}
