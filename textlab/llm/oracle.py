"""DuckDB SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def ngram_components(k: int = 4, num: int = 85, den: int = 100) -> str:
    """Shingle sets, all linking pairs, and the smallest id reachable."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE {den} * c >= {num} * (a.n + b.n - c)
),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.other = links.x
)
SELECT r.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id"""


def repeated_bytes(length: int = 400) -> str:
    """Every string of ``length`` bytes by its 64-bit hash; runs of covered bytes cut out.  Bytes are written as hex digits."""
    return f"""
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, {2 * length})) AS m
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {length} + 1, 0))) AS i FROM hexed)
),
starts AS (SELECT doc_id, i FROM strings WHERE m IN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + {length} THEN 0 ELSE 1 END AS fresh FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + {length} AS b
  FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run
),
pieces AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM runs
  UNION ALL
  SELECT r.doc_id, any_value(length(h) // 2), max(b) FROM runs r JOIN hexed ON r.doc_id = hexed.doc_id GROUP BY r.doc_id
),
kept AS (
  SELECT p.doc_id, string_agg(substr(h, 2 * p.after + 1, 2 * (p.a - p.after)), '' ORDER BY p.a) AS h
  FROM pieces p JOIN hexed ON p.doc_id = hexed.doc_id GROUP BY p.doc_id
),
cut AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed FROM runs GROUP BY doc_id)
SELECT x.doc_id, (length(x.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.h, x.h))) AS kept_sha256
FROM hexed x LEFT JOIN cut ON x.doc_id = cut.doc_id LEFT JOIN kept k ON x.doc_id = k.doc_id"""
