"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _windows(table: str, key: str) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"SELECT {key}, {words} AS w FROM {table}"


DECONTAMINATION = f"""
WITH items AS ({_windows("benchmark", "item_id")}),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS ({_windows("documents", "doc_id")}),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT d.doc_id, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.win = t.win AND d.n = t.n),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

#: Base32 of a SHA-1: five hexadecimal digits are four letters.
WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS newest FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(digest, (k // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM r
"""

#: Texts as hexadecimal digits, two a byte, cut into stretches so that no window is sought far from its start.
SUFFIX_ARRAY = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS hx FROM documents),
pieces AS (SELECT rid, s, substr(hx, 2 * s + 1, 2 * (2048 + 199)) AS piece FROM (SELECT rid, hx, unnest(range(0, len(hx) // 2, 2048)) AS s FROM docs WHERE len(hx) >= 400)),
windows AS (SELECT rid, s + i AS pos, substr(piece, 2 * i + 1, 400) AS win FROM
  (SELECT rid, s, piece, unnest(range(0, least(2048, len(piece) // 2 - 199))) AS i FROM pieces WHERE len(piece) >= 400)),
hits AS (SELECT w.rid, w.pos FROM windows w JOIN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1) r ON r.win = w.win),
marked AS (SELECT rid, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY rid ORDER BY pos) + 200 THEN 0 ELSE 1 END AS new FROM hits),
numbered AS (SELECT rid, pos, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS run FROM marked),
runs AS (SELECT rid, run, min(pos) AS a, max(pos) + 200 AS b FROM numbered GROUP BY ALL),
gaps AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS f, a AS t FROM runs
  UNION ALL SELECT rid, max(b), NULL FROM runs GROUP BY rid),
kept AS (SELECT g.rid, string_agg(substr(d.hx, 2 * g.f + 1, 2 * (coalesce(g.t, len(d.hx) // 2) - g.f)), '' ORDER BY g.f) AS hx FROM gaps g JOIN docs d USING (rid) GROUP BY 1),
spans AS (SELECT rid, count(*) AS n FROM runs GROUP BY 1)
SELECT d.doc_id, (len(d.hx) // 2)::BIGINT AS n_bytes, ((len(d.hx) - len(coalesce(k.hx, d.hx))) // 2)::BIGINT AS n_removed, coalesce(s.n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.hx, d.hx))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (rid) LEFT JOIN spans s USING (rid)
"""
