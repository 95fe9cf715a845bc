"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations


# op5: the words of texts and items, the windows of items, and every window of a text
# of a size that occurs among them.
DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, w[s : s + least(len(w), 13) - 1] AS win
  FROM i, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (
  SELECT doc_id, s, n, w[s : s + n - 1] AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n),
h AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

# op6: what the files must give back, and the records that were damaged on purpose.
WARC_AUDIT = """
SELECT page_id, sha256(coalesce(html, '')) AS payload_sha256, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT)
       AS n_bytes, coalesce(page_id % 97 = 13, false) AS damaged
FROM pages
"""

# op11: the longest original of equal normalised texts stays, then the smallest id.
EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS k,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


def build() -> dict[str, str]:
    return {"op5_decontaminate": DECONTAMINATE, "op6_warc_audit": WARC_AUDIT, "op11_exact_dedup": EXACT_DEDUP}
