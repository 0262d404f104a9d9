"""SQL for the queries of this subpackage that SQL can express (DuckDB over the same tables)."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def op2_sql(source: str = "documents") -> str:
    """Mixing: fill sources in order of cap over weight, then systematic sampling along one line a source."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h
  FROM {source}
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1)::INT AS sid
  FROM sized GROUP BY source
), weighed AS (SELECT *, (sid % 3 + 1)::BIGINT AS w FROM totals
), filled AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::BIGINT AS left_words,
         (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS left_weight
  FROM weighed
  WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, w * left_words > 3 * source_size * left_weight AS is_capped FROM filled
), level AS (
  SELECT ((SELECT sum(source_size) FROM weighed) - 3 * coalesce(sum(source_size) FILTER (is_capped), 0))::DOUBLE
         / sum(w) FILTER (NOT is_capped)::DOUBLE AS words_per_weight
  FROM capped
), plan AS (
  SELECT sid, source, source_size,
         CASE WHEN is_capped THEN (3 * source_size)::DOUBLE ELSE w * words_per_weight END AS target,
         ('0x' || substr(md5('mix:offset:' || sid), 1, 5))::INT / 1048576.0::DOUBLE AS shift
  FROM capped, level
), placed AS (
  SELECT d.doc_id, d.size, d.h, p.*, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
         row_number() OVER (
           PARTITION BY p.sid
           ORDER BY len(bin(size)) * 4 + substr(rpad(bin(size), 3, '0'), 2, 2)::INT, h
         )::DOUBLE AS place
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), copied AS (
  SELECT *, least(floor(shift + place * rate) - floor(shift + (place - 1) * rate), 3)::BIGINT AS copies FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied
"""


OP4 = """
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
         regexp_extract(substr(rest, len(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest
), pages2 AS (
  SELECT row_number() OVER () AS row_id, page_id, path,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM parts
), best AS (
  SELECT p.row_id, max(r.host || r.path) AS any_rule, arg_max(r.host || r.path, len(r.host || r.path)) AS rule,
         arg_max(r.verdict, len(r.host || r.path)) AS verdict
  FROM pages2 p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.row_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM pages2 p LEFT JOIN best b USING (row_id)
"""


#: Every overlap of 13 words with 11 equal has four equal words in a row, whichever 2 differ.
OP6 = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents
), item_words AS (
  SELECT row_number() OVER () AS item_row, item_id,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark
), doc_grams AS (
  SELECT row_id, i AS at, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram
  FROM doc_words, unnest(range(1, len(w) - 2)) AS t(i)
), item_grams AS (
  SELECT item_row, i AS at, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram
  FROM item_words, unnest(range(1, len(w) - 2)) AS t(i) WHERE len(w) >= 5
), diagonals AS (
  SELECT DISTINCT d.row_id, b.item_row, d.at - b.at AS shift FROM doc_grams d JOIN item_grams b USING (gram)
), laid AS (
  SELECT d.doc_id, b.item_id, g.shift, least(13, len(b.w)) AS wide, len(b.w) AS n, len(d.w) AS n_doc, d.w AS dw, b.w AS bw
  FROM diagonals g JOIN doc_words d USING (row_id) JOIN item_words b USING (item_row)
), counted AS (
  SELECT doc_id, item_id, shift, wide, s,
         list_sum([CASE WHEN dw[s + shift + j] = bw[s + j] THEN 1 ELSE 0 END for j in range(0, wide)]) AS equal
  FROM laid, unnest(range(greatest(1, 1 - shift), least(n, n_doc - shift) - wide + 2)) AS t(s)
), doc_places AS (
  SELECT doc_id, w, i, w[i] AS word FROM doc_words, unnest(range(1, len(w) + 1)) AS t(i)
), short_items AS (
  SELECT item_id, w, w[1] AS word FROM item_words WHERE len(w) BETWEEN 1 AND 4
), hits AS (
  SELECT doc_id, item_id, equal, s + shift - 1 AS place FROM counted WHERE equal >= CASE WHEN wide < 13 THEN wide ELSE 11 END
  UNION ALL
  SELECT d.doc_id, b.item_id, len(b.w), d.i - 1
  FROM doc_places d JOIN short_items b USING (word) WHERE d.w[d.i : d.i + len(b.w) - 1] = b.w
)
SELECT doc_id, item_id, max(equal)::BIGINT AS equal_words, min(place)::BIGINT AS first_word
FROM hits GROUP BY doc_id, item_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": op2_sql(), "op4_url_filter": OP4, "op6_decontamination": OP6}
