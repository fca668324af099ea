"""The SQL that these queries are checked with, where whole tables allow it."""

_NAMES = r"""
names AS (SELECT DISTINCT j, lower(trim(split_part(raw_line, chr(9), 1), ' ' || chr(160) || chr(13))) AS name FROM var_lines WHERE j IS NOT NULL),
once AS (SELECT DISTINCT i, j, seq FROM x_entries),
counts AS (
  SELECT name AS var_name, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT i) AS BIGINT) AS records
  FROM once JOIN names USING (j) WHERE name <> '' GROUP BY name),
marked AS (
  SELECT *, CASE WHEN records < 5 THEN 'rare' WHEN 2 * records > (SELECT count(DISTINCT i) FROM x_entries) THEN 'common' END AS mark
  FROM counts)
"""

_VALUES = """
once AS (SELECT i, j, seq, min(v) AS v FROM x_entries WHERE j IS NOT NULL AND v > 0 AND isfinite(v) GROUP BY i, j, seq),
ranked AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v) AS r, count(*) OVER (PARTITION BY j) AS n FROM once),
limits AS (
  SELECT j, min(v) FILTER (WHERE r * 100 >= n * 5) AS p5, min(v) FILTER (WHERE r * 100 >= n * 50) AS p50,
    min(v) FILTER (WHERE r * 100 >= n * 95) AS p95 FROM ranked GROUP BY j)
"""

#: Exact phrases of twelve words, by joining all windows.
_LEAKS = r"""
item_words AS (
  SELECT item_id, list_transform(regexp_extract_all(regexp_replace(text, '=\r?\n', '', 'g'), '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w
  FROM heldout_items WHERE text IS NOT NULL),
doc_words AS (
  SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '=\r?\n', '', 'g'), '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w
  FROM documents WHERE text IS NOT NULL),
item_windows AS (SELECT DISTINCT item_id, w[k:k + 11] AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM item_words WHERE len(w) >= 12)),
doc_windows AS (SELECT DISTINCT doc_id, w[k:k + 11] AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM doc_words WHERE len(w) >= 12)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM item_windows JOIN doc_windows USING (p))
"""

_VECTORS = """
raw AS (
  SELECT DISTINCT obs_ix AS ix, CAST(vec AS DOUBLE[]) AS v FROM obsm_vectors
  WHERE obsm_key = 'x_embed' AND vec IS NOT NULL AND len(vec) = 64
    AND len(list_filter(vec, lambda x: NOT isfinite(x) OR x IS NULL)) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.ix AS ix, b.ix AS other, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM raw a JOIN raw b ON a.ix <> b.ix
  WHERE list_cosine_similarity(a.v, b.v) >= 0.85)
"""

#: Every window of 200 characters, grouped; shared ones united where they overlap or touch.
_SHARED = """
windows AS (SELECT doc_id, k, substring(text, CAST(k + 1 AS INTEGER), 200) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS k FROM documents WHERE length(text) >= 200)),
common AS (SELECT w FROM windows GROUP BY w HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 200 THEN 0 ELSE 1 END AS new FROM windows SEMI JOIN common USING (w)),
runs AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked),
spans AS (SELECT doc_id, min(k) AS span_start, max(k) + 200 AS span_end FROM runs GROUP BY doc_id, run)
"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_NAMES} SELECT var_name, mark FROM marked WHERE mark IS NOT NULL",
    "p1_counts": f"WITH {_NAMES} SELECT var_name, occurrences, records, mark FROM marked",
    # All members of a cluster are similar to one another in these data, so the smallest similar row is the cluster's first.
    "p2_found": f"""WITH {_VECTORS}, firsts AS (SELECT ix AS member_ix, min(other) AS first_ix FROM near GROUP BY ix)
      SELECT first_ix, member_ix FROM firsts WHERE first_ix < member_ix""",
    "p2_sizes": f"""WITH {_VECTORS}, firsts AS (SELECT ix AS member_ix, min(other) AS first_ix FROM near GROUP BY ix)
      SELECT first_ix, count(*) + 1 AS size FROM firsts WHERE first_ix < member_ix GROUP BY first_ix""",
    "p4_found": f"""WITH {_VECTORS}, best AS (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY c DESC, other) AS r FROM near)
      SELECT DISTINCT least(ix, other) AS ix_a, greatest(ix, other) AS ix_b FROM best WHERE r <= 5""",
    "p7_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p7_items": f"WITH {_LEAKS} SELECT item_id, count(*) AS documents FROM leaks GROUP BY item_id",
    # At the tables' small scales the heap visits all cells, so the neighbours are the true ones.
    "p4_nearest": f"""WITH {_VECTORS},
      pairs AS (SELECT a.ix AS query, b.ix AS entry, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM raw a JOIN raw b ON a.ix <> b.ix WHERE a.ix % 50 = 0),
      best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, entry) AS INTEGER) AS place FROM pairs)
      SELECT query, entry, cosine, place FROM best WHERE place <= 5""",
    "p5_bounds": f"""WITH {_VALUES},
      binned AS (SELECT *, CAST(floor(log2(v)) AS INTEGER) AS e, CAST(floor((v / pow(2, floor(log2(v))) - 1) * 128) AS INTEGER) AS m FROM ranked),
      bins AS (SELECT j, e, m, min(v) AS least, max(v) AS most FROM binned GROUP BY ALL),
      asked AS (SELECT *, CAST(unnest([5, 50, 95]) AS BIGINT) AS c FROM binned)
      SELECT j, c / 100.0::DOUBLE AS p, least, most, n FROM asked JOIN bins USING (j, e, m) WHERE r = (n * c + 99) // 100""",
    "p8_found": f"WITH {_SHARED} SELECT doc_id, span_start, span_end FROM spans",
    "p8_shares": f"""WITH {_SHARED}, sums AS (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS shared FROM spans GROUP BY doc_id)
      SELECT doc_id, coalesce(length(text), 0) AS chars, coalesce(shared, 0) AS shared,
        CASE WHEN length(text) > 0 THEN coalesce(shared, 0) / length(text)::DOUBLE ELSE 0.0 END AS share FROM documents LEFT JOIN sums USING (doc_id)""",
    "p5_found": f"WITH {_VALUES} SELECT i, j, seq FROM once JOIN limits USING (j) WHERE v > 4 * p95 OR v * 4 < p5",
}
