"""The SQL that each core query is checked with."""

_X = "SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem"
_SUMMED = "SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
_N = "(SELECT count(*) FROM orders)"
_PARTS = "(SELECT count(*) FROM part)"
_R = "SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R'"
_KEPT = "SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem WHERE l_returnflag <> 'R'"
_STACK = f"SELECT * FROM ({_R}) UNION ALL SELECT i + {_N}, j, v FROM ({_KEPT})"
_LONG = "SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
_SEQ = """SELECT l_orderkey AS i, l_partkey AS j, row_number() OVER (PARTITION BY l_orderkey, l_partkey
      ORDER BY l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS seq, l_quantity AS v FROM lineitem"""
_LABELS = """
part_names AS (SELECT p_partkey AS ix, p_brand || '_' || p_size AS name FROM part),
tagged AS (SELECT 0 AS src, * FROM part_names WHERE ix % 3 <> 0 UNION ALL SELECT 1, * FROM part_names WHERE ix % 2 = 0),
firsts AS (SELECT name, min(src * 1000000000000 + ix) AS f, count(DISTINCT src) AS n FROM tagged GROUP BY name)
"""
_OBS_PARTS = """
c AS (SELECT c_custkey AS ix, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer),
s AS (SELECT s_suppkey + (SELECT count(*) FROM customer) AS ix, s_acctbal AS acctbal, s_nationkey AS nation FROM supplier)
"""


def _values(at: list[int]) -> str:
    return ", ".join(f"({old}, {new})" for new, old in enumerate(at))


def _runs() -> str:
    runs, offset = [("chr1", 0, 12000, 500, 200), ("chr2", 100, 9050, 300, 300), ("a:b-c", 0, 7, 3, 2)], 0
    out = []
    for name, a, z, size, step in runs:
        n = -(-(z - a) // step)
        out.append(f"SELECT CAST({offset} + k AS BIGINT) AS ix, '{name}:' || ({a} + k * {step}) || '-' || least({a} + k * {step} + {size}, {z}) AS name FROM range({n}) t(k)")
        offset += n
    return " UNION ALL ".join(out)

_DRIFT = r"""
files AS (
  SELECT file_id, any_value(series_id) AS series_id, any_value(file_seq) AS file_seq, any_value(column_order) AS cols
  FROM obs_files GROUP BY file_id),
steps AS (
  SELECT file_id, cols, lag(file_id) OVER w AS before, lag(cols) OVER w AS before_cols
  FROM files WINDOW w AS (PARTITION BY series_id ORDER BY file_seq)),
rows_ AS (
  SELECT DISTINCT file_id, row_no, obs_name, CAST(payload AS JSON) AS p FROM obs_records WHERE json_valid(payload)),
keys AS (SELECT *, unnest(json_keys(p)) AS col FROM rows_),
vals AS (SELECT file_id, row_no, obs_name, col, json_extract(p, '$."' || col || '"') AS x FROM keys),
typed AS (
  SELECT file_id, row_no, obs_name, col,
    CASE json_type(x) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'decimal' ELSE 'integer' END AS type,
    CASE WHEN json_type(x) = 'DOUBLE' THEN CAST(CAST(x AS DOUBLE) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS v
  FROM vals WHERE json_type(x) <> 'NULL'),
olds AS (SELECT file_id, before, unnest(list_filter(before_cols, lambda c: NOT list_contains(cols, c))) AS old_name FROM steps WHERE before IS NOT NULL),
news AS (SELECT file_id, unnest(list_filter(cols, lambda c: NOT list_contains(before_cols, c))) AS new_name FROM steps WHERE before IS NOT NULL),
renamed AS (
  SELECT o.file_id, o.old_name, n.new_name FROM olds o JOIN news n USING (file_id)
  JOIN typed a ON a.file_id = o.before AND a.col = o.old_name
  JOIN typed b ON b.file_id = o.file_id AND b.col = n.new_name AND a.obs_name = b.obs_name
  GROUP BY ALL HAVING bool_and(a.type = b.type AND a.v = b.v)),
main AS (
  SELECT file_id, col, arg_max(type, n * 1000000 - r) AS type
  FROM (SELECT file_id, col, type, count(*) AS n, min(row_no) AS r FROM typed GROUP BY ALL) GROUP BY ALL),
kept AS (SELECT file_id, before, unnest(list_filter(cols, lambda c: list_contains(before_cols, c))) AS col FROM steps WHERE before IS NOT NULL)
"""

ORACLES: dict[str, str] = {
    "select_row_slice": f"SELECT i - 100 AS i, j, v FROM ({_X}) WHERE i >= 100 AND i < {_N} - 600",
    "select_row_step": f"SELECT (i - 3) // 7 AS i, j, v FROM ({_X}) WHERE i >= 3 AND (i - 3) % 7 = 0",
    "select_row_reverse": f"SELECT ({_N} - 6 - i) // 3 AS i, j, v FROM ({_X}) WHERE i >= 10 AND i < {_N} - 5 AND ({_N} - 6 - i) % 3 = 0",
    "select_index_repeat": f"SELECT new AS i, j, v FROM ({_X}) JOIN (VALUES {_values([7, 3, 7, 900, 3, 0, 41])}) t(old, new) ON i = old",
    "select_rows_cols": f"SELECT i - 100 AS i, new AS j, v FROM ({_SUMMED}) JOIN (VALUES {_values([5, 3, 5, 77])}) t(old, new) ON j = old WHERE i >= 100 AND i < 900",
    "select_csc_cols": f"SELECT i, j - 20 AS j, v FROM ({_X}) WHERE j >= 20 AND j < 120",
    "select_composed": f"SELECT (i - 70) // 6 AS i, j, v FROM ({_X}) WHERE i >= 70 AND i < 50 + 2 * 300 AND (i - 70) % 6 = 0",
    "select_mask": f"""SELECT new AS i, j, v FROM ({_X}) JOIN (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS new FROM orders WHERE o_orderpriority = '1-URGENT') ON i = o_orderkey""",
    "select_names": """SELECT 1000000 - c_custkey AS new, c_name AS name, (SELECT max(b.c_custkey) FROM customer b WHERE b.c_name = a.c_name) AS old
      FROM customer a WHERE c_acctbal > 0 UNION ALL SELECT 0, 'nobody', NULL""",
    "select_points": f"""WITH p AS (SELECT r.new * 60 + c.k AS place, r.old AS i, c.k AS j FROM (VALUES {_values([7, 3, 900])}) r(old, new), range(60) c(k))
      SELECT place, i, j, coalesce(v, 0.0) AS v FROM p LEFT JOIN ({_SUMMED}) USING (i, j)""",
    "select_dense_rows": f"SELECT new AS i, j, v FROM ({_LONG}) JOIN (VALUES {_values([9, 2, 9, 100])}) t(old, new) ON i = old",
    "select_dense_cols": f"SELECT i, new AS j, v FROM ({_LONG}) JOIN (VALUES {_values([5, 0, 63, 5])}) t(old, new) ON j = old",
    "select_dense_steps": f"""WITH n AS (SELECT count(*) AS n FROM embeddings)
      SELECT (n - 1 - i) // 2 AS i, (60 - j) // 7 AS j, v FROM ({_LONG}), n WHERE (n - 1 - i) % 2 = 0 AND j > 1 AND j <= 60 AND (60 - j) % 7 = 0""",
    "select_cube": f"""SELECT i, a.new AS j, CAST((j % 8 - 2) // 3 AS INTEGER) AS k, v FROM ({_LONG}) JOIN (VALUES {_values([7, 0])}) a(old, new) ON j // 8 = a.old
      WHERE j % 8 >= 2 AND (j % 8 - 2) % 3 = 0""",
    "dense_to_long": _LONG,
    "noncanonical_entries": """SELECT l_orderkey AS i, l_partkey AS j, row_number() OVER (PARTITION BY l_orderkey, l_partkey
      ORDER BY l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS seq, l_quantity AS v FROM lineitem""",
    "canonical_check": "SELECT l_orderkey AS i, l_partkey AS j, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "entry_problems": f"SELECT i, j, v FROM ({_X}) WHERE i >= {_N} - 100 OR j >= {_PARTS} - 10",
    "csr_from_row_lists": "SELECT l_orderkey AS i, l_partkey AS j, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_quantity) - 1 AS seq, l_quantity AS v FROM lineitem",
    "table_select": f"SELECT new AS ix, o_totalprice, o_orderstatus FROM orders JOIN (VALUES {_values([12, 4, 12, 700])}) t(old, new) ON o_orderkey = old",
    "table_column": "SELECT o_orderkey AS ix, o_orderpriority FROM orders",
    "subset_obs": f"SELECT (o_orderkey - 200) // 5 AS ix, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 200 AND o_orderkey < {_N} - 100 AND (o_orderkey - 200) % 5 = 0",
    "subset_var": f"SELECT new AS ix, p_name, p_size FROM part JOIN (VALUES {_values([9, 1, 9, 50])}) t(old, new) ON p_partkey = old",
    "subset_layers": f"SELECT l_orderkey - 10 AS i, new AS j, l_discount AS v FROM lineitem JOIN (VALUES {_values([9, 1, 9, 50])}) t(old, new) ON l_partkey = old WHERE l_orderkey >= 10 AND l_orderkey < 800",
    "subset_pairwise": f"""WITH p AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST(a.n_nationkey * 100 + b.n_nationkey AS BIGINT) AS v FROM nation a JOIN nation b USING (n_regionkey))
      SELECT r.new AS i, c.new AS j, v FROM p JOIN (VALUES {_values([4, 0, 4, 17, 3])}) r(old, new) ON i = r.old JOIN (VALUES {_values([4, 0, 4, 17, 3])}) c(old, new) ON j = c.old""",
    "stack_entries": _STACK,
    "stack_slice": f"SELECT i - 1000 AS i, j, v FROM ({_STACK}) WHERE i >= 1000 AND i < 1000 + {_N}",
    "stack_select_rows": f"""SELECT new AS i, j, v FROM ({_STACK}) JOIN (SELECT * FROM (VALUES (3, 1), (40, 3), (3, 6)) t(old, new)
      UNION ALL SELECT {_N} + d, new FROM (VALUES (5, 0), (5, 2), (-1, 4), (0, 5)) t(d, new)) ON i = old""",
    "stack_select_step": f"SELECT (i - 1) // 7 AS i, j, v FROM ({_STACK}) WHERE i >= 1 AND (i - 1) % 7 = 0",
    "stack_dense": f"SELECT * FROM ({_LONG}) UNION ALL SELECT i // 2 + (SELECT count(*) FROM embeddings), j, v FROM ({_LONG}) WHERE i % 2 = 0",
    "stack_table_common_columns": """SELECT c_custkey AS ix, c_name AS name, c_acctbal AS acctbal FROM customer
      UNION ALL SELECT s_suppkey + (SELECT count(*) FROM customer), s_name, s_acctbal FROM supplier""",
    "dataset_key_column": f"SELECT 'returned' AS sample, {_N} AS n, 0 AS first, {_N} - 1 AS last UNION ALL SELECT 'kept', {_N}, {_N}, 2 * {_N} - 1",
    "dataset_key_filter": f"SELECT *, 'returned' AS sample FROM ({_R})",
    "dataset_obsm": f"""WITH r AS (SELECT o_orderkey AS k FROM orders)
      SELECT k AS i, 0 AS j, CAST(k AS DOUBLE) AS v FROM r UNION ALL SELECT k, 1, 8.0 FROM r
      UNION ALL SELECT k + {_N}, 0, CAST(k AS DOUBLE) FROM r UNION ALL SELECT k + {_N}, 1, 4.0 FROM r""",
    "dataset_to_table": f"""SELECT new AS i, j, v FROM ({_STACK}) JOIN (SELECT {_N} + 2 AS old, 0 AS new UNION ALL SELECT 1, 1 UNION ALL SELECT 2, 2) ON i = old WHERE j < 150""",
    "flattened_positions": """SELECT 'customer' AS child, c_custkey AS ix, c_custkey AS local FROM customer
      UNION ALL SELECT 'supplier', s_suppkey + (SELECT count(*) FROM customer), s_suppkey FROM supplier
      UNION ALL SELECT 'part', p_partkey + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier), p_partkey FROM part""",
    "concat_inner_vars": f"WITH {_LABELS} SELECT row_number() OVER (ORDER BY f) - 1 AS ix, name FROM firsts WHERE n = 2",
    "concat_outer_vars": f"WITH {_LABELS} SELECT row_number() OVER (ORDER BY f) - 1 AS ix, name FROM firsts",
    "concat_align_column": "SELECT a.p_partkey AS ix, a.p_name AS name, b.p_retailprice FROM part a LEFT JOIN (SELECT * FROM part WHERE p_size > 25) b ON a.p_name = b.p_name",
    "concat_var_merge": """SELECT p_partkey AS ix, 'p' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 AND p_size > 20 THEN p_size + 100 ELSE p_size END AS p_size,
      p_type, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS p_retailprice FROM part""",
    "concat_obs_diagonal": f"WITH {_OBS_PARTS} SELECT ix, acctbal, segment, NULL AS nation FROM c UNION ALL SELECT ix, acctbal, NULL, nation FROM s",
    "concat_obs_inner": f"WITH {_OBS_PARTS} SELECT ix, acctbal FROM c UNION ALL SELECT ix, acctbal FROM s",
    "concat_label_column": f"WITH {_OBS_PARTS} SELECT 'c' AS source, ix, acctbal, segment, NULL AS nation FROM c UNION ALL SELECT 's', ix, acctbal, NULL, nation FROM s",
    "concat_x_outer": f"SELECT * FROM ({_R}) UNION ALL SELECT i + {_N}, j + 100, v FROM ({_KEPT})",
    "concat_x_inner": f"SELECT i, j - 100 AS j, v FROM ({_R}) WHERE j >= 100 UNION ALL SELECT i + {_N}, j, v FROM ({_KEPT}) WHERE j < {_PARTS} - 100",
    "concat_dense": f"""WITH m AS (SELECT 0 AS src, o AS j, n AS new FROM (VALUES (0, 0), (1, 1), (2, 2)) t(o, n) UNION ALL SELECT 1, o, n FROM (VALUES (10, 2), (11, 3)) t(o, n)),
      cells AS (SELECT i + src * (SELECT count(*) FROM embeddings) AS i, new AS j, v FROM ({_LONG}) JOIN m USING (j)),
      grid AS (SELECT r.i, c.j FROM range(2 * (SELECT count(*) FROM embeddings)) r(i), range(4) c(j))
      SELECT i, j, coalesce(v, 0.0) AS v FROM grid LEFT JOIN cells USING (i, j)""",
    "split_counts": "SELECT c_mktsegment AS key, count(*) AS n, count(*) - 1 AS last FROM customer GROUP BY 1",
    "split_local_ordinals": "SELECT event_id AS ix, event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS ordinal FROM events",
    "split_x": f"""SELECT key, ordinal AS i, j, v FROM ({_X}) JOIN (
      SELECT o_orderkey, o_orderpriority AS key, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS ordinal FROM orders) ON i = o_orderkey""",
    "chunk_bounds": f"SELECT k AS chunk, k * 4700 AS start, least(k * 4700 + 4700, {_N}) AS \"end\" FROM range(({_N} + 4699) // 4700) t(k)",
    "chunk_column_sums": f"SELECT i // 4700 AS chunk, j, sum(v) AS total FROM ({_X}) GROUP BY 1, 2",
    "chunk_iteration": f"""WITH n AS (SELECT {_N} AS n, {_N} // 3 AS z), st AS ({_STACK}),
      b AS (SELECT c * n + k * z AS start, least(c * n + k * z + z, (c + 1) * n) AS stop FROM n, range(2) x(c), range((n + z - 1) // z) y(k))
      SELECT start, stop AS \"end\", coalesce(sum(v), 0.0) AS total FROM b LEFT JOIN st ON i >= start AND i < stop GROUP BY 1, 2""",
    "interval_labels": _runs(),
    "interval_positions": f"SELECT name, ix FROM ({_runs()}) UNION ALL SELECT * FROM (VALUES ('chr1:1-2', NULL), ('chr9:0-500', NULL), ('x', NULL))",
    "range_labels": "SELECT p_partkey AS ix, CAST(p_partkey + 50 AS VARCHAR) AS name FROM part",
    "categorical_codes": """SELECT event_id AS ix, code, event_type AS category FROM events JOIN (
      SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS code FROM events GROUP BY event_type) USING (event_type)""",
    "cast_int": "SELECT p_partkey, CAST(CAST(p_size AS TINYINT) AS INTEGER) AS as_i8, CAST(CAST(p_size AS USMALLINT) AS INTEGER) AS as_u16 FROM part",
    "cast_float": "SELECT l_orderkey AS i, l_partkey AS j, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS v FROM lineitem",
    "cast_string": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, CAST(p_size > 10 AS INTEGER) AS large FROM part",
    "dense_from_sparse_all_rows": f"SELECT r.k AS i, c.k AS j, coalesce(v, 0.0) AS v FROM range({_N}) r(k) CROSS JOIN range(20) c(k) LEFT JOIN ({_SUMMED}) ON i = r.k AND j = c.k",
    "roundtrip_write_read": f"SELECT i - 100 AS i, j, v FROM ({_X}) WHERE i >= 100 AND i < {_N} - 600",
    "append_chunks": _STACK,
    "mtx_roundtrip": _X,
    "select_mask_column": f"""SELECT new AS i, j, v FROM ({_X}) JOIN (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS new FROM orders WHERE o_orderpriority = '1-URGENT') ON i = o_orderkey""",
    "select_by_names": f"SELECT i, ({_PARTS} - 1 - j) // 3 AS j, v FROM ({_X}) WHERE j % 3 = 0",
    "select_seq": f"SELECT ({_N} - 1 - i) // 3 AS i, j - 5 AS j, seq, v FROM ({_SEQ}) WHERE ({_N} - 1 - i) % 3 = 0 AND j >= 5",
    "stack_seq": f"""SELECT (2 * {_N} - 4 - i) // 2 AS i, j, seq, v FROM (SELECT * FROM ({_SEQ}) UNION ALL SELECT i + {_N}, j, seq, v FROM ({_SEQ}))
      WHERE i >= 5 AND i < 2 * {_N} - 3 AND (2 * {_N} - 4 - i) % 2 = 0""",
    "stack_mixed": f"SELECT * FROM ({_LONG}) WHERE v <> 0 UNION ALL SELECT i + (SELECT count(*) FROM embeddings), j, v FROM ({_LONG}) WHERE v <> 0",
    "stack_places": f"SELECT (2 * {_N} - 1 - i) // 5 AS i, j, v FROM ({_STACK}) WHERE (2 * {_N} - 1 - i) % 5 = 0",
    "dataset_subset": f"SELECT new AS i, j, v FROM ({_STACK}) JOIN (SELECT {_N} + 2 AS old, 0 AS new UNION ALL SELECT 1, 1 UNION ALL SELECT 2, 2) ON i = old",
    "dataset_written": _STACK,
    "dataset_mask": _KEPT,
    "concat_full": f"SELECT * FROM ({_X}) UNION ALL SELECT i + {_N}, j + 50, v FROM ({_X})",
    "concat_full_obs": f"SELECT o_orderkey AS ix, 'a' AS source, o_totalprice AS name FROM orders UNION ALL SELECT o_orderkey + {_N}, 'b', -o_totalprice FROM orders",
    "concat_full_var": f"""SELECT k AS ix, CAST(k AS VARCHAR) AS label, coalesce(b.p_brand, a.p_name) AS name, a.p_size, b.p_type AS kind
      FROM range({_PARTS} + 50) r(k) LEFT JOIN part a ON a.p_partkey = k LEFT JOIN part b ON b.p_partkey + 50 = k""",
    "split_empty_key": f"""SELECT key, ordinal AS i, j, v FROM ({_X}) JOIN (
      SELECT o_orderkey, key, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) - 1 AS ordinal
      FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN '' ELSE substring(o_orderpriority, 3) END AS key FROM orders) WHERE key <> 'HIGH') ON i = o_orderkey""",
    "split_obs_rows": """SELECT o_orderpriority AS key, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS ix, o_totalprice,
      CAST(o_orderkey + 7 AS VARCHAR) AS name FROM orders""",
    "chunk_table": f"""SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, max(o_orderkey) AS last, (o_orderkey // (({_N} + 3) // 4)) * (({_N} + 3) // 4) AS start
      FROM orders GROUP BY o_orderkey // (({_N} + 3) // 4)""",
    "categorical_select": """SELECT ((SELECT count(*) FROM events) - 1 - event_id) // 9 AS ix, code, event_type AS category FROM events JOIN (
      SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS code FROM events GROUP BY event_type) USING (event_type)
      WHERE event_id > 3 AND ((SELECT count(*) FROM events) - 1 - event_id) % 9 = 0""",
    "stored_names": f"SELECT (o_orderkey - 10) // 2 AS ix, 'o' || o_custkey AS name FROM orders WHERE o_orderkey >= 10 AND o_orderkey < {_N} - 10 AND (o_orderkey - 10) % 2 = 0",
    "cast_dense": f"SELECT i, j, v AS as_f64, CAST(CAST(floor(CAST(v AS FLOAT) * CAST(1000 AS FLOAT)) AS INTEGER) AS VARCHAR) AS as_text FROM ({_LONG})",
    "cast_dense_f32": "SELECT p_partkey AS i, 0 AS j, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 1, 3.0 FROM part",
    "memory_compressed": _SEQ,
    "memory_dense": _LONG,
    "memory_table": "SELECT c_custkey AS ix, c_acctbal, c_mktsegment FROM customer",
    "transposed": f"SELECT j - 20 AS i, i AS j, v FROM ({_X}) WHERE j >= 20 AND j < 120",
    "append_twice": _STACK,
    "append_csc": _STACK,
    "append_dense": f"SELECT * FROM ({_LONG}) UNION ALL SELECT i // 2 + (SELECT count(*) FROM embeddings), j, v FROM ({_LONG}) WHERE i % 2 = 0",
    "append_table": """SELECT c_custkey AS ix, c_name AS name, c_acctbal AS acctbal FROM customer
      UNION ALL SELECT s_suppkey + (SELECT count(*) FROM customer), s_name, s_acctbal FROM supplier""",
    "append_anew": _KEPT,
    "write_slice": f"""WITH n AS (SELECT count(*) AS n FROM embeddings)
      SELECT i, j, CASE WHEN i > 7 AND (n - 1 - i) % 4 = 0 THEN CAST(((n - 1 - i) // 4) % 100 AS DOUBLE) ELSE v END AS v FROM ({_LONG}), n""",
    "subset_written": f"SELECT (i - 10) // 3 AS i, j - 5 AS j, v FROM ({_X}) WHERE i >= 10 AND (i - 10) % 3 = 0 AND j >= 5 AND j < 90",
    "container_shapes": f"""SELECT 'X' AS slot, {_N} AS rows, {_PARTS} AS cols UNION ALL SELECT 'obs', {_N}, 5 UNION ALL SELECT 'layers/copy', {_N}, {_PARTS}
      UNION ALL SELECT 'obsm/narrow', {_N}, 7""",
    "store_equal": "SELECT * FROM (VALUES ('X', true), ('obs', true), ('var', true), ('layers/discount', true), ('changed', false)) t(slot, equal)",
    "stream_append": """SELECT CAST(l_orderkey AS VARCHAR) AS name, l_partkey AS j, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) - 1 AS seq,
      l_quantity AS v FROM lineitem""",
    "mtx_read": _SEQ,
    "mtx_symmetric": """SELECT CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS BIGINT) AS j, 0 AS seq,
      CAST(greatest(a.n_nationkey, b.n_nationkey) * 100 + least(a.n_nationkey, b.n_nationkey) AS BIGINT) AS v FROM nation a JOIN nation b USING (n_regionkey)""",
    "p3_values": f"""WITH RECURSIVE {_DRIFT},
      edges AS (SELECT series_id AS s, old_name AS a, new_name AS b FROM renamed JOIN files USING (file_id)
        UNION SELECT series_id, new_name, old_name FROM renamed JOIN files USING (file_id)),
      reach(s, a, b) AS (SELECT * FROM edges UNION SELECT r.s, r.a, e.b FROM reach r JOIN edges e ON e.s = r.s AND e.a = r.b),
      names AS (SELECT s, a, least(a, min(b)) AS name FROM reach GROUP BY s, a),
      texts AS (SELECT t.*, CASE t.type WHEN 'string' THEN json_extract_string(t.v, '$') ELSE t.v END AS text FROM typed t),
      cells AS (SELECT f.series_id, t.file_id, t.row_no, t.obs_name, t.col, coalesce(n.name, t.col) AS name, t.type, t.text
        FROM texts t JOIN files f USING (file_id) LEFT JOIN names n ON n.s = f.series_id AND n.a = t.col WHERE list_contains(f.cols, t.col)),
      counted AS (SELECT series_id, name, type, row_number() OVER (PARTITION BY series_id, name ORDER BY n DESC, type DESC) AS r
        FROM (SELECT series_id, name, type, count(*) AS n FROM cells GROUP BY ALL)),
      mains AS (SELECT series_id, name, CASE WHEN list_sort(list(type) FILTER (WHERE r <= 2)) = ['decimal', 'integer'] THEN 'decimal'
        ELSE any_value(type) FILTER (WHERE r = 1) END AS canonical_type FROM counted GROUP BY ALL)
      SELECT c.series_id, c.file_id, c.row_no, c.obs_name, c.col AS "column", c.name, c.type,
        CASE c.type WHEN 'boolean' THEN CAST(c.text AS BOOLEAN) END AS as_boolean, CASE c.type WHEN 'integer' THEN CAST(c.text AS DECIMAL(38,0)) END AS as_integer,
        CASE c.type WHEN 'decimal' THEN CAST(c.text AS DOUBLE) END AS as_decimal, CASE c.type WHEN 'string' THEN c.text END AS as_string, m.canonical_type,
        CASE m.canonical_type WHEN 'decimal' THEN try_cast(c.text AS DOUBLE) END AS canonical_decimal,
        CASE WHEN c.type <> 'decimal' THEN CASE m.canonical_type WHEN 'boolean' THEN CAST(try_cast(c.text AS BOOLEAN) AS VARCHAR) WHEN 'integer' THEN CAST(try_cast(c.text AS DECIMAL(38,0)) AS VARCHAR)
          WHEN 'decimal' THEN NULL ELSE c.text END END AS canonical
      FROM cells c JOIN mains m ON m.series_id = c.series_id AND m.name = c.name
      UNION ALL SELECT f.series_id, r.file_id, r.row_no, r.obs_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM (SELECT DISTINCT file_id, row_no, obs_name FROM obs_records) r LEFT JOIN files f USING (file_id) ANTI JOIN cells USING (file_id, row_no)""",
    "p3_paths": f"""WITH {_DRIFT}
      SELECT file_id, col AS path, type, CAST(count(*) AS BIGINT) AS n, min(row_no) AS first_row FROM typed GROUP BY ALL""",
    "p3_alternatives": f"""WITH {_DRIFT},
      had AS (SELECT file_id, col, type, CAST(count(*) AS BIGINT) AS n, min(row_no) AS first_row FROM typed GROUP BY ALL),
      both_ AS (SELECT file_id, before, col, col AS old_name FROM kept UNION ALL
        SELECT r.file_id, s.before, r.new_name, r.old_name FROM renamed r JOIN steps s USING (file_id))
      SELECT b.file_id, b.col AS "column", b.old_name, h.type, h.n, h.first_row FROM both_ b JOIN had h ON h.file_id = b.file_id AND h.col = b.col
        ANTI JOIN had o ON o.file_id = b.before AND o.col = b.old_name AND o.type = h.type""",
    "p3_found": f"""WITH {_DRIFT}
      SELECT file_id, 'renamed' AS change_kind, old_name, new_name FROM renamed
      UNION ALL SELECT file_id, 'added', '', new_name FROM news ANTI JOIN renamed USING (file_id, new_name)
      UNION ALL SELECT file_id, 'removed', old_name, '' FROM olds ANTI JOIN renamed USING (file_id, old_name)
      UNION ALL SELECT k.file_id, 'retyped', k.col, k.col FROM kept k JOIN main a ON a.file_id = k.file_id AND a.col = k.col
        JOIN main b ON b.file_id = k.before AND b.col = k.col WHERE a.type <> b.type""",
}
