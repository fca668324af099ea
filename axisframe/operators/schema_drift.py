"""Tables whose columns change from file to file, read into one consistent table, with a report of each change.

Inference keeps tagged unions: every record gives (column, type) alternatives, partial counts of which are fused per
file, so that no alternative is lost and files can be inferred in parallel.  Conflicts become typed branches (one typed
value column per alternative) beside a canonical value, converted to the type that most values of the column have in its
series.  Changes are found between each file and the one before it in its series; renames by equal values under equal
row names.

Types are boolean, string, integer (number without a decimal point), decimal (number with one, or with an exponent),
and for nested values object and array.  Defined cases: a payload that is null, no JSON object or cut off has no values;
a null value has no type; a row or file delivered again counts once, as loaded last; a null row name takes part in no
comparison; of equally frequent types the one seen first in the file counts; files without a file_seq or series take no
part in comparisons; other columns do not matter; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.operators.components import components
from axisframe.workspace import materialize

_KIND = """case
  when kind = 'BOOLEAN' then 'boolean' when kind = 'STRING' then 'string' when kind = 'BIGINT' then 'integer'
  when kind like 'DECIMAL%0)' and kind rlike '^DECIMAL\\\\((19|[23][0-9]), ?0\\\\)$' then 'integer'
  when kind like 'DECIMAL%' or kind like 'DOUBLE%' or kind like 'FLOAT%' then 'decimal' when kind rlike '^OBJECT' then 'object' else 'array' end"""


def last_records(records: DataFrame) -> DataFrame:
    """(file_id, row_no, obs_name, payload): each record once, as loaded last."""
    last = F.max(F.struct("loaded_at", "payload", "obs_name")).alias("r")
    return records.groupBy("file_id", "row_no").agg(last).select("file_id", "row_no", "r.obs_name", "r.payload")


def tagged_values(records: DataFrame, moving: DataFrame | None = None, all_texts: bool = True) -> DataFrame:
    """(file_id, row_no, obs_name, column, type, text): the non-null values of each record once, with their types; equal
    values of one type have equal texts.  With ``moving``, the output of :func:`moving_columns`, also ``moves``: whether
    the column comes or goes in a step from or to the file; without ``all_texts`` only these have a text."""
    last = last_records(records)
    last = last.withColumn("moving", F.lit(None).cast("array<string>")) if moving is None else last.join(moving, "file_id", "left")
    rows = last.select("file_id", "row_no", "obs_name", "moving", F.expr("try_parse_json(payload)").alias("v"))
    cells = rows.where("v is not null").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("column"), "value"))
    cells = cells.where("column is not null").withColumn("kind", F.expr("schema_of_variant(value)")).where("kind <> 'VOID'")
    raw = F.expr("cast(value as string)")
    kind = F.expr(_KIND)
    text = F.when(kind == "decimal", raw.cast("double").cast("string")).otherwise(raw)
    moves = [] if moving is None else [F.coalesce(F.array_contains("moving", F.col("column")), F.lit(False)).alias("moves")]
    text = text if all_texts or not moves else F.when(F.array_contains("moving", F.col("column")), text)
    return cells.select("file_id", "row_no", "obs_name", "column", kind.alias("type"), text.alias("text"), *moves)


def listed_files(files: DataFrame) -> DataFrame:
    """(file_id, series_id, file_seq, columns): each file once, as written last."""
    last = F.max(F.struct("written_at", "series_id", "file_seq", "column_order")).alias("f")
    return files.groupBy("file_id").agg(last).select("file_id", "f.series_id", "f.file_seq", F.array_distinct(F.coalesce("f.column_order", F.array().cast("array<string>"))).alias("columns"))


def fused_types(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., column, types): the tagged union of each column, as an array of (type, n, first_row) by falling n."""
    counted = values.groupBy(*by, "column", "type").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"))
    order = F.struct((-F.col("n")).alias("m"), "first_row", "type")
    lists = counted.groupBy(*by, "column").agg(F.sort_array(F.collect_list(order)).alias("t"))
    return lists.select(*by, "column", F.transform("t", lambda x: F.struct(x["type"].alias("type"), (-x["m"]).alias("n"), x["first_row"].alias("first_row"))).alias("types"))


def fused_paths(records: DataFrame) -> DataFrame:
    """(file_id, path, types): the tagged union of every path, nested ones too: ``a.b`` is the key b of the object a,
    ``a[]`` any element of the array a; ``types`` as in :func:`fused_types`, counting values.  Objects and arrays are
    opened level by level, however deep; one without content has no paths below it."""
    level = last_records(records).select("file_id", "row_no", F.lit("").alias("path"), F.lit("object").alias("type"), F.col("payload").alias("text"))
    parts: list[DataFrame] = []
    while True:
        spark = level.sparkSession
        opened = level.select("file_id", "row_no", "path", "type", F.expr("try_parse_json(text)").alias("v")).where("v is not null")
        below = opened.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("pos", F.col("key").alias("k"), "value")).where("pos is not null")
        inner = F.when(F.col("type") == "array", F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("k")).otherwise(F.concat("path", F.lit("."), F.col("k")))
        below = below.where("type = 'array' or k is not null").withColumn("path", inner).withColumn("kind", F.expr("schema_of_variant(value)")).where("kind <> 'VOID'")
        typed = below.select("file_id", "row_no", "path", F.expr(_KIND).alias("type"), F.expr("cast(value as string)").alias("text"))
        cells = materialize(typed.withColumn("text", F.when(F.col("type").isin("object", "array"), F.col("text"))), "paths")
        parts.append(cells.groupBy("file_id", F.col("path").alias("column"), "type").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row")))
        level = cells.where("text is not null")
        if level.isEmpty():
            break
    counted = parts[0]
    for more in parts[1:]:
        counted = counted.unionByName(more)
    order = F.struct((-F.col("n")).alias("m"), "first_row", "type")
    lists = counted.groupBy("file_id", "column").agg(F.sort_array(F.collect_list(order)).alias("t"))
    return lists.select("file_id", F.col("column").alias("path"), F.transform("t", lambda x: F.struct(x["type"].alias("type"), (-x["m"]).alias("n"), x["first_row"].alias("first_row"))).alias("types"))


def consecutive(files: DataFrame) -> DataFrame:
    """(file_id, before, columns, before_columns) of each file that has an earlier one in its series."""
    order = Window.partitionBy("series_id").orderBy("file_seq", "file_id")
    known = files.where("series_id is not null and file_seq is not null")
    lagged = known.withColumn("before", F.lag("file_id").over(order)).withColumn("before_columns", F.lag("columns").over(order))
    return lagged.where("before is not null").select("file_id", "before", "columns", "before_columns")


def moving_columns(steps: DataFrame) -> DataFrame:
    """(file_id, moving): the columns of each file that come or go in a step to it or from it."""
    gone = steps.select(F.col("before").alias("file_id"), F.explode(F.array_except("before_columns", "columns")).alias("c"))
    new = steps.select("file_id", F.explode(F.array_except("columns", "before_columns")).alias("c"))
    return gone.unionByName(new).groupBy("file_id").agg(F.collect_set("c").alias("moving"))


def renames(steps: DataFrame, values: DataFrame) -> DataFrame:
    """(file_id, old_name, new_name) of columns whose values agree, also in type, wherever both files have the row; from
    :func:`tagged_values` with ``moves``."""
    old = steps.select("file_id", "before", F.explode(F.array_except("before_columns", "columns")).alias("old_name"))
    new = steps.select("file_id", F.explode(F.array_except("columns", "before_columns")).alias("new_name"))
    # Only columns that come or go are compared: the other cells leave before anything is grouped.
    cells = values.where("moves and obs_name is not null")
    # One row a (file, name, column): the least and the greatest value; rows that share a name cannot multiply.
    cell = F.struct("type", "text")
    per_name = materialize(cells.groupBy("file_id", "obs_name", "column").agg(F.min(cell).alias("lo"), F.max(cell).alias("hi")), "changed_cells")
    left = per_name.select(F.col("file_id").alias("before"), "obs_name", F.col("column").alias("old_name"), F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"))
    left = old.join(left, ["before", "old_name"]).drop("before")
    right = per_name.select("file_id", "obs_name", F.col("column").alias("new_name"), "lo", "hi")
    right = new.join(right, ["file_id", "new_name"])
    equal = (F.col("lo") == F.col("hi")) & (F.col("old_lo") == F.col("old_hi")) & (F.col("lo") == F.col("old_lo"))
    pairs = left.join(right, ["file_id", "obs_name"]).groupBy("file_id", "old_name", "new_name").agg(F.bool_and(equal).alias("equal"))
    return pairs.where("equal").drop("equal")


def changes(files: DataFrame, values: DataFrame) -> DataFrame:
    """(file_id, change_kind, old_name, new_name): every column renamed, added, removed or retyped, from the outputs of
    :func:`listed_files` and :func:`tagged_values`."""
    steps = materialize(consecutive(files), "file_steps")
    renamed = materialize(renames(steps, values), "renames")
    added = steps.select("file_id", F.explode(F.array_except("columns", "before_columns")).alias("new_name")).join(renamed, ["file_id", "new_name"], "left_anti")
    removed = steps.select("file_id", F.explode(F.array_except("before_columns", "columns")).alias("old_name")).join(renamed, ["file_id", "old_name"], "left_anti")
    main = fused_types(values, ["file_id"]).select("file_id", "column", F.col("types")[0]["type"].alias("type"))
    kept = steps.select("file_id", "before", F.explode(F.array_intersect("columns", "before_columns")).alias("column"))
    earlier = main.select(F.col("file_id").alias("before"), "column", F.col("type").alias("before_type"))
    retyped = kept.join(main, ["file_id", "column"]).join(earlier, ["before", "column"]).where("type <> before_type")
    none = F.lit("")
    out = renamed.select("file_id", F.lit("renamed").alias("change_kind"), "old_name", "new_name")
    out = out.unionByName(added.select("file_id", F.lit("added").alias("change_kind"), none.alias("old_name"), "new_name"))
    out = out.unionByName(removed.select("file_id", F.lit("removed").alias("change_kind"), "old_name", none.alias("new_name")))
    return out.unionByName(retyped.select("file_id", F.lit("retyped").alias("change_kind"), F.col("column").alias("old_name"), F.col("column").alias("new_name")))


def alternatives(files: DataFrame, values: DataFrame) -> DataFrame:
    """(file_id, column, old_name, type, n, first_row): every type of a column that the file before it in its series has
    no value of, with its count and first row, from the outputs of :func:`listed_files` and :func:`tagged_values`.  Columns
    are those that both files list, and renamed ones; a column without values before has no alternatives there."""
    steps = materialize(consecutive(files), "file_steps")
    same = steps.select("file_id", "before", F.explode(F.array_intersect("columns", "before_columns")).alias("column")).withColumn("old_name", F.col("column"))
    renamed = renames(steps, values).join(steps.select("file_id", "before"), "file_id")
    kept = same.unionByName(renamed.select("file_id", "before", F.col("new_name").alias("column"), "old_name"))
    types = materialize(fused_types(values, ["file_id"]), "fused_types")
    earlier = types.select(F.col("file_id").alias("before"), F.col("column").alias("old_name"), F.transform("types", lambda x: x["type"]).alias("had"))
    both = kept.join(types, ["file_id", "column"]).join(earlier, ["before", "old_name"], "left")
    each = both.select("file_id", "column", "old_name", F.coalesce("had", F.array().cast("array<string>")).alias("had"), F.explode("types").alias("t"))
    return each.where(~F.array_contains("had", F.col("t.type"))).select("file_id", "column", "old_name", "t.type", "t.n", "t.first_row")


def appearing_alternatives(files: DataFrame, records: DataFrame) -> DataFrame:
    """The rows of :func:`alternatives` from the raw tables."""
    return alternatives(*_read(files, records, False))


def drift_report(files: DataFrame, records: DataFrame) -> DataFrame:
    """The report of :func:`changes` from the raw tables."""
    return changes(*_read(files, records, False))


def _read(files: DataFrame, records: DataFrame, all_texts: bool) -> tuple[DataFrame, DataFrame]:
    listed = materialize(listed_files(files), "files")
    return listed, materialize(tagged_values(records, moving_columns(consecutive(listed)), all_texts), "tagged_values")


def consistent_table(files: DataFrame, records: DataFrame) -> DataFrame:
    """All files as one long table: (series_id, file_id, row_no, obs_name, column, name, type, as_boolean, as_integer,
    as_decimal, as_string, canonical_type, canonical).

    ``column`` is the name in the file, ``name`` the one name of all columns of the series that renames connect (the
    smallest).  Each value stands in the branch of its own type; ``canonical`` is its conversion to ``canonical_type``,
    the most frequent type of that name in the series (decimal where integers and decimals are the two most frequent),
    as text, null where it cannot be converted.  Every record is in the table: one without a value in a listed column has
    a single row, with nulls from ``column`` on.  Files without a series form one series, the null one.
    """
    listed, values = _read(files, records, True)
    renamed = renames(consecutive(listed), values).join(listed.select("file_id", "series_id"), "file_id")
    key = lambda c: F.struct("series_id", F.col(c).alias("column"))
    linked = components(renamed.select(key("old_name").alias("a"), key("new_name").alias("b")))
    names = linked.select("node.series_id", "node.column", F.col("label.column").alias("name"))
    cells = values.join(listed.select("file_id", "series_id", "columns"), "file_id").where(F.array_contains("columns", F.col("column"))).drop("columns")
    cells = cells.join(names, ["series_id", "column"], "left").withColumn("name", F.coalesce("name", "column"))
    counted = cells.groupBy("series_id", "name", "type").agg(F.count("*").alias("n"))
    union = counted.groupBy("series_id", "name").agg(F.sort_array(F.collect_list(F.struct("n", "type")), False).alias("t"))
    two = F.array_sort(F.transform(F.slice("t", 1, 2), lambda x: x["type"]))
    main = union.select("series_id", "name", F.when(two == F.array(F.lit("decimal"), F.lit("integer")), "decimal").otherwise(F.col("t")[0]["type"]).alias("canonical_type"))
    branch = lambda kind, to: F.when(F.col("type") == kind, F.col("text").try_cast(to)).alias(f"as_{kind}")
    converted = (
        F.when(F.col("canonical_type") == "boolean", F.col("text").try_cast("boolean").cast("string"))
        .when(F.col("canonical_type") == "integer", F.col("text").try_cast("decimal(38,0)").cast("string"))
        .when(F.col("canonical_type") == "decimal", F.col("text").try_cast("double").cast("string"))
        .otherwise(F.col("text"))
    )
    other = F.when(~F.col("type").isin("boolean", "integer", "decimal"), F.col("text")).alias("as_string")
    main = main.select(F.col("series_id").alias("main_series"), F.col("name").alias("main_name"), "canonical_type")
    table = cells.join(main, F.col("series_id").eqNullSafe(F.col("main_series")) & (F.col("name") == F.col("main_name"))).select(
        "series_id", "file_id", "row_no", "obs_name", "column", "name", "type",
        branch("boolean", "boolean"), branch("integer", "decimal(38,0)"), branch("decimal", "double"), other,
        "canonical_type", converted.alias("canonical"),
    )
    with_value = cells.select(F.col("file_id").alias("f"), F.col("row_no").alias("r")).distinct()
    bare = last_records(records).drop("payload").join(with_value, F.col("file_id").eqNullSafe(F.col("f")) & F.col("row_no").eqNullSafe(F.col("r")), "left_anti")
    return table.unionByName(bare.join(listed.select("file_id", "series_id"), "file_id", "left"), allowMissingColumns=True)


def wide_table(consistent: DataFrame, series_id: str, files: DataFrame | None = None) -> DataFrame:
    """One series of :func:`consistent_table` as an ordinary table: a row for each record and a column for each name, of
    its canonical type.  The names are looked up first; their number is that of the columns of the series' files.  With
    ``files``, the raw table of files, listed columns without any value in the series are columns of nulls."""
    rows = consistent.where(F.col("series_id") == series_id)
    found = rows.select("column", "name", "canonical_type").where("name is not null").distinct().collect()
    kinds = {r.name: r.canonical_type for r in found}
    if files is not None:
        known = {r.column for r in found}
        listed = listed_files(files).where(F.col("series_id") == series_id).select(F.explode("columns").alias("c")).where("c is not null").distinct().collect()
        kinds |= {r.c: "string" for r in listed if r.c not in known and r.c not in kinds}
    sql = {"boolean": "boolean", "integer": "decimal(38,0)", "decimal": "double"}
    cells = [F.max(F.when(F.col("name") == n, F.col("canonical"))).cast(sql.get(k, "string")).alias(n) for n, k in sorted(kinds.items())]
    return rows.groupBy("file_id", "row_no", F.col("obs_name").alias("obs_name")).agg(*cells) if cells else rows.select("file_id", "row_no", "obs_name")
