"""The driver's queries for the core operators, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe import store, streaming
from axisframe.axis_index import IntervalIndex, RangeIndex, Run, interval_lookup, lookup_frame
from axisframe.elements import Dense, Sparse, Table, stack_select, vstack
from axisframe.functions import casts
from axisframe.model import AxisTable, same
from axisframe.operators import chunks, concat, dataset, schema_drift, split
from axisframe.plans import bindings as b
from axisframe.plans.bindings import table
from axisframe.selection import Index, Places, Range, parse, points_frame
from axisframe.sources import mtx
from axisframe.workspace import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _cells(x: Sparse) -> DataFrame:
    return x.df.select("i", "j", "v")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = b.summed(spark, sf_dir)
    return _cells(x.select(parse(slice(100, 900), x.shape[0]), parse([5, 3, 5], x.shape[1])))


# -- selection -----------------------------------------------------------------------------------------------------


@query
def select_row_slice(spark, sf_dir):
    x = b.entries(spark, sf_dir)
    return _cells(x.select(Range(100, -600).resolve(x.shape[0]), Range(0, x.shape[1])))


@query
def select_row_step(spark, sf_dir):
    x = b.entries(spark, sf_dir)
    return _cells(x.select(Range(3, None, 7).resolve(x.shape[0]), Range(0, x.shape[1])))


@query
def select_row_reverse(spark, sf_dir):
    x = b.entries(spark, sf_dir)
    return _cells(x.select(Range(10, -5, -3).resolve(x.shape[0]), Range(0, x.shape[1])))


@query
def select_index_repeat(spark, sf_dir):
    x = b.entries(spark, sf_dir)
    return _cells(x.select(Index((7, 3, 7, 900, 3, 0, 41)).resolve(x.shape[0]), Range(0, x.shape[1])))


@query
def select_rows_cols(spark, sf_dir):
    x = b.summed(spark, sf_dir)
    return _cells(x[100:900, [5, 3, 5, 77]])


@query
def select_csc_cols(spark, sf_dir):
    x = b.entries(spark, sf_dir).with_layout("csc")
    return _cells(x[:, 20:120])


@query
def select_composed(spark, sf_dir):
    """Two selections one after the other, composed to one filter on the stored ordinal."""
    from axisframe.selection import compose

    x = b.entries(spark, sf_dir)
    first = Range(50, None, 2).resolve(x.shape[0])
    both = compose(first, Range(10, 300, 3).resolve(len(first)))
    return _cells(x.select(both, Range(0, x.shape[1])))


@query
def select_mask(spark, sf_dir):
    """Rows where a boolean column of the axis is true; their new positions by distributed ranking."""
    x = b.entries(spark, sf_dir)
    mask = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return _cells(x.select(Places.of_mask(mask, "o_orderkey"), Range(0, x.shape[1])))


@query
def select_mask_column(spark, sf_dir):
    """The same through the container: a condition on obs subsets every slot."""
    return _cells(b.container(spark, sf_dir).subset(obs=F.col("o_orderpriority") == "1-URGENT").X)


@query
def select_by_names(spark, sf_dir):
    """Columns by a frame of names, in the order asked; the names of the axis are a frame too."""
    t = b.container(spark, sf_dir).with_names(1, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ix"), F.concat(F.lit("p"), "p_partkey").alias("name")))
    n = t.n_vars
    wanted = spark.range(0, n, 3).select(F.floor((F.lit(n - 1) - F.col("id")) / 3).cast("long").alias("new"), F.concat(F.lit("p"), F.col("id")).alias("name"))
    return _cells(t.subset(var=wanted).X)


@query
def select_seq(spark, sf_dir):
    """Entries of repeated coordinates keep their order through a selection of rows and columns."""
    x = _ordered(spark, sf_dir)
    return x[::-3, 5:].df


def _ordered(spark, sf_dir) -> Sparse:
    lines = table(spark, sf_dir, "lineitem")
    return Sparse.of(lines, (b.length(spark, sf_dir, "orders"), b.length(spark, sf_dir, "part")), "l_orderkey", "l_partkey", "l_quantity", b.ORDER[:2] + b.ORDER[3:])


@query
def select_names(spark, sf_dir):
    """Customers by name, in the order asked; unknown names have no position."""
    index = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ix"), F.col("c_name").alias("name"))
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 0").select((F.lit(1_000_000) - F.col("c_custkey")).alias("new"), F.col("c_name").alias("name"))
    return lookup_frame(index, wanted.unionByName(spark.createDataFrame([(0, "nobody")], "new long, name string")))


@query
def select_points(spark, sf_dir):
    """A mixed selection as explicit points, looked up one by one."""
    x = b.summed(spark, sf_dir)
    return x.lookup(points_frame(spark, [Index((7, 3, 900)), Range(0, 60)])).select("place", "i", "j", "v")


@query
def select_dense_rows(spark, sf_dir):
    d = b.vectors(spark, sf_dir)
    picked = d.select(Index((9, 2, 9, 100)).resolve(d.shape[0]), Range(0, 64))
    return picked.to_long().withColumn("v", F.col("v").cast("double"))


@query
def select_dense_cols(spark, sf_dir):
    d = b.vectors(spark, sf_dir)
    picked = d.select(Range(0, d.shape[0], 1), Index((5, 0, 63, 5)))
    return picked.to_long().withColumn("v", F.col("v").cast("double"))


@query
def select_dense_steps(spark, sf_dir):
    d = b.vectors(spark, sf_dir)
    return d[::-2, 60:1:-7].to_long().withColumn("v", F.col("v").cast("double"))


@query
def select_cube(spark, sf_dir):
    """Three dimensions: each vector as 8 x 8, gathered on all axes."""
    d = b.vectors(spark, sf_dir)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, 8))
    cube = Dense(d.df.withColumn("v", rows), (d.shape[0], 8, 8), d.dtype)
    picked = cube.select(Range(0, d.shape[0]), Index((7, 0)), Range(2, 8, 3))
    flat = picked.df.select("i", F.posexplode("v").alias("j", "r")).select("i", "j", F.posexplode("r").alias("k", "v"))
    return flat.select("i", "j", "k", F.col("v").cast("double").alias("v"))


@query
def dense_to_long(spark, sf_dir):
    return b.vectors(spark, sf_dir).to_long().withColumn("v", F.col("v").cast("double"))


@query
def noncanonical_entries(spark, sf_dir):
    """All entries of repeated coordinates, ordered by seq, none summed."""
    lines = table(spark, sf_dir, "lineitem")
    x = Sparse.of(lines, (b.length(spark, sf_dir, "orders"), b.length(spark, sf_dir, "part")), "l_orderkey", "l_partkey", "l_quantity", b.ORDER[:2] + b.ORDER[3:])
    return x.df


@query
def canonical_check(spark, sf_dir):
    return b.entries(spark, sf_dir).repeated()


@query
def entry_problems(spark, sf_dir):
    """Entries outside a shape that is smaller than the data need."""
    x = b.entries(spark, sf_dir)
    return Sparse(x.df, (x.shape[0] - 100, x.shape[1] - 10)).problems().select("i", "j", "v")


@query
def csr_from_row_lists(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")))).alias("entries"))
    return Sparse.from_row_lists(lists, b.length(spark, sf_dir, "part"), b.length(spark, sf_dir, "orders")).df


@query
def table_select(spark, sf_dir):
    t = b.obs(spark, sf_dir)
    names = t.columns
    return t.select(Index((12, 4, 12, 700)).resolve(t.n), Index((names.index("o_totalprice"), names.index("o_orderstatus")))).df


@query
def table_column(spark, sf_dir):
    return b.obs(spark, sf_dir)["o_orderpriority"]


@query
def subset_obs(spark, sf_dir):
    return b.container(spark, sf_dir).subset(obs=slice(200, -100, 5)).obs.df.select("ix", "o_custkey", "o_totalprice")


@query
def subset_var(spark, sf_dir):
    return b.container(spark, sf_dir).subset(var=[9, 1, 9, 50]).var.df.select("ix", "p_name", "p_size")


@query
def subset_layers(spark, sf_dir):
    return _cells(b.container(spark, sf_dir).subset(slice(10, 800), [9, 1, 9, 50]).layers["discount"])


@query
def subset_pairwise(spark, sf_dir):
    """A pairwise element takes the same selection on both axes."""
    t = AxisTable(spark, obsp={"region": b.nation_pairs(spark, sf_dir)})
    return _cells(t.subset(obs=[4, 0, 4, 17, 3]).obsp["region"])


# -- stacks --------------------------------------------------------------------------------------------------------


def _halves(spark, sf_dir) -> list[Sparse]:
    """X as two children: lines returned and lines kept, both over all orders."""
    x = b.entries(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    part = lambda flag: Sparse(lines.where(flag).select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.lit(0).cast("long").alias("seq"), F.col("l_quantity").alias("v")), x.shape)
    return [part(F.col("l_returnflag") == "R"), part(F.col("l_returnflag") != "R")]


@query
def stack_entries(spark, sf_dir):
    return _cells(vstack(_halves(spark, sf_dir)))


@query
def stack_slice(spark, sf_dir):
    parts = _halves(spark, sf_dir)
    return _cells(stack_select(parts, Range(1000, 1000 + parts[0].shape[0])))


@query
def stack_select_rows(spark, sf_dir):
    """Stacked positions with repeats, from both children, in the order asked."""
    parts = _halves(spark, sf_dir)
    n = parts[0].shape[0]
    return _cells(stack_select(parts, Index((n + 5, 3, n + 5, 40, n - 1, n, 3))))


@query
def stack_select_step(spark, sf_dir):
    """A stepped slice keeps its phase across children."""
    parts = _halves(spark, sf_dir)
    return _cells(stack_select(parts, parse(slice(1, None, 7), 2 * parts[0].shape[0])))


@query
def stack_dense(spark, sf_dir):
    d = b.vectors(spark, sf_dir)
    return vstack([d, d[::2, :]]).to_long().withColumn("v", F.col("v").cast("double"))


@query
def stack_table_common_columns(spark, sf_dir):
    """Tables with different columns: those that both have."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ix"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ix"), F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return dataset.stacked_table([Table(c, b.length(spark, sf_dir, "customer")), Table(s, b.length(spark, sf_dir, "supplier"))]).df


def _dataset(spark, sf_dir) -> dataset.AxisDataset:
    parts = _halves(spark, sf_dir)
    children = {k: AxisTable(spark, X=p, obsm={"pos": _pos(spark, p.shape[0], k)}) for k, p in zip(("returned", "kept"), parts)}
    return dataset.AxisDataset.of(children)


def _pos(spark, n, key) -> Dense:
    return Dense(spark.range(n).select(F.col("id").alias("i"), F.array(F.col("id").cast("double"), F.lit(float(len(key)))).alias("v")), (n, 2))


@query
def dataset_key_column(spark, sf_dir):
    return _dataset(spark, sf_dir).annotation.obs.df.groupBy("sample").agg(F.count("*").alias("n"), F.min("ix").alias("first"), F.max("ix").alias("last"))


@query
def dataset_key_filter(spark, sf_dir):
    """A filter on the literal key leaves the scan of one child."""
    parts = _halves(spark, sf_dir)
    return dataset.keyed_union(list(zip(("returned", "kept"), [_cells(p) for p in parts])), "sample").where("sample = 'returned'")


@query
def dataset_obsm(spark, sf_dir):
    d = _dataset(spark, sf_dir).child_obsm()["pos"]
    return d.to_long()


@query
def dataset_to_table(spark, sf_dir):
    d = _dataset(spark, sf_dir)
    n = d.shape[0] // 2
    return _cells(d.to_table(obs=[n + 2, 1, 2], var=slice(0, 150)).X)


@query
def flattened_positions(spark, sf_dir):
    """Stacked position -> child and local position, by literal offsets."""
    children = {n: AxisTable(spark).with_length(0, b.length(spark, sf_dir, n)) for n in ("customer", "supplier", "part")}
    return dataset.AxisDataset.of(children).flattened()


@query
def dataset_subset(spark, sf_dir):
    """Rows of a dataset by stacked positions as one container, all columns."""
    d = _dataset(spark, sf_dir)
    n = d.shape[0] // 2
    return _cells(d[[n + 2, 1, 2], :].X)


@query
def dataset_written(spark, sf_dir):
    """A dataset written, opened again, and its X."""
    path = fresh_path(spark, "dataset")
    _dataset(spark, sf_dir).write(path)
    return _cells(dataset.open_dataset(spark, path).X)


@query
def dataset_mask(spark, sf_dir):
    """Rows of one child through the key column of the dataset's obs."""
    return _cells(_dataset(spark, sf_dir)[F.col("sample") == "kept"].X)


@query
def stack_seq(spark, sf_dir):
    """Entries of repeated coordinates keep their order in a stack, cut across its children."""
    x = _ordered(spark, sf_dir)
    return stack_select([x, x], Range(5, 2 * x.shape[0] - 3, -2)).df


@query
def stack_mixed(spark, sf_dir):
    """A dense child below a sparse one: the stack is sparse."""
    d = b.vectors(spark, sf_dir)
    return _cells(vstack([d.to_sparse(), d])).withColumn("v", F.col("v").cast("double"))


@query
def stack_places(spark, sf_dir):
    """Rows of a stack by a frame of positions, from both children."""
    parts = _halves(spark, sf_dir)
    n = 2 * parts[0].shape[0]
    places = Places(spark.range(0, n, 5).select((F.lit(n - 1) - F.col("id")).alias("old"), F.floor(F.col("id") / 5).cast("long").alias("new")), -(-n // 5))
    return _cells(stack_select(parts, places))


# -- concat --------------------------------------------------------------------------------------------------------


def _labels(spark, sf_dir) -> list[DataFrame]:
    """Two var axes of part names that overlap; repeated names keep their first position."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ix"), F.concat_ws("_", "p_brand", "p_size").alias("name"), "p_size", "p_retailprice", "p_type")
    return [p.where("ix % 3 <> 0"), p.where("ix % 2 = 0")]


@query
def concat_inner_vars(spark, sf_dir):
    return concat.merged_labels([x.select("ix", "name") for x in _labels(spark, sf_dir)], "inner")


@query
def concat_outer_vars(spark, sf_dir):
    return concat.merged_labels([x.select("ix", "name") for x in _labels(spark, sf_dir)], "outer")


@query
def concat_align_column(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ix"), F.col("p_name").alias("name"))
    prices = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_name").alias("name"), "p_retailprice")
    return concat.align(labels, prices, "p_retailprice")


@query
def concat_var_merge(spark, sf_dir):
    """Cells of the last input with a value; inputs have different columns and nulls."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ix"), F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), "p_size", "p_retailprice", "p_type")
    one = p.select("ix", "name", "p_size", "p_type")
    two = p.where("ix % 2 = 0").select("ix", "name", F.when(F.col("p_size") > 20, F.col("p_size") + 100).alias("p_size"), "p_retailprice")
    return concat.merged_var(p.select("ix", "name"), [one, two])


def _obs_parts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ix"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ix"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    return [(c, b.length(spark, sf_dir, "customer")), (s, b.length(spark, sf_dir, "supplier"))]


@query
def concat_obs_diagonal(spark, sf_dir):
    return concat.stacked_obs(_obs_parts(spark, sf_dir), "outer")


@query
def concat_obs_inner(spark, sf_dir):
    parts = [(df.select("ix", "acctbal"), n) for df, n in _obs_parts(spark, sf_dir)]
    return concat.stacked_obs(parts, "inner")


@query
def concat_label_column(spark, sf_dir):
    return concat.stacked_obs(_obs_parts(spark, sf_dir), "outer", "source", ["c", "s"])


@query
def concat_x_outer(spark, sf_dir):
    """X of both inputs over the outer labels; missing columns have no entries."""
    one, two = (AxisTable(spark, X=x).with_names(1, RangeIndex(k, k + x.shape[1])) for k, x in zip((0, 100), _halves(spark, sf_dir)))
    return _cells(concat.concat([one, two], "outer").X)


@query
def concat_x_inner(spark, sf_dir):
    one, two = (AxisTable(spark, X=x).with_names(1, RangeIndex(k, k + x.shape[1])) for k, x in zip((0, 100), _halves(spark, sf_dir)))
    return _cells(concat.concat([one, two], "inner").X)


@query
def concat_dense(spark, sf_dir):
    """Dense inputs over outer labels; missing cells have the type's zero."""
    d = b.vectors(spark, sf_dir)
    one = AxisTable(spark, X=d[:, 0:3]).with_names(1, ["a", "b", "c"])
    two = AxisTable(spark, X=d[:, 10:12]).with_names(1, ["c", "d"])
    return concat.concat([one, two], "outer").X.to_long().withColumn("v", F.col("v").cast("double"))


def _full(spark, sf_dir) -> AxisTable:
    """Two containers with ordinary tables, one of whose columns is called name and one has a dot, concatenated."""
    x, part = b.entries(spark, sf_dir), table(spark, sf_dir, "part")
    v = part.select(F.col("p_partkey").alias("ix"), F.col("p_name").alias("name"), F.col("p_size").alias("p.size"))
    w = part.select(F.col("p_partkey").alias("ix"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ix"), F.col("o_totalprice").alias("name"))
    n = x.shape[1]
    one = AxisTable(spark, X=x, obs=Table(o, x.shape[0]), var=Table(v, n)).with_names(1, RangeIndex(0, n))
    two = AxisTable(spark, X=x, obs=Table(o.withColumn("name", -F.col("name")), x.shape[0]), var=Table(w, n)).with_names(1, RangeIndex(50, 50 + n))
    return concat.concat([one, two], "outer", "source", ["a", "b"], file=fresh_path(spark, "concat"))


@query
def concat_full(spark, sf_dir):
    return _cells(_full(spark, sf_dir).X)


@query
def concat_full_obs(spark, sf_dir):
    return _full(spark, sf_dir).obs.df


@query
def concat_full_var(spark, sf_dir):
    t = _full(spark, sf_dir)
    names = t.var_index.frame(spark).select("ix", F.col("name").alias("label"))
    return t.var.df.withColumnRenamed("p.size", "p_size").join(names, "ix")


# -- split and chunks ----------------------------------------------------------------------------------------------


@query
def split_counts(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ix"), F.col("c_mktsegment").alias("key"))
    return split.local_ordinals(t, "key").groupBy("key").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"))


@query
def split_local_ordinals(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("ix"), F.col("event_type").alias("key"))
    return split.local_ordinals(t, "key")


@query
def split_x(spark, sf_dir):
    """X of every part of a split by order priority, rows renumbered within the part."""
    t = AxisTable(spark, X=b.entries(spark, sf_dir), obs=b.obs(spark, sf_dir))
    parts = split.split_obs_by(t, "o_orderpriority")
    return dataset.keyed_union([(k, _cells(p.X)) for k, p in parts.items()], "key")


@query
def split_empty_key(spark, sf_dir):
    """A split whose keys are '' and others: the empty text is a key like any."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ix"), F.expr("nullif(case o_orderpriority when '5-LOW' then '' else substring(o_orderpriority, 3) end, 'HIGH')").alias("key.1"))
    x = b.entries(spark, sf_dir)
    parts = split.split_obs_by(AxisTable(spark, X=x, obs=Table(o, x.shape[0])), "key.1", fresh_path(spark, "split_out"))
    return dataset.keyed_union([(k, _cells(p.X)) for k, p in parts.items()], "key")


@query
def split_obs_rows(spark, sf_dir):
    """Obs and names of every part of a split."""
    o = b.obs(spark, sf_dir)
    t = AxisTable(spark, obs=o).with_names(0, RangeIndex(7, 7 + o.n))
    parts = split.split_obs_by(t, "o_orderpriority")
    return dataset.keyed_union([(k, p.obs.df.select("ix", "o_totalprice").join(p.obs_index.frame(spark), "ix")) for k, p in parts.items()], "key")


@query
def chunk_table(spark, sf_dir):
    """Chunks of a table: rows and sums of each."""
    t = b.obs(spark, sf_dir)
    sums = [c.df.agg(F.count("*").alias("n"), F.sum("o_custkey").cast("long").alias("total"), (F.max("ix") + a).alias("last")).withColumn("start", F.lit(a).cast("long")) for c, a, _ in chunks.Chunks(t, -(-t.n // 4))]
    return sums[0].unionByName(sums[1]).unionByName(sums[2]).unionByName(sums[3])


@query
def chunk_bounds(spark, sf_dir):
    n = b.length(spark, sf_dir, "orders")
    return chunks.chunk_bounds(table(spark, sf_dir, "orders"), n, 4_700)


@query
def chunk_column_sums(spark, sf_dir):
    return chunks.chunk_column_sums(b.entries(spark, sf_dir).df, 4_700)


@query
def chunk_iteration(spark, sf_dir):
    """Chunks one after another, across the children of a stack: rows and totals of each."""
    parts = _halves(spark, sf_dir)
    size = parts[0].shape[0] // 3
    sums = [c.df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")).select(F.lit(a).cast("long").alias("start"), F.lit(z).cast("long").alias("end"), "total") for c, a, z in chunks.Chunks(parts, size)]
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out


# -- names ---------------------------------------------------------------------------------------------------------

RUNS = IntervalIndex((Run("chr1", 0, 12_000, 500, 200), Run("chr2", 100, 9_050, 300, 300), Run("a:b-c", 0, 7, 3, 2)))


@query
def interval_labels(spark, sf_dir):
    return RUNS.frame(spark)


@query
def interval_positions(spark, sf_dir):
    """Labels back to positions by arithmetic; labels that are no window have none."""
    rows, offset = [], 0
    for r in RUNS.runs:
        rows.append((r.name, r.start, r.end, r.size, r.step, offset))
        offset += len(r)
    runs = spark.createDataFrame(rows, "run string, start long, end long, size long, step long, offset long")
    wanted = RUNS.frame(spark).select("name").unionByName(spark.createDataFrame([("chr1:1-2",), ("chr9:0-500",), ("x",)], "name string"))
    return interval_lookup(wanted, runs)


@query
def range_labels(spark, sf_dir):
    return RangeIndex(50, 50 + b.length(spark, sf_dir, "part")).frame(spark)


@query
def categorical_codes(spark, sf_dir):
    t = Table(table(spark, sf_dir, "events").select(F.col("event_id").alias("ix"), "event_type"), 0)
    codes, names = t.categorical("event_type")
    return codes.join(names, "code")


@query
def categorical_select(spark, sf_dir):
    """Codes of selected rows; the categories stay those of the whole column."""
    t = Table(table(spark, sf_dir, "events").select(F.col("event_id").alias("ix"), "event_type"), b.length(spark, sf_dir, "events"))
    codes, names = t.select_codes("event_type", parse(slice(None, 3, -9), t.n))
    return codes.join(names, "code")


@query
def stored_names(spark, sf_dir):
    """Names of a long axis written as a table of the store and read again."""
    n = b.length(spark, sf_dir, "orders")
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ix"), F.concat(F.lit("o"), F.col("o_custkey")).alias("name"))
    t = store.write(AxisTable(spark).with_length(0, n).with_names(0, names), fresh_path(spark, "store"))
    return t[10:-10:2].obs_index.frame(spark)


# -- conversions ---------------------------------------------------------------------------------------------------


@query
def cast_int(spark, sf_dir):
    """Integers to narrower and unsigned types, with range checks."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", casts.convert(F.col("p_size"), "i32", "i8").cast("int").alias("as_i8"), casts.convert(F.col("p_size"), "i32", "u16").alias("as_u16"))


@query
def cast_float(spark, sf_dir):
    x = b.entries(spark, sf_dir)
    return _cells(Sparse(x.df.withColumn("v", F.col("v").cast("bigint")), x.shape, dtype="i64").cast("f64"))


@query
def cast_string(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", casts.convert(F.col("p_size"), "i32", "string").alias("size_text"), casts.convert(F.col("p_size") > 10, "bool", "i32").alias("large"))


@query
def cast_dense(spark, sf_dir):
    """A dense array in double precision, and as text."""
    d = b.vectors(spark, sf_dir)
    wide = d.cast("f64").to_long().withColumnRenamed("v", "as_f64")
    whole = Dense(d.df.withColumn("v", F.transform("v", lambda x: F.floor(x * 1000).cast("int"))), d.shape, "i32")
    return wide.join(whole.cast("string").to_long().withColumnRenamed("v", "as_text"), ["i", "j"])


@query
def cast_dense_f32(spark, sf_dir):
    p = Dense(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.array(F.col("p_size").cast("smallint"), F.lit(3).cast("smallint")).alias("v")), (b.length(spark, sf_dir, "part"), 2))
    return p.cast("f32").to_long().withColumn("v", F.col("v").cast("double"))


@query
def memory_compressed(spark, sf_dir):
    """X as compressed rows on the driver and back; repeated coordinates stay."""
    x = _ordered(spark, sf_dir)
    return Sparse.from_compressed(spark, *x.to_compressed(), x.shape).df


@query
def memory_dense(spark, sf_dir):
    """A dense array as numpy and back."""
    d = b.vectors(spark, sf_dir)
    return Dense.from_numpy(spark, d.to_numpy()).to_long().withColumn("v", F.col("v").cast("double"))


@query
def memory_table(spark, sf_dir):
    """A table as pandas, with a categorical column, and back."""
    n = b.length(spark, sf_dir, "customer")
    frame = Table(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ix"), "c_acctbal", "c_mktsegment"), n).to_pandas()
    frame["c_mktsegment"] = frame["c_mktsegment"].astype("category")
    return Table.from_pandas(spark, frame).df


@query
def transposed(spark, sf_dir):
    return b.entries(spark, sf_dir).transpose()[20:120, :].df.select("i", "j", "v")


@query
def dense_from_sparse_all_rows(spark, sf_dir):
    """Every row of a narrow sparse matrix as a dense row, zeros included."""
    return b.summed(spark, sf_dir)[:, 0:20].to_dense().to_long()


# -- stores --------------------------------------------------------------------------------------------------------


@query
def roundtrip_write_read(spark, sf_dir):
    """Write a container as a snapshot, open it, and read a row range of X."""
    path = fresh_path(spark, "store")
    t = store.write(AxisTable(spark, X=b.entries(spark, sf_dir), obs=b.obs(spark, sf_dir)), path)
    return _cells(t[100:-600, :].X)


@query
def append_chunks(spark, sf_dir):
    """Grow X by chunks and read it back."""
    path = fresh_path(spark, "store")
    store.create(spark, path)
    return _cells(store.append_rows(spark, path, iter(_halves(spark, sf_dir))).X)


@query
def append_twice(spark, sf_dir):
    """Two calls: the second grows what the first left."""
    path = fresh_path(spark, "store")
    store.create(spark, path)
    for part in _halves(spark, sf_dir):
        store.append_rows(spark, path, iter([part]))
    return _cells(store.read(spark, path).X)


@query
def append_csc(spark, sf_dir):
    path, parts = fresh_path(spark, "store"), _halves(spark, sf_dir)
    store.create(spark, path)
    store.append_rows(spark, path, iter([parts[0].with_layout("csc")]), "layers/lines")
    return _cells(store.append_rows(spark, path, iter([parts[1].with_layout("csc")]), "layers/lines").layers["lines"])


@query
def append_dense(spark, sf_dir):
    path, d = fresh_path(spark, "store"), b.vectors(spark, sf_dir)
    store.create(spark, path)
    store.append_rows(spark, path, iter([d]), "obsm/vectors")
    return store.append_rows(spark, path, iter([d[::2, :]]), "obsm/vectors").obsm["vectors"].to_long().withColumn("v", F.col("v").cast("double"))


@query
def append_table(spark, sf_dir):
    """A table grown by chunks whose columns come in another order."""
    path = fresh_path(spark, "store")
    store.create(spark, path)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ix"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("ix"), F.col("s_name").alias("name"))
    store.append_rows(spark, path, iter([Table(c, b.length(spark, sf_dir, "customer"))]), "obs")
    return store.append_rows(spark, path, iter([Table(s, b.length(spark, sf_dir, "supplier"))]), "obs").obs.df


@query
def append_anew(spark, sf_dir):
    """X set from an iterator in place of what it was."""
    path, parts = fresh_path(spark, "store"), _halves(spark, sf_dir)
    store.create(spark, path)
    store.append_rows(spark, path, iter(parts))
    return _cells(store.append_rows(spark, path, iter(parts[1:]), anew=True).X)


@query
def write_slice(spark, sf_dir):
    """Every fourth row of a stored dense array replaced, in falling order."""
    d = b.vectors(spark, sf_dir)
    path = fresh_path(spark, "store")
    store.write(AxisTable(spark, obsm={"v": d}), path)
    rows = parse(slice(None, 7, -4), d.shape[0])
    new = Dense(spark.range(len(rows)).select(F.col("id").alias("i"), F.array_repeat((F.col("id") % 100).cast("float"), 64).alias("v")), (len(rows), 64), d.dtype)
    return store.write_rows(spark, path, "obsm/v", rows, new).obsm["v"].to_long().withColumn("v", F.col("v").cast("double"))


@query
def subset_written(spark, sf_dir):
    """A subset of a container as a store of its own; its X."""
    t = b.container(spark, sf_dir).subset(slice(10, None, 3), slice(5, 90)).write(fresh_path(spark, "store"))
    return _cells(t.X)


@query
def container_shapes(spark, sf_dir):
    """What a container holds after a layer was set, one deleted, and a table set: every element with its shape."""
    t = b.container(spark, sf_dir)
    t = t.set("layers", t.X, "copy").delete("layers", "discount").set("obsm", b.entries(spark, sf_dir)[:, 0:7].to_dense(), "narrow").set("var", None)
    return spark.createDataFrame([(s, *map(int, e.shape)) for s, e in t.elements()], "slot string, rows long, cols long")


@query
def store_equal(spark, sf_dir):
    """Which elements of a store equal those it was written from."""
    t = b.container(spark, sf_dir)
    back = store.write(t, fresh_path(spark, "store"))
    there = dict(back.elements())
    changed = there["X"].df.withColumn("v", F.when(F.col("i") == 3, F.col("v") + 1).otherwise(F.col("v")))
    rows = [(s, same(e, there[s])) for s, e in t.elements()] + [("changed", same(t.X, Sparse(changed, t.X.shape)))]
    return spark.createDataFrame(rows, "slot string, equal boolean")


@query
def mtx_read(spark, sf_dir):
    """A MatrixMarket file with repeated coordinates, whose order in the file becomes ``seq``."""
    path = fresh_path(spark, "mtx")
    mtx.write_mtx(_ordered(spark, sf_dir), path)
    return mtx.read_mtx(spark, path).df


@query
def mtx_symmetric(spark, sf_dir):
    """A symmetric file in parts: the entry below the diagonal stands for both."""
    path = fresh_path(spark, "mtx")
    low = b.nation_pairs(spark, sf_dir).df.where("i >= j")
    lines = low.select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    lines.write.text(path)
    store.Files(spark, path).write("part-.header", f"%%MatrixMarket matrix coordinate integer symmetric\n% pairs\n25 25 {low.count()}\n")
    return mtx.read_mtx(spark, path).df


@query
def mtx_roundtrip(spark, sf_dir):
    """Write X as a MatrixMarket file and read it again."""
    path = fresh_path(spark, "mtx")
    x = b.entries(spark, sf_dir)
    mtx.write_mtx(x, path)
    return mtx.read_mtx(spark, path).df.select("i", "j", "v")


@query
def stream_append(spark, sf_dir):
    """Orders that arrive in two micro-batches, appended as rows of a stored matrix; its entries by the rows' names."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_quantity"))).alias("entries"))
    source, path, progress = (fresh_path(spark, n) for n in ("arriving", "streamed", "progress"))
    lists.repartition(2).write.parquet(source)
    rows = spark.readStream.schema(lists.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.append_stream(rows, path, progress, b.length(spark, sf_dir, "part"), "l_orderkey", "l_orderkey").awaitTermination()
    names = spark.read.parquet(f"{path}/names").select("i", "name")
    return streaming.read_stream_store(spark, path).df.join(names, "i").select("name", "j", "seq", "v")


# -- drifting schemas ----------------------------------------------------------------------------------------------


@query
def p3_found(spark, sf_dir):
    return schema_drift.drift_report(table(spark, sf_dir, "obs_files"), table(spark, sf_dir, "obs_records"))


@query
def p3_alternatives(spark, sf_dir):
    """Every type that appears in a column from one file to the next, also where the main type stays."""
    return schema_drift.appearing_alternatives(table(spark, sf_dir, "obs_files"), table(spark, sf_dir, "obs_records"))


@query
def p3_values(spark, sf_dir):
    """The consistent table with canonical decimals as numbers, and texts only where no decimal is written as one."""
    t = p3_table(spark, sf_dir)
    number = F.col("canonical_type") == "decimal"
    return t.withColumn("canonical_decimal", F.when(number, F.col("canonical").try_cast("double"))).withColumn("canonical", F.when(~number & (F.col("type") != "decimal"), F.col("canonical")))


@query
def p3_paths(spark, sf_dir):
    """The alternative types of every path in every file."""
    paths = schema_drift.fused_paths(table(spark, sf_dir, "obs_records"))
    return paths.select("file_id", "path", F.explode("types").alias("t")).select("file_id", "path", "t.type", "t.n", "t.first_row")


@query
def p3_table(spark, sf_dir):
    return schema_drift.consistent_table(table(spark, sf_dir, "obs_files"), table(spark, sf_dir, "obs_records"))
