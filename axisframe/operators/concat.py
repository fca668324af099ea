"""Concatenation along obs with alignment of the var axis by label (inner or outer)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe import store
from axisframe.axis_index import FrameIndex
from axisframe.elements import Dense, Sparse, Table, vstack
from axisframe.model import AxisTable
from axisframe.ordinals import rank_by_position
from axisframe.selection import quoted
from axisframe.workspace import materialize


def merged_labels(names: Sequence[DataFrame], join: str) -> DataFrame:
    """(ix, name) of the common labels in the order of the first input, or of all labels in the order first seen.
    Inputs are (ix, name); of a repeated label the first position counts."""
    tagged = reduce(DataFrame.unionByName, [n.select(F.lit(k).alias("src"), "ix", "name") for k, n in enumerate(names)])
    first = tagged.groupBy("name").agg(F.min(F.struct("src", "ix")).alias("first"), F.count_distinct("src").alias("sources"))
    if join == "inner":
        first = first.where(F.col("sources") == len(names))
    elif join != "outer":
        raise ValueError(f"join is inner or outer, not {join!r}")
    # Numbered by buckets of (input, position), so that no task sorts all labels.
    at = F.col("first.src").cast("long") * F.lit(1 << 44) + F.col("first.ix")
    return rank_by_position(first.withColumn("__at", at), "__at", out="rank").select(F.col("rank").alias("ix"), "name")


#: Pairs of equal names beyond which :func:`align` joins a name in parts.
ALIGN_PAIRS = 1 << 24


def align(labels: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(ix, name, column) of the labels; null where the table has none.  A name that the table repeats gives a row for each
    pair.  A name of more pairs than ``ALIGN_PAIRS`` is joined in parts: each of its labels is in one, by ``ix``, its rows of
    the table are in all.  Partitions are as many as the session names, as few bytes may give many rows."""
    values = table.select("name", quoted(column))
    sides = [df.select("name", F.lit(k).alias("__k")) for k, df in enumerate((labels, values))]
    counts = sides[0].unionByName(sides[1]).groupBy("name").agg(F.count_if(F.col("__k") == 0).alias("__n"), F.count_if(F.col("__k") == 1).alias("__m"))
    product = F.col("__n").cast("double") * F.col("__m")
    # Few names, written once so that both sides have the same parts; never more parts than labels.
    split = materialize(counts.where(product > ALIGN_PAIRS).select("name", F.least(F.ceil(product / ALIGN_PAIRS), "__n").alias("__parts")), "split_names")
    parts = F.coalesce("__parts", F.lit(1))
    tasks = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = labels.join(F.broadcast(split), "name", "left").withColumn("__part", F.pmod(F.xxhash64("ix"), parts)).repartition(tasks, "name", "__part")
    copies = values.join(F.broadcast(split), "name", "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).repartition(tasks, "name", "__part")
    return spread.join(copies, ["name", "__part"], "left").select("ix", "name", quoted(column))


def merged_var(labels: DataFrame, tables: Sequence[DataFrame], label: str = "name") -> DataFrame:
    """(ix, label, columns...): the union of the tables' columns in the order first seen; in each cell the last input with
    a value counts.  Tables have their labels in the column ``label``; all other names may occur among their columns."""
    columns = list(dict.fromkeys(c for t in tables for c in t.columns if c not in ("ix", label)))
    kinds = {c: next(t.schema[c].dataType for t in tables if c in t.columns) for c in columns}
    # Positions in place of names, as a user's column may have any name.
    tagged = [
        t.select(F.col(quoted(label)).alias("__l"), F.lit(k).alias("__src"), *[(F.col(quoted(c)) if c in t.columns else F.lit(None)).cast(kinds[c]).alias(f"__c{n}") for n, c in enumerate(columns)])
        for k, t in enumerate(tables)
    ]
    if not columns:
        return labels.select("ix", quoted(label))
    cells = [F.max_by(f"__c{n}", F.when(F.col(f"__c{n}").isNotNull(), F.col("__src"))).alias(f"__c{n}") for n in range(len(columns))]
    merged = reduce(DataFrame.unionByName, tagged).groupBy("__l").agg(*cells)
    named = labels.select("ix", F.col(quoted(label)).alias("__l"))
    return named.join(merged, "__l", "left").select("ix", F.col("__l").alias(label), *[F.col(f"__c{n}").alias(c) for n, c in enumerate(columns)])


def stacked_obs(tables: Sequence[tuple[DataFrame, int]], join: str, label: str | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Obs tables one below the other: outer fills missing columns with null, inner asks for equal columns.  With keys a
    first column ``label`` names the input."""
    offset, parts = 0, []
    for k, (df, n) in enumerate(tables):
        part = df.withColumn("ix", F.col("ix") + offset)
        if keys is not None:
            part = part.select("ix", F.lit(keys[k]).alias(label or "label"), *[quoted(c) for c in part.columns if c != "ix"])
        parts.append(part)
        offset += n
    if join == "inner" and len({tuple(sorted((f.name, f.dataType.simpleString()) for f in p.schema)) for p in parts}) > 1:
        raise ValueError("an inner concat asks for obs tables with the same columns")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=join == "outer"), parts)


def concat(tables: Sequence[AxisTable], join: str = "inner", label: str | None = None, keys: Sequence[str] | None = None, file: str | None = None) -> AxisTable:
    """One container from several: X, obs and var; the other slots are left out, as they are not aligned.  With ``file``
    it is written there and opened.  Names stay frames: nothing as long as an axis comes to the driver."""
    if not tables:
        raise ValueError("nothing to concatenate")
    if keys is not None and len(keys) != len(tables):
        raise ValueError("as many keys as inputs")
    spark = tables[0].spark
    frames = [t._names(1).frame(spark) for t in tables]
    labels = materialize(merged_labels(frames, join), "labels")
    width = labels.count()
    tag = "__label"
    with_names = [(t.var.df.join(f.select("ix", F.col("name").alias(tag)), "ix") if t.var is not None else f.select("ix", F.col("name").alias(tag))) for t, f in zip(tables, frames)]
    var = Table(merged_var(labels.select("ix", F.col("name").alias(tag)), with_names, tag).drop(tag), width)
    matrices = []
    for t, f in zip(tables, frames):
        # Of a repeated label the first position counts.
        mapping = f.join(labels.select(F.col("ix").alias("new"), "name"), "name").groupBy("new").agg(F.min("ix").alias("old"))
        if t.X is None:
            matrices.append(None)
        elif isinstance(t.X, Sparse):
            matrices.append(t.X.remap_columns(mapping, width))
        else:
            # The rows of a dense matrix are arrays of this width, so its columns fit on the driver.
            old = {r.new: r.old for r in mapping.collect()}
            matrices.append(t.X.remap_columns([old.get(n) for n in range(width)]))
    present = [m for m in matrices if m is not None]
    X = None
    if present:
        kind = present[0]
        empty = lambda n: Sparse(spark.createDataFrame([], f"i long, j long, seq long, v {_held(kind)}"), (n, width), "csr", kind.dtype)
        parts = [m if m is not None else empty(t.shape[0]) for m, t in zip(matrices, tables)]
        if any(isinstance(p, Sparse) for p in parts):
            parts = [p.to_sparse() if isinstance(p, Dense) else p for p in parts]
        X = vstack(parts)
    obs = None
    if keys is not None or any(t.obs is not None for t in tables):
        parts = [(t.obs.df if t.obs is not None else spark.range(t.shape[0]).withColumnRenamed("id", "ix"), t.shape[0]) for t in tables]
        obs = Table(stacked_obs(parts, join, label, keys), sum(t.shape[0] for t in tables))
    rows = sum(t.shape[0] for t in tables)
    offsets = [sum(t.shape[0] for t in tables[:k]) for k in range(len(tables))]
    names = reduce(DataFrame.unionByName, [t._names(0).frame(spark).select((F.col("ix") + o).alias("ix"), "name") for t, o in zip(tables, offsets)])
    whole = AxisTable(spark, rows, width, X=X, obs=obs, var=var, obs_index=FrameIndex(names, rows), var_index=FrameIndex(labels, width))
    return whole if file is None else store.write(whole, file)


def _held(matrix: Sparse | Dense) -> str:
    from axisframe.functions.casts import HELD_AS

    return HELD_AS[matrix.dtype]
