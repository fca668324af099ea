"""Splitting along obs by a key: the only grouping of containers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe import store
from axisframe.axis_index import FrameIndex
from axisframe.model import AxisTable
from axisframe.ordinals import rank_by_position
from axisframe.selection import quoted
from axisframe.workspace import fresh_path, materialize


def local_ordinals(keys: DataFrame, key: str, position: str = "ix") -> DataFrame:
    """(position, key, ordinal): the place of each row among those of its key, in row order; null keys are left out."""
    return rank_by_position(keys.where(F.col(key).isNotNull()).select(position, key), position, [key])


def split_frame(table: AxisTable, key: str | Sequence) -> DataFrame:
    """(ix, key) from a column of obs or a list with a value for each row."""
    if isinstance(key, str):
        return table.obs.df.select("ix", F.col(quoted(key)).cast("string").alias("key"))
    if len(key) != table.shape[0]:
        raise ValueError(f"{len(key)} keys for {table.shape[0]} rows")
    values = pd.Series(list(key), dtype=object)
    return table.spark.createDataFrame(pd.DataFrame({"ix": range(len(values)), "key": values}), "ix long, key string")


def split_obs_by(table: AxisTable, key: str | Sequence, out_dir: str | None = None) -> dict[str, AxisTable]:
    """A container for each distinct key, with obs, var and X, rows in their order; null keys are dropped, the empty text
    is a key.  With ``out_dir`` each is a store at ``out_dir/<key>`` (the key percent-encoded, the empty one ``%``).

    X, obs and names are routed once: they are joined to (ix, part, ordinal) and written partitioned by the number of the
    part; a part is a manifest that points to its folders.  The driver holds one row for each key.
    """
    spark = table.spark
    root = out_dir.rstrip("/") if out_dir else fresh_path(spark, "split")
    ranked = materialize(local_ordinals(split_frame(table, key), "key"), "split_keys")
    sizes = {r.key: r.n for r in ranked.groupBy("key").agg(F.count("*").alias("n")).collect()}
    numbers = {k: n for n, k in enumerate(sorted(sizes))}
    numbered = spark.createDataFrame(list(numbers.items()), "key string, __part int")
    places = ranked.join(numbered, "key").select(F.col("ix").alias("__ix"), "__part", F.col("ordinal").alias("__to"))

    def routed(df: DataFrame, ordinal: str, name: str) -> Callable[[int], DataFrame]:
        joined = df.join(places, F.col(ordinal) == F.col("__ix")).withColumn(ordinal, F.col("__to"))
        path = f"{root}/_parts/{name}"
        kept = [quoted(c) for c in df.columns]
        joined.select(*kept, "__part").hint("rebalance", "__part").write.option("compression", "zstd").partitionBy("__part").parquet(path)
        files = store.Files(spark, path)
        # A part without rows has no folder.
        return lambda n: spark.read.schema(df.schema).parquet(f"{path}/__part={n}") if files.exists(f"__part={n}") else df.where(F.lit(False))

    x = None if table.X is None else routed(table.X.df, "i", "X")
    obs = None if table.obs is None else routed(table.obs.df, "ix", "obs")
    names = None if table.obs_index is None else routed(table.obs_index.frame(spark), "ix", "names")
    out = {}
    for value, number in numbers.items():
        n = sizes[value]
        part = AxisTable(spark, n, table.n_vars, var=table.var, var_index=table.var_index)
        if x is not None:
            part = part.set("X", replace(table.X, df=x(number), shape=(n, *table.X.shape[1:])))
        if obs is not None:
            part = part.set("obs", replace(table.obs, df=obs(number), n=n))
        if names is not None:
            part = part.with_names(0, FrameIndex(names(number), n))
        out[value] = store.write(part, f"{root}/{quote(value, safe='') or '%'}", adopt=root) if out_dir else part
    return out
