"""Delimited text as the tables of a container, and the reader that picks a format by name or extension."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from axisframe import store
from axisframe.elements import Table
from axisframe.model import AxisTable
from axisframe.ordinals import in_file_order, placed
from axisframe.selection import quoted
from axisframe.sources import optional
from axisframe.workspace import materialize


def read_csv(spark: SparkSession, path: str, names: str | None = None, axis: int = 0, **options) -> AxisTable:
    """A container whose obs (or var) table is a delimited file with a header, rows in the order of the file; the column
    ``names``, if given, becomes the names of the axis.  ``options`` are those of Spark's reader."""
    rows = spark.read.options(**({"header": True, "inferSchema": True} | options)).csv(path)
    columns = rows.columns
    ranked = materialize(in_file_order(placed(rows)), "csv")
    table = Table(ranked.select("ix", *[quoted(c) for c in columns if c != names]), ranked.count())
    out = AxisTable(spark).set(("obs", "var")[axis], table)
    return out if names is None else out.with_names(axis, ranked.select("ix", F.col(quoted(names)).cast("string").alias("name")))


def read_file(spark: SparkSession, path: str, mode: str | None = "r+", backend: str | None = None):
    """Open a file of any format: ``backend`` names it, else the extension does.  A Parquet snapshot is opened as a handle
    (mode ``r`` or ``r+``) or, with mode None, read into memory; HDF5 and Zarr files are decoded on the driver into local
    objects, in any mode."""
    if optional.format_of(path, backend) != "parquet":
        return optional.read_file(path, backend)
    table = store.read(spark, path, mode or "r")
    return table if mode else table.to_memory(sparse="compressed")
