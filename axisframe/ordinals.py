"""Ordinals for rows that have an order but no position, without sorting them all in one task.

Rows are counted in buckets of their order value; a bucket's offset is the sum of the counts before it (a small table),
and only inside a bucket rows are numbered by sorting.  A key that holds a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_by_position(df: DataFrame, position: str = "ix", keys: list[str] | None = None, out: str = "ordinal", bucket: int = 100_000) -> DataFrame:
    """Number the rows of each group of ``keys`` (all rows without keys) by the long column ``position``, from 0.
    Null keys form a group of their own; of equal positions any order."""
    keys = keys or []
    marked = df.withColumn("__b", F.floor(F.col(position) / bucket))
    counts = marked.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    names = [f"__k{n}" for n in range(len(keys))]
    offsets = offsets.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__b").alias("__ob"), "__o")
    on = F.col("__b").eqNullSafe(F.col("__ob"))
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(position)) - 1
    return marked.withColumn("__r", inside).join(offsets, on).withColumn(out, (F.col("__r") + F.col("__o")).cast("long")).drop("__b", "__r", "__ob", "__o", *names)


#: Columns that tell where a row of a text file stands, as :func:`placed` gives them.
PLACE = ("__file", "__block", "__line")


def placed(rows: DataFrame) -> DataFrame:
    """Rows just read from text files, with their place: file, block, and a number that rises with the lines of a block."""
    here = rows.withColumn("__file", F.col("_metadata.file_path")).withColumn("__block", F.col("_metadata.file_block_start"))
    return here.withColumn("__line", F.monotonically_increasing_id())


def in_file_order(rows: DataFrame, out: str = "ix") -> DataFrame:
    """Number rows with a place by file, block and line, from 0: within blocks each on its own, blocks by their counts."""
    blocks = rows.groupBy("__file", "__block").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = rows.withColumn("__at", F.row_number().over(Window.partitionBy("__file", "__block").orderBy("__line")) - 1)
    return inside.join(starts, ["__file", "__block"]).withColumn(out, (F.col("__start") + F.col("__at")).cast("long")).drop("__start", "__at", *PLACE)
