"""The supplied tables as axes and elements: X is lineitem (order x part), obs orders, var part, obsm embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.elements import Dense, Sparse, Table
from axisframe.model import AxisTable
from axisframe.store import parquet_rows

ORDER = ["l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def length(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table, from the files' footers."""
    return parquet_rows(spark, f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, value: str = "l_quantity") -> Sparse:
    """X with every line as an entry of its own; ``seq`` is left 0, as order within a coordinate is not asked for."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.lit(0).cast("long").alias("seq"), F.col(value).alias("v"))
    return Sparse(df, (length(spark, sf_dir, "orders"), length(spark, sf_dir, "part")))


def summed(spark: SparkSession, sf_dir: str) -> Sparse:
    """X with one entry a coordinate: the total quantity."""
    x = entries(spark, sf_dir)
    df = x.df.groupBy("i", "j").agg(F.sum("v").alias("v")).select("i", "j", F.lit(0).cast("long").alias("seq"), "v")
    return Sparse(df, x.shape)


def obs(spark: SparkSession, sf_dir: str) -> Table:
    df = table(spark, sf_dir, "orders")
    return Table(df.withColumnRenamed("o_orderkey", "ix"), length(spark, sf_dir, "orders"))


def var(spark: SparkSession, sf_dir: str) -> Table:
    return Table(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "ix"), length(spark, sf_dir, "part"))


def vectors(spark: SparkSession, sf_dir: str) -> Dense:
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    return Dense(df, (length(spark, sf_dir, "embeddings"), 64))


def nation_pairs(spark: SparkSession, sf_dir: str) -> Sparse:
    """A pairwise element over nations: how many suppliers the pair's nations have together, where regions agree."""
    nation = table(spark, sf_dir, "nation")
    a = nation.select(F.col("n_nationkey").cast("long").alias("i"), "n_regionkey")
    b = nation.select(F.col("n_nationkey").cast("long").alias("j"), "n_regionkey")
    df = a.join(b, "n_regionkey").select("i", "j", F.lit(0).cast("long").alias("seq"), (F.col("i") * 100 + F.col("j")).alias("v"))
    return Sparse(df, (25, 25))


def container(spark: SparkSession, sf_dir: str) -> AxisTable:
    x = entries(spark, sf_dir)
    layer = entries(spark, sf_dir, "l_discount")
    return AxisTable(spark, X=x, obs=obs(spark, sf_dir), var=var(spark, sf_dir), layers={"discount": layer})
