"""The driver's queries for the problems of this subpackage, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm.bpe import encode_corpus
from axisframe.llm.clusters import by_first_member, describe, describe_by_terms, pivot_clusters
from axisframe.llm.multi_index import MultiIndex, neighbours, similar_pairs, usable_vectors
from axisframe.llm.percentiles import bounds, merge, outlying_entries, summarize
from axisframe.llm.positional_index import leaked
from axisframe.llm.shared_spans import shared_spans, shares
from axisframe.llm.term_counts import TermCounts, counts_of_entries, entry_terms, rare_and_common
from axisframe.workspace import materialize

#: Where the public vocabularies lie; a parameter of every operator that uses one.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = counts_of_entries(table(spark, sf_dir, "x_entries"), table(spark, sf_dir, "var_lines"), TermCounts(spark, buckets=16))
    return rare_and_common(store)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).where("mark is not null").select(F.col("term").alias("var_name"), "mark")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).withColumnRenamed("term", "var_name")


def embedded(spark: SparkSession, sf_dir: str) -> MultiIndex:
    """The multi-index of the usable x_embed vectors."""
    vectors = table(spark, sf_dir, "obsm_vectors").where("obsm_key = 'x_embed'")
    return MultiIndex(usable_vectors(vectors, "obs_ix", "vec", 64, "written_at"), 64, min_cosine=0.85)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = by_first_member(pivot_clusters(embedded(spark, sf_dir)))
    return sets.where("id <> first").select(F.col("first").alias("first_ix"), F.col("id").alias("member_ix"))


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster of at least two rows with its size."""
    return p2_found(spark, sf_dir).groupBy("first_ix").agg((F.count("*") + 1).alias("size"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size, its three most typical rows, and the names that most of its rows have entries for."""
    index = embedded(spark, sf_dir)
    sets = materialize(by_first_member(pivot_clusters(index)), "clusters")
    names = describe_by_terms(sets, entry_terms(table(spark, sf_dir, "x_entries"), table(spark, sf_dir, "var_lines")))
    return describe(index, sets, "first").join(names, "first", "left").withColumnRenamed("first", "first_ix")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(embedded(spark, sf_dir), k=5)


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows, however far, of the stated query set (ids divisible by 50) against all rows."""
    index = embedded(spark, sf_dir)
    return neighbours(index, 5, min_cosine=-1.0, queries=index.rows.where("id % 50 = 0"), candidates=4_096)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlying_entries(table(spark, sf_dir, "x_entries"))


def p5_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from the summaries of the single children, combined: within 1/128 of the value."""
    entries = table(spark, sf_dir, "x_entries").where("j is not null and v > 0 and v < double('infinity')")
    once = entries.groupBy("child_key", "i", "j", "seq").agg(F.min("v").alias("v"))
    children = summarize(once.withColumn("part", F.struct("child_key", "j")), "part", "v")
    combined = merge(children.select(F.col("part.j").alias("j"), "bin", "n", "least", "most"), "j")
    return bounds(combined, "j", [0.05, 0.5, 0.95])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), width=12)


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"), span=200)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared with another."""
    documents = table(spark, sf_dir, "documents")
    return shares(documents, shared_spans(documents, span=200))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_sizes, p2_clusters, p4_found, p4_nearest, p5_found, p5_bounds, p6_ids, p7_found, p7_items, p8_found, p8_shares)
}
