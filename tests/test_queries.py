"""Each core query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from axisframe.plans.oracles import ORACLES
from axisframe.plans.queries import QUERIES


def rows_of(arrow):
    names = sorted(arrow.column_names)

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 9))
        return str(x)

    return names, sorted(tuple(cell(r[n]) for n in names) for r in arrow.to_pylist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    want = duck.sql(ORACLES[name]).to_arrow_table()
    assert rows_of(QUERIES[name](spark, sf_dir).toArrow()) == rows_of(want)


def test_every_row_is_converted_to_dense(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    got = QUERIES["dense_from_sparse_all_rows"](spark, sf_dir)
    assert orders > 400 and got.count() == 20 * orders and got.select("i").distinct().count() == orders


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert os.path.isdir(sf_dir) and __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_the_optional_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "axisframe"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "axisframe.llm" not in f.read_text(), f
