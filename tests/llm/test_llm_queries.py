"""The queries of this subpackage that have SQL, against DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

from axisframe.llm.oracles import ORACLES
from axisframe.llm.queries import QUERIES



def rows_of(arrow):
    names = sorted(arrow.column_names)
    return names, sorted(tuple(str(r[n]) for n in names) for r in arrow.to_pylist())


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
    assert rows_of(QUERIES[name](spark, sf_dir).toArrow()) == rows_of(duck.sql(ORACLES[name]).to_arrow_table())


def test_clusters_shares_and_bounds_agree_with_each_other(spark, sf_dir, duck):
    members = QUERIES["p2_found"](spark, sf_dir).toPandas()
    told = QUERIES["p2_clusters"](spark, sf_dir).toPandas().set_index("first_ix")
    for first, group in members.groupby("first_ix"):
        assert told.loc[first, "size"] == len(group) + 1
        assert set(told.loc[first, "typical"]) <= {first, *group.member_ix}
    spans = QUERIES["p8_found"](spark, sf_dir).toPandas()
    shares = QUERIES["p8_shares"](spark, sf_dir).toPandas().set_index("doc_id")
    assert (shares.share <= 1).all() and shares.shared.sum() == (spans.span_end - spans.span_start).sum()
    bounds = QUERIES["p5_bounds"](spark, sf_dir).toPandas()
    limits = duck.sql("""SELECT j, list(v ORDER BY v) AS v FROM (SELECT i, j, seq, min(v) AS v FROM x_entries
      WHERE j IS NOT NULL AND v > 0 AND isfinite(v) GROUP BY ALL) GROUP BY j""").df().set_index("j").v
    for r in bounds.itertuples():
        values = limits[r.j]
        exact = values[-(-len(values) * round(r.p * 100) // 100) - 1]
        assert r.n == len(values) and r.least <= exact <= r.most <= r.least * (1 + 1 / 128)
