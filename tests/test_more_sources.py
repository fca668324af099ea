import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from axisframe import store
from axisframe.elements import Dense, ShapeError, Sparse, Table
from axisframe.model import AxisTable
from axisframe.operators.chunks import Builder
from axisframe.operators.dataset import AxisDataset
from axisframe.sources import tables


def test_csv_keeps_the_order_of_the_file(spark, tmp_path):
    lines = ["cell,n.x,text"] + [f"c{k},{k * 2},t{k % 7}" for k in range(3000)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        t = tables.read_csv(spark, str(tmp_path / "a.csv"), "cell")
        assert t.shape[0] == 3000 and t.obs_names == [f"c{k}" for k in range(3000)]
        assert t.obs.to_pandas()["n.x"].tolist() == [2 * k for k in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_arrow_in_and_out(spark):
    table = pa.table({"a": [3, None, 1], "c": pa.array(["x", "y", "x"]).dictionary_encode(), "d.e": [[1.0], [], None]})
    t = Table.from_arrow(spark, table)
    assert t.categories == {"c": ["x", "y"]} and t.to_arrow().to_pydict() == {"a": [3, None, 1], "c": ["x", "y", "x"], "d.e": [[1.0], [], None]}
    d = Dense.from_numpy(spark, np.arange(6.0).reshape(3, 2))
    assert d.to_arrow()["v"].to_pylist() == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]


def test_reshape(spark):
    x = np.arange(48).reshape(2, 24)
    d = Dense.from_numpy(spark, x)
    for shape in ((24,), (4, 6), (2, 3, 4)):
        assert d.reshape(*shape).to_numpy().tolist() == x.reshape(2, *shape).tolist()
        assert d.reshape(*shape).reshape(24).to_numpy().tolist() == x.tolist()
    with pytest.raises(ShapeError):
        d.reshape(5, 5)


def test_builder(spark):
    dense, sparse = Dense.from_numpy(spark, np.array([[0.0, 2.0]])), Sparse.from_numpy(spark, np.array([[3.0, 0.0]]))
    b = Builder("sparse")
    b.add(dense)
    b.add(sparse)
    assert b.result().to_numpy().tolist() == [[0.0, 2.0], [3.0, 0.0]]
    for wrong in (Sparse.from_numpy(spark, np.eye(3)), Sparse.from_numpy(spark, np.array([[1, 0]]))):
        with pytest.raises(ShapeError):
            b.add(wrong)
    with pytest.raises(ShapeError):
        Builder().result()


def test_file_reader_and_chunk_size(spark, tmp_path):
    path = str(tmp_path / "s")
    t = store.write(AxisTable(spark, X=Sparse.from_numpy(spark, np.eye(40))), path, chunk_size=7)
    assert len(t.X.df.inputFiles()) >= 6 and t.X.df.count() == 40
    assert tables.read_file(spark, path).shape == (40, 40)
    assert tables.read_file(spark, path, None)["X"][0].tolist() == [1.0] * 40
    with pytest.raises(ImportError):
        tables.read_file(spark, str(tmp_path / "x.h5ad"))
    with pytest.raises(ValueError):
        tables.read_file(spark, path, backend="tiff")


def test_dataset_has_the_slots_of_a_container(spark, tmp_path):
    children = {k: AxisTable.build(spark, X=np.eye(n, 3), obs=pd.DataFrame({"v": range(n)}), obsm={"m": np.ones((n, 2))}).with_names(0, [f"{k}{i}" for i in range(n)]) for k, n in (("a", 2), ("b", 4))}
    d = AxisDataset.of(children)
    assert d.obs_names == ["a0", "a1", "b0", "b1", "b2", "b3"] and list(d.obsm) == ["m"] and d.obs.columns == ["sample"] and d.var is None and not d.varm
    assert d[[5, 0]].X.to_numpy().tolist() == [[0, 0, 0], [1, 0, 0]] and d[["b1", "a1"]].obs_names == ["b1", "a1"]
    assert [tuple(r) for r in d.flattened().orderBy("ix").collect()][2:4] == [(2, 0, "b"), (3, 1, "b")]
    whole = d.into_table(str(tmp_path / "whole"))
    assert whole.shape == (6, 3) and children["a"].is_closed and whole.X.df.count() == 6
