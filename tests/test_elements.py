import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axisframe import elements
from axisframe.elements import Dense, ShapeError, Sparse, Table, stack_select, vstack
from axisframe.functions import casts
from axisframe.selection import Index, Range, parse


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(1)
    return (rng.random((12, 9)) < 0.4) * rng.integers(1, 50, (12, 9))


SELECTIONS = [(slice(None), slice(2, 7)), ([5, 3, 5], slice(None)), (slice(None, None, -3), [8, 0, 8]), (slice(1, 11, 4), slice(None, None, -1)), ([], [1])]


@pytest.mark.parametrize("rows,cols", SELECTIONS)
def test_sparse_and_dense_select_like_numpy(spark, grid, rows, cols):
    want = grid[rows][:, cols] if not isinstance(rows, list) or rows else grid[np.array(rows, int)][:, cols]
    s, d = Sparse.from_numpy(spark, grid)[rows, cols], Dense.from_numpy(spark, grid)[rows, cols]
    assert s.shape == d.shape == want.shape
    assert (s.to_numpy() == want).all() and (d.to_numpy() == want).all()


def test_three_dimensions(spark):
    cube = np.arange(4 * 5 * 6).reshape(4, 5, 6)
    d = Dense.from_numpy(spark, cube)
    assert (d[[3, 0, 3], 1:4, ::-2].to_numpy() == cube[[3, 0, 3]][:, 1:4, ::-2]).all()
    assert d.at(2, 3, 4) == cube[2, 3, 4]
    with pytest.raises(IndexError):
        d.at(9, 0, 0)


def test_repeated_coordinates_are_kept(spark):
    rows = [(0, 0, 1), (1, 0, 2), (1, 0, 3), (1, 2, 4), (2, 3, 5), (3, 1, 6), (4, 3, 7)]
    df = spark.createDataFrame([(i, j, v, n) for n, (i, j, v) in enumerate(rows)], "i long, j long, v long, n int")
    x = Sparse.of(df, (5, 4), order=["n"])
    assert not x.is_canonical()
    assert sorted((r.i, r.j, r.v) for r in x.df.collect()) == sorted(rows)
    picked = x.select(Range(0, 5), Index((0, 0)))
    assert sorted((r.i, r.j, r.seq, r.v) for r in picked.df.where("i = 1").collect()) == [(1, 0, 0, 2), (1, 0, 1, 3), (1, 1, 0, 2), (1, 1, 1, 3)]
    assert [tuple(r) for r in x.repeated().collect()] == [(1, 0, 2)]
    assert x.problems().isEmpty() and x.transpose().shape == (4, 5)


def test_compressed_rows(spark):
    data, indices, offsets = [1, 2, 3, 4, 5, 6, 7], [0, 0, 0, 2, 3, 1, 3], [0, 1, 4, 5, 6, 7]
    x = Sparse.from_compressed(spark, data, indices, offsets, (5, 4))
    rows = sorted((r.i, r.j, r.seq, r.v) for r in x.df.collect())
    assert rows == [(0, 0, 0, 1), (1, 0, 0, 2), (1, 0, 1, 3), (1, 2, 0, 4), (2, 3, 0, 5), (3, 1, 0, 6), (4, 3, 0, 7)]
    y = Sparse.from_compressed(spark, data, indices, offsets, (4, 5), "csc")
    assert sorted((r.j, r.i) for r in y.df.collect()) == [(r[0], r[1]) for r in rows]
    for bad in (([1], [5], [0, 1]), ([1, 2], [2, 1], [0, 2]), ([1], [0], [0, 2])):
        with pytest.raises(ShapeError):
            Sparse.from_compressed(spark, *bad, (1, 4))


def test_stacks_equal_concatenated_arrays(spark, grid):
    parts = [grid[:5], grid[5:5], grid[5:]]
    for kind in (Sparse, Dense):
        elements = [kind.from_numpy(spark, p) if len(p) else kind.from_numpy(spark, grid)[0:0, :] for p in parts]
        assert (vstack(elements).to_numpy() == grid).all()
        for what in (slice(1, 11, 3), slice(None, None, -1), [11, 0, 4, 5, 5], slice(3, 9)):
            got = stack_select(elements, parse(what, 12), Range(0, 9))
            assert (got.to_numpy() == grid[what]).all(), what
    with pytest.raises(ShapeError):
        vstack([Sparse.from_numpy(spark, grid), Sparse.from_numpy(spark, grid[:, :3])])


def test_slices_of_rows_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("i"), F.lit(1).cast("long").alias("j"), F.lit(0).cast("long").alias("seq"), F.lit(1.0).alias("v")).write.parquet(str(tmp_path / "x"))
    x = Sparse(spark.read.parquet(str(tmp_path / "x")), (1000, 5))
    plan = stack_select([x, x], Range(1100, 1200), Range(0, 5)).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i,100)" in plan and plan.count("FileScan") == 1
    plan = x.select(Index((7, 3, 7)), Range(0, 5)).df._jdf.queryExecution().executedPlan().toString()
    assert "In(i, [3,7])" in plan and "BroadcastHashJoin" in plan


def test_tables(spark):
    frame = pd.DataFrame({"a": [1, 2, 3, 4], "c": pd.Categorical(["x", "y", None, "x"], categories=["y", "x"])})
    t = Table.from_pandas(spark, frame)
    back = t.select(Index((3, 1, 3))).to_pandas()
    assert back["a"].tolist() == [4, 2, 4] and back["c"].tolist() == ["x", "y", "x"] and list(back["c"].cat.categories) == ["y", "x"]
    assert t[1:3, [1]].columns == ["c"] and "a" in t and "z" not in t
    codes, names = t.categorical("c")
    assert [r.code for r in codes.orderBy("ix").collect()] == [0, 1, -1, 0]
    assert [r.category for r in names.orderBy("code").collect()] == ["x", "y"]
    assert t.with_column("d", [9, 8, 7, 6]).df.orderBy("ix").select("d").toPandas()["d"].tolist() == [9, 8, 7, 6]
    with pytest.raises(ShapeError):
        t.with_column("d", [1])


def test_null_nan_and_infinity_stay_apart(spark):
    d = Dense(spark.createDataFrame([(0, [float("nan"), float("inf"), None])], "i long, v array<double>"), (1, 3))
    row = d[:, [2, 0, 1]].df.first().v
    assert row[0] is None and np.isnan(row[1]) and row[2] == float("inf")


def test_casts(spark):
    one = spark.createDataFrame([(300, 1.5, True, None)], "a int, b double, c boolean, d int")
    assert one.select(casts.convert(F.col("a"), "i32", "u16")).first()[0] == 300
    assert one.select(casts.convert(F.col("d"), "i32", "i8")).first()[0] is None
    assert one.select(casts.convert(F.col("c"), "bool", "i64")).first()[0] == 1
    for source, target in (("i32", "i8"), ("i32", "u8")):
        with pytest.raises(Exception, match="cannot hold"):
            one.select(casts.convert(F.col("a"), source, target)).collect()
    for column, source, target in (("b", "f64", "i32"), ("b", "f64", "f32"), ("a", "i32", "f32"), ("a", "i32", "bool")):
        with pytest.raises(casts.CastError):
            casts.convert(F.col(column), source, target)
    assert Sparse.from_numpy(spark, np.eye(2)).cast("f32").dtype == "f32"
    assert Dense.from_numpy(spark, np.eye(2, dtype="int8")).cast("f64").to_numpy().dtype == float


def test_compressed_matrices_pass_the_driver_in_parts(spark, monkeypatch):
    """Repeated coordinates, empty rows and runs that parts cut, for all layouts; no part is longer than the bound."""
    rng = np.random.default_rng(5)
    i, j = rng.integers(0, 9, 600) * 2, rng.integers(0, 4, 600)
    i[:300], j[:300] = 4, 2
    frame = pd.DataFrame({"i": i, "j": j})
    frame["seq"] = frame.groupby(["i", "j"]).cumcount()
    monkeypatch.setattr(elements, "_PART", 200)
    monkeypatch.setattr(elements, "_IN_FILE", 500)
    sent, kept = [], elements._entries
    monkeypatch.setattr(elements, "_entries", lambda *a: sent.append(a[5] - a[4]) or kept(*a))
    for kind, values in (("double", rng.normal(size=600)), ("long", np.arange(600)), ("string", [f"t{n}" for n in range(600)])):
        rows = [(int(a), int(b), int(c), v.item() if hasattr(v, "item") else v) for a, b, c, v in zip(i, j, frame["seq"], values)]
        for layout in ("csr", "csc"):
            x = Sparse(spark.createDataFrame(rows[::-1], f"i long, j long, seq long, v {kind}"), (19, 5), layout)
            data, indices, offsets = x.to_compressed()
            assert (len(data), len(indices), len(offsets), offsets[-1]) == (600, 600, 20 if layout == "csr" else 6, 600)
            assert isinstance(data, np.memmap) == (kind != "string")
            back = Sparse.from_compressed(spark, data, indices, offsets, x.shape, layout)
            assert sorted(map(tuple, back.df.collect())) == sorted(rows) and back.df.schema["v"].dataType == x.df.schema["v"].dataType
    assert max(sent) == 200 and sum(sent) == 6 * 600
    holes = Sparse(spark.createDataFrame([(k, 0, 0, None if k > 90 else k) for k in range(100)], "i long, j long, seq long, v long"), (100, 1)).to_compressed()[0]
    assert holes[:91].tolist() == list(range(91)) and np.isnan(holes[91:].astype(float)).all()
    bad = np.zeros(300, int)
    bad[199], bad[200] = 1, 0
    with pytest.raises(ShapeError):
        Sparse.from_compressed(spark, np.ones(300), bad, [0, 300], (1, 2))
    none = Sparse(spark.createDataFrame([], "i long, j long, seq long, v int"), (3, 2)).to_compressed()
    assert [len(a) for a in none] == [0, 0, 4] and none[0].dtype == np.int32


def test_parts_of_compressed_matrices_are_small_on_their_way(spark, monkeypatch):
    """Either way entries pass the driver packed, not as rows; pieces cut runs of one coordinate, values keep their type."""
    n = 6000
    i, j = np.sort(np.r_[np.zeros(2500, int), np.arange(n - 2500) // 3]) * 2, np.zeros(n, int)
    frame = pd.DataFrame({"i": i, "j": j})
    frame["seq"] = frame.groupby(["i", "j"]).cumcount()
    offsets = np.r_[0, np.cumsum(np.bincount(i))]
    monkeypatch.setattr(elements, "_PART", 2000)
    monkeypatch.setattr(elements, "_PIECE", 700, raising=False)
    sent, create, packed, kept = [], type(spark).createDataFrame, [], elements.materialize
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: sent.append(data) or create(self, data, *a, **k))

    def noted(df, label, *a):
        out = kept(df, label, *a)
        packed.extend(out.select(F.length("part")).toArrow()[0].to_pylist() if label == "packed" else [])
        return out

    monkeypatch.setattr(elements, "materialize", noted)
    for values in (np.r_[np.nan, np.arange(n - 1) % 50.0], np.arange(n, dtype="uint8"), np.arange(n) % 3 == 0, np.arange(n, dtype="int32")):
        for layout in ("csr", "csc"):
            sent.clear(), packed.clear()
            shape = (len(offsets) - 1, 1) if layout == "csr" else (1, len(offsets) - 1)
            x = Sparse.from_compressed(spark, values, j, offsets, shape, layout)
            assert len(sent) == 3 and max(t.nbytes for t in sent) < 8 * 2000
            got = x.df.toPandas().sort_values(["i", "j", "seq"])
            rows, cols = (i, j) if layout == "csr" else (j, i)
            assert [got[c].tolist() for c in ("i", "j", "seq")] == [rows.tolist(), cols.tolist(), frame["seq"].tolist()]
            np.testing.assert_array_equal(got["v"].to_numpy(), values)
            back = x.to_compressed()
            assert sum(packed) < 8 * n
            for one, other in zip(back, (values, j, offsets)):
                np.testing.assert_array_equal(one, other)
