import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axisframe import store
from axisframe.axis_index import ListIndex, RangeIndex
from axisframe.elements import Dense, ShapeError, Sparse, Table, stack_select
from axisframe.model import AxisTable
from axisframe.operators import concat, dataset, split
from axisframe.operators.chunks import Chunks
from axisframe.selection import FULL, Index, Names, Places, Range, compose, parse, points_frame


@pytest.fixture(scope="module")
def full(spark):
    rng = np.random.default_rng(2)
    local = {
        "X": (rng.random((13, 7)) < 0.5) * 1.0 * rng.integers(1, 9, (13, 7)), "layer": rng.random((13, 7)), "obsm": rng.random((13, 3)),
        "obsp": (rng.random((13, 13)) < 0.3) * 2.0, "varm": rng.random((7, 2)), "varp": rng.random((7, 7)),
    }
    obs = pd.DataFrame({"a": range(13), "group": list("ABBACAABBCCAB")}, index=[f"r{k}" for k in range(13)])
    var = pd.DataFrame({"b": range(7)}, index=list("pqrstuv"))
    sparse = lambda k: Sparse.from_numpy(spark, local[k])
    t = AxisTable.build(
        spark, X=sparse("X"), obs=obs, var=var, uns={"n": {"x": 1, "y": 2.5, "z": True, "s": "t"}},
        layers={"l": local["layer"]}, obsm={"m": local["obsm"]}, obsp={"p": sparse("obsp")}, varm={"m": local["varm"]}, varp={"p": local["varp"]},
    )
    return local, t


CASES = [(slice(2, 11, 3), [6, 0, 6]), ([12, 0, 12, 5], slice(None)), (slice(None, None, -2), slice(1, 4))]


@pytest.mark.parametrize("rows,cols", CASES)
def test_subset_keeps_every_slot_aligned(full, rows, cols):
    local, t = full
    got = t.subset(rows, cols).to_memory()
    assert (got["X"] == local["X"][rows][:, cols]).all() and np.allclose(got["layers"]["l"], local["layer"][rows][:, cols])
    assert np.allclose(got["obsm"]["m"], local["obsm"][rows]) and (got["obsp"]["p"] == local["obsp"][rows][:, rows]).all()
    assert np.allclose(got["varm"]["m"], local["varm"][cols]) and np.allclose(got["varp"]["p"], local["varp"][cols][:, cols])
    assert got["obs"]["a"].tolist() == list(np.arange(13)[rows]) and got["var_names"] == list(np.array(list("pqrstuv"))[cols])


def test_names_and_random_chunks(full):
    local, t = full
    assert (t.subset(["r5", "r1"], Names(("q",))).X.to_numpy() == local["X"][[5, 1]][:, [1]]).all()
    with pytest.raises(KeyError):
        t.subset(["r5", "nobody"])
    chunk, at = t.sample_rows(6, seed=3)
    assert (chunk.X.to_numpy() == local["X"][at]).all() and (t.sample_rows(6, seed=3)[1] == at).all()
    with pytest.raises(ValueError):
        t.sample_rows(99, replacement=False)


def test_axis_lengths_are_facts(spark):
    t = AxisTable(spark, X=Sparse.from_numpy(spark, np.zeros((3, 4))))
    assert t.shape == (3, 4)
    with pytest.raises(ShapeError):
        t.set("obsm", Dense.from_numpy(spark, np.zeros((10, 2))), "m")
    with pytest.raises(ShapeError):
        t.with_length(0, 5)
    with pytest.raises(ShapeError):
        t.with_names(0, ["only one"])
    assert AxisTable(spark).with_length(0, 5).shape == (5, 0)
    named = AxisTable(spark).with_names(0, ["a", "b"]).set("obs", pd.DataFrame())
    assert named.obs_names == ["a", "b"] and "AxisTable" in repr(t)
    assert t.delete("X").X is None


def test_snapshots(spark, full, tmp_path):
    local, t = full
    path = str(tmp_path / "s")
    back = store.write(t, path)
    assert back.shape == t.shape and back.obs_names == t.obs_names and back.uns == t.uns
    assert (back.X.to_numpy() == local["X"]).all() and np.allclose(back.varp["p"].to_numpy(), local["varp"])
    with pytest.raises(store.StoreError):
        store.write(t, path)
    part = store.write(back.subset(slice(0, 4)), path, mode="commit")
    assert part.shape == (4, 7) and (store.read(spark, path).X.to_numpy() == local["X"][:4]).all()
    only = store.write(t, str(tmp_path / "p"), slots={"obs", "uns"})
    assert only.X is None and only.obs.columns == ["a", "group"] and only.var_index is None
    store.set_attribute(spark, path, "k", {"x": [1, None]})
    assert store.attributes(spark, path) == {"k": {"x": [1, None]}}
    with pytest.raises(store.StoreError):
        store.read(spark, str(tmp_path / "none"))


def test_handles_modes_and_commits(spark, full, tmp_path):
    local, t = full
    back = t.write(str(tmp_path / "s"))
    assert back.isbacked and back.filename == str(tmp_path / "s") and back.backend == "parquet" and not t.isbacked
    smaller = back.subset(slice(0, 5)).commit()
    assert smaller.shape == (5, 7) and back.reopen().shape == (5, 7)
    with pytest.raises(ValueError):
        back.reopen("r").commit()
    back.persist("X")
    back.close()
    assert back.is_closed
    with pytest.raises(ValueError):
        back.commit()
    with pytest.raises(store.StoreError):
        store.read(spark, str(tmp_path / "s"), "w")


def test_chunks_append_and_roll_back(spark, full, tmp_path):
    local, t = full
    chunks = list(Chunks(t.X, 5))
    assert [(a, b) for _, a, b in chunks] == [(0, 5), (5, 10), (10, 13)] and len(Chunks(t.X, 5)) == 3
    assert list(Chunks(t.X[0:0, :], 5)) == [] and len(Chunks(t.X[0:0, :], 5)) == 0
    assert sum(c.to_numpy().sum(0) for c, _, _ in chunks).tolist() == local["X"].sum(0).tolist()
    stacked = [(a, b) for _, a, b in Chunks([t.X, t.X], 8)]
    assert stacked == [(0, 8), (8, 13), (13, 21), (21, 26)]
    path = str(tmp_path / "s")
    store.create(spark, path)
    assert (store.append_rows(spark, path, (c for c, _, _ in chunks)).X.to_numpy() == local["X"]).all()
    bad = [t.X, t.X[:, 0:2]]
    with pytest.raises(store.StoreError):
        store.append_rows(spark, path, iter(bad))
    assert (store.read(spark, path).X.to_numpy() == local["X"]).all()


def test_split_keeps_row_order_and_drops_nulls(spark, full, tmp_path):
    local, t = full
    keys = ["A", None, "B", "A", None, "A", "B", "B", "A", None, "B", "A", "A"]
    parts = split.split_obs_by(t, keys, str(tmp_path / "out"))
    for key, part in parts.items():
        at = [n for n, k in enumerate(keys) if k == key]
        assert (part.X.to_numpy() == local["X"][at]).all() and part.obs.to_pandas()["a"].tolist() == at
        assert part.obs_names == [f"r{k}" for k in at]
    assert sorted(parts) == ["A", "B"]


def test_outer_and_inner_concat(spark):
    def make(array, names, **columns):
        var = pd.DataFrame(columns, index=names) if columns else None
        t = AxisTable.build(spark, X=Sparse.from_numpy(spark, np.asarray(array)), var=var)
        return t.with_names(1, names).with_names(0, [str(k + 1) for k in range(len(array))])

    a = make([[1, 2, 3], [4, 5, 6], [7, 8, 9]], ["a", "b", "c"], text=["a", "a", "c"], n=[2, 5, 8])
    b = make([[1, 2], [3, 4], [5, 6]], ["b", "d"], f=[2.5, 5.5])
    c = make([[1, 2], [3, 4], [5, 6], [7, 8]], ["e", "f"], text=["3", "3"])
    out = concat.concat([a, b, c], "outer", label="from", keys=["x", "y", "z"])
    want = np.zeros((10, 6), int)
    want[:3, :3], want[3:6, [1, 3]], want[6:, 4:] = a.X.to_numpy(), b.X.to_numpy(), c.X.to_numpy()
    assert out.var_names == list("abcdef") and (out.X.to_numpy() == want).all()
    assert out.obs_names == ["1", "2", "3"] * 2 + ["1", "2", "3", "4"]
    var = out.var.to_pandas()
    assert var["text"].tolist() == ["a", "a", "c", None, "3", "3"] and var["f"].tolist()[1::2][:2] == [2.5, 5.5]
    assert out.obs.to_pandas()["from"].tolist() == ["x"] * 3 + ["y"] * 3 + ["z"] * 4
    inner = concat.concat([a, b], "inner")
    assert inner.var_names == ["b"] and inner.X.to_numpy().ravel().tolist() == [2, 5, 8, 1, 3, 5]
    mixed = concat.concat([a, AxisTable.build(spark, X=np.array([[9, 9]])).with_names(1, ["c", "a"])], "outer")
    assert mixed.X.to_numpy()[3].tolist() == [9, 0, 9]
    none = concat.concat([a, AxisTable(spark).with_length(0, 2).with_names(1, ["a", "b", "c"])], "outer")
    assert none.X.to_numpy()[3:].sum() == 0 and none.shape == (5, 3)


def test_rows_of_repeated_names_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(concat, "ALIGN_PAIRS", 1000, raising=False)
    left = [(k, "all" if k < 200 else "few" if k < 203 else "none" if k < 206 else None) for k in range(208)]
    right = [("all", None if k % 50 == 0 else k / 2) for k in range(100)] + [("few", float(k)) for k in range(900)] + [("other", 1.0), (None, 2.0)]
    labels, prices = spark.createDataFrame(left, "ix long, name string"), spark.createDataFrame(right, "name string, `the price` double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = concat.align(labels, prices, "the price").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(ix, name, v) for ix, name in left for v in [v for n, v in right if n == name and n is not None] or [None]]
    assert sorted(map(repr, [tuple(r)[:3] for r in got])) == sorted(map(repr, want)) and len(want) == 22705
    assert got[0].__fields__ == ["ix", "name", "the price", "task"]
    assert len({r.task for r in got if r.name == "all"}) > 1


def test_datasets(spark, full, tmp_path):
    local, t = full
    children = [("one", t.subset(slice(0, 4))), ("two", t.subset(slice(4, 4))), ("three", t.subset(slice(4, 13)))]
    d = dataset.AxisDataset.of(children)
    assert d.shape == (13, 7) and d.obs_names if hasattr(d, "obs_names") else d.annotation.obs_names == t.obs_names
    assert d.annotation.obs.to_pandas()["sample"].tolist() == ["one"] * 4 + ["three"] * 9
    assert (d.X.to_numpy() == local["X"]).all() and d.annotation.uns == t.uns and d.locate(4) == ("three", 0)
    assert d.child_obs().to_pandas()["a"].tolist() == list(range(13)) and np.allclose(d.child_obsm()["m"].to_numpy(), local["obsm"])
    table = d.to_table(obs=[12, 3, 4, 3], var=slice(1, 3))
    assert (table.X.to_numpy() == local["X"][[12, 3, 4, 3]][:, 1:3]).all()
    with pytest.raises(TypeError):
        d.set("X", t.X)
    with pytest.raises(ShapeError):
        dataset.AxisDataset.of([("a", t), ("b", t.with_names(1, RangeIndex(0, 7)))])
    path = str(tmp_path / "d")
    d.write(path)
    again = dataset.open_dataset(spark, path)
    assert (again.X.to_numpy() == local["X"]).all() and list(again.children) == ["one", "two", "three"]
    (tmp_path / "moved").mkdir()
    (tmp_path / "d" / "children" / "one").rename(tmp_path / "moved" / "one")
    moved = dataset.open_dataset(spark, path, at={"one": str(tmp_path / "moved" / "one")})
    assert (moved.X.to_numpy() == local["X"]).all()
    assert dataset.shared_uns([t, t.set("uns", 1, "n")]) == {}


def test_stacked_tables_have_common_columns(spark):
    a = Table.from_pandas(spark, pd.DataFrame({"x": [1], "y": [2]}))
    b = Table.from_pandas(spark, pd.DataFrame({"y": [3], "z": [4]}))
    assert dataset.stacked_table([a, b]).to_pandas()["y"].tolist() == [2, 3]
    arrays, misfits = dataset.stacked_arrays([{"k": Dense.from_numpy(spark, np.ones((2, 2)))}, {"k": Dense.from_numpy(spark, np.ones((2, 3)))}])
    assert arrays == {} and misfits == ["k"]


def test_list_index_of_names(spark):
    assert [tuple(r) for r in ListIndex(("b", "a")).frame(spark).collect()] == [(0, "b"), (1, "a")]


# -- what must not be lost -----------------------------------------------------------------------------------------


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_split_keeps_the_empty_key(spark, tmp_path):
    x = Sparse.from_numpy(spark, np.arange(1, 17).reshape(4, 4))
    t = AxisTable(spark, X=x, obs=Table.from_pandas(spark, pd.DataFrame({"k": ["", "a/b", "", "c"]}))).with_names(0, ["r0", "r1", "r2", "r3"])
    for where in (None, str(tmp_path / "out")):
        parts = split.split_obs_by(t, "k", where)
        assert sorted(parts) == ["", "a/b", "c"]
        assert parts[""].X.to_numpy().tolist() == [[1, 2, 3, 4], [9, 10, 11, 12]] and parts[""].obs_names == ["r0", "r2"]
        assert parts["a/b"].X.to_numpy().tolist() == [[5, 6, 7, 8]] and parts["a/b"].obs.df.count() == 1
    assert store.read(spark, str(tmp_path / "out" / "%")).X.df.count() == 8


def test_append_grows_what_is_there(spark, tmp_path):
    path = str(tmp_path / "s")
    store.create(spark, path)
    one = Sparse.from_numpy(spark, np.eye(3))
    for n in (1, 2):
        assert store.append_rows(spark, path, iter([one])).shape == (3 * n, 3)
    assert store.read(spark, path).X.to_numpy().tolist() == np.vstack([np.eye(3)] * 2).tolist()
    with pytest.raises(store.StoreError):
        store.append_rows(spark, path, iter([one, Sparse.from_numpy(spark, np.eye(4))]))
    obs = Table.from_pandas(spark, pd.DataFrame({"a b.c": [1, 2, 3], "name": ["x", None, ""]}))
    with pytest.raises(ValueError):
        store.append_rows(spark, path, iter([obs]), "obs")  # six rows on that axis
    t = store.append_rows(spark, path, iter([obs, obs]), "obs")
    assert t.obs.n == 6 and sorted(r.ix for r in t.obs.df.collect()) == list(range(6))
    with pytest.raises(ValueError):
        store.append_rows(spark, path, iter([one]))  # obs has six rows
    assert store.read(spark, path).shape == (6, 3) and store.append_rows(spark, path, iter([])).shape == (6, 3)
    assert store.append_rows(spark, path, iter([one, one]), anew=True).X.df.count() == 6


def test_a_failed_write_leaves_the_manifest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.write(AxisTable(spark, X=Sparse.from_numpy(spark, np.eye(3))), path)
    files = store.Files(spark, path)
    before = files.read(store.MANIFEST)
    seen = []
    delete = store.Files.delete
    monkeypatch.setattr(store.Files, "delete", lambda self, name="": (seen.append((name, self.exists(store.MANIFEST))), delete(self, name))[1])
    files.write(store.MANIFEST, before.replace('"format": 1', '"format": 1 '))
    assert not seen and files.exists(store.MANIFEST)  # replaced by a rename, never deleted first
    store.read(spark, path).commit()
    assert all(there for _, there in seen)

    def broken(self, name, text):
        raise OSError("no space")

    monkeypatch.setattr(store.Files, "write", broken)
    with pytest.raises(OSError):
        store.read(spark, path).commit()
    assert store.read(spark, path).X.to_numpy().tolist() == np.eye(3).tolist()


def test_closed_handles_give_nothing(spark, tmp_path):
    t = store.write(AxisTable(spark, X=Sparse.from_numpy(spark, np.eye(3))), str(tmp_path / "s"))
    t.close()
    t.close()
    for ask in (lambda: t.X, lambda: t[0:1], lambda: t.to_memory(), lambda: t.obsm, lambda: t.commit()):
        with pytest.raises(ValueError):
            ask()
    assert t.is_closed and "closed" in repr(t) and t.reopen().X.df.count() == 3


def test_columns_called_name_or_with_dots(spark):
    one, two = pd.DataFrame({"name": ["u", "v"], "a.b": [1, 2]}), pd.DataFrame({"name": ["w", None], "c`d": [5.0, 6.0]})
    tables = [AxisTable.build(spark, X=np.ones((2, 2)), var=f, obs=f).with_names(1, n) for f, n in ((one, ["g", "h"]), (two, ["h", "i"]))]
    out = concat.concat(tables, "outer", "x.y", ["p", "q"])
    var = out.var.to_pandas()
    assert out.var_names == ["g", "h", "i"] and var["name"].tolist()[:2] == ["u", "w"] and var["a.b"].tolist()[:2] == [1, 2] and var["c`d"].tolist()[1:] == [5.0, 6.0]
    assert out.obs.to_pandas()["x.y"].tolist() == ["p", "p", "q", "q"] and out.obs_names == ["0", "1", "0", "1"]
    picked = out.subset(obs=[3, 0]).obs
    assert picked.select(FULL.resolve(2), Index((picked.columns.index("c`d"),))).to_pandas()["c`d"].tolist()[0] == 6.0
    assert rows_of(picked["a.b"])[1] == (1, 1)


def test_long_selections_stay_frames(spark):
    t = AxisTable.build(spark, X=np.arange(24.0).reshape(6, 4), obs=pd.DataFrame({"k": [1, 5, 2, 7, 9, 0]}))
    t = t.with_names(0, spark.range(6).select(F.col("id").alias("ix"), F.concat(F.lit("n"), F.col("id") % 5).alias("name")))
    assert t.subset(obs=F.col("k") > 4).X.to_numpy()[:, 1].tolist() == [5.0, 13.0, 17.0]
    assert t.subset(obs=F.col("k") > 4).obs_names == ["n1", "n3", "n4"]
    asked = spark.createDataFrame([(0, "n4"), (1, "n0"), (2, "n4")], "new long, name string")
    assert t.subset(obs=asked).X.to_numpy()[:, 0].tolist() == [16.0, 20.0, 16.0]
    assert t.obs_ix(["n0", "n1"]).tolist() == [5, 1] and t[["n3"]].shape == (1, 4)
    with pytest.raises(KeyError):
        t.subset(obs=spark.createDataFrame([(0, "nobody")], "new long, name string"))
    empty = t.subset(obs=F.col("k") > 100)
    assert empty.shape == (0, 4) and empty.X.df.isEmpty()


def test_uns_lists_arrays_and_element_handles(spark, tmp_path):
    uns = {"l": [1, "a", None, [2.5]], "a": np.arange(6).reshape(2, 3), "t": np.array(["x", None], object), "f": np.array([1.5, float("nan")]), "s": "text", "n": np.int64(3)}
    t = store.write(AxisTable.build(spark, X=np.eye(2), uns=uns), str(tmp_path / "s"))
    assert t.uns["l"] == uns["l"] and t.uns["a"].tolist() == uns["a"].tolist() and t.uns["t"].tolist() == ["x", None] and np.isnan(t.uns["f"][1]) and t.uns["n"] == 3
    assert t.element("uns", "s").is_scalar and not t.element("X").is_scalar and t.element("X").shape == (2, 2) and t.element("X").dtype == "f64"
    assert t.element("X").read().tolist() == np.eye(2).tolist() and t.element("X")[0:1].shape == (1, 2)
    assert t.element("obsm", "none").is_none and t.element("obs").is_none
    store.set_attribute(spark, t.path, "made", "by hand", "X")
    store.set_attribute(spark, t.path, "made", 1)
    assert store.attributes(spark, t.path, "X") == {"made": "by hand"} and store.attributes(spark, t.path) == {"made": 1}
    store.set_attribute(spark, t.path, "made", None, "X")
    assert store.attributes(spark, t.path, "X") == {}


def test_memory_keeps_sparse_matrices_sparse(spark):
    x = Sparse(spark.createDataFrame([(0, 1, 0, 5), (0, 1, 1, 6), (2, 0, 0, 7)], "i long, j long, seq long, v long"), (3, 2))
    data, indices, offsets, shape = AxisTable(spark, X=x).to_memory(("X",), "compressed")["X"]
    assert data.tolist() == [5, 6, 7] and indices.tolist() == [1, 1, 0] and offsets.tolist() == [0, 2, 2, 3] and shape == (3, 2)


def test_stepped_ranges_over_stacks_and_their_composition(spark):
    children = [Sparse.from_numpy(spark, np.arange(1, 1 + 2 * n).reshape(n, 2) + 100 * n) for n in (3, 1, 4)]
    whole = np.vstack([c.to_numpy() for c in children])
    for s in [slice(None, None, 2), slice(None, None, -1), slice(6, 1, -3), slice(1, 7, 5), slice(2, 2), slice(7, None, -2), slice(3, 4, 9)]:
        got = stack_select(children, parse(s, 8))
        assert got.to_numpy().tolist() == whole[s].tolist() and got.shape[0] == len(whole[s])
        for t in [slice(None, None, -1), slice(1, None, 2), slice(None, 1, -2)]:
            first = parse(s, 8)
            both = compose(first, parse(t, len(first)))
            assert isinstance(both, Range) and both.positions().tolist() == np.arange(8)[s][t].tolist()


def test_slices_are_written_in_place(spark, tmp_path):
    path = str(tmp_path / "s")
    table = Table.from_pandas(spark, pd.DataFrame({"a.b": [1, 2, 3, 4], "t": ["p", "q", None, "s"]}))
    x = Sparse.from_numpy(spark, np.arange(1, 13).reshape(4, 3))
    store.write(AxisTable(spark, X=x, obs=table, obsm={"m": Dense.from_numpy(spark, np.zeros((4, 2)))}), path)
    new = Table.from_pandas(spark, pd.DataFrame({"t": ["new", "two"], "a.b": [30, 10]}))
    got = store.write_rows(spark, path, "obs", Index((2, 0)), new).obs.to_pandas()
    assert got["a.b"].tolist() == [10, 2, 30, 4] and got["t"].tolist() == ["two", "q", "new", "s"]
    places = Places(spark.createDataFrame([(3, 0), (1, 1)], "old long, new long"), 2)
    t = store.write_rows(spark, path, "X", places, Sparse.from_numpy(spark, np.array([[0, 0, 7], [8, 0, 0]])))
    assert t.X.to_numpy().tolist() == [[1, 2, 3], [8, 0, 0], [7, 8, 9], [0, 0, 7]]
    t = store.write_rows(spark, path, "obsm/m", Range(1, 4, -2), Dense.from_numpy(spark, np.array([[5.0, 5.0], [6.0, 6.0]])))
    assert t.obsm["m"].to_numpy().tolist() == [[0, 0], [6, 6], [0, 0], [5, 5]]
    with pytest.raises(store.StoreError):
        store.write_rows(spark, path, "obsm/m", Range(0, 3), Dense.from_numpy(spark, np.zeros((2, 2))))
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("v_")]) == 1  # what was replaced is gone


def test_points_as_a_frame(spark):
    x = Sparse.from_numpy(spark, np.arange(20).reshape(4, 5))
    for chosen in ([Range(0, 4), Range(4, 5)], [Range(0, 3, -2), Index((4, 0, 4))], [Index((3,)), Range(1, 5, 3)], [Index(()), Range(0, 5)]):
        want = [(int(i), int(j), n, int(i) * 5 + int(j)) for n, (i, j) in enumerate((i, j) for i in chosen[0].positions() for j in chosen[1].positions())]
        got = x.lookup(points_frame(spark, chosen)).select("i", "j", "place", "v")
        assert rows_of(got) == sorted(want)


def test_names_compare_across_forms(spark):
    from axisframe.axis_index import FrameIndex, IntervalIndex, Run, equal

    frame = FrameIndex(spark.range(5).select(F.col("id").alias("ix"), F.col("id").cast("string").alias("name")), 5)
    assert equal(frame, RangeIndex(0, 5)) and equal(RangeIndex(0, 5), frame) and not equal(frame, RangeIndex(1, 6)) and not equal(frame, RangeIndex(0, 4))
    assert equal(ListIndex(("0", "1")), RangeIndex(0, 2)) and not equal(RangeIndex(0, 20_000), RangeIndex(1, 20_001))
    assert equal(frame.select(Range(1, 4)), RangeIndex(1, 4)) and not frame.has_duplicates()
    twice = IntervalIndex((Run("a", 0, 10, 5, 5), Run("a", 5, 10, 5, 5)))
    assert twice.has_duplicates() and not IntervalIndex((Run("a", 0, 10, 5, 5), Run("b", 0, 10, 5, 5))).has_duplicates()
