import gzip

import numpy as np
import pytest

from axisframe.elements import Sparse
from axisframe.sources import mtx, optional


def put(path, text, packed=False):
    path.write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    return str(path)


def entries(x):
    return sorted((r.i, r.j, r.v) for r in x.df.collect())


@pytest.mark.parametrize("packed,name", [(False, "a.mtx"), (True, "a.mtx.gz"), (True, "packed")])
def test_general_files_plain_and_packed(spark, tmp_path, packed, name):
    text = "%%MatrixMarket matrix coordinate integer general\n% note\n\n4 3 4\n1 1 5\n4 3 4\n4 3 4\n2 2 -7\n"
    x = mtx.read_mtx(spark, put(tmp_path / name, text, packed))
    assert x.shape == (4, 3) and x.dtype == "i64" and entries(x) == [(0, 0, 5), (1, 1, -7), (3, 2, 4), (3, 2, 4)]


def test_entry_equal_to_the_size_line(spark, tmp_path):
    x = mtx.read_mtx(spark, put(tmp_path / "a", "%%MatrixMarket matrix coordinate integer general\n3 3 3\n3 3 3\n3 3 3\n1 1 1\n"))
    assert entries(x) == [(0, 0, 1), (2, 2, 3), (2, 2, 3)]


def test_symmetry_and_patterns(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate real {}\n3 3 2\n2 1 1.5\n3 3 2\n"
    assert entries(mtx.read_mtx(spark, put(tmp_path / "s", head.format("symmetric")))) == [(0, 1, 1.5), (1, 0, 1.5), (2, 2, 2.0)]
    assert entries(mtx.read_mtx(spark, put(tmp_path / "k", head.format("skew-symmetric")))) == [(0, 1, -1.5), (1, 0, 1.5), (2, 2, 2.0)]
    assert entries(mtx.read_mtx(spark, put(tmp_path / "p", "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1\n"))) == [(1, 0, 1)]


@pytest.mark.parametrize("text", ["", "nothing", "%%MatrixMarket matrix array real general\n1 1\n1\n", "%%MatrixMarket matrix coordinate complex general\n1 1 0\n", "%%MatrixMarket matrix coordinate real general\n% only comments\n", "%%MatrixMarket matrix coordinate real hermitian\n1 1 0\n"])
def test_other_files_are_errors(spark, tmp_path, text):
    with pytest.raises(mtx.FormatError):
        mtx.read_mtx(spark, put(tmp_path / "bad", text))


def test_tables_and_round_trip(spark, tmp_path):
    m = put(tmp_path / "m", "%%MatrixMarket matrix coordinate real general\n2 3 1\n2 3 1.25\n")
    t = mtx.read_mtx_table(spark, m, put(tmp_path / "o", "a\tx\nb\n"), put(tmp_path / "v", "g1\tq\tz\ng2\ng3\n"))
    assert t.obs_names == ["a", "b"] and t.var_names == ["g1", "g2", "g3"] and t.X.to_numpy()[1, 2] == 1.25
    x = Sparse.from_numpy(spark, np.array([[0.0, 1.5], [2.0, 0.0], [0.0, 0.0]]))
    mtx.write_mtx(x, str(tmp_path / "out"))
    assert (tmp_path / "out").read_text().splitlines()[1:] == ["3 2 2", "1 2 1.5", "2 1 2.0"]
    mtx.write_mtx(x, str(tmp_path / "parts"), single=False)
    for name in ("out", "parts"):
        back = mtx.read_mtx(spark, str(tmp_path / name))
        assert back.shape == (3, 2) and entries(back) == entries(x)


def test_repeated_coordinates_keep_the_order_of_the_file(spark, tmp_path):
    lines = [f"{1 + k % 3} 1 {v}" for k, v in enumerate([9, 5, 5, 2, 7, 1, 4, 0, 6])]
    text = "%%MatrixMarket matrix coordinate integer general\n" + "% a long comment\n" * 3000 + "3 1 9\n" + "\n".join(lines) + "\n"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        x = mtx.read_mtx(spark, put(tmp_path / "m", text))
        got = {i: [r.v for r in x.df.where(f"i = {i}").orderBy("seq").collect()] for i in range(3)}
        names = mtx.read_names(spark, put(tmp_path / "n", "".join(f"name{k}\tx\n" for k in range(4000))))
        assert names.labels() == [f"name{k}" for k in range(4000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {0: [9, 2, 4], 1: [5, 7, 0], 2: [5, 1, 6]}


class Group(dict):
    def __init__(self, attrs, value=None, **items):
        super().__init__(items)
        self.attrs, self.value = attrs, value

    def __getitem__(self, key):
        return self.value if key is ... or key == () else super().__getitem__(key)


def test_encodings_of_optional_formats():
    assert optional.format_of("a.h5ad") == "hdf5" and optional.format_of("a.zarr/") == "zarr" and optional.format_of("a") == "parquet"
    with pytest.raises(ValueError):
        optional.format_of("a", "other")
    raw = lambda x: Group({}, np.array(x))
    csr = Group({"encoding-type": "csr_matrix", "shape": [2, 3]}, data=raw([1, 2, 3]), indices=raw([0, 0, 2]), indptr=raw([0, 2, 3]))
    i, j, v, shape = optional.decode(csr)
    assert i.tolist() == [0, 0, 1] and j.tolist() == [0, 0, 2] and v.tolist() == [1, 2, 3] and shape == (2, 3)
    cat = Group({"encoding-type": "categorical"}, categories=raw(["x", "y"]), codes=raw([1, -1, 0]))
    assert optional.decode(cat).tolist() == ["y", None, "x"]
    table = Group({"encoding-type": "dataframe", "column-order": ["c"]}, c=cat)
    assert optional.decode(Group({"encoding-type": "dict"}, t=table))["t"]["c"].tolist() == ["y", None, "x"]
    with pytest.raises(ValueError):
        optional.sparse_entries([1], [5], [0, 1], (1, 3), "csr")
    if not optional.importlib.util.find_spec("h5py"):
        with pytest.raises(optional.MissingLibrary):
            optional.read_file("a.h5ad")
