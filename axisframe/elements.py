"""What lies along axes: sparse and dense arrays and tables, as lazy DataFrames with explicit ordinals.

Sparse: (i, j, seq, v), one row an entry; seq orders entries of one coordinate, which are kept, never summed.
Dense:  (i, v), v an array (nested for more than two dimensions).
Table:  (ix, columns...).
The shape is part of the element: rows without entries exist.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from axisframe.functions import casts
from axisframe.ordinals import rank_by_position
from axisframe.selection import Places, Range, Selection, parse_all, place_rows, quoted, select_rows
from axisframe.workspace import fresh_path, materialize, remove_table, ship_package

#: Column positions of a dense selection beyond this many go in as one array literal instead of single columns.
_WIDE = 1_000


#: Entries that go from the driver to the executors at once, and of these in one piece; bytes that come to the driver at
#: once, and of an array from which on it lies in a file.
_PART, _PIECE, _IN_FILE = 1 << 20, 1 << 16, 1 << 24


class ShapeError(ValueError):
    """Elements whose shapes do not fit together."""


class _Filed:
    """A local array that grows; beyond ``_IN_FILE`` bytes it lies in a temporary file that is gone when it is let go."""

    def __init__(self, empty: np.ndarray):
        """``empty``: the array without values."""
        self.parts: list[np.ndarray] = []
        self.size, self.file, self.dtype, self.empty = 0, None, None, empty

    def append(self, part: np.ndarray) -> None:
        if not len(part):
            return
        if self.dtype is not None and part.dtype != self.dtype and self.file is not None:
            # A part with nulls is held in another type than those before it.
            self.parts, self.file, self.size = [self._mapped()], None, 0
        self.parts.append(part)
        self.dtype = np.result_type(*{p.dtype for p in self.parts}) if self.file is None else self.dtype
        self.size += part.nbytes
        if (self.file or self.size > _IN_FILE) and self.dtype != object:
            self.file = self.file or tempfile.TemporaryFile()
            for p in self.parts:
                p.astype(self.dtype, copy=False).tofile(self.file)
            self.parts, self.size = [], 0

    def _mapped(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r+")

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else self.empty
        for p in self.parts:
            p.astype(self.dtype, copy=False).tofile(self.file)
        self.parts = []
        return self._mapped()


def _majors(offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """The rows (of csc the columns) of the entries a..b."""
    first, last = np.searchsorted(offsets, [a, b - 1], side="right") - 1
    return np.repeat(np.arange(first, last + 1), np.diff(np.clip(offsets[first : last + 2], a, b)))


def _before(indices, offsets, a: int) -> int:
    """How many entries of the coordinate of entry a lie before it."""
    start = int(offsets[np.searchsorted(offsets, a, side="right") - 1])
    return a - start - int(np.searchsorted(indices[start:a], indices[a]))


def _entries(spark: SparkSession, data, indices, offsets, a: int, b: int, layout: str, schema: str) -> DataFrame:
    """The entries a..b of compressed rows or columns; those of one coordinate follow one another.  More numbers than a piece
    holds go out as compressed pieces, which become rows on the executors: as rows they would fill the driver's heap."""
    if b - a > _PIECE and data.dtype.kind in "fiub":
        cuts = [*range(a, b, _PIECE), b]
        pieces = [(_before(indices, offsets, k), _pack(_majors(offsets, k, m), indices[k:m], data[k:m])) for k, m in zip(cuts, cuts[1:])]
        return _unpacked(spark, pieces, layout, schema)
    major, minor = _majors(offsets, a, b) if b > a else np.zeros(0, np.int64), np.asarray(indices[a:b]).astype("int64")
    seq = _seq(major, minor, _before(indices, offsets, a) if b > a else 0)
    rows, cols = (major, minor) if layout == "csr" else (minor, major)
    values = np.asarray(data[a:b])
    if values.dtype.kind not in "fiub":
        return spark.createDataFrame(pd.DataFrame({"i": rows, "j": cols, "seq": seq, "v": values}), schema)
    held = to_arrow_schema(T._parse_datatype_string(schema))
    return spark.createDataFrame(pa.table([pa.array(c).cast(f.type) for c, f in zip((rows, cols, seq, values), held)], schema=held), schema)


def _seq(major: np.ndarray, minor: np.ndarray, before: int) -> np.ndarray:
    """The place of each entry in its coordinate; ``before`` entries of the first one lie in earlier parts."""
    new = np.flatnonzero(np.r_[True, (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])][: len(major)])
    held = np.diff(np.r_[new, len(major)])
    seq = np.arange(len(major)) - np.repeat(new, held)
    seq[: held[0] if len(held) else 0] += before
    return seq


def _pack(major, minor, values) -> bytes:
    """Entries as compressed bytes."""
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.asarray(c)) for c in (major, minor, values)], names=["major", "minor", "v"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(spark: SparkSession, pieces: Sequence[tuple[int, bytes]], layout: str, schema: str) -> DataFrame:
    """The entries of packed pieces, each with the number of entries of its first coordinate that lie before it."""
    ship_package(spark)
    held = to_arrow_schema(T._parse_datatype_string(schema))

    def unpacked(batches):
        for batch in batches:
            for before, piece in zip(batch["before"].to_pylist(), batch["piece"]):
                t = pa.ipc.open_stream(piece.as_buffer()).read_all()
                major, minor = t["major"].to_numpy(), t["minor"].to_numpy()
                rows, cols = (major, minor) if layout == "csr" else (minor, major)
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip((rows, cols, _seq(major, minor, before), t["v"].to_numpy()), held)], schema=held)

    numbers, parts = zip(*pieces)
    sent = pa.table({"before": pa.array(numbers, pa.int64()), "piece": pa.array(parts, pa.binary())})
    return spark.createDataFrame(sent, "before long, piece binary").mapInArrow(unpacked, schema)


@dataclass(frozen=True)
class Sparse:
    """A sparse matrix in long form; ``layout`` (csr or csc) says how it is sorted when stored."""

    df: DataFrame
    shape: tuple[int, int]
    layout: str = "csr"
    dtype: str = ""
    kind = "sparse"

    def __post_init__(self):
        if not self.dtype:
            object.__setattr__(self, "dtype", casts.dtype_of(self.df.schema["v"].dataType.simpleString()))

    @classmethod
    def of(cls, df: DataFrame, shape: tuple[int, int], i: str = "i", j: str = "j", v: str = "v", order: Sequence[str] = (), layout: str = "csr") -> Sparse:
        """From entries in any order; ``order`` sorts entries of one coordinate.  Without it they must be unique."""
        seq = F.row_number().over(Window.partitionBy("i", "j").orderBy(*order)) - 1 if order else F.lit(0)
        rows = df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), F.col(v).alias("v"), *[F.col(c) for c in order if c not in ("i", "j", "v")])
        return cls(rows.withColumn("seq", seq.cast("long")).select("i", "j", "seq", "v"), shape, layout)

    @classmethod
    def from_row_lists(cls, df: DataFrame, n_cols: int, n_rows: int, i: str = "i", entries: str = "entries") -> Sparse:
        """From rows of (i, array of (column, value)); repeated columns of a row are kept in order."""
        flat = df.select(F.col(i).cast("long").alias("i"), F.posexplode(entries).alias("p", "e"))
        names = df.schema[entries].dataType.elementType.names
        rows = flat.select("i", F.col(f"e.{names[0]}").cast("long").alias("j"), "p", F.col(f"e.{names[1]}").alias("v"))
        return cls.of(rows, (n_rows, n_cols), order=["p"])

    @classmethod
    def from_compressed(cls, spark: SparkSession, data, indices, offsets, shape: tuple[int, int], layout: str = "csr") -> Sparse:
        """From compressed rows or columns.  Offsets must rise from 0 to the number of entries and indices must not fall
        within a row; equal ones are repeated coordinates."""
        data, indices, offsets = np.asarray(data), np.asarray(indices), np.asarray(offsets)
        major_n, minor_n = shape if layout == "csr" else shape[::-1]
        if len(offsets) != major_n + 1 or offsets[0] != 0 or offsets[-1] != len(data) or (offsets[1:] < offsets[:-1]).any() or len(indices) != len(data):
            raise ShapeError("offsets do not fit the shape and the entries")
        kind = numpy_dtype(data.dtype)
        schema = f"i long, j long, seq long, v {casts.HELD_AS[kind]}"
        if len(indices) and (indices.min() < 0 or indices.max() >= minor_n):
            raise ShapeError("an index lies outside the shape")
        for a in range(0, len(data), _PART):
            last, part = max(a - 1, 0), min(a + _PART, len(data))
            if ((np.diff(indices[last:part]) < 0) & (np.diff(_majors(offsets, last, part)) == 0)).any():
                raise ShapeError("indices fall within a row")
        if len(data) <= _PART:
            return cls(_entries(spark, data, indices, offsets, 0, len(data), layout, schema), shape, layout, kind)
        # A part at a time goes through the driver's memory, into a table of the shared folder.
        path = fresh_path(spark, "compressed")
        for a in range(0, len(data), _PART):
            _entries(spark, data, indices, offsets, a, min(a + _PART, len(data)), layout, schema).write.option("compression", "zstd").mode("append").parquet(path)
        return cls(spark.read.schema(schema).parquet(path), shape, layout, kind)

    @classmethod
    def from_numpy(cls, spark: SparkSession, array, layout: str = "csr") -> Sparse:
        """From a dense numpy array or anything with ``tocoo`` (its repeated coordinates are kept)."""
        if hasattr(array, "tocoo"):
            coo = array.tocoo()
            rows, cols, values, shape = coo.row, coo.col, coo.data, coo.shape
        else:
            array = np.asarray(array)
            rows, cols = np.nonzero(array)
            values, shape = array[rows, cols], array.shape
        frame = pd.DataFrame({"i": rows.astype("int64"), "j": cols.astype("int64"), "v": values})
        frame["seq"] = frame.groupby(["i", "j"]).cumcount().astype("int64")
        kind = casts.HELD_AS[numpy_dtype(values.dtype)]
        return cls(spark.createDataFrame(frame[["i", "j", "seq", "v"]], f"i long, j long, seq long, v {kind}"), tuple(map(int, shape)), layout, numpy_dtype(values.dtype))

    def select(self, *selections: Selection) -> Sparse:
        """Rows and columns, each in its order with its repeats."""
        rows, cols = selections
        df = select_rows(self.df, rows, self.shape[0], "i")
        df = select_rows(df, cols, self.shape[1], "j")
        return replace(self, df=df, shape=(len(rows), len(cols)))

    def __getitem__(self, what) -> Sparse:
        return self.select(*parse_all(what, self.shape))

    def lookup(self, points: DataFrame) -> DataFrame:
        """Points (i, j, more...) with ``v``, their last entry, or the type's zero where they have none."""
        last = self.df.groupBy("i", "j").agg(F.max_by("v", "seq").alias("v"))
        zero = F.lit(casts.ZERO[self.dtype]).cast(casts.HELD_AS[self.dtype])
        return points.join(last, ["i", "j"], "left").withColumn("v", F.coalesce("v", zero))

    def cast(self, to: str) -> Sparse:
        return replace(self, df=self.df.withColumn("v", casts.convert(F.col("v"), self.dtype, to, casts.SPARSE)), dtype=to)

    def with_layout(self, layout: str) -> Sparse:
        return replace(self, layout=layout)

    def repeated(self) -> DataFrame:
        """(i, j, n) of coordinates with several entries."""
        return self.df.groupBy("i", "j").agg(F.count("*").alias("n")).where("n > 1")

    def is_canonical(self) -> bool:
        return self.repeated().isEmpty()

    def problems(self) -> DataFrame:
        """Entries that lie outside the shape or have no coordinate."""
        return self.df.where(F.coalesce((F.col("i") < 0) | (F.col("i") >= self.shape[0]) | (F.col("j") < 0) | (F.col("j") >= self.shape[1]), F.lit(True)))

    def transpose(self) -> Sparse:
        df = self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "seq", "v")
        return replace(self, df=df, shape=self.shape[::-1], layout={"csr": "csc", "csc": "csr"}[self.layout])

    def remap_columns(self, mapping: DataFrame, n_cols: int) -> Sparse:
        """Columns renumbered by (old, new); entries of columns without one vanish."""
        df = self.df.join(mapping, F.col("j") == F.col("old")).select("i", F.col("new").alias("j"), "seq", "v")
        return replace(self, df=df, shape=(self.shape[0], n_cols))

    def shift_rows(self, offset: int) -> DataFrame:
        return self.df.withColumn("i", F.col("i") + offset) if offset else self.df

    def to_dense(self) -> Dense:
        """Every row, with zeros where there is no entry; of repeated coordinates the last counts.  For narrow matrices."""
        zero = F.lit(casts.ZERO[self.dtype]).cast(casts.HELD_AS[self.dtype])
        last = self.df.groupBy("i", "j").agg(F.max_by("v", "seq").alias("v"))
        rows = last.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
        every = self.df.sparkSession.range(self.shape[0]).select(F.col("id").alias("i")).join(rows, "i", "left")
        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.shape[1] - 1).cast("long")), lambda j: F.coalesce(F.try_element_at("m", j), zero)) if self.shape[1] else F.array().cast(f"array<{casts.HELD_AS[self.dtype]}>")
        return Dense(every.select("i", cells.alias("v")), self.shape, self.dtype)

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*(("i", "j", "seq") if self.layout == "csr" else ("j", "i", "seq")))

    def to_compressed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(data, indices, offsets) of compressed rows, or columns for csc; repeated coordinates stay, in order.  Sorted and
        packed on the executors and fetched in parts; data and indices of many entries lie in temporary files."""
        major, minor = ("i", "j") if self.layout == "csr" else ("j", "i")
        n = self.shape[0 if self.layout == "csr" else 1]

        def packed(batches):
            task = TaskContext.get().partitionId()
            for k, batch in enumerate(batches):
                part = _pack(*batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([k]), pa.array([len(part)]), pa.array([part], pa.binary())], names=["task", "k", "n", "part"])

        ship_package(self.df.sparkSession)
        # Written before it is sorted, as sorting reads its input twice.
        rows = materialize(self.df.select(major, minor, "seq", "v"), "entries")
        ordered = rows.orderBy(F.asc_nulls_last(major), F.asc_nulls_last(minor), F.asc_nulls_last("seq")).drop("seq")
        parts = materialize(ordered.mapInArrow(packed, "task long, k long, n long, part binary"), "packed")
        remove_table(rows)
        none = to_arrow_schema(self.df.select("v").schema).empty_table()["v"].to_numpy()
        data, indices, offsets = _Filed(none), _Filed(np.zeros(0, np.int64)), np.zeros(n + 1, np.int64)
        sizes = parts.groupBy("task").agg(F.sum("n").alias("n")).orderBy("task").collect()
        group = np.cumsum([r.n for r in sizes]) // _IN_FILE
        for g in np.unique(group):
            tasks = [r.task for r, h in zip(sizes, group) if h == g]
            fetched = parts.where(F.col("task").between(tasks[0], tasks[-1])).drop("n").toArrow()
            for at in np.lexsort([fetched["k"].to_numpy(), fetched["task"].to_numpy()]):
                t = pa.ipc.open_stream(fetched["part"][int(at)].as_buffer()).read_all()
                row, held = np.unique(t["major"].drop_null().to_numpy(), return_counts=True)
                # As in a search of the sorted entries: what lies before the first row counts there, what lies behind the last nowhere.
                np.add.at(offsets, np.maximum(row[row < n] + 1, 0), held[row < n])
                data.append(t["v"].to_numpy())
                indices.append(t["minor"].to_numpy())
        remove_table(parts)
        return data.array(), indices.array(), np.cumsum(offsets, out=offsets)

    def to_numpy(self) -> np.ndarray:
        """A dense numpy array; of repeated coordinates the last counts."""
        frame = self.df.toPandas().sort_values(["i", "j", "seq"])
        out = np.zeros(self.shape, frame["v"].to_numpy().dtype if len(frame) else float)
        out[frame["i"], frame["j"]] = frame["v"]
        return out


@dataclass(frozen=True)
class Dense:
    """A dense array of two or more dimensions: one row of the frame for each position of the first axis."""

    df: DataFrame
    shape: tuple[int, ...]
    dtype: str = ""
    kind = "dense"

    def __post_init__(self):
        if len(self.shape) < 2:
            raise ShapeError("an array along an axis has two dimensions or more")
        if not self.dtype:
            object.__setattr__(self, "dtype", casts.dtype_of(element_type(self.df.schema["v"].dataType)))

    @classmethod
    def of(cls, df: DataFrame, shape: tuple[int, ...], i: str = "i", v: str = "v") -> Dense:
        return cls(df.select(F.col(i).cast("long").alias("i"), F.col(v).alias("v")), shape)

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray) -> Dense:
        array = np.asarray(array)
        kind = casts.HELD_AS[numpy_dtype(array.dtype)]
        for _ in array.shape[1:]:
            kind = f"array<{kind}>"
        values = array.astype(object).tolist() if array.dtype.kind in "US" else array.tolist()
        return cls(spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}"), array.shape, numpy_dtype(array.dtype))

    def select(self, *selections: Selection) -> Dense:
        """An orthogonal gather over all dimensions."""
        rows, rest = selections[0], selections[1:]
        value = _gather(F.col("v"), rest, self.shape[1:])
        df = select_rows(self.df, rows, self.shape[0], "i")
        if value is not None:
            df = df.withColumn("v", value)
        return replace(self, df=df, shape=tuple(map(len, selections)))

    def __getitem__(self, what) -> Dense:
        return self.select(*parse_all(what, self.shape))

    def at(self, *place: int):
        """The value at one place."""
        value = reduce(lambda c, k: F.get(c, F.lit(k)), place[1:], F.col("v"))
        row = self.df.where(F.col("i") == place[0]).select(value.alias("x")).first()
        if row is None or any(not 0 <= k < n for k, n in zip(place, self.shape)):
            raise IndexError(place)
        return row.x

    def cast(self, to: str) -> Dense:
        def inner(c: Column, depth: int) -> Column:
            return casts.convert(c, self.dtype, to) if not depth else F.transform(c, lambda x: inner(x, depth - 1))

        return replace(self, df=self.df.withColumn("v", inner(F.col("v"), len(self.shape) - 1)), dtype=to)

    def reshape(self, *shape: int) -> Dense:
        """The same cells, row-major, in other dimensions behind the first."""
        if int(np.prod(shape)) != int(np.prod(self.shape[1:])) or not shape:
            raise ShapeError(f"{self.shape[1:]} cannot be {shape}")
        value = F.col("v")
        for _ in self.shape[2:]:
            value = F.flatten(value)
        for size in reversed(shape[1:]):
            value = _folded(value, size)
        return replace(self, df=self.df.withColumn("v", value), shape=(self.shape[0], *shape))

    def to_long(self) -> DataFrame:
        """(i, j, v), one row a cell of a matrix."""
        return self.df.select("i", F.posexplode("v").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")

    def to_sparse(self) -> Sparse:
        """Entries of the cells that are not the type's zero."""
        cells = self.to_long().where(~F.col("v").eqNullSafe(F.lit(casts.ZERO[self.dtype]))).withColumn("seq", F.lit(0).cast("long"))
        return Sparse(cells.select("i", "j", "seq", "v"), self.shape, "csr", self.dtype)

    def remap_columns(self, old_of_new: Sequence[int | None]) -> Dense:
        """New columns from old ones; None gives the type's zero."""
        zero = F.lit(casts.ZERO[self.dtype]).cast(casts.HELD_AS[self.dtype])
        at = F.array(*[F.lit(-1 if k is None else int(k)) for k in old_of_new]) if old_of_new else F.array().cast("array<int>")
        value = F.transform(at, lambda k: F.when(k >= 0, F.get("v", k)).otherwise(zero))
        return replace(self, df=self.df.withColumn("v", value), shape=(self.shape[0], len(old_of_new)))

    def shift_rows(self, offset: int) -> DataFrame:
        return self.df.withColumn("i", F.col("i") + offset) if offset else self.df

    def to_arrow(self):
        """(i, v) as an Arrow table, in the order of the rows."""
        return self.df.toArrow().sort_by("i")

    def to_numpy(self) -> np.ndarray:
        frame = self.df.toPandas().sort_values("i")
        out = np.array([_plain(v) for v in frame["v"]], dtype=object if self.dtype == "string" else None)
        return out.reshape(self.shape) if len(frame) else np.zeros(self.shape)


@dataclass(frozen=True)
class Table:
    """A table along an axis: ``ix`` and any columns.  ``categories``: for categorical columns the names in the order
    first seen; the values themselves are plain strings."""

    df: DataFrame
    n: int
    categories: dict[str, list[str]] = field(default_factory=dict)
    kind = "table"

    @property
    def shape(self) -> tuple[int, int]:
        return self.n, len(self.columns)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != "ix"]

    @classmethod
    def from_pandas(cls, spark: SparkSession, frame: pd.DataFrame) -> Table:
        kept = {c: list(map(str, frame[c].cat.categories)) for c in frame.columns if isinstance(frame[c].dtype, pd.CategoricalDtype)}
        plain = frame.reset_index(drop=True).astype({c: object for c in kept})
        for c in plain.columns:
            if plain[c].dtype == object:  # a missing text is null, not a number
                plain[c] = plain[c].where(plain[c].notna(), None)
        plain.insert(0, "ix", np.arange(len(plain)))
        return cls(spark.createDataFrame(plain) if len(plain) else spark.createDataFrame([], "ix long"), len(frame), kept)

    def select(self, rows: Selection, cols: Selection | None = None) -> Table:
        df = select_rows(self.df, rows, self.n, "ix")
        if cols is not None:
            df = df.select("ix", *[quoted(self.columns[k]) for k in cols.positions()])
        return replace(self, df=df, n=len(rows))

    def __getitem__(self, what):
        if isinstance(what, str):
            return self.df.select("ix", quoted(what))
        return self.select(*parse_all(what, self.shape))

    def __contains__(self, column: str) -> bool:
        return column in self.columns

    def with_column(self, name: str, values) -> Table:
        """Set a column: a Column expression, a frame (ix, value), or as many local values as there are rows."""
        if isinstance(values, Column):
            return replace(self, df=self.df.withColumn(name, values))
        if isinstance(values, DataFrame):
            value = next(c for c in values.columns if c != "ix")
            return replace(self, df=self.df.drop(name).join(values.select("ix", F.col(quoted(value)).alias(name)), "ix", "left"))
        values = list(values)
        if len(values) != self.n:
            raise ShapeError(f"{len(values)} values for {self.n} rows")
        local = self.df.sparkSession.createDataFrame(pd.DataFrame({"ix": np.arange(self.n), name: values}))
        return replace(self, df=self.df.drop(name).join(local, "ix", "left"))

    def categorical(self, column: str) -> tuple[DataFrame, DataFrame]:
        """(ix, code) and (code, category): codes number the distinct values in the order first seen; null has code -1."""
        value = F.col(quoted(column)).cast("string")
        first = self.df.where(value.isNotNull()).groupBy(value.alias("category")).agg(F.min("ix").alias("first"))
        names = rank_by_position(first, "first", out="code").select(F.col("code").cast("int").alias("code"), "category")
        codes = self.df.select("ix", value.alias("category")).join(names, "category", "left")
        return codes.select("ix", F.coalesce("code", F.lit(-1)).alias("code")), names

    def select_codes(self, column: str, rows: Selection) -> tuple[DataFrame, DataFrame]:
        """(ix, code) of selected rows of a categorical column and its (code, category): categories stay those of the
        whole column, whether or not a row still has them."""
        codes, names = self.categorical(column)
        return select_rows(codes, rows, self.n, "ix"), names

    def remap_columns(self, *_):
        raise ShapeError("a table has named columns")

    def shift_rows(self, offset: int) -> DataFrame:
        return self.df.withColumn("ix", F.col("ix") + offset) if offset else self.df

    def to_arrow(self):
        """The columns as an Arrow table, in the order of the rows; other libraries take it without a copy."""
        return self.df.toArrow().sort_by("ix").drop_columns(["ix"])

    @classmethod
    def from_arrow(cls, spark: SparkSession, table) -> Table:
        """From an Arrow table, or anything that converts itself to one (``to_arrow``)."""
        import pyarrow as pa

        table = table.to_arrow() if hasattr(table, "to_arrow") and not isinstance(table, pa.Table) else table
        names = table.column_names
        plain = pa.table([pa.array(np.arange(len(table))), *[c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in table.columns]], names=["ix", *names])
        kept = {n: c.combine_chunks().unify_dictionaries().dictionary.to_pylist() if hasattr(c.combine_chunks(), "unify_dictionaries") else list(dict.fromkeys(x for x in c.to_pylist() if x is not None)) for n, c in zip(names, table.columns) if pa.types.is_dictionary(c.type)}
        return cls(spark.createDataFrame(plain), len(table), kept)

    def to_pandas(self) -> pd.DataFrame:
        out = self.df.toPandas().sort_values("ix").drop(columns="ix").reset_index(drop=True)
        for c, names in self.categories.items():
            if c in out:
                out[c] = pd.Categorical(out[c], categories=names)
        return out


Element = Sparse | Dense | Table


def _folded(value: Column, size: int) -> Column:
    """An array as an array of arrays of ``size``."""
    parts = F.when(F.size(value) > 0, F.sequence(F.lit(0), F.size(value).cast("int") - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(parts, lambda k: F.slice(value, k + 1, size))


def element_type(kind: T.DataType) -> str:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind.simpleString()


def numpy_dtype(dtype: np.dtype) -> str:
    """Declared type of a numpy dtype."""
    kind = np.dtype(dtype)
    if kind.kind == "b":
        return "bool"
    if kind.kind in "iuf" and kind.itemsize <= 8 and not (kind.kind == "f" and kind.itemsize < 4):
        return f"{kind.kind}{kind.itemsize * 8}"
    if kind.kind in "OUST":
        return "string"
    raise casts.CastError(f"no element type for {kind}")


def _plain(value):
    return [_plain(x) for x in value] if isinstance(value, (list, np.ndarray)) else value


def _gather(value: Column, selections: Sequence[Selection], shape: Sequence[int]) -> Column | None:
    """The selected cells of a nested array; None if all is selected."""
    if all(s.is_full(n) for s, n in zip(selections, shape)):
        return None
    first, rest = selections[0], selections[1:]
    if first.is_full(shape[0]):
        picked = value
    elif isinstance(first, Range) and first.step == 1:
        picked = F.slice(value, first.start + 1, len(first))
    elif isinstance(first, Range):
        last = first.positions()[-1] if len(first) else 0
        start = first.start if first.step > 0 else first.stop - 1
        places = F.sequence(F.lit(int(start)), F.lit(int(last)), F.lit(first.step)) if len(first) else F.array().cast("array<int>")
        picked = F.transform(places, lambda k: F.get(value, k))
    else:
        at = first.positions().tolist()
        places = F.array(*[F.lit(k) for k in at]) if 0 < len(at) <= _WIDE else F.from_json(F.lit(str(at)), "array<int>")
        picked = F.transform(places, lambda k: F.get(value, k))
    inner = rest and not all(s.is_full(n) for s, n in zip(rest, shape[1:]))
    return F.transform(picked, lambda x: _gather(x, rest, shape[1:])) if inner else picked


def select_square(element: Sparse | Dense, selection: Selection) -> Sparse | Dense:
    """A pairwise element: the same selection on both axes."""
    return element.select(selection, selection, *[Range(0, n) for n in element.shape[2:]])


def vstack(elements: Sequence[Element]) -> Element:
    """Elements one below the other; a literal offset for each, so nothing is shuffled."""
    first = elements[0]
    if len({e.kind for e in elements}) > 1:
        if any(e.kind == "table" for e in elements):
            raise ShapeError("tables and arrays cannot be stacked")
        elements = [e.to_sparse() if e.kind == "dense" else e for e in elements]
        first = elements[0]
    offset, parts = 0, []
    if first.kind == "table":
        for e in elements:
            parts.append(e.shift_rows(offset))
            offset += e.n
        return Table(reduce(DataFrame.unionByName, parts), offset, first.categories)
    for e in elements:
        if e.shape[1:] != first.shape[1:] or e.dtype != first.dtype:
            raise ShapeError(f"cannot stack {e.shape} {e.dtype} below {first.shape} {first.dtype}")
        parts.append(e.shift_rows(offset))
        offset += e.shape[0]
    return replace(first, df=reduce(DataFrame.unionByName, parts), shape=(offset, *first.shape[1:]))


def split_by_child(selection: Selection, lengths: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each child the local positions that a list of positions over the stack asks of it, and where each goes."""
    at, ends = selection.positions(), np.cumsum([0, *lengths])
    child = np.searchsorted(ends, at, side="right") - 1
    return [(at[child == k] - ends[k], np.flatnonzero(child == k)) for k in range(len(lengths))]


def range_of_child(selection: Range, offset: int, n: int) -> tuple[Range, int]:
    """What a range over the stack asks of the child at ``offset``, as a range of its own positions, and where its first
    row goes: the phase of a step is kept from child to child, without any list of positions."""
    step = abs(selection.step)
    low, high = max(selection.start, offset), min(selection.stop, offset + n)
    if selection.step > 0:
        k = max(0, -(-(low - selection.start) // step))
        local = Range(selection.start + k * step - offset, high - offset, step)
    else:
        k = max(0, -(-(selection.stop - high) // step))
        local = Range(low - offset, selection.stop - k * step - offset, -step)
    return (local, k) if local.stop > local.start else (Range(0, 0), k)


def stack_select(elements: Sequence[Element], selection: Selection, *others: Selection) -> Element:
    """Rows of a stack, resolved to each child's own ordinals before any offset, so that its scan gets the filter."""
    lengths = [e.shape[0] for e in elements]
    rest = list(others) or [Range(0, n) for n in elements[0].shape[1:]]
    ordinal, parts, offset = ("ix" if elements[0].kind == "table" else "i"), [], 0
    shape = (len(selection), *map(len, rest))
    across = lambda e: e if e.kind == "table" else e.select(Range(0, e.shape[0]), *rest)
    split = None if isinstance(selection, (Range, Places)) else split_by_child(selection, lengths)
    for k, (e, n) in enumerate(zip(elements, lengths)):
        if isinstance(selection, Range):
            local, first = range_of_child(selection, offset, n)
            if len(local):
                parts.append((e.select(local) if e.kind == "table" else e.select(local, *rest)).shift_rows(first))
        elif isinstance(selection, Places):
            own = selection.df.where((F.col("old") >= offset) & (F.col("old") < offset + n)).select((F.col("old") - offset).alias("old"), "new")
            parts.append(select_rows(across(e).df, Places(own, len(selection)), n, ordinal))
        elif len(split[k][0]):
            parts.append(place_rows(across(e).df, *split[k], ordinal))
        offset += n
    df = reduce(DataFrame.unionByName, parts) if parts else elements[0].df.where(F.lit(False))
    return Table(df, len(selection), elements[0].categories) if ordinal == "ix" else replace(elements[0], df=df, shape=shape)
