"""The container: a matrix with everything that describes its two axes, as an immutable handle over lazy frames.

Slots: ``X`` and ``layers`` (both axes), ``obs``/``var`` (tables with names), ``obsm``/``varm`` (first axis),
``obsp``/``varp`` (one axis twice), ``uns`` (free).  Lengths of the axes are facts of their own, set once: an axis
without data can be given any length, one with data only its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.axis_index import AxisIndex, FrameIndex, ListIndex, RangeIndex, places_of, positions_of
from axisframe.elements import Dense, Element, ShapeError, Sparse, Table, select_square
from axisframe.selection import FULL, Index, Names, Places, Range, Selection, parse, quoted

#: slot -> the axes (0 obs, 1 var) that the element's leading dimensions lie on.
AXES = {"X": (0, 1), "layers": (0, 1), "obs": (0,), "var": (1,), "obsm": (0,), "varm": (1,), "obsp": (0, 0), "varp": (1, 1), "uns": ()}
COLLECTIONS = ("layers", "obsm", "varm", "obsp", "varp")
SLOTS = tuple(AXES)
#: What a closed handle does not give any more.
_CONTENT = frozenset((*SLOTS, "obs_index", "var_index"))


@dataclass(frozen=True)
class AxisTable:
    """An annotated matrix.  Methods give new handles; nothing is computed until a slot is collected or written."""

    spark: SparkSession
    n_obs: int | None = None
    n_vars: int | None = None
    X: Sparse | Dense | None = None
    obs: Table | None = None
    var: Table | None = None
    obs_index: AxisIndex | None = None
    var_index: AxisIndex | None = None
    layers: Mapping[str, Element] = field(default_factory=dict)
    obsm: Mapping[str, Element] = field(default_factory=dict)
    varm: Mapping[str, Element] = field(default_factory=dict)
    obsp: Mapping[str, Element] = field(default_factory=dict)
    varp: Mapping[str, Element] = field(default_factory=dict)
    uns: Mapping[str, Any] = field(default_factory=dict)
    path: str | None = None
    mode: str = "r+"
    _open: list[bool] = field(default_factory=lambda: [True], repr=False, compare=False)

    def __post_init__(self):
        lengths: list[int | None] = [self.n_obs, self.n_vars]

        def claim(axis: int, n: int, what: str) -> None:
            if lengths[axis] is None:
                lengths[axis] = n
            elif lengths[axis] != n:
                raise ShapeError(f"{what} has length {n}, its axis {lengths[axis]}")

        for slot, element in self.elements():
            for axis, n in zip(AXES[slot.split("/")[0]], element.shape):
                claim(axis, n, slot)
        for axis, index in ((0, self.obs_index), (1, self.var_index)):
            if index is not None:
                claim(axis, len(index), ("obs", "var")[axis] + " names")
        object.__setattr__(self, "n_obs", lengths[0])
        object.__setattr__(self, "n_vars", lengths[1])

    def __getattribute__(self, name: str):
        if name in _CONTENT and not object.__getattribute__(self, "__dict__").get("_open", (True,))[0]:
            raise ValueError("this handle is closed")
        return object.__getattribute__(self, name)

    # -- shape and names -------------------------------------------------------------------------------------------

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_obs or 0, self.n_vars or 0

    def elements(self):
        """(slot or slot/key, element) of all that lies along an axis."""
        for slot in ("X", "obs", "var"):
            if getattr(self, slot) is not None:
                yield slot, getattr(self, slot)
        for slot in COLLECTIONS:
            for key, element in getattr(self, slot).items():
                yield f"{slot}/{key}", element

    def with_length(self, axis: int, n: int) -> AxisTable:
        """Set an axis length; an error if anything populated on that axis says otherwise."""
        return replace(self, **{("n_obs", "n_vars")[axis]: n})

    def _names(self, axis: int) -> AxisIndex:
        return (self.obs_index, self.var_index)[axis] or RangeIndex(0, self.shape[axis])

    @property
    def obs_names(self) -> list[str]:
        return self._names(0).labels()

    @property
    def var_names(self) -> list[str]:
        return self._names(1).labels()

    def with_names(self, axis: int, names: AxisIndex | list[str] | DataFrame) -> AxisTable:
        """Name an axis: a local list, an index, or a frame (ix, name) with a row for each position."""
        index = ListIndex(tuple(map(str, names))) if isinstance(names, list) else names
        if isinstance(names, DataFrame):
            index = FrameIndex(names.select("ix", "name"), names.count())
        return replace(self, **{("obs_index", "var_index")[axis]: index})

    def obs_ix(self, names) -> np.ndarray:
        return positions_of(self._names(0), names).positions()

    def var_ix(self, names) -> np.ndarray:
        return positions_of(self._names(1), names).positions()

    # -- slots -----------------------------------------------------------------------------------------------------

    def set(self, slot: str, value: Any, key: str | None = None) -> AxisTable:
        """Set a slot or an entry of a collection; None deletes it.  Shapes are checked before anything changes."""
        if slot in COLLECTIONS or slot == "uns":
            if key is None:
                return replace(self, **{slot: dict(value or {})})
            entries = {k: v for k, v in getattr(self, slot).items() if k != key}
            return replace(self, **{slot: entries | ({} if value is None else {key: value})})
        if slot in ("obs", "var"):
            if isinstance(value, pd.DataFrame):
                value = Table.from_pandas(self.spark, value)
            if isinstance(value, Table) and not value.n and not value.columns:
                value = None  # an empty table leaves the names as they are
        return replace(self, **{slot: value})

    def delete(self, slot: str, key: str | None = None) -> AxisTable:
        if key is not None and key not in getattr(self, slot):
            raise KeyError(key)
        return self.set(slot, None, key)

    def keys(self, slot: str) -> list[str]:
        return list(getattr(self, slot))

    # -- subsetting ------------------------------------------------------------------------------------------------

    def _selection(self, what, axis: int) -> Selection:
        if isinstance(what, Column):
            table = (self.obs, self.var)[axis]
            if table is None:
                raise ValueError("a mask by columns needs a table on its axis")
            return Places.of_mask(table.df.where(what))
        if isinstance(what, DataFrame):
            return places_of(self._names(axis), what)
        if isinstance(what, Names):
            what = positions_of(self._names(axis), what.names)
        elif isinstance(what, (list, tuple, np.ndarray, pd.Series)) and len(what) and isinstance(next(iter(what)), str):
            what = positions_of(self._names(axis), list(what))
        return parse(what, self.shape[axis])

    def subset(self, obs=FULL, var=FULL) -> AxisTable:
        """The same rows and columns of every element: positions, slices, masks or names; too long for the driver, a mask
        as a condition on the axis's table and names as a frame (new, name).  Columns of dense elements are cells of an
        array and take local selections only."""
        chosen = self._selection(obs, 0), self._selection(var, 1)

        def pick(slot: str, element: Element) -> Element:
            axes = AXES[slot]
            rest = [Range(0, n) for n in element.shape[len(axes) :]]
            if element.kind == "table":
                return element.select(chosen[axes[0]])
            if axes[0] == axes[-1] and len(axes) == 2:
                return select_square(element, chosen[axes[0]])
            return element.select(*[chosen[a] for a in axes], *rest)

        changes: dict[str, Any] = {s: pick(s, getattr(self, s)) for s in ("X", "obs", "var") if getattr(self, s) is not None}
        changes |= {s: {k: pick(s, e) for k, e in getattr(self, s).items()} for s in COLLECTIONS}
        for axis, name in enumerate(("obs_index", "var_index")):
            index = getattr(self, name)
            changes[name] = None if index is None else index.select(chosen[axis])
        return replace(self, n_obs=len(chosen[0]), n_vars=len(chosen[1]), **changes)

    def __getitem__(self, what) -> AxisTable:
        obs, var = what if isinstance(what, tuple) else (what, FULL)
        return self.subset(obs, var)

    def sample_rows(self, size: int, replacement: bool = True, seed: int = 2022) -> tuple[AxisTable, np.ndarray]:
        """A random chunk of rows, the same for the same seed, and its positions."""
        rng = np.random.default_rng(seed)
        if not replacement and size > self.shape[0]:
            raise ValueError("more rows than there are")
        at = rng.choice(self.shape[0], size, replace=replacement)
        return self.subset(Index(tuple(map(int, at)))), at

    # -- handles ---------------------------------------------------------------------------------------------------

    def persist(self, slot: str, key: str | None = None, on: bool = True) -> None:
        """Keep an element in memory after its first read, or no more."""
        element = getattr(self, slot) if key is None else getattr(self, slot)[key]
        element.df.persist() if on else element.df.unpersist()

    @property
    def filename(self) -> str | None:
        return self.path

    @property
    def backend(self) -> str:
        return "parquet"

    @property
    def isbacked(self) -> bool:
        return self.path is not None

    @property
    def is_closed(self) -> bool:
        return not self._open[0]

    def close(self) -> None:
        """Let go of what is kept in memory; the handle cannot be committed any more."""
        if not self.is_closed:
            for _, element in self.elements():
                element.df.unpersist()
        self._open[0] = False

    def reopen(self, mode: str = "r") -> AxisTable:
        """The store's current state."""
        from axisframe import store

        return store.read(self.spark, self.path, mode)

    def write(self, path: str, slots=SLOTS) -> AxisTable:
        from axisframe import store

        return store.write(self, path, slots)

    def commit(self) -> AxisTable:
        """Make this handle the content of the store it was opened from."""
        from axisframe import store

        if self.path is None or self.mode == "r" or self.is_closed:
            raise ValueError("only an open handle of a store opened with r+ can be committed")
        return store.write(self, self.path, mode="commit")

    def map_elements(self, change: Callable[[str, Element], Element]) -> AxisTable:
        """A handle with every element replaced by ``change(slot, element)``."""
        changes: dict[str, Any] = {s: change(s, getattr(self, s)) for s in ("X", "obs", "var") if getattr(self, s) is not None}
        changes |= {s: {k: change(s, e) for k, e in getattr(self, s).items()} for s in COLLECTIONS}
        return replace(self, **changes)

    def to_memory(self, slots=SLOTS, sparse: str = "dense") -> dict[str, Any]:
        """The given slots as numpy and pandas objects; sparse elements as dense arrays, or with ``sparse="compressed"``
        as (data, indices, offsets, shape), which keeps repeated coordinates and takes the room of the entries only."""
        def local(e):
            if e.kind == "table":
                return e.to_pandas()
            return (*e.to_compressed(), e.shape) if e.kind == "sparse" and sparse == "compressed" else e.to_numpy()

        out: dict[str, Any] = {s: None if getattr(self, s) is None else local(getattr(self, s)) for s in ("X", "obs", "var") if s in slots}
        out |= {s: {k: local(e) for k, e in getattr(self, s).items()} for s in COLLECTIONS if s in slots}
        return out | {"obs_names": self.obs_names, "var_names": self.var_names} | ({"uns": dict(self.uns)} if "uns" in slots else {})

    def element(self, slot: str, key: str | None = None) -> Handle:
        """A lazy handle of one element or uns entry."""
        return Handle(self, slot, key)

    def __repr__(self) -> str:
        if self.is_closed:
            return f"closed AxisTable at {self.path!r}"
        lines = [f"AxisTable with n_obs x n_vars = {self.shape[0]} x {self.shape[1]}" + (f" at {self.path!r}" if self.path else "")]
        for slot in ("obs", "var"):
            if getattr(self, slot) is not None:
                lines.append(f"    {slot}: {', '.join(getattr(self, slot).columns)}")
        lines += [f"    {s}: {', '.join(getattr(self, s))}" for s in (*COLLECTIONS, "uns") if getattr(self, s)]
        return "\n".join(lines)

    @classmethod
    def build(cls, spark: SparkSession, X=None, obs=None, var=None, uns=None, **collections) -> AxisTable:
        """From DataFrames' elements or local numpy and pandas objects."""
        def local(value):
            if isinstance(value, (Sparse, Dense, Table)) or value is None:
                return value
            if isinstance(value, pd.DataFrame):
                return Table.from_pandas(spark, value)
            return Sparse.from_numpy(spark, value) if hasattr(value, "tocoo") else Dense.from_numpy(spark, value)

        names = {}
        for slot, frame in (("obs_index", obs), ("var_index", var)):
            if isinstance(frame, pd.DataFrame) and not isinstance(frame.index, pd.RangeIndex):
                names[slot] = ListIndex(tuple(map(str, frame.index)))
        entries = {s: {k: local(v) for k, v in (collections.get(s) or {}).items()} for s in COLLECTIONS}
        return cls(spark, X=local(X), obs=local(obs), var=local(var), uns=dict(uns or {}), **names, **entries)


@dataclass(frozen=True)
class Handle:
    """One element or uns entry of a container, looked up when it is used."""

    table: AxisTable
    slot: str
    key: str | None = None

    @property
    def value(self) -> Any:
        whole = getattr(self.table, self.slot)
        if self.key is not None and self.key not in whole:
            raise KeyError(self.key)
        return whole if self.key is None else whole[self.key]

    @property
    def is_none(self) -> bool:
        return getattr(self.table, self.slot) is None if self.key is None else self.key not in getattr(self.table, self.slot)

    @property
    def is_scalar(self) -> bool:
        return isinstance(self.value, (str, bool, int, float, np.generic)) or self.value is None

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(getattr(self.value, "shape", ()))

    @property
    def dtype(self) -> str:
        return str(getattr(self.value, "dtype", type(self.value).__name__))

    def __getitem__(self, what):
        return self.value[what]

    def read(self) -> Any:
        """The whole of it, on the driver."""
        value = self.value
        return value if not hasattr(value, "df") else value.to_pandas() if value.kind == "table" else value.to_numpy()


def content_hash(element: Element) -> int:
    """A hash of an element's rows, whatever their physical order."""
    columns = sorted(element.df.columns)
    row = element.df.select(F.coalesce(F.sum(F.xxhash64(*map(quoted, columns)).cast("decimal(38,0)")), F.lit(0)).alias("h"), F.count("*").alias("n")).first()
    return hash((element.shape, tuple(columns), int(row.h), row.n))


def same(a: Element, b: Element) -> bool:
    """Equal kind, shape, type and rows."""
    return a.kind == b.kind and a.shape == b.shape and getattr(a, "dtype", "") == getattr(b, "dtype", "") and content_hash(a) == content_hash(b)
