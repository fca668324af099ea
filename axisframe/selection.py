"""Selections along one axis: plain values that are resolved and composed before any plan is built.

A selection names *stored* positions, in order, with repeats.  Lowering it to a DataFrame turns a range into a filter on
the stored ordinal (pushed to the scan), and a list of positions into a join that also carries each one's new ordinal.

Stepped ranges have ceil((stop - start) / |step|) positions.  A negative step reverses first: it starts at stop - 1 and
goes down.  Python slices with a negative step are translated to that form and mean what they mean in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.ordinals import rank_by_position

#: Positions given as a list are broadcast up to this many (16 bytes each), joined by shuffle beyond.
BROADCAST_POSITIONS = 1_000_000
#: Lists up to this many distinct positions also become an IN filter on the scan.
IN_FILTER = 200


class SelectionError(ValueError):
    """A selection that does not fit its axis."""


@dataclass(frozen=True)
class Range:
    """Positions start..stop by step; open or negative ends are resolved against the axis length."""

    start: int | None = None
    stop: int | None = None
    step: int = 1

    def __post_init__(self):
        if self.step == 0:
            raise SelectionError("the step of a range cannot be zero")

    def resolve(self, n: int) -> Range:
        start = 0 if self.start is None else self.start
        stop = n if self.stop is None else self.stop
        start, stop = (start + n if start < 0 else start), (stop + n if stop < 0 else stop)
        if start < 0 or stop > n:
            raise SelectionError(f"range {self.start}:{self.stop} is outside an axis of length {n}")
        return Range(start, max(start, stop), self.step)

    def __len__(self) -> int:
        return -(-max(0, self.stop - self.start) // abs(self.step))

    def positions(self) -> np.ndarray:
        if self.step > 0:
            return np.arange(self.start, self.stop, self.step)
        return np.arange(self.stop - 1, self.start - 1, self.step)

    def is_full(self, n: int) -> bool:
        return self.step == 1 and self.start == 0 and self.stop == n

    def keeps(self, ordinal: Column) -> Column:
        """Whether a stored ordinal is selected; bounds first, as only they reach the scan."""
        inside = (ordinal >= self.start) & (ordinal < self.stop)
        if self.step == 1:
            return inside
        anchor = ordinal - self.start if self.step > 0 else F.lit(self.stop - 1) - ordinal
        return inside & (anchor % abs(self.step) == 0) if self.step != -1 else inside

    def renumber(self, ordinal: Column) -> Column:
        if self.step == 1:
            return ordinal - self.start if self.start else ordinal
        anchor = ordinal - self.start if self.step > 0 else F.lit(self.stop - 1) - ordinal
        return F.floor(anchor / abs(self.step)).cast("long")


@dataclass(frozen=True)
class Index:
    """Explicit positions, in order, with repeats."""

    at: tuple[int, ...]

    def resolve(self, n: int) -> Index | Range:
        at = np.array(self.at, np.int64)
        at = np.where(at < 0, at + n, at)
        if len(at) and (at.min() < 0 or at.max() >= n):
            raise SelectionError(f"a position is outside an axis of length {n}")
        if len(at) and len(at) == at[-1] - at[0] + 1 and (np.diff(at) == 1).all():
            return Range(int(at[0]), int(at[-1]) + 1)
        return Index(tuple(at.tolist()))

    def __len__(self) -> int:
        return len(self.at)

    def positions(self) -> np.ndarray:
        return np.array(self.at, np.int64)

    def is_full(self, n: int) -> bool:
        return False


@dataclass(frozen=True)
class Names:
    """Labels to be looked up in the axis index; of repeated labels the last position counts."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Places:
    """Positions held in a frame (old, new), for selections too long for the driver: masks and names as columns."""

    df: DataFrame
    n: int

    @classmethod
    def of_mask(cls, rows: DataFrame, ordinal: str = "ix") -> Places:
        """The positions that a frame names, each once, in rising order."""
        places = rank_by_position(rows.select(F.col(ordinal).alias("old")).where("old is not null").distinct(), "old", out="new")
        return cls(places, places.count())

    def resolve(self, n: int) -> Places:
        return self

    def __len__(self) -> int:
        return self.n

    def positions(self) -> np.ndarray:
        raise SelectionError("a selection held in a frame has no local positions; it selects rows only")

    def is_full(self, n: int) -> bool:
        return False


Selection = Range | Index | Places
FULL = Range()


def parse(what, n: int) -> Selection:
    """A selection from a Python subscript: slice, ``...``, None, integer, list, boolean mask or Series."""
    if what is None or what is Ellipsis:
        return FULL.resolve(n)
    if isinstance(what, (Range, Index, Places)):
        return what.resolve(n)
    if isinstance(what, slice):
        start, stop, step = what.indices(n)
        if step > 0:
            return Range(start, max(start, stop), step).resolve(n)
        return Range(max(stop + 1, 0), start + 1, step) if start > stop else Range(0, 0)
    if isinstance(what, (bool, np.bool_)):
        raise SelectionError("a single boolean selects nothing")
    if isinstance(what, (int, np.integer)):
        return Index((int(what),)).resolve(n)
    values = what.to_numpy() if isinstance(what, pd.Series) else np.asarray(list(what) if not isinstance(what, np.ndarray) else what)
    if values.ndim != 1:
        raise SelectionError("a selection has one dimension")
    if values.dtype == bool:
        if len(values) != n:
            raise SelectionError(f"a mask of {len(values)} on an axis of length {n}")
        return Index(tuple(np.flatnonzero(values).tolist())).resolve(n)
    if len(values) and not np.issubdtype(values.dtype, np.integer):
        raise SelectionError(f"cannot select by {values.dtype}")
    return Index(tuple(int(x) for x in values)).resolve(n)


def parse_all(what, shape: Sequence[int]) -> list[Selection]:
    """One selection for each axis; missing trailing ones, and what ``...`` stands for, are full."""
    parts = list(what) if isinstance(what, tuple) else [what]
    if sum(p is Ellipsis for p in parts) > 1 or len(parts) - any(p is Ellipsis for p in parts) > len(shape):
        raise SelectionError(f"{len(parts)} selections for {len(shape)} axes")
    if any(p is Ellipsis for p in parts):
        at = next(k for k, p in enumerate(parts) if p is Ellipsis)
        parts[at : at + 1] = [None] * (len(shape) - len(parts) + 1)
    parts += [None] * (len(shape) - len(parts))
    return [parse(p, n) for p, n in zip(parts, shape)]


def compose(first: Selection, then: Selection) -> Selection:
    """One selection of stored positions for ``then`` applied to the result of ``first``; both resolved."""
    if isinstance(first, Range) and isinstance(then, Range) and first.step > 0 and then.step > 0:
        start = first.start + then.start * first.step
        stop = first.start + (then.start + (len(then) - 1) * then.step) * first.step + 1 if len(then) else start
        return Range(start, stop, first.step * then.step)
    if isinstance(first, Range) and isinstance(then, Range):
        # Reversals: the positions still lie at one distance from each other, downwards or upwards.
        k, step = len(then), first.step * then.step
        if not k:
            return Range(0, 0)
        ends = [_place(first, _place(then, n)) for n in (0, k - 1)]
        return Range(ends[0], ends[1] + 1, step) if step > 0 else Range(ends[1], ends[0] + 1, step)
    if isinstance(then, Places):
        raise SelectionError("a selection held in a frame cannot be composed; select twice")
    return Index(tuple(first.positions()[then.positions()].tolist()))


def _place(selection: Range, n: int) -> int:
    return selection.start + n * selection.step if selection.step > 0 else selection.stop - 1 + n * selection.step


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def out_shape(selections: Iterable[Selection]) -> tuple[int, ...]:
    return tuple(len(s) for s in selections)


def expand(selections: Sequence[Selection]) -> np.ndarray | None:
    """The explicit points (row-major) of a mixed selection; None where all axes are ranges."""
    if all(isinstance(s, Range) for s in selections):
        return None
    grids = np.meshgrid(*[s.positions() for s in selections], indexing="ij")
    return np.stack([g.ravel() for g in grids], axis=1)


def points_frame(spark, selections: Sequence[Selection], names: Sequence[str] = ("i", "j")) -> DataFrame:
    """(names..., place): the points of :func:`expand` as a frame, multiplied out on the executors; ``place`` is row-major."""
    total = int(np.prod([len(s) for s in selections], dtype=np.int64))
    points, rest = spark.range(total).withColumnRenamed("id", "place"), total
    for name, s in zip(names, selections):
        rest //= max(len(s), 1)
        local = F.floor(F.col("place") / rest).cast("long") % len(s)
        if isinstance(s, Range):
            points = points.withColumn(name, (F.lit(s.start) + local * s.step) if s.step > 0 else (F.lit(s.stop - 1) + local * s.step))
        else:
            at = positions_frame(spark, s, "__old", "__new") if not isinstance(s, Places) else s.df.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
            points = points.withColumn("__k", local).join(at, F.col("__k") == F.col("__new")).withColumn(name, F.col("__old")).drop("__k", "__old", "__new")
    return points.select(*names, "place")


def positions_frame(spark, selection: Selection, old: str = "old", new: str = "new") -> DataFrame:
    """(old, new) of a list of positions."""
    at = selection.positions()
    return _frame(spark, at, np.arange(len(at)), old, new)


def _frame(spark, at: np.ndarray, new_at: np.ndarray, old: str, new: str) -> DataFrame:
    frame = spark.createDataFrame(pd.DataFrame({old: at.astype("int64"), new: new_at.astype("int64")}), f"{old} long, {new} long")
    return F.broadcast(frame) if len(at) <= BROADCAST_POSITIONS else frame


def place_rows(df: DataFrame, at: np.ndarray, new: np.ndarray, ordinal: str = "i") -> DataFrame:
    """The rows at stored positions ``at``, each at its ``new`` one; the frame is broadcast only up to a bound."""
    if not len(at):
        return df.where(F.lit(False))
    distinct, col = np.unique(at), F.col(ordinal)
    # Bounds and short lists are derived here, since a join gives the scan no filter of its own.
    bounded = df.where(col.isin(distinct.tolist())) if len(distinct) <= IN_FILTER else df.where((col >= int(at.min())) & (col <= int(at.max())))
    return _join(bounded, _frame(df.sparkSession, at, new, "__old", "__new"), ordinal)


def _join(df: DataFrame, frame: DataFrame, ordinal: str) -> DataFrame:
    joined = df.join(frame, F.col(ordinal) == F.col("__old")).withColumn(ordinal, F.col("__new"))
    return joined.select(*[quoted(c) for c in df.columns])


def select_rows(df: DataFrame, selection: Selection, n: int, ordinal: str = "i") -> DataFrame:
    """The selected rows, renumbered; repeated positions repeat their rows.  Keeps the column order."""
    if selection.is_full(n):
        return df
    if isinstance(selection, Range):
        return df.where(selection.keeps(F.col(ordinal))).withColumn(ordinal, selection.renumber(F.col(ordinal)))
    if isinstance(selection, Places):
        return _join(df, selection.df.select(F.col("old").alias("__old"), F.col("new").alias("__new")), ordinal)
    at = selection.positions()
    return place_rows(df, at, np.arange(len(at)), ordinal)


class _Maker:
    """``s_[...]``: the subscript itself."""

    def __getitem__(self, what):
        return what


s_ = _Maker()
