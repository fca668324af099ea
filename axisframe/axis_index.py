"""Names along an axis, in three forms: a list, a range of numbers, or intervals of named sequences."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.selection import Index as Positions
from axisframe.selection import Places, Selection, select_rows
from axisframe.selection import Range as RangeSelection

#: Names of at most this many positions are held as Python strings; more stay in a frame.
LOCAL_NAMES = 10_000

_INTERVAL = re.compile(r"(.*):(\d+)-(\d+)", re.DOTALL)


@dataclass(frozen=True)
class ListIndex:
    """Explicit names; repeats are allowed, and a lookup gives the last position."""

    names: tuple[str, ...]
    kind = "list"

    def __len__(self) -> int:
        return len(self.names)

    def labels(self) -> list[str]:
        return list(self.names)

    def find(self, name: str) -> int | None:
        return self._last().get(name)

    def _last(self) -> dict[str, int]:
        if "_found" not in self.__dict__:
            object.__setattr__(self, "_found", {n: k for k, n in enumerate(self.names)})
        return self.__dict__["_found"]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame({"ix": np.arange(len(self.names)), "name": list(self.names)}), "ix long, name string")

    def select(self, selection: Selection) -> AxisIndex:
        if isinstance(selection, Places):
            return _in_frame(self, selection)
        return ListIndex(tuple(self.names[k] for k in selection.positions()))

    def has_duplicates(self) -> bool:
        return len(set(self.names)) < len(self.names)


@dataclass(frozen=True)
class RangeIndex:
    """Names are the decimal numbers start..stop; computed, never stored."""

    start: int
    stop: int
    kind = "range"

    def __len__(self) -> int:
        return max(0, self.stop - self.start)

    def labels(self) -> list[str]:
        return [str(k) for k in range(self.start, self.stop)]

    def find(self, name: str) -> int | None:
        if not re.fullmatch(r"-?\d+", name) or str(int(name)) != name or not self.start <= int(name) < self.stop:
            return None
        return int(name) - self.start

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(len(self)).select(F.col("id").alias("ix"), (F.col("id") + self.start).cast("string").alias("name"))

    def select(self, selection: Selection) -> AxisIndex:
        if isinstance(selection, RangeSelection) and selection.step == 1:
            return RangeIndex(self.start + selection.start, self.start + selection.stop)
        if isinstance(selection, Places):
            return _in_frame(self, selection)
        return ListIndex(tuple(str(self.start + int(k)) for k in selection.positions()))

    def has_duplicates(self) -> bool:
        return False


@dataclass(frozen=True)
class Run:
    """Windows of ``size`` every ``step`` over start..end of a named sequence; the last is clipped at the end."""

    name: str
    start: int
    end: int
    size: int
    step: int

    def __len__(self) -> int:
        return -(-max(0, self.end - self.start) // self.step)

    def label(self, k: int) -> str:
        at = self.start + k * self.step
        return f"{self.name}:{at}-{min(at + self.size, self.end)}"


@dataclass(frozen=True)
class IntervalIndex:
    """Names ``sequence:from-to`` of runs, one run after another."""

    runs: tuple[Run, ...]
    kind = "intervals"

    def __len__(self) -> int:
        return sum(map(len, self.runs))

    def labels(self) -> list[str]:
        return [r.label(k) for r in self.runs for k in range(len(r))]

    def find(self, name: str) -> int | None:
        found = _INTERVAL.fullmatch(name)
        if not found:
            return None
        at, to, offset = int(found[2]), int(found[3]), 0
        hit = None
        for r in self.runs:
            fits = r.start <= at < r.end and (at - r.start) % r.step == 0 and to == min(at + r.size, r.end)
            if r.name == found[1] and fits:
                hit = offset + (at - r.start) // r.step
            offset += len(r)
        return hit

    def frame(self, spark: SparkSession) -> DataFrame:
        """Runs are exploded on the executors; what the driver sends is one row a run."""
        rows, offset = [], 0
        for r in self.runs:
            rows.append((r.name, r.start, r.end, r.size, r.step, len(r), offset))
            offset += len(r)
        runs = spark.createDataFrame(rows, "run string, start long, end long, size long, step long, n long, offset long")
        each = runs.where("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
        return interval_labels(each.withColumn("at", F.col("start") + F.col("k") * F.col("step"))).select((F.col("offset") + F.col("k")).alias("ix"), "name")

    def select(self, selection: Selection) -> AxisIndex:
        if isinstance(selection, RangeSelection) and selection.step == 1:
            runs, offset = [], 0
            for r in self.runs:
                a, b = max(selection.start - offset, 0), min(selection.stop - offset, len(r))
                # A slice may cut a run short only where windows do not reach beyond the new end.
                if b > a:
                    end = r.end if b == len(r) else r.start + (b - 1) * r.step + r.size
                    if b < len(r) and -(-(end - (r.start + a * r.step)) // r.step) != b - a:
                        return ListIndex(tuple(self.labels()[selection.start : selection.stop]))
                    runs.append(Run(r.name, r.start + a * r.step, end, r.size, r.step))
                offset += len(r)
            return IntervalIndex(tuple(runs))
        if isinstance(selection, Places):
            return _in_frame(self, selection)
        labels = self.labels()
        return ListIndex(tuple(labels[k] for k in selection.positions()))

    def has_duplicates(self) -> bool:
        """Labels repeat only between runs of one sequence; those are compared as rows."""
        names = [r.name for r in self.runs if len(r)]
        return len(set(names)) < len(names) and FrameIndex(self.frame(SparkSession.active()), len(self)).has_duplicates()


@dataclass(frozen=True, eq=False)
class FrameIndex:
    """Names as a frame (ix, name), for axes too long for the driver: lookups and selections are joins."""

    df: DataFrame
    n: int
    kind = "frame"

    def __len__(self) -> int:
        return self.n

    def labels(self) -> list[str]:
        """All names on the driver; for short axes."""
        return [r.name for r in self.df.orderBy("ix").collect()]

    def find(self, name: str) -> int | None:
        return self.find_all([name]).get(name)

    def find_all(self, names: list[str]) -> dict[str, int]:
        """The last position of each of the given names that there is."""
        wanted = self.df.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
        return {r.name: r.ix for r in self.df.join(wanted, "name", "left_semi").groupBy("name").agg(F.max("ix").alias("ix")).collect()} if names else {}

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.df.select("ix", "name")

    def select(self, selection: Selection) -> AxisIndex:
        return FrameIndex(select_rows(self.df.select("ix", "name"), selection, self.n, "ix"), len(selection))

    def has_duplicates(self) -> bool:
        return not self.df.groupBy("name").count().where("count > 1").isEmpty()


def _in_frame(index: AxisIndex, selection: Places) -> FrameIndex:
    return FrameIndex(index.frame(selection.df.sparkSession), len(index)).select(selection)


AxisIndex = ListIndex | RangeIndex | IntervalIndex | FrameIndex


def interval_labels(df: DataFrame) -> DataFrame:
    """Add ``name``, the label of the window at ``at`` of (run, end, size)."""
    return df.withColumn("name", F.concat("run", F.lit(":"), F.col("at").cast("string"), F.lit("-"), F.least(F.col("at") + F.col("size"), F.col("end")).cast("string")))


def interval_lookup(labels: DataFrame, runs: DataFrame, label: str = "name") -> DataFrame:
    """Add ``ix`` to labels by arithmetic on (run, start, end, size, step, offset) rows, one for each sequence; null where
    a label is no window of its run."""
    part = lambda n: F.regexp_extract(label, r"^([\s\S]*):(\d+)-(\d+)$", n)
    parsed = labels.select("*", part(1).alias("__run"), part(2).try_cast("long").alias("__at"), part(3).try_cast("long").alias("__to"))
    joined = parsed.join(runs, F.col("__run") == F.col("run"), "left")
    fits = F.expr("__at >= start and __at < end and (__at - start) % step = 0 and __to = least(__at + size, end)")
    out = F.when(fits, F.col("offset") + F.floor((F.col("__at") - F.col("start")) / F.col("step")).cast("long"))
    return joined.withColumn("ix", out).select(*labels.columns, "ix")


def from_labels(names: list[str]) -> AxisIndex:
    return ListIndex(tuple(map(str, names)))


def positions_of(index: AxisIndex, names) -> Positions:
    """Positions of local names; an unknown name is an error."""
    if isinstance(index, FrameIndex):
        known = index.find_all(list(names))
        found = [known.get(n) for n in names]
    else:
        found = [index.find(n) for n in names]
    missing = [n for n, k in zip(names, found) if k is None]
    if missing:
        raise KeyError(f"names not on this axis: {missing[:5]}")
    return Positions(tuple(found))


def places_of(index: AxisIndex, wanted: DataFrame) -> Places:
    """The positions of the names of a frame (new, name), by a join; an unknown name is an error."""
    found = lookup_frame(index.frame(wanted.sparkSession), wanted)
    told = found.agg(F.count("*").alias("n"), F.first(F.when(F.col("old").isNull(), F.coalesce("name", F.lit("null"))), True).alias("missing")).first()
    if told.missing is not None:
        raise KeyError(f"names not on this axis: {told.missing}, perhaps more")
    return Places(found.select("old", "new"), told.n)


def equal(a: AxisIndex, b: AxisIndex) -> bool:
    """Same names in the same order, whatever the forms."""
    if a is b or len(a) != len(b):
        return a is b
    if isinstance(a, RangeIndex) and isinstance(b, RangeIndex):
        return a == b
    if isinstance(a, FrameIndex) or isinstance(b, FrameIndex) or len(a) > LOCAL_NAMES:
        spark = next((x.df.sparkSession for x in (a, b) if isinstance(x, FrameIndex)), None) or SparkSession.active()
        other = b.frame(spark).select("ix", F.col("name").alias("other"))
        return a.frame(spark).join(other, "ix", "full").where(~F.col("name").eqNullSafe(F.col("other"))).isEmpty()
    return a == b or a.labels() == b.labels()


def lookup_frame(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(new, name, old) of wanted (new, name) rows against an index (ix, name); of repeated names the last counts;
    unknown names have a null ``old``."""
    last = names.groupBy("name").agg(F.max("ix").alias("old"))
    return wanted.join(last, "name", "left").select("new", "name", "old")
