"""Row chunks of an element: on the driver one after another, or as a column for distributed work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.elements import Dense, Element, ShapeError, Sparse, vstack
from axisframe.selection import Range


class Chunks:
    """(chunk, start, end) of ``size`` rows each, the last one shorter; none of an empty element.  Of several elements
    (the children of a stack) chunks never cross from one into the next, and positions are those of the stack."""

    def __init__(self, elements: Element | Sequence[Element], size: int):
        if size < 1:
            raise ValueError("chunks have one row or more")
        self.elements = list(elements) if isinstance(elements, (list, tuple)) else [elements]
        self.size = size

    def __len__(self) -> int:
        return sum(-(-e.shape[0] // self.size) for e in self.elements)

    def __iter__(self) -> Iterator[tuple[Element, int, int]]:
        offset = 0
        for e in self.elements:
            n = e.shape[0]
            for a in range(0, n, self.size):
                b = min(a + self.size, n)
                rest = [] if e.kind == "table" else [Range(0, m) for m in e.shape[1:]]
                yield e.select(Range(a, b), *rest), offset + a, offset + b
            offset += n


class Builder:
    """An element grown chunk by chunk, its kind, type and width given or those of the first chunk.  Dense chunks go into
    a sparse element as their entries; other kinds, types or widths are errors.  The element is a lazy stack."""

    def __init__(self, kind: str | None = None, dtype: str | None = None, width: tuple[int, ...] | None = None):
        self.kind, self.dtype, self.width, self.parts = kind, dtype, width, []

    def add(self, chunk: Sparse | Dense) -> None:
        if self.kind == "sparse" and chunk.kind == "dense":
            chunk = chunk.to_sparse()
        form = chunk.kind, chunk.dtype, tuple(chunk.shape[1:])
        want = tuple(mine if mine is not None else given for mine, given in zip((self.kind, self.dtype, self.width), form))
        if form != want:
            raise ShapeError(f"a chunk of {form} for an element of {want}")
        self.kind, self.dtype, self.width = want
        self.parts.append(chunk)

    def result(self) -> Sparse | Dense:
        if not self.parts:
            raise ShapeError("no chunk was added")
        return vstack(self.parts)


def chunk_of(ordinal: str, size: int) -> Column:
    """Number of the chunk that a row lies in."""
    return F.floor(F.col(ordinal) / size).cast("long")


def chunk_bounds(df: DataFrame, n: int, size: int) -> DataFrame:
    """(chunk, start, end) of an axis of n rows, without a scan."""
    chunks = df.sparkSession.range(-(-n // size))
    start = F.col("id") * size
    return chunks.select(F.col("id").alias("chunk"), start.alias("start"), F.least(start + size, F.lit(n)).alias("end"))


def chunk_column_sums(df: DataFrame, size: int) -> DataFrame:
    """(chunk, j, total): sums of the columns of each chunk of entries (i, j, v); summed up they are the column sums."""
    return df.groupBy(chunk_of("i", size).alias("chunk"), "j").agg(F.sum("v").alias("total"))
