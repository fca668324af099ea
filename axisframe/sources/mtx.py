"""MatrixMarket coordinate files, plain or gzipped, with names files beside them.

The file is split by Spark's text source and parsed by column expressions; a folder of parts is read in the order of
their names.  Lines carry their place (file, block, line), so the header is the first line and the size line the first
that is no comment, however many comments there are, and repeated coordinates keep the order of the file.  Paths are
those of Hadoop: without a scheme they lie on the default file system.  Integer files give i64, real ones f64, pattern files 1.  Symmetric files give the mirrored entry
too, skew-symmetric ones with the opposite sign.  Empty rows count: the shape is that of the header.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.axis_index import FrameIndex
from axisframe.elements import Sparse
from axisframe.model import AxisTable
from axisframe.ordinals import PLACE, in_file_order, placed
from axisframe.store import Files
from axisframe.workspace import fresh_path, materialize


class FormatError(ValueError):
    """Not a MatrixMarket file that can be read."""


@dataclass(frozen=True)
class Header:
    field: str
    symmetry: str
    rows: int
    cols: int
    entries: int


def parse_header(lines: list[str]) -> Header:
    """From the first lines, up to and with the size line."""
    if not lines or not lines[0].lower().startswith("%%matrixmarket"):
        raise FormatError("no MatrixMarket banner")
    words = lines[0].lower().split()
    if len(words) != 5 or words[1] != "matrix" or words[2] != "coordinate":
        raise FormatError(f"only coordinate matrices can be read: {lines[0]!r}")
    if words[3] not in ("integer", "real", "double", "pattern") or words[4] not in ("general", "symmetric", "skew-symmetric"):
        raise FormatError(f"cannot read {words[3]} {words[4]} matrices")
    for line in lines[1:]:
        if line.strip() and not line.lstrip().startswith("%"):
            size = line.split()
            if len(size) != 3 or not all(re.fullmatch(r"\d+", s) for s in size):
                raise FormatError(f"not a size line: {line!r}")
            return Header("real" if words[3] == "double" else words[3], words[4], *map(int, size))
    raise FormatError("the file ends before its size line")


def _lines(spark: SparkSession, path: str) -> list[DataFrame]:
    """(value and its place) of the lines of a text file, or of the first file of a folder and of the others; gzip by its
    first bytes, whatever the name."""
    files = Files(spark, path)
    if not files.exists():
        raise FormatError(f"no file at {path}")
    if files.is_folder():
        names = [f"{path.rstrip('/')}/{n}" for n in files.list() if n[0] not in "._"]
        if not names:
            raise FormatError(f"no file in {path}")
        return [placed(spark.read.text(part)) for part in (names[:1], names[1:]) if part]
    if not path.endswith(".gz") and files.first_bytes(2) == b"\x1f\x8b":
        # A single packed stream cannot be split anyway; a copy under the right name lets the text source unpack it.
        copy = fresh_path(spark, "unpacked") + ".gz"
        Files(spark, copy).copy_from([files.fs.makeQualified(files._path("")).toString()])
        path = copy
    return [placed(spark.read.text(path))]


def _first(lines: DataFrame, condition=None):
    """The first line of a file, or the first of some: only as many of its blocks are read as that takes."""
    return next(iter((lines if condition is None else lines.where(condition)).take(1)), None)


def read_mtx(spark: SparkSession, path: str, layout: str = "csr") -> Sparse:
    """A sparse matrix; repeated coordinates are kept, in the order of the file, as ``seq`` says."""
    lines, *others = _lines(spark, path)
    content = ~F.col("value").startswith("%") & (F.trim("value") != "")
    banner, size = _first(lines), _first(lines, content)
    header = parse_header([x.value for x in (banner, size) if x is not None and (x is banner or x.value != banner.value)])
    here = (F.col("__file") == size["__file"]) & (F.col("__block") == size["__block"]) & (F.col("__line") == size["__line"])
    body = lines.where(content & ~here)
    for more in others:
        body = body.unionByName(more.where(content))
    body = body.withColumn("w", F.split(F.trim("value"), r"\s+"))
    want = 2 if header.field == "pattern" else 3
    value = F.lit(1).cast("bigint") if header.field == "pattern" else F.col("w")[2].cast("bigint" if header.field == "integer" else "double")
    kept = body.where(F.size("w") == want).select((F.col("w")[0].cast("long") - 1).alias("i"), (F.col("w")[1].cast("long") - 1).alias("j"), value.alias("v"), *PLACE)
    if header.symmetry != "general":
        sign = -1 if header.symmetry == "skew-symmetric" else 1
        kept = kept.unionByName(kept.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v"), *PLACE))
    return Sparse.of(kept, (header.rows, header.cols), order=[*PLACE], layout=layout)


def read_names(spark: SparkSession, path: str) -> FrameIndex:
    """Names of an axis: the first tab field of each line, in the order of the file."""
    lines = reduce(DataFrame.unionByName, _lines(spark, path)).withColumn("name", F.split("value", "\t")[0]).drop("value")
    named = materialize(in_file_order(lines).select("ix", "name"), "names")
    return FrameIndex(named, named.count())


def read_mtx_table(spark: SparkSession, path: str, obs_names: str | None = None, var_names: str | None = None) -> AxisTable:
    """A container from a matrix file and names files."""
    x = read_mtx(spark, path)
    table = AxisTable(spark, X=x)
    for axis, names in ((0, obs_names), (1, var_names)):
        if names:
            table = table.with_names(axis, read_names(spark, names))
    return table


def write_mtx(matrix: Sparse, path: str, single: bool = True) -> None:
    """A general coordinate file, entries by row, column and seq; with ``single`` one file, its parts joined as streams,
    else a folder of parts in the order of their names.  :func:`read_mtx` reads both, and other programs the single file."""
    spark = matrix.df.sparkSession
    field = "integer" if matrix.dtype[0] in "iub" else "real"
    head = f"%%MatrixMarket matrix coordinate {field} general\n{matrix.shape[0]} {matrix.shape[1]} {matrix.df.count()}\n"
    value = F.col("v").cast("bigint" if field == "integer" else "double").cast("string")
    rows = matrix.df.repartitionByRange("i", "j").sortWithinPartitions("i", "j", "seq")
    lines = rows.select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), value).alias("value"))
    folder = fresh_path(spark, "mtx") if single else path.rstrip("/")
    lines.write.mode("overwrite").text(folder)
    files = Files(spark, folder)
    files.write("part-.header", head)
    if single:
        parts = [f"{folder}/{n}" for n in files.list() if n.startswith("part-")]
        Files(spark, path).copy_from(parts)
        files.delete()
