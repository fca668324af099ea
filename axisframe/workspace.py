"""Places for intermediate tables that several executors share.

Iterative operators cut their lineage by writing a Parquet table into the folder named by ``spark.checkpoint.dir``.
The setting is read from the session.  Only where it is unset and the session runs on one machine (local tests) a
temporary folder is chosen; on a cluster, whose executors would each write to a disk of their own, it is an error.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_local_dirs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the session names it."""
    named = spark.conf.get(_CONF, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors of {master} share: intermediate tables go there")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="axisframe_"))
        atexit.register(shutil.rmtree, _local_dirs[0], True)
    return "file://" + _local_dirs[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/axisframe/{label}_{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; the result has no lineage and survives the
    loss of executors.  The table stays until :func:`remove_table` or the end of the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate path through the Hadoop file system it lives on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def remove_table(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that came from :func:`materialize`."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/axisframe/" in path:
            remove(df.sparkSession, path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run: once a context, as a zip of its sources.
    Operators with Python code call it first."""
    context = spark.sparkContext
    if getattr(context, "_axisframe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        files = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".py"))
        digest = hashlib.sha1(b"".join(open(f, "rb").read() for f in files)).hexdigest()[:10]
        folder = tempfile.mkdtemp(prefix="axisframe_zip_")
        atexit.register(shutil.rmtree, folder, True)
        archive = os.path.join(folder, f"axisframe_{digest}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in files:
                z.write(f, os.path.join("axisframe", os.path.relpath(f, root)))
        context.addPyFile(archive)
    context._axisframe_shipped = True
