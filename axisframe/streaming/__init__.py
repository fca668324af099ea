"""Growing a snapshot from a stream.

The engine has no event-time operators of its own; Structured Streaming provides them.  What a stream needs here is an
append that keeps stored positions dense and happens once for each micro-batch.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from axisframe import store
from axisframe.elements import Sparse
from axisframe.ordinals import rank_by_position

_STATE = "stream.json"


def append_batch(batch: DataFrame, epoch: int, path: str, n_cols: int, row_key: str, order: str, entries: str = "entries") -> None:
    """Append the rows of a micro-batch (row_key, order long, entries array of (column, value)) below those of the store
    at ``path``.  Rows are numbered by ``order``; an epoch that was appended already is skipped, so a restart repeats
    nothing."""
    spark = batch.sparkSession
    files = store.Files(spark, path)
    done = json.loads(files.read(_STATE)) if files.exists(_STATE) else {"epoch": -1, "rows": 0, "parts": []}
    if epoch <= done["epoch"]:
        return
    ranked = rank_by_position(batch.select(row_key, order, entries), order, out="i").withColumn("i", F.col("i") + done["rows"])
    names = batch.schema[entries].dataType.elementType.names
    ranked = ranked.persist()
    try:
        n = ranked.count()
        part = f"x/epoch={epoch}"
        cells = ranked.select("i", F.posexplode(entries).alias("seq", "e"))
        cells = cells.select("i", F.col(f"e.{names[0]}").cast("long").alias("j"), F.col("seq").cast("long").alias("seq"), F.col(f"e.{names[1]}").alias("v"))
        root = path.rstrip("/")
        cells.write.mode("overwrite").parquet(f"{root}/{part}")
        ranked.select("i", F.col(row_key).cast("string").alias("name")).write.mode("overwrite").parquet(f"{root}/names/epoch={epoch}")
    finally:
        ranked.unpersist()
    files.write(_STATE, json.dumps({"epoch": epoch, "rows": done["rows"] + n, "n_cols": n_cols, "parts": [*done["parts"], part]}))


def append_stream(rows: DataFrame, path: str, checkpoint: str, n_cols: int, row_key: str, order: str, entries: str = "entries") -> StreamingQuery:
    """Start the append of a streaming frame; ``checkpoint`` holds the stream's progress."""
    def each(batch: DataFrame, epoch: int) -> None:
        append_batch(batch, epoch, path, n_cols, row_key, order, entries)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream_store(spark, path: str) -> Sparse | None:
    """The matrix as of the last finished epoch."""
    files = store.Files(spark, path)
    if not files.exists(_STATE):
        return None
    state = json.loads(files.read(_STATE))
    df = spark.read.parquet(*[f"{path.rstrip('/')}/{p}" for p in state["parts"]]).select("i", "j", "seq", "v")
    return Sparse(df, (state["rows"], state["n_cols"]))
