"""Snapshots on disk: Parquet for what lies along axes, one JSON manifest for everything else.

A commit writes new files beside the old ones and then replaces the manifest by one rename that overwrites, so a reader
sees the old state or the new one, and a path that is being read is never overwritten.  Sparse data are sorted by their leading ordinal, so a row range
reads few row groups.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.axis_index import LOCAL_NAMES, AxisIndex, FrameIndex, IntervalIndex, ListIndex, RangeIndex, Run
from axisframe.elements import Dense, Element, Sparse, Table
from axisframe.model import AXES, COLLECTIONS, SLOTS, AxisTable
from axisframe.selection import Places, Range, Selection, positions_frame, quoted

MANIFEST = "manifest.json"


class StoreError(ValueError):
    """A store that cannot be read, or not in this way."""


class Files:
    """Small files through the Hadoop file system, so that every storage Spark reads works."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file: the new content is complete before it takes the name, and takes it by one rename."""
        part = f"{name}.{uuid.uuid4().hex[:8]}"
        stream = self.fs.create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        how = self.jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.OVERWRITE.getClass(), 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        whole = self.fs.makeQualified(self._path(name))
        hadoop.FileContext.getFileContext(whole.toUri(), self.conf).rename(self.fs.makeQualified(self._path(part)), whole, how)

    def first_bytes(self, count: int, name: str = "") -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readNBytes(count))
        finally:
            stream.close()

    def copy_from(self, sources: list[str], name: str = "") -> None:
        """Write a file as the given ones (full paths), one after another; bytes stream through, whatever their size."""
        io = self.jvm.org.apache.hadoop.io.IOUtils
        out = self.fs.create(self._path(name), True)
        try:
            for source in sources:
                path = self.jvm.org.apache.hadoop.fs.Path(source)
                stream = path.getFileSystem(self.conf).open(path)
                try:
                    io.copyBytes(stream, out, self.conf, False)
                finally:
                    stream.close()
        finally:
            out.close()

    def is_folder(self, name: str = "") -> bool:
        return self.fs.getFileStatus(self._path(name)).isDirectory()

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._path(name), True)

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)))

    def new_folder(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))


def parquet_rows(spark: SparkSession, path: str, most_files: int = 64) -> int:
    """Rows of a Parquet file or folder, from the footers: read here while they are few, else by a job."""
    files = Files(spark, path)
    names = [n for n in files.list() if n.endswith(".parquet") and n[0] not in "._"] if files.is_folder() else [""]
    if len(names) > most_files or not names:
        return spark.read.parquet(path).count()
    parquet, total = files.jvm.org.apache.parquet.hadoop, 0
    for n in names:
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(files._path(n), files.conf))
        total += reader.getRecordCount()
        reader.close()
    return total


def encode_index(index: AxisIndex | None, path: str, name: str) -> dict | None:
    """An index for the manifest; names beyond ``LOCAL_NAMES`` are written to a Parquet table ``name`` beside it."""
    if index is None:
        return None
    if isinstance(index, RangeIndex):
        return {"kind": "range", "start": index.start, "stop": index.stop}
    if isinstance(index, IntervalIndex):
        return {"kind": "intervals", "runs": [[r.name, r.start, r.end, r.size, r.step] for r in index.runs]}
    if len(index) <= LOCAL_NAMES:
        return {"kind": "list", "names": index.labels()}
    spark = index.df.sparkSession if isinstance(index, FrameIndex) else SparkSession.active()
    rows = index.frame(spark).select("ix", "name")
    rows.repartitionByRange("ix").sortWithinPartitions("ix").write.option("compression", "zstd").parquet(f"{path.rstrip('/')}/{name}")
    return {"kind": "frame", "n": len(index), "path": name}


def decode_index(data: dict | None, spark: SparkSession, root: str) -> AxisIndex | None:
    if data is None:
        return None
    if data["kind"] == "frame":
        return FrameIndex(spark.read.schema("ix long, name string").parquet(f"{root}/{data['path']}"), data["n"])
    if data["kind"] == "range":
        return RangeIndex(data["start"], data["stop"])
    if data["kind"] == "intervals":
        return IntervalIndex(tuple(Run(*r) for r in data["runs"]))
    return ListIndex(tuple(data["names"]))


#: Element -> tag in the manifest.
def encoding(element: Element) -> str:
    if element.kind == "sparse":
        return f"{element.layout}_matrix"
    if element.kind == "dense":
        return "string-array" if element.dtype == "string" else "array"
    return "dataframe"


def encode_uns(value: Any) -> Any:
    """Scalars, lists, local arrays and nested mappings with their types; bool before int, since a bool is an int."""
    if isinstance(value, dict):
        return {"encoding": "dict", "value": {k: encode_uns(v) for k, v in value.items()}}
    if isinstance(value, (list, tuple)):
        return {"encoding": "list", "value": [encode_uns(v) for v in value]}
    if isinstance(value, np.ndarray):
        flat = [v.item() if hasattr(v, "item") else v for v in value.ravel()]
        return {"encoding": "string-array" if value.dtype.kind in "OUST" else "array", "dtype": value.dtype.str if value.dtype.kind not in "OUST" else "object", "shape": list(value.shape), "value": [repr(v) if isinstance(v, float) else v for v in flat]}
    if isinstance(value, np.generic):
        return encode_uns(value.item())
    if isinstance(value, str):
        return {"encoding": "string", "value": value}
    for kind, tag in ((bool, "bool"), (int, "i64"), (float, "f64")):
        if isinstance(value, kind):
            return {"encoding": "numeric-scalar", "dtype": tag, "value": repr(value) if tag == "f64" else value}
    if value is None:
        return {"encoding": "null"}
    raise StoreError(f"cannot keep a {type(value).__name__} in uns as a scalar or mapping")


def decode_uns(data: Any) -> Any:
    if data["encoding"] == "dict":
        return {k: decode_uns(v) for k, v in data["value"].items()}
    if data["encoding"] == "list":
        return [decode_uns(v) for v in data["value"]]
    if data["encoding"] in ("array", "string-array"):
        kind = np.dtype(data["dtype"])
        return np.array([float(v) if kind.kind == "f" else v for v in data["value"]], kind).reshape(data["shape"])
    if data["encoding"] == "null":
        return None
    return float(data["value"]) if data.get("dtype") == "f64" else data["value"]


def _write_element(element: Element, path: str, chunk_size: int | None = None) -> None:
    df, key = element.df, "ix" if element.kind == "table" else "i"
    if element.kind == "sparse":
        key = "i" if element.layout == "csr" else "j"
        df = df.repartitionByRange(key).sortWithinPartitions(key, "j" if key == "i" else "i", "seq")
    else:
        df = df.repartitionByRange(key).sortWithinPartitions(key)
    writer = df.write.option("compression", "zstd")
    (writer.option("maxRecordsPerFile", chunk_size) if chunk_size else writer).parquet(path)


def column_encoding(table: Table, field: T.StructField) -> str:
    """The tag of a table's column: categorical, nullable numbers and booleans, texts, or a plain array."""
    if field.name in table.categories:
        return "categorical"
    if isinstance(field.dataType, T.StringType):
        return "string-array"
    if field.nullable and isinstance(field.dataType, T.BooleanType):
        return "nullable-boolean"
    return "nullable-integer" if field.nullable and isinstance(field.dataType, T.IntegralType) else "array"


def _describe(element: Element, paths: list[str]) -> dict:
    out = {"encoding": encoding(element), "kind": element.kind, "shape": list(element.shape), "paths": paths, "schema": element.df.schema.jsonValue()}
    if element.kind == "sparse":
        out |= {"layout": element.layout}
    if element.kind == "table":
        columns = {f.name: column_encoding(element, f) for f in element.df.schema if f.name != "ix"}
        return out | {"rows": element.n, "categories": element.categories, "column-order": element.columns, "columns": columns}
    return out | {"dtype": element.dtype}


def _open_element(spark: SparkSession, root: str, data: dict) -> Element:
    kind = T.StructType.fromJson(data["schema"])
    df = spark.read.schema(kind).parquet(*[p if "://" in p or p.startswith(("/", "file:")) else f"{root}/{p}" for p in data["paths"]])
    if data["kind"] == "sparse":
        return Sparse(df, tuple(data["shape"]), data["layout"], data["dtype"])
    if data["kind"] == "dense":
        return Dense(df, tuple(data["shape"]), data["dtype"])
    return Table(df, data["rows"], data["categories"])


def write(table: AxisTable, path: str, slots: tuple[str, ...] | set[str] = SLOTS, mode: str = "error", adopt: str | None = None, chunk_size: int | None = None) -> AxisTable:
    """Write the given slots as a snapshot at ``path`` and open it.  Mode ``error`` refuses an existing store, ``commit``
    replaces its content at once when all files are written.  Elements that are read from below the folder ``adopt``, as
    they are, are not written again: the manifest points to their files.  ``chunk_size`` bounds the rows of a file."""
    unknown = set(slots) - set(SLOTS)
    if unknown:
        raise StoreError(f"no such slots: {sorted(unknown)}")
    files = Files(table.spark, path)
    if files.exists(MANIFEST) and mode != "commit":
        raise StoreError(f"{path} holds a store already")
    version = uuid.uuid4().hex[:8]
    entries = {}
    for name, element in table.elements():
        if name.split("/")[0] in slots:
            lies = _folder_of(element, adopt) if adopt else None
            if lies:
                entries[name] = _describe(element, [lies])
                continue
            entries[name] = _describe(element, [f"v_{version}/{name}"])
            _write_element(element, f"{path.rstrip('/')}/v_{version}/{name}", chunk_size)
    uns = {}
    for key, value in table.uns.items() if "uns" in slots else ():
        if isinstance(value, (Sparse, Dense, Table)):
            uns[key] = _describe(value, [f"v_{version}/uns/{key}"])
            _write_element(value, f"{path.rstrip('/')}/v_{version}/uns/{key}")
        else:
            uns[key] = encode_uns(value)
    old = _folders(json.loads(files.read(MANIFEST))) if files.exists(MANIFEST) else set()
    manifest = {
        "format": 1, "version": version, "shape": [table.n_obs, table.n_vars], "elements": entries, "uns": uns,
        "obs_index": encode_index(table.obs_index, path, f"v_{version}/obs_names") if "obs" in slots else None,
        "var_index": encode_index(table.var_index, path, f"v_{version}/var_names") if "var" in slots else None,
    }
    files.write(MANIFEST, json.dumps(manifest, ensure_ascii=False))
    for folder in old:
        files.delete(folder)
    return read(table.spark, path)


def _folder_of(element: Element, root: str) -> str | None:
    """The folder below ``root`` that holds the element's files and nothing else, if it is read from there as it is."""
    files = element.df.inputFiles()
    folders = {f.rsplit("/", 1)[0] for f in files}
    inside = f"{root.split('://')[-1].removeprefix('file:').rstrip('/')}/_parts/"
    return folders.pop() if len(folders) == 1 and inside in files[0] else None


def _folders(manifest: dict) -> set[str]:
    """The version folders that a manifest's files lie in."""
    paths = [p for e in (*manifest["elements"].values(), *manifest["uns"].values()) for p in e.get("paths", ())]
    paths += [x["path"] for x in (manifest["obs_index"], manifest["var_index"]) if x and "path" in x]
    return {f"v_{manifest['version']}"} | {p.split("/")[0] for p in paths if p.startswith("v_")}


def read(spark: SparkSession, path: str, mode: str = "r+") -> AxisTable:
    """Open a snapshot: only the manifest is read; elements are lazy.  A handle opened with mode ``r`` is not committed."""
    if mode not in ("r", "r+"):
        raise StoreError(f"mode is r or r+, not {mode!r}")
    files, root = Files(spark, path), path.rstrip("/")
    if not files.exists(MANIFEST):
        raise StoreError(f"no store at {path}")
    data = json.loads(files.read(MANIFEST))
    slots: dict[str, Any] = {s: {} for s in COLLECTIONS}
    for name, entry in data["elements"].items():
        slot, _, key = name.partition("/")
        element = _open_element(spark, root, entry)
        if key:
            slots[slot][key] = element
        else:
            slots[slot] = element
    uns = {k: _open_element(spark, root, v) if "paths" in v else decode_uns(v) for k, v in data["uns"].items()}
    return AxisTable(spark, *data["shape"], obs_index=decode_index(data["obs_index"], spark, root), var_index=decode_index(data["var_index"], spark, root), uns=uns, path=root, mode=mode, **slots)


def create(spark: SparkSession, path: str) -> AxisTable:
    """An empty store, replacing what the path held."""
    Files(spark, path).delete()
    return write(AxisTable(spark), path)


def attributes(spark: SparkSession, path: str, element: str = "") -> dict:
    """Free JSON attributes of a store or of one of its elements (a slot, or slot/key)."""
    files = Files(spark, path)
    return json.loads(files.read("attributes.json")).get(element, {}) if files.exists("attributes.json") else {}


def set_attribute(spark: SparkSession, path: str, key: str, value: Any, element: str = "") -> None:
    """Set an attribute; None deletes it."""
    files = Files(spark, path)
    known = json.loads(files.read("attributes.json")) if files.exists("attributes.json") else {}
    kept = {k: v for k, v in known.get(element, {}).items() if k != key} | ({} if value is None else {key: value})
    files.write("attributes.json", json.dumps(known | {element: kept}))


def write_rows(spark: SparkSession, path: str, slot: str, selection: Selection, values: Element) -> AxisTable:
    """Put the rows of ``values`` in the place of the selected rows of a stored element; the other rows stay."""
    table = read(spark, path)
    element = _slot(table, slot)
    if values.kind != element.kind or values.shape[1:] != element.shape[1:] or values.shape[0] != len(selection):
        raise StoreError(f"{values.shape} does not fit {len(selection)} rows of {element.shape}")
    key = "ix" if element.kind == "table" else "i"
    if isinstance(selection, Range):
        hit, place = selection.keeps(F.col(key)), spark.range(len(selection)).select(F.col("id").alias("new"), ((F.lit(selection.start) if selection.step > 0 else F.lit(selection.stop - 1)) + F.col("id") * selection.step).alias("old"))
        kept = element.df.where(~hit)
    else:
        place = selection.df if isinstance(selection, Places) else positions_frame(spark, selection)
        kept = element.df.join(place.select(F.col("old").alias(key)), key, "left_anti")
    moved = values.df.join(place, F.col(key) == F.col("new")).withColumn(key, F.col("old")).select(*[quoted(c) for c in element.df.columns])
    changed = replace(element, df=kept.select(*[quoted(c) for c in element.df.columns]).unionByName(moved))
    name, _, inner = slot.partition("/")
    return write(table.set(name, changed, inner or None), path, mode="commit")


def _slot(table: AxisTable, slot: str) -> Element | None:
    name, _, key = slot.partition("/")
    return getattr(table, name).get(key) if key else getattr(table, name)


def append_rows(spark: SparkSession, path: str, chunks, slot: str = "X", anew: bool = False) -> AxisTable:
    """Grow an element by an iterator of elements of its type and width, below the rows it has (with ``anew``, from none):
    each is appended as files, the manifest is replaced when all are written, and a chunk that does not fit, or a length
    that does not fit the rest of the axis, leaves the store as it was."""
    table, out = read(spark, path), f"v_{uuid.uuid4().hex[:8]}/{slot}"
    before = None if anew else _slot(table, slot)
    first, offset = before, before.shape[0] if before is not None else 0
    files = Files(spark, path)
    data = json.loads(files.read(MANIFEST))
    replaced = data["elements"].pop(slot, None)
    wrote = False
    try:
        for chunk in chunks:
            first = chunk if first is None else first
            if _form(chunk) != _form(first):
                raise StoreError(f"a chunk of {_form(chunk)} after {_form(first)}")
            rows = chunk.shift_rows(offset)
            if chunk.kind == "table":
                rows = rows.select(*[quoted(c) for c in first.df.columns])
            rows.write.mode("append").option("compression", "zstd").parquet(f"{path.rstrip('/')}/{out}")
            offset, wrote = offset + chunk.shape[0], True
        if not wrote:
            return table
        whole = replace(first, n=offset) if first.kind == "table" else replace(first, shape=(offset, *first.shape[1:]))
        data["elements"][slot] = _describe(whole, [*(replaced["paths"] if before is not None else ()), out])
        name, _, key = slot.partition("/")
        # The axis takes the new length where nothing else lies on it.
        alone = replace(table.set(name, None, key or None), n_obs=None, n_vars=None)
        fixed = [n if any(a == axis for s, _ in alone.elements() for a in AXES[s.split("/")[0]]) or (table.obs_index, table.var_index)[axis] is not None else None for axis, n in enumerate(data["shape"])]
        grown = replace(alone, n_obs=fixed[0], n_vars=fixed[1]).set(name, whole, key or None)
        data["shape"] = [grown.n_obs, grown.n_vars]
    except Exception:
        files.delete(out)
        raise
    files.write(MANIFEST, json.dumps(data, ensure_ascii=False))
    if replaced and before is None:
        for folder in replaced["paths"]:
            files.delete(folder)
    return read(spark, path)


def _form(element: Element) -> tuple:
    if element.kind == "table":
        return element.kind, tuple(sorted((f.name, f.dataType.simpleString()) for f in element.df.schema))
    return element.kind, element.shape[1:], element.dtype
