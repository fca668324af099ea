"""A lazy dataset: an annotation container over children that are stacked on obs and share the var axis."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe import store
from axisframe.axis_index import FrameIndex, equal
from axisframe.elements import Dense, Element, ShapeError, Sparse, Table, stack_select, vstack
from axisframe.model import AxisTable, same
from axisframe.selection import FULL, Range, Selection

REGISTRY = "dataset.json"


def common_columns(tables: Sequence[DataFrame]) -> list[str]:
    """Columns of the first table that all have, in its order."""
    return [c for c in tables[0].columns if all(c in t.columns for t in tables)]


def stacked_table(tables: Sequence[Table]) -> Table:
    """Tables one below the other, with their common columns."""
    kept = common_columns([t.df for t in tables])
    return vstack([replace(t, df=t.df.select(*kept)) for t in tables])


def stacked_arrays(children: Sequence[Mapping[str, Element]]) -> tuple[dict[str, Element], list[str]]:
    """Arrays under keys that all children have and that fit together; and the keys that do not fit."""
    out, misfits = {}, []
    for key in children[0] if children else ():
        if all(key in c for c in children):
            try:
                elements = [c[key] for c in children]
                out[key] = stacked_table(elements) if all(e.kind == "table" for e in elements) else vstack(elements)
            except ShapeError:
                misfits.append(key)
    return out, misfits


def keyed_union(frames: Sequence[tuple[str, DataFrame]], key_column: str) -> DataFrame:
    """A union with a literal key for each branch; a filter on the key leaves a single scan."""
    return reduce(DataFrame.unionByName, [df.withColumn(key_column, F.lit(key)) for key, df in frames])


@dataclass(frozen=True)
class AxisDataset:
    """Children by key, in order.  ``annotation`` holds what belongs to the dataset itself."""

    spark: SparkSession
    children: Mapping[str, AxisTable]
    annotation: AxisTable
    add_key: str = "sample"
    paths: Mapping[str, str] | None = None

    @classmethod
    def of(cls, children: Mapping[str, AxisTable] | Sequence[tuple[str, AxisTable]], add_key: str = "sample", paths: Mapping[str, str] | None = None) -> AxisDataset:
        pairs = list(children.items()) if isinstance(children, Mapping) else list(children)
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("keys of children must differ")
        tables = dict(pairs)
        if not tables:
            raise ValueError("a dataset needs children")
        first = next(iter(tables.values()))
        for key, t in tables.items():
            if not equal(t._names(1), first._names(1)):
                raise ShapeError(f"var names of {key!r} differ from those of the first child")
        frames = [(k, first.spark.range(t.shape[0]).select((F.col("id") + off).alias("ix"))) for (k, t), off in zip(tables.items(), _offsets(tables.values()))]
        n = sum(t.shape[0] for t in tables.values())
        obs = Table(keyed_union(frames, add_key), n)
        names = None
        if all(t.obs_index is not None for t in tables.values()):
            parts = [t.obs_index.frame(first.spark).select((F.col("ix") + off).alias("ix"), "name") for t, off in zip(tables.values(), _offsets(tables.values()))]
            names = FrameIndex(reduce(DataFrame.unionByName, parts), n)
        annotation = AxisTable(first.spark, n, first.n_vars, obs=obs, obs_index=names, var_index=first.var_index, uns=shared_uns(list(tables.values())))
        return cls(first.spark, tables, annotation, add_key, paths)

    @property
    def shape(self) -> tuple[int, int]:
        return self.annotation.shape

    @property
    def lengths(self) -> list[int]:
        return [t.shape[0] for t in self.children.values()]

    @property
    def X(self) -> Element | None:
        parts = [t.X for t in self.children.values()]
        return vstack(parts) if all(p is not None for p in parts) else None

    def set(self, slot: str, value: Any, key: str | None = None) -> AxisDataset:
        if slot == "X":
            raise TypeError("X of a dataset lies in its children and cannot be set")
        return replace(self, annotation=self.annotation.set(slot, value, key))

    @property
    def obs(self) -> Table | None:
        """The dataset's own obs: the key column and what was set."""
        return self.annotation.obs

    @property
    def var(self) -> Table | None:
        return self.annotation.var

    @property
    def uns(self) -> Mapping[str, Any]:
        return self.annotation.uns

    @property
    def obsm(self) -> dict[str, Element]:
        """The dataset's own arrays, and the children's stacked ones under keys that it has not."""
        return {**self.child_obsm(), **self.annotation.obsm}

    @property
    def varm(self) -> Mapping[str, Element]:
        return self.annotation.varm

    @property
    def obsp(self) -> Mapping[str, Element]:
        return self.annotation.obsp

    @property
    def varp(self) -> Mapping[str, Element]:
        return self.annotation.varp

    @property
    def obs_names(self) -> list[str]:
        return self.annotation.obs_names

    @property
    def var_names(self) -> list[str]:
        return self.annotation.var_names

    def flattened(self) -> DataFrame:
        """(ix, child, local): the child and the position in it of every stacked position, by literal offsets."""
        frames = [(k, self.spark.range(n).select((F.col("id") + off).alias("ix"), F.col("id").alias("local"))) for k, n, off in zip(self.children, self.lengths, _offsets(self.children.values()))]
        return keyed_union(frames, "child")

    def subset(self, obs=FULL, var=FULL) -> AxisTable:
        """Rows and columns as one container, resolved to each child; rows as in :meth:`AxisTable.subset`."""
        return self.to_table(obs, var)

    def __getitem__(self, what) -> AxisTable:
        return self.subset(*what) if isinstance(what, tuple) else self.subset(what)

    def child_obs(self) -> Table | None:
        parts = [t.obs for t in self.children.values()]
        return stacked_table(parts) if all(p is not None for p in parts) else None

    def child_obsm(self) -> dict[str, Element]:
        return stacked_arrays([t.obsm for t in self.children.values()])[0]

    def select_x(self, obs: Selection, var: Selection | None = None) -> Element:
        """Rows of the stacked X, resolved to each child before any offset."""
        return stack_select([t.X for t in self.children.values()], obs, var or Range(0, self.shape[1]))

    def locate(self, position: int) -> tuple[str, int]:
        """The child of a stacked position, and the position in it."""
        for key, n in zip(self.children, self.lengths):
            if position < n:
                return key, position
            position -= n
        raise IndexError(position)

    def to_table(self, obs=FULL, var=FULL, copy_x: bool = True, file: str | None = None) -> AxisTable:
        """One container with the dataset's annotation, the stacked X, and the stacked obsm under keys of its own; with
        ``file`` it is written there and opened."""
        a = self.annotation
        arrays = {k: v for k, v in self.child_obsm().items() if k not in a.obsm}
        table = replace(a, obsm={**arrays, **a.obsm})
        chosen = table._selection(obs, 0), table._selection(var, 1)
        out = table.subset(*chosen)
        x = self.X if copy_x else None
        out = out.set("X", self.select_x(*chosen)) if x is not None else out
        return out if file is None else store.write(out, file)

    def into_table(self, file: str | None = None) -> AxisTable:
        """:meth:`to_table` of all, after which the children and the annotation are closed; with ``file`` only, as the
        result would read from closed handles otherwise."""
        out = self.to_table(file=file)
        for t in (*self.children.values(), self.annotation) if file else ():
            t.close()
        return out

    def write(self, path: str, relative: bool = True) -> AxisDataset:
        """Write the annotation and the registry of children; children without a path are written beside it."""
        files, paths = store.Files(self.spark, path), {}
        children = {}
        for key, t in self.children.items():
            where = t.path or store.write(t, f"{path}/children/{key}").path
            children[key] = t if t.path else store.read(self.spark, where)
            paths[key] = os.path.relpath(where, path) if relative and "://" not in where else where
        store.write(self.annotation, f"{path}/annotation", mode="commit")
        files.write(REGISTRY, json.dumps({"keys": list(paths), "paths": list(paths.values()), "add_key": self.add_key}))
        return replace(self, children=children, paths=paths)

    def __repr__(self) -> str:
        return f"AxisDataset of {len(self.children)} children, n_obs x n_vars = {self.shape[0]} x {self.shape[1]}, {self.add_key!r} in obs"


def _offsets(tables) -> list[int]:
    out, total = [], 0
    for t in tables:
        out.append(total)
        total += t.shape[0]
    return out


def shared_uns(tables: Sequence[AxisTable]) -> dict[str, Any]:
    """Entries that all children have and that are equal."""
    def agree(a, b) -> bool:
        elements = isinstance(a, (Sparse, Dense, Table)), isinstance(b, (Sparse, Dense, Table))
        return same(a, b) if all(elements) else not any(elements) and type(a) is type(b) and a == b

    first = tables[0].uns
    return {k: v for k, v in first.items() if all(k in t.uns and agree(t.uns[k], v) for t in tables[1:])}


def resolve_paths(path: str, registry: dict, at: Mapping[str, str] | str | None = None, found=None) -> dict[str, str]:
    """Where the children are: relative paths start at the dataset's (real) folder; ``at`` relocates them, by key or to
    a folder that holds them under their own names.  ``found`` tells whether a store is at a place: a child that is not in
    the new folder keeps its old path."""
    base = os.path.realpath(path) if "://" not in path else path
    whole = lambda p: p if p.startswith("/") or "://" in p else os.path.normpath(f"{base}/{p}") if "://" not in base else f"{base}/{p}"
    out = {}
    for key, p in zip(registry["keys"], registry["paths"]):
        out[key] = whole(p)
        if isinstance(at, Mapping) and key in at:
            out[key] = whole(at[key])
        elif isinstance(at, str):
            moved = whole(f"{at.rstrip('/')}/{p.rstrip('/').rsplit('/', 1)[-1]}")
            out[key] = moved if found is None or found(moved) else out[key]
    return out


def open_dataset(spark: SparkSession, path: str, at: Mapping[str, str] | str | None = None) -> AxisDataset:
    """Open a dataset; with ``at`` its registry is rewritten to the children's new places once all of them are open."""
    files = store.Files(spark, path)
    registry = json.loads(files.read(REGISTRY))
    paths = resolve_paths(path, registry, at, lambda p: store.Files(spark, p).exists(store.MANIFEST))
    children = {k: store.read(spark, p) for k, p in paths.items()}
    if at is not None:
        files.write(REGISTRY, json.dumps(registry | {"paths": list(paths.values())}))
    return AxisDataset(spark, children, store.read(spark, f"{path}/annotation"), registry["add_key"], paths)
