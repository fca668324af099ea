"""Formats whose libraries may be missing: HDF5 and Zarr.  The choice of a format by name or extension."""

from __future__ import annotations

import importlib

#: Encoding tags of the file formats, and the element that each becomes.
ENCODINGS = {
    "array": "dense", "string-array": "dense", "csr_matrix": "sparse", "csc_matrix": "sparse", "dataframe": "table",
    "categorical": "categorical", "nullable-integer": "nullable", "nullable-boolean": "nullable", "dict": "mapping",
    "string": "scalar", "numeric-scalar": "scalar",
}
#: The library and the file extensions of each format.
_LIBRARIES = {"hdf5": "h5py", "zarr": "zarr"}
_EXTENSIONS = {".h5ad": "hdf5", ".h5": "hdf5", ".hdf5": "hdf5", ".zarr": "zarr"}


class MissingLibrary(ImportError):
    """A format that needs a library which is not installed."""


def format_of(path: str, chosen: str | None = None) -> str:
    """The format named, or that of the extension; Parquet otherwise."""
    if chosen is not None:
        if chosen not in (*_LIBRARIES, "parquet"):
            raise ValueError(f"no such format: {chosen}")
        return chosen
    return next((f for e, f in _EXTENSIONS.items() if path.lower().rstrip("/").endswith(e)), "parquet")


def library(fmt: str):
    try:
        return importlib.import_module(_LIBRARIES[fmt])
    except ImportError as e:
        raise MissingLibrary(f"reading {fmt} needs the library {_LIBRARIES[fmt]}, which is not installed") from e


def element_kind(attributes: dict) -> str:
    """What a group or dataset of a file is, by its ``encoding-type``; without one an array."""
    tag = attributes.get("encoding-type", "array")
    if tag not in ENCODINGS:
        raise ValueError(f"unknown encoding {tag!r}")
    return ENCODINGS[tag]


def sparse_entries(data, indices, indptr, shape, layout: str):
    """(i, j, v) of compressed rows or columns; repeated coordinates keep their order."""
    import numpy as np

    major = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    if len(indptr) - 1 != shape[0 if layout == "csr" else 1] or len(data) != len(indices) or (len(indices) and max(indices) >= shape[1 if layout == "csr" else 0]):
        raise ValueError("offsets and indices do not fit the shape")
    return (major, np.asarray(indices), np.asarray(data)) if layout == "csr" else (np.asarray(indices), major, np.asarray(data))


def decode(group) -> object:
    """A local object from an open group or dataset of either library: arrays, (i, j, v, shape), columns or mappings."""
    import numpy as np

    kind = element_kind(dict(group.attrs))
    if kind == "dense":
        return np.asarray(group[...])
    if kind == "sparse":
        shape = tuple(int(n) for n in group.attrs["shape"])
        layout = "csr" if group.attrs["encoding-type"] == "csr_matrix" else "csc"
        return (*sparse_entries(group["data"][...], group["indices"][...], group["indptr"][...], shape, layout), shape)
    if kind == "table":
        return {c: decode(group[c]) for c in group.attrs["column-order"]}
    if kind == "categorical":
        names, codes = np.asarray(group["categories"][...], object), np.asarray(group["codes"][...])
        return np.array([None if c < 0 else names[c] for c in codes], object)
    if kind == "nullable":
        return np.ma.masked_array(group["values"][...], group["mask"][...])
    if kind == "mapping":
        return {k: decode(group[k]) for k in group}
    return group[()]


def read_file(path: str, chosen: str | None = None) -> dict:
    """All top-level elements of an HDF5 or Zarr file, decoded on the driver."""
    fmt = format_of(path, chosen)
    if fmt == "parquet":
        raise ValueError("a Parquet snapshot is opened with axisframe.store.read")
    lib = library(fmt)
    root = lib.File(path, "r") if fmt == "hdf5" else lib.open(path, mode="r")
    return {k: decode(root[k]) for k in root}
