"""Texts as flat numpy arrays of code points: shared by the operators that split or hash whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def class_table() -> np.ndarray:
    """Class of every code point: letter (Unicode L), number (N), white space, or other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(start, stop)))
        for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for found in regex.finditer(name, every):
                table[start + found.start() : start + found.end()] = kind
    return table


def lower_table() -> np.ndarray:
    """Lower case of every code point that has one of a single character, else the code point itself."""
    table = np.arange(0x110000, dtype=np.uint32)
    for n in range(0x110000):
        if not 0xD800 <= n < 0xE000:
            low = chr(n).lower()
            if len(low) == 1:
                table[n] = ord(low)
    return table


def blocks(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` each, so that a batch of long texts needs no more memory than another."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for n, size in enumerate(sizes.tolist()):
        if total and total + size > most_bytes:
            yield start, n
            start, total = n, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points, one text after another, and where each text starts (one more than there are texts)."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    joined = "".join(x for x in texts.to_pylist() if x)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then the same from starts[1], and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
