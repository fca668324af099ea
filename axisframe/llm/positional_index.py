"""Held-out texts inside a corpus, by a distributed positional inverted index.

The corpus is indexed by document shards: each task turns its documents into rows of a stored index, each row a shard of
some thousand documents with, for every term, the sorted list of its positions.  A search sends the test windows to all
shards.  In a shard a window starts from its rarest term; the terms' position lists, each shifted by the term's offset,
are intersected from the rarest term upwards, so most windows end after one list.  Positions leave a gap between
documents, so no match crosses them.

Nothing is shuffled by term: a term that a third of all documents hold only makes lists longer that are rarely
consulted.  The index is written to the shared folder and can serve many searches.

Words are the longest runs of letters and numbers (Unicode L and N) in lower case, after each ``=`` that ends a line has
been removed with its line end.  Defined cases: null and empty texts have no words; items shorter than the window have
no windows; repeated documents and items give the same pairs, once; texts of any length are indexed whole; other columns
do not matter; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.codepoints import LETTER, NUMBER, blocks, class_table, flatten, lower_table, spread
from axisframe.llm.shared_spans import _BASES, _INVERSES, _ROOT, _mix
from axisframe.workspace import materialize, ship_package

_INDEX = "doc_ids array<long>, doc_starts array<int>, terms array<long>, term_starts array<int>, positions array<int>"
_BIG_SIGMA, _SMALL_SIGMA, _LAST_SIGMA = 0x3A3, 0x3C3, 0x3C2


class Words:
    """Splits texts into words and hashes each to 64 bits."""

    def __init__(self, classes: np.ndarray, lower: np.ndarray):
        self.is_word = (classes == LETTER) | (classes == NUMBER)
        self.lower = lower
        self.powers = self.inverses = np.ones(0, np.uint64)

    @staticmethod
    def tables() -> tuple[np.ndarray, np.ndarray]:
        return class_table(), lower_table()

    def _power(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", _BASES[0]), ("inverses", _INVERSES[0])):
                values = np.full(max(n, 1 << 16), base, np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values, dtype=np.uint64))

    def __call__(self, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of flat texts, and where each text's words start."""
        n = len(chars)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
        first = np.zeros(n + 1, bool)
        first[starts] = True
        # Soft line breaks: '=' LF and '=' CR LF, inside one text.
        equals = np.flatnonzero(chars[:-1] == 61)
        equals = equals[~first[equals + 1]]
        feed = equals[chars[equals + 1] == 10]
        both = equals[(chars[equals + 1] == 13) & (equals + 2 < n)]
        both = both[(chars[both + 2] == 10) & ~first[both + 2]]
        drop = np.r_[feed, feed + 1, both, both + 1, both + 2]
        if len(drop):
            keep = np.ones(n, bool)
            keep[drop] = False
            starts = np.r_[0, np.cumsum(keep)][starts]
            chars = chars[keep]
            n = len(chars)
            first = np.zeros(n + 1, bool)
            first[starts] = True
        word = np.zeros(n + 1, bool)
        word[:n] = self.is_word[chars]
        begin = word[:n].copy()
        begin[1:] &= ~word[: n - 1] | first[1:n]
        begin = np.flatnonzero(begin)
        last = word[:n] & (~word[1:] | first[1:])
        end = np.flatnonzero(last) + 1
        low = self.lower[chars]
        sigma = np.flatnonzero(chars == _BIG_SIGMA)
        if len(sigma):
            ends_word = last[sigma] & ~np.isin(sigma, begin)
            low[sigma] = np.where(ends_word, _LAST_SIGMA, _SMALL_SIGMA)
        self._power(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix((low.astype(np.uint64) + np.uint64(1)) * _ROOT) * self.powers[:n], out=sums[1:])
        return _mix((sums[end] - sums[begin]) * self.inverses[begin]), np.searchsorted(begin, starts)

    def of(self, texts: pa.Array, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """The same for an Arrow column.  A very long text goes in parts, cut after spaces."""
        if len(texts) == 1 and texts[0].is_valid and len(text := texts[0].as_py()) > most:
            hashes, at = [], 0
            while at < len(text):
                cut = text.rfind(" ", at, at + most) + 1
                cut = cut if cut > at else (text.find(" ", at + most) + 1 or len(text))
                cut = len(text) if at + most >= len(text) else cut
                hashes.append(self(*flatten(pa.array([text[at:cut]])))[0])
                at = cut
            return np.concatenate(hashes), np.array([0, sum(map(len, hashes))])
        return self(*flatten(texts))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 4_000_000) -> DataFrame:
    """The stored index: one row a shard (see the module).  Narrow: each task indexes what it reads."""
    ship_package(df.sparkSession)
    tables = df.sparkSession.sparkContext.broadcast(Words.tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(*tables.value)
        for batch in batches:
            for a, b in blocks(batch.column(1), shard_bytes):
                hashes, starts = words.of(batch.column(1).slice(a, b - a))
                # One free position between documents.
                position = np.arange(len(hashes)) + np.repeat(np.arange(b - a), np.diff(starts))
                order = np.argsort(hashes, kind="stable")
                ordered = hashes[order]
                term = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, np.int64)
                row = (
                    batch.column(0).slice(a, b - a).to_numpy(), starts + np.arange(b - a + 1),
                    ordered[term].view(np.int64), np.r_[term, len(order)], position[order],
                )
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(k.to_pandas_dtype()))) for x, k in zip(row, kinds)],
                    names=["doc_ids", "doc_starts", "terms", "term_starts", "positions"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.length("text") > 0))
    return materialize(rows.mapInArrow(run, _INDEX), "positional_index")


@dataclass
class TestWindows:
    """The distinct windows of the test items: terms, windows as positions in terms, and the items of each window."""

    terms: np.ndarray
    windows: np.ndarray
    owner_starts: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, texts: pa.Array, width: int, words: Words) -> TestWindows:
        hashes, starts = words.of(texts) if len(texts) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        sizes = np.maximum(np.diff(starts) - width + 1, 0)
        at = spread(starts[:-1], sizes)
        owner = np.repeat(ids, sizes)
        terms, coded = np.unique(hashes.view(np.int64), return_inverse=True)
        windows = coded[at[:, None] + np.arange(width)].reshape(-1, width)
        distinct, which = np.unique(windows, axis=0, return_inverse=True)
        pairs = np.unique(np.c_[which.ravel(), owner].reshape(-1, 2), axis=0)
        return cls(terms, distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1])


def search_shard(shard: tuple, test: TestWindows, least: int, slop: int, most: int = 2_000_000) -> np.ndarray:
    """(document, item) pairs of one shard: documents where at least ``least`` words of a window of the item stand at
    their places, each at most ``slop`` words off.  Windows are taken together while the lists of their rarest terms have
    at most ``most`` positions in all, which bounds the memory whatever the words."""
    doc_ids, doc_starts, terms, term_starts, positions = shard
    width = test.windows.shape[1]
    if not len(terms) or not len(test.windows):
        return np.zeros((0, 2), np.int64)
    ordered = np.argsort(terms)  # stored in unsigned order
    at = ordered[np.minimum(np.searchsorted(terms, test.terms, sorter=ordered), len(terms) - 1)]
    present = terms[at] == test.terms
    begin = np.where(present, term_starts[at], 0)
    count = np.where(present, term_starts[at + 1] - term_starts[at], 0)
    # Forward view of the test terms' lists: which of them stands at each position.
    here = np.full(doc_starts[-1] + 2 * (width + slop) + 1, -1, np.int32)
    margin = width + slop
    here[margin + positions[spread(begin, count)]] = np.repeat(np.arange(len(count)), count)
    misses = width - least
    live = np.flatnonzero((count[test.windows] == 0).sum(1) <= misses)
    windows = test.windows[live]
    order = np.argsort(count[windows], axis=1, kind="stable")
    found = [np.zeros((0, 2), np.int64)]
    # With misses allowed, one of the (misses + 1) rarest terms must be in place: each of them seeds.
    for seed in range(misses + 1):
        offset = order[:, seed]
        term = windows[np.arange(len(windows)), offset]
        sizes = count[term]
        bounds = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(most, sizes.sum() + most, most), side="left")) + 1 if len(sizes) else np.zeros(0, int)
        for a, z in zip(np.r_[0, bounds], np.minimum(np.r_[bounds, len(windows)], len(windows))):
            n = sizes[a:z]
            window = np.repeat(np.arange(a, z), n)
            start = positions[spread(begin[term[a:z]], n)] - offset[window]
            missed = np.zeros(len(window), np.int8)
            for k in range(width):
                if k == seed:
                    continue
                o = order[window, k]
                want = windows[window, o]
                hit = np.zeros(len(window), bool)
                for d in range(-slop, slop + 1):
                    hit |= here[np.clip(margin + start + o + d, 0, len(here) - 1)] == want
                missed += ~hit
                keep = missed <= misses
                window, start, missed = window[keep], start[keep], missed[keep]
            found.append(np.c_[live[window], np.searchsorted(doc_starts, start + offset[window], side="right") - 1])
    hits = np.unique(np.concatenate(found), axis=0)
    sizes = np.diff(test.owner_starts)[hits[:, 0]]
    items = test.owners[spread(test.owner_starts[hits[:, 0]], sizes)]
    return np.unique(np.c_[doc_ids[np.repeat(hits[:, 1], sizes)], items], axis=0)


def search(
    index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 12,
    least: int | None = None, slop: int = 0, block_chars: int = 8_000_000,
) -> DataFrame:
    """(doc_id, item_col): documents that hold ``width`` consecutive words of an item, as exact phrases by default; with
    ``least`` < width or ``slop`` > 0, as proximity matches.  The items are the stated query set: they go to the shards
    in blocks of at most about ``block_chars`` characters, however many there are."""
    spark = index.sparkSession
    ship_package(spark)
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    asked = asked.where(F.col("item").isNotNull() & (F.length("text") >= 2 * width - 1))
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    block_count = -(-total // block_chars) or 1
    parts, words = [], Words(*Words.tables())
    for block in range(block_count):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(block_count)) == block).toArrow()
        texts = rows["text"].combine_chunks() if len(rows) else pa.array([], pa.string())
        test = spark.sparkContext.broadcast(TestWindows.of(rows["item"].to_numpy(), texts, width, words))

        def run(batches: Iterator[pa.RecordBatch], test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(len(batch)):
                    shard = tuple(batch.column(k)[n].values.to_numpy() for k in range(5))
                    pairs = search_shard(shard, test.value, least or width, slop)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "item"])

        parts.append(index.mapInArrow(run, "doc_id long, item long"))
    return reduce(DataFrame.unionByName, parts).distinct().withColumnRenamed("item", item_col)


def leaked(documents: DataFrame, items: DataFrame, width: int = 12) -> DataFrame:
    """(doc_id, item_id): build the index of ``documents`` and find every exact phrase of ``width`` words."""
    return search(build_index(documents), items, width=width)
