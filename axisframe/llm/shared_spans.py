"""Long exact spans shared between records: count-min prefilter, then exact grouping of what may repeat.

Every window of ``span`` characters of every text is covered, at every offset.  A window's *key* is the smallest hash
among its ``gram``-character substrings, so equal windows have equal keys, and neighbouring windows mostly share one:
a text becomes a short list of (key, range of windows).

1. Each partition counts, in a count-min sketch, in how many texts each key occurs; the partitions' sketches are added
   up.  A sketch can only overestimate, so a key whose estimate is below two occurs in one text only and is dropped;
   no repeated window is lost, whatever the width.
2. The ranges under the other keys go out without their text and are counted exactly by key: keys of a single id leave
   here, also where the corpus is too large for the sketch to tell them, so text is shipped for repeated keys only.
3. The slices of text under repeated keys go to the task of their key, where the windows are grouped exactly; those found
   in two different ids are shared.
4. Keys whose slices have more than ``hot`` characters in all (a boilerplate passage in a third of all mails, say) would
   make one task large.  Their windows are grouped by window instead, aggregated before the shuffle.
5. Shared windows unite to the largest runs of shared characters of each text.

Defined cases: null, empty and short texts share nothing; texts of any length are covered whole (in pieces that overlap
by span - 1); rows that repeat an id count as one record; copies of a text under different ids share all of it; other
columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.llm.codepoints import flatten
from axisframe.workspace import materialize, ship_package

_BLOCK = 1 << 16
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xA3EC647659359ACD))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_PIECE = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= _ROOT
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of all substrings of one length, from running sums; ``which`` picks one of two independent hashes."""

    def __init__(self, which: int):
        self.which, self.powers, self.inverses = which, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def __call__(self, chars: np.ndarray, length: int) -> np.ndarray:
        n = len(chars)
        if n < length:
            return np.zeros(0, np.uint64)
        if len(self.powers) < n:
            room = max(n, 1 << 16)
            for name, base in (("powers", _BASES[self.which]), ("inverses", _INVERSES[self.which])):
                values = np.full(room, base, np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values, dtype=np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix((chars.astype(np.uint64) + np.uint64(1 + self.which)) * _ROOT) * self.powers[:n], out=sums[1:])
        out = sums[length:] - sums[:-length]
        out *= self.inverses[: len(out)]
        return _mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def pieces(batch: pa.RecordBatch, span: int, most: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch as flat arrays of at most about ``most`` windows: code points, start of each piece (and the
    end), row of each piece, offset of each piece in its text.  Long texts give several pieces that overlap by
    span - 1, so that every window lies in exactly one."""
    texts = batch.column(1)
    for a, b in _rows(texts, most):
        chars, starts = flatten(texts.slice(a, b - a))
        rows = np.flatnonzero(np.diff(starts) >= span)
        if not len(rows):
            continue
        if b - a == 1 and len(chars) > most + span:
            for at in range(0, len(chars) - span + 1, most):
                part = chars[at : at + most + span - 1]
                yield part, np.array([0, len(part)]), np.array([a]), np.array([at])
        else:
            yield chars, starts, np.arange(a, b), np.zeros(b - a, np.int64)


def _rows(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for n, size in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if total and total + size > most:
            yield start, n
            start, total = n, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def key_ranges(chars: np.ndarray, starts: np.ndarray, span: int, gram: int, roll: Rolling):
    """Ranges of windows under one key: key, piece, first and last window (offsets in the piece)."""
    keys = sliding_min(roll(chars, gram), span - gram + 1)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(keys)]
    inside = np.arange(len(keys)) + span <= starts[owner + 1]
    change = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]
    change[1:] |= inside[1:] != inside[:-1]
    at = np.flatnonzero(change)
    last = np.r_[at[1:], len(keys)] - 1
    at, last = at[inside[at]], last[inside[at]]
    return keys[at], owner[at], at - starts[owner[at]], last - starts[owner[at]]


def _cells(keys: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """Counter of each key in each row of the sketch."""
    return [(_mix(keys + np.uint64(d * 7919 + 1)) >> np.uint64(64 - bits)).astype(np.int64) for d in range(depth)]


def _sketch(texts: DataFrame, span: int, gram: int, depth: int, bits: int) -> np.ndarray:
    """The merged sketch as it is needed: one bit a counter for 'two or more'."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, pending, size = Rolling(0), [], 0

        def out() -> pa.RecordBatch:
            cells = np.concatenate(pending)
            cell, n = np.unique(cells, return_counts=True)
            block = cell >> 16
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = pa.array(np.r_[first, len(cell)].astype(np.int32))
            low = pa.ListArray.from_arrays(ends, pa.array((cell & (_BLOCK - 1)).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(block[first]), low, pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], names=["block", "cells", "n"])

        for batch in batches:
            for chars, starts, rows, _ in pieces(batch, span):
                keys, piece, _, _ = key_ranges(chars, starts, span, gram, roll)
                order = np.lexsort((keys, piece))
                keys, piece = keys[order], piece[order]
                once = np.r_[True, (keys[1:] != keys[:-1]) | (piece[1:] != piece[:-1])]
                for d, cells in enumerate(_cells(keys[once], depth, bits)):
                    pending.append(cells + (d << bits))
                    size += len(cells)
                if size > 4_000_000:
                    yield out()
                    pending, size = [], 0
        if pending:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], names=["block", "two"])

        now, total = None, np.zeros(_BLOCK, np.int64)
        for batch in batches:  # sorted by block: one array of counters at a time, however many parts there are
            for n, block in enumerate(batch.column(0).to_pylist()):
                if block != now:
                    if now is not None:
                        yield out()
                    now, total = block, np.zeros(_BLOCK, np.int64)
                total[batch.column(1)[n].values.to_numpy()] += batch.column(2)[n].values.to_numpy()
        if now is not None:
            yield out()

    counted = texts.mapInArrow(count, "block long, cells array<int>, n array<int>")
    two = np.zeros(depth << (bits - 3), np.uint8)
    merged = counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, two binary")
    for row in merged.toLocalIterator():
        two[row.block << 13 : (row.block + 1) << 13] = np.frombuffer(row.two, np.uint8)
    return two


def _estimated(keys: np.ndarray, two: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Which keys the sketch takes for repeated."""
    repeated = np.ones(len(keys), bool)
    for d, cells in enumerate(_cells(keys, depth, bits)):
        cells = cells + (d << bits)
        repeated &= (two[cells >> 3] >> (7 - (cells & 7)) & 1).astype(bool)
    return repeated


def _runs(hit: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of hits of one owner."""
    at = np.flatnonzero(hit)
    new = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return at[first], at[np.r_[first[1:], len(at)] - 1] if len(at) else at


def shared_windows(slices: list[str], ids: np.ndarray, span: int, rolls: tuple[Rolling, Rolling]):
    """Exact grouping: runs of windows that stand in slices of two different ids: slice, first and last window."""
    sizes = np.array([len(s) for s in slices])
    starts = np.r_[0, np.cumsum(sizes)]
    chars = np.frombuffer("".join(slices).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(slices)), sizes)[: len(chars) - span + 1]
    at = np.flatnonzero(np.arange(len(owner)) + span <= starts[owner + 1])
    owner = owner[at]
    one, other = (r(chars, span)[at] for r in rolls)
    order = np.argsort(one, kind="stable")
    same = one[order][1:] == one[order][:-1]
    if (other[order][1:] != other[order][:-1])[same].any():
        order = np.lexsort((other, one))
        same = (one[order][1:] == one[order][:-1]) & (other[order][1:] == other[order][:-1])
    group = np.r_[0, np.cumsum(~same)]
    first = np.flatnonzero(np.r_[True, ~same])
    who = ids[owner[order]]
    mixed = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
    hit = np.zeros(len(at), bool)
    hit[order] = mixed[group]
    # Windows of one slice are neighbours in ``at``; slices are set apart by their owner.
    a, b = _runs(hit, owner)
    return owner[a], at[a] - starts[owner[a]], at[b] - starts[owner[b]]


def repeated_ranges(texts: DataFrame, span: int, gram: int, depth: int, bits: int) -> DataFrame:
    """(key, id, tag, at, last): the ranges of windows whose key the sketch takes for repeated, without their text, from
    texts (id, text, tag); ``last`` is the offset of the last window."""
    sketch = texts.sparkSession.sparkContext.broadcast(_sketch(texts, span, gram, depth, bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, two = Rolling(0), sketch.value
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for chars, starts, rows, offsets in pieces(batch, span):
                keys, piece, first, last = key_ranges(chars, starts, span, gram, roll)
                use = _estimated(keys, two, depth, bits)
                keys, piece, first, last = keys[use], piece[use], first[use], last[use]
                columns = keys.view(np.int64), ids[rows[piece]], tags[rows[piece]], offsets[piece] + first, offsets[piece] + last
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "tag", "at", "last"])

    return texts.mapInArrow(emit, "key long, id long, tag long, at long, last long")


def _slices(texts: DataFrame, ranges: DataFrame, span: int) -> DataFrame:
    """(key, id, at, slice): the text of each range."""
    lists = ranges.groupBy("id", "tag").agg(F.collect_list("key").alias("keys"), F.collect_list("at").alias("ats"), F.collect_list("last").alias("lasts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ats, lasts = (batch.column(k) for k in (2, 3, 4))
            ends = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            keys, ats, lasts = (c.flatten().to_numpy() for c in (keys, ats, lasts))
            ids = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
            texts_ = batch.column(1)
            size, start = 0, 0
            for n in range(len(batch)):
                # Batches of bounded size, however many ranges a text has.
                size += int((lasts[ends[n] : ends[n + 1]] - ats[ends[n] : ends[n + 1]]).sum()) + span * int(ends[n + 1] - ends[n])
                if size > 4_000_000 or n + 1 == len(batch):
                    found = []
                    for k in range(start, n + 1):
                        text = texts_[k].as_py()
                        found += [text[a : b + span] for a, b in zip(ats[ends[k] : ends[k + 1]].tolist(), lasts[ends[k] : ends[k + 1]].tolist())]
                    a, b = ends[start], ends[n + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(ids[a:b]), pa.array(ats[a:b]), pa.array(found, pa.string())], names=["key", "id", "at", "slice"])
                    size, start = 0, n + 1

    joined = texts.join(lists, ["id", "tag"]).select("id", "text", "keys", "ats", "lasts")
    return joined.mapInArrow(cut, "key long, id long, at long, slice string")


def shared_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, gram: int = 64,
    depth: int = 2, bits: int | None = None, most_bits: int = 28, hot: int = 2_000_000,
) -> DataFrame:
    """(id_col, span_start, span_end): the largest runs of characters that lie in a stretch of at least ``span``
    characters which stands verbatim under another id too.  ``id_col`` must be integral.

    ``bits``: counters of a row of the sketch, as a power of two; by default from the total number of characters, at
    most ``most_bits``, which bounds what is broadcast (a bit each, 64 MB at 28).  Beyond it the sketch lets more keys
    through to their exact count (some 40 bytes for 75 characters of text); the result is the same.
    """
    spark = df.sparkSession
    ship_package(spark)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # The tag tells texts apart that share an id.
    texts = texts.where((F.length("text") >= span) & F.col("id").isNotNull()).withColumn("tag", F.xxhash64("text"))
    if bits is None:
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        bits = min(most_bits, max(17, int(np.ceil(np.log2(1 + 8 * chars / (span - gram))))))
    ranges = materialize(repeated_ranges(texts, span, gram, depth, bits), "ranges")
    size = F.sum(F.col("last") - F.col("at") + span)
    counted = ranges.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), size.alias("chars"))
    keys = materialize(counted.where("least < most").select("key", (F.col("chars") > hot).alias("hot")), "keys")
    # Once each, should a record have been delivered again and again.
    kept = ranges.join(keys, "key").dropDuplicates(["key", "id", "tag", "at", "last"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls, most = (Rolling(0), Rolling(1)), 1_000_000

        def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            ids, at = t["id"].to_numpy(), t["at"].to_numpy()
            owner, a, b = shared_windows(t["slice"].to_pylist(), ids, span, rolls)
            return pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(at[owner] + a), pa.array(at[owner] + b + span)], names=["id", "a", "b"])

        waiting, size, last = [], 0, None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            chars = np.r_[0, np.cumsum(pc.utf8_length(batch.column(3)).to_numpy())]
            start = 0
            # Rows come sorted by key; a chunk ends only where the key changes.
            changes = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for stop in ([0] if last is not None and last != keys[0] else []) + changes.tolist():
                if size + chars[stop] - chars[start] > most:
                    yield found([*waiting, batch.slice(start, stop - start)])
                    waiting, size, start = [], 0, stop
            waiting.append(batch.slice(start))
            size, last = size + chars[-1] - chars[start], keys[-1]
        if waiting:
            yield found(waiting)

    rows = _slices(texts, kept.where("not hot"), span)
    parts = [rows.repartition("key").sortWithinPartitions("key").mapInArrow(group, "id long, a long, b long")]
    if not keys.where("hot").isEmpty():
        parts.append(_by_window(_slices(texts, kept.where("hot"), span), span))
    return _united(reduce(DataFrame.unionByName, parts)).select(F.col("id").alias(id_col), F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def shares(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, chars, shared, share): how much of each text lies in its spans; null and empty texts share 0 of 0.  Rows
    that repeat an id are taken for one text (the longest)."""
    sizes = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.max(F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0))).cast("long").alias("chars"))
    marked = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    out = sizes.join(marked, id_col, "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
    return out.withColumn("share", F.when(F.col("chars") > 0, F.col("shared") / F.col("chars")).otherwise(0.0))


def _by_window(rows: DataFrame, span: int) -> DataFrame:
    """The same grouping for hot keys: one row a window, aggregated on both sides of the shuffle."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = Rolling(0), Rolling(1)
        for batch in batches:
            ids, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a in range(0, len(batch), 2000):
                chars, starts = flatten(batch.column(3).slice(a, 2000))
                if len(chars) < span:
                    continue
                owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(chars) - span + 1]
                keep = np.flatnonzero(np.arange(len(owner)) + span <= starts[owner + 1])
                owner = owner[keep]
                one, other = (r(chars, span)[keep].view(np.int64) for r in rolls)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other), pa.array(ids[a + owner]), pa.array(at[a + owner] + keep - starts[owner])], names=["one", "other", "id", "a"])

    windows = rows.mapInArrow(explode, "one long, other long, id long, a long")
    groups = windows.groupBy("one", "other").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("one", "other")
    return windows.join(groups, ["one", "other"], "left_semi").select("id", "a", (F.col("a") + span).alias("b"))


def _united(spans: DataFrame) -> DataFrame:
    """Overlapping and touching (a, b) of one id as one."""
    before = Window.partitionBy("id").orderBy("a", "b")
    marked = spans.withColumn("reach", F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("new", F.when(F.col("reach") >= F.col("a"), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("id", "a", "b")
