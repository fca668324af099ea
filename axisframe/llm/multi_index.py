"""An inverted multi-index over vectors, for searches by cosine.

Vectors are scaled to unit length and cut into two halves; each half has its own codebook, fitted on a bounded sample
(``sample`` rows, taken by hash of the id).  Every row lies in the cell of its two nearest centroids.  A search visits,
for each row, the occupied cells in the order of the summed distances of their centroid pairs, by a heap over the two
sorted distance lists (:func:`visited_cells`), until they hold ``candidates`` entries; it compares the row with the
entries of these cells only, exactly, in double precision.

What the heap stops before is not lost where a least cosine is given: the search is then *completed*.  A cell's core are
its rows within ``CORE`` of the cell's mean direction.  By the triangle inequality a core can hold a row similar to x only
if its mean lies within CORE + arccos(min_cosine) of x, so x also visits every such core; rows in no core (strays) visit
the cores near them as entries and, in blocks, one another.  The last part grows with the square of the number of strays:
``complete=False`` leaves the completion out, for the recall of the heap alone at a cost linear in the rows.

In the plan, cells that follow one another share a *unit*, about ``unit_rows_`` entries; entries go to the unit of their
cell once, queries to the units of the cells they visit, with the list of these cells.  Units with many queries or
entries are cut into parts of bounded size, so a cell that holds a third of all rows becomes many tasks; partial results
are reduced again by row.  What the driver holds and broadcasts: two codebooks of at most ``most_centroids`` rows, a
number for each occupied cell, and the means of at most ``most_cores`` cores (beyond these the rows count as strays).

Usable are vectors that are not null, of the stated width, finite, without null elements and not all zero; a row
delivered several times counts once, as last written.  Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.workspace import materialize, remove_table, ship_package

#: More than single precision can err in a cosine of unit vectors.
SLACK = 1e-5
#: Angle from a cell's mean direction within which its rows form a core; cells of fewer rows than CORE_ROWS have none.
CORE, CORE_ROWS = 0.3, 8
#: In place of a list: the one of all strays, and none.
STRAYS, NOWHERE = -1, -2
#: In place of a row's core: a stray, and a stray known to be similar to no other, which need not meet them again.
STRAY, ALONE = -1, -2
#: Strays of a task, at most: each goes to all parts of the other side, so few large parts ship the least.
MOST_STRAYS = 65_536


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, width: int, order_col: str | None = None) -> DataFrame:
    """(id, vec): the usable vectors (see the module), one an id."""
    fine = (F.size(vec_col) == width) & F.forall(vec_col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(vec_col, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
    order = F.struct(F.col(order_col) if order_col else F.lit(0), F.col(vec_col))
    return rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.struct(order.alias("o"), F.col(vec_col).alias("vec"))).alias("m")).select("id", F.col("m.vec").cast("array<float>").alias("vec"))


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column as a matrix of rows of length one."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    # The largest element first, so that no square overflows or vanishes.
    rows /= np.abs(rows).max(axis=1, keepdims=True) if len(rows) else 1
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0)


def _means(x: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of k-means, begun with rows drawn by their squared distance to those drawn before; empty ones stay."""
    centres = np.empty((min(size, len(x)), x.shape[1]))
    far = np.ones(len(x))
    for k in range(len(centres)):
        mass = np.cumsum(far)
        at = min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), len(x) - 1) if mass[-1] > 0 else k
        centres[k] = x[at]
        far = np.minimum(far, _squared(x, centres[k : k + 1])[:, 0]) if k else _squared(x, centres[:1])[:, 0]
    for _ in range(rounds):
        near = np.concatenate([_squared(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)])
        mass = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = mass > 0
        centres[full] = sums[full] / mass[full, None]
    return centres


def visited_cells(x: np.ndarray, halves: list[np.ndarray], occupied: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the occupied cells by rising summed distance of their centroid pairs, until they hold ``least``
    entries: (row, place in ``occupied``), in the order visited.

    One heap a row, all rows in step: the heads of the lists that pair one centroid of the first half with those of the
    second by distance.  The least head is taken and its list moved on; a list opens when the one before it has been
    asked, so that each pair is reached once and no list is looked at before it can hold the least sum.
    """
    one, two = halves
    half = one.shape[1]
    far = [_squared(x[:, :half], one), _squared(x[:, half:], two)]
    order = [np.argsort(d, axis=1, kind="stable") for d in far]
    far = [np.take_along_axis(d, o, 1) for d, o in zip(far, order)]
    heads = np.full((len(x), len(one)), np.inf)
    heads[:, 0] = far[0][:, 0] + far[1][:, 0]
    at, open_, got = np.zeros((len(x), len(one)), np.int32), 1, np.zeros(len(x), np.int64)
    rows, places, live = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(x) if len(occupied) else 0)
    while len(live):
        i = heads[live, :open_].argmin(1)
        j = at[live, i]
        cell = order[0][live, i] * len(two) + order[1][live, j]
        place = np.minimum(np.searchsorted(occupied, cell), len(occupied) - 1)
        hit = occupied[place] == cell
        rows.append(live[hit])
        places.append(place[hit])
        got[live[hit]] += counts[place[hit]]
        at[live, i] = j + 1
        more = j + 1 < len(two)
        heads[live, i] = np.where(more, far[0][live, i] + far[1][live, np.minimum(j + 1, len(two) - 1)], np.inf)
        opens = (j == 0) & (i + 1 < len(one))
        heads[live[opens], i[opens] + 1] = far[0][live[opens], i[opens] + 1] + far[1][live[opens], 0]
        open_ = max(open_, min(len(one), int(i.max()) + 2))
        live = live[got[live] < least]
        live = live[np.isfinite(heads[live, :open_].min(1))] if len(live) else live
    return np.concatenate(rows), np.concatenate(places)


@dataclass
class Routing:
    """Where rows go.  Lists of entries are numbered 2 * place for a cell's core and one more for its other rows; the
    list of all strays has a unit of its own, the last."""

    halves: list[np.ndarray]
    occupied: np.ndarray  # cells with rows, sorted
    counts: np.ndarray  # rows of each
    core_at: np.ndarray  # the place of each core's cell
    unit: np.ndarray  # of each place
    query_parts: np.ndarray
    entry_parts: np.ndarray
    first_task: np.ndarray

    def unit_of(self, lists: np.ndarray) -> np.ndarray:
        return np.where(lists == STRAYS, len(self.query_parts) - 1, self.unit[np.maximum(lists, 0) >> 1] if len(self.unit) else 0)

    def visits(self, x: np.ndarray, cells: np.ndarray, core: np.ndarray, near: pa.Array, candidates: int, complete: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists that queries visit."""
        rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if complete:
            rows.append(np.repeat(np.arange(len(x)), np.diff(near.offsets.to_numpy())))
            lists.append(2 * self.core_at[near.flatten().to_numpy()])
            strays = np.flatnonzero(core == STRAY)
            rows.append(strays)
            lists.append(np.full(len(strays), STRAYS))
        if candidates:
            # The first cell visited is the row's own; often it holds enough.
            own = np.searchsorted(self.occupied, cells)
            far = np.flatnonzero(self.counts[own] < candidates)
            row, place = [np.flatnonzero(self.counts[own] >= candidates)], [own[self.counts[own] >= candidates]]
            for a in range(0, len(far), 2048):
                r, p = visited_cells(x[far[a : a + 2048]], self.halves, self.occupied, self.counts, candidates)
                row.append(far[a + r])
                place.append(p)
            row, place = np.concatenate(row), np.concatenate(place)
            of_core = np.isin(place, self.core_at)
            rows.append(row[of_core])
            lists.append(2 * place[of_core])
            # A completed search meets the strays of all cells anyway.
            if not complete:
                rows.append(row)
                lists.append(2 * place + 1)
        return np.concatenate(rows), np.concatenate(lists)

    def entry_lists(self, cells: np.ndarray, core: np.ndarray, complete: bool) -> np.ndarray:
        place = np.searchsorted(self.occupied, cells)
        return np.where(core >= 0, 2 * place, np.where(core == ALONE, NOWHERE, STRAYS) if complete else 2 * place + 1)


def _by_unit(rows: np.ndarray, lists: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """One row for each (row, unit): the row, the unit, and the lists there, each once."""
    if len(rows):
        order = np.lexsort((lists, units, rows))
        rows, lists, units = rows[order], lists[order], units[order]
        once = np.r_[True, (np.diff(rows) != 0) | (np.diff(lists) != 0)]
        rows, lists, units = rows[once], lists[once], units[once]
    first = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(units) != 0)]) if len(rows) else np.zeros(0, np.int64)
    starts = pa.array(np.r_[first, len(rows)].astype(np.int32))
    return rows[first], units[first], pa.ListArray.from_arrays(starts, pa.array(lists, pa.int64()))


class MultiIndex:
    """The index of a table of usable vectors (id, vec)."""

    def __init__(
        self, vectors: DataFrame, width: int, min_cosine: float = 0.85, sample: int = 20_000, centroids: int | None = None,
        candidates: int = 64, unit_rows_: int | None = None, most_queries: int = 8_192, most_entries: int = 32_768,
        most_centroids: int = 2_048, most_cores: int = 65_536, seed: int = 0,
    ):
        """``centroids`` of a half: by default about the square root of the number of rows, at most ``most_centroids``."""
        self.spark, self.width, self.min_cosine, self.candidates = vectors.sparkSession, width, min_cosine, candidates
        ship_package(self.spark)
        vectors = materialize(vectors, "vectors")
        n = vectors.count()
        picked = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow()["vec"].combine_chunks()
        rng, half = np.random.default_rng(seed), width // 2
        rows = unit_rows(picked if isinstance(picked, pa.Array) else pa.concat_arrays(picked.chunks), width)
        size = centroids or min(most_centroids, max(4, 1 << int(np.log2(max(np.sqrt(n), 1)))))
        self.halves = [_means(x, size, 6, rng) if len(x) else np.zeros((1, x.shape[1])) for x in (rows[:, :half], rows[:, half:])]
        books = self.spark.sparkContext.broadcast(self.halves)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = books.value
            for batch in batches:
                x = unit_rows(batch.column(1), width)
                cell = _squared(x[:, :half], one).argmin(1) * len(two) + _squared(x[:, half:], two).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int64)), batch.column(1)], names=["id", "cell", "vec"])

        assigned = materialize(vectors.mapInArrow(assign, "id long, cell long, vec array<float>"), "cells")
        remove_table(vectors)
        # Sorted, so that the same rows always give the same units.
        cells = assigned.groupBy("cell").count().toArrow().sort_by("cell")
        occupied, counts = cells["cell"].to_numpy(), cells["count"].to_numpy()
        self.rows = self._place(assigned, occupied, counts, most_cores)
        remove_table(assigned)
        self._route(occupied, counts, unit_rows_ or int(np.clip(n // 16, 500, 6_000)), most_queries, most_entries)

    def _place(self, assigned: DataFrame, occupied: np.ndarray, counts: np.ndarray, most_cores: int) -> DataFrame:
        """The rows with their core (-1 for strays) and all cores near enough to hold a similar row."""
        width = self.width
        large = np.flatnonzero(counts >= CORE_ROWS)
        large = np.sort(large[np.argsort(-counts[large], kind="stable")[:most_cores]])
        self._core_at = large
        number = np.full(len(occupied), -1)
        number[large] = np.arange(len(large))
        shared = self.spark.sparkContext.broadcast((occupied, number))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, core_of = shared.value
            for batch in batches:
                core = core_of[np.searchsorted(cells, batch.column(0).to_numpy())]
                use = np.flatnonzero(core >= 0)
                if len(use):
                    names, place = np.unique(core[use], return_inverse=True)
                    total = np.zeros((len(names), width))
                    np.add.at(total, place, unit_rows(batch.column(1), width)[use])
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(names), flat], names=["core", "s"])

        part = assigned.select("cell", "vec").mapInArrow(sums, "core long, s array<double>")
        whole = part.groupBy("core").agg(*[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(width)]).toArrow().sort_by("core")
        means = np.stack([whole[f"s{k}"].to_numpy() for k in range(width)], axis=1)
        means /= np.maximum(np.sqrt((means * means).sum(1, keepdims=True)), 1e-12)
        centre = self.spark.sparkContext.broadcast(means)
        reach = float(np.cos(min(np.pi, CORE + np.arccos(np.clip(self.min_cosine, -1, 1)))) - SLACK)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (cells, core_of), means = shared.value, centre.value
            small = means.astype(np.float32)
            for batch in batches:
                x = unit_rows(batch.column(2), width)
                core = core_of[np.searchsorted(cells, batch.column(1).to_numpy())]
                if len(means):
                    core[np.einsum("ij,ij->i", x, means[core]) < np.cos(CORE)] = -1
                starts, found = [0], [np.zeros(0, np.int64)]
                step = max(1, (1 << 22) // max(len(small), 1))
                for a in range(0, len(x), step):
                    r, c = np.nonzero(x[a : a + step].astype(np.float32) @ small.T >= reach)
                    found.append(c)
                    starts.extend((starts[-1] + np.cumsum(np.bincount(r, minlength=len(x[a : a + step])))).tolist())
                near = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(core.astype(np.int32)), near, batch.column(2)], names=["id", "cell", "core", "near", "vec"])

        return materialize(assigned.mapInArrow(place, "id long, cell long, core int, near array<int>, vec array<float>"), "placed")

    def _route(self, occupied, counts, unit_size: int, most_queries: int, most_entries: int) -> None:
        # Cells in order share a unit until it is full; a cell is never cut here, but below into parts.
        unit = np.unique((np.cumsum(counts) - counts) // unit_size, return_inverse=True)[1] if len(counts) else np.zeros(0, np.int64)
        units = int(unit[-1]) + 1 if len(unit) else 0
        of_core = self.spark.sparkContext.broadcast(unit[self._core_at])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asking, strays = np.zeros(units, np.int64), 0
            for batch in batches:
                near = batch.column(1)
                strays += int((batch.column(0).to_numpy() < 0).sum())
                row, at = np.repeat(np.arange(len(batch)), np.diff(near.offsets.to_numpy())), of_core.value[near.flatten().to_numpy()]
                asking += np.bincount(np.unique(row * max(units, 1) + at) % max(units, 1), minlength=units)[:units]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(units + 1)), pa.array(np.r_[asking, strays])], names=["unit", "n"])

        told = self.rows.select("core", "near").mapInArrow(count, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).toArrow()
        asking = np.zeros(units + 1, np.int64)
        asking[told["unit"].to_numpy()] = told["n"].to_numpy()
        entries = np.r_[np.bincount(unit, counts, units).astype(np.int64), asking[-1]]
        parts = [np.maximum(1, -(-n // most)) for n, most in ((asking, most_queries), (entries, most_entries))]
        for part, most in zip(parts, (most_queries, most_entries)):
            part[-1] = max(1, -(-int(asking[-1]) // int(np.clip(asking[-1] // 6, most, max(most, MOST_STRAYS)))))
        first = np.r_[0, np.cumsum(parts[0] * parts[1])]
        self.tasks = int(first[-1])
        self.routing = self.spark.sparkContext.broadcast(Routing(self.halves, occupied, counts, self._core_at, unit, *parts, first))

    def scan(
        self, queries: DataFrame, entries: DataFrame, reducer: Callable, schema: str, extra: str | None = None,
        candidates: int = 0, complete: bool = True,
    ) -> DataFrame:
        """Apply ``reducer`` to each task's queries and entries, both given as rows of the index and, if named, with a long
        column ``extra``.  The reducer gets ids, unit vectors and extras of the queries, those of the entries, and the
        blocks (query rows, entry rows) to compare; it gives the columns of ``schema``.  Queries meet the entries of the
        cells that the heap visits up to ``candidates`` and, with ``complete``, every entry with a cosine of at least the
        index's ``min_cosine``."""
        routing, width, both = self.routing, self.width, queries is entries

        def asking(r: Routing, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
            """Row, unit, own list there (of a core) and lists visited, of the batch as queries."""
            cells, core, near = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            x = unit_rows(batch.column(4), width) if candidates else np.zeros((len(batch), 0))
            rows, lists = r.visits(x, cells, core, near, candidates, complete)
            row, unit, asked = _by_unit(rows, lists, r.unit_of(lists))
            own = r.entry_lists(cells, core, complete)
            return row, unit, np.where((core[row] >= 0) & (r.unit_of(own)[row] == unit), own[row], NOWHERE), asked

        def lying(r: Routing, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
            """The same of the batch as entries: each in its list; strays also as visitors of the cores near them."""
            cells, core, near = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            own = r.entry_lists(cells, core, complete)
            rows = np.repeat(np.arange(len(batch)), np.diff(near.offsets.to_numpy()))
            lists = 2 * r.core_at[near.flatten().to_numpy()]
            use = np.full(len(rows), complete) & (core[rows] < 0)
            row, unit, asked = _by_unit(rows[use], lists[use], r.unit_of(lists[use]))
            lie = np.flatnonzero(own != NOWHERE)
            asked = pa.concat_arrays([pa.array([[]] * len(lie), pa.list_(pa.int64())), asked])
            return np.r_[lie, row], np.r_[r.unit_of(own)[lie], unit], np.r_[own[lie], np.full(len(row), NOWHERE)], asked

        def side(roles: tuple[int, ...]):
            def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                r = routing.value
                # What the heap visits is many times the rows: few rows at once.
                for batch in (part for b in batches for part in (_parts(b, 512) if candidates else [b])):
                    if not len(batch):
                        continue
                    found = {role: (asking, lying)[role - 1](r, batch) for role in roles}
                    if len(roles) == 2:
                        # A row that asks and lies in a unit of a single part goes there once, in both roles.
                        q, e = found[1], found[2]
                        units = len(r.query_parts)
                        names, of_q, of_e = np.intersect1d(q[0] * units + q[1], e[0] * units + e[1], return_indices=True)
                        whole = r.query_parts[names % units] * r.entry_parts[names % units] == 1
                        of_q, of_e = of_q[whole], of_e[whole]
                        found[3] = q[0][of_q], q[1][of_q], e[2][of_e], q[3].take(pa.array(of_q))
                        for role, gone in ((1, of_q), (2, of_e)):
                            row, unit, at, asked = found[role]
                            stay = np.setdiff1d(np.arange(len(row)), gone)
                            found[role] = row[stay], unit[stay], at[stay], asked.take(pa.array(stay))
                    ids = batch.column(0).to_numpy()
                    for role, (row, unit, at, asked) in found.items():
                        if not len(row):
                            continue
                        # Into the parts of the unit: the own part of this side, all of the other.
                        qs, es = r.query_parts[unit], r.entry_parts[unit]
                        own = ((ids[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % (es if role == 2 else qs)
                        copies = qs if role == 2 else es
                        pick = np.repeat(np.arange(len(row)), copies)
                        k = np.arange(len(pick)) - np.repeat(np.cumsum(copies) - copies, copies)
                        task = r.first_task[unit[pick]] + (k * es[pick] + own[pick] if role == 2 else own[pick] * es[pick] + k)
                        took = pa.array(row[pick])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(task), pa.array(np.full(len(pick), role, np.int32)), batch.column(0).take(took), pa.array(at[pick]), asked.take(pa.array(pick)), batch.column(5).take(took), batch.column(4).take(took)],
                            names=["task", "role", "id", "at", "visits", "x", "vec"],
                        )

            return send

        x = F.col(extra).cast("long").alias("x") if extra else F.lit(0).cast("long").alias("x")
        kind = "task long, role int, id long, at long, visits array<long>, x long, vec array<float>"
        sides = ((queries, (1, 2)),) if both else ((queries, (1,)), (entries, (2,)))
        sent = [df.select("id", "cell", "core", "near", "vec", x).mapInArrow(side(roles), kind) for df, roles in sides]

        def reduce_task(table):
            role, at = table["role"].to_numpy(), table["at"].to_numpy()
            vec, visits = (c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in (table[n].combine_chunks() for n in ("vec", "visits")))
            rows, ids, extras = unit_rows(vec, width), table["id"].to_numpy(), table["x"].to_numpy()
            by, lists = np.repeat(np.arange(len(ids)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()

            def part(mine: np.ndarray, asks: np.ndarray):
                take = np.flatnonzero(mine)
                place = np.full(len(ids), -1)
                place[take] = np.arange(len(take))
                use = (mine & asks)[by]
                return (ids[take], rows[take], extras[take]), at[take], (place[by[use]], lists[use])

            # An entry visits only where it lies in no list.
            (q, q_at, q_by), (e, e_at, e_by) = part(role != 2, role != 2), part(role != 1, (at == NOWHERE) & complete)
            blocks = [*meetings(*q_by, np.arange(len(e_at)), e_at), *((b, a) for a, b in meetings(*e_by, np.arange(len(q_at)), q_at))]
            return pa.Table.from_batches([reducer(*q, *e, blocks)])

        # Tasks differ in size; more partitions than cores, and none merged, let them even out.
        whole = sent[0] if both else sent[0].unionByName(sent[1])
        return whole.repartition(2 * max(self.tasks, 1), "task").groupBy("task").applyInArrow(reduce_task, schema)


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(batch), rows):
        yield batch.slice(a, rows)


def meetings(visitors: np.ndarray, visited: np.ndarray, members: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each list that has both, its visitors and its members."""
    by_visit, by_list = np.argsort(visited, kind="stable"), np.argsort(lists, kind="stable")
    visited, lists = visited[by_visit], lists[by_list]
    names = np.intersect1d(visited, lists)
    ends = [np.searchsorted(x, names, side=s) for x in (visited, lists) for s in ("left", "right")]
    for a, b, c, d in zip(*(x.tolist() for x in ends)):
        yield visitors[by_visit[a:b]], members[by_list[c:d]]


def score_blocks(q: np.ndarray, e: np.ndarray, blocks, rows: int = 512, columns: int = 8_192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Single-precision cosines of unit vectors in parts of bounded size: query rows, entry rows, scores.  They are
    off by less than ``SLACK``; what lies that near to a limit is computed again in double precision."""
    q, e = q.astype(np.float32), e.astype(np.float32)
    for r, c in blocks:
        for b in range(0, len(c), columns):
            right = e[c[b : b + columns]].T
            for a in range(0, len(r), rows):
                yield r[a : a + rows], c[b : b + columns], q[r[a : a + rows]] @ right


def shortened(q: np.ndarray, e: np.ndarray, axes: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in ``axes`` + 1 numbers a row, whose products are no less than the cosines: the coordinates along the
    directions that hold most of the mass of ``e``, and the length of what is left (by the Cauchy-Schwarz inequality)."""
    if q.shape[1] <= axes + 1:
        return q.astype(np.float32), e.astype(np.float32)
    some = e[:: -(-len(e) // 20_000)] if len(e) else e
    basis = np.linalg.eigh(some.T @ some)[1][:, ::-1]

    def short(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), axes + 1), np.float32)
        for a in range(0, len(x), 16_384):
            y = x[a : a + 16_384] @ basis
            out[a : a + 16_384, :axes] = y[:, :axes]
            out[a : a + 16_384, axes] = np.sqrt((y[:, axes:] * y[:, axes:]).sum(1))
        return out

    return short(q), short(e)


def exact_cosines(q: np.ndarray, e: np.ndarray, r: np.ndarray, c: np.ndarray, step: int = 50_000) -> np.ndarray:
    """Cosines of the pairs (r, c) in double precision."""
    parts = [np.einsum("ij,ij->i", q[r[a : a + step]], e[c[a : a + step]]) for a in range(0, len(r), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def similar_blocks(q: np.ndarray, e: np.ndarray, blocks, min_cosine: float, **size) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which pairs have a cosine of at least ``min_cosine``, in parts."""
    for rows, columns, scores in score_blocks(q, e, blocks, **size):
        hit, maybe = scores >= min_cosine + SLACK, scores >= min_cosine - SLACK
        if np.count_nonzero(hit) < np.count_nonzero(maybe):
            r, c = np.nonzero(hit != maybe)
            hit[r, c] = exact_cosines(q, e, rows[r], columns[c]) >= min_cosine
        yield rows, columns, hit


def best_of(query: np.ndarray, entry: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best rows of each query: highest cosine, of equal ones the smaller entry."""
    order = np.lexsort((entry, -cosine, query))
    ordered = query[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[place < k]


def _top(k: int, min_cosine: float):
    def reducer(q_ids, q, _q, e_ids, e, _e, blocks):
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for rows, columns, scores in score_blocks(q, e, blocks):
            hits = scores >= min_cosine - SLACK
            if not hits.any():
                continue
            # Where more than k rows are near: all that might be among the k best, and one for the row itself.
            many = np.flatnonzero(np.count_nonzero(hits, axis=1) > k + 1)
            if len(many):
                part = scores[many]
                hits[many] &= part >= np.partition(part, -(k + 1), axis=1)[:, -(k + 1), None] - 2 * SLACK
            r, c = np.nonzero(hits)
            query, entry, cosine = q_ids[rows[r]], e_ids[columns[c]], np.round(exact_cosines(q, e, rows[r], columns[c]), 9)
            use = np.flatnonzero((query != entry) & (cosine >= min_cosine))
            found.append((query[use], entry[use], cosine[use]))
        query, entry, cosine = (np.concatenate(x) for x in zip(*found))
        # A pair that met in two lists counts once.
        once = np.unique(np.c_[query, entry], axis=0, return_index=True)[1]
        query, entry, cosine = query[once], entry[once], cosine[once]
        use = best_of(query, entry, cosine, k)
        return pa.RecordBatch.from_arrays([pa.array(query[use]), pa.array(entry[use]), pa.array(cosine[use])], names=["query", "entry", "cosine"])

    return reducer


def neighbours(
    index: MultiIndex, k: int = 5, min_cosine: float | None = None, queries: DataFrame | None = None,
    candidates: int | None = None, complete: bool | None = None,
) -> DataFrame:
    """(query, entry, cosine, place): for every row (or those of ``queries``, rows of the index) the k most similar other
    rows with a cosine of at least ``min_cosine``, rounded to 9 decimals; of equal ones the smaller id first.

    The heap visits cells up to ``candidates`` entries.  From the index's ``min_cosine`` on the search is completed by
    default and exact; below it cannot be, and a row whose visited cells hold fewer gets fewer."""
    least = index.min_cosine if min_cosine is None else min_cosine
    whole = least >= index.min_cosine if complete is None else complete
    if whole and least < index.min_cosine:
        raise ValueError(f"the index completes searches from a cosine of {index.min_cosine} on")
    found = index.scan(index.rows if queries is None else queries, index.rows, _top(k, least), "query long, entry long, cosine double", candidates=index.candidates if candidates is None else candidates, complete=whole)
    # Two units may both have compared a pair.
    found = found.repartition("query").groupBy("query", "entry").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "entry")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def similar_pairs(index: MultiIndex, k: int = 5) -> DataFrame:
    """(ix_a, ix_b), ix_a < ix_b: pairs of which one is among the k most similar rows of the other."""
    near = neighbours(index, k)
    return near.select(F.least("query", "entry").alias("ix_a"), F.greatest("query", "entry").alias("ix_b")).distinct()
