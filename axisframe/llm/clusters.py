"""Clusters of mutually similar rows, by parallel pivot correlation clustering over the inverted multi-index.

Rows are ordered by a hash of their id.  In each round every unassigned row that has no similar unassigned row before it
in that order becomes a pivot; pivots absorb the unassigned rows similar to them, each row going to the closest pivot.
The row first in hash order is always a pivot, so rounds end; in expectation there are O(log n) of them.  After the last
round members move to the closest of all pivots, and each cluster's medoids (its rows closest to the cluster's mean
direction) are computed.

No pair is ever emitted: a task reduces its comparisons to one row per query (is there an earlier similar row; which
pivot is closest).  State is written to the shared folder after each round.  The strays of the index, which meet one
another all, do so once: those that the first round finds similar to no other stray meet only cores from then on.

Where all members of a cluster are similar to one another, the pivot clusters are the connected sets of the similarity
graph.  Where they are not, :func:`linked`, an operator of its own, unites clusters that any similar pair connects; the
links go between cluster ids and are reduced in each task.

Defined cases: unusable vectors are in no cluster; equal vectors fall together; a row without similar rows is a cluster
of its own; ties go to the smaller id; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisframe.llm.multi_index import ALONE, SLACK, STRAY, MultiIndex, exact_cosines, score_blocks, shortened, similar_blocks, unit_rows
from axisframe.operators.components import components
from axisframe.workspace import materialize


def hash_order(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random order of ids, without ties: an invertible mix of 64 bits."""
    x = ids.astype(np.int64).view(np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _has_earlier(min_cosine: float):
    def meet(q, e, rows, columns, before):
        """The similar pairs of strays (row, column before it), in parts.  Most rows are far from all others, which a
        part of their coordinates tells."""
        few_q, few_e = shortened(q[rows], e[columns])
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            for b in range(0, int(before[part[-1]]), 2048):
                stop = min(b + 2048, int(before[part[-1]]))
                maybe = few_q[a : a + 256] @ few_e[b:stop].T >= min_cosine - SLACK
                r, c = np.divmod(np.flatnonzero(maybe), stop - b)
                if len(r) > maybe.size // 50:
                    r, c = np.nonzero(next(similar_blocks(q, e, [(part, columns[b:stop])], min_cosine))[2])
                else:
                    hit = exact_cosines(q, e, part[r], columns[b + c]) >= min_cosine
                    r, c = r[hit], c[hit]
                use = b + c < before[part[r]]
                yield part[r[use]], columns[b + c[use]]

    def reducer(q_ids, q, q_core, e_ids, e, e_core, blocks):
        mine, theirs = hash_order(q_ids), hash_order(e_ids)
        earlier, met, followed = np.zeros(len(q_ids), bool), np.zeros(len(q_ids), bool), np.zeros(len(e_ids), bool)
        for rows, columns in blocks:
            # Both in hash order: a query asks only the entries that come before it.
            rows, columns = rows[np.argsort(mine[rows])], columns[np.argsort(theirs[columns])]
            before = np.zeros(len(q_ids), np.int64)
            before[rows] = np.searchsorted(theirs[columns], mine[rows])
            if (q_core[rows] == STRAY).all() and (e_core[columns] == STRAY).all():
                for r, c in meet(q, e, rows, columns, before):
                    earlier[r] = met[r] = True
                    followed[c] = True
                continue
            for a in range(0, len(rows), 512):
                part = rows[a : a + 512]
                for b in range(0, int(before[part[-1]]), 1024):
                    # A query with an earlier row needs no further comparison.
                    part = part[~earlier[part] & (before[part] > b)]
                    if not len(part):
                        break
                    stop = min(b + 1024, int(before[part[-1]]))
                    for r, c, hit in similar_blocks(q, e, [(part, columns[b:stop])], min_cosine):
                        hit &= np.arange(b, stop) < before[r, None]
                        earlier[r] |= hit.any(axis=1)
        ids = np.r_[q_ids[earlier], e_ids[followed]]
        told = np.r_[np.ones(earlier.sum(), bool), np.zeros(followed.sum(), bool)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(told), pa.array(np.r_[met[earlier], followed[followed]])], names=["id", "earlier", "met"])

    return reducer


def _closest(min_cosine: float):
    def reducer(q_ids, q, _q, e_ids, e, _e, blocks):
        best = np.full(len(q_ids), -2.0)
        pivot = np.zeros(len(q_ids), np.int64)
        for rows, columns, scores in score_blocks(q, e, blocks):
            # All that might be closest; of equal cosines (9 decimals) the smaller id.
            r, c = np.nonzero(scores >= np.maximum(scores.max(axis=1, keepdims=True), min_cosine) - 2 * SLACK)
            if not len(r):
                continue
            cosine, ids = np.round(exact_cosines(q, e, rows[r], columns[c]), 9), e_ids[columns[c]]
            order = np.lexsort((ids, -cosine, r))
            order = order[np.r_[True, np.diff(r[order]) != 0]]
            at, ids, cosine = rows[r[order]], ids[order], cosine[order]
            better = (cosine > best[at]) | ((cosine == best[at]) & (ids < pivot[at]))
            pivot[at[better]], best[at[better]] = ids[better], cosine[better]
        near = best >= min_cosine
        return pa.RecordBatch.from_arrays([pa.array(q_ids[near]), pa.array(pivot[near]), pa.array(best[near])], names=["id", "pivot", "cosine"])

    return reducer


def _links(min_cosine: float):
    def reducer(q_ids, q, q_group, e_ids, e, e_group, blocks):
        found = [np.zeros((0, 2), np.int64)]
        for rows, columns, hit in similar_blocks(q, e, blocks, min_cosine):
            mine, theirs = q_group[rows], e_group[columns]
            hit &= mine[:, None] != theirs
            if hit.any():
                r, c = np.nonzero(hit)
                found.append(np.unique(np.c_[mine[r], theirs[c]], axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return reducer


def _nearest_pivot(index: MultiIndex, rows: DataFrame, pivots: DataFrame) -> DataFrame:
    near = index.scan(rows, pivots, _closest(index.min_cosine), "id long, pivot long, cosine double")
    near = near.unionByName(pivots.select("id", F.col("id").alias("pivot"), F.lit(1.0).alias("cosine")))
    best = near.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("pivot")).alias("minus"))).alias("m"))
    return best.select("id", (-F.col("m.minus")).alias("pivot"), F.col("m.cosine").alias("cosine"))


def _marked(rows: DataFrame, met: DataFrame) -> DataFrame:
    """Rows of the index, strays that are not among ``met`` marked so that they meet no other stray again."""
    strays = rows.where(F.col("core") == STRAY)
    alone = strays.join(met, "id", "left_anti").withColumn("core", F.lit(ALONE))
    return rows.where(F.col("core") != STRAY).unionByName(alone).unionByName(strays.join(met, "id", "left_semi"))


def pivot_clusters(index: MultiIndex) -> DataFrame:
    """(id, pivot): the cluster of every usable row, named by its pivot."""
    active, done, rounds = index.rows, [], 0
    while True:
        told = materialize(index.scan(active, active, _has_earlier(index.min_cosine), "id long, earlier boolean, met boolean", extra="core").distinct(), "told")
        if not rounds:
            active = whole = materialize(_marked(active, told.where("met").select("id").distinct()), "marked")
        earlier = told.where("earlier").select("id").distinct()
        pivots = materialize(active.join(earlier, "id", "left_anti").select(*index.rows.columns), "pivots")
        taken = materialize(_nearest_pivot(index, active, pivots), "absorbed")
        done.append((taken, pivots))
        rounds += 1
        # Ids alone tell whether a row is left; vectors move only then.
        left = materialize(active.select("id").join(taken, "id", "left_anti"), "left")
        if left.isEmpty():
            break
        active = materialize(active.join(left, "id", "left_semi").select(*index.rows.columns), "unassigned")
    if rounds == 1:
        return done[0][0].select("id", "pivot")
    pivots = done[0][1]
    for _, more in done[1:]:
        pivots = pivots.unionByName(more)
    return materialize(_nearest_pivot(index, whole, materialize(pivots, "pivots")).select("id", "pivot"), "clusters")


def by_first_member(clusters: DataFrame) -> DataFrame:
    """(id, first): each cluster of (id, pivot) named by its smallest id."""
    least = clusters.groupBy("pivot").agg(F.min("id").alias("first"))
    return clusters.join(least, "pivot").select("id", "first")


def linked(index: MultiIndex, clusters: DataFrame) -> DataFrame:
    """(id, first): clusters united where a similar pair connects them; ``first`` is the smallest id of the united set."""
    grouped = index.rows.join(clusters, "id").select(*index.rows.columns, "pivot")
    links = materialize(index.scan(grouped, grouped, _links(index.min_cosine), "a long, b long", extra="pivot").distinct(), "links")
    if links.isEmpty():
        named = clusters.select("id", F.col("pivot").alias("root"))
    else:
        labels = components(links)
        named = clusters.join(labels, F.col("pivot") == F.col("node"), "left").select("id", F.coalesce("label", "pivot").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("first"))
    return named.join(least, "root").select("id", "first")


def describe(index: MultiIndex, clusters: DataFrame, cluster_col: str = "pivot", typical: int = 3) -> DataFrame:
    """(cluster_col, size, typical): each cluster's size and its ``typical`` medoids, the rows closest to the cluster's
    mean direction, closest first, of equal ones the smaller id."""
    width = index.width
    rows = index.rows.join(clusters, "id").select("id", "vec", F.col(cluster_col).alias("cluster"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at = np.unique(batch.column(2).to_numpy(), return_inverse=True)
            total = np.zeros((len(names), width))
            np.add.at(total, at, unit_rows(batch.column(1), width))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at, minlength=len(names))), flat], names=["cluster", "n", "s"])

    part = rows.mapInArrow(sums, "cluster long, n long, s array<double>")
    whole = part.groupBy("cluster").agg(F.sum("n").alias("size"), *[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(width)])
    means = materialize(whole.select("cluster", "size", F.array(*[f"s{k}" for k in range(width)]).alias("mean")), "means")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = unit_rows(batch.column(1), width)
            mean = batch.column(3).flatten().to_numpy().reshape(-1, width)
            dot = np.round((x * mean).sum(1) / np.sqrt((mean * mean).sum(1)), 9)
            ids, cluster = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((ids, -dot, cluster))
            first = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0])
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            # Only a batch's best of each cluster go on, so a large cluster is no hot spot.
            use = order[place < typical]
            yield pa.RecordBatch.from_arrays([pa.array(cluster[use]), pa.array(ids[use]), pa.array(dot[use])], names=["cluster", "id", "dot"])

    scored = rows.join(means, "cluster").select("id", "vec", "cluster", "mean").mapInArrow(score, "cluster long, id long, dot double")
    best = Window.partitionBy("cluster").orderBy(F.desc("dot"), "id")
    top = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= typical)
    lists = top.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda t: t["id"]).alias("typical"))
    return means.select("cluster", "size").join(lists, "cluster").withColumnRenamed("cluster", cluster_col)


def describe_by_terms(clusters: DataFrame, terms: DataFrame, cluster_col: str = "first", most: int = 3) -> DataFrame:
    """(cluster_col, terms): for each cluster of (id, cluster_col) the ``most`` terms that occur in the most of its rows,
    of equal ones the alphabetically first.  ``terms``: (record, term), a row for each entry."""
    once = terms.where("term is not null").select(F.col("record").alias("id"), "term").distinct()
    counted = once.join(clusters, "id").groupBy(cluster_col, "term").agg(F.count("*").alias("n"))
    best = Window.partitionBy(cluster_col).orderBy(F.desc("n"), "term")
    top = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    return top.groupBy(cluster_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]).alias("terms"))
