import datetime as dt
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axisframe.llm import clusters, multi_index, percentiles
from axisframe.llm.term_counts import TermCounts, counts_of_entries, rare_and_common, variable_names

# -- term counts ---------------------------------------------------------------------------------------------------


def frame(spark, rows):
    return spark.createDataFrame(rows, "record long, term string")


def state(store):
    return {r.term: (r.occurrences, r.records) for r in store.counts().collect()}, store.record_count()


def test_deltas_equal_counting_anew(spark, tmp_path):
    store = TermCounts(spark, str(tmp_path / "t"), buckets=3)
    assert state(store) == ({}, 0)
    store.apply(frame(spark, [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None), (None, "z")]))
    assert state(store) == ({"a": (3, 2), "b": (1, 1)}, 3)
    store.apply(frame(spark, [(1, "b"), (4, "c"), (4, "")]), spark.createDataFrame([(2,), (99,)], "record long"))
    assert state(store) == ({"b": (1, 1), "c": (1, 1), "": (1, 1)}, 3)
    store.apply(frame(spark, []))
    assert state(store) == ({"b": (1, 1), "c": (1, 1), "": (1, 1)}, 3)
    store.apply(frame(spark, []), spark.createDataFrame([(1,), (3,), (4,)], "record long"))
    assert state(store) == ({}, 0)
    store.apply(frame(spark, [(7, "x")] * 500 + [(n, "x") for n in range(300)]))
    assert state(store) == ({"x": (800, 300)}, 300)


def test_random_change_sets(spark, tmp_path):
    rng = np.random.default_rng(4)
    store, content = TermCounts(spark, str(tmp_path / "t"), buckets=2), {}
    for _ in range(3):
        changed = {int(r): [str(t) for t in rng.integers(0, 6, rng.integers(1, 5))] for r in rng.integers(0, 12, 5)}
        deleted = [int(r) for r in rng.integers(0, 12, 2) if int(r) not in changed]
        store.apply(frame(spark, [(r, t) for r, ts in changed.items() for t in ts]), spark.createDataFrame([(r,) for r in deleted], "record long"))
        content = {r: t for r, t in (content | changed).items() if r not in deleted}
        flat = pd.DataFrame([(r, t) for r, ts in content.items() for t in ts], columns=["r", "t"])
        want = {t: (len(g), g.r.nunique()) for t, g in flat.groupby("t")}
        assert state(store) == (want, len(content)) == state(TermCounts(spark, str(tmp_path / "t")))


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    store = TermCounts(spark, str(tmp_path / "t"), buckets=16)
    store.apply(frame(spark, [(n, f"w{n}") for n in range(100)]))
    store.apply(frame(spark, [(5, "w5"), (5, "more")]))
    assert list(store.current["records"].values()).count(2) == 1 and list(store.current["counts"].values()).count(2) <= 2
    assert state(store)[0]["more"] == (1, 1) and len(state(store)[0]) == 101


def test_versions_are_merged_and_failed_applies_change_nothing(spark, tmp_path, monkeypatch):
    store = TermCounts(spark, str(tmp_path / "t"), buckets=2, most_versions=2)
    for n in range(6):
        store.apply(frame(spark, [(n, "a"), (0, f"v{n}")]), spark.createDataFrame([(n - 2,)], "record long") if n > 2 else None)
        assert all(len(v) <= 2 for of in store.versions.values() for v in of.values())
        assert state(store) == state(TermCounts(spark, str(tmp_path / "t")))
    assert state(store) == ({"a": (2, 2), "v5": (1, 1)}, 3)
    before = state(store)
    monkeypatch.setattr(TermCounts, "_settle", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.apply(frame(spark, [(9, "z")]))
    monkeypatch.undo()
    again = TermCounts(spark, str(tmp_path / "t"))
    assert state(again) == before
    again.apply(frame(spark, [(9, "z")]))
    assert state(again)[0]["z"] == (1, 1)


def test_names_marks_and_redelivered_entries(spark):
    lines = [(0, " Foo \tx"), (1, "foo\r"), (2, "\tonly"), (3, None), (4, "bar\t\r"), (4, "bar"), (None, "q")]
    lines = spark.createDataFrame(lines, "j int, raw_line string").withColumn("name", F.lit("clash"))
    assert sorted(tuple(r) for r in variable_names(lines).collect()) == [(0, "foo"), (1, "foo"), (4, "bar")]
    t0 = dt.datetime(2026, 1, 1)
    rows = [(n, j, 0, t0 + dt.timedelta(days=n)) for n in range(10) for j in (0, 1)] + [(0, 4, 0, t0), (0, 4, 1, t0), (3, 9, 0, t0), (3, None, 0, None)]
    rows += [(0, 4, 0, t0 + dt.timedelta(days=9))]
    entries = spark.createDataFrame(rows, "i long, j int, seq int, written_at timestamp").withColumn("term", F.lit(1))
    store = counts_of_entries(entries, lines, TermCounts(spark, buckets=2))
    got = {r.term: (r.occurrences, r.records, r.mark) for r in rare_and_common(store).collect()}
    assert got == {"foo": (20, 10, "common"), "bar": (2, 1, "rare")} and store.record_count() == 10
    empty = counts_of_entries(entries.where("false"), lines, TermCounts(spark, buckets=2))
    assert state(empty) == ({}, 0)


# -- percentiles ---------------------------------------------------------------------------------------------------


def test_order_code_is_that_of_the_bits(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.1, 3.5, 2.0**-1074, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.7976931348623157e308, float("inf"), float("-inf"), 2.0**1023, math.nextafter(1, 0), math.nextafter(1, 2), 1e-300, 7e22]
    values += [float(x) for x in np.random.default_rng(1).standard_normal(300) * 10.0 ** np.random.default_rng(2).integers(-300, 300, 300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", percentiles.order_code(F.col("v")).alias("c")).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.c == (bits if r.v >= 0 else -bits), r.v


def brute(values, p):
    v = sorted(values)
    return next(x for n, x in enumerate(v, 1) if n * 1000 >= round(p * 1000) * len(v))


@pytest.mark.parametrize("ways,broadcast_rows", [(64, 200_000), (4, 0)])
def test_exact_percentiles(spark, ways, broadcast_rows):
    rng = np.random.default_rng(3)
    groups = {
        "hot": rng.lognormal(0, 3, 4000).round(2).tolist(), "ties": [5.0] * 90 + [1.0] * 5 + [9.0] * 5, "one": [7.25], "wide": [-1e300, -1.0, 0.0, 1e-310, 1e300, float("inf")],
        "two": [1.0, 2.0], None: [3.0, 1.0, 2.0], "twenty": [float(k) for k in range(1, 21)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "grp string, value double").withColumn("n", F.lit(1)).withColumn("c", F.lit("x"))
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.grp, r.p): r.percentile for r in percentiles.exact(df, "grp", "value", ps, ways, broadcast_rows).collect()}
    assert got == {(g, p): brute(vs, p) for g, vs in groups.items() for p in ps}
    assert percentiles.exact(df.where("false"), "grp", "value", ps).isEmpty()


@pytest.mark.parametrize("ways", [256, 4, 2])
def test_exact_percentiles_of_adjacent_doubles(spark, ways, monkeypatch):
    tiny = math.nextafter(0, 1)
    groups = {"sum": [3.3, 1.1 + 2.2], "next": [2.0, math.nextafter(2, 3)], "tiny": [-tiny, 0.0, tiny], "run": [1 + k * 2.0**-52 for k in range(9)], "far": [-1e300, 3.3, 1.1 + 2.2, 1e300]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "grp string, value double")
    passes, kept = [], percentiles.materialize

    def counted(frame, name):
        passes.append(name)
        assert len(passes) <= 80, "the bisection does not end"
        return kept(frame, name)

    monkeypatch.setattr(percentiles, "materialize", counted)
    ps = [0.05, 0.5, 0.95]
    got = {(r.grp, r.p): r.percentile for r in percentiles.exact(df, "grp", "value", ps, ways).collect()}
    assert got == {(g, p): brute(vs, p) for g, vs in groups.items() for p in ps}


def test_summaries_of_parts_combine(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 3000), rng.normal(0, 50, 3000))], "grp int, value double")
    parts = percentiles.summarize(df.where("value < 3"), "grp", "value").unionByName(percentiles.summarize(df.where("value >= 3"), "grp", "value"))
    whole = percentiles.summarize(df, "grp", "value")
    ps = [0.05, 0.5, 0.95]
    one, two = (sorted(tuple(r) for r in percentiles.bounds(s, "grp", ps).collect()) for s in (percentiles.merge(parts, "grp"), whole))
    assert one == two
    exact = {(r.grp, r.p): r.percentile for r in percentiles.exact(df, "grp", "value", ps).collect()}
    for g, p, least, most, _ in one:
        assert least <= exact[g, p] <= most and most - least <= max(abs(least), abs(most)) / 128


# -- vectors -------------------------------------------------------------------------------------------------------


def vector_rows(rng, width=8):
    centres = rng.normal(size=(25, width))
    rows = [(int(n), (centres[n % 25] + rng.normal(0, 0.08, width)).astype("float32").tolist()) for n in range(400)]
    rows += [(1000 + n, rng.normal(size=width).astype("float32").tolist()) for n in range(60)]
    rows += [(2000 + n, rows[3][1]) for n in range(9)] + [(3000, [x * 1e18 for x in rows[4][1]]), (3001, [x * 1e-20 for x in rows[4][1]])]
    bad = [None, [1.0] * (width - 1), [0.0] * width, [float("nan")] * width, [float("inf")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1), []]
    return rows + [(4000 + n, b) for n, b in enumerate(bad)] + [(None, rows[0][1])] + rows[:20]


@pytest.fixture(scope="module")
def indexed(spark):
    rows = vector_rows(np.random.default_rng(7))
    df = spark.createDataFrame(rows, "ix long, vec array<float>").withColumn("id", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("task", F.lit(3))
    index = multi_index.MultiIndex(multi_index.usable_vectors(df, "ix", "vec", 8), 8, unit_rows_=80, most_queries=50, most_entries=64)
    pdf = pd.DataFrame([(i, v) for i, v in rows if i is not None and i < 4000], columns=["ix", "v"]).drop_duplicates("ix").sort_values("ix")
    v = np.array(pdf.v.tolist(), np.float32).astype(float)
    v /= np.abs(v).max(1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return index, pdf.ix.to_numpy(), np.round(v @ v.T, 9)


def test_usable_vectors(indexed):
    index, ids, _ = indexed
    assert sorted(r.id for r in index.rows.select("id").collect()) == ids.tolist()
    assert index.tasks > 5


def test_nearest_vectors_with_ties(indexed):
    index, ids, cosine = indexed
    want = set()
    for a in range(len(ids)):
        order = np.lexsort((ids, -cosine[a]))
        near = [b for b in order if b != a and cosine[a, b] >= 0.85][:5]
        want |= {(int(ids[a]), int(ids[b])) for b in near}
    found = multi_index.neighbours(index, 5)
    got = {(r.query, r.entry) for r in found.collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    pairs = [tuple(r) for r in multi_index.similar_pairs(index).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    some = index.rows.where("id % 50 = 0")
    assert {r.query for r in multi_index.neighbours(index, 2, queries=some).collect()} <= set(range(0, 4000, 50))


def test_recall_of_all_nearest_vectors(spark):
    """Without a least cosine: recall at 10 against brute force."""
    rng = np.random.default_rng(9)
    v = (rng.normal(size=(1500, 6)) @ rng.normal(size=(6, 16))).astype("float32")
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "ix long, vec array<float>")
    index = multi_index.MultiIndex(multi_index.usable_vectors(df, "ix", "vec", 16), 16, unit_rows_=200)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cosine = u @ u.T
    np.fill_diagonal(cosine, -2)
    got = {(r.query, r.entry) for r in multi_index.neighbours(index, 10, min_cosine=-1.0).collect()}
    want = {(a, int(b)) for a in range(len(v)) for b in np.argsort(-cosine[a])[:10]}
    assert len(got & want) >= 0.9 * len(want)


def test_similar_pairs_far_from_their_centroids(spark):
    """No pair is lost, however the rows lie about the centroids."""
    rng = np.random.default_rng(11)
    v = (rng.normal(size=(1500, 5)) @ rng.normal(size=(5, 16))).astype("float32")
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "ix long, vec array<float>")
    index = multi_index.MultiIndex(multi_index.usable_vectors(df, "ix", "vec", 16), 16, sample=60, unit_rows_=50, most_queries=70, most_entries=90)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cosine = np.round(u @ u.T, 9)
    np.fill_diagonal(cosine, -2)
    got = {(r.query, r.entry) for r in multi_index.neighbours(index, 1500).collect()}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(cosine >= 0.85))}
    united = clusters.linked(index, clusters.pivot_clusters(index))
    assert {r.id: r.first for r in united.collect()} == components_of(np.arange(len(v)), cosine)


def components_of(ids, cosine):
    label = {i: i for i in ids.tolist()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(*np.nonzero(cosine >= 0.85)):
        x, y = root(int(ids[a])), root(int(ids[b]))
        label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids.tolist()}


def test_pivot_clusters_and_their_union(indexed):
    index, ids, cosine = indexed
    found = {r.id: r.pivot for r in clusters.pivot_clusters(index).collect()}
    at = {i: n for n, i in enumerate(ids.tolist())}
    assert sorted(found) == ids.tolist()
    assert all(cosine[at[i], at[p]] >= 0.85 for i, p in found.items()) and all(found[p] == p for p in found.values())
    united = clusters.linked(index, clusters.pivot_clusters(index))
    assert {r.id: r.first for r in united.collect()} == components_of(ids, cosine)
    told = {r["first"]: r for r in clusters.describe(index, united, "first").collect()}
    sizes = pd.Series(components_of(ids, cosine)).value_counts()
    assert {k: r["size"] for k, r in told.items()} == sizes.to_dict()
    for k, r in told.items():
        assert len(r.typical) == min(3, r["size"]) and all(components_of(ids, cosine)[i] == k for i in r.typical[:1])


def test_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "ix long, vec array<float>")
    index = multi_index.MultiIndex(multi_index.usable_vectors(df, "ix", "vec", 4), 4)
    assert multi_index.similar_pairs(index).isEmpty()
    assert clusters.linked(index, clusters.pivot_clusters(index)).isEmpty()
    one = spark.createDataFrame([(5, [1.0, 0.0, 0.0, 0.0])], "ix long, vec array<float>")
    index = multi_index.MultiIndex(multi_index.usable_vectors(one, "ix", "vec", 4), 4)
    assert [tuple(r) for r in clusters.linked(index, clusters.pivot_clusters(index)).collect()] == [(5, 5)]


def test_cells_are_visited_by_summed_distance():
    rng = np.random.default_rng(2)
    halves = [rng.normal(size=(6, 3)), rng.normal(size=(5, 3))]
    x, occupied = rng.normal(size=(40, 6)), np.sort(rng.choice(30, 20, replace=False))
    counts = rng.integers(1, 4, 20)
    sums = (multi_index._squared(x[:, :3], halves[0])[:, :, None] + multi_index._squared(x[:, 3:], halves[1])[:, None, :]).reshape(40, 30)[:, occupied]
    for least in (1, 9, 1000):
        rows, places = multi_index.visited_cells(x, halves, occupied, counts, least)
        for r in range(40):
            got = places[rows == r]
            assert np.allclose(sums[r, got], np.sort(sums[r])[: len(got)]) and len(set(got.tolist())) == len(got)
            held = np.cumsum(counts[got])
            assert len(got) == 20 if least == 1000 else held[-1] >= least and (len(got) == 1 or held[-2] < least)
    assert len(multi_index.visited_cells(x, halves, occupied[:0], counts[:0], 5)[0]) == 0


def test_clusters_come_from_the_pivots(indexed, monkeypatch):
    """Without pivots that absorb what is similar, the clusters are not those of the table."""
    index, ids, cosine = indexed
    right = {r.id: r["first"] for r in clusters.by_first_member(clusters.pivot_clusters(index)).collect()}
    cliques = {i: f for i, f in components_of(ids, cosine).items()}
    assert all(right[i] >= cliques[i] for i in cliques) and sorted(right) == ids.tolist()

    def only_itself(q_ids, q, _q, e_ids, e, _e, blocks):
        import pyarrow as pa

        mine = np.intersect1d(q_ids, e_ids)
        return pa.RecordBatch.from_arrays([pa.array(mine), pa.array(mine), pa.array(np.ones(len(mine)))], names=["id", "pivot", "cosine"])

    monkeypatch.setattr(clusters, "_closest", lambda least: only_itself)
    broken = {r.id: r["first"] for r in clusters.by_first_member(clusters.pivot_clusters(index)).collect()}
    assert all(i == f for i, f in broken.items()) and broken != right


@pytest.mark.parametrize("width,most_cores", [(16, 0), (16, 2), (5, 65_536)])
def test_few_cores_and_odd_widths_lose_nothing(spark, width, most_cores):
    rng = np.random.default_rng(13)
    v = (rng.normal(size=(12, width))[rng.integers(0, 12, 400)] + rng.normal(0, 0.25, (400, width))).astype("float32")
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "ix long, vec array<float>")
    index = multi_index.MultiIndex(multi_index.usable_vectors(df, "ix", "vec", width), width, centroids=6, unit_rows_=90, most_cores=most_cores)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cosine = np.round(u @ u.T, 9)
    np.fill_diagonal(cosine, -2)
    got = {(r.query, r.entry) for r in multi_index.neighbours(index, 400).collect()}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(cosine >= 0.85))}
    heap = {(r.query, r.entry) for r in multi_index.neighbours(index, 400, candidates=100, complete=False).collect()}
    assert heap <= got and len(heap) >= 0.9 * len(got)


@pytest.mark.parametrize("width,most_cores", [(64, 65_536), (64, 0), (30, 1), (5, 0)])
def test_strays_meet_one_another_once(spark, width, most_cores):
    """The pivots are those of the rows taken one by one in hash order; rows far from all others are compared once only."""
    rng = np.random.default_rng(17)
    v = np.concatenate([rng.normal(size=(4, width))[rng.integers(0, 4, 200)] + rng.normal(0, 0.2, (200, width)), rng.normal(size=(300, width))])
    v = np.concatenate([v, v[-20:] + rng.normal(0, 0.1, (20, width))]).astype("float32")
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "ix long, vec array<float>")
    index = multi_index.MultiIndex(multi_index.usable_vectors(df, "ix", "vec", width), width, unit_rows_=90, most_cores=most_cores)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cosine = np.round(u @ u.T, 9)
    pivots: list[int] = []
    for n in np.argsort(clusters.hash_order(np.arange(len(v)))):
        if not any(cosine[n, p] >= 0.85 for p in pivots):
            pivots.append(int(n))
    want = {n: min(pivots, key=lambda p: (-cosine[n, p], p)) for n in range(len(v))}
    assert {r.id: r.pivot for r in clusters.pivot_clusters(index).collect()} == want

    def compared(q_ids, q, _q, e_ids, e, _e, blocks):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([sum(len(a) * len(b) for a, b in blocks)], pa.int64())], names=["n"])

    def pairs(rows):
        return index.scan(rows, rows, compared, "n long").agg(F.sum("n")).first()[0] or 0

    told = index.scan(index.rows, index.rows, clusters._has_earlier(0.85), "id long, earlier boolean, met boolean", extra="core")
    far = {n for n in range(len(v)) if (cosine[n] >= 0.85).sum() == 1}
    assert {r.id for r in told.where("earlier").collect()} == {n for n in range(len(v)) if any(cosine[n, m] >= 0.85 and a < b for m, a, b in zip(range(len(v)), clusters.hash_order(np.arange(len(v))), [clusters.hash_order(np.array([n]))[0]] * len(v)))}
    marked = clusters._marked(index.rows, told.where("met").select("id").distinct())
    assert far <= {r.id for r in marked.where(F.col("core") == multi_index.ALONE).collect()}
    assert pairs(marked) <= pairs(index.rows) - len(far) ** 2


def test_short_products_are_no_less_than_cosines():
    rng = np.random.default_rng(3)
    for scale in (np.ones(64), np.exp(-np.arange(64) / 6.0), np.exp(np.arange(64) / 9.0)):
        q, e = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(90, 64)) * scale, rng.normal(size=(300, 64)) * scale))
        a, b = multi_index.shortened(q, e)
        assert a.shape == (90, 25) and (a @ b.T >= q @ e.T - multi_index.SLACK).all()
