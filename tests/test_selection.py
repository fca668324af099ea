import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axisframe.axis_index import IntervalIndex, ListIndex, RangeIndex, Run, equal, positions_of
from axisframe.selection import Index, Range, SelectionError, compose, expand, parse, parse_all, s_

ends = st.one_of(st.none(), st.integers(-60, 60))
steps = st.one_of(st.none(), st.integers(-9, 9).filter(bool))


@given(st.integers(0, 50), ends, ends, steps)
@settings(max_examples=400, deadline=None)
def test_python_slices_mean_what_they_mean_in_numpy(n, a, b, k):
    got = parse(slice(a, b, k), n)
    want = np.arange(n)[a:b:k]
    assert got.positions().tolist() == want.tolist()
    assert len(got) == len(want)


@given(st.integers(1, 40), st.data())
@settings(max_examples=200, deadline=None)
def test_composition_is_selection_after_selection(n, data):
    one = parse(slice(data.draw(ends), data.draw(ends), data.draw(steps)), n)
    two = parse(slice(data.draw(ends), data.draw(ends), data.draw(steps)), len(one))
    assert compose(one, two).positions().tolist() == np.arange(n)[one.positions()][two.positions()].tolist()


def test_stepped_ranges_have_the_ceiling_of_positions():
    assert len(Range(3, 50, 7)) == 7
    assert Range(0, 10, -3).positions().tolist() == [9, 6, 3, 0]


def test_masks_lists_and_errors():
    assert parse([True, False, True], 3).positions().tolist() == [0, 2]
    assert parse(pd.Series([False, True]), 2).positions().tolist() == [1]
    assert parse([-1, 0, 0], 4) == Index((3, 0, 0))
    assert parse([2, 3, 4], 9) == Range(2, 5)
    assert len(parse([], 5)) == 0
    for bad, n in (([True], 3), ([4], 4), (["a"], 2), (True, 2)):
        with pytest.raises(SelectionError):
            parse(bad, n)
    with pytest.raises(SelectionError):
        Range(0, 11).resolve(10)
    assert [len(x) for x in parse_all(s_[..., 1:3], (4, 5, 6))] == [4, 5, 2]
    with pytest.raises(SelectionError):
        parse_all((1, 2, 3), (4, 4))


def test_mixed_selections_expand_row_major():
    assert expand([Index((3, 1)), Range(0, 2)]).tolist() == [[3, 0], [3, 1], [1, 0], [1, 1]]
    assert expand([Range(0, 2), Range(0, 2)]) is None


def test_interval_names():
    runs = IntervalIndex((Run("0", 0, 2, 1, 1), Run("1", 0, 972, 1, 27), Run("2", 0, 1134, 53, 18)))
    assert len(runs) == 101
    assert runs.select(Range(88, 97)).labels() == runs.labels()[88:97]
    assert [runs.find(n) for n in runs.labels()] == list(range(101))
    assert runs.find("1:1-2") is None and runs.find("nonsense") is None
    odd = IntervalIndex((Run("a:b-c", 0, 7, 3, 2),))
    assert odd.labels() == ["a:b-c:0-3", "a:b-c:2-5", "a:b-c:4-7", "a:b-c:6-7"] and odd.find("a:b-c:6-7") == 3


@given(st.integers(0, 3), st.integers(1, 40), st.integers(1, 12), st.integers(1, 12), st.data())
@settings(max_examples=200, deadline=None)
def test_interval_slices_keep_their_labels(start, width, size, step, data):
    index = IntervalIndex((Run("x", start, start + width, size, step), Run("y", 0, width, step, size)))
    a = data.draw(st.integers(0, len(index)))
    b = data.draw(st.integers(a, len(index)))
    assert index.select(Range(a, b)).labels() == index.labels()[a:b]
    assert all(index.find(n) is not None for n in index.labels())


def test_index_forms_lookup_and_equality():
    assert ListIndex(("a", "b", "a")).find("a") == 2 and ListIndex(("a", "b", "a")).has_duplicates()
    r = RangeIndex(5, 9)
    assert r.labels() == ["5", "6", "7", "8"] and r.find("7") == 2 and r.find("x") is None and r.find("07") is None
    assert equal(r, ListIndex(("5", "6", "7", "8"))) and not equal(r, ListIndex(("5", "6", "7")))
    assert isinstance(r.select(Range(1, 3)), RangeIndex) and isinstance(r.select(Index((0, 0))), ListIndex)
    with pytest.raises(KeyError):
        positions_of(r, ["7", "99"])
