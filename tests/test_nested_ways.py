"""Nested chords of small maps by windows, and of giant ones in ranges over all tasks."""

from geoloom.operators import regions
from geoloom.plans import ordered
from geoloom.plans.fixtures import nested_map
from geoloom.plans.iterate import cut

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_chords_are_put_in_by_windows_as_in_ranges(spark, monkeypatch):
    tables = [*map(cut, nested_map(spark, SF))]
    wide = [rows(t) for small in (0, 500) for t in regions.put_chords(*tables, small=small)]  # all maps giant, and some
    assert wide[:3] == wide[3:]

    def sliced(*_):
        raise AssertionError("small maps are sorted in ranges")

    monkeypatch.setattr(ordered, "sliced", sliced)
    assert [rows(t) for t in regions.put_chords(*tables)] == wide[:3]
