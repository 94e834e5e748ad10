"""Memory of tasks: array functions work on a batch in parts, and tables are counted without a join of them all."""

import numpy as np
import pyarrow as pa

from geoloom.functions import packed
from geoloom.sources.tables import polygon_report


def test_array_functions_work_in_parts_of_bounded_size(monkeypatch):
    seen = []

    @packed.in_parts
    def doubled(name: pa.Array, lists: pa.Array, more: pa.Array) -> pa.Array:
        seen.append(len(lists.flatten()) + len(more.flatten()))
        n = name.to_numpy()
        return pa.array([[2 * x + n[i] for x in row.as_py()] for i, row in enumerate(lists)], pa.list_(pa.int64()))

    names, lists, more = pa.array(np.arange(50)), pa.array([list(range(k % 7)) for k in range(50)]), pa.array([[1]] * 50)
    monkeypatch.setattr(packed, "PART", 10)
    got = doubled(names, lists, more)
    assert max(seen) < 20 and sum(seen) == len(lists.flatten()) + 50
    assert got.to_pylist() == [[2 * x + k for x in range(k % 7)] for k in range(50)]
    assert doubled(names[:0], lists[:0], more[:0]).to_pylist() == []


def test_tables_are_counted_without_joins(spark):
    t = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "pid long, idx long")
    out = polygon_report(vertices=t, edges=t.where("pid = 1"), none=t.where("idx > 7"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 2, 2, 0), (2, 1, 0, 0)]
