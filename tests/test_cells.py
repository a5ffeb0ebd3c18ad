"""Cell search against brute force, and how much of the vectors it reads."""

from __future__ import annotations

import numpy as np
import pytest

from sieveline.operators import cells

SCHEMA = "id long, v array<float>, size int, cell int"


def rows():
    g = np.random.default_rng(8)
    centre = g.normal(size=(20, 16)) * 3
    out = [(i, (centre[i % 20] + g.normal(size=16) * 0.2).astype(np.float32).tolist()) for i in range(1500)]
    out += [(2000 + i, [1.0] * 16) for i in range(300)]  # one vector, many times
    out += [(3000 + i, g.normal(size=3).astype(np.float32).tolist()) for i in range(60)]  # another length
    out += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] + [1.0] * 15), (4004, [None] + [1.0] * 15), (None, [1.0] * 16), (4005, [-1.0] * 16), (4006, [1e-30] * 16)]
    return out


def brute(rows, every, k):
    kept = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    kept = [(i, v / np.sqrt((v * v).sum())) for i, v in kept]
    out = {}
    for i, q in kept:
        if i % every == 0:
            hits = sorted((-round(float(q @ v), 6), j) for j, v in kept if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in hits if s < 0][:k]
    return {i: h for i, h in out.items() if h}


@pytest.mark.parametrize("options", [{}, {"cells": 1, "block": 10_000}, {"cells": 30, "block": 32, "first": 2}])
def test_cell_search_equals_brute_force(spark, options):
    data = rows()
    df = spark.createDataFrame([(*r, 1, 1) for r in data], SCHEMA).repartition(3)
    hits, counts = cells.cell_search(df, df.where("id % 20 = 0"), 8, **options)
    got: dict = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = brute(data, 20, 8)
    # a cosine may round either way at the sixth digit
    assert got.keys() == want.keys()
    for i, h in want.items():
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in h], abs=2e-6), i
        assert len(h) < 8 or {j for j, s in h if s > h[-1][1] + 2e-6} <= {j for j, _ in got[i]}
    read = counts.collect()
    if options.get("block") == 32:
        assert sum(r.read for r in read) < sum(r.vectors for r in read) / 3


def test_cell_search_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    hits, counts = cells.cell_search(empty, empty, 5)
    assert hits.collect() == [] and counts.collect() == []
    one = spark.createDataFrame([(20, [1.0, 2.0], 1, 1)], SCHEMA)
    assert cells.cell_search(one, one, 5)[0].collect() == []
