"""The exact set join against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sieveline.operators import setjoin

rnd = random.Random(3)


def some_sets():
    """Copies, near copies, parts, large sets over a common core, members that all have, negative and huge members, empty and null sets."""
    base = [[rnd.randrange(-(2**62), 2**62) for _ in range(rnd.choice([1, 2, 5, 40, 41]))] for _ in range(40)]
    out = []
    for s in base:
        for _ in range(rnd.randrange(1, 7)):
            t = set(s)
            for _ in range(rnd.randrange(0, 1 + len(s) // 3)):
                t.discard(rnd.choice(s))
                t.add(rnd.randrange(60))
            out.append(t)
    big = set(range(1000, 4000))
    out += [big, set(big), set(rnd.sample(sorted(big), 900)) | set(range(200)), set(range(1000, 1010)), {7}, {7}, {7, 8}, {2**63 - 1, -(2**63)}]
    # a group of near copies over several blocks
    out += [set(range(5000, 5040)) - {5000 + rnd.randrange(40)} | {6000 + i} for i in range(60)]
    rnd.shuffle(out)
    rows = [(10 * i, sorted(t, key=lambda _: rnd.random())) for i, t in enumerate(out)]
    return rows + [(99_991, []), (99_992, None)]


def brute(rows, least):
    sets = {i: frozenset(s) for i, s in rows if s}
    first: dict = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    out = {}
    for i, s in sets.items():
        linked, best = set(), None
        for j, t in sets.items():
            if i == j:
                continue
            both, small = len(s & t), min(len(s), len(t))
            if both and both >= np.ceil(small * least - 1e-9):
                if s != t:
                    linked.add(first[t])
                if j < i and (best is None or (both / small, -j) > best):
                    best = (both / small, -j)
        if linked or any(t == s for j, t in sets.items() if j != i):
            out[i] = (first[s], len(linked), -best[1] if best else None, best[0] if best else None)
    return out


@pytest.mark.parametrize("least", [0.4, 0.72, 1.0])
@pytest.mark.parametrize("limits", [{}, {"block_sets": 7, "block_members": 200}])
def test_overlap_join_equals_brute_force(spark, least, limits):
    rows = some_sets()
    df = spark.createDataFrame(rows, "id int, s array<long>").repartition(5)
    got = {r.id: (r.first_id, r.links, r.matched_id, r.score) for r in setjoin.overlap_join(df, least, **limits).collect()}
    assert got == brute(rows, least)


def test_overlap_join_of_nothing(spark):
    assert setjoin.overlap_join(spark.createDataFrame([], "id long, s array<long>"), 0.5).collect() == []
    assert setjoin.overlap_join(spark.createDataFrame([(1, [5]), (None, [5]), (2, [6])], "id long, s array<long>"), 0.5).collect() == []


def test_overlaps_in_steps(monkeypatch):
    monkeypatch.setattr(setjoin, "STEP", 50)
    x = [rnd.sample(range(50), rnd.randrange(20)) for _ in range(12)]
    y = [rnd.sample(range(50), rnd.randrange(20)) for _ in range(9)]
    flat = lambda s: (np.array([m for t in s for m in t], np.int64), np.array([i for i, t in enumerate(s) for _ in t], np.int64))
    got = setjoin.overlaps(*flat(x), *flat(y), 12, 9)
    assert got.tolist() == [[len(set(a) & set(b)) for b in y] for a in x]


def test_members_of_the_same_sets_are_one_entry(spark):
    """Two copies of 300 members share one entry of that weight, not 300 rows; what all three have is another, lone members none."""
    sets = [(1, [*range(300), 1000, 1001]), (2, [*range(300), 1000, 2001]), (3, [1000, 3001]), (4, [4001])]
    out = {r.id: [(e.df, e.w) for e in r.t] for r in setjoin.shared_members(spark.createDataFrame(sets, "id long, s array<long>")).collect()}
    assert out == {1: [(2, 300), (3, 1)], 2: [(2, 300), (3, 1)], 3: [(3, 1)]}


def test_a_member_is_no_row(spark, monkeypatch):
    """What sets share, with each set's size, as by brute force; on the way to their parts members are packed, not a row each."""
    rows = some_sets()
    df = spark.createDataFrame(rows, "id int, s array<long>").repartition(3)
    out = setjoin.sized_members(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    holders: dict = {}
    for i, s in rows:
        for m in s or []:
            holders.setdefault(m, set()).add(i)
    got = {r.id: r for r in out.collect()}
    for i, s in rows:
        groups: dict = {}
        for m in s or []:
            if len(holders[m]) > 1:
                groups.setdefault(frozenset(holders[m]), []).append(m)
        assert got[i].n == len(s or []) and sorted((e.df, e.w) for e in got[i].t) == sorted((len(g), len(m)) for g, m in groups.items())
    assert len(got) == len(rows) and out.schema["id"].dataType == df.schema["id"].dataType


def test_recall_looks_for_shared_members_once(spark, sf, monkeypatch):
    """The exact join and the candidates of ``lsh_recall`` read one table of what texts share."""
    from sieveline.plans import QUERIES

    calls, real = [], setjoin.sized_members
    monkeypatch.setattr(setjoin, "sized_members", lambda s: calls.append("sized") or real(s))
    monkeypatch.setattr(setjoin, "shared_members", lambda s: pytest.fail("dealt out again"))
    assert QUERIES["lsh_recall"](spark, sf).count() <= 2 and calls == ["sized"]
