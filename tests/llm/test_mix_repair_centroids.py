"""Mixing, repair and clustering against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from sieveline.llm import centroids, mixing, repair

rnd = random.Random(11)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- mixing ---------------------------------------------------------------

DOCS = "doc_id long, text string, source string, size int, target string, taken string, first int, last int, salt int, rest int, end int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "t", "t", 1, 1, 1, 1, 1) for i, t, s in rows], DOCS)


def brute_targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    """Rounds of clamping in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped: set = set()
    while True:
        rest = Fraction(3, 2) * sum(sizes.values()) - sum(2 * sizes[s] for s in clamped)
        free = sum(w[s] for s in sizes if s not in clamped)
        over = {s for s in sizes if s not in clamped and w[s] * rest / free > 2 * sizes[s]}
        if not over:
            return {s: Fraction(2 * sizes[s]) if s in clamped else w[s] * rest / free for s in sizes}
        clamped |= over


def mixture_rows():
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t", None), (3, "one", "a"), (3, "one", "a"), (None, "two words", None), (None, None, None), (7, "é 中 " * 9000, "é"), (8, "x" * 50_000, "Z")]
    rows += [(10 + i, " ".join(["w"] * rnd.randrange(40)), rnd.choice(["hot"] * 5 + ["a", "b", "", None, "z", "é"])) for i in range(600)]
    return rows


def test_mix_equals_brute_force(spark):
    rows = mixture_rows()
    got = mixing.mix(docs_of(spark, rows)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, s in rows)
    sizes: Counter = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size
        whole = int(r.target // r.source_size) if r.source_size else 0
        assert whole * r.size <= r.taken <= (whole + 1) * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= Fraction(1, 2) for s in sizes)
    # one document a source at most is taken in part
    parts = Counter(r.source for r in got if r.size and r.taken % r.size)
    assert all(n == 1 for n in parts.values())


def test_mix_equals_its_sql(spark):
    rows = mixture_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = mixing.mix(docs_of(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(mixing.SQL).fetchall())


def test_mix_reruns_agree_and_seeds_differ(spark):
    rows = mixture_rows()
    key = lambda df: Counter((r.doc_id, r.source, r.taken) for r in df.collect())
    one = key(mixing.mix(docs_of(spark, rows)))
    rnd.shuffle(rows)
    assert key(mixing.mix(docs_of(spark, rows).repartition(7))) == one
    assert key(mixing.mix(docs_of(spark, rows), seed=12)) != one


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "b")], [(1, "one two three", "a")]])
def test_mix_of_little(spark, rows):
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    if rows and rows[0][1] == "one two three":
        assert (got[0].target, got[0].taken) == (4.5, 5)  # half up
    else:
        assert all(r.taken == 0 and r.target == 0 for r in got)


def test_global_ranks(spark):
    df = spark.range(1000).selectExpr("cast(id * 7919 % 1000 as string) as s")
    got = {r.s: r.place for r in mixing.global_ranks(df, df["s"].asc_nulls_last()).collect()}
    assert got == {s: i for i, s in enumerate(sorted(got))}


# --- repair ---------------------------------------------------------------

NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPACES = " \t\n\x0b\x0c\r"


def brute_repair(rows: list[tuple]) -> tuple:
    """Cheapest and least edits by going through every state after every row; rows are (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen, kinds = Counter(), set(), []
    for _, role, text in rows:
        core = text.strip(SPACES) if text.strip(SPACES) else ""
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        kinds.append(fault)

    def inserted(best):
        for _ in range(3):
            for q, (c, audit, left) in list(best.items()):
                to, role = NEXT[q]
                new = (c + 5, audit + "I", (*left, f"{role}:"))
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, kinds, strict=True):
        after: dict = {}

        def offer(q, new, after=after):
            if q not in after or new[:2] < after[q][:2]:
                after[q] = new

        for q, (c, audit, left) in best.items():
            offer(q, (c + 2, audit + "D", left))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                offer(NEXT[q][0], (c + 1 + more, audit + "R", (*left, f"{NEXT[q][1]}:{text}")))
                if (q, role[:1]) in KEEP:
                    offer(KEEP[q, role[:1]], (c + more, audit + "K", (*left, f"{role}:{text}")))
        best = inserted(after)
    cost, audit, left = min((best[q] for q in (0, 3) if q in best), key=lambda b: b[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest(), left


def odd_conversations():
    texts = [None, "", " \n", "Hello.", "Hello", "What? ", "stop!\t\x0b", "cut off,", "a.b", "é中", "…", "x" * 20_000 + "."]
    roles = [None, "", "system", "user", "assistant", "tool", "User", "supervisor", "u", "a"]
    rows = []
    for c in range(150):
        for _ in range(rnd.randrange(1, 12)):
            rows.append((c if c else None, rnd.choice([None, *range(6)]), rnd.choice(roles if c % 3 else roles[2:5]), rnd.choice(texts) if c % 2 else rnd.choice(texts) or f"t{rnd.random()}."))
    # long: many turns, runs of copies, long stretches of rows that have to go
    for t in range(700):
        role = ("user", "assistant")[t % 2] if rnd.random() < 0.9 else rnd.choice(roles)
        rows.append((900, t, role, f"text {t}." if rnd.random() < 0.8 else rnd.choice(texts)))
    rows += [(901, 5, "user", "same.")] * 400 + [(901, 6 + t, "assistant", "again.") for t in range(300)] + [(901, 3, "system", "first.")]
    rows += [(902, t, "user", "") for t in range(200)] + [(903, None, "assistant", "end.")] * 3
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, fault int, n int, at int, segment int, audit string, c int, dup int"


@pytest.fixture(scope="module")
def conversations(spark):
    rows = odd_conversations()
    by: dict = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, "x", 1, 1) for r in rows], SCHEMA)
    return df, {c: brute_repair(r) for c, r in by.items()}


@pytest.mark.parametrize("limits", [{}, {"long_rows": 0}, {"long_rows": 20}, {"long_bytes": 1000}])
def test_repair_equals_brute_force(conversations, limits):
    df, want = conversations
    got = {r[0]: tuple(r)[1:] for r in repair.repair_summary(df, **limits).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}


@pytest.mark.parametrize("limits", [{}, {"long_rows": 20}])
def test_repaired_rows_are_legal(conversations, limits):
    df, want = conversations
    left: dict = {}
    for r in repair.repaired_rows(df, **limits).orderBy("segment", "place").collect():
        left.setdefault(r.conv_id, []).append(r)
    for c, w in want.items():
        rows = left.get(c, [])
        assert tuple(f"{r.role}:{r.text}" for r in rows) == w[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in rows))
        assert "".join(r.edit for r in rows) == w[-3].replace("D", "")


def test_damage_and_repair_equal_their_sql(spark):
    rows = odd_conversations()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    # the SQL's recursion carries whole texts: one long conversation is enough
    rows = [r for r in rows if r[0] is None or r[0] < 900 or (r[0] == 901 and r[1] < 60)]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, "x", 1, 1) for r in rows], SCHEMA)
    want = Counter(con.execute(repair.SQL).fetchall())
    assert Counter(map(tuple, repair.damaged_and_repaired(df).collect())) == want
    assert Counter(map(tuple, repair.damaged_and_repaired(df, long_rows=15).collect())) == want


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.damaged_and_repaired(empty).collect() == [] and repair.repaired_rows(empty).collect() == []
    # crc32('4:4') % 20 is no 0 for all turns: find one that is dropped
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    got = repair.damaged_and_repaired(spark.createDataFrame([(4, turn, "user", "x.", 1, 1, 1, 1, "x", 1, 1)], SCHEMA)).collect()
    assert list(map(tuple, got)) == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_states_are_few():
    table = repair.Repairer(**repair.COSTS)
    seen = []
    for _ in range(4):
        for _ in range(500):
            table.scan([(rnd.randrange(repair.KINDS), 1) for _ in range(60)], table.start)
        seen.append(len(table.vectors))
    assert seen[-1] < 500 and seen[-1] - seen[0] < seen[0] / 4


# --- clustering -----------------------------------------------------------


def brute_clusters(rows: list[tuple], k=40, rounds=5, size=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    if not start:
        return []
    centres = [list(v) for _, v in start]
    points = np.array([v for _, v in kept], np.int64)

    def assigned():
        c = np.array(centres, np.int64)
        d = np.stack([((points - x) ** 2).sum(1) for x in c], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        a, _ = assigned()
        for j in range(len(centres)):
            if (a == j).any():
                centres[j] = [int(s) // int((a == j).sum()) for s in points[a == j].sum(0)]
    a, d = assigned()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, int(j), int(x), int(d[a == j].sum()), int(d.sum()), sha[j]) for (i, _), j, x in zip(kept, a, d, strict=True)]


VECTORS = "vec_id long, embedding array<float>, q int, cluster string, distance string, ids int, total int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "d", 1, 1) for i, v in rows], VECTORS)


def odd_vectors():
    g = np.random.default_rng(5)
    near = g.normal(size=(12, 64))
    rows = [(i, (near[i % 12] + g.normal(size=64) * 0.02).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.25] * 64) for i in range(500)]  # one vector, many times
    rows += [(2000 + i, [float(i % 2)] * 64) for i in range(6)] + [(2000, [0.5] * 64), (2000, [0.5] * 64)]  # ties, repeated ids
    rows += [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [None] + [1.0] * 63), (3004, [float("nan")] * 64), (3005, [float("inf")] + [0.0] * 63), (None, [0.1] * 64), (3006, [5000.0] * 64), (3007, [-131072.0] * 64)]
    return rows


@pytest.mark.parametrize("tree_rows", [8192, 50])
def test_clusters_equal_brute_force(spark, tree_rows):
    rows = odd_vectors()
    got = centroids.cluster_vectors(vectors_of(spark, rows), tree_rows=tree_rows).collect()
    assert Counter(map(tuple, got)) == Counter(brute_clusters(rows))


def test_clusters_of_few_and_none(spark):
    few = odd_vectors()[:5]
    assert Counter(map(tuple, centroids.cluster_vectors(vectors_of(spark, few)).collect())) == Counter(brute_clusters(few))
    assert centroids.cluster_vectors(vectors_of(spark, [])).collect() == [] and centroids.cluster_vectors(vectors_of(spark, [(1, None)])).collect() == []


def test_balls_hold_their_rows_and_prune():
    g = np.random.default_rng(9)
    centre = g.integers(-3000, 3000, (30, 64))
    points = centre[g.integers(0, 30, 4000)] + g.integers(-20, 20, (4000, 64))
    tree = centroids.BallTree(points)
    for b in range(len(tree.child)):
        some = points[tree.order[tree.start[b] : tree.end[b]]]
        assert (some.sum(0) == tree.total[b]).all() and np.sqrt(((some - tree.pivot[b]) ** 2).sum(1)).max() <= tree.radius[b]
    whole = rows = 0
    for ball, which, _ in centroids.descend(tree, points[tree.order], centre):
        whole, rows = (whole + len(which), rows) if ball else (whole, rows + len(which))
    assert whole and rows < len(points) / 2
