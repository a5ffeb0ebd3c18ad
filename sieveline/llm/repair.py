"""Repair of conversation structure: cheapest edits to ``(s?(ua)+)?`` by a lazily determinised weighted automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import cut

#: Costs of the edits, and of leaving a truncated row in.
COSTS = {"rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
#: Conversations of more rows, or of more bytes, are repaired in segments.
LONG_ROWS, LONG_BYTES = 10_000, 1 << 24
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
INF = 1 << 40
#: What may follow: start, after the system row, after a user row, after an assistant row (the end may stand at the first and last).
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
ROLE = ("", "system", "user", "assistant")
#: The state that an inserted or reroled row leads to, and those that kept rows lead to, by initial.
MADE = (USER, USER, ASSISTANT, USER)
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
INITIALS = "sua"
#: Faults of a row, besides none: those that cost when left in, those that have to go.
FINE, CUT, GONE = range(3)
KINDS = 3 * (len(INITIALS) + 1)


class Repairer:
    """The edit automaton, determinised as texts need it.

    After each row, the costs of having edited the rows so far into a prefix
    that ends in each of four grammar states form a vector. Less its smallest
    entry it is a state of a deterministic automaton whose arcs, one a kind of
    row, add a cost; both are kept in tables, filled when first needed. Entries
    so far above the smallest that no cheapest path goes through them count as
    infinite, so the states are few. Cheapest paths are then traced backward
    over tight arcs: sets of grammar states, with the least edit of each, which
    depend on state, kind and set after, and are kept in a table as well.
    """

    def __init__(self, rerole: int, delete: int, insert: int, truncated: int):
        self.rerole, self.delete, self.insert, self.truncated = rerole, delete, insert, truncated
        # from any state: away with a system row, both rows of a pair made
        self.most = 2 * insert + 2 * delete + truncated + rerole
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.backs: dict[tuple[int, int, int], tuple[int, tuple[str, ...]]] = {}
        self.start = self.state(self.closed([0, INF, INF, INF]))[0]

    def state(self, costs: list[int]) -> tuple[int, int]:
        """Number of the normalised vector, and what was taken off."""
        low = min(costs)
        vector = tuple(c - low if c - low <= self.most else INF for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], low

    def closed(self, costs: list[int]) -> list[int]:
        """With rows inserted behind."""
        for _ in range(3):
            for q in range(4):
                costs[MADE[q]] = min(costs[MADE[q]], costs[q] + self.insert)
        return costs

    def arcs(self, kind: int) -> list[tuple[int, str, int, int]]:
        """State before, edit, state after and cost of a row of this kind."""
        role, fault = divmod(kind, 3)
        out = [(q, "D", q, self.delete) for q in range(4)]
        if fault != GONE:
            left = self.truncated if fault == CUT else 0
            out += [(q, "R", MADE[q], self.rerole + left) for q in range(4)]
            out += [(q, "K", KEPT[c, q], left) for q in range(4) for c in INITIALS[role : role + 1] if (c, q) in KEPT]
        return out

    def step(self, state: int, kind: int) -> tuple[int, int]:
        known = self.steps.get((state, kind))
        if known is None:
            before, after = self.vectors[state], [INF] * 4
            for q, _, to, cost in self.arcs(kind):
                after[to] = min(after[to], before[q] + cost)
            known = self.steps[state, kind] = self.state(self.closed(after))
        return known

    def scan(self, kinds: list[tuple[int, int]], state: int) -> tuple[list[int], int]:
        """States before each run of rows and after the last, and the cost added. Runs longer than one are of rows that go."""
        states, cost = [state], 0
        for kind, n in kinds:
            state, more = self.step(state, kind)
            cost += more + (n - 1) * self.delete
            states.append(state)
        return states, cost

    def inserts(self, state: int, after: int) -> tuple[int, list[str]]:
        """A set of states on cheapest paths, with those that reach it by inserting; 'I' for these."""
        vector, edits = self.vectors[state], [""] * 4
        for _ in range(3):
            for q in range(4):
                if not after >> q & 1 and after >> MADE[q] & 1 and vector[q] < INF and vector[q] + self.insert == vector[MADE[q]]:
                    after |= 1 << q
                    edits[q] = "I"
        return after, edits

    def back(self, state: int, kind: int, after: int) -> tuple[int, tuple[str, ...]]:
        """Grammar states on cheapest paths before a row, given those after it, and the least edit of each."""
        known = self.backs.get((state, kind, after))
        if known is None:
            to, more = self.step(state, kind)
            here, there, tight = self.vectors[state], self.vectors[to], [""] * 4
            for q, edit, q2, cost in self.arcs(kind):
                if after >> q2 & 1 and here[q] < INF and here[q] + cost == more + there[q2] and not ("" < tight[q] < edit):
                    tight[q] = edit
            rows = sum(1 << q for q in range(4) if tight[q])
            before = rows
            for _ in range(3):
                for q in range(4):
                    if before >> MADE[q] & 1 and here[q] < INF and here[q] + self.insert == here[MADE[q]]:
                        before |= 1 << q
                        if not tight[q] or tight[q] > "I":
                            tight[q] = "I"
            known = self.backs[state, kind, after] = before, tuple(tight)
        return known

    def trace(self, kinds: list[tuple[int, int]], states: list[int], after: int) -> tuple[int, list[tuple[str, ...]]]:
        """Least edits at each place, from the set of states on cheapest paths after the last row back to the first."""
        edits: list[tuple[str, ...]] = []
        for k in range(len(kinds) - 1, -1, -1):
            after, least = self.back(states[k], kinds[k][0], after)
            edits.append(least)
        edits.reverse()
        return after, edits

    def ends(self, state: int) -> tuple[int, int]:
        """What ending here adds, and the states in which cheapest edits end."""
        vector = self.vectors[state]
        least = min(vector[q] for q in ENDS)
        return least, sum(1 << q for q in ENDS if vector[q] == least)


def walk(kinds: list[tuple[int, int]], edits: list[tuple[str, ...]], q: int, last: list[str]) -> tuple[str, list[tuple[int, int]], int]:
    """Edits in order from state q; which row (-1: inserted) each row left comes from, and the state it leads to; the state after."""
    audit, rows = [], []
    for k, (kind, n) in enumerate(kinds):
        while True:
            edit = edits[k][q]
            audit.append(edit * n if edit == "D" else edit)
            if edit == "D":
                break
            if edit == "K":
                q = KEPT[INITIALS[kind // 3], q]
                rows.append((k, q))
                break
            q = MADE[q]
            rows.append((-1 if edit == "I" else k, q))
            if edit == "R":
                break
    while last[q]:
        audit.append("I")
        q = MADE[q]
        rows.append((-1, q))
    return "".join(audit), rows, q


def _faults(text: Column) -> Column:
    """FINE, CUT or GONE by the text alone."""
    core = F.rtrim(text, F.lit(SPACE))
    return F.when(core == "", GONE).when(F.right(core, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)


def _prepared(rows: DataFrame, key: str) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(F.col(key).alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), _faults(text).alias("fault"))


def _kind(role: str, fault: int) -> int:
    at = INITIALS.find(role[:1]) if role else -1
    return 3 * (at if at >= 0 else len(INITIALS)) + fault if fault != GONE else GONE


def _legal(one: str, two: str) -> bool:
    return one[:1] + two[:1] in ("su", "ua", "au")


SUMMARY = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id {key}, segment long, place long, edit string, role string, text string"


def _arrow(schema: str, columns: list[list], key: pa.DataType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names = [c.strip().split(" ", 1) for c in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, key if k == 0 else kinds[t]) for k, (c, (_, t)) in enumerate(zip(columns, names, strict=True))], names=[n for n, _ in names])


def _repaired(rows: list[tuple], found: list[tuple[int, int]], audit: str) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each row that is left."""
    kept = (e for e in audit if e != "D")
    for edit, (k, q) in zip(kept, found, strict=True):
        yield (edit, rows[k][1], rows[k][2]) if edit == "K" else (edit, ROLE[q], rows[k][2] if k >= 0 else "")


class _Typed:
    """Batches that remember the type of their first column."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.batches, self.type = batches, pa.null()

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        for batch in self.batches:
            self.type = batch.column(0).type
            yield batch


def _keyed(batches: Iterable[pa.RecordBatch], keys: int = 2) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that agree in the first ``keys`` columns, which stand together."""
    own, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:keys] != own:
                yield own, rows
                rows = []
            own = row[:keys]
            rows.append(row[keys:])
    if rows:
        yield own, rows


def _whole(batches: Iterable[pa.RecordBatch], costs: dict[str, int], as_rows: bool) -> Iterator[pa.RecordBatch]:
    """Conversations that fit a task's memory, one after the other."""
    table = Repairer(**costs)
    out: list[tuple] = []
    size, batches = 0, _Typed(batches)

    def full() -> pa.RecordBatch:
        return _arrow(ROWS if as_rows else SUMMARY, [list(c) for c in zip(*out, strict=True)], batches.type)

    for (own,), rows in _keyed(batches, 1):
        seen, faults, kinds = set(), [0, 0, 0], []
        for _, role, text, fault in rows:
            what = 0 if fault == GONE else 1 if (role, text) in seen else 2 if fault == CUT else None
            seen.add((role, text))
            if what is not None:
                faults[what] += 1
            kinds.append((_kind(role, GONE if what in (0, 1) else fault), 1))
        states, cost = table.scan(kinds, table.start)
        more, after = table.ends(states[-1])
        after, last = table.inserts(states[-1], after)
        _, edits = table.trace(kinds, states, after)
        audit, found, _ = walk(kinds, edits, START, last)
        left = _repaired(rows, found, audit)
        if as_rows:
            some = [(own, 0, n, *r) for n, r in enumerate(left)]
            out += some
            size += sum(len(r[5]) for r in some) + len(some)
        else:
            turns = [r[0] for r in rows if r[0] is not None]
            gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
            illegal = sum(not _legal(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False))
            digest = hashlib.sha256()
            for n, (_, role, text) in enumerate(left):
                digest.update(("\n" * (n > 0) + f"{role}:{text}").encode())
            out.append((own, gaps, *faults, illegal, cost + more, audit, digest.hexdigest()))
            size += len(audit) + 200
        if size > 1 << 20:
            yield full()
            out, size = [], 0
    if out:
        yield full()


def _segments(rows: DataFrame) -> DataFrame:
    """Rows of long conversations in order, in segments: ``conv_id, segment, at, turn, role, text, fault, n, dup``.

    Equal rows of one turn are one row with their number first, so that no
    group of copies meets in one task; ``dup`` says that all of them are
    duplicates, otherwise all but the first. Rows are then dealt by range, so
    that a conversation spreads over as many segments as it is long.
    """
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    once = rows.groupBy("conv_id", "turn", "role", "text", "fault").agg(F.count("*").alias("n")).withColumn("digest", digest)
    once = cut(once, "runs")
    first = once.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.count("*").alias("m"), F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("first")).where("m > 1")
    known = once.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    known = known.select("conv_id", "turn", "role", "text", "fault", "n", later.alias("dup"))
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt, "segments")
    return dealt.withColumn("segment", F.shiftright("_at", 33)).withColumnRenamed("_at", "at")


def _runs(rows: list[tuple]) -> tuple[list[tuple[int, int]], list[tuple], list[int]]:
    """Runs of kinds, the row of each run, and the numbers of blank, duplicate and truncated rows. Rows: role, text, fault, n, dup."""
    kinds, of, faults = [], [], [0, 0, 0]
    for row in rows:
        role, _, fault, n, dup = row
        if fault == GONE:
            faults[0] += n
            runs = [(GONE, n)]
        else:
            faults[1] += n if dup else n - 1
            faults[2] += fault == CUT and not dup
            runs = [(GONE, n)] if dup else [(_kind(role, fault), 1), (GONE, n - 1)]
        for run in runs:
            if run[1]:
                kinds.append(run)
                of.append((None, *row[:2]))
    return kinds, of, faults


def _maps(batches: _Typed, costs: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Each segment as a map of costs from four states to four, with its counts. Columns: segment and conversation, then :func:`_runs`' rows."""
    table = Repairer(**costs)
    for (own, segment), rows in _keyed(batches):
        kinds, _, faults = _runs(rows)
        costs_of = []
        for q in range(4):
            states, cost = table.scan(kinds, table.state([0 if q == p else INF for p in range(4)])[0])
            costs_of += [cost + v if v < INF else INF for v in table.vectors[states[-1]]]
        illegal = sum(n - 1 for *_, n, _ in rows) + sum(not _legal(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array([own], batches.type), pa.array([segment]), pa.array([costs_of], pa.list_(pa.int64())), *(pa.array([x]) for x in (*faults, illegal, rows[0][0][:1], rows[-1][0][:1]))],
            names=["conv_id", "segment", "map", "blank", "duplicate", "truncated", "illegal", "head", "tail"],
        )


def _joined(table: Repairer, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's segments in order: costs on entry, states on cheapest paths on exit, and the whole cost."""
    pdf = pdf.sort_values("segment")
    maps = [[list(map(int, m[4 * q : 4 * q + 4])) for q in range(4)] for m in pdf["map"]]
    entry, costs = [], list(table.vectors[table.start])
    for m in maps:
        entry.append(costs)
        costs = [min(INF, min(costs[q] + m[q][to] for q in range(4))) for to in range(4)]
    whole = min(costs[q] for q in ENDS)
    exits: list[int] = []
    ahead = [0 if q in ENDS else INF for q in range(4)]
    for k in range(len(maps) - 1, -1, -1):
        after = costs if k == len(maps) - 1 else entry[k + 1]
        exits.append(sum(1 << q for q in range(4) if after[q] + ahead[q] == whole))
        ahead = [min(INF, min(maps[k][q][to] + ahead[to] for to in range(4))) for q in range(4)]
    out = pdf[["conv_id", "segment"]].copy()
    out["entry"], out["exit"], out["cost"] = entry, exits[::-1], whole
    out["final"] = [k == len(maps) - 1 for k in range(len(maps))]
    return out


def _entered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's pieces, the state in which each segment is entered."""
    q, out = START, []
    for segment, some in pdf.groupby("segment", sort=True):
        out.append((segment, q))
        q = int(some.loc[some["start"] == q, "stop"].iloc[0])
    return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], "segment": [s for s, _ in out], "state": [q for _, q in out]})


def _walked(batches: Iterable[pa.RecordBatch], costs: dict[str, int], as_rows: bool) -> Iterator[pa.RecordBatch]:
    """Edits of each segment, by the state on entry: all that may be entered, or, as rows, the one that is.

    Columns: conversation and segment, then entry costs, exit states, whether last, state entered, and :func:`_runs`' rows.
    """
    table = Repairer(**costs)
    batches = _Typed(batches)
    for (own, segment), rows in _keyed(batches):
        entry, exit_, final, state = rows[0][:4]
        kinds, of, _ = _runs([r[4:] for r in rows])
        states, _ = table.scan(kinds, table.state(list(entry))[0])
        after, last = table.inserts(states[-1], exit_)
        before, edits = table.trace(kinds, states, after)
        if not final:  # rows inserted at a boundary belong to the segment behind it, in which every way of entry is known
            last = [""] * 4
        starts = [state] if as_rows else [q for q in range(4) if before >> q & 1]
        got = [walk(kinds, edits, q, last) for q in starts]
        if as_rows:
            audit, found, _ = got[0]
            left = list(_repaired(of, found, audit))
            columns = [[own] * len(left), [segment] * len(left), list(range(len(left))), *([r[i] for r in left] for i in range(3))]
            yield _arrow(ROWS, columns, batches.type)
        else:
            yield pa.RecordBatch.from_arrays(
                [pa.array([own] * len(starts), batches.type), *(pa.array(c) for c in ([segment] * len(starts), starts, [g[2] for g in got], [g[0] for g in got]))], names=["conv_id", "segment", "start", "stop", "audit"]
            )


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's rows, which pass one by one."""
    digest, own, some = hashlib.sha256(), None, False
    batches = _Typed(batches)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own], batches.type), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if some and conv != own:
                yield done()
                digest, some = hashlib.sha256(), False
            digest.update(("\n" * some + f"{role}:{text}").encode())
            own, some = conv, True
    if some:
        yield done()


def _long(rows: DataFrame, costs: dict[str, int], key: str, as_rows: bool) -> DataFrame:
    """Long conversations: maps of segments compose, each segment is traced by itself, pieces are put together."""
    seg = _segments(rows)
    body = ("role", "text", "fault", "n", "dup")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _maps(_Typed(batches), costs)

    # the text is not needed here, only what it counts as
    plain = seg.select("conv_id", "segment", "role", F.lit("").alias("text"), "fault", "n", "dup", "at")
    plain = plain.repartition("segment").sortWithinPartitions("segment", F.col("conv_id").asc_nulls_first(), "at").drop("at")
    known = cut(plain.mapInArrow(maps, f"conv_id {key}, segment long, map array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string"), "maps")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return _joined(Repairer(**costs), pdf)

    # one row a segment, of which a conversation has at most as many as there are partitions
    ways = cut(known.groupBy("conv_id").applyInPandas(joined, f"conv_id {key}, segment long, entry array<long>, exit long, cost long, final boolean"), "ways")
    ways = ways.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "entry", "exit", "final", "cost")

    def traced(entered: DataFrame, schema: str, rows_out: bool) -> DataFrame:
        df = seg.join(entered, same("conv_id", "c") & (F.col("segment") == F.col("s")))
        df = df.repartition("segment").sortWithinPartitions("segment", F.col("conv_id").asc_nulls_first(), "at")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _walked(batches, costs, rows_out)

        return df.select("conv_id", "segment", "entry", "exit", "final", "state", *body).mapInArrow(run, schema)

    pieces = cut(traced(ways.withColumn("state", F.lit(0).cast("long")), f"conv_id {key}, segment long, start long, stop long, audit string", False), "pieces")
    # the state on entry follows from the one before: small rows, one a segment and state

    def entered_by(pdf: pd.DataFrame) -> pd.DataFrame:
        return _entered(pdf)

    entered = cut(pieces.select("conv_id", "segment", "start", "stop").groupBy("conv_id").applyInPandas(entered_by, f"conv_id {key}, segment long, state long"), "entered")
    named = entered.select(F.col("conv_id").alias("c2"), F.col("segment").alias("s2"), "state")
    out = cut(traced(ways.join(named, same("c", "c2") & (F.col("s") == F.col("s2"))).drop("c2", "s2"), ROWS.format(key=key), True), "repaired")
    if as_rows:
        return out
    ordered = out.select("conv_id", "segment", "place", "role", "text").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment", "place")
    digests = ordered.mapInArrow(_hashed, f"conv_id {key}, repaired_sha256 string")
    audit = pieces.join(named, same("conv_id", "c2") & (F.col("segment") == F.col("s2")) & (F.col("start") == F.col("state")))
    audit = audit.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    before = F.lag("tail").over(Window.partitionBy("conv_id").orderBy("segment"))
    broken = F.when(before.isNull() | F.concat(before, "head").isin("su", "ua", "au"), 0).otherwise(1)
    counts = known.withColumn("illegal", F.col("illegal") + broken).groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    cost = ways.groupBy(F.col("c").alias("conv_id")).agg(F.first("cost").alias("cost"))
    whole = turns
    for part in (counts, cost, audit, digests):
        part = part.withColumnRenamed("conv_id", "c3")
        whole = whole.join(part, same("conv_id", "c3"), "left").drop("c3")
    nothing = hashlib.sha256().hexdigest()
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _run(rows: DataFrame, costs: dict[str, int], key: str, long_rows: int, long_bytes: int, as_rows: bool) -> DataFrame:
    ship_package(rows.sparkSession)
    ready = _prepared(rows, key)
    kind = dict(ready.dtypes)["conv_id"]
    sizes = ready.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = cut(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("c")), "long")
    some = bool(long.take(1))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    short = ready.join(long, same, "left_anti") if some else ready
    short = short.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    schema = (ROWS if as_rows else SUMMARY).format(key=kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _whole(batches, costs, as_rows)

    out = short.mapInArrow(run, schema)
    return out.unionByName(_long(ready.join(long, same, "left_semi"), costs, kind, as_rows)) if some else out


def repair_summary(rows: DataFrame, costs: dict[str, int] = COSTS, *, key: str = "conv_id", long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The cheapest repair of every conversation and what was wrong: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows have ``turn, role, text``; a conversation's are taken by turn (nulls
    first), then role and text by code point. Null roles and texts count as one
    space. A row's first fault counts: blank, duplicate (of an earlier role and
    text), truncated (no ``.!?`` at the end). Edits are Keep, Rerole, Delete
    (needed for the first two faults) and Insert; a truncated row left in costs
    more. ``audit`` has the edits of the cheapest repair that leaves the initials
    ``(s?(ua)+)?``, of several the least by ASCII. An empty role has no initial
    and is never kept. ``repaired_sha256`` is of ``role:text``, joined by newlines.

    Conversations within ``long_rows`` and ``long_bytes`` are repaired whole, in
    a stream over sorted partitions. Longer ones are dealt by range into
    segments, whose cost maps compose and which are traced one by one; only
    their digest passes through one task, row by row, as SHA-256 has to. A null
    id is one conversation. Rows are what they hold: rows that repeat are
    duplicates. An empty table gives an empty result. Other columns are ignored.
    """
    return _run(rows, costs, key, long_rows, long_bytes, False)


def repaired_rows(rows: DataFrame, costs: dict[str, int] = COSTS, *, key: str = "conv_id", long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations: ``conv_id, segment, place, edit, role, text``, in the order of segment and place; see :func:`repair_summary`."""
    return _run(rows, costs, key, long_rows, long_bytes, True)


def damage(rows: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """Faults for tests, by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, without ``.!?``, repeated, as user. Nulls become one space in what is hashed, in roles and in texts."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(key), F.lit(":"), blank("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    out = rows.where(fault != 0).select(F.col(key).alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("_copy"))
    return out.drop("_copy")


def damaged_and_repaired(conversations: DataFrame, **options: int) -> DataFrame:
    """:func:`repair_summary` of damaged conversations; one without rows left has zeros and an empty audit."""
    found = repair_summary(damage(conversations), **options).withColumnRenamed("conv_id", "c")
    ids = conversations.select("conv_id").distinct()
    zeros = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


#: Forward over the rows, the cheapest and least edits into each grammar state.
SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
h AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS f FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM d),
r AS MATERIALIZED (SELECT *, role[1] AS c, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN core[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
made AS (SELECT * FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) m(q, q2, role)),
ins AS (SELECT q, q AS q2, 0 AS cost, '' AS audit, []::VARCHAR[] AS rows FROM made UNION ALL SELECT q, q2, 5, 'I', [role || ':'] FROM made
  UNION ALL SELECT a.q, b.q2, 10, 'II', [a.role || ':', b.role || ':'] FROM made a JOIN made b ON b.q = a.q2),
kept AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) k(q, c, q2)),
arcs AS MATERIALIZED (
  SELECT r.conv_id, r.i, m.q, m.q AS q2, 2 AS cost, 'D' AS edit, []::VARCHAR[] AS rows FROM r, made m
  UNION ALL SELECT r.conv_id, r.i, m.q, m.q2, 1 + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'R', [m.role || ':' || r.text] FROM r, made m WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT r.conv_id, r.i, k.q, k.q2, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', [r.role || ':' || r.text] FROM r JOIN kept k ON k.c = r.c WHERE fault NOT IN ('blank', 'duplicate')),
st AS (SELECT c.conv_id, 0::BIGINT AS i, ins.q2 AS q, ins.cost, ins.audit, ins.rows FROM (SELECT DISTINCT conv_id FROM r) c JOIN ins ON ins.q = 0
    QUALIFY row_number() OVER (PARTITION BY c.conv_id, ins.q2 ORDER BY ins.cost) = 1
  UNION ALL
  SELECT s.conv_id, a.i, ins.q2, s.cost + a.cost + ins.cost, s.audit || a.edit || ins.audit, list_concat(s.rows, a.rows, ins.rows)
    FROM st s JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.i = s.i + 1 AND a.q = s.q JOIN ins ON ins.q = a.q2
    QUALIFY row_number() OVER (PARTITION BY s.conv_id, ins.q2 ORDER BY s.cost + a.cost + ins.cost, s.audit || a.edit || ins.audit) = 1),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM r GROUP BY conv_id),
p AS (SELECT conv_id, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT conv_id, c, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id),
e AS (SELECT st.* FROM st JOIN n ON n.conv_id IS NOT DISTINCT FROM st.conv_id AND st.i = n.n WHERE st.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY st.conv_id ORDER BY st.cost, st.audit) = 1)
SELECT c.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
  coalesce(p.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
