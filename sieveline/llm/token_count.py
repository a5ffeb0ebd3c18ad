"""Token counts by a compiled finite-state transducer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship_package
from .textbytes import chunks

SPACE = "▁"
#: Marks a symbol outside the vocabulary; it never merges and costs its UTF-8 bytes.
OUTSIDE = "\0outside"
#: Longer stretches without a synchronising symbol are cut into chunks of this many symbols.
CHUNK = 1024
#: Stretches remembered, bytes of them, and transitions compiled, by a Python worker before it starts afresh.
REMEMBERED, REMEMBERED_BYTES, COMPILED = 1_000_000, 64 << 20, 500_000


class Transducer:
    """Deterministic transducer whose transitions carry emitted-token counts.

    Compiled from a BPE vocabulary with scores (best score first, leftmost on
    ties; symbols outside it fall back to bytes). An encoding is the one
    sequence of tokens whose neighbours all stay apart when merged on their
    own, so the last token after each symbol follows from those before it, as
    far back as the longest token reaches. A state is that bounded history: the
    longest suffix that begins a token, and for each position in it from which a
    token may still start the last token and the count relative to now. Reading a symbol changes the count by
    the transition's number, which may be negative as tokens merge. States and
    transitions are determinised on first use.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.prefixes = {t[:k] for t in scores for k in range(1, len(t) + 1)} | {""}
        # least recently used results go beyond the bound
        self.single, self.apart, self.suffix = (lru_cache(COMPILED)(f) for f in (self._single, self._apart, self._suffix))
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.size = 0
        self.start = self._state(("", ((0, None, 0),)))

    def merge(self, text: str) -> list[str]:
        """The vocabulary's merges carried out one by one; defines ``apart`` and serves tests."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _single(self, t: str) -> bool:
        return t in self.scores and self.merge(t) == [t]

    def _apart(self, a: str, b: str) -> bool:
        return self.merge(a + b) == [a, b]

    def _state(self, key: tuple) -> dict:
        """A state is the table of its compiled moves, symbol -> (state, count); None leads to its key."""
        if (state := self.states.get(key)) is None:
            state = self.states[key] = {None: key}
        return state

    def _suffix(self, suffix: str, symbol: str) -> tuple[str, dict[int, str], frozenset[int]]:
        """Longest suffix that begins a token; tokens that end here, by size - 1; sizes at which one may go on."""
        grown = suffix + symbol
        while grown not in self.prefixes:
            grown = grown[1:]
        n = len(grown)
        ends = {k - 1: grown[n - k :] for k in range(1, n + 1) if self.single(grown[n - k :])}
        return grown, ends, frozenset(k - 1 for k in range(1, n + 1) if grown[n - k :] in self.prefixes)

    def _compile(self, state: dict, symbol: str) -> tuple[dict, int]:
        suffix, history = state[None]
        grown, ends, open_ = self.suffix(suffix, symbol)
        token, rel, cost = OUTSIDE, 0, len(symbol.encode())
        for back, prev, count in reversed(history):  # longest token first
            t = ends.get(back)
            if t is not None and (prev is None or prev == OUTSIDE or self.apart(prev, t)):
                token, rel, cost = t, count, 1
                break
        delta = rel + cost
        older = [(j + 1, prev, count - delta) for j, prev, count in history if j in open_]
        move = (self._state((grown, ((0, token, 0), *older))), delta)
        state[symbol] = move
        self.size += 1
        return move

    def run(self, state: dict, text: str) -> tuple[dict, int]:
        """State after ``text``, and by how much the count of tokens changed."""
        total = 0
        for symbol in text:
            if symbol in state:
                state, delta = state[symbol]
            else:
                state, delta = self._compile(state, symbol)
            total += delta
        return state, total


class StateMap:
    """What a stretch of text does to entry states: exit state and change of the count for each.

    ``entries`` are worked out at once, before it is known which state the text
    before the stretch leads to; a state that is not among them is added when
    it occurs. The map of two neighbouring stretches is their composition.
    """

    def __init__(self, run, entries: Iterable[dict]):
        self.run, self.known = run, {}
        for state in entries:
            self(state)

    def __call__(self, state: dict) -> tuple[dict, int]:
        if id(state) not in self.known:  # states live as long as the transducer
            self.known[id(state)] = (state, *self.run(state))
        return self.known[id(state)][1:]

    def then(self, other: StateMap) -> StateMap:
        """This map, then the other's: associative, so neighbours combine in any order."""

        def run(state: dict) -> tuple[dict, int]:
            middle, x = self(state)
            end, y = other(middle)
            return end, x + y

        return StateMap(run, [entry for entry, _, _ in self.known.values()])


def entry_states(fst: Transducer, before: str, reach: int) -> list[dict]:
    """States in which a chunk may be entered: those that the text before it leads to from the start state, begun at each of its last ``reach`` symbols."""
    found = {}
    for k in range(max(0, len(before) - reach), len(before)):
        state, _ = fst.run(fst.start, before[k:])
        found[id(state)] = state
    return list(found.values())


def scan(maps: list[StateMap]) -> list[StateMap]:
    """The maps of all prefixes, by a work-efficient parallel scan.

    Neighbours are combined, the half as many combined ones are scanned, and
    every other prefix is one of those and one map more; all compositions of a
    level are independent of one another.
    """
    if len(maps) < 2:
        return maps
    pairs = [maps[i].then(maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
    done = scan(pairs)
    return [maps[0]] + [done[i // 2] if i % 2 else done[i // 2 - 1].then(maps[i]) for i in range(1, len(maps))]


class TokenCounter:
    """Counts for a piece model with a leading space symbol and byte fallback.

    Two neighbouring symbols that stand together in no token, a space symbol
    after another one above all, synchronise the transducer: no token crosses
    them, so a stretch between such places maps every entry state alike and its
    count is a constant; over constant maps the prefix scan is a running sum. A stretch beyond CHUNK symbols is cut; its
    chunks' state maps are worked out for the states that may enter them, and combined by a prefix scan.

    Counts of stretches are remembered by their bytes: short ones as a number
    that holds the bytes themselves, longer ones as they are.
    """

    def __init__(self, path: str):
        import sentencepiece.sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or 4 in kinds or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with identity normalisation, a leading space symbol and byte fallback are compiled")
        scores = {p.piece: p.score for p in model.pieces if p.type in (1, 5)}
        if any(SPACE in t.lstrip(SPACE) or "\n" in t for t in scores):
            raise ValueError("a token crosses a synchronising symbol")
        # pairs of ASCII symbols that stand together in some token; between any other two no token crosses
        self.together = np.zeros((256, 256), bool)
        self.together[128:] = self.together[:, 128:] = True
        for t in scores:
            for a, b in zip(t, t[1:]):
                a, b = (32 if x == SPACE else ord(x) for x in (a, b))
                if a < 128 and b < 128:
                    self.together[a, b] = True
        self.fst = Transducer(scores)
        self.reach = max(map(len, scores), default=1)
        self.short: dict[int, int] = {}
        self.long: dict[tuple[bool, bytes], int] = {}
        self.held = 0

    def chunk_maps(self, text: str) -> list[StateMap]:
        """A state map for every chunk of a stretch; equal chunks after equal symbols share one."""
        maps, made = [], {}
        for i in range(0, len(text), CHUNK):
            chunk, before = text[i : i + CHUNK], text[max(0, i - 2 * self.reach) : i]
            if (before, chunk) not in made:
                entries = entry_states(self.fst, before, self.reach) if i else [self.fst.start]
                made[before, chunk] = StateMap(partial(self.fst.run, text=chunk), entries)
            maps.append(made[before, chunk])
        return maps

    def count_unit(self, unit: str, first: bool) -> int:
        """Tokens of one stretch; ``first`` puts the model's own space symbol before it."""
        text = (SPACE if first else "") + unit.replace(" ", SPACE)
        if len(text) <= CHUNK:
            return self.fst.run(self.fst.start, text)[1]
        return scan(self.chunk_maps(text))[-1](self.fst.start)[1]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text, given the texts' UTF-8 bytes and offsets."""
        n = len(data)
        if not n:
            return np.zeros(len(offsets) - 1, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        prev = np.empty(n, np.uint8)
        prev[0], prev[1:] = 0, data[:-1]
        # 0x81 ends a written-out space symbol, which does merge with a space after it
        cut = edge[:-1] | ~self.together.ravel()[(prev.astype(np.uint16) << 8) | data] | ((data == 32) & (prev >= 128) & (prev != 0x81))
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        first = edge[starts]  # the model's own space symbol comes before it
        size = ends - starts
        values, raw = np.empty(len(starts), np.int64), data.tobytes()
        # up to seven bytes: the bytes, their number and the flag are one 64-bit number
        brief = size <= 7
        at = starts[brief]
        word = np.ndarray(n, "<u8", raw + bytes(8), strides=(1,))[at]
        bits = (size[brief] * 8).astype(np.uint64)
        key = (word & ((np.uint64(1) << bits) - np.uint64(1))) | (bits << np.uint64(53)) | (first[brief].astype(np.uint64) << np.uint64(60))
        distinct, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        counts = np.empty(len(distinct), np.int64)
        for i, (k, a, j) in enumerate(zip(distinct.tolist(), at[where].tolist(), (size[brief][where]).tolist(), strict=True)):
            if (c := self.short.get(k)) is None:
                c = self.short[k] = self.count_unit(raw[a : a + j].decode(), bool(k >> 60))
            counts[i] = c
        values[brief] = counts[inverse]
        found, known = [], self.long
        for a, b, f in zip(starts[~brief].tolist(), ends[~brief].tolist(), first[~brief].tolist(), strict=True):
            unit = raw[a:b]
            if (c := known.get((f, unit))) is None:
                c = known[f, unit] = self.count_unit(unit.decode(), f)
                self.held += len(unit)
            found.append(c)
        values[~brief] = found
        sums = np.concatenate([[0], np.cumsum(values)])
        where = np.searchsorted(starts, offsets)
        if len(self.short) + len(known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.short.clear()
            known.clear()
            self.held = 0
        if self.fst.size > COMPILED:
            self.fst.reset()
        return sums[where[1:]] - sums[where[:-1]]


_counters: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Null and empty texts have no bytes and no tokens. Rows are independent: no
    shuffle; memory is bounded by a batch, whatever the number of rows; repeated
    rows and other columns do not matter.
    """
    ship_package(docs.sparkSession)
    src = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TokenCounter(path)
        counter = _counters[path]
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1), 1 << 22):
                n = counter.count(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return src.mapInArrow(run, schema)
