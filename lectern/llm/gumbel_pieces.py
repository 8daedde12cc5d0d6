"""Distinct sampled segmentations of whole texts: Gumbel top-k without replacement over a SentencePiece lattice.

A text's segmentations are the paths of a lattice of vocabulary pieces; a path's probability is the product of its
pieces' weights over the sum for all paths, which backward sums over the lattice give exactly. Adding Gumbel noise to
all log-probabilities and taking the k largest draws k distinct segmentations without replacement. An A* search finds
them without listing paths: a node is a set of paths, and its bound is the largest perturbed value in it, itself a
(truncated) Gumbel variable of the set's total mass. The node of the highest bound is popped; the path that attains the
bound is drawn top-down; the rest of the set splits into nodes by where, and how, paths leave the popped one, each with
its own bound below its parent's.

Pieces never hold a space mark after another character, so the lattice is a chain of units, each a run of spaces and
what follows. That is used twice: lattices are kept per distinct unit, and a descent draws all its units at once. The
set of paths that leave a popped path later is one node; where they leave it is drawn only when that node is popped.

Noise comes from a hash of (seed, row key, sample, unit, step): results do not depend on batches, partitions or order.

``gumbel`` is a sample's perturbed log-probability; ``inclusion`` is its probability of being among the k largest, given
the (k+1)-th value: 1 - exp(-exp(log_prob - that value)).

Defined results: rows without a key share a key of their own; null text has no samples; empty text has the space mark's segmentations (the dummy prefix); a text with
fewer than k segmentations gives all of them, with inclusion 1; rows of equal key and text get equal samples.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import small_batches

#: Samples a text, and the seed, of the production query.
SAMPLES, SEED = 4, 2024
#: States of lattices that a worker keeps; texts and characters walked together.
_STATES, _TEXTS, _CHARS = 700_000, 1024, 1 << 22
#: Characters of a unit from which on it is kept whole.
_LONG = 24
#: Log-mass, relative to its node's, below which a set of paths is beyond the precision of the rest's sum.
_NEGLIGIBLE = 45.0
_G = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


class Vocabulary:
    """Pieces and their weights. Merge-ranked vocabularies have no probabilities, so a piece weighs 1 / (rank + 10)."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.text: list[bytes] = []
        self.byte: list[int] = [0] * 256
        self.trie: dict = {}  # character -> [further characters, piece or -1, weight]
        first = None
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            usable = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and "▁" not in piece.lstrip("▁")
            self.text.append(piece.encode() if usable else b"")
            if usable:
                first = i if first is None else first
                node, entry = self.trie, None
                for c in piece:
                    entry = node.setdefault(c, [{}, -1, 0.0])
                    node = entry[0]
                entry[1], entry[2] = i, 1 / (i - first + 10)
        self.rare = 1 / (10 * model.get_piece_size())  # the weight of a byte
        # the trie as sorted arrays: (node, character) -> node, for many walkers at once
        self.code: dict[str, int] = {}
        edges, self.node_piece, self.node_weight = [], [-1], [0.0]
        level = [(0, self.trie)]
        while level:
            below = []
            for node, further in level:
                for c, (children, piece, weight) in further.items():
                    edges.append((node, self.code.setdefault(c, len(self.code) + 1), len(self.node_piece)))
                    below.append((len(self.node_piece), children))
                    self.node_piece.append(piece)
                    self.node_weight.append(weight)
            level = below
        self.node_piece, self.node_weight = np.array(self.node_piece, dtype=np.int64), np.array(self.node_weight)
        self.characters = len(self.code) + 1
        self.code_of = np.zeros(0x110000, dtype=np.int64)  # by code point; units have spaces for space marks
        for c, code in self.code.items():
            self.code_of[ord(" " if c == "▁" else c)] = code
        walk = np.array(sorted((node * self.characters + c, child) for node, c, child in edges), dtype=np.int64)
        self.walk_key, self.walk_child = walk[:, 0].copy(), walk[:, 1].copy()
        # bytes of a piece in the text, where a space mark is a space
        self.lengths = np.array([len(x) - 2 * x.count("▁".encode()) for x in self.text], dtype=np.int64)

    def decode(self, ids) -> str:
        """The text of pieces: space marks become spaces, and the dummy prefix goes."""
        return b"".join(self.text[i] for i in ids).decode().replace("▁", " ")[1:]


class _Grown:
    """An array that grows at its end, in amortised constant time a value."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1 << 12, dtype=kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.empty(2 * (self.n + len(values)), dtype=self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def now(self) -> np.ndarray:
        return self.room[: self.n]


class Lattices:
    """Normalised lattices of distinct units, side by side: states, and edges with conditional probabilities.

    What can follow a position, and how likely, depends only on the rest of the unit, so a state is a rest, and units
    with equal endings share their states. A state is known by its first character and the state of what follows it, so all
    units find their states together, from their last characters on, and pieces are found for all new states at once: a
    walker a state goes down the trie and along the states. Long units are kept whole, in logarithms.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        # (state of what follows + 1, character) -> state, by sorted keys
        self.known, self.known_state = np.array([-1]), np.array([-1])
        self.whole: dict[str, int] = {}  # long unit -> its first state
        self.sequences: dict[bytes, int] = {}
        self.outside: dict[tuple[int, tuple[int, ...]], float] = {}  # (state, path) -> the probability of all others
        # of a state: first character, state of the rest after it (-1: none), weight of all ways on, its edges' range, and
        # whether its weights are too small for a product
        self._char, self._tail, self._beta, self._first, self._end, self._lost = (_Grown(k) for k in ("i8", "i8", "f8", "i8", "i8", "?"))
        # of an edge: probability, its logarithm, the sum up to it, state (-1: the unit's end), piece or the number of a
        # character's bytes after all pieces
        self._mass, self._log, self._cum, self._to, self._ids = (_Grown(k) for k in ("f8", "f8", "f8", "i8", "i8"))
        self.freeze()

    def __len__(self) -> int:
        return self._first.n

    def _bytes(self, c: str) -> tuple[int, float]:
        """The number and the weight of a character's bytes, for one that is no piece."""
        raw = c.encode()
        return len(self.vocabulary.text) + self.sequences.setdefault(raw, len(self.sequences)), self.vocabulary.rare ** len(raw)

    def _pieces(self, unit: str, i: int) -> list[tuple[int, int, float]]:
        """(end, piece, weight) of the pieces from position ``i``."""
        node, here = self.vocabulary.trie, []
        for j in range(i, len(unit)):
            entry = node.get(unit[j])
            if entry is None:
                break
            node, piece, weight = entry
            if piece >= 0:
                here.append((j + 1, piece, weight))
        if not here or here[0][0] > i + 1:
            here.append((i + 1, *self._bytes(unit[i])))
        return here

    def states_of(self, units: pa.Array) -> np.ndarray:
        """The first state of each of distinct units, with spaces for space marks; what is missing is added."""
        names = units.to_pylist()
        length = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        chars = np.frombuffer("".join(names).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        short = np.flatnonzero(length <= _LONG)
        found = np.full(len(names), -1)
        found[short] = self._add(chars, np.cumsum(length)[short], length[short])
        apart = found < 0
        apart[short] = self._lost.now[found[short]]
        for i in np.flatnonzero(apart):
            unit = names[i].replace(" ", "▁")
            found[i] = self.whole[unit] if unit in self.whole else self._add_whole(unit)
        return found

    def _put(self, degree: np.ndarray, mass: np.ndarray, to: np.ndarray, ids: np.ndarray) -> None:
        """Adds the edges of new states, state by state, with normalised masses."""
        end = self._to.n + np.cumsum(degree)
        first = end - degree
        cum = mass.copy()
        for k in range(1, int(degree.max(initial=0))):  # sums within a state only: equal for any batch
            at = first[degree > k] - self._to.n + k
            cum[at] += cum[at - 1]
        cum[end - 1 - self._to.n] = 2.0  # the last one takes what rounding leaves
        with np.errstate(divide="ignore"):
            self._log.add(np.maximum(np.log(mass), -750.0))
        for grown, values in ((self._first, first), (self._end, end), (self._mass, mass), (self._cum, cum), (self._to, to), (self._ids, ids)):
            grown.add(values)

    def _add(self, chars: np.ndarray, ends: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The first states of units, given by where they end in ``chars``, and adds those that aren't there."""
        v, base = self.vocabulary, len(self)
        last, going, end = np.full(len(ends), -1), np.arange(len(ends)), base
        keys: list[np.ndarray] = []
        for n in range(1, _LONG + 1):  # rests of n characters
            going = going[length[going] >= n]
            if not len(going):
                break
            key, back = np.unique((last[going] + 1) << 21 | chars[ends[going] - n], return_inverse=True)
            place = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            state = np.where(self.known[place] == key, self.known_state[place], -1)
            new = state < 0
            keys.append(key[new])
            state[new] = np.arange(end, end + len(keys[-1]))
            end += len(keys[-1])
            last[going] = state[back]
        m = end - base
        if not m:
            return last
        lengths = np.repeat(np.arange(1, len(keys) + 1), list(map(len, keys))).astype(np.int8)
        fresh = np.concatenate(keys)
        tails, first_char = (fresh >> 21) - 1, fresh & ((1 << 21) - 1)
        known, states = np.concatenate([self.known, fresh]), np.concatenate([self.known_state, np.arange(base, end)])
        order = np.argsort(known, kind="stable")
        self.known, self.known_state = known[order], states[order]
        self._char.add(v.code_of[first_char])
        self._tail.add(tails)
        char, tail = self._char.now, self._tail.now
        # a walker a state: down the trie by its characters, a step for all at a time
        state, node, at = np.arange(m), np.zeros(m, dtype=np.int64), base + np.arange(m)
        single = np.zeros(m, dtype=bool)
        edges: list[tuple[np.ndarray, ...]] = []
        first = True
        while len(state):
            key = node * v.characters + char[at]
            place = np.minimum(np.searchsorted(v.walk_key, key), len(v.walk_key) - 1)
            ok = v.walk_key[place] == key
            state, node, at = state[ok], v.walk_child[place[ok]], tail[at[ok]]
            piece = v.node_piece[node]
            hit = piece >= 0
            if first:
                single[state[hit]] = True
                first = False
            edges.append((state[hit], at[hit], piece[hit], v.node_weight[node[hit]]))
            on = at >= 0
            state, node, at = state[on], node[on], at[on]
        spelled = np.flatnonzero(~single)  # characters that are no piece
        kinds, back = np.unique(first_char[spelled], return_inverse=True)
        spelling = [self._bytes("▁" if c == 32 else chr(c)) for c in kinds.tolist()]
        edges.insert(0, (spelled, tail[base + spelled], np.array([x for x, _ in spelling], dtype=np.int64)[back], np.array([w for _, w in spelling])[back]))
        # long pieces first: they are the likeliest, so a draw mostly stops at a state's first edge
        state, to, ids, weight = (np.concatenate(x) for x in zip(*reversed(edges)))
        order = np.argsort(state, kind="stable")
        state, to, ids, weight = state[order], to[order], ids[order], weight[order]
        # backward sums by the length of the rest, shortest first
        self._beta.add(np.ones(m))
        self._lost.add(np.zeros(m, dtype=bool))
        beta, lost = self._beta.now, self._lost.now
        state_cuts = np.searchsorted(lengths, np.arange(_LONG + 2))  # new states, and so their edges, are in order of length
        cuts = np.searchsorted(state, state_cuts)
        for n in range(1, len(keys) + 1):
            e, s = slice(cuts[n], cuts[n + 1]), slice(state_cuts[n], state_cuts[n + 1])
            if s.stop > s.start:
                weight[e] *= np.where(to[e] >= 0, beta[to[e]], 1.0)
                total = np.bincount(state[e] - s.start, weights=weight[e], minlength=s.stop - s.start)
                gone = (total < 1e-250) | ((tails[s] >= 0) & lost[tails[s]])  # products of many rare bytes
                lost[base + s.start : base + s.stop] = gone
                beta[base + s.start : base + s.stop] = np.where(gone, 1.0, total)
        self._put(np.bincount(state, minlength=m), weight / beta[base + state], to, ids)
        return last

    def _add_whole(self, unit: str) -> int:
        n, base = len(unit), len(self)
        pieces = [self._pieces(unit, i) for i in range(n)]
        beta = [0.0] * (n + 1)
        shares: list[list[float]] = [[]] * n
        for i in range(n - 1, -1, -1):
            log = [math.log(w) + beta[j] for j, _, w in pieces[i]]
            top = max(log)
            beta[i] = top + math.log(sum(math.exp(x - top) for x in log))
            shares[i] = [1.0] if len(log) == 1 else [math.exp(x - beta[i]) for x in log]
        flat = [(share, base + j if j < n else -1, sequence) for i in range(n) for share, (j, sequence, _) in zip(shares[i], pieces[i])]
        mass, to, ids = zip(*flat)
        for grown, value in ((self._char, 0), (self._tail, -1), (self._beta, 1.0), (self._lost, False)):
            grown.add(np.full(n, value))
        self._put(np.array([len(x) for x in pieces]), np.array(mass), np.array(to, dtype=np.int64), np.array(ids, dtype=np.int64))
        if n < 4 * _LONG:
            self.whole[unit] = base
        return base

    def freeze(self) -> None:
        """Brings the arrays up to what was added."""
        self.a_first, self.a_end, self.a_mass, self.a_log, self.a_cum, self.a_to, self.a_ids = (
            x.now for x in (self._first, self._end, self._mass, self._log, self._cum, self._to, self._ids)
        )
        pieces = len(self.vocabulary.text)
        spelled = [[self.vocabulary.byte[b] for b in raw] for raw in self.sequences]
        self.s_len = np.array([1] * pieces + [len(x) for x in spelled], dtype=np.int64)
        self.s_start = np.cumsum(self.s_len) - self.s_len
        self.s_flat = np.array([*range(pieces), *(y for x in spelled for y in x)], dtype=np.int64)

    def outgoing(self, state: int) -> range:
        return range(int(self.a_first[state]), int(self.a_end[state]))

    def log_of(self, path: tuple[int, ...]) -> float:
        return float(sum(self.a_log[e] for e in path))


def _mix(x):
    """A hash of 64-bit numbers, for arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix1(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WORD
    return x ^ (x >> 31)


def _uniform(*parts: int) -> float:
    """A number in (0, 1) from a hash of the parts."""
    h = 0
    for p in parts:
        h = _mix1((h * _G + p + 1) & _WORD)
    return ((h >> 11) + 0.5) / (1 << 53)


def _walk(lattices: Lattices, states: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws a path through each unit: (edges in order, edges a unit, log-probability a unit)."""
    at, state = np.arange(len(states)), states
    units, edges = [], []
    counts = np.zeros(len(states), dtype=np.int64)
    step = 0
    with np.errstate(over="ignore"):
        while len(at):
            u = (_mix(keys[at] + np.uint64(step * _G & _WORD)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            e = lattices.a_first[state]
            later = np.flatnonzero(u >= lattices.a_cum[e])
            while len(later):
                e[later] += 1
                later = later[u[later] >= lattices.a_cum[e[later]]]
            units.append(at)
            edges.append(e)
            state = lattices.a_to[e]
            going = state >= 0
            step += 1
            counts[at[~going]] = step
            at, state = at[going], state[going]
    start = np.cumsum(counts) - counts
    edge, log = np.empty(int(counts.sum()), dtype=np.int64), np.zeros(len(states))
    for step, (unit, drawn) in enumerate(zip(units, edges)):
        edge[start[unit] + step] = drawn
        log[unit] += lattices.a_log[drawn]
    return edge, counts, log


class _Leaf:
    """A path: its edges, where each unit's edges start, and log-probabilities of units and of prefixes."""

    __slots__ = ("edges", "falling", "log", "prefix", "start")

    def __init__(self, edges: np.ndarray, counts: np.ndarray, log: np.ndarray):
        self.edges, self.log = edges, log
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.prefix = np.concatenate([[0.0], np.cumsum(log)])
        self.falling = -self.prefix

    def unit(self, v: int) -> tuple[int, ...]:
        return tuple(self.edges[self.start[v] : self.start[v + 1]].tolist())


class _Node:
    """The paths that share ``leaf`` up to a unit from ``start`` on and then leave it; at ``start`` also all of ``barred``.
    Units of ``skip`` belong to other nodes."""

    __slots__ = ("barred", "barred_p", "leaf", "log_mass", "share", "skip", "start")

    def __init__(self, lattices: Lattices, states: np.ndarray, leaf: _Leaf, start: int, barred: tuple, skip: frozenset):
        self.leaf, self.start, self.barred, self.skip = leaf, start, barred, skip
        m = int(np.searchsorted(leaf.falling[start:-1], leaf.falling[start] + _NEGLIGIBLE, side="right"))
        rel = leaf.prefix[start : start + m] - leaf.prefix[start]
        away = -np.expm1(leaf.log[start : start + m])
        for i in np.flatnonzero(away < 1e-9):  # too near to 1 for a difference
            away[i] = _outside_one(lattices, int(states[start + i]), leaf.unit(start + int(i)))
        if m:
            away[0] = _outside(lattices, int(states[start]), barred) if len(barred) > 1 else _outside_one(lattices, int(states[start]), barred[0])
        share = np.exp(rel) * away
        for v in skip:
            if start <= v < start + m:
                share[v - start] = 0.0
        self.share = share
        total = float(share.sum())
        self.log_mass = leaf.prefix[start] + math.log(total) if total > 0 else -math.inf


#: Edges of a path from which on the mass outside it is a plain difference; such units have many other paths.
_DEEP = 300


def _outside(lattices: Lattices, state: int, barred) -> float:
    """The probability of the paths from a state that aren't barred, summed without cancellation."""
    if max(map(len, barred)) > _DEEP:
        return max(0.0, 1 - sum(math.exp(lattices.log_of(path)) for path in barred))
    total = 0.0
    for e in lattices.outgoing(state):
        through = [p[1:] for p in barred if p[0] == e]
        if not through:
            total += float(lattices.a_mass[e])
        elif lattices.a_to[e] >= 0:
            total += float(lattices.a_mass[e]) * _outside(lattices, int(lattices.a_to[e]), through)
    return total


def _outside_one(lattices: Lattices, state: int, path: tuple[int, ...]) -> float:
    """``_outside`` of one path, which frequent units ask for again and again."""
    found = lattices.outside.get((state, path))
    if found is None:
        found = lattices.outside[state, path] = _outside(lattices, state, (path,))
    return found


def _other_path(lattices: Lattices, state: int, barred: tuple, key: tuple) -> tuple[int, ...]:
    """A path through one unit drawn from those that aren't barred."""
    path: list[int] = []
    live = list(barred)
    while state >= 0:
        out = lattices.outgoing(state)
        weights = []
        for e in out:
            through = [p[1:] for p in live if p[0] == e]
            to = int(lattices.a_to[e])
            weights.append(float(lattices.a_mass[e]) * (1.0 if not through else _outside(lattices, to, through) if to >= 0 else 0.0))
        u = _uniform(*key, len(path)) * sum(weights)
        chosen = out[-1]
        for e, w in zip(out, weights):
            u -= w
            if w > 0:
                chosen = e
                if u < 0:
                    break
        path.append(chosen)
        state = int(lattices.a_to[chosen])
        live = [p[1:] for p in live if p[0] == chosen]
    return tuple(path)


def _below(log_mass: float, bound: float, u: float) -> float:
    """A Gumbel variable at ``log_mass``, given that it is at most ``bound``."""
    return log_mass - math.log(math.exp(min(log_mass - bound, 700.0)) - math.log(u))


def units_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts in order, with a space for each space mark and for the dummy prefix, and how many each text has."""
    long = pa.large_string()
    marked = pc.binary_join_element_wise(pa.scalar("", long), pc.replace_substring(pa.array(texts, long), "▁", " "), pa.scalar(" ", long))
    edges = np.frombuffer(marked.buffers()[1], dtype=np.int64)[: len(marked) + 1] if len(marked) else np.zeros(1, dtype=np.int64)
    raw = marked.buffers()[2] if len(marked) else pa.py_buffer(b"")
    space = np.frombuffer(raw, dtype=np.uint8)[: edges[-1]] == ord(" ")
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[edges[:-1]] = True
    cuts = np.append(np.flatnonzero(starts), edges[-1])
    units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), raw)
    return units, np.diff(np.searchsorted(cuts, edges))


def sample_texts(lattices: Lattices, keys: list[int], texts: list[str], k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` samples in falling order: (ids, log_prob, gumbel, inclusion)."""
    if len(lattices) > _STATES:
        lattices.clear()
    units, counts = units_of(texts)
    coded = units.dictionary_encode()
    every = lattices.states_of(coded.dictionary)[coded.indices.to_numpy()]
    states = np.split(every, np.cumsum(counts)[:-1]) if texts else []
    del units, coded
    lattices.freeze()
    rows = [_mix1((_mix1((seed + (key >> 64)) & _WORD) * _G + (key & _WORD)) & _WORD) for key in keys]

    def walk(wanted: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Draws units from a start on: for (text, sample, start)."""
        if not wanted:
            return []
        with np.errstate(over="ignore"):
            noise = [_mix(np.uint64(_mix1((rows[d] + j * _G) & _WORD)) + np.arange(s, len(states[d]), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) for d, j, s in wanted]
        sizes = [len(x) for x in noise]
        edge, count, log = _walk(lattices, np.concatenate([states[d][s:] for d, _, s in wanted]), np.concatenate(noise))
        ends = np.cumsum(sizes)
        cut = np.concatenate([[0], np.cumsum(count)])
        return [(edge[cut[b - n] : cut[b]], count[b - n : b], log[b - n : b]) for b, n in zip(ends, sizes)]

    heaps: list[list] = [[] for _ in texts]
    found: list[list] = [[] for _ in texts]

    def push(d: int, node: _Node, bound: float, *label: int) -> None:
        if node.log_mass > -math.inf:
            g = _below(node.log_mass, bound, _uniform(rows[d], 7, *label))
            heapq.heappush(heaps[d], (-g, len(heaps[d]), label, node))

    for d, (edges, counts, log) in enumerate(walk([(d, 0, 0) for d in range(len(texts))])):
        leaf = _Leaf(edges, counts, log)
        g = -math.log(-math.log(_uniform(rows[d], 5)))
        found[d].append((leaf, g))
        push(d, _Node(lattices, states[d], leaf, 0, (leaf.unit(0),), frozenset()), g, 0, 0)
    for j in range(1, k):
        popped = []
        for d, heap in enumerate(heaps):
            if not heap:
                continue
            g, _, _, node = heapq.heappop(heap)
            run = np.cumsum(node.share)
            v = node.start + int(np.searchsorted(run, _uniform(rows[d], 11, j) * run[-1], side="right"))
            v = min(v, node.start + len(run) - 1)
            while node.share[v - node.start] <= 0:  # rounding may point beside the last possible unit
                v -= 1
            barred = node.barred if v == node.start else (node.leaf.unit(v),)
            path = _other_path(lattices, int(states[d][v]), barred, (rows[d], 13, j))
            popped.append((d, -g, node, v, barred, path))
        rests = iter(walk([(d, j, v + 1) for d, _, _, v, _, _ in popped if v + 1 < len(states[d])]))
        for d, g, node, v, barred, path in popped:
            edges, counts, log = next(rests) if v + 1 < len(states[d]) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
            base = node.leaf
            leaf = _Leaf(
                np.concatenate([base.edges[: base.start[v]], np.array(path, dtype=np.int64), edges]),
                np.concatenate([np.diff(base.start)[:v], [len(path)], counts]),
                np.concatenate([base.log[:v], [lattices.log_of(path)], log]),
            )
            found[d].append((leaf, g))
            push(d, _Node(lattices, states[d], base, node.start, node.barred, node.skip | {v}), g, j, 1)
            push(d, _Node(lattices, states[d], leaf, v, (*barred, path), frozenset()), g, j, 2)
    out = []
    for d in range(len(texts)):
        after = -heaps[d][0][0] if heaps[d] else -math.inf
        samples = []
        for leaf, g in found[d]:
            seq = lattices.a_ids[leaf.edges]
            n = lattices.s_len[seq]
            ids = lattices.s_flat[np.repeat(lattices.s_start[seq] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            p = float(leaf.prefix[-1])
            inclusion = 1.0 if after == -math.inf else -math.expm1(-math.exp(min(p - after, 700.0)))
            samples.append((ids, p, g, inclusion))
        out.append(samples)
    return out


_ready: dict[str, Lattices] = {}


def lattices_of(model_file: str) -> Lattices:
    """A vocabulary's lattices, kept by each worker."""
    if model_file not in _ready:
        _ready[model_file] = Lattices(Vocabulary(model_file))
    return _ready[model_file]


def _samples(batches: Iterator[pa.RecordBatch], model_file: str, k: int, seed: int):
    """(key, samples) of each row of each batch."""
    lattices = lattices_of(model_file)

    def flush(keys: list, texts: list):
        with_text = [i for i, t in enumerate(texts) if t is not None]
        made = dict(zip(with_text, sample_texts(lattices, [hash_key(keys[i]) for i in with_text], [texts[i] for i in with_text], k, seed))) if with_text else {}
        return [(key, made.get(i, [])) for i, key in enumerate(keys)]

    for batch in batches:
        keys, texts, size, out = [], [], 0, []
        for key, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            text = text.as_py()
            if keys and (len(keys) >= _TEXTS or size + len(text or "") > _CHARS):
                out += flush(keys, texts)
                yield out
                keys, texts, size, out = [], [], 0, []
            keys.append(key)
            texts.append(text)
            size += len(text or "")
        if keys:
            yield flush(keys, texts)


def hash_key(key) -> int:
    """What noise is drawn from: a key's 64 bits, and one more for rows without a key."""
    return 1 << 64 if key is None else (key + 1) & _WORD


def sample_pieces(docs: DataFrame, model_file: str, k: int = SAMPLES, seed: int = SEED, ids: bool = True) -> DataFrame:
    """A row a sample of ``docs`` (doc_id, text): doc_id, sample (from 1), n_pieces, n_bytes (of the decoded pieces, space
    marks as spaces, without the dummy prefix), ids_crc32 (of unsigned little-endian 32-bit ids), log_prob, gumbel, inclusion, and ``ids``."""
    schema = "doc_id long, sample int, n_pieces long, n_bytes long, ids_crc32 long, log_prob double, gumbel double, inclusion double" + ", ids array<int>" * ids

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()] + [pa.list_(pa.int32())] * ids
        names = [c.split()[0] for c in schema.split(", ")]
        for rows in _samples(batches, model_file, k, seed):
            lengths = lattices_of(model_file).vocabulary.lengths
            columns: list[list] = [[] for _ in names]
            for key, samples in rows:
                for n, (piece_ids, p, g, inclusion) in enumerate(samples, 1):
                    values = [key, n, len(piece_ids), int(lengths[piece_ids].sum()) - 1, zlib.crc32(piece_ids.astype("<u4")), p, g, inclusion] + [piece_ids.astype(np.int32)] * ids
                    for column, value in zip(columns, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(build, schema)


def decode_pieces(rows: DataFrame, model_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text that ``ids`` decode to (null ids: null) in place of a column of that name."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = lattices_of(model_file).vocabulary
        for batch in batches:
            yield pa.array([None if x is None else vocabulary.decode(x) for x in batch.to_pylist()], pa.string())

    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() != out.lower()]
    return rows.select(*kept, F.arrow_udf(decode, "string")(F.col(f"`{ids}`")).alias(out))
