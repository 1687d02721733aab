"""LM scoring: word counts, and an online logistic mix of hashed-context bit predictors.

A text, A-Z in lower case, is coded byte by byte and then an end mark. Its units are words, each with the white-space
byte or end that follows. A byte is a path of bits in a code tree that belongs to the two bytes before it in the unit
where these are frequent, else to the one before. For a bit six predictors look up how often it was set in the training
texts: in the tree's node alone, with three, four, five and six earlier bytes of the unit, and with all of them. The units of all training texts and their counts are
a table that grows with the texts, from which the predictors' tables are counted; where contexts share a slot, the
most frequent keeps it, and check bits tell the others that it is not theirs. The predictors' log-odds are mixed by
weights that a gate selects, from how well known the longest contexts are. Weights start alike for every text and move
along the gradient after each chunk of 64 bits of the text, and a table from mixed to observed odds refines the result,
so that a text's score does not depend on where or beside what it is scored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import fresh, map_batches, others
from tessera.session import materialise

#: Counted words that every task is given, the most frequent, at most; the rest are joined by shuffle.
HEAD_WORDS = 400_000
#: Each hashed predictor has four slots for each unit of the training texts, and 2^MAX_SLOT_BITS (8 MB) at most.
MAX_SLOT_BITS = 22
CHUNK, RATE, REFINE_RATE, START_WEIGHT = 64, 0.02, 0.02, 0.35

_END, _GO_ON = 255, 254  # no bytes of UTF-8: before a unit's first byte, and before that of a unit that goes on
_TREES = 512  # pairs of last bytes that have a code tree of their own, the most frequent
_ORDERS = (3, 4, 5, 6)  # earlier bytes of the hashed predictors; the last one has all of the unit
_PREDICTORS = len(_ORDERS) + 2
_GATES, _BINS = 16, 33
_UNIT = 24  # bytes of a unit at most; longer words go on in the next one
_CHECK_BITS = 6
_SLICE_BYTES = 700_000  # bytes of text that are cut at a time; a longer text is walked in stretches
_GROUP_BYTES = 2_100_000  # bytes of text that are scored side by side
_POOL_BYTES = 8_000_000  # bytes of text from which texts of like sizes are taken, so that no turn has one text alone
_KEPT_UNITS = 600_000  # units that a task counts before they go out
_KEPT_ROWS = 5_000_000  # decisions of units that a task keeps
_MADE_BYTES = 30_000  # bytes of new units whose decisions are made at a time
_LANES = 256  # lanes into which texts are dealt, at most
_COUNTED_UNITS = 60_000  # units whose contexts a task sums up at a time


@dataclass(frozen=True)
class Trees:
    """Code trees: which one is used after the last two bytes; where a byte's path starts, how long it is, its nodes and bits."""

    which: np.ndarray
    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def _paths(weights: list[int]) -> list[tuple[list[int], list[int]]]:
    """Nodes, numbered from the first that was made, and bits of each byte's way down a Huffman tree."""
    heap = [(n, b, b) for b, n in enumerate(weights)]
    heapq.heapify(heap)
    parent, made = [(-1, 0)] * 511, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (made, 0), (made, 1)
        heapq.heappush(heap, (a[0] + b[0], made, made))
        made += 1
    ways: list[tuple[list[int], list[int]]] = [([], [])] * 511
    for at in range(509, -1, -1):  # a node is made after those below it
        above, bit = parent[at]
        nodes, bits = ways[above]
        ways[at] = [*nodes, above - 256], [*bits, bit]
    return ways[:256]


def build_trees(pairs: np.ndarray, deeper: dict[int, np.ndarray]) -> tuple[Trees, np.ndarray]:
    """A tree for each last byte, and one for each of ``deeper``'s two last bytes; and how often each (tree, byte) came.

    ``pairs`` counts (last byte, byte), ``deeper`` a byte after two. Bytes that were never seen have a path too.
    """
    which = np.arange(65536) % 256
    counts = [*pairs.astype(np.int64), *(deeper[c].astype(np.int64) for c in sorted(deeper))]
    for k, c in enumerate(sorted(deeper)):
        which[c] = 256 + k
        counts[c % 256] = counts[c % 256] - counts[256 + k]
    weights = [[int(n) * 256 + 1 for n in row] for row in pairs]
    weights += [[(int(n) << 20) + (w >> 8 if w < 1 << 28 else 1 << 20) + 1 for n, w in zip(deeper[c], weights[c % 256])] for c in sorted(deeper)]
    length, nodes, bits = [], [], []
    for tree, own in enumerate(weights):
        for way, turns in _paths(own):
            length.append(len(way))
            nodes += [tree * 255 + n for n in way]
            bits += turns
    size = np.array(length, np.int64)
    return Trees(which, np.cumsum(size) - size, size, np.array(nodes, np.int32), np.array(bits, np.uint8)), np.concatenate(counts)


def _raw(texts: list[str | None]) -> list[bytes]:
    """Texts as bytes, A-Z in lower case."""
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, _END])
_BYTE_KEYS = np.random.default_rng(20240517).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_END_HASH = np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, 0 to n at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 18, n + (n >> 2))
        _POWERS[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size, base, np.uint64))) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def _stirred(hashes: np.ndarray) -> np.ndarray:
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes


class _Split:
    """Texts as one array of bytes, each with an end mark, cut into words and into units.

    A stretch of one long text may be ``open`` at its end, and go on with a word (``going``).
    """

    def __init__(self, raw: list[bytes], going: bool = False, open: bool = False) -> None:
        self.raw, self.going = raw[0] if open else b"".join(r + b"\xff" for r in raw), going
        self.data = np.frombuffer(self.raw, np.uint8)
        self.lengths = np.array([len(r) + (not open) for r in raw], np.int64)
        self.ends = np.cumsum(self.lengths)
        up, self.down = _powers(len(self.data))
        self.total = np.append(np.uint64(0), np.cumsum(_BYTE_KEYS[self.data] * up[: len(self.data)]))
        gap = np.flatnonzero(_SPACE[self.data])
        self.stop = gap + 1 if not open or _SPACE[self.data[-1]] else np.append(gap + 1, len(self.data))  # of each word and the byte after it
        self.start = np.append(0, self.stop[:-1]) if len(self.stop) else gap

    def hashes(self, start: np.ndarray, stop: np.ndarray, mark: np.ndarray | int = 0) -> np.ndarray:
        """Hashes of stretches of bytes; a hash is a mixed polynomial of them."""
        found = (self.total[stop] - self.total[start]) * self.down[start] + (stop - start).astype(np.uint64)
        return _stirred(found + np.asarray(mark).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' words, each text with an end, and their numbers."""
        some = self.stop - self.start > 1
        start, stop = self.start[some], self.stop[some] - 1
        owner = np.searchsorted(self.ends, start, side="right")
        sizes = np.bincount(owner, minlength=len(self.lengths)) + 1
        out = np.full(int(sizes.sum()), _END_HASH, np.uint64)
        out[np.arange(len(start)) + owner] = self.hashes(start, stop)
        return out.view(np.int64), sizes

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, stops, marks and hashes of the units, in order."""
        pieces = -(-(self.stop - self.start) // _UNIT)
        place = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(self.start, pieces) + place * _UNIT
        stop = np.minimum(start + _UNIT, np.repeat(self.stop, pieces))
        mark = np.where(place > 0, _GO_ON, _END).astype(np.uint8)
        mark[:1] = _GO_ON if self.going else _END
        return start, stop, mark, self.hashes(start, stop, mark).view(np.int64)


def _slices(column: pa.Array, limit: int = _SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a column of texts, of about ``limit`` bytes each."""
    size, a = 0, 0
    for i, x in enumerate(column):
        size += len(x.as_buffer() or b"") + 1
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(column):
        yield a, len(column)


def _sliced(raw: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about _SLICE_BYTES each."""
    place = np.cumsum([len(r) + 1 for r in raw]) // _SLICE_BYTES
    for part in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(place)) + 1):
        yield [raw[i] for i in part.tolist()]


_GAP = re.compile(rb"[ \t-\r]")


def _stretches(raw: bytes, limit: int = _SLICE_BYTES) -> Iterator[_Split]:
    """A long text in stretches, cut where a unit ends."""
    at, going = 0, False
    while len(raw) - at > limit:
        cut = at + limit
        space = max(raw.rfind(c, at, cut) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        cut = space + 1 if space >= at else cut - limit % _UNIT
        yield _Split([raw[at:cut]], going, open=True)
        at, going = cut, space < at
    yield _Split([raw[at:]], going)


def _word_hash(word: bytes) -> np.ndarray:
    """The hash of one long word."""
    up, total = _powers(_SLICE_BYTES)[0], 0
    for at in range(0, len(word), _SLICE_BYTES):
        part = np.frombuffer(word[at : at + _SLICE_BYTES], np.uint8)
        total += int((_BYTE_KEYS[part] * up[: len(part)]).sum()) * pow(_BASE, at, 1 << 64)
    return _stirred(np.array([(total + len(word)) % (1 << 64)], np.uint64))


def _long_words(raw: bytes, limit: int = _SLICE_BYTES) -> np.ndarray:
    """Hashes of a long text's words and its end; no more than about ``limit`` bytes are looked at side by side."""
    out, at = [], 0
    while at < len(raw):
        found = _GAP.search(raw, at + limit)
        cut = found.start() if found else len(raw)
        space = max(raw.rfind(c, at, at + limit) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        begin = max(at, space + 1)
        long = cut - begin > limit
        out.append(_Split([raw[at : begin if long else cut]]).words()[0][:-1])
        if long:
            out.append(_word_hash(raw[begin:cut]).view(np.int64))
        at = cut
    return np.concatenate([*out, np.array([_END_HASH]).view(np.int64)])


def _decided(trees: Trees, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (hashed predictor, decision), nodes, bits, and the decisions of each unit.

    ``data`` holds the units' bytes one after the other, ``sizes`` of them each, ``first`` the mark of each.
    """
    starts = np.cumsum(sizes) - sizes
    within = np.arange(len(data)) - np.repeat(starts, sizes)
    mark = np.repeat(first, sizes)
    before = [np.where(within >= k, np.roll(data, k), mark) for k in range(1, max(_ORDERS) + 1)]
    pair = trees.which[before[1].astype(np.int64) * 256 + before[0]] * 256 + data
    length = trees.length[pair]
    ends = np.cumsum(length)
    path = np.arange(ends[-1] if len(ends) else 0) + np.repeat(trees.start[pair] - (ends - length), length)
    node, bit = trees.node[path], trees.bit[path]
    spread = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashes = np.empty((len(_ORDERS) + 1, len(node)), np.uint64)
    code, k = np.zeros(len(data), np.uint64), 0
    for j, own in enumerate(before, 1):
        code = code << np.uint64(8) | own
        if j == _ORDERS[k]:
            hashes[k] = np.repeat(_stirred((code + np.uint64(j)) * np.uint64(0xC2B2AE3D27D4EB4F)), length)
            k += 1
    up, down = _powers(len(data))
    total = np.append(np.uint64(0), np.cumsum(_BYTE_KEYS[data] * up[: len(data)]))
    origin = np.repeat(starts, sizes)
    hashes[-1] = np.repeat(_stirred((total[:-1] - total[origin]) * down[origin] + mark), length)
    hashes ^= spread
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    return hashes, node, bit, np.add.reduceat(length, starts) if len(starts) else sizes


def _slots(hashes: np.ndarray, slot_bits: int) -> np.ndarray:
    """Slots and, in the last bits, their checks."""
    return (hashes >> np.uint64(64 - slot_bits - _CHECK_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Code trees and, for each predictor, what each slot holds: check bits, confidence and quantised log-odds."""

    trees: Trees
    tables: list[np.ndarray]
    slot_bits: int


def _pack(ones: np.ndarray, total: np.ndarray, check: np.ndarray | int = 0) -> np.ndarray:
    """Log-odds in eighths (7 bits), how often a context was seen (3 bits) and its check bits."""
    odds = np.log((ones + 0.2) / (total - ones + 0.2))
    sure = np.minimum(7, np.floor(np.log2(total + 1))).astype(np.int64)
    return (np.clip(np.rint(odds * 8), -63, 63).astype(np.int64) + 64 | sure << 7 | np.asarray(check) << 10).astype(np.uint16)


class _Profiles:
    """Decisions of units, eight bytes each: the predictors' log-odds, the gate and the sign of the bit.

    The first rows are a chunk of zeros, which texts are filled up with.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.keys, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rows = np.zeros(CHUNK, np.int64)

    def _made(self, data: np.ndarray, mark: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        hashes, node, bit, decisions = _decided(model.trees, data, mark, sizes)
        rows = np.zeros((len(node), 8), np.int8)
        rows[:, 0] = (model.tables[0][node] & 127).astype(np.int8) - 64
        for k in range(1, _PREDICTORS):
            places = _slots(hashes[k - 1], model.slot_bits)
            held = model.tables[k][places >> _CHECK_BITS]
            own = (held >> 10) == (places & (1 << _CHECK_BITS) - 1)
            rows[:, k] = np.where(own, (held & 127).astype(np.int8) - 64, 0)
            if k >= _PREDICTORS - 2:
                sure = np.where(own, held >> 8 & 3, 0).astype(np.int8)
                rows[:, 6] += sure << 2 if k == _PREDICTORS - 1 else sure
        rows[:, 7] = 2 * bit.astype(np.int8) - 1
        return rows.view(np.int64).ravel(), decisions

    def _add(self, split: _Split, start: np.ndarray, stop: np.ndarray, mark: np.ndarray, keys: np.ndarray) -> None:
        """Keep the decisions of units that are new; so many are made at a time that their hashes stay in a cache."""
        sizes = stop - start
        counts, before = [], len(self.rows)
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(np.cumsum(sizes) // _MADE_BYTES)) + 1):
            own = sizes[part]
            offset = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            rows, n = self._made(split.data[np.repeat(start[part], own) + offset], mark[part], own)
            self.rows.resize(len(self.rows) + len(rows), refcheck=False)  # grows where it is, so that there is no second copy
            self.rows[-len(rows) :] = rows
            counts.append(n)
        size = np.concatenate(counts)
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        self.keys = both[order]
        self.start, self.size = np.concatenate([self.start, before + np.cumsum(size) - size])[order], np.concatenate([self.size, size])[order]

    def forget(self) -> None:
        """Leave out all units where many are kept; places that were given are no longer theirs."""
        if len(self.rows) > _KEPT_ROWS:
            self.__init__(self.model)

    def places(self, split: _Split, fill: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all texts' decisions, each text filled up to whole chunks, and how many decisions each has."""
        start, stop, mark, keys = split.units()
        one, first, place = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, one)
        there = self.keys[np.minimum(at, len(self.keys) - 1)] == one if len(self.keys) else np.zeros(len(one), bool)
        if not there.all():
            new = first[~there]
            self._add(split, start[new], stop[new], mark[new], one[~there])
            at = np.searchsorted(self.keys, one)
        begin, size = self.start[at][place], self.size[at][place]
        owner = np.searchsorted(split.ends, start, side="right")
        sizes = np.bincount(owner, size, len(split.lengths)).astype(np.int64)
        if fill:  # as if one more unit stood after each text
            last = np.searchsorted(owner, np.arange(len(sizes)), side="right")
            begin, size = np.insert(begin, last, 0), np.insert(size, last, -sizes % CHUNK)
        index = np.repeat((begin - np.cumsum(size) + size).astype(np.int32), size)
        index += np.arange(len(index), dtype=np.int32)
        return index, sizes


_EIGHTHS = np.full(8, 0.125, np.float32)
_FIRST_WEIGHTS = np.where(np.arange(8) < _PREDICTORS, START_WEIGHT, 0).astype(np.float32)
_FIRST_REFINE = np.linspace(-8, 8, _BINS, dtype=np.float32)


class _Mixer:
    """Weights and refining tables of the lanes in which texts are scored side by side."""

    def __init__(self, lanes: int) -> None:
        self.weights, self.refine = np.empty((lanes, _GATES, 8), np.float32), np.empty((lanes, _BINS), np.float32)
        self.moves = np.empty((lanes * _GATES, 4), np.complex64)
        lane = np.arange(lanes)[:, None]
        self.gates, self.bins = lane * _GATES, lane * _BINS

    def begin(self, lanes: np.ndarray) -> None:
        """Another text begins in these lanes."""
        self.weights[lanes], self.refine[lanes] = _FIRST_WEIGHTS, _FIRST_REFINE

    def turn(self, rows: np.ndarray) -> np.ndarray:
        """Score one chunk in each of the first lanes, (lane, decision), and move their weights; what each takes, in nats.

        A zero that a chunk is filled up with moves nothing and takes log(2).
        """
        n = len(rows)
        inputs = rows.view(np.int8).reshape(-1, 8).astype(np.float32)
        sign = inputs[:, 7].copy()
        used = rows >> 48
        used &= _GATES - 1
        used += self.gates[:n]
        used = used.ravel()
        own, table = self.weights[:n].reshape(-1, 8), self.refine[:n].reshape(-1)
        dot = own.take(used, axis=0, mode="clip")
        dot *= inputs
        dot = dot @ _EIGHTHS
        np.minimum(dot, _MOST, out=dot)
        np.maximum(dot, -_MOST, out=dot)
        bins = dot * _PER_ODDS
        bins += _MIDDLE
        bins = bins.astype(np.int64).reshape(n, -1)
        bins += self.bins[:n]
        bins = bins.ravel()
        dot += dot
        dot += table.take(bins, mode="clip")
        dot *= sign
        dot *= _THIRD
        np.exp(dot, out=dot)
        sums = dot + _ONE
        dot /= sums
        dot *= sign
        np.log(sums, out=sums)
        inputs *= dot[:, None]
        # Moves are summed up two by two, as complex numbers, in half the calls.
        moves = self.moves[: len(own)]
        moves[:] = 0
        for k in range(_PREDICTORS // 2):
            np.add.at(moves[:, k], used, inputs.view(np.complex64)[:, k])
        moves *= _STEP
        own += moves.view(np.float32)
        table += np.bincount(bins, dot, len(table)).astype(np.float32) * _REFINE_STEP
        return sums.reshape(n, -1).sum(1, dtype=np.float64)


_ONE, _MOST, _THIRD = np.float32(1), np.float32(8), np.float32(-1 / 3)
_PER_ODDS, _MIDDLE = np.float32((_BINS - 1) / 16), np.float32(_BINS / 2)
_STEP, _REFINE_STEP = np.float32(RATE / 8), np.float32(REFINE_RATE)


def _dealt(chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Chunks in the order of turns and lanes, how many lanes each turn has, and the lanes in which a text begins in it.

    Texts, of so many chunks each, are dealt one after the other into lanes of like length, the longest first. The
    lanes of a turn are the first ones.
    """
    turns = max(int(chunks.max()), -(-int(chunks.sum()) // _LANES))
    lanes = [(0, k) for k in range(-(-int(chunks.sum()) // turns))]
    begin, lane = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
    for text in np.argsort(-chunks, kind="stable").tolist():
        begin[text], lane[text] = lanes[0]
        heapq.heapreplace(lanes, (lanes[0][0] + int(chunks[text]), lanes[0][1]))
    lanes.sort(reverse=True)
    rank = np.empty(len(lanes), np.int64)
    rank[[k for _, k in lanes]] = np.arange(len(lanes))
    lane = rank[lane]
    active = np.searchsorted([-n for n, _ in lanes], -np.arange(lanes[0][0]), side="left")
    first = np.cumsum(active) - active
    turn = np.arange(int(chunks.sum())) + np.repeat(begin - (np.cumsum(chunks) - chunks), chunks)
    order = np.empty(len(turn), np.int64)
    order[first[turn] + np.repeat(lane, chunks)] = np.arange(len(turn))
    by_turn = np.argsort(begin, kind="stable")
    begins = np.split(lane[by_turn], np.searchsorted(begin[by_turn], np.arange(1, len(active))))
    return order, active, begins


def _side_by_side(profiles: _Profiles, splits: Iterable[_Split]) -> np.ndarray:
    """Bits that each of some texts takes."""
    profiles.forget()
    index, sizes = (np.concatenate(x) for x in zip(*(profiles.places(s) for s in splits)))
    index, chunks = index.reshape(-1, CHUNK), -(-sizes // CHUNK)
    order, active, begins = _dealt(chunks)
    mixer, nats, at = _Mixer(int(active[0])), np.empty(len(order)), 0
    for n, begin in zip(active.tolist(), begins):
        if len(begin):
            mixer.begin(begin)
        now = order[at : at + n]
        nats[now] = mixer.turn(profiles.rows.take(index.take(now, axis=0)))
        at += n
    return np.add.reduceat(nats, np.cumsum(chunks) - chunks) / np.log(2) - -sizes % CHUNK


def _alone(profiles: _Profiles, raw: bytes) -> float:
    """Bits that a long text takes; it is walked in stretches that carry the weights on."""
    mixer, left, nats = _Mixer(1), np.zeros(0, np.int64), 0.0
    mixer.begin(np.zeros(1, np.int64))
    for part in _stretches(raw):
        profiles.forget()
        index, _ = profiles.places(part, fill=False)
        left = np.concatenate([left, profiles.rows.take(index)])
        whole = len(left) // CHUNK * CHUNK
        nats += sum(mixer.turn(row)[0] for row in left[:whole].reshape(-1, 1, CHUNK))
        left = left[whole:]
    fill = -len(left) % CHUNK
    if len(left):
        nats += mixer.turn(np.append(left, np.zeros(fill, np.int64))[None])[0]
    return float(nats / np.log(2) - fill)


def score_bits(model: Model, texts: list[str | None]) -> np.ndarray:
    """Bits that the model takes for each text and its end mark."""
    raw, profiles = _raw(texts), _Profiles(model)
    out = np.zeros(len(raw))
    some = [i for i, r in enumerate(raw) if len(r) <= _SLICE_BYTES]
    if some:
        out[some] = _side_by_side(profiles, map(_Split, _sliced([raw[i] for i in some])))
    for i, r in enumerate(raw):
        if len(r) > _SLICE_BYTES:
            out[i] = _alone(profiles, r)
    return out


def _summed(keys: np.ndarray, ones: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums."""
    if not len(keys):
        return keys, ones, total
    low = (len(keys) - 1).bit_length()
    if int(keys.max()) >> 63 - low:
        order = np.argsort(keys)
        keys = keys[order]
    else:  # places ride along in the low bits of what is sorted
        packed = np.sort(keys << low | np.arange(len(keys)))
        order, keys = packed & (1 << low) - 1, packed >> low
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], np.add.reduceat(np.take(ones, order), start), np.add.reduceat(np.take(total, order), start)


class _Vocabulary:
    """Units with their bytes, words and counts; what has no unit is a word or an end."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.n, self.word, self.unit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def _add(self, keys: np.ndarray, n: np.ndarray, word: np.ndarray, unit_of) -> None:
        at = np.searchsorted(self.keys, keys)
        there = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.n[at[there]] += n[there]
        new = np.flatnonzero(~there)
        if len(new):
            units = np.empty(len(new), object)
            units[:] = [unit_of(i) for i in new.tolist()]
            both = np.concatenate([self.keys, keys[new]])
            order = np.argsort(both, kind="stable")
            self.keys = both[order]
            self.n, self.word, self.unit = (np.concatenate(x)[order] for x in ((self.n, n[new]), (self.word, word[new]), (self.unit, units)))

    def units(self, split: _Split) -> None:
        """Count the units of some texts; words that are cut are not counted here."""
        start, stop, mark, keys = split.units()
        one, first, n = np.unique(keys, return_index=True, return_counts=True)
        start, stop, mark = start[first], stop[first], mark[first]
        whole = (mark == _END) & _SPACE[split.data[stop - 1]] & (stop - start > 1) if len(first) else np.zeros(0, bool)
        word = np.zeros(len(first), np.int64)
        word[whole] = split.hashes(start[whole], stop[whole] - 1).view(np.int64)
        self._add(one, n, word, lambda i: bytes([mark[i]]) + split.raw[start[i] : stop[i]])

    def words(self, hashes: np.ndarray) -> None:
        """Count words, and ends, that no unit stands for."""
        one, n = np.unique(hashes, return_counts=True)
        self._add(one, n, one, lambda i: None)

    def rows(self) -> pa.RecordBatch:
        word = pa.array(self.word, mask=self.word == 0)
        out = pa.RecordBatch.from_arrays([pa.array(self.keys), word, pa.array(self.unit.tolist(), pa.binary()), pa.array(self.n)], names=["h", "w", "unit", "n"])
        self.clear()
        return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of texts; they go out whenever many are held."""
    held = _Vocabulary()
    ends = 0
    for batch in batches:
        for a, b in _slices(batch.column(0)):
            raw = _raw(batch.column(0).slice(a, b - a).to_pylist())
            ends += len(raw)
            short = [r for r in raw if len(r) <= _SLICE_BYTES]
            if short:
                split = _Split(short)
                held.units(split)
                cut = (split.stop - split.start) > _UNIT
                held.words(split.hashes(split.start[cut], split.stop[cut] - 1).view(np.int64))
            for r in raw:
                if len(r) > _SLICE_BYTES:
                    for part in _stretches(r):
                        held.units(part)
                        if len(held.keys) > _KEPT_UNITS:
                            yield held.rows()
                    held.words(_cut_words(r))
            if len(held.keys) > _KEPT_UNITS:
                yield held.rows()
    held.words(np.full(ends, _END_HASH, np.uint64).view(np.int64))
    yield held.rows()


def _cut_words(raw: bytes) -> np.ndarray:
    """Hashes of the words of a long text that are cut into several units."""
    words = (m[0] for m in re.finditer(rb"[^ \t-\r]{%d,}" % _UNIT, raw))
    return np.concatenate([np.zeros(0, np.int64), *(_word_hash(w).view(np.int64) for w in words)])


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The materialised ``(h, w, unit, n)`` of all rows of ``docs``: each unit, its whole word's hash and its count.

    Words that are cut into units, and ends, have rows of their own without a unit.
    """
    found = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), _seen, "h long, w long, unit binary, n long")
    return materialise(found.groupBy("h", "w", "unit").agg(F.sum("n").alias("n")), "units")


def _windows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many rows each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(rows)
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(rows)


def _unit_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, marks and sizes of units, whose first byte is the mark."""
    units = column.to_pylist()
    sizes = np.array([len(u) for u in units], np.int64)
    every = np.frombuffer(b"".join(units), np.uint8)
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(every), bool)
    inner[starts] = False
    return every[inner], every[starts], sizes - 1


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of bytes (or marks) two before and before a byte, and the byte, in units."""
    for part in _windows(batches, 100_000):
        data, mark, sizes = _unit_bytes(part.column(0))
        within, mark = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(mark, sizes)
        one, two = (np.where(within >= k, np.roll(data, k), mark).astype(np.int64) for k in (1, 2))
        seen, place = np.unique(two << 16 | one << 8 | data, return_inverse=True)
        n = np.bincount(place, np.repeat(part.column(1).to_numpy(), sizes), len(seen)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], names=["key", "n"])


def _halved(ones: np.ndarray, total: np.ndarray) -> tuple[bytes, bytes]:
    """Counts in 16 bits, great ones in proportion."""
    by = np.maximum(1.0, total / 65535)
    return np.rint(ones / by).astype(np.uint16).tobytes(), np.rint(total / by).astype(np.uint16).tobytes()


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers in all rows of a column of bytes."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def train(docs: DataFrame, text_col: str = "text", slot_bits: int | None = None, units: DataFrame | None = None) -> Model:
    """Learn from all rows of ``docs``: their units, of these the byte pairs for the trees, then bits in every context.

    The driver is given 65,536 pairs and what comes after _TREES of them, and tables whose slots follow the number of units up to 2^MAX_SLOT_BITS. Contexts
    are counted by ranges of slots; of those that share a slot the most frequent keeps it.
    """
    spark = docs.sparkSession
    units = vocabulary(docs, text_col) if units is None else units
    some = units.filter("unit is not null").select("unit", "n")
    found = materialise(map_batches(some, _triples, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "triples")
    counted = found.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(65536, np.int64)
    pairs[counted["key"].to_numpy()] = counted["n"].to_numpy()
    last = F.shiftright("key", 8)
    often = found.groupBy(last.alias("last")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "last").limit(_TREES)
    deeper: dict[int, np.ndarray] = {}
    for key, n in zip(*(c.to_pylist() for c in found.join(F.broadcast(often.select("last")), last == F.col("last")).select("key", "n").toArrow().columns)):
        deeper.setdefault(key >> 8, np.zeros(256, np.int64))[key & 255] = n
    trees, each = build_trees(pairs.reshape(256, 256), deeper)
    known, each = spark.sparkContext.broadcast(trees), np.repeat(each, trees.length)
    nodes = _pack(np.bincount(trees.node, each * trees.bit), np.bincount(trees.node, each))
    bits = slot_bits or min(MAX_SLOT_BITS, max(12, (4 * units.count()).bit_length()))
    hashed = len(_ORDERS) + 1
    step = 1 << min(bits, 18)  # slots of a range
    parts = (hashed << bits) // step

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys: np.ndarray, ones: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.int64) * (step << _CHECK_BITS)).tolist()
            own = [(p, slice(a, b)) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            counts = [_halved(ones[r], total[r]) for _, r in own]
            data = [[keys[r].astype(np.uint32).tobytes() for _, r in own], [o for o, _ in counts], [t for _, t in counts]]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int64()), *(pa.array(x, pa.binary()) for x in data)], names=["p", "keys", "ones", "total"])

        for some in _windows(batches, _COUNTED_UNITS):
            hashes, _, bit, decisions = _decided(known.value, *_unit_bytes(some.column(0)))
            n = np.repeat(some.column(1).to_numpy(), decisions)
            for k, own in enumerate(hashes):
                yield rows(*_summed(_slots(own, bits) + (k << bits + _CHECK_BITS), n * bit, n))

    def kept(rows: pa.Table) -> pa.Table:
        keys = _joined(rows["keys"], np.uint32).astype(np.int64)
        ones, total = (_joined(rows[c], np.uint16).astype(np.int64) for c in ("ones", "total"))
        keys, ones, total = _summed(keys, ones, total)
        order = np.lexsort((-keys, total, keys >> _CHECK_BITS))
        slot = keys[order] >> _CHECK_BITS
        last = order[np.flatnonzero(np.append(slot[1:] != slot[:-1], True))]
        vals = np.full(step, 64, np.uint16)
        vals[(keys[last] >> _CHECK_BITS) - rows["p"][0].as_py() * step] = _pack(ones[last], total[last], keys[last] & (1 << _CHECK_BITS) - 1)
        return pa.table({"p": rows["p"][:1], "vals": pa.array([vals.tobytes()], pa.binary())})

    ranges = map_batches(some, counted, "p long, keys binary, ones binary, total binary").repartition(parts, "p")
    found = ranges.groupBy("p").applyInArrow(kept, "p long, vals binary").toArrow()
    tables = np.full((parts, step), 64, np.uint16)
    for p, vals in zip(found["p"].to_pylist(), found["vals"].to_pylist()):
        tables[p] = np.frombuffer(vals, np.uint16)
    return Model(trees, [nodes, *tables.reshape(hashed, 1 << bits)], bits)


def _known_words(head: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """Of each text: words and end, those in ``head``, the sum of their logs, and the hashes of the others."""
    starts = np.cumsum(sizes) - sizes
    one, place = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(head[0], one), max(0, len(head[0]) - 1))
    there = head[0][at] == one if len(head[0]) else np.zeros(len(one), bool)
    logs = np.where(there, head[1][at], 0.0)[place] if len(head[0]) else np.zeros(len(hashes))
    known = there[place]
    tail = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(~known, starts))), pa.int32()), pa.array(hashes[~known]))
    return [pa.array(sizes), pa.array(np.add.reduceat(known, starts, dtype=np.int64)), pa.array(np.add.reduceat(logs, starts)), tail]


def score(docs: DataFrame, model: Model, text_col: str = "text", head: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, with ``bits`` and ``n_bytes``, one row for each.

    With ``head``, sorted hashes of words and logs of their counts, also ``n_tokens``, ``n_known``, ``logs`` and
    ``tail``, the hashes of words that are not in it. A column of ``docs`` that has the name of an output is left out
    in its favour. Null texts are empty; null ids and repeated rows come out as they go in.
    """
    known = docs.sparkSession.sparkContext.broadcast((model, head))
    more = ["bits double", "n_bytes long", *(["n_tokens long", "n_known long", "logs double", "tail array<long>"] if head else [])]
    rows = docs.select(F.col(text_col).cast("string").alias(fresh(docs.columns, "text_")), *others(docs.columns, [text_col, *(m.split()[0] for m in more)]))
    target = rows.drop(rows.columns[0]).limit(0).selectExpr("*", *(f"cast(null as {t}) as {n}" for n, t in map(str.split, more))).schema
    names = [f.name for f in target.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head = known.value
        profiles = _Profiles(model)

        def scored(part: pa.RecordBatch, raw: list[bytes]) -> pa.RecordBatch:
            if len(raw) == 1 and len(raw[0]) > _SLICE_BYTES:
                bits = np.array([_alone(profiles, raw[0])])
                words = _long_words(raw[0])
                words = [(words, np.array([len(words)]))]
            else:
                words = []

                def splits() -> Iterator[_Split]:
                    for some in _sliced(raw):
                        split = _Split(some)
                        if head:
                            words.append(split.words())
                        yield split

                bits = _side_by_side(profiles, splits())
            found = _known_words(head, *map(np.concatenate, zip(*words))) if head else []
            return pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(bits), pa.array([len(r) for r in raw], pa.int64()), *found], names=names)

        def settled(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pool = pa.Table.from_batches(waiting).combine_chunks()
            sizes = np.array([len(x.as_buffer() or b"") for x in pool.column(0)], np.int64)
            order = np.argsort(-sizes, kind="stable")
            # Texts of like sizes side by side, the longest first; one longer than a slice is alone.
            alone = sizes[order] > _SLICE_BYTES
            group = np.where(alone, -1 - np.arange(len(order)), np.cumsum(np.where(alone, 0, sizes[order] + 1)) // _GROUP_BYTES)
            for part in np.split(order, np.flatnonzero(np.diff(group)) + 1):
                own = pool.take(pa.array(part)).combine_chunks().to_batches()[0]
                yield scored(own, _raw(own.column(0).to_pylist()))

        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                waiting.append(batch.slice(a, b - a))
                size += sum(len(x.as_buffer() or b"") for x in waiting[-1].column(0))
                if size > _POOL_BYTES:
                    yield from settled(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from settled(waiting)

    return map_batches(rows, run, target)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text, modulo seven, is two; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 7 == 2


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``, row for row.

    base_score is the add-one unigram score of words and end in log10, score the mixed model's log10 probability
    of the whole text in lower case (A-Z) and its end, bits_per_byte its bits over the text's bytes. Both learn
    from the rows whose crc32 of the id as text, modulo seven, is not two. A null text is empty and has the end
    alone; a row with a null id is scored, teaches nothing and is not held out; repeated rows count as often as
    they come; an empty table gives an empty result; other columns are not looked at. Words are told by 64-bit hashes.
    """
    key = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"))
    rows = _texts(docs, id_col, text_col)
    teach = F.coalesce(~held_out("doc_id"), F.lit(False))
    units = vocabulary(rows.filter(teach))
    model = train(rows.filter(teach), slot_bits=slot_bits, units=units)
    words = materialise(units.filter("w is not null").groupBy(F.col("w").alias("h")).agg(F.sum("n").alias("c")), "words")
    levels = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), *[F.sum((F.col("c") >= 1 << j).cast("long")).alias(f"l{j}") for j in range(48)]).first()
    n, v = levels["n"] or 0, levels["v"]
    least = next(1 << j for j in range(48) if (levels[f"l{j}"] or 0) <= head_words)
    top = words.filter(F.col("c") >= least).toArrow()
    order = np.argsort(top["h"].to_numpy())
    head = top["h"].to_numpy()[order], np.log10(top["c"].to_numpy()[order] + 1.0)
    keyed = rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = materialise(score(keyed.withColumn("text_key", key), model, head=head), "scored")

    tail = words.filter(F.col("c") < least)
    other = scored.select("text_key", F.explode("tail").alias("h")).groupBy("text_key", "h").agg(F.count("*").alias("k")).join(tail, "h")
    seldom = other.groupBy("text_key").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("logs"))
    # Rows with one text fall together here; their number is known from the scored rows.
    copies = scored.groupBy("text_key").agg(F.count("*").alias("copies"))
    seldom = seldom.join(copies, "text_key").select(
        F.col("text_key").alias("seldom_key"), F.floor(F.col("known") / F.col("copies")).cast("long").alias("more_known"), (F.col("logs") / F.col("copies")).alias("more_logs")
    )
    out = scored.drop("tail").join(seldom, F.col("text_key") == F.col("seldom_key"), "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (-F.col("bits") * F.log10(F.lit(2.0))).alias("score"),
        (F.col("bits") / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
