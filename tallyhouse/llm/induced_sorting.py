"""External induced sorting of the suffixes of one shard, with common-prefix lengths.

The shard's suffixes are split by type: an S suffix is smaller than the one after it, an L suffix larger, and an S suffix
after an L suffix is S*. The S* suffixes are sorted first, by names of the stretches between them. The others follow by
induction: whenever a suffix is read in order, the suffix before it becomes known and goes into a priority queue under
its first symbol. L suffixes come out in rising order, then S suffixes in falling order.

A queue holds, for each symbol, suffixes in the order in which they were put (which is their order), with the length of
the prefix that each shares with the one before it; lengths are carried through the induction as minima over what was read
between the two sources. Queues keep a bounded number of entries in memory; the rest lies in files of a folder that the
caller names. In memory besides them are the text and the sorted S* suffixes.

Symbols are bytes; 0xFF, which UTF-8 never holds, separates the pieces of a shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs

from tallyhouse.session import arrow_uri

SEPARATOR = 0xFF

#: Entries of a queue that stay in memory (6 bytes each).
QUEUE_ENTRIES = 8 << 20


class DiskQueue:
    """Entries (place, common prefix) by symbol, each symbol first in, first out; what exceeds the bound goes to files."""

    def __init__(self, folder: str, bound: int = QUEUE_ENTRIES):
        self.system, self.folder = pafs.FileSystem.from_uri(arrow_uri(folder))
        self.held: list[list] = [[] for _ in range(256)]
        self.sizes = np.zeros(256, np.int64)
        self.bound, self.made = bound, False

    def put(self, symbol: int, places: np.ndarray, shared: np.ndarray) -> None:
        self.held[symbol].append((places.astype(np.int32), shared.astype(np.int16)))
        self.sizes[symbol] += len(places)
        while self.sizes.sum() > self.bound:
            self._spill(int(self.sizes.argmax()))

    def _spill(self, symbol: int) -> None:
        if not self.made:
            self.system.create_dir(self.folder, recursive=True)
            self.made = True
        inside = [k for k, x in enumerate(self.held[symbol]) if isinstance(x, tuple)]
        name = f"{self.folder}/{uuid.uuid4().hex}"
        places, shared = (np.concatenate([self.held[symbol][k][c] for k in inside]) for c in (0, 1))
        with self.system.open_output_stream(name, compression=None) as out:
            out.write(places.tobytes())
            out.write(shared.tobytes())
        # entries in memory are always later than those in files
        self.held[symbol] = [x for x in self.held[symbol] if not isinstance(x, tuple)] + [name]
        self.sizes[symbol] = 0

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All entries of a symbol, also those put meanwhile; those in memory at once."""
        while self.held[symbol]:
            if isinstance(self.held[symbol][0], tuple):
                entries, self.held[symbol] = self.held[symbol], []
                self.sizes[symbol] = 0
                yield entries[0] if len(entries) == 1 else tuple(np.concatenate(c) for c in zip(*entries))
            else:
                entry = self.held[symbol].pop(0)
                with self.system.open_input_stream(entry, compression=None) as source:
                    raw = source.read()
                self.system.delete_file(entry)
                n = len(raw) // 6
                yield np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int16, n, 4 * n)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The end of the text counts as smaller than any symbol, so that the last suffix is L."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    rise[-1] = -1
    decided = np.where(rise != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return rise[following] > 0


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(keys)
    new = np.zeros(len(keys), np.int64)
    new[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(rank[order[-1]]) + 1 if len(order) else 0


def name_stretches(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the stretches from each S* place to the next (inclusive), compared by symbol and type."""
    symbols = np.zeros(len(text) + 4, np.uint64)
    symbols[: len(text)] = 2 * text.astype(np.uint64) + is_s + 2
    ends = np.append(stars[1:] + 1, len(text))
    rank, n = np.zeros(len(stars), np.int64), 1
    live = np.arange(len(stars))
    step = 0
    while len(live):
        place = stars[live] + step
        word = np.zeros(len(live), np.uint64)
        for k in range(3):
            inside = place + k < ends[live]
            word = (word << np.uint64(10)) | np.where(inside, symbols[np.minimum(place + k, len(text))], 0).astype(np.uint64)
        # ranks so far in the high bits, the next three symbols below
        key = (rank[live].astype(np.uint64) << np.uint64(30)) | word
        refined = np.zeros(len(stars), np.uint64)
        refined[:] = rank.astype(np.uint64) << np.uint64(30)
        refined[live] = key
        rank, n = _dense(refined)
        step += 3
        counts = np.bincount(rank, minlength=n)
        live = live[(counts[rank[live]] > 1) & (stars[live] + step < ends[live])]
    return rank, n


def sort_stars(rank: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Order of the suffixes of the string of names, by their first ``depth`` names at least; prefixes are doubled."""
    size, length = len(rank), 1
    while n < size and length < depth:
        counts = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(counts[rank] > 1)
        after = np.zeros(len(tied), np.int64)
        inside = tied + length < size
        after[inside] = rank[tied[inside] + length] + 1
        sub, _ = _dense(rank[tied] * (size + 2) + after)
        # a rank leaves room for its ties, so that the order within them is added to it
        below = np.concatenate([[0], np.cumsum(counts)])[:-1]
        wide = below[rank]
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, rank[tied], sub)
        wide[tied] += sub - first[rank[tied]]
        rank, n = _dense(wide)
        length *= 2
    return np.argsort(rank)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``most``."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    out = np.zeros(len(a), np.int64)
    room = np.minimum(len(text) - np.maximum(a, b), most)
    live = np.arange(len(a))
    while len(live):
        x = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        same = np.full(len(live), 8)
        for k in range(8):
            same = np.where((same == 8) & ((x >> np.uint64(56 - 8 * k)) & np.uint64(0xFF) != 0), k, same)
        out[live] += same
        live = live[(same == 8) & (out[live] < room[live])]
    return np.minimum(out, room)


class _Minima:
    """Minima of stretches of an array, by tables of doubling widths."""

    def __init__(self, values: np.ndarray):
        self.tables, width = [values], 1
        while 2 * width <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Over [first, end), which is not empty."""
        level = np.frexp(end - first)[1] - 1
        out = np.empty(len(first), self.tables[0].dtype)
        for k in np.unique(level):
            at = level == k
            table = self.tables[k]
            out[at] = np.minimum(table[first[at]], table[end[at] - (1 << int(k))])
        return out


class _Induction:
    """Reads suffixes in order and queues the suffixes before them that are wanted."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, most: int, queue: DiskQueue):
        self.text, self.wanted, self.most, self.queue = text, wanted, most, queue
        #: smallest common prefix read since a symbol's last entry; -1 before its first
        self.since = np.full(256, -1, np.int64)

    def read(self, places: np.ndarray, shared: np.ndarray) -> None:
        """``shared`` is each suffix's common prefix with the one read before it."""
        if not len(places):
            return
        before = np.maximum(places - 1, 0)
        chosen = np.flatnonzero((places > 0) & self.wanted[before])
        symbols = self.text[before[chosen]]
        order = np.argsort(symbols, kind="stable")
        chosen, symbols = chosen[order], symbols[order]
        heads = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if len(chosen) else np.zeros(0, int)
        minima = _Minima(shared.astype(np.int16))
        first = np.zeros(len(chosen), np.int64)
        first[1:] = chosen[:-1] + 1
        first[heads] = 0
        between = minima(first, chosen + 1).astype(np.int64) if len(chosen) else first
        own = symbols[heads]
        since = self.since[own]
        between[heads] = np.where(since < 0, -1, np.minimum(since, between[heads]))
        self.since = np.where(self.since < 0, -1, np.minimum(self.since, shared.min()))
        tails = np.append(heads[1:], len(chosen)) - 1 if len(heads) else heads
        left = chosen[tails] + 1
        rest = np.full(len(tails), self.most, np.int64)
        inside = left < len(shared)
        if inside.any():
            rest[inside] = minima(left[inside], np.full(inside.sum(), len(shared)))
        self.since[own] = rest
        values = np.minimum(between + 1, self.most)
        for symbol, a, b in zip(own.tolist(), heads.tolist(), (tails + 1).tolist()):
            self.queue.put(symbol, before[chosen[a:b]], values[a:b])


def repeated_starts(text: np.ndarray, length: int, folder: str, bound: int = QUEUE_ENTRIES) -> np.ndarray:
    """Marks the places whose suffix shares at least ``length`` symbols with another suffix."""
    n = len(text)
    if n >= 1 << 31 or length >= 1 << 15:
        raise ValueError("entries of a queue hold places in 32 bits and common prefixes in 16")
    marks = np.zeros(n, bool)
    if n == 0:
        return marks
    is_s = suffix_types(text)
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    names, count = name_stretches(text, is_s, stars)
    sorted_stars = stars[sort_stars(names, count, length // 2 + 1)] if len(stars) else stars
    star_shared = np.zeros(len(stars), np.int64)
    star_shared[1:] = common_prefix(text, sorted_stars[:-1], sorted_stars[1:], length)
    star_symbol = text[sorted_stars]
    star_from = np.searchsorted(star_symbol, np.arange(257))

    def mark(places, shared, last):
        """Marks both sides of every pair that shares enough; ``last`` is the suffix read before."""
        long = shared >= length
        marks[places[long]] = True
        marks[places[:-1][long[1:]]] = True
        if long[0] and last is not None:
            marks[last] = True

    rising = DiskQueue(f"{folder}/rising-{uuid.uuid4().hex}", bound)
    large = DiskQueue(f"{folder}/large-{uuid.uuid4().hex}", bound)
    ends = {}
    forward = _Induction(text, ~is_s, length, rising)
    rising.put(int(text[-1]), np.array([n - 1]), np.array([0]))
    forward.since[int(text[-1])] = 0
    for symbol in range(256):
        last = None
        for places, shared in rising.take(symbol):
            mark(places, shared, last)
            forward.read(places, shared)
            large.put(symbol, places, shared)
            last = int(places[-1])
        ends[symbol] = last
        a, b = star_from[symbol], star_from[symbol + 1]
        if a < b:
            shared = star_shared[a:b].copy()
            shared[0] = 0 if last is None else common_prefix(text, np.array([last]), sorted_stars[a : a + 1], length)[0]
            forward.read(sorted_stars[a:b], shared)

    falling = DiskQueue(f"{folder}/falling-{uuid.uuid4().hex}", bound)
    backward = _Induction(text, is_s, length, falling)
    for symbol in range(255, -1, -1):
        last = None
        for places, shared in falling.take(symbol):
            mark(places, shared, last)
            backward.read(places, shared)
            last = int(places[-1])
        parts = list(large.take(symbol))
        for k, (places, shared) in enumerate(reversed(parts)):
            # the common prefix with the suffix read before, which is the next larger one
            down = np.empty(len(places), np.int64)
            down[1:] = shared[1:][::-1]
            if k:
                down[0] = parts[len(parts) - k][1][0]
            elif last is None:
                down[0] = 0
            else:
                down[0] = common_prefix(text, np.array([last]), places[-1:], length)[0]
                if down[0] >= length:
                    marks[[last, int(places[-1])]] = True
            backward.read(places[::-1], down)
    return marks
