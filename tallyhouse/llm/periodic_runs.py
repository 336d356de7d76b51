"""Periodic runs in word sequences: maximal stretches that repeat a period, such as phrases stuck in a loop.

A stretch of words has period q if words q apart are identical. A run is a stretch with smallest period q and at least
``least_exponent`` periods and ``least_words`` words that neither neighbouring word extends. Per document:

1. A word that repeats within its run stands at most q words after its last occurrence. Stretches in which that holds
   for long enough, by doubling bounds of q, are the only ones that runs can lie in; prose has very few.
2. Each such stretch goes into a suffix automaton. Its suffix links form a tree in which the states of a prefix are a path
   to the root. Every state has a colour, the end of its last occurrence. The words are appended one by one: an access of
   a link-cut tree walks the path of the new prefix, one step for each segment of one colour, and recolours it. A segment
   of colour e on the path of the prefix that ends at i is the last occurrence, ending at e, of its longest string, which
   has l words: if l is i - e, the words up to i are a square of that period whose left neighbour doesn't extend it, as
   in each run exactly one is.
3. Each square is extended to its run.

Accesses take O(log n) steps each, amortised. Stretches longer than ``BLOCK_WORDS`` are taken in overlapping blocks of at
least eight periods, each of which holds four periods of any run that starts in its first half.

Defined cases: a null text is empty; empty texts have no words and no runs; repeated rows get equal results; a null
``doc_id`` stays null; words are compared by 64-bit hashes. Memory grows with a text, and for the automaton with
``BLOCK_WORDS`` or eight times the longest period looked for. Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shipping import ship
from tallyhouse.llm.words import row_blocks, spaced_words, text_bytes

LEAST_EXPONENT = 4
LEAST_WORDS = 6

#: Words that go into one automaton (some 500 bytes each), unless eight periods need more.
BLOCK_WORDS = 1 << 16

SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def last_seen(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words from the last occurrence of each word in its row; more than there are words for first ones."""
    key = hashes ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    distance = np.full(len(hashes), len(hashes) + 1, np.int64)
    again = key[order[1:]] == key[order[:-1]]
    distance[order[1:][again]] = (order[1:] - order[:-1])[again]
    return distance


def _stretches(near: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least ``least`` neighbours that are ``near``."""
    edges = np.flatnonzero(np.diff(near, prepend=False, append=False))
    first, end = edges[::2], edges[1::2]
    long = end - first >= least
    return first[long], end[long]


def suspicious(distance: np.ndarray, rows: np.ndarray, first_word: np.ndarray, exponent: int, words: int):
    """Per doubling bound of the period: bound, and the (first, end) of the stretches that runs up to it can lie in.

    Within a run of period q, ``lower`` < q <= ``bound``, all words but the first q repeat within q; it is inside the
    stretch, the ``bound`` words before that, and a neighbour on either side.
    """
    bound, lower = 1, 0
    longest = int(np.diff(first_word).max(initial=0))
    while exponent * (lower + 1) <= longest:
        least = max((exponent - 1) * (lower + 1), words - bound)
        first, end = _stretches(distance <= bound, least)
        if len(first):
            row = rows[first]
            first, end = first - bound - 1, end + 1
            yield bound, np.maximum(first, first_word[row]), np.minimum(end, first_word[row + 1])
        bound, lower = 2 * bound, bound


def _merged(pieces: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """The union of (first, end) stretches; those that only touch may be of two rows and are kept apart."""
    if not pieces:
        return
    first, end = (np.concatenate(part) for part in zip(*pieces))
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(first[1:] >= reach[:-1]) + 1
    yield from zip(first[np.r_[0, cut]].tolist(), reach[np.r_[cut - 1, len(reach) - 1]].tolist())


def _automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest string of each state of the words' suffix automaton, and the state of each prefix."""
    link, size, step, prefix = [-1], [0], [{}], []
    last = 0
    for n, word in enumerate(ids, 1):
        state = len(link)
        link.append(0)
        size.append(n)
        step.append({})
        prefix.append(state)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = state
            at = link[at]
        if at >= 0:
            target = step[at][word]
            if size[target] == size[at] + 1:
                link[state] = target
            else:
                clone = len(link)
                link.append(link[target])
                size.append(size[at] + 1)
                step.append(step[target].copy())
                while at >= 0 and step[at].get(word) == target:
                    step[at][word] = clone
                    at = link[at]
                link[target] = link[state] = clone
        last = state
    return link, size, prefix


class LinkCutTree:
    """Preferred paths of a rooted tree as splay trees; the nodes of a path have one colour, kept at its splay root.

    Node 0 stands for "none", which leaves the root of the suffix links out of all paths.
    """

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up, self.left, self.right = list(parent), [0] * n, [0] * n
        self.colour = [-1] * n

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree."""
        up, left, right = self.up, self.left, self.right
        root = x
        while True:
            p = up[root]
            if not p or (left[p] != root and right[p] != root):
                break
            root = p
        colour = self.colour[root]
        while root != x:
            p = up[x]
            g = up[p]
            if p != root:
                same = (left[p] == x) == (left[g] == p)
                self._rotate(p if same else x)
            else:
                root = x
            self._rotate(x)
            if g == root:
                root = x
        self.colour[x] = colour

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``node`` to the root; gives each old colour with the path's lowest node of it."""
        below, at = 0, node
        while at:
            self._splay(at)
            old = self.colour[at]
            if old >= 0:
                yield old, at
            rest = self.right[at]
            if rest:
                self.colour[rest] = old
            self.right[at] = below
            below, at = at, self.up[at]
        self.colour[below] = colour


def squares(ids: list[int]) -> Iterator[tuple[int, int]]:
    """(start, period) of the first square of each run of at least two periods."""
    link, size, prefix = _automaton(ids)
    tree = LinkCutTree([max(p, 0) for p in link])
    for end, state in enumerate(prefix):
        for last, node in tree.access(state, end):
            if size[node] == end - last:
                yield end - 2 * size[node] + 1, size[node]


def _same_until(ids: np.ndarray, at: int, period: int, end: int) -> int:
    """The first place from ``at`` on whose word differs from that ``period`` before; ``end`` if there is none."""
    width = 64
    while at < end:
        stop = min(at + width, end)
        differ = ids[at:stop] != ids[at - period : stop - period]
        if differ.any():
            return at + int(differ.argmax())
        at, width = stop, 4 * width
    return end


def _extended(ids: np.ndarray, start: int, period: int, first: int, end: int) -> tuple[int, int]:
    """Start and end of the run that holds the square at ``start``, within the row from ``first`` to ``end``."""
    finish = _same_until(ids, start + 2 * period, period, end)
    back = ids[first : start + period][::-1]
    return first + len(back) - _same_until(back, period, period, len(back)), finish


def find_runs(hashes: np.ndarray, rows: np.ndarray, first_word: np.ndarray, exponent: int, words: int):
    """Sorted (row, start, length, period) of all runs; ``first_word`` has the first word of each row, and the end."""
    distance = last_seen(hashes, rows)
    usual, groups = [], []
    for bound, *places in suspicious(distance, rows, first_word, exponent, words):
        if 2 * exponent * bound <= BLOCK_WORDS:
            usual.append(places)
        else:
            groups.append((2 * exponent * bound, [places]))
    found: dict[tuple[int, int], int] = {}
    for width, pieces in [(BLOCK_WORDS, usual), *groups]:
        for first, end in _merged(pieces):
            for at in range(first, max(end - width // 2, first + 1), width // 2):
                block = hashes[at : min(at + width, end)]
                _, ids = np.unique(block, return_inverse=True)
                reach: dict[int, int] = {}
                for start, period in squares(ids.tolist()):
                    start += at
                    if start + 2 * period <= reach.get(period, 0):
                        continue
                    row = rows[start]
                    start, finish = _extended(hashes, start, period, int(first_word[row]), int(first_word[row + 1]))
                    reach[period] = finish
                    if finish - start >= max(words, exponent * period):
                        found[start, period] = finish
    for (start, period), finish in sorted(found.items()):
        row = int(rows[start])
        yield row, start - int(first_word[row]), finish - start, period


def _batch(ids: list, n_words: list[int], runs: list[list[tuple]], collapsed: list[bytes]) -> pa.RecordBatch:
    flat = [run for some in runs for run in some]
    fields = [pa.array([run[k] for run in flat], pa.int64()) for k in range(3)]
    starts = np.r_[0, np.cumsum([len(some) for some in runs], dtype=np.int64)].astype(np.int32)
    listed = pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    texts = pa.array(collapsed, pa.binary()).cast(pa.string())
    columns = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), listed, texts]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def collapse(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and in their first periods, joined by one space."""
    kept = text.split()  # at space and the controls 9 to 13
    if runs:
        drop = bytearray(len(kept))
        for start, length, period in runs:
            drop[start + period : start + length] = b"\1" * (length - period)
        kept = [word for word, gone in zip(kept, drop) if not gone]
    return b" ".join(kept)


def detect(docs: DataFrame, exponent: int = LEAST_EXPONENT, words: int = LEAST_WORDS) -> DataFrame:
    """Of every document: number of words, runs by start and period, and the text with each run cut to one period."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_blocks(offsets):
                part = data[offsets[a] : offsets[b]]
                cuts = offsets[a : b + 1] - offsets[a]
                found = spaced_words(part, cuts)
                runs = [[] for _ in range(b - a)]
                for row, *run in find_runs(found.hash, found.rows(), found.first, exponent, words):
                    runs[row].append(run)
                raw = part.tobytes()
                collapsed = [collapse(raw[cuts[k] : cuts[k + 1]], some) for k, some in enumerate(runs)]
                yield _batch(batch.column(0)[a:b].to_pylist(), np.diff(found.first).tolist(), runs, collapsed)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)
