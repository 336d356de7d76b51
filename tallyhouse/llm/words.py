"""Vectorised word splitting and hashing of Arrow text columns, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (some 80 bytes of memory each); a longer text is worked on alone.
BLOCK_BYTES = 256 << 10

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20260).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _alphanumeric() -> np.ndarray:
    """Byte -> lower-case byte of a word made of digits, letters and bytes above 0x7F; 0 elsewhere."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            table[b] = b
        elif 0x41 <= b <= 0x5A:
            table[b] = b + 0x20
    return table


def _spaced() -> np.ndarray:
    """Byte -> class of a word made of anything but space and the controls 9 to 13; False elsewhere."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


ALPHANUMERIC = _alphanumeric()
IN_ALPHANUMERIC = ALPHANUMERIC > 0
IN_SPACED = _spaced()
UNCHANGED = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the multiplier modulo 2^64, kept between calls up to the usual block."""
    name = "inverse" if inverse else "power"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, _INVERSE if inverse else _MULTIPLIER, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * BLOCK_BYTES:
            _powers[name] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span; one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal contents wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


class Words:
    """The words of some texts: byte spans, 64-bit hashes, the row of each, and each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, letters: np.ndarray):
        n = len(data)
        member = np.zeros(n + 2, bool)
        member[1:-1] = inside[data]
        edge = member[1:] != member[:-1]
        starts_here = edge[:-1] & member[1:-1]
        ends_here = edge.copy()
        ends_here[:-1] &= ~member[1:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        if len(cuts):
            joined = cuts[member[cuts] & member[cuts + 1]]
            starts_here[joined] = True
            ends_here[joined] = True
        self.starts = np.flatnonzero(starts_here)
        self.ends = np.flatnonzero(ends_here)
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = span_hash(prefix_hash(_BYTE_VALUES[letters[data]]), self.starts, self.ends)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def alphanumeric_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of digits, letters (A-Z lower-cased) and anything outside ASCII."""
    return Words(data, offsets, IN_ALPHANUMERIC, ALPHANUMERIC)


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words between spaces and the controls 9 to 13, unchanged."""
    return Words(data, offsets, IN_SPACED, UNCHANGED)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window of ``width`` neighbours."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


_PLACE_BITS = np.uint64(26)


def owners(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of every window of ``width`` grams: its leftmost gram of smallest hash.

    Equal windows have equal anchors at the same place, whatever surrounds them. Returns (anchor place, first window,
    window after the last) for each run of windows with the same anchor. ``grams`` has at most 2^26 entries.
    """
    place = np.arange(len(grams), dtype=np.uint64)
    least = window_minima((grams >> _PLACE_BITS << _PLACE_BITS) | place, width)
    anchor = (least & np.uint64((1 << 26) - 1)).astype(np.int64)
    change = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], change]) if len(anchor) else change
    last = np.append(change, len(anchor)) if len(anchor) else change
    return anchor[first], first, last
