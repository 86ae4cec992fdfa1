"""Vectorised text helpers that run inside tasks: word splitting, substring hashes, minimisers.

A batch of texts is one byte buffer plus offsets, as Arrow has it. All hashes are 64-bit and
depend on content alone, so any two tasks agree on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_R = U(0x9E3779B97F4A7C15)
_R_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, CHUNK + 1024)
        for name, base in (("up", _R), ("down", _R_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``limit`` bytes, or one longer text."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def rolling_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes from each position."""
    sums = prefix_sums(buf)
    _, down = _powers(len(sums))
    n = len(buf) - k + 1
    return mix((sums[k:] - sums[:n]) * down[:n])


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't in ``space``; none crosses a text."""
    solid = ~space[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    after = np.empty(len(buf), bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and the texts' offsets into them."""
    starts, ends = word_spans(buf, offs, space)
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        sums = prefix_sums(buf[base : ends[j - 1]])
        hashes[i:j] = span_hash(sums, starts[i:j] - base, ends[i:j] - base)
        i = j
    return starts, ends, hashes, np.searchsorted(starts, offs)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours in h; runs that cross texts are the caller's to drop."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += h[j : j + m] * _STEP[j]
    return mix(out)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def lower(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented letters of the first two-byte block, in UTF-8."""
    out = lower_ascii(buf)
    at = np.flatnonzero((out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)) + 1
    if len(at):
        out = out.copy()
        out[at] += np.uint8(32)
    return out


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    have, out = 1, keys
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out


def minimisers(h: np.ndarray, w: int) -> np.ndarray:
    """For every w neighbours in h, the position of the least hash, the leftmost among equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = U(20)
    low = (U(1) << bits) - U(1)
    out = np.empty(n, np.int64)
    step = (1 << 20) - w
    for s in range(0, n, step):
        e = min(n, s + step)
        part = h[s : e + w - 1]
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out[s:e] = (_least(keys, w) & low).astype(np.int64) + s
    return out


def spread(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def runs_of(window_doc_end: np.ndarray, anchor: np.ndarray, first_unit: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut valid windows (those inside one text) to runs with one anchor: first window, count, anchor."""
    valid = np.flatnonzero(window_doc_end)
    if not len(valid):
        z = np.zeros(0, np.int64)
        return z, z, z
    a = anchor[valid]
    cut = np.flatnonzero((np.diff(valid) != 1) | (np.diff(a) != 0)) + 1
    begin = np.concatenate([[0], cut])
    return valid[begin] + first_unit, np.diff(np.concatenate([begin, [len(valid)]])), a[begin] + first_unit
