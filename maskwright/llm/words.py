"""Words and window hashes of whole Arrow text columns, computed with numpy on the UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D (`[^\\x20\\x09-\\x0D]+`); as these are
ASCII, working on UTF-8 bytes and on code points gives the same words.  Hashes are polynomial
(Rabin-Karp) in Z/2^64 with an odd base, so that every sub-range comes from two prefix sums, and are
finished with a 64-bit mixer.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE_BYTES, _BASE_WORDS = 0x9E3779B97F4A7C1B, 0xD1342543DE82EF93
#: Bytes hashed at once; a longer single word is hashed on its own.
SEGMENT = 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i (mod 2^64) for i < n."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _tables[base] = (both[0], both[1])
    up, down = _tables[base]
    return up[:n], down[:n]


_owner = ""
_forget: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called by a task when it starts: a worker process serves many tasks, and what another operator has remembered in it goes.

    forget: drops what this owner remembers, when another one claims the process.
    """
    global _owner
    if owner == _owner:
        return
    for other, f in _forget:
        if other != owner:
            f()
    _forget[:] = [(o, f) for o, f in _forget if o == owner]
    _tables.clear()
    _owner = owner
    if forget:
        _forget.append((owner, forget))
    gc.collect()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the machine, where the C library can: idle workers wait beside other operators' tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(f):
    """A function of one group, or of two (as Spark tells them apart by their parameters), after which memory is given back."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        give_back()
        return out

    return two if f.__code__.co_argcount == 2 else one


def lean_stream(f):
    """The same for a function of a partition's batches."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher on uint64 (splitmix64's)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def row_slices(text: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes each (single longer rows stand alone)."""
    off = np.frombuffer(_binary(text).buffers()[1], dtype=np.int64)[text.offset :][: len(text) + 1] if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, min(to, len(text))
        at = min(to, len(text))


def _binary(text: pa.Array) -> pa.Array:
    return text if pa.types.is_large_binary(text.type) else text.cast(pa.large_binary())


def as_array(column) -> pa.Array:
    """One Arrow array of a column of a batch or table."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; starts and ends must not descend."""
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    while at < n:
        lo = int(starts[at])
        to = int(np.searchsorted(ends, lo + SEGMENT, side="right"))
        if to <= at:  # one span longer than a segment
            long = data[lo : ends[at]].tobytes()
            out[at] = int.from_bytes(hashlib.blake2b(long, digest_size=8).digest(), "little")
            at += 1
            continue
        hi = int(ends[to - 1])
        up, down = _powers(_BASE_BYTES, hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


class Words:
    """Words of the rows of a text column: data[start:end] each, in order; row i has words first[i]:first[i+1]."""

    def __init__(self, text: pa.Array, lower: bool = False):
        text = _binary(as_array(text))
        n = len(text)
        if n:
            off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
            lo, hi = int(off[0]), int(off[-1])
            raw = text.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8)[lo:hi] if raw is not None and hi > lo else np.empty(0, np.uint8)
            off = off - lo
            if text.null_count:  # what lies under a null is undefined
                null = np.flatnonzero(text.is_null().to_numpy(zero_copy_only=False))
                if (off[null + 1] > off[null]).any():
                    raise ValueError("bytes under a null")
        else:
            off, data = np.zeros(1, np.int64), np.empty(0, np.uint8)
        self.n_rows, self.offsets = n, off
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = off[(off > 0) & (off < len(data))]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, off)
        self.inside = inside

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.n_rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of k words within a row, in order; short: a row of fewer words, but some, is one window."""
        n = len(hashes)
        counts, sums = self.counts, np.zeros(n + 1, np.uint64)
        up, down = _powers(_BASE_WORDS, n + 1)
        np.cumsum(hashes * up[:n], out=sums[1:])
        last = np.repeat(self.first[1:] - k, counts)  # the last start in each word's row
        starts = np.arange(n)
        starts = starts[starts <= last]
        h = mix((sums[starts + k] - sums[starts]) * down[starts] + np.uint64(k))
        if short:
            rows = np.flatnonzero((counts > 0) & (counts < k))
            s, e = self.first[rows], self.first[rows + 1]
            more = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            order = np.argsort(np.concatenate([starts, s]), kind="stable")
            starts, h = np.concatenate([starts, s])[order], np.concatenate([h, more])[order]
        return starts, h

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each row joined by one space: bytes and row offsets."""
        s, e = self.starts[keep], self.ends[keep]
        kept_rows = np.repeat(np.arange(self.n_rows), self.counts)[keep]
        lengths = e - s
        spaced = np.zeros(len(s), np.int64)  # 1 where a space follows
        spaced[:-1] = kept_rows[1:] == kept_rows[:-1]
        mark = np.zeros(len(self.data) + 2, np.int8)
        mark[s] += 1
        mark[e + spaced] -= 1
        take = np.cumsum(mark[: len(self.data)], dtype=np.int8).astype(bool)
        out = self.data[take]
        out[~self.inside[take]] = 32
        sizes = np.bincount(kept_rows, weights=lengths + spaced, minlength=self.n_rows).astype(np.int64) if len(s) else np.zeros(self.n_rows, np.int64)
        return out, np.concatenate([[0], np.cumsum(sizes)])


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column of these bytes."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
