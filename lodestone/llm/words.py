"""Words of many texts at once, with NumPy: no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed random odd base and byte values of the polynomial word hash; made from a seed, the same everywhere.
_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(_RNG.integers(0, 2**64, dtype=np.uint64) | np.uint64(5))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Texts are hashed in pieces of about this many bytes, so memory doesn't follow the batch.
PIECE = 600_000


def mix(x: np.ndarray) -> np.ndarray:
    """A finisher: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    for shift in range(max(n - 1, 1).bit_length()):  # doubling: out[2^k : 2^(k+1)] = out[: 2^k] * base^(2^k)
        at = 1 << shift
        if at < n:
            out[at : 2 * at] = out[: min(at, n - at)] * np.uint64(pow(int(_BASE), at, 1 << 64))
    return out


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


_POW = _powers(1 << 16)
_INV_BASE = _inverse(_BASE)


def _inverse_powers(n: int) -> np.ndarray:
    global _INV
    if len(_INV) < n:
        out = np.ones(1 << (n - 1).bit_length(), np.uint64)
        at = 1
        while at < len(out):
            out[at : 2 * at] = out[:at] * np.uint64(pow(int(_INV_BASE), at, 1 << 64))
            at *= 2
        _INV = out
    return _INV[:n]


def _base_powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        _POW = _powers(1 << (n - 1).bit_length())
    return _POW[:n]


_INV = np.ones(1, np.uint64)


def pieces(texts: list[bytes]):
    """Runs of texts of about PIECE bytes; a longer text is a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > PIECE:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def slices(batches, rows: int = 1000, column: int | None = None, most: int = 4_000_000):
    """Arrow batches cut into smaller ones, so what a worker holds follows neither the batch nor the partition: of
    ``rows`` rows and, by the lengths of a text ``column``, of about ``most`` bytes or one row."""
    for b in batches:
        ends = np.arange(rows, b.num_rows + rows, rows)
        if column is not None and b.num_rows:
            size = pc.binary_length(b.column(column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // most
            ends = np.union1d(ends, np.flatnonzero(np.diff(part)) + 1)
        lo = 0
        for hi in ends:
            if lo < b.num_rows:
                yield b.slice(lo, int(hi) - lo)
            lo = int(hi)


class Words:
    """The words of some texts: ``hash`` of each, ``doc`` (index of its text), ``start`` and ``end`` in ``raw``."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        self.raw = raw
        gap = _SPACE[raw]
        edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.per_doc = np.bincount(self.doc, minlength=len(texts))
        value = _BYTE[_LOWER[raw] if lower else raw]
        value[gap] = 0
        total = np.cumsum(value * _base_powers(len(raw)), dtype=np.uint64)
        before = np.where(self.start > 0, total[self.start - 1], np.uint64(0)) if len(self.start) else np.zeros(0, np.uint64)
        own = total[self.end - 1] - before if len(self.start) else before
        self.hash = mix(own * _inverse_powers(len(raw))[self.start] + (self.end - self.start).astype(np.uint64)) if len(self.start) else before


def shingle_sets(texts: list[bytes], k: int = 5):
    """For each text its sorted distinct k-word shingle hashes; a shorter text is one shingle, one without words none."""
    for lo, hi in pieces(texts):
        w = Words(texts[lo:hi])
        h, n = w.hash, len(w.hash)
        roll = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            roll[: n - j] = mix(roll[: n - j] * np.uint64(31) + h[j:] + np.uint64(j + 1))
        first = np.cumsum(w.per_doc) - w.per_doc
        for d in range(hi - lo):
            a, c = int(first[d]), int(w.per_doc[d])
            if c == 0:
                yield np.zeros(0, np.uint64)
            elif c < k:
                x = c
                for v in h[a : a + c]:
                    x = int(mix(np.array([(x * 33 + int(v)) & (1 << 64) - 1], np.uint64))[0])
                yield np.array([x], np.uint64)
            else:
                yield np.unique(roll[a : a + c - k + 1])
