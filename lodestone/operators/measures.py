"""How rows of numbers compare, in blocks: a matrix product bounds what may be among the best, and that is scored exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.similarity import LEVEL_ENDS, LEVEL_WEIGHTS

#: A single-precision step, and components beyond which a row isn't compared in single precision.
STEP, LARGEST = 2.0**-23, 1e15


def _halves_up(s: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: of two equally near decimals the one farther from 0."""
    return np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5), s) / 10.0**digits + 0.0


def _errors(dim: int, of: np.ndarray) -> np.ndarray:
    return (dim + 8) * STEP * of


@dataclass(frozen=True)
class Dot:
    """The scalar product, rounded to so many decimals. Also the base of the others, which say how they differ.

    ``prepared`` makes arrays of rows that ``keys`` compares: no key is below its exact value by more than ``floor`` takes
    off. ``floor`` is the key that every item reaches whose score is ``least`` or more; ``exact`` scores rows in pairs.
    """

    digits: int = 12
    type = "array<double>"

    def fits(self, v: Column) -> Column:
        """Whether a row is compared in blocks; others go by the score's expression."""
        return F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < LARGEST)), F.lit(False))

    def prepared(self, x: np.ndarray) -> tuple:
        return x.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", x, x))

    def keys(self, q: tuple, x: tuple) -> np.ndarray:
        return q[0] @ x[0].T

    def floor(self, least: np.ndarray, q: tuple, x: tuple) -> np.ndarray:
        return least - _errors(q[0].shape[1], q[1] * x[1].max(initial=0))

    def exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", q, x)

    def rounded(self, s: np.ndarray) -> np.ndarray:
        return _halves_up(s, self.digits) if self.digits < 9 else np.round(s, self.digits)


@dataclass(frozen=True)
class Residual(Dot):
    """The scalar product, or 0 where that is negative."""

    def floor(self, least, q, x):
        return np.where(least <= 0, -np.inf, super().floor(least, q, x))

    def exact(self, q, x):
        return np.maximum(0.0, super().exact(q, x))


class _Squares:
    """Keys that are squared distances with the sign turned."""

    @staticmethod
    def prepared(x: np.ndarray) -> tuple:
        n2 = np.einsum("ij,ij->i", x, x)
        one = np.ones_like(n2)
        return np.column_stack([2 * x, -one, -n2]).astype(np.float32), np.column_stack([x, n2, one]).astype(np.float32), np.sqrt(n2)

    @staticmethod
    def keys(q: tuple, x: tuple) -> np.ndarray:
        return q[0] @ x[1].T

    @staticmethod
    def errors(q: tuple, x: tuple) -> np.ndarray:
        return _errors(q[0].shape[1], (q[2] + x[2].max(initial=0)) ** 2)

    @staticmethod
    def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        e = x - q
        return np.einsum("ij,ij->i", e, e)


@dataclass(frozen=True)
class Metric(Dot):
    """(most - distance) / most; ``metric_similarity`` has a ``most`` of 2."""

    most: float = 2.0

    def prepared(self, x):
        return _Squares.prepared(x)

    def keys(self, q, x):
        return _Squares.keys(q, x)

    def floor(self, least, q, x):
        return -((self.most * (1 - least)) ** 2) - _Squares.errors(q, x)

    def exact(self, q, x):
        d = np.sqrt(_Squares.exact(q, x))
        return 1 - d / 2 if self.most == 2 else (self.most - d) / self.most


@dataclass(frozen=True)
class Gated(Dot):
    """A blend of the metric over the first ``cut`` numbers and a step: 1 where the metric over the rest is above a
    threshold."""

    cut: int = 48
    threshold: float = 0.7
    weight: float = 0.5

    def prepared(self, x):
        return *_Squares.prepared(x[:, : self.cut]), *_Squares.prepared(x[:, self.cut :])

    def keys(self, q, x):
        near = 1 - np.sqrt(np.maximum(-_Squares.keys(q[:3], x[:3]) - _Squares.errors(q[:3], x[:3])[:, None].astype(np.float32), 0)) / 2
        reach = -((2 * (1 - self.threshold)) ** 2) - _Squares.errors(q[3:], x[3:])
        return (1 - self.weight) * near + self.weight * (_Squares.keys(q[3:], x[3:]) >= reach[:, None].astype(np.float32))

    def floor(self, least, q, x):
        return least - 1e-5 * (1 + np.abs(least))

    def exact(self, q, x):
        near, colour = (1 - np.sqrt(_Squares.exact(q[:, p], x[:, p])) / 2 for p in (slice(self.cut), slice(self.cut, None)))
        return (1 - self.weight) * near + self.weight * np.where(colour > self.threshold, 1.0, 0.0)


@dataclass(frozen=True)
class Nearest(Dot):
    """Two points a row: the nearest of the four distances, through a Gaussian (``major_similarity``)."""

    width: float = 50.0

    def prepared(self, x):
        n = x.shape[1] // 2
        return *_Squares.prepared(x[:, :n]), *_Squares.prepared(x[:, n:])

    def keys(self, q, x):
        best = None
        for a in (q[:3], q[3:]):
            for b in (x[:3], x[3:]):
                k = _Squares.keys(a, b)
                best = k if best is None else np.maximum(best, k, out=best)
        return best

    def floor(self, least, q, x):
        errors = np.maximum.reduce([_Squares.errors(a, b) for a in (q[:3], q[3:]) for b in (x[:3], x[3:])])
        return np.where(least > 0, 2 * self.width**2 * np.log(np.maximum(least, 1e-300)), -np.inf) - errors - 1e-3

    def exact(self, q, x):
        n = x.shape[1] // 2
        halves = (slice(n), slice(n, None))
        d = np.minimum.reduce([_Squares.exact(q[:, a], x[:, b]) for a in halves for b in halves])
        return np.where(d == 0, 1.0, np.exp(-d / (2 * self.width * self.width)))


def _inverse(n: np.ndarray) -> np.ndarray:
    return np.divide(1.0, n, out=np.zeros(n.shape), where=n > 0)


@dataclass(frozen=True)
class Levels(Dot):
    """Cosine of unary codes, from levels 0 to 4 (``level_cosine``)."""

    top: int = 4
    type = "array<int>"

    def fits(self, v):
        return F.coalesce(F.forall(v, lambda x: x.isNotNull() & x.between(0, self.top)), F.lit(False))

    def _code(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :, None] > np.arange(self.top)).astype(np.uint8).reshape(len(x), -1)

    def prepared(self, x):
        return self._code(x), _inverse(np.sqrt(x.sum(1, dtype=np.int64).astype(np.float64))).astype(np.float32)

    def keys(self, q, x):
        return (q[0].astype(np.float32) @ x[0].astype(np.float32).T) * q[1][:, None] * x[1]

    def floor(self, least, q, x):
        return least - 1e-5

    def exact(self, q, x):
        size = np.sqrt(q.sum(1, dtype=np.int64).astype(np.float64)) * np.sqrt(x.sum(1, dtype=np.int64).astype(np.float64))
        return np.divide(np.minimum(q, x).sum(1, dtype=np.int64).astype(np.float64), size, out=np.zeros(len(q)), where=size > 0)


@dataclass(frozen=True)
class Bits(Levels):
    """Cosine of bitmaps in blocks of 64 (``bit_cosine``)."""

    type = "array<bigint>"

    def fits(self, v):
        return F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False))

    def _bits(self, x: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1)

    def prepared(self, x):
        b = self._bits(x)
        return b, _inverse(np.sqrt(b.sum(1, dtype=np.int64).astype(np.float64))).astype(np.float32)

    def exact(self, q, x):
        return super().exact(self._bits(q), self._bits(x))


@dataclass(frozen=True)
class Pyramid(Levels):
    """The weighted sum of such cosines over the levels of a pyramid (``pyramid_cosine``)."""

    per_cell: int = 64

    def _sizes(self, x: np.ndarray) -> np.ndarray:
        """The norms of the levels."""
        return np.sqrt(np.column_stack([x[:, : end * self.per_cell].sum(1, dtype=np.int64) for end in LEVEL_ENDS]).astype(np.float64))

    def prepared(self, x):
        return self._code(x), _inverse(self._sizes(x)).astype(np.float32)

    def keys(self, q, x):
        both, score, start = None, None, 0
        for i, (weight, end) in enumerate(zip(LEVEL_WEIGHTS, LEVEL_ENDS)):
            at = slice(start * self.per_cell * self.top, end * self.per_cell * self.top)
            own = q[0][:, at].astype(np.float32) @ x[0][:, at].astype(np.float32).T
            both = own if both is None else np.add(both, own, out=both)
            part = both * (weight * q[1][:, i, None]) * x[1][:, i]
            score = part if score is None else np.add(score, part, out=score)
            start = end
        return score

    def exact(self, q, x):
        least, size, score = np.minimum(q, x), self._sizes(q) * self._sizes(x), np.zeros(len(q))
        for i, (weight, end) in enumerate(zip(LEVEL_WEIGHTS, LEVEL_ENDS)):
            both = least[:, : end * self.per_cell].sum(1, dtype=np.int64).astype(np.float64)
            score = score + weight * np.divide(both, size[:, i], out=np.zeros(len(q)), where=size[:, i] > 0)
        return score


class Best:
    """The k best items of each of a block's queries so far: ids and scores in arrays of k columns, best first."""

    #: Keys that are held at once, numbers of rows that are scored exactly at once, and what rounding may add to a score.
    TILE, NUMBERS, SLACK = 1 << 20, 1 << 22, 1.01e-6

    def __init__(self, measure: Dot, queries: np.ndarray, k: int):
        self.measure, self.q, self.k = measure, queries, k
        self.asked = measure.prepared(queries)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.value = np.full((len(queries), k), -np.inf)
        self.high = max(1, min(1024, len(queries)))
        self.waiting: dict[int, list] = {}
        self.wide = max(64, min(4096, self.TILE // self.high))

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(x), self.wide):
            own, own_ids = x[at : at + self.wide], ids[at : at + self.wide]
            items = self.measure.prepared(own)
            for lo in range(0, len(self.q), self.high):
                self._meet(lo, min(lo + self.high, len(self.q)), own_ids, own, items)

    def _scores(self, row: np.ndarray, col: np.ndarray, x: np.ndarray) -> np.ndarray:
        step = max(1, self.NUMBERS // x.shape[1]) if x.shape[1] else len(row) or 1
        parts = [self.measure.rounded(self.measure.exact(self.q[row[i : i + step]], x[col[i : i + step]])) for i in range(0, len(row), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _meet(self, lo: int, hi: int, ids: np.ndarray, x: np.ndarray, items: tuple) -> None:
        asked = tuple(a[lo:hi] for a in self.asked)
        keys = self.measure.keys(asked, items)
        least = self.value[lo:hi, -1]
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and len(ids) > self.k:  # what any k items reach bounds the k best
            some = np.argpartition(keys[new], len(ids) - self.k, axis=1)[:, len(ids) - self.k :]
            least = least.copy()
            least[new] = self._scores(np.repeat(lo + new, self.k), some.ravel(), x).reshape(len(new), self.k).min(1)
        need = self.measure.floor(least - self.SLACK, asked, items)
        bound = np.nextafter(need.astype(np.float32), np.float32(-np.inf))
        some = np.flatnonzero(keys.max(1) >= bound)
        if not len(some):
            return
        row, col = np.divmod(np.flatnonzero(keys[some] >= bound[some, None]), len(ids))
        row = lo + some[row]
        value, own = self._scores(row, col, x), ids[col]
        last, last_id = self.value[row, -1], self.id[row, -1]
        better = (value > last) | ((value == last) & (own < last_id))
        waiting = self.waiting.setdefault(lo, [])
        waiting.append((row[better], value[better], own[better]))
        if sum(len(r) for r, _, _ in waiting) >= self.k * (hi - lo):
            self._merge(lo)

    def _merge(self, lo: int) -> None:
        """Puts what waits for the queries from ``lo`` on among their best. Until then older, lower bounds let more pass, so
        a query's best are sorted anew once for some k finds, not for each."""
        row, value, own = (np.concatenate(c) for c in zip(*self.waiting.pop(lo)))
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, self.k), row])
        value, own = np.concatenate([self.value[touched].ravel(), value]), np.concatenate([self.id[touched].ravel(), own])
        order = np.lexsort((own, -value, (row - lo).astype(np.int16)))  # at most 1024 rows: short numbers sort fast
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.value[touched], self.id[touched] = value[order].reshape(-1, self.k), own[order].reshape(-1, self.k)

    def columns(self, query_ids: np.ndarray) -> dict[str, np.ndarray]:
        for lo in list(self.waiting):
            self._merge(lo)
        row, col = np.nonzero(~np.isneginf(self.value))
        return {"query_id": query_ids[row], "item_id": self.id[row, col], "similarity": self.value[row, col]}
