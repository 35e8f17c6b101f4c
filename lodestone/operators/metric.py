"""A learned projection: neighbours and gradients are found where the items are; the driver holds the matrix alone."""

from __future__ import annotations

import os
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import normalized
from ..session import delete, importable, shared_dir

#: Rows of a block of items, at most and (where cores would idle) at least; rows of a block compared at a time.
ROWS, FEW, SLICE = 4096, 512, 512
#: Pairs that a block's search passes on for each of its items, of a kind and on average, before it narrows what it looks for.
HELD = 64


def sampled(rows: DataFrame, n: int, key: str = "item") -> DataFrame:
    """At most n rows, the same at every run: those with the smallest hashes of their columns. A threshold on the hash
    leaves few more than n before they are ordered."""
    total, h = rows.count(), F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 31))
    if total > 2 * n:
        rows = rows.where(h < int(1.5 * n / total * (1 << 31)))
    return rows.orderBy(h, key).limit(n)


def pca_matrix(items: DataFrame, dims: int) -> np.ndarray:
    """The first principal directions of the column vector, one per row."""
    x = items.select(array_to_vector(F.col("vector").cast("array<double>")).alias("f_"))
    return np.array(PCA(k=dims, inputCol="f_", outputCol="p_").fit(x).pc.toArray()).T


class _Block(NamedTuple):
    """A file of items in the shared folder: their ids, classes and vectors, by class and id."""

    path: str
    rows: int

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.memmap(self.path, np.int64, "r")
        return data[: self.rows], data[self.rows : 2 * self.rows], data[2 * self.rows :].view(np.float64).reshape(self.rows, -1)


def _written(items: DataFrame, path: str) -> tuple[list[_Block], float]:
    """All items as blocks that each task can map, and the length of the longest vector. A task that is run again writes
    another file; only those of which a row tells are read."""
    cores, n = items.sparkSession.sparkContext.defaultParallelism, items.count()
    parts = max(-(-n // ROWS), min(2 * cores, -(-n // FEW)), 1)

    def write(t: pa.Table) -> pa.Table:
        t, file = t.sort_by([("label", "ascending"), ("item_id", "ascending")]), f"{path}/{uuid.uuid4().hex}"
        x = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        os.makedirs(path, exist_ok=True)
        with open(file, "wb") as f:
            for part in (t["item_id"].to_numpy(), t["label"].to_numpy(), x):
                f.write(np.ascontiguousarray(part).tobytes())
        return pa.table({"path": [file], "rows": pa.array([t.num_rows], pa.int64()), "far": [float(np.sqrt((x * x).sum(1).max()))]})

    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(parts))).groupBy("block").applyInArrow(write, "path string, rows long, far double").collect()
    return [_Block(r.path, r.rows) for r in blocks], max((r.far for r in blocks), default=0.0)


class _Pairs:
    """Pairs of one kind, an item of a block and a neighbour in any: q, the block of the neighbour (in order), its place
    there, and the distance; with the ``k`` least distances of each q so far."""

    def __init__(self, rows: int, k: int):
        self.k, self.best, self.new = k, np.full((rows, k), np.inf), []
        self.all = [np.empty(0, np.int32)] * 3 + [np.empty(0, np.float32)]

    def add(self, q: np.ndarray, two: int, col: np.ndarray, d: np.ndarray) -> None:
        self.new.append((q.astype(np.int32), np.full(len(q), two, np.int32), col.astype(np.int32), d))

    def settle(self) -> int:
        """Takes in what was added and tells how many pairs there are."""
        if self.new:
            new = [np.concatenate(c) for c in zip(*self.new)]
            rows = np.unique(new[0])
            q, d = np.concatenate([np.repeat(rows, self.k), new[0]]), np.concatenate([self.best[rows].ravel(), new[3]])
            self.best[rows] = d[_first(q, d, np.zeros(len(q)), self.k)].reshape(len(rows), self.k)
            self.all, self.new = [np.concatenate(c) for c in zip(self.all, new)], []
        return len(self.all[0])

    def keep(self, which: np.ndarray) -> None:
        self.all = [c[which] for c in self.all]


def _first(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of each q's k least distances, of equal ones those of the least ids; q by q and in order."""
    order = np.lexsort((ids, d, q))
    starts = np.flatnonzero(np.diff(q[order], prepend=-1))
    place = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
    return order[place < k]


def _differences(x: np.ndarray, blocks: list[_Block], q: np.ndarray, two: np.ndarray, col: np.ndarray):
    """For pairs in the order of their second blocks: which of them, the differences of their vectors, the neighbours' ids."""
    starts = np.flatnonzero(np.diff(two, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(two)]):
        ids, _, y = blocks[two[start]].read()
        for at in range(start, end, 1 << 15):
            own = slice(at, min(end, at + (1 << 15)))
            yield own, x[q[own]] - y[col[own]], ids[col[own]]


def _measured(x: np.ndarray, blocks: list[_Block], matrix: np.ndarray, q: np.ndarray, two: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, ids = np.empty(len(q)), np.empty(len(q), np.int64)
    for own, e, i in _differences(x, blocks, q, two, col):
        d[own], ids[own] = ((e @ matrix.T) ** 2).sum(1), i
    return d, ids


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(d, 0))


def _places(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix with few ones, eight of its cells at a time."""
    flat = which.ravel()
    words = flat[: len(flat) // 8 * 8].view(np.uint64)
    at = np.append(np.add.outer(np.flatnonzero(words) * 8, np.arange(8)).ravel(), np.arange(len(words) * 8, len(flat)))
    return np.divmod(at[flat[at]], which.shape[1])


def _near(one: int, blocks: list[_Block], matrix: np.ndarray, k: int, others: int, margin: float, room: float, error: float, held: int) -> tuple[float, _Pairs, _Pairs]:
    """For each item of a block all of its class (other ids) no farther than the k-th nearest of them and ``room``, and all
    of other classes no farther than the nearest ``others`` (or what comes within the margin) and ``room``.

    Products are taken in single precision; ``error`` is how far a distance may be off, and that much more is kept. Where
    more than ``held`` an item lie in the room it is made smaller, down to none; then the nearest alone are kept, measured in double
    precision. Returns the room that was kept.
    """
    ids_a, y_a, x = blocks[one].read()
    z = (x @ matrix.T).astype(np.float32)
    left = np.hstack([-2 * z, (z * z).sum(1)[:, None], np.ones((len(z), 1), np.float32)])
    friends, foes = _Pairs(len(x), k), _Pairs(len(x), others)

    def reach() -> tuple[np.ndarray, np.ndarray]:
        f = np.sqrt(friends.best[:, -1])
        return f, np.minimum(np.sqrt(foes.best[:, -1]), np.sqrt(f * f + margin))

    def squared(d: np.ndarray) -> np.ndarray:
        return np.minimum((d + room + 2 * error) ** 2, np.finfo(np.float32).max).astype(np.float32)

    for two, block in enumerate(blocks):
        ids_b, y_b, y = block.read()
        w = (y @ matrix.T).astype(np.float32)
        right = np.hstack([w, np.ones((len(w), 1), np.float32), (w * w).sum(1)[:, None]]).T
        f, o = reach()
        for at in range(0, len(x), SLICE):
            d = left[at : at + SLICE] @ right  # of squares; rounding may leave some just below nought
            own = y_a[at : at + len(d)]
            runs = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for r, s in zip(runs, runs[1:]):
                start, end = (np.searchsorted(y_b, own[r], side) for side in ("left", "right"))
                if start == end:
                    continue
                same = d[r:s, start:end]
                if two == one:
                    same[ids_a[at + r : at + s, None] == ids_b[None, start:end]] = np.inf
                most = f[at + r : at + s]
                if end - start > k and np.isinf(most).any():
                    most = np.minimum(most, _root(np.partition(same, k - 1, axis=1)[:, k - 1]))
                row, col = _places(same <= squared(most)[:, None])
                friends.add(row + at + r, two, col + start, np.maximum(same[row, col], 0))
                same[:] = np.inf
            most = o[at : at + len(d)]
            if d.shape[1] > others and np.isinf(most).any():
                most = np.minimum(most, _root(np.partition(d, others - 1, axis=1)[:, others - 1]))
            row, col = _places(d <= squared(most)[:, None])
            foes.add(row + at, two, col, np.maximum(d[row, col], 0))
        friends.settle(), foes.settle()
        while (last := two == len(blocks) - 1) or max(len(friends.all[0]), len(foes.all[0])) > held * len(x):
            f, o = reach()
            if last:  # with fewer friends than k all are near, and the farthest of them tells who is pushed; without any, none is
                most = np.where(np.isfinite(friends.best), friends.best, -np.inf).max(1)
                o = np.where(most < 0, -np.inf, np.minimum(o, np.sqrt(np.maximum(most, 0) + margin)))
            for pairs, most in ((friends, f), (foes, o)):
                pairs.keep(pairs.all[3] <= np.where(most < 0, -1, squared(most))[pairs.all[0]])
            if max(len(friends.all[0]), len(foes.all[0])) <= held * len(x):
                break
            if room > 0:
                room = room / 2 if room > error else 0.0
                continue
            for pairs in (friends, foes):
                d, ids = _measured(x, blocks, matrix, *pairs.all[:3])
                pairs.keep(np.sort(_first(pairs.all[0], d, ids, pairs.k)))
            break
    return room, friends, foes


def _found(spark: SparkSession, blocks: list[_Block], *how) -> DataFrame:
    """(one, room, friends, foes): what ``_near`` finds for each block."""

    def run(batches):
        for batch in batches:
            for one in batch["id"].to_pylist():
                room, *pairs = _near(one, blocks, *how)
                yield pa.RecordBatch.from_pydict({"one": pa.array([one], pa.int64()), "room": [room]} | {name: pa.array([np.stack(p.all[:3]).tobytes()], pa.binary()) for name, p in zip(("friends", "foes"), pairs)})

    return spark.range(0, len(blocks), 1, len(blocks)).mapInArrow(run, "one long, room double, friends binary, foes binary")


def _scatter(found: DataFrame, blocks: list[_Block], matrix: np.ndarray, k: int, others: int, margin: float, pull: float, push: float) -> tuple[np.ndarray, float]:
    """The sum over linked items of (x - y)(x - y)', times ``pull`` for friends and -``push`` for others: a matrix of each
    task, added up in two steps where they are many. And the mean distance of an item's farthest friend."""
    dim = matrix.shape[1]

    def run(batches):
        total, far = np.zeros((dim, dim)), np.zeros(2)
        for batch in batches:
            for r in batch.to_pylist():
                x = blocks[r["one"]].read()[2]
                reach = np.full(len(x), -np.inf)
                for name, most, weight in (("friends", k, pull), ("foes", others, -push)):
                    pairs = np.frombuffer(r[name], np.int32).reshape(3, -1)
                    d, ids = _measured(x, blocks, matrix, *pairs)
                    own = np.sort(_first(pairs[0], d, ids, most))
                    if name == "friends":
                        np.maximum.at(reach, pairs[0][own], d[own])
                    else:
                        own = own[d[own] < reach[pairs[0][own]] + margin]
                    for _, e, _ in _differences(x, blocks, *pairs[:, own]):
                        total += weight * (e.T @ e)
                far += np.sqrt(reach[reach >= 0]).sum(), (reach >= 0).sum()
        yield pa.RecordBatch.from_pydict({"s": pa.array([np.append(total, far).tobytes()], pa.binary())})

    def added(t: pa.Table) -> pa.Table:
        return pa.table({"s": pa.array([sum(np.frombuffer(s, np.float64) for s in t["s"].to_pylist()).tobytes()], pa.binary())})

    parts = found.select("one", "friends", "foes").mapInArrow(run, "s binary")
    if len(blocks) * dim * dim > 1 << 21:  # else few numbers, and an exchange a step would cost more
        parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(8))).groupBy("part").applyInArrow(added, "s binary")
    total = sum(np.frombuffer(s, np.float64) for s in parts.toArrow()["s"].to_pylist())
    return total[:-2].reshape(dim, dim), total[-2] / max(total[-1], 1)


def fit_metric(items: DataFrame, dims: int, k: int = 3, others: int = 3, margin: float = 0.05, pull: float = 0.3, push: float = 0.45, rate: float = 0.1, steps: int = 50) -> np.ndarray:
    """A projection that draws items of a class together and holds other classes off.

    Starts from the principal directions. In each step every item is drawn to its k nearest of its own class and pushed
    from the nearest ``others`` of different classes that come within ``margin`` of those; the matrix follows the mean
    gradient. It learns from all items; those without a vector or a label are left out.

    No item reaches the driver: items lie as files in the shared folder, which tasks map. All items meet all others in the
    first step, and then only when the matrix has moved so far that others may have come near: a distance changes by no
    more than the length of the matrix's move times that of the difference, which is at most twice the longest vector's.
    A search keeps what lies within twice that room of the nearest, so until it is used up the steps choose among those.
    """
    spark = items.sparkSession
    importable(spark)
    x = items.where("vector is not null and label is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("vector").cast("array<double>").alias("vector"), F.xxhash64("label").alias("label"))
    matrix = pca_matrix(items, dims)
    folder = f"{shared_dir(spark)}/metric-{uuid.uuid4().hex}"
    found, sought, left, room = None, matrix, -1.0, 0.0
    try:
        blocks, far = _written(x, folder.removeprefix("file://").removeprefix("file:"))
        n = sum(b.rows for b in blocks)
        for step in range(steps if n else 0):
            if 4 * far * np.linalg.norm(matrix - sought, 2) > left:
                if found is not None:
                    found.unpersist()
                # distances in units of the longest that there can be, so that single precision holds them
                sought, unit = matrix, np.linalg.norm(matrix, 2) * far or 1.0
                error = np.sqrt((dims + 8) * 2.0**-21)
                found = _found(spark, blocks, matrix / unit, k, others, margin / unit**2, room / unit, error, HELD).persist()
                left = found.agg(F.min("room")).first()[0] * unit
            s, typical = _scatter(found, blocks, matrix, k, others, margin, pull, push)
            move = -rate * (matrix @ s) / n
            matrix = matrix + move
            # what the steps to come would use at this one's pace, as long as some eight times the nearest lie in it
            room = min(5 * far * np.linalg.norm(move, 2) * (steps - step - 1), typical * (8 ** (1 / dims) - 1))
    finally:
        if found is not None:
            found.unpersist()
        delete(spark, folder)
    return matrix


def projected(items: DataFrame, matrix: np.ndarray) -> DataFrame:
    """The column vector through the matrix, at length 1. The matrix, a model of fixed size, travels as a literal."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])
    dot = lambda r, v: F.aggregate(F.zip_with(r, v, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return items.withColumn("vector", normalized(F.transform(rows, lambda r: dot(r, F.col("vector")))))
