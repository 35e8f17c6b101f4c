"""Samples of points by image and sign, and centroids of many nodes at once: trees, and a codebook for each sign."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import normalized
from ..session import importable
from .inverted import idf

#: Rows of a batch that a worker compares at once.
ROWS = 2000


# samples


def digest_order(*cols: str) -> Column:
    """The order of a random draw that is the same at every run: by a digest of the columns' text."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in cols]))


def lowest(rows: DataFrame, keys: list[str], n: int, order: Column, salts: int = 16) -> DataFrame:
    """The n rows of each key that come first in ``order``: a bottom-n sketch.

    Each task passes on n rows a key at most (window group limit), first to ``salts`` parts of the key and from there to
    the key, so no task holds a key's rows, however many there are.
    """
    x = rows.withColumn("order_", order).withColumn("salt_", F.pmod(F.xxhash64("order_"), F.lit(salts)))
    for by in ([*keys, "salt_"], keys):
        w = Window.partitionBy(*by).orderBy("order_")
        x = x.withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= n)
    return x.select(*rows.columns)


def sampled_points(points: DataFrame, images: int, per_image: int, per_sign: int, cols: list[str], item: str = "item", sign: str = "sign") -> DataFrame:
    """Points to learn codebooks from: ``images`` images are drawn, then up to ``per_image`` points of each sign from each
    of them, and of these up to ``per_sign`` of each sign. So an image with very many points counts no more than others.

    ``cols`` are the columns whose digest decides which points are drawn; draws are the same at every run.
    """
    drawn = points.select(item).distinct().withColumn("order_", digest_order(item)).orderBy("order_", item).limit(images).select(item)
    x = points.join(F.broadcast(drawn) if images <= 100_000 else drawn, item, "left_semi")
    x = lowest(x, [item, sign], per_image, digest_order(item, sign, *cols))
    # a draw of its own: by the first one's order, images with many points would win
    return lowest(x, [sign], per_sign, F.md5(F.concat(F.lit("codebook:"), digest_order(item, sign, *cols))))


# centroids


@dataclass
class Level:
    """Centres of one depth; those of node i of the depth above are rows first[i] to first[i + 1]."""

    centres: np.ndarray
    first: np.ndarray


def _square_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None], 0)


def below(v: np.ndarray, node: np.ndarray, level: Level) -> np.ndarray:
    """The nearest child of each row's node (ties: the first), or -1 where the node has none."""
    out = np.full(len(v), -1)
    order = np.argsort(node, kind="stable")
    nodes, starts = np.unique(node[order], return_index=True)
    for p, rows in zip(nodes, np.split(order, starts[1:])):
        lo, hi = (level.first[p], level.first[p + 1]) if p >= 0 else (0, 0)
        if hi > lo:
            out[rows] = lo + _square_distances(v[rows], level.centres[lo:hi]).argmin(1)
    return out


def _batches(batches):
    """(node, vectors) of pieces of Arrow batches whose first columns are node and vec."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            b = whole.slice(lo, ROWS)
            yield b, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _down(v: np.ndarray, node: np.ndarray, levels: list[Level]) -> np.ndarray:
    for level in levels:
        node = below(v, node, level)
    return node


def _first_centres(points: DataFrame, levels: list[Level], width: int) -> dict[int, np.ndarray]:
    """For each node below ``levels``, ``width`` of its distinct points: those whose hashes are least. Workers keep no
    more than that of a node, so what is exchanged follows the model's size and the number of tasks."""
    held = points.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        nodes, hashes, vecs = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for b, node, v in _batches(batches):
            nodes, hashes = np.concatenate([nodes, _down(v, node, held.value)]), np.concatenate([hashes, b.column(2).to_numpy()])
            vecs = v if vecs is None else np.concatenate([vecs, v])
            order = np.lexsort((hashes, nodes))
            nodes, hashes, vecs = nodes[order], hashes[order], vecs[order]
            fresh = np.ones(len(nodes), bool)
            fresh[1:] = (nodes[1:] != nodes[:-1]) | (hashes[1:] != hashes[:-1])
            fresh &= nodes >= 0
            nodes, hashes, vecs = nodes[fresh], hashes[fresh], vecs[fresh]
            few = np.arange(len(nodes)) - np.searchsorted(nodes, nodes) < width
            nodes, hashes, vecs = nodes[few], hashes[few], vecs[few]
        if vecs is not None and len(vecs):
            yield _rows(["node_", "hash_", "vec"], nodes, hashes, vecs)

    found = points.select("node_", "vec", F.xxhash64("vec").alias("hash_")).mapInArrow(run, "node_ long, hash_ long, vec array<double>")
    found = lowest(found.dropDuplicates(["node_", "hash_"]), ["node_"], width, F.col("hash_")).toArrow().sort_by([("node_", "ascending"), ("hash_", "ascending")])
    node = found["node_"].to_numpy()
    vecs = found["vec"].combine_chunks().flatten().to_numpy().reshape(len(node), -1) if len(node) else np.zeros((0, 1))
    return {int(p): vecs[node == p] for p in np.unique(node)}


def _rows(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    """A batch of number columns and a last column of vectors."""
    *numbers, vecs = cols
    offsets = pa.array((np.arange(len(vecs) + 1) * vecs.shape[1]).astype(np.int32))
    return pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.ListArray.from_arrays(offsets, pa.array(vecs.ravel()))], names=names)


def _moved(points: DataFrame, levels: list[Level], now: Level) -> np.ndarray:
    """One Lloyd step of all nodes of a depth: the means of the points nearest to each centre; a centre without points
    stays. One job: tasks sum the points of each centre, and one aggregation by centre adds these sums."""
    held = points.sparkSession.sparkContext.broadcast((levels, now))
    dim = now.centres.shape[1]

    def run(batches):
        fixed, level = held.value
        total, count = np.zeros(level.centres.shape), np.zeros(len(level.centres), np.int64)
        for _, node, v in _batches(batches):
            at = below(v, _down(v, node, fixed), level)
            v, at = v[at >= 0], at[at >= 0]
            order = np.argsort(at, kind="stable")
            own, starts = np.unique(at[order], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(v[order], starts)
                count[own] += np.diff(np.append(starts, len(at)))
        own = np.flatnonzero(count)
        for lo in range(0, len(own), ROWS):
            some = own[lo : lo + ROWS]
            yield _rows(["centre", "n", "s"], some, count[some], total[some])

    sums = points.select("node_", "vec").mapInArrow(run, "centre long, n long, s array<double>")
    found = sums.groupBy("centre").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)]).toArrow()
    held.unpersist()
    out = now.centres.copy()
    if found.num_rows:
        out[found["centre"].to_numpy()] = np.stack([found[f"s{i}"].to_numpy() for i in range(dim)], axis=1) / found["n"].to_numpy()[:, None]
    return out


def grown(points: DataFrame, nodes: int, widths: list[int], steps: int = 30, start: list[dict[int, np.ndarray]] | None = None, keep: int = 0, tol: float = 1e-4) -> list[Level]:
    """Centres for points (node_, vec): those of each node 0 to ``nodes`` - 1 are split into widths[0] clusters, each of
    these into widths[1], and so on.

    All nodes of a depth move together, so there are at most (steps + 1) x depths jobs, whatever the number of nodes. A
    depth ends early once no centre moves by ``tol``. ``start`` has centres of nodes to begin with, depth by depth; missing ones
    are drawn, and the first ``keep`` depths stay as they are there. A node with fewer distinct points than clusters has
    one child for each of them. What the driver and each worker hold is the model.
    """
    importable(points.sparkSession)
    points = points.select(F.col("node_").cast("long").alias("node_"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null").persist()
    levels: list[Level] = []
    try:
        for depth, width in enumerate(widths):
            given = start[depth] if start and depth < len(start) else {}
            drawn = {} if depth < keep else _first_centres(points, levels, width)
            own = []
            for p in range(nodes):
                c = given.get(p, np.zeros((0, 0)))[:width]
                more = drawn.get(p, np.zeros((0, 0)))
                if len(c) and len(more):  # of the drawn ones, those that aren't there yet
                    more = more[(more[:, None] != c[None]).any(-1).all(1)]
                parts = [x for x in (c, more[: width - len(c)]) if len(x)]
                own.append(np.concatenate(parts) if parts else np.zeros((0, 0)))
            some = [c for c in own if len(c)]
            if not some:
                break
            now = Level(np.concatenate(some), np.concatenate([[0], np.cumsum([len(c) for c in own])]).astype(np.int64))
            for _ in range(0 if depth < keep else steps):
                after = _moved(points, levels, now)
                still = np.abs(after - now.centres).max() < tol
                now = Level(after, now.first)
                if still:
                    break
            levels.append(now)
            nodes = len(now.centres)
    finally:
        points.unpersist()
    return levels


def _descended(v: np.ndarray, levels: list, children: list, number: dict, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, squared distance) of each row: level by level the distances of all rows to all nodes are one matrix, and
    a row goes on with the children of its ``beam`` nearest nodes. Ties go to the smaller path."""
    open_ = np.zeros((len(v), 1), bool) | True
    names: list[tuple] = [()]
    for level, below_ in zip(levels, children):
        paths = sorted(p for n in names for p in below_.get(n, ()))
        parent = np.array([names.index(p[:-1]) for p in paths])
        c = np.array([level[p] for p in paths])
        d = np.stack([((v - x) ** 2).sum(1) for x in c], axis=1) if len(v) else np.zeros((0, len(c)))
        d[~open_[:, parent]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        open_ = np.zeros(d.shape, bool)
        np.put_along_axis(open_, order, True, axis=1)
        open_ &= np.isfinite(d)
        names = paths
    best = d.argmin(1)
    return np.array([number[p] for p in names])[best], d[np.arange(len(v)), best]


@dataclass
class CentroidTree:
    """Hierarchical centroids: ``levels[i]`` is (path, vec) for the nodes at depth i + 1, a path being its child numbers.

    The tree is a model of fixed size (the product of its widths), so it is broadcast.
    """

    levels: list[dict[tuple, np.ndarray]]

    @property
    def leaves(self) -> list[tuple]:
        return sorted(self.levels[-1])

    def predict(self, points: DataFrame, beam: int = 4, cols: list[str] | None = None) -> DataFrame:
        """Adds label (the number of the nearest leaf found) and distance, descending with the ``beam`` nearest nodes."""
        cols = cols or points.columns
        held = points.sparkSession.sparkContext.broadcast((self.levels, {p: i for i, p in enumerate(self.leaves)}))
        at = cols.index("vec")

        def run(batches):
            levels, number = held.value
            children = []
            for level in levels:
                below_: dict = {}
                for path in sorted(level):
                    below_.setdefault(path[:-1], []).append(path)
                children.append(below_)
            for whole in batches:
                for lo in range(0, whole.num_rows, ROWS):
                    b = whole.slice(lo, ROWS)
                    v = np.array(b.column(at).to_pylist(), np.float64).reshape(b.num_rows, -1)
                    label, distance = _descended(v, levels, children, number, beam)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.int32()), pa.array(distance)], names=[*cols, "label", "distance"])

        schema = points.select(*cols).schema.add("label", T.IntegerType()).add("distance", T.DoubleType())
        return points.select(*cols).mapInArrow(run, schema)

    def as_start(self) -> list[dict[int, np.ndarray]]:
        """Centres by the number of their parent, for ``grown``."""
        out, above = [], [()]
        for level in self.levels:
            number = {p: i for i, p in enumerate(above)}
            by: dict[int, list] = {}
            for path in sorted(level):
                by.setdefault(number[path[:-1]], []).append(level[path])
            out.append({i: np.array(c) for i, c in by.items()})
            above = sorted(level)
        return out


def centroid_tree(points: DataFrame, widths: list[int], steps: int = 30, start: CentroidTree | None = None, keep: int = 0) -> CentroidTree:
    """A tree over the column vec: widths[0] clusters, each of those split into widths[1], and so on (see ``grown``).

    ``start`` is a tree to begin with: its centres move on, but for those of its first ``keep`` depths, and depths that it
    doesn't have are drawn and trained below them.
    """
    levels = grown(points.select(F.lit(0).alias("node_"), "vec"), 1, widths, steps, start.as_start() if start else None, keep)
    paths, out = [()], []
    for level in levels:
        names = [(*p, i) for p, lo, hi in zip(paths, level.first, level.first[1:]) for i in range(hi - lo)]
        out.append(dict(zip(names, level.centres)))
        paths = names
    return CentroidTree(out)


# a codebook for each sign


def signed_codebooks(points: DataFrame, k: int = 32, steps: int = 50, unit: bool = True) -> DataFrame:
    """(sign, label, vec): k centroids of the points (sign 0 or 1, vec) of each sign; both signs move in the same jobs.
    With ``unit``, points are taken at length 1."""
    vec = F.col("vec").cast("array<double>")
    levels = grown(points.select(F.col("sign").alias("node_"), (normalized(vec) if unit else vec).alias("vec")), 2, [k], steps)
    rows = []
    if levels:
        rows = [(s, i - int(levels[0].first[s]), [float(x) for x in levels[0].centres[i]]) for s in (0, 1) for i in range(levels[0].first[s], levels[0].first[s + 1])]
    return points.sparkSession.createDataFrame(rows, "sign int, label int, vec array<double>")


def pooled_weights(counts: DataFrame, half: int) -> DataFrame:
    """(word, n, weight) for all words of both codebooks: those of sign 1 as they are, those of sign 0 ``half`` later.

    ``counts`` (sign, label, n) says how many points took a word; there may be several rows a word, and words that none
    took have 0. Weights are by ``idf`` over the points of both signs together.
    """
    word = F.when(F.col("sign") == 1, F.col("label")).otherwise(F.col("label") + half).cast("long")
    found = counts.groupBy(word.alias("word")).agg(F.sum("n").cast("long").alias("n"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total_"))
    every = counts.sparkSession.range(2 * half).select(F.col("id").alias("word"))
    x = every.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return x.crossJoin(F.broadcast(total)).select("word", "n", idf(F.col("n"), F.col("total_")).alias("weight"))
