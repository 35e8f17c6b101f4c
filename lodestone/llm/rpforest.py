"""Near-duplicate vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch, by_hash, join_hot, small, trimmed
from .components import by_id, components, numbered

#: Vectors that fit the trees of one dimension at most, and the bytes that they may take; sample points that a fitted
#: leaf keeps at least; dimensions, the commonest ones, that get a forest. Vectors of any other dimension are one leaf.
SAMPLE, SAMPLE_BYTES, LEAST, FORESTS = 16_384, 64 << 20, 16, 64

#: Random directions that a node tries; levels beyond those of even halves; the share of a node's pairs that its halves
#: may leave to compare, or it stays whole.
TRIES, MORE, WORTH = 4, 2, 0.9


def unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in double precision, and which rows have a direction at all."""
    dim = len(vectors[0]) if len(vectors) else 0
    x = np.array(vectors, np.float64).reshape(len(vectors), dim)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    x[~ok] = 0
    x /= np.maximum(np.abs(x).max(1, initial=0), np.finfo(np.float64).tiny)[:, None]
    x /= np.maximum(np.sqrt((x * x).sum(1)), np.finfo(np.float64).tiny)[:, None]
    return x, ok


def _cheapest(p: np.ndarray, spill: float, reach: float) -> tuple[float, float, float]:
    """(cost, cut, margin): the cut of projections that leaves the fewest pairs inside the halves, as a share of all."""
    p = np.sort(p)
    margin = max(spill * float(p.std()), reach)
    cuts = p[np.unique((np.linspace(0.05, 0.95, 61) * (len(p) - 1)).round().astype(int))]
    left, right = np.searchsorted(p, cuts + margin), len(p) - np.searchsorted(p, cuts - margin)
    cost = (left / len(p)) ** 2 + (right / len(p)) ** 2
    i = int(cost.argmin())
    return float(cost[i]), float(cuts[i]), margin


class Forest:
    """Trees fitted to a bounded sample: each node splits by a random projection where the halves cost least to compare.

    A row within the margin of a split goes to both sides. The margin is ``spill`` standard deviations, and at least half
    of what the link distance is on a random direction. A node that no split makes much cheaper with that margin is a
    dense group: it stays whole, as a leaf of any size. Below the fitted leaves, ``extra`` levels go on splitting by
    directions common to a tree at each leaf's own cuts, so the depth follows the number of rows and not the size of the
    sample. A cut at infinity sends all rows left.
    """

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf: int, spill: float, least: float, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf))))
        self.dim, self.trees = sample.shape[1], trees
        self.depth = min(depth + MORE if depth else 0, max(0, int(np.log2(max(len(sample), 1) / LEAST))))
        nodes, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.dirs, self.cut, self.margin = np.zeros((trees, nodes, self.dim)), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
        self.dense = np.zeros((trees, leaves), bool)
        reach, per = 0.5 * float(np.sqrt(2 * (1 - least) / self.dim)), rows / max(len(sample), 1)
        fitted = []
        for t in range(trees):
            groups = [(np.arange(len(sample)), False)]
            for node in range(nodes):
                at, dense = groups[node]
                if not dense and len(at) * per > leaf and len(at) > 1:
                    r = rng.normal(size=(TRIES, self.dim))
                    r /= np.linalg.norm(r, axis=1)[:, None]
                    p = sample[at] @ r.T
                    found = [(*_cheapest(p[:, i], spill, reach), i) for i in range(TRIES)]
                    cost, cut, margin, i = min(found)
                    if cost <= WORTH:
                        self.dirs[t, node], self.cut[t, node], self.margin[t, node] = r[i], cut, margin
                        groups += [(at[p[:, i] < cut + margin], False), (at[p[:, i] >= cut - margin], False)]
                        continue
                    dense = True
                groups += [(at, dense), (at[:0], False)]
            fitted.append(groups[nodes:])
        need = [[0 if dense else int(np.ceil(np.log2(max(len(at) * per / leaf, 1)))) for at, dense in g] for g in fitted]
        self.extra = min(max(map(max, need)), 24)
        self.more = rng.normal(size=(trees, self.extra, self.dim))
        self.more /= np.linalg.norm(self.more, axis=2, keepdims=True)
        self.more_cut, self.more_margin = np.full((trees, leaves, self.extra), np.inf), np.zeros((trees, leaves, self.extra))
        for t in range(trees):
            for k, (at, dense) in enumerate(fitted[t]):
                for level in range(min(need[t][k], self.extra) if len(at) > 1 else 0):
                    cost, cut, margin = _cheapest(sample[at] @ self.more[t, level], spill, reach)
                    if cost <= WORTH:
                        self.more_cut[t, k, level], self.more_margin[t, k, level] = cut, margin
                self.dense[t, k] = dense or need[t][k] > 0 and not np.isfinite(self.more_cut[t, k]).any()

    @staticmethod
    def _split(row, at, p, cut, margin):
        left, right = p < cut + margin, p >= cut - margin
        return np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, dense) for every leaf of every tree that a row reaches; leaf numbers differ between trees."""
        rows, found, dense = [], [], []
        for t in range(self.trees):
            row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = at + (1 << level) - 1
                p = np.einsum("ij,ij->i", x[row], self.dirs[t, node])
                row, at = self._split(row, at, p, self.cut[t, node], self.margin[t, node])
            base = at
            for level in range(self.extra):
                p = x[row] @ self.more[t, level]
                left, right = p < self.more_cut[t, base, level] + self.more_margin[t, base, level], p >= self.more_cut[t, base, level] - self.more_margin[t, base, level]
                row, base = np.concatenate([row[left], row[right]]), np.concatenate([base[left], base[right]])
                at = np.concatenate([2 * at[left], 2 * at[right] + 1])
            rows.append(row)
            found.append(at + (t << 56))
            dense.append(self.dense[t, base])
        return np.concatenate(rows), np.concatenate(found), np.concatenate(dense)


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _assigned(reps: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """Adds to each vector its leaves (own_, sorted) and a mark for each: the vector's first dense leaf in its dense leaves,
    in others the leaf itself. Vectors of a dimension without a forest have the leaf 0."""
    held = reps.sparkSession.sparkContext.broadcast(forests)

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                n, forest = part.num_rows, held.value.get(int(dim))
                if forest is None:
                    leaf, mark, ends = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n + 1)
                else:
                    x, _ = unit(_vectors(part.column(3)))
                    row, leaf, dense = forest.leaves(x)
                    order = np.lexsort((leaf, row))
                    row, leaf, dense = row[order], leaf[order], dense[order]
                    ends = np.searchsorted(row, np.arange(n + 1))
                    first = np.full(n, np.iinfo(np.int64).max)
                    np.minimum.at(first, row[dense], leaf[dense])
                    mark = np.where(dense, first[row], leaf)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(leaf, ends), _lists(mark, ends)], names=[*part.schema.names, "own_", "marks_"])

    x = reps.select("node_", "times_", "dim_", "embedding")
    return x.mapInArrow(trimmed(run), f"{x._jdf.schema().toDDL()}, own_ array<long>, marks_ array<long>")


def _shared(own: pa.Array, leaf: int) -> np.ndarray:
    """A column for each leaf before ``leaf`` that at least two of the rows are in: 1 in those rows."""
    row, value = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False)), own.flatten().to_numpy(zero_copy_only=False)
    early = value < leaf
    ids, at, times = np.unique(value[early], return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    both = times[at] > 1
    inside = np.zeros((len(own), int((times > 1).sum())), np.float32)
    inside[row[early][both], column[at[both]]] = 1
    return inside


def _compare(least: float, step: int = 512):
    """Compares the vectors of one cell: a whole leaf, or two blocks of a large one.

    Returns per vector the copies of others that it links with and a member of its own cluster in the cell. A pair
    that shares several leaves is counted in the first of them alone. Products are taken for ``step`` rows at a time.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, times = t["node_"].to_numpy(), t["times_"].to_numpy().astype(np.float64)
        leaf, apart, block = int(t["leaf_"][0].as_py()), t["one_"][0].as_py() != t["two_"][0].as_py(), t["block_"].to_numpy()
        x, _ = unit(_vectors(t["embedding"].combine_chunks()))
        link = np.zeros((len(x), len(x)), bool)
        for lo in range(0, len(x), step):
            link[lo : lo + step] = x[lo : lo + step] @ x.T >= least
            if apart:
                link[lo : lo + step] &= block[lo : lo + step, None] != block[None, :]
        np.fill_diagonal(link, False)
        some = np.flatnonzero(link.any(1))
        link = link[np.ix_(some, some)] if len(some) < len(x) else link
        inside = _shared(t["own_"].combine_chunks().take(pa.array(some)), leaf)
        n = np.zeros(len(some), np.int64)
        for lo in range(0, len(some), step):
            fresh = link[lo : lo + step]
            if inside.shape[1]:
                fresh = fresh & ~(inside[lo : lo + step] @ inside.T > 0)
            n[lo : lo + step] = (fresh @ times[some]).round()
        root = np.arange(len(some), dtype=np.int32)
        while len(some):
            new = root.copy()
            for lo in range(0, len(some), step):
                least_ = np.where(link[lo : lo + step], root[None, :], np.int32(len(some))).min(1)
                new[lo : lo + step] = np.minimum(root[lo : lo + step], least_)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.table({"node_": node[some], "n_": n, "root_": node[some][root]})

    return run


def _fitted(reps: DataFrame, trees: int, leaf: int, spill: float, least: float) -> dict[int, Forest]:
    """A forest for each of the commonest dimensions with more vectors than a leaf takes."""
    out = {}
    for dim, rows in reps.groupBy("dim_").count().where(F.col("count") > leaf).orderBy(F.desc("count"), "dim_").limit(FORESTS).collect():
        most = max(1024, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        sample = by_hash(reps.where(F.col("dim_") == dim), most, "a_", "b_").select("embedding").toArrow()["embedding"].combine_chunks()
        out[dim] = Forest(unit(_vectors(sample))[0], rows, trees, leaf, spill, least)
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, trees: int = 3, leaf: int = 512, spill: float = 0.08, block: int = 4096) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept.

    Equal vectors are collapsed to one with a count. For each dimension, a forest fitted to at most SAMPLE vectors
    (smallest hashes of the vector) sends every vector to its leaves; vectors of a leaf are compared, in double
    precision, and all pairs at ``least`` or more link. Leaves give counts and one edge per vector, never pairs. A leaf
    beyond ``block`` vectors is compared in pairs of blocks, each a group of its own. Links that no tree brings together
    are missed; none is false. Vectors of different dimensions never link.

    Null vectors and those with a null or non-finite component or of length zero link with nothing. Ids may be any
    64-bit numbers. A null id has a null component_id unless it reaches an id; rows that repeat an id share its links.
    Extra columns are ignored. An empty table gives an empty one.
    """
    work = Scratch(vectors.sparkSession)
    of = vectors.schema[vec_col].dataType
    vec = F.col(vec_col) if getattr(of, "elementType", None) == FloatType() else F.col(vec_col).cast("array<double>")
    usable = vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), vec).alias("embedding"))
    rows = rows.withColumn("a_", F.xxhash64("embedding")).withColumn("b_", F.xxhash64(F.lit("vector"), "embedding"))
    reps = rows.where(F.col("embedding").isNotNull()).groupBy("a_", "b_").agg(F.min("vec_id").alias("node_"), F.count("*").alias("times_"), F.any_value("embedding").alias("embedding"))
    reps, without = numbered(work.keep(reps.withColumn("dim_", F.size("embedding")), "distinct"), ["a_", "b_"], rows.select("vec_id"), work)
    cells = work.keep(_assigned(reps, _fitted(reps, trees, leaf, spill, least)), "leaves")
    blocks = F.ceil(F.count("*") / F.least(F.lit(block), F.greatest(F.lit(256), F.floor(F.lit(1 << 21) / F.col("dim_"))))).cast("int")
    marked = F.explode(F.arrays_zip(F.col("own_").alias("leaf_"), F.col("marks_").alias("mark_"))).alias("at_")
    # vectors of one mark before the leaf met in the leaf of that mark, so their blocks are compared with those of others alone
    count = cells.select("dim_", marked).select("dim_", "at_.*").groupBy("dim_", "leaf_", "mark_").agg(blocks.alias("n_"))
    count = count.groupBy("dim_", "leaf_").agg(F.collect_list(F.struct("mark_", "n_")).alias("list_"), F.sum("n_").alias("of_")).where("of_ > 1")
    x = cells.select("dim_", "node_", "times_", "own_", "embedding", marked).select("dim_", "node_", "times_", "own_", "embedding", "at_.*")
    x = x.join(small(work.keep(count.drop("of_"), "large-leaves")), ["dim_", "leaf_"], "left")
    x = x.withColumn("own_n_", F.expr("filter(list_, m -> m.mark_ = mark_)[0].n_"))
    x = x.withColumn("start_", F.expr("aggregate(filter(list_, m -> m.mark_ < mark_), 0, (s, m) -> s + m.n_)"))
    x = x.withColumn("block_", F.coalesce(F.col("start_") + F.pmod(F.xxhash64("node_"), F.col("own_n_")).cast("int"), F.lit(0)))
    others = "filter(sequence(0, aggregate(list_, 0, (s, m) -> s + m.n_) - 1), o -> mark_ = leaf_ or o < start_ or o >= start_ + own_n_)"
    every = F.expr(f"if(list_ is null, array(named_struct('one_', 0, 'two_', 0)), transform({others}, o -> named_struct('one_', least(o, block_), 'two_', greatest(o, block_))))")
    x = x.withColumn("cell_", F.explode(every)).select("dim_", "leaf_", "cell_.*", "block_", "node_", "times_", "own_", "embedding")
    found = x.groupBy("dim_", "leaf_", "one_", "two_").applyInArrow(_compare(least), "node_ long, n_ long, root_ long")
    found = work.keep(found, "links")
    work.drop(cells)
    comps = by_id(work.keep(components(found.select(F.col("node_").alias("u_"), F.col("root_").alias("v_")), work), "components"), without)
    sums = found.groupBy("node_").agg(F.sum("n_").alias("n_"))
    in_one = F.col("found_").isNotNull() if without is not None else F.col("comp_").isNotNull()
    classes = reps.select("a_", "b_", "node_", "times_").join(sums, "node_", "left").join(comps, "node_", "left")
    classes = classes.select("a_", "b_", "times_", (F.col("times_") - 1 + F.coalesce("n_", F.lit(0))).alias("n_links"), F.when(in_one, F.col("comp_")).otherwise(F.col("node_")).alias("component_id"))
    known = rows.where(F.col("embedding").isNotNull()).select("vec_id", "a_", "b_")
    out = join_hot(known, work.keep(classes, "classes"), ["a_", "b_"], "times_", vectors.count()).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where(F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
