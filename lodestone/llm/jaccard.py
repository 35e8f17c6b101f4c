"""Exact n-gram Jaccard self-join in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_hot, small, text_or_empty, trimmed
from .components import by_id, components, numbered
from .words import mix, shingle_sets, slices

#: Frequent shingles that are told apart at most.
MOST_FREQUENT = 1_000_000


def _utf8(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def frequent_shingles(docs: DataFrame, words: int, share: float, chunk: int) -> np.ndarray:
    """Sorted hashes of the shingles in at least ``share`` of all documents.

    A shingle that frequent overall is as frequent in some chunk, so each chunk reports only its own frequent ones and
    the reports are summed. At most (mean set size / share) shingles can qualify, and of more than MOST_FREQUENT the
    commonest are taken: 8 MB. The list serves only to order shingles: any order gives the same join.
    """

    def local(batches):
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            hot = c >= max(4, share * n)
            return pa.RecordBatch.from_arrays([pa.array(h[hot].view(np.int64)), pa.array(c[hot].astype(np.int64))], names=["h_", "c_"])

        for b in slices(batches, column=0):
            for s in shingle_sets(_utf8(b.column(0)), words):
                held.append(s)
                n += 1
                if n >= chunk:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    rows = docs.select("text_").mapInArrow(trimmed(local), "h_ long, c_ long").groupBy("h_").agg(F.sum("c_").alias("c_"))
    hot = rows.where(F.col("c_") >= max(4, 0.5 * share * total)).orderBy(F.desc("c_"), "h_").limit(MOST_FREQUENT)
    return np.sort(hot.select("h_").toArrow()["h_"].to_numpy().view(np.uint64))


#: A set's window is longer by this percentage of the set than one common shingle would ask for; in return, linked sets
#: have as many more shingles in common there, and the rarest of them will do.
SLACK = 15


def _required(n, percent: int):
    """For a set of n: how few of its shingles a linked set may share, its window, and how many the windows share."""
    least = (percent * n + 99) // 100
    return least, n - least + SLACK * n // 100 + 1, SLACK * least // 100 + 1


def _prefix(s: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """A set's window: the shingles whose regions it may have to enter, the first ones in a fixed order, hot ones last.

    A set's home is the region of its first shingle. Its distance to the region of its (k+1)-th one is at least k / n,
    as k shingles would have to go; beyond 1 - t no set of that region can be near enough, so n - ceil(t n) + 1 regions
    hold at least one shingle that a linked set has in its own window.
    """
    k = min(len(s), _required(len(s), percent)[1])
    order = mix(s)
    if len(hot):
        at = np.searchsorted(hot, s)
        is_hot = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == s)
        order = (order >> np.uint64(1)) | (is_hot.astype(np.uint64) << np.uint64(63))
    return s[np.argpartition(order, k - 1)[:k]] if k < len(s) else s


def _key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signatures(docs: DataFrame, words: int, percent: int, hot: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for b in slices(batches, column=1):
            n, key, pre = [], [], []
            for s in shingle_sets(_utf8(b.column(1)), words):
                n.append(len(s))
                key.append(_key(s))
                pre.append(_prefix(s, shared.value, percent) if len(s) else s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), _longs(pre)], names=["doc_id", "n_shingles", "key_", "prefix_"])

    return docs.mapInArrow(trimmed(run), "doc_id long, n_shingles long, key_ binary, prefix_ array<long>")


def _mask(s: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in at least two cells a shingle, a power of two of 64-bit words. Sets whose parities
    differ in k cells differ in at least k shingles; a mask of half the size is the exclusive or of its halves."""
    m = np.zeros(1 << (max(len(s), 1) - 1 >> 5).bit_length(), np.uint64)
    h = mix(s)
    np.bitwise_xor.at(m, (h >> np.uint64(6)) & np.uint64(len(m) - 1), np.uint64(1) << (h & np.uint64(63)))
    return m


def _differ(a: str, b: str):
    """At least so many shingles are in one of two sets alone, by their masks; 0 where one mask is over twice the other."""

    def folded(c: str, other: str):
        half = (F.size(c) / 2).cast("int")
        two = F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(half == F.size(other), two).otherwise(F.col(c))

    cells = F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.coalesce(F.aggregate(cells, F.lit(0), lambda n, x: n + x), F.lit(0))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for b in slices(batches, column=1):
            sets = list(shingle_sets(_utf8(b.column(1)), words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_key(s) for s in sets], pa.binary()), _longs(sets), _longs([_mask(s) for s in sets])], names=["node_", "key_", "set_", "mask_"])

    return docs.mapInArrow(trimmed(run), "node_ long, key_ binary, set_ array<long>, mask_ array<long>")


def _measured(pairs: DataFrame, sets: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """(x_, y_) with their exact distance d_ and whether they link.

    Up to a checked number of pairs these are broadcast to the sets, so only sets that a pair needs are shuffled, once
    to their partner. Beyond it the joins are plain; a partner of very many is split by adaptive execution in both.
    """
    pairs = small(work.keep(pairs, "pairs"), 500_000)
    ends = pairs.select("y_").distinct()
    a = sets.select(F.col("node_").alias("x_"), F.col("set_").alias("a_")).join(pairs, "x_")
    b = sets.select(F.col("node_").alias("y_"), F.col("set_").alias("b_")).join(small(work.keep(ends, "ends"), 500_000), "y_")
    both = F.size(F.array_intersect("a_", "b_")).cast("long")
    x = a.join(b, "y_").select("x_", "y_", both.alias("both_"), (F.size("a_") + F.size("b_")).cast("long").alias("sum_"))
    any_ = F.col("sum_") - F.col("both_")
    return x.select("x_", "y_", (1 - F.col("both_") / any_).alias("d_"), (100 * F.col("both_") >= percent * any_).alias("link_"))


def _regions(rows: DataFrame, sizes: DataFrame, hot: np.ndarray, percent: int, work: Scratch) -> DataFrame:
    """(h_, node_, n_) for the regions of at least two nodes, from the windows' rows (node_, h_).

    How many windows hold a shingle is counted first. Within its window a node enters the regions of its rarest
    shingles alone: as linked windows share at least q shingles, all but the q - 1 commonest hold one of them. Shingles
    of one window come first and make no region, so documents that share mere passages meet in none.
    """
    spark = rows.sparkSession
    w = Window.partitionBy("h_")
    if len(hot):
        hots = F.broadcast(spark.createDataFrame(pa.table({"h_": hot.view(np.int64)})))
        many = rows.join(hots, "h_").select("node_", F.lit(1 << 62).alias("df_"), "h_")
        rows = rows.join(hots, "h_", "left_anti")
    common = rows.withColumn("df_", F.count("*").over(w)).where(F.col("df_") > 1).select("node_", "df_", "h_")
    common = common.unionByName(many) if len(hot) else common
    lists = common.groupBy("node_").agg(F.sort_array(F.collect_list(F.struct("df_", "h_"))).alias("common_")).join(sizes, "node_")
    least = F.floor((F.col("n_shingles") * percent + 99) / 100)
    window = F.least(F.col("n_shingles"), F.col("n_shingles") - least + F.floor(F.col("n_shingles") * SLACK / 100) + 1)
    shared = F.floor(least * SLACK / 100) + 1
    enter = window - shared + 1 - (window - F.size("common_"))
    lists = lists.withColumn("enter_", enter.cast("int")).where(F.col("enter_") > 0)
    entered = lists.select("node_", "n_shingles", F.explode(F.slice("common_", F.lit(1), F.col("enter_"))).alias("r_")).select("node_", F.col("n_shingles").alias("n_"), "r_.*")
    # distance to the empty set as a second pivot: linked sizes differ by a factor of at most 100 / percent
    size = F.floor(F.log(F.col("n_").cast("double")) / math.log(100 / percent)).cast("int")
    entered = entered.withColumn("size_", F.explode(F.array(size, size + 1))).withColumn("h_", F.xxhash64("h_", "size_"))
    entered = work.keep(entered.select("h_", "node_", "n_"), "entered")
    # regions are named by their members, so those with the same members are one; a region of one node is none
    heads = entered.groupBy("h_").agg(F.count("*").alias("m_"), F.bit_xor(F.xxhash64("node_")).alias("s_")).where(F.col("m_") > 1)
    named = join_hot(entered, work.keep(heads, "heads"), "h_", "m_", entered.count())
    return named.select(F.col("s_").alias("h_"), "node_", "n_").distinct()


def _pivoted(regions: DataFrame, work: Scratch) -> DataFrame:
    """Adds pivot_ to (h_, node_, n_, far_): the far member that is in most regions, so likely the centre of its group."""
    often = regions.groupBy("node_").agg(F.count("*").alias("often_"))
    rows = regions.join(often, "node_")
    pivots = rows.groupBy("h_").agg(F.max_by("node_", F.struct("far_", "often_", -F.col("node_"))).alias("pivot_"), F.count("*").alias("m_"))
    return join_hot(regions, work.keep(pivots, "pivots"), "h_", "m_", regions.count()).select("h_", "node_", "n_", "pivot_")


def _side(rows: DataFrame, name: str, *cols: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(c if c in ("pivot_", "h_", "class_") else f"{c[0]}{name}_") for c in cols], F.col("node_").alias(f"{name}_"), F.col("n_").alias(f"n{name}_"), F.col("comp_").alias(f"c{name}_"))


def _open(percent: int):
    """Pairs whose components differ and whose sizes allow a link."""
    nx, ny = F.col("nx_"), F.col("ny_")
    return (F.col("cx_") != F.col("cy_")) & (100 * nx >= percent * ny) & (100 * ny >= percent * nx)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x_", "y_").alias("x_"), F.greatest("x_", "y_").alias("y_")).distinct()


#: Logarithm of the ratio of sizes that a class spans.
CLASS = math.log(1.05)


def _size_class(n):
    return F.floor(F.log(n.cast("double")) / CLASS).cast("int")


def _beyond_pivot(regions: DataFrame, sets: DataFrame, percent: int, most: int | None, work: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs between a region's members outside its largest component and all others, and deeper regions.

    Two sets share at most min(|x & p|, |y & p|) within the pivot p. Where that is too little for a link, they must
    share the rest outside p, so the members enter regions of their rarest shingles outside p. Regions of one pivot are
    taken together. Members that share enough within p meet those of the sizes that may link. New regions and sizes in
    which more than ``most`` pairs could be compared are not, if they hold more than ``most`` squared together; they are
    returned as deeper. Of the pairs in the others, those go on for which the pivot and the shingles from the region's on
    leave enough and whose masks differ in few enough cells.
    """
    g = work.keep(regions.groupBy("pivot_", "node_", "n_", "comp_").agg(F.max("far_").alias("far_")), "members")
    pivots = work.keep(g.select("pivot_").distinct(), "pivots")
    of = sets.select(F.col("node_").alias("pivot_"), F.col("set_").alias("of_")).join(small(pivots, 500_000), "pivot_")
    g = sets.join(small(g, 500_000), "node_").join(of, "pivot_")
    g = work.keep(g.select("pivot_", "node_", "n_", "comp_", "far_", "mask_", F.array_except("set_", "of_").alias("out_")).withColumn("b_", F.col("n_") - F.size("out_")), "outside")
    least = lambda n: F.floor((percent * n + 99) / 100)
    needed = lambda both: F.floor((percent * both + 99 + percent) / (100 + percent))
    # pairs that may link by what they share within the pivot; that bounds the partner's size, so few sizes are looked up
    within = g.where(100 * F.col("b_") >= percent * F.col("n_"))
    hi = F.least(F.floor(100 * F.col("n_") / percent), F.floor((100 + percent) * F.col("b_") / percent) - F.col("n_"))
    asks = within.where("far_").withColumn("lo_", least(F.col("n_"))).withColumn("hi_", hi).where("lo_ <= hi_")
    asks = asks.withColumn("class_", F.explode(F.sequence(_size_class(F.col("lo_")), _size_class(F.col("hi_")))))
    within = within.withColumn("class_", _size_class(F.col("n_")))
    at = ["pivot_", "class_"]
    # a set of n needs at least ceil(t n) - |x & p| from outside, so of its rarest outside shingles all but that many will do
    from_out = F.greatest(least(F.col("n_")) - F.col("b_"), F.lit(1))
    e = g.select("pivot_", "node_", "n_", "b_", "comp_", "far_", F.size("out_").alias("size_"), from_out.alias("from_"), F.explode("out_").alias("e_")).where(F.col("size_") >= F.col("from_"))
    e = e.withColumn("df_", F.count("*").over(Window.partitionBy("pivot_", "e_")))
    e = e.withColumn("rank_", F.row_number().over(Window.partitionBy("pivot_", "node_").orderBy("df_", "e_")))
    # how many outside shingles are left from this one on: what two sets share within p and after their first common one
    e = e.withColumn("spare_", F.col("size_") - F.col("rank_") + 1).where((F.col("spare_") >= F.col("from_")) & (F.col("df_") > 1))
    span = e.groupBy("pivot_", "e_").agg((F.sum(F.col("far_").cast("long")) * F.count("*")).alias("pairs_"), F.bit_xor(F.xxhash64("pivot_", "node_", "far_")).alias("h_"), F.min("comp_").alias("min_"), F.max("comp_").alias("max_"))
    span = span.where((F.col("min_") < F.col("max_")) & (F.col("pairs_") > 0)).select("pivot_", "e_", "pairs_", F.xxhash64("pivot_", "h_").alias("h_"))
    # regions of a pivot with the same members are one
    e = e.join(span, ["pivot_", "e_"]).groupBy("h_", "node_", "n_", "comp_", "far_", "pairs_").agg(F.max("b_").alias("b_"), F.max("spare_").alias("spare_"))
    e = work.keep(e, "deeper")
    few, deeper = e, None
    if most is not None:
        hot = asks.groupBy(at).agg(F.count("*").alias("a_")).join(within.groupBy(at).agg(F.count("*").alias("m_")), at)
        hot = work.keep(hot.select(*at, (F.col("a_") * F.col("m_")).alias("pairs_")).where(F.col("pairs_") > most), "hot")
        over = e.where(F.col("pairs_") > most)
        total = hot.select("pairs_").unionByName(over.select("h_", "pairs_").distinct().select("pairs_")).agg(F.sum("pairs_")).first()[0] or 0
        if total > most**2:
            few = e.where(F.col("pairs_") <= most)
            hot = small(hot)
            met = asks.select(*at, "node_", "n_", "far_").unionByName(within.select(*at, "node_", "n_", F.lit(False).alias("far_"))).join(hot, at, "left_semi")
            met = met.groupBy(F.xxhash64(F.lit("within"), *at).alias("h_"), "node_", "n_").agg(F.max("far_").alias("far_"))
            asks = asks.join(hot, at, "left_anti")
            deeper = over.select("h_", "node_", "n_", "far_").unionByName(met)
    # a pair needs more than the least that each alone may need; near copies of p have its size, so they need far more
    enough = needed(F.col("nx_") + F.col("ny_"))
    alike = lambda shared: _open(percent) & (shared >= enough) & (_differ("mx_", "my_") <= F.col("nx_") + F.col("ny_") - 2 * enough)
    near = _side(asks, "x", *at, "b_", "mask_").join(_side(within, "y", *at, "b_", "mask_"), at).where(alike(F.least("bx_", "by_")))
    few = few.join(sets.select("node_", "mask_"), "node_")
    out = _side(few.where("far_"), "x", "h_", "b_", "spare_", "mask_").join(_side(few, "y", "h_", "b_", "spare_", "mask_"), "h_")
    out = out.where(alike(F.least("bx_", "by_") + F.least("sx_", "sy_")))
    return _ordered(near.select("x_", "y_").unionByName(out.select("x_", "y_"))), deeper


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, share: float = 0.002, chunk: int = 2000, cell: int = 4096, rounds: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the smallest id reachable by links.

    Documents link when the Jaccard distance of their sets of ``words``-word shingles is at most eps = 1 - percent/100.
    The join is exact:

    1. Equal sets are one node.
    2. The first pivots are shingles. A node's home region is that of its first shingle in a fixed order (rare before
       frequent); the triangle inequality bounds how far it lies from the region of each later shingle, and it is
       replicated to those within eps. Linked nodes meet in at least one region.
    3. In each region a document becomes the pivot and every member's exact distance d to it is found. Members within
       eps are one component. Others must still be compared with each other and, by the triangle inequality, only
       with members at d >= (least distance beyond eps) - eps.
    4. The members outside a region's largest component join recursively with the others, in regions of the shingles
       that lie outside the pivot. A region with at most ``cell`` pairs compares them; larger ones get pivots of their
       own, up to ``rounds`` levels, the last of which compares whatever is left. A level whose larger regions hold at
       most ``cell`` squared pairs together is the last.

    Members of one component are never compared again, so a large group of near copies costs one comparison each; nor
    is a pair that was measured at a level above. Pairs whose masks (parities of hashed shingles) rule a link out, as
    they differ in too many cells, aren't measured: only few of the pairs of excerpts from one text are.
    Regions of frequent shingles get their pivot by a pre-aggregated minimum, others by a window over the region.

    Sets are compared by 64-bit hashes of their shingles and told apart by 128-bit digests of those: "exact" is up to
    a collision of these. Null and empty texts have no shingles and are alone. Ids may be any 64-bit numbers. A null id
    has a null component_id unless a row with an id is reachable; rows that repeat an id share its component. Extra
    columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    work = Scratch(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text_"))
    hot = frequent_shingles(base, words, share, chunk)
    sigs = work.keep(_signatures(base, words, percent, hot), "signatures")
    full = sigs.where(F.col("key_").isNotNull())
    narrow = work.keep(sigs.select("doc_id", "n_shingles", "key_"), "narrow")
    named = full.groupBy("key_", "doc_id").agg(F.count("*").alias("n_"))
    groups = named.groupBy("key_").agg(F.min("doc_id").alias("node_"), F.coalesce(F.min_by("n_", "doc_id"), F.lit(1)).alias("times_"), F.sum("n_").alias("rows_"))
    nodes, without = numbered(work.keep(groups, "groups"), ["key_"], narrow.select("doc_id"), work)
    nodes = work.keep(nodes, "nodes")
    member = join_hot(narrow, nodes, "key_", "rows_", narrow.count())

    # a node's window comes from the row that names it, and from one of them where a row is repeated
    others = work.keep(member.where(F.col("doc_id") != F.col("node_")).select("key_", "doc_id").distinct(), "others")
    rows = full.where(F.col("doc_id").isNotNull()).join(small(others, 500_000), ["key_", "doc_id"], "left_anti").select("key_", F.col("doc_id").alias("node_"), "n_shingles", "prefix_")
    twice = nodes.where(F.col("times_") > 1).select("key_")
    repeats = bool(twice.limit(1).count())
    if repeats:
        rows = rows.join(twice, "key_", "left_anti").unionByName(rows.join(twice, "key_", "left_semi").dropDuplicates(["node_", "key_"]))
    if without is not None:
        missing = full.where(F.col("doc_id").isNull()).join(small(without.select("key_", "node_")), "key_").dropDuplicates(["key_"])
        rows = rows.unionByName(missing.select("key_", "node_", "n_shingles", "prefix_"))
    sizes = rows.select("node_", "n_shingles").distinct()
    rows = rows.select("node_", F.explode("prefix_").alias("h_"))
    regions = work.keep(_regions(rows, sizes, hot, percent, work).withColumn("far_", F.lit(True)), "regions")
    regions = work.keep(_pivoted(regions, work), "regions")
    work.drop(sigs, others)
    wanted = work.keep(regions.select("node_").distinct().join(nodes.groupBy("node_").agg(F.max("times_").alias("times_")), "node_"), "wanted")
    texts = base.join(small(wanted, 1_000_000), F.col("doc_id") == F.col("node_")).select("doc_id", "text_", "times_")
    if repeats:
        again = texts.where(F.col("times_") > 1).dropDuplicates(["doc_id", "text_"])
        texts = texts.where(F.col("times_") == 1).unionByName(again)
    sets = _sets(texts.select("doc_id", "text_"), words).drop("key_")
    if without is not None:
        missing = _sets(base.where(F.col("doc_id").isNull()), words).drop("node_").join(small(without.select("key_", "node_")), "key_").dropDuplicates(["key_"])
        sets = sets.unionByName(missing.select("node_", "set_", "mask_"))
    sets = work.keep(sets, "sets")

    comps = work.keep(spark.createDataFrame([], "node_ long, comp_ long"), "components")

    def joined(new: DataFrame) -> DataFrame:
        """The components with more links. What is known is a star already and is only added to."""
        new = work.keep(new.where("link_").select(F.col("x_").alias("u_"), F.col("y_").alias("v_")), "links")
        if not new.limit(1).count():
            return comps
        return work.keep(components(new.unionByName(comps.select(F.col("node_").alias("u_"), F.col("comp_").alias("v_"))), work), "components")

    tried = None
    for turn in range(rounds):
        # every member meets the pivot that it shares most regions with; other pivots only if that left them apart
        pairs = regions.where(F.col("node_") != F.col("pivot_")).groupBy(F.col("node_").alias("x_"), F.col("pivot_").alias("y_")).agg(F.count("*").alias("c_"))
        pairs = work.keep(pairs, "pairs")
        main = pairs.groupBy("x_").agg(F.max_by("y_", F.struct("c_", -F.col("y_"))).alias("y_"))
        far = work.keep(_measured(main, sets, percent, work), "distances")
        comps = joined(far)
        of = lambda c: comps.select(F.col("node_").alias(f"{c}_"), F.col("comp_").alias(f"c{c}_"))  # noqa: E731, B023
        rest = pairs.join(far.select("x_", "y_"), ["x_", "y_"], "left_anti").join(of("x"), "x_", "left").join(of("y"), "y_", "left")
        apart = F.coalesce("cx_", "x_") != F.coalesce("cy_", "y_")
        rest = work.keep(rest.select("x_", "y_", apart.alias("apart_")), "rest")
        more = work.keep(_measured(rest.where("apart_").select("x_", "y_"), sets, percent, work), "distances")
        comps = joined(more)
        known = far.unionByName(more).unionByName(rest.where("not apart_").select("x_", "y_", F.lit(None).cast("double").alias("d_"), F.lit(True).alias("link_")))
        left = regions.join(known.select(F.col("x_").alias("node_"), F.col("y_").alias("pivot_"), "d_", "link_"), ["node_", "pivot_"])
        left = work.keep(left, "measured")
        edge = left.groupBy("h_").agg(F.min(F.when(~F.col("link_"), F.col("d_"))).alias("edge_"), F.count("*").alias("rows_")).where(F.col("edge_").isNotNull())
        window = F.coalesce(F.col("d_"), F.lit(1.0)) >= F.col("edge_") - (1 - percent / 100) - 1e-9
        left = join_hot(left, work.keep(edge, "edges"), "h_", "rows_", regions.count()).where(~F.col("link_") | window)
        left = work.keep(left.join(comps, "node_", "left").select("h_", "node_", "n_", "pivot_", F.coalesce("comp_", "node_").alias("comp_")), "inside")
        # a region whose members are all in one component by now is done; else those outside its largest one are far
        span = left.groupBy("h_", "comp_").agg(F.count("*").alias("m_"), F.bit_xor(F.xxhash64("node_")).alias("s_"))
        span = span.groupBy("h_").agg(F.max_by("comp_", F.struct("m_", "comp_")).alias("main_"), (F.sum("m_") - F.max("m_")).alias("m_"), F.bit_xor("s_").alias("s_"), F.sum("m_").alias("rows_"))
        left = join_hot(left, work.keep(span.where(F.col("m_") > 0), "spans"), "h_", "rows_", regions.count()).withColumn("far_", F.col("comp_") != F.col("main_"))
        # regions left with the same members and pivot are one
        left = left.groupBy(F.xxhash64("s_", "pivot_").alias("h_"), "pivot_", "node_", "n_", "comp_", "far_").agg(F.max("m_").alias("m_"))
        left = work.keep(left, "left")
        pairs, deeper = _beyond_pivot(left, sets, percent, None if turn + 1 == rounds else cell, work)
        pairs = pairs if tried is None else pairs.join(tried, ["x_", "y_"], "left_anti")
        if deeper is not None:
            pairs = work.keep(pairs, "tried")
            new = pairs.unionByName(_ordered(far.unionByName(more)))
            tried = new if tried is None else tried.unionByName(new)
        comps = joined(_measured(pairs, sets, percent, work))
        if deeper is None:
            break
        regions = work.keep(_pivoted(deeper, work), "regions")
    comps = by_id(comps, without)
    in_one = F.col("found_").isNotNull() if without is not None else F.col("comp_").isNotNull()
    found = member.join(comps, "node_", "left").select("doc_id", "n_shingles", F.when(in_one, F.col("comp_")).otherwise(F.col("node_")).alias("component_id"))
    return found.unionByName(narrow.where(F.col("key_").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
