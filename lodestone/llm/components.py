"""Connected components of a graph that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u_, v_))"), F.expr("bit_xor(xxhash64(v_, u_, 7))")).first())


def components(edges: DataFrame, work: Scratch, rounds: int = 60) -> DataFrame:
    """``edges`` has longs u_ and v_; returns (node_, comp_): the smallest node reachable, for each node of an edge.

    Alternates the large-star and small-star steps: every node hands its larger, then its smaller, neighbours to its
    least neighbour, until all edges point at the least node of their component. Minima are pre-aggregated, so a node
    with very many edges costs one row a task; the tables between rounds are written to the shared folder.
    """
    e = edges.where(F.col("u_") != F.col("v_")).select(F.greatest("u_", "v_").alias("u_"), F.least("u_", "v_").alias("v_")).distinct()
    e = work.keep(e, "edges")
    was = _mark(e)
    for _ in range(rounds):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("v_").alias("u_"), F.col("u_").alias("v_")))
        least = both.groupBy("u_").agg(F.min("v_").alias("m_")).withColumn("m_", F.least("m_", "u_"))
        big = both.where(F.col("v_") > F.col("u_")).join(least, "u_").select(F.col("v_").alias("u_"), F.col("m_").alias("v_")).distinct()
        big = work.keep(big.where(F.col("u_") != F.col("v_")), "large-star")
        least = big.groupBy("u_").agg(F.min("v_").alias("m_"))
        moved = big.join(least, "u_").where(F.col("v_") != F.col("m_")).select(F.col("v_").alias("u_"), F.col("m_").alias("v_"))
        new = work.keep(least.withColumnRenamed("m_", "v_").unionByName(moved).distinct(), "small-star")
        work.drop(e, big)
        e, now = new, _mark(new)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u_").alias("node_"), F.col("v_").alias("comp_")).unionByName(e.select(F.col("v_").alias("node_"), F.col("v_").alias("comp_")).distinct())


def numbered(groups: DataFrame, keys: list[str], ids: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``groups`` (one row per value of ``keys``, node_ null where no row has an id) with a node_ in every row.

    Groups without an id get a hash of their keys as their number. That no number is an id (``ids``, one long column) or
    another group's number is checked, so ids may take the whole range of 64 bits. Returns the groups and, if there are
    any, those without an id.
    """
    none = groups.where(F.col("node_").isNull())
    if not none.limit(1).count():
        return groups, None
    known = ids.select(F.col(ids.columns[0]).alias("node_"))
    for salt in range(100):
        named = work.keep(none.withColumn("node_", F.xxhash64(F.lit(salt), *keys)), "without-id")
        twice = named.groupBy("node_").count().where("count > 1")
        if not twice.limit(1).count() and not known.join(small(named.select("node_")), "node_", "left_semi").limit(1).count():
            return groups.where(F.col("node_").isNotNull()).unionByName(named), named
    raise RuntimeError("no free numbers for rows without an id")


def by_id(comps: DataFrame, without: DataFrame | None) -> DataFrame:
    """``comps`` (node_, comp_) with comp_ the least *id* of the component; null where it has none. ``without`` holds the
    nodes that stand for rows without an id."""
    if without is None:
        return comps
    marked = comps.join(small(without.select("node_", F.lit(True).alias("no_"))), "node_", "left")
    least = marked.groupBy("comp_").agg(F.min(F.when(F.col("no_").isNull(), F.col("node_"))).alias("id_"))
    alone = without.select("node_", F.lit(None).cast("long").alias("comp_")).join(comps, "node_", "left_anti")
    return marked.join(least, "comp_").select("node_", F.col("id_").alias("comp_")).unionByName(alone).withColumn("found_", F.lit(True))
