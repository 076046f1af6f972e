"""Connected components of an edge table, by alternating large-star and small-star joins.

(Kiveris et al., "Connected components in MapReduce and beyond", 2014.) Each round is a few group-bys whose
groups only need a minimum, so no vertex's neighbours are ever gathered in one place; every round's edges are
written to the shared folder, those of the round before deleted, and nothing but their count and checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import cut, drop, every_salt, salt


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's larger (or else smaller and own) neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # replicating a minimum is cheap, so a vertex with very many neighbours is dealt over several tasks
    salts = 8
    left = both.withColumn("s", salt(F.col("b"), salts))
    right = least.withColumn("s", every_salt(salts))
    near = left.join(right, ["a", "s"])
    if large:
        return near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m"))).filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge to another.

    ``edges`` may hold loops, repeats and either direction; rows with a null end are no edges.
    """
    e = edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct()
    e, before = cut(e, "edges"), None
    for _ in range(rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.countDistinct("a")).first()
        if state[0] == state[2] and state == before or not state[0]:
            break
        before = state
        before_cut, e = e, cut(_star(_star(e, True).select("a", "b"), False), "edges")
        drop(before_cut)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
