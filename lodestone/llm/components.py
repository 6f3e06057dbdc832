"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node links its neighbours, larger ones or smaller ones, to the smallest node that it sees."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
    linked = both.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component is the smallest node reachable.

    No edges give no rows. Each round is written to the shared folder in place of the one before; after the last the edges are stars, each node
    beside its smallest, and a round that changes nothing ends the loop.
    """
    state = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == mark or now[0] == 0:
            break
        mark = tuple(now)
        before, state = state, materialize(_star(_star(state, True), False), "edges")
        release(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = state.select(F.col("b").alias("id")).distinct()
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
