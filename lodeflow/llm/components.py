"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

BY_ID, MOST_ROUNDS = 3, 200


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of 64-bit ids -> (node, component), component being the smallest node reachable.

    In each round every node points to the first of its neighbours and itself; links are then drawn between what their
    ends point to. The first is the smallest in the first rounds (BY_ID): a star whose centre is its smallest node is one
    node after a round. In later rounds it is the first by a hash of node and round, so that chains, whatever their order,
    lose a share of their nodes in each. At the end the rounds' pointers are followed in turn. Minima are taken in part
    before the shuffle, and pointers are joined from a written table: a hot node's links are rows of a plain join then,
    which the adaptive plan splits. Nulls and self-links drop out; repeated links count once; an empty table gives an
    empty result. More than MOST_ROUNDS rounds would raise an error.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        if len(pointers) == MOST_ROUNDS:
            raise RuntimeError(f"components are not found after {MOST_ROUNDS} rounds")
        ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))))
        rank = lambda c, r=len(pointers): F.struct(F.lit(0).alias("h") if r < BY_ID else F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("id"))
        least = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.min(rank("other")).alias("m"))
        step = staged(least.select("node", F.least(rank("node"), F.col("m"))["id"].alias("to")), "pointers")
        one, two = (step.select(F.col("node").alias(f"n{x}"), F.col("to").alias(f"to{x}")) for x in "uv")
        drawn = edges.join(one, F.col("u") == F.col("nu")).join(two, F.col("v") == F.col("nv")).where("tou <> tov")
        after = staged(drawn.select(F.greatest("tou", "tov").alias("u"), F.least("tou", "tov").alias("v")).distinct(), "links")
        discard(edges)
        edges = after
        pointers.append(step)
    if not pointers:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = pointers[0].withColumnRenamed("to", "component")
    for step in pointers[1:]:
        later = step.select(F.col("node").alias("n_"), F.col("to").alias("to_"))
        found = found.join(later, F.col("component") == F.col("n_"), "left").select("node", F.coalesce("to_", "component").alias("component"))
    if len(pointers) <= BY_ID:
        return found
    found = staged(found, "found")
    least = staged(found.groupBy(F.col("component").alias("c_")).agg(F.min("node").alias("least")), "least")
    return found.join(least, F.col("component") == F.col("c_")).select("node", F.col("least").alias("component"))
