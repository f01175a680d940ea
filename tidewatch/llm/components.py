"""Connected components of a link table, as joins and groupings that leave each node with its least member.

Links are rewired in rounds: first every larger neighbour of a node is linked to the node's least neighbour,
then every smaller one. Each round is written to the shared folder, and the tables of earlier rounds are
deleted. Rounds grow with the logarithm of the number of nodes; nothing is gathered in one task, and a
node with very many neighbours is an ordinary skewed join key that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard
from tidewatch.session import stage

MAX_ROUNDS = 100


def _links(df: DataFrame) -> DataFrame:
    """Distinct links with the larger node first."""
    return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _to_larger(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _links(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _to_smaller(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _links(others.unionAll(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that occurs in the bigint columns `a` and `b` of `links`.

    The component is its least node. Null nodes and links of a node with itself don't count.
    """
    now = stage(_links(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        # Links form stars around least members exactly when another round changes nothing.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        following = stage(_to_smaller(_to_larger(now)), "links")
        discard(now)
        now, seen = following, state
    else:
        raise ValueError(f"components are not settled after {MAX_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
