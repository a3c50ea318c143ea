"""Connected components of a link table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every node that occurs in ``links(a, b)``.

    ``component`` is the least id reachable.  Alternating stars: each round halves the
    distances, so long chains take logarithmically many rounds; the loop ends when a round
    changes nothing.  Only two numbers about a round reach the driver.  Each round is
    written to the shared folder, which cuts the lineage.  Links of a node to itself and
    links with a null end are ignored; no links give no rows.
    """
    links = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    before = _state(links)
    while before[0]:
        links = materialize(_small_star(_large_star(links)), "stars")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        links.select(F.col("b"), F.col("b")).distinct())
