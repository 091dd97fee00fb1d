"""Connected components of a link table, in rounds of joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.session import cut, erase


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that occurs in ``links`` (columns a and b).

    Large-star and small-star rounds: every node is linked to the smallest of its neighbours, first by those above it, then
    by those below it, until only stars are left. Rounds grow with the logarithm of the longest chain; each is a grouping
    for minima and a join, so a node with a third of all links is combined before the shuffle and its join is split.
    Self-links and nulls are left out; repeated links count once.
    """
    both = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    edges = cut(both.where("lo < hi").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first()  # one row
        if now == state or not now[0]:
            break
        state, before = now, edges
        stars = cut(large_star(edges))
        edges = cut(small_star(stars))
        erase(before)
        erase(stars)
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def least_below(edges: DataFrame) -> DataFrame:
    """Every node's smallest neighbour below it, written, so that the join with it can be split where a node is hot."""
    return cut(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every node's neighbours above it are linked to the smallest of its neighbours and itself."""
    moved = edges.join(least_below(edges), F.col("lo") == F.col("node"), "left")
    return moved.select(F.coalesce("least", "lo").alias("lo"), "hi")


def small_star(edges: DataFrame) -> DataFrame:
    """Every node's neighbours below it, and itself, are linked to the smallest of them."""
    joined = edges.join(least_below(edges), F.col("hi") == F.col("node"))
    ends = F.array(F.struct(F.col("least").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("least").alias("lo"), F.col("hi")))
    return joined.select(F.explode(ends).alias("e")).select("e.*").where("lo < hi").distinct()
