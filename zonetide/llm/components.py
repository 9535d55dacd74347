"""Connected components of a graph whose links are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have links; ``component`` is the smallest node reachable.

    ``links`` has two long columns ``a`` and ``b``. In each round every node points to the
    smallest of itself and its neighbours, and links are carried over to the nodes pointed to.
    At least half of the nodes that have links drop out, so rounds are few. A node with very
    many links costs no more than others: minima are taken before the shuffle. Null ends, loops and
    repeated links don't matter. No links give no rows.
    """
    links = (links.select("a", "b").where(F.col("a") != F.col("b"))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = stored(links, "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        points = stored(both.groupBy(F.col("a").alias("node"))
                        .agg(F.least(F.min("b"), F.min("a")).alias("to")), "points")
        rounds.append(points)
        heads = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        tails = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = stored(links.join(heads, "a").join(tails, "b").where(F.col("x") != F.col("y"))
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                       .distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # From the last round back: where the node pointed to has itself moved on.
    result = rounds[-1].select("node", F.col("to").alias("component"))
    for points in reversed(rounds[:-1]):
        later = result.select(F.col("node").alias("to"), "component")
        result = (points.join(later, "to", "left")
                  .select("node", F.coalesce("component", "to").alias("component")))
    return result
