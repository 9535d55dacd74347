"""Segments of connected zones with alike daily profiles.

Touching zones are joined by edges weighted by how much their profiles differ. Borůvka's rounds find the minimum spanning
tree of all edges at once: in each round every group of zones takes its lightest edge to another group, so the
number of groups at least halves. Then the tree is cut where that lessens the differences within segments most, one edge
after the other. A segment is a part of the tree, so it is connected.

Profiles are whole numbers (the share of each hour, in thousandths), weights too; equal weights go by the ids of the ends. So
trees and cuts don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters, check_range
from zonetide.functions.numeric import ratio
from zonetide.plans.shared import stored

HOURS = 24


def hourly_profiles(demand: DataFrame, zones: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """(location_id, trip_count, profile): the share of each hour in a zone's trips, in thousandths; zeros without trips."""
    hour = filters.without("hour").apply(demand).groupBy("location_id").agg(
        F.sum("trip_count").alias("trip_count"),
        *[F.coalesce(F.sum(F.when(F.col("pickup_hour") == h, F.col("trip_count"))), F.lit(0)).alias(f"h{h}")
          for h in range(HOURS)])
    share = F.array(*[F.coalesce(ratio(1000 * F.col(f"h{h}"), F.col("trip_count"), 0).cast("bigint"), F.lit(0))
                      for h in range(HOURS)])
    return filters.select_zones(zones).select("location_id").join(hour, "location_id", "left").select(
        "location_id", F.coalesce("trip_count", F.lit(0).cast("bigint")).alias("trip_count"), share.alias("profile"))


def _squared(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, v: total + v * v)


def weighted_edges(profiles: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(a, b, weight) of touching zones, a < b; the weight is the squared distance of their profiles."""
    ends = [profiles.select(F.col("location_id").alias(c), F.col("profile").alias(f"profile_{c}")) for c in "ab"]
    pairs = adjacency.select(F.least("location_id", "neighbour_id").alias("a"),
                             F.greatest("location_id", "neighbour_id").alias("b")).where("a < b").distinct()
    apart = F.zip_with("profile_a", "profile_b", lambda x, y: x - y)
    return pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", _squared(apart).alias("weight"))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """The edges (a, b, weight) of the minimum spanning tree, or of one for each connected part."""
    edges = stored(edges, "edges")
    open_edges = edges.select("a", "b", "weight", F.col("a").alias("ga"), F.col("b").alias("gb"))
    trees = []
    while not open_edges.isEmpty():
        edge = F.struct("weight", "a", "b", "ga", "gb")
        lightest = (open_edges.select(F.col("ga").alias("group"), edge.alias("e"))
                    .union(open_edges.select(F.col("gb").alias("group"), edge.alias("e")))
                    .groupBy("group").agg(F.min("e").alias("e")))
        lightest = stored(lightest.select("group", "e.a", "e.b", "e.weight", F.when(
            F.col("e.ga") == F.col("group"), F.col("e.gb")).otherwise(F.col("e.ga")).alias("to")), "lightest")
        trees.append(lightest.select("a", "b", "weight").distinct())
        # Every group points to another; the two that point to each other are the end, the smaller one of them the root.
        back = lightest.select(F.col("group").alias("to"), F.col("to").alias("back"))
        heads = lightest.join(back, "to", "left").select("group", F.when(
            (F.col("back") == F.col("group")) & (F.col("group") < F.col("to")), F.col("group"))
            .otherwise(F.col("to")).alias("head"))
        moved = True
        while moved:  # half as far to the root each time
            heads = stored(heads, "heads")
            further = heads.select(F.col("group").alias("head"), F.col("head").alias("next"))
            jumped = heads.join(further, "head").select("group", F.col("next").alias("head"), (
                F.col("next") != F.col("head")).alias("moved"))
            moved = not jumped.where("moved").isEmpty()
            heads = jumped.drop("moved")
        for side in ("ga", "gb"):
            named = heads.select(F.col("group").alias(side), F.col("head").alias(f"{side}_head"))
            open_edges = open_edges.join(named, side).drop(side).withColumnRenamed(f"{side}_head", side)
        open_edges = stored(open_edges.where("ga != gb").select("a", "b", "weight", "ga", "gb"), "open")
    tree = edges.limit(0)
    for part in trees:
        tree = tree.unionByName(part)
    return tree.distinct()


def _rooted(profiles: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, up) of each zone and each zone on its way to the root, itself included; the root of a tree is its smallest zone."""
    both = stored(tree.select("a", "b").union(tree.select("b", "a")), "tree")
    # The smallest zone of each tree, by handing on the smallest seen so far.
    names = profiles.select(F.col("location_id").alias("node"), F.col("location_id").alias("root"))
    changed = True
    while changed:
        names = stored(names, "roots")
        seen = names.select(F.col("node").alias("b"), F.col("root").alias("near"))
        nearer = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        handed = names.join(nearer, "node", "left").select("node", F.least("root", "near").alias("next"), "root")
        changed = not handed.where("next < root").isEmpty()
        names = handed.select("node", F.col("next").alias("root"))
    ways = frontier = names.where("node = root").select("node", F.col("node").alias("up"))
    done = ways.select("node")
    while not frontier.isEmpty():
        step = (both.join(frontier, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "up")
                .join(done, "node", "left_anti"))
        own = step.select("node", F.col("node").alias("up")).distinct()
        frontier = stored(step.union(own), "frontier")
        ways = ways.union(frontier)
        done = frontier.select("node").union(done).distinct()
    return ways


def _within(n: Column, squares: Column, sums: Column) -> Column:
    """Sum of squared distances from the mean profile."""
    return squares.cast("double") - _squared(sums).cast("double") / n.cast("double")


def zone_segments(profiles: DataFrame, adjacency: DataFrame, segments: int = 5) -> DataFrame:
    """(location_id, trip_count, segment): connected zones with alike profiles have the same segment.

    A segment is named by its smallest zone. Zones that nothing links lie in parts of their own, of which there may be more than
    ``segments``; otherwise edges are cut until there are that many, as long as a cut gains anything. Each cut takes the edge
    that lessens the sum of squared distances from the segments' mean profiles most (ties: the smaller ids). Rows are as
    many as the ways from zones to the root of their tree are long.
    """
    check_range("segments", segments, 1, 1000)
    profiles = stored(profiles, "profiles")
    tree = stored(spanning_tree(weighted_edges(profiles, adjacency)), "tree")
    parts = [F.col("profile")[h] for h in range(HOURS)]
    measured = profiles.select(F.col("location_id").alias("node"), _squared(F.col("profile")).alias("q"),
                               *[p.alias(f"p{h}") for h, p in enumerate(parts)])
    ways = stored(_rooted(profiles, tree), "ways")
    count = profiles.count() - tree.count()  # a tree for each connected part

    def totals(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("q").alias("q"),
                                     F.array(*[F.sum(f"p{h}") for h in range(HOURS)]).alias("sums"))

    depth = Window.partitionBy("up")
    while count < segments:
        # Every zone but a root stands for the edge above it, and for the part of the segment that hangs from it.
        below = totals(ways.join(measured, "node"), "up").withColumnRenamed("up", "location_id")
        tops = ways.withColumn("below", F.count("*").over(depth)).groupBy("node").agg(
            F.max_by("up", F.struct("below", -F.col("up"))).alias("top"))
        whole = below.select(F.col("location_id").alias("top"), F.col("n").alias("all_n"), F.col("q").alias("all_q"),
                             F.col("sums").alias("all_sums"))
        above = ways.where("node != up")
        found = (below.join(tops.withColumnRenamed("node", "location_id"), "location_id").where("location_id != top")
                 .join(whole, "top"))
        rest = F.zip_with("all_sums", "sums", lambda x, y: x - y)
        gain = (_within(F.col("all_n"), F.col("all_q"), F.col("all_sums")) - _within(F.col("n"), F.col("q"), F.col("sums"))
                - _within(F.col("all_n") - F.col("n"), F.col("all_q") - F.col("q"), rest))
        parents = above.join(ways.groupBy("node").agg(F.count("*").alias("far")).withColumnRenamed("node", "up"), "up"
                             ).groupBy(F.col("node").alias("location_id")).agg(F.max_by("up", "far").alias("parent"))
        edge = F.struct("gain", -F.least("location_id", "parent"), -F.greatest("location_id", "parent"))
        best = (found.withColumn("gain", gain).join(parents, "location_id").where("gain > 0")
                .agg(F.max_by("location_id", edge).alias("cut")).first())
        if best["cut"] is None:
            break
        hanging = ways.where(F.col("up") == best["cut"]).select("node")
        kept_above = ways.join(hanging, "node", "left_anti")
        inside = ways.join(hanging, "node", "left_semi").join(
            hanging.withColumnRenamed("node", "up"), "up", "left_semi").select("node", "up")
        ways = stored(kept_above.unionByName(inside), "ways")
        count += 1
    size = ways.withColumn("below", F.count("*").over(depth)).groupBy("node").agg(
        F.max_by("up", F.struct("below", -F.col("up"))).alias("top"))
    named = size.withColumn("segment", F.min("node").over(Window.partitionBy("top")))
    return profiles.select("location_id", "trip_count").join(
        named.select(F.col("node").alias("location_id"), "segment"), "location_id")
