"""Accessibility: what can be reached from each zone within a time.

Zones that touch are joined by links that take some seconds. Shortest times from all zones are found together, by rounds
of relaxation: only the pairs that became faster in a round are carried on in the next, and no further than the longest
time asked for. Times are whole seconds, so sums are exact and results don't depend on the order of rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.filters import check_range
from zonetide.functions.numeric import ratio
from zonetide.plans.shared import stored

MINUTES = (15, 30, 60)


def link_times(flows: DataFrame, adjacency: DataFrame, default_seconds: int = 900) -> DataFrame:
    """Seconds from each zone to each that touches it: the mean of the trips between them, ``default_seconds``
    where there were none, one second at least."""
    check_range("default_seconds", default_seconds, 1, 86_400)
    means = flows.groupBy("origin_id", "destination_id").agg(
        ratio(F.sum("duration_sum"), F.sum("trip_count"), 0).cast("bigint").alias("mean"))
    links = adjacency.select(F.col("location_id").alias("origin_id"), F.col("neighbour_id").alias("destination_id"))
    return links.join(means, ["origin_id", "destination_id"], "left").select(
        "origin_id", "destination_id",
        F.greatest(F.coalesce("mean", F.lit(default_seconds).cast("bigint")), F.lit(1)).alias("seconds"))


def shortest_times(places: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """(origin_id, destination_id, seconds) of all pairs at most ``limit`` seconds apart, each place with itself included.

    ``places`` has location_id, ``links`` origin_id, destination_id and seconds (over 0; nulls and links between
    unknown places don't count). Ways of one link are known from the start; each round adds a link, as long as some pair that became
    faster lies so far within the limit that the shortest link leads on. A link is used only by the pairs that reach its start,
    so work follows what lies within the limit, not all pairs.
    """
    known = stored(places.select("location_id").distinct(), "places")
    ends = known.withColumnRenamed("location_id", "destination_id")
    starts = known.withColumnRenamed("location_id", "origin_id")
    # A way back to a place itself is never faster than to stay.
    usable = stored(links.where((F.col("seconds") > 0) & (F.col("seconds") <= limit) & (F.col("origin_id") != F.col("destination_id")))
                    .groupBy("origin_id", "destination_id").agg(F.min("seconds").cast("bigint").alias("step"))
                    .join(ends, "destination_id", "left_semi").join(starts, "origin_id", "left_semi")
                    .select(F.col("origin_id").alias("destination_id"), F.col("destination_id").alias("next"), "step"),
                    "links")
    pair = ["origin_id", "destination_id"]
    shortest = usable.agg(F.min("step")).first()[0]
    itself = known.select(F.col("location_id").alias("origin_id"), F.col("location_id").alias("destination_id"),
                          F.lit(0).cast("bigint").alias("seconds"))
    if shortest is None:
        return itself

    def leading_on(found: DataFrame) -> DataFrame:
        return found.where(F.col("seconds") <= limit - shortest)

    direct = usable.select(F.col("destination_id").alias("origin_id"), F.col("next").alias("destination_id"),
                           F.col("step").alias("seconds"))
    best, frontier = itself.unionByName(direct), leading_on(direct)
    while not frontier.isEmpty():
        tried = (frontier.join(usable, "destination_id")
                 .select("origin_id", F.col("next").alias("destination_id"),
                         (F.col("seconds") + F.col("step")).alias("seconds"))
                 .where((F.col("seconds") <= limit) & (F.col("origin_id") != F.col("destination_id")))
                 .groupBy(*pair).agg(F.min("seconds").alias("seconds")))
        before = best.withColumnRenamed("seconds", "before")
        merged = stored(before.join(tried, pair, "full").select(
            *pair, F.least("before", "seconds").alias("seconds"),
            F.coalesce(F.col("seconds") < F.coalesce("before", F.lit(limit + 1)), F.lit(False)).alias("faster")), "times")
        best, frontier = merged.drop("faster"), leading_on(merged.where("faster").drop("faster"))
    return best


def accessibility(values: DataFrame, links: DataFrame, minutes: Sequence[int] = MINUTES) -> DataFrame:
    """For each zone and number of minutes: how many zones, and trips of theirs, can be reached, the zone's own
    included, their share of all trips (6 decimals), and the mean minutes to them, weighted by trips (2 decimals).

    ``values`` has location_id and trip_count. The share is null if there are no trips at all, the mean if none is reached.
    """
    check_range("minutes", min(minutes), 1, max(minutes))
    # Stored: what counts the trips is not done again for each use.
    values = stored(values.select("location_id", "trip_count"), "values")
    times = shortest_times(values, links, 60 * max(minutes))
    total = values.agg(F.sum("trip_count")).scalar()
    there = values.select(F.col("location_id").alias("destination_id"), "trip_count")
    bounds = F.array(*[F.lit(int(m)) for m in sorted(set(minutes))])
    reached = (times.join(there, "destination_id").withColumn("minutes", F.explode(bounds))
               .where(F.col("seconds") <= 60 * F.col("minutes")).groupBy("origin_id", "minutes").agg(
                   F.count("*").cast("int").alias("reachable_zones"), F.sum("trip_count").alias("reachable_trips"),
                   F.sum(F.col("seconds") * F.col("trip_count")).alias("weighted")))
    trips = F.col("reachable_trips")
    return reached.withColumn("_total", total).select(
        F.col("origin_id").alias("location_id"), "minutes", "reachable_zones", "reachable_trips",
        ratio(trips, F.col("_total"), 6).cast("double").alias("trip_share"),
        ratio(F.col("weighted"), 60 * trips, 2).cast("double").alias("mean_minutes"))
