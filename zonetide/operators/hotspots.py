"""Zones and their neighbourhoods: hotspots and coldspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters
from zonetide.functions.numeric import quotient
from zonetide.functions.percentile import zone_cume_dist, zone_grain
from zonetide.labels import HOTSPOT_CLASSES, lookup


def neighbour_stats(selected: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Number of neighbours and their mean trip count, for each selected zone.

    Only neighbours among the selected zones count. Zones without one get 0 and 0.
    """
    counts = selected.select(F.col("location_id").alias("neighbour_id"),
                             F.col("trip_count").alias("neighbour_trips"))
    stats = (
        adjacency.join(counts, "neighbour_id")
        .groupBy("location_id")
        .agg(F.count("*").cast("int").alias("neighbour_count"),
             quotient(F.sum("neighbour_trips"), F.count("*")).alias("neighbour_mean"))
    )
    return selected.join(stats, "location_id", "left").withColumns({
        "neighbour_count": F.coalesce("neighbour_count", F.lit(0)),
        "neighbour_mean": F.coalesce("neighbour_mean", F.lit(0).cast("decimal(38,17)")),
    })


def with_geometry(result: DataFrame, zones: DataFrame) -> DataFrame:
    """Add the zones' ``geom``, if they have one.

    Joined last: the rankings before it run in one task, where boundaries have no place.
    """
    if "geom" not in zones.columns:
        return result
    return result.join(zones.select("location_id", "geom"), "location_id")


def hotspot_score(zone: Column, around: Column, neighbours: Column) -> Column:
    """-2..2 from the percentiles of a zone and of its neighbourhood; first match wins."""
    return (
        F.when(neighbours == 0, 0)
        .when((zone >= 0.80) & (around >= 0.80), 2)
        .when((zone >= 0.60) & (around >= 0.60), 1)
        .when((zone <= 0.20) & (around <= 0.20), -2)
        .when((zone <= 0.40) & (around <= 0.40), -1)
        .otherwise(0).cast("smallint")
    )


def hotspots(demand: DataFrame, zones: DataFrame, adjacency: DataFrame,
             filters: Filters = NO_FILTERS) -> DataFrame:
    """Hotspot class of every selected zone, with its geometry.

    Both percentiles run over all selected zones, those without trips included; the
    neighbours' mean is ranked after rounding to 2 decimals.
    """
    counted = filters.apply(demand).groupBy("location_id").agg(
        F.sum("trip_count").alias("trip_count"))
    selected = (
        filters.select_zones(zones).select("location_id", "zone_name", "borough")
        .join(counted, "location_id", "left")
        .withColumn("trip_count", F.coalesce("trip_count", F.lit(0).cast("bigint")))
    )
    ranked = (
        neighbour_stats(zone_grain(selected), adjacency)
        .withColumn("neighbour_avg_trip_count", F.round("neighbour_mean", 2))
        .withColumns({"zone_share": zone_cume_dist("trip_count"),
                      "around_share": zone_cume_dist("neighbour_avg_trip_count")})
    )
    score = hotspot_score(F.col("zone_share"), F.col("around_share"), F.col("neighbour_count"))
    return with_geometry(ranked.select(
        "location_id", "zone_name", "borough", "trip_count", "neighbour_count",
        F.col("neighbour_avg_trip_count").cast("double").alias("neighbour_avg_trip_count"),
        score.alias("hotspot_score"),
        lookup(score, HOTSPOT_CLASSES).alias("hotspot_class"),
    ), zones)
