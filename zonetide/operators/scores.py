"""Weighted zone scores and zone details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters, iso_weekday
from zonetide.functions.numeric import percent_of, ratio
from zonetide.functions.percentile import zone_cume_dist, zone_grain
from zonetide.labels import HOTSPOT_CLASSES, PRIORITY_CLASSES, WEEKDAYS, lookup
from zonetide.operators.hotspots import hotspot_score, neighbour_stats, with_geometry

# Weights of the score parts, points per hotspot score, class bounds.
DEMAND_WEIGHT = "0.50"
HOTSPOT_WEIGHT = "0.30"
CONSISTENCY_WEIGHT = "0.20"
HOTSPOT_POINTS = {-2: 0, -1: 25, 0: 50, 1: 75, 2: 100}
PRIORITY_BOUNDS = (20, 40, 60, 80)

SCORE_COLUMNS = ("demand_score", "hotspot_component_score", "consistency_score", "zone_score")


def priority_class(score: Column) -> Column:
    chain = F.lit(PRIORITY_CLASSES[0])
    for bound, name in zip(PRIORITY_BOUNDS, PRIORITY_CLASSES[1:], strict=True):
        chain = F.when(score >= bound, name).otherwise(chain)
    return chain


def weighted_score(demand: Column, hotspot: Column, consistency: Column) -> Column:
    def part(score: Column, weight: str) -> Column:
        return score.cast("decimal(7,2)") * F.lit(weight).cast("decimal(3,2)")

    return F.round(part(demand, DEMAND_WEIGHT) + part(hotspot, HOTSPOT_WEIGHT)
                   + part(consistency, CONSISTENCY_WEIGHT), 2)


HOURS, WEEKDAYS_ISO = range(24), range(1, 8)


def _daily(scoped: DataFrame) -> DataFrame:
    """Totals of each zone and day, the trips of each hour in columns of their own."""
    weighted = F.col("avg_trip_distance") * F.col("trip_count").cast("decimal(14,0)")
    return scoped.groupBy("location_id", "pickup_date").agg(
        F.sum("trip_count").alias("trip_count"),
        F.sum("total_amount").alias("total_amount"),
        F.sum(weighted).alias("weighted_distance"),
        *[F.sum(F.when(F.col("pickup_hour") == h, F.col("trip_count"))).alias(f"hour_{h}")
          for h in HOURS])


def _peak_parts() -> list[Column]:
    """Trips of each hour and weekday, from the totals of the days."""
    weekday = iso_weekday("pickup_date")
    return [*[F.sum(f"hour_{h}").alias(f"hour_{h}") for h in HOURS],
            *[F.sum(F.when(weekday == w, F.col("trip_count"))).alias(f"weekday_{w}")
              for w in WEEKDAYS_ISO]]


def _busiest(unit: str, values: range) -> Column:
    """The hour or weekday with most trips, of those that have any; ties go to the smaller one."""
    totals = [F.when(F.col(f"{unit}_{v}").isNotNull(),
                     F.struct(F.col(f"{unit}_{v}").alias("n"), F.lit(-v).alias("less")))
              for v in values]
    return (-F.array_max(F.array(*totals))["less"]).cast("int")


def _scored(demand: DataFrame, zones: DataFrame, adjacency: DataFrame,
            filters: Filters) -> DataFrame:
    """Every selected zone with the parts of its score (exact decimals) and its peaks."""
    scoped = filters.apply(demand)
    days = scoped.agg(F.countDistinct("pickup_date").cast("int")).scalar()
    per_zone = _daily(scoped).groupBy("location_id").agg(
        F.sum("trip_count").alias("trip_count"),
        F.count("*").cast("int").alias("active_day_count"),
        ratio(F.sum("total_amount"), F.sum("trip_count"), 2).alias("avg_total_amount"),
        ratio(F.sum("weighted_distance"), F.sum("trip_count"), 2).alias("avg_trip_distance"),
        *_peak_parts())
    per_zone = per_zone.select(
        "location_id", "trip_count", "active_day_count", "avg_total_amount", "avg_trip_distance",
        _busiest("hour", HOURS).cast("smallint").alias("peak_hour"),
        _busiest("weekday", WEEKDAYS_ISO).alias("peak_weekday"))
    selected = (
        filters.select_zones(zones).select("location_id", "zone_name", "borough")
        .join(per_zone, "location_id", "left")
        .withColumns({
            "trip_count": F.coalesce("trip_count", F.lit(0).cast("bigint")),
            "active_day_count": F.coalesce("active_day_count", F.lit(0)),
            "total_day_count": days,
        })
    )
    around = neighbour_stats(zone_grain(selected), adjacency).withColumn(
        "around_share", zone_cume_dist("neighbour_mean"))
    has_trips = F.col("trip_count") > 0
    # Partitioned by "has trips": zones without trips stay out of the ranking.
    ranked = around.withColumn("zone_share", F.when(has_trips, zone_cume_dist(
        "trip_count", has_trips)))
    score = hotspot_score(F.col("zone_share"), F.col("around_share"), F.col("neighbour_count"))
    parts = ranked.withColumns({
        "demand_score": percent_of(F.coalesce("zone_share", F.lit(0.0))),
        "hotspot_score": score,
        "consistency_score": F.coalesce(
            ratio(F.col("active_day_count") * 100, F.col("total_day_count"), 2), F.lit(0)),
    })
    points = F.lit(None).cast("int")
    for value, number in HOTSPOT_POINTS.items():
        points = F.when(F.col("hotspot_score") == value, number).otherwise(points)
    return parts.withColumn("hotspot_component_score", points).withColumn(
        "zone_score", weighted_score(F.col("demand_score"), F.col("hotspot_component_score"),
                                     F.col("consistency_score")))


def _as_doubles(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]


def zone_scores(demand: DataFrame, zones: DataFrame, adjacency: DataFrame,
                filters: Filters = NO_FILTERS) -> DataFrame:
    """0.5 demand + 0.3 hotspot + 0.2 consistency.

    Demand is ranked among zones with trips only, and the neighbours' mean unrounded.
    """
    scores = _scored(demand, zones, adjacency, filters).select(
        "location_id", "zone_name", "borough", "trip_count", "active_day_count",
        "total_day_count", *_as_doubles(*SCORE_COLUMNS),
        priority_class(F.col("zone_score")).alias("priority_class"))
    return with_geometry(scores, zones)


def peaks(demand: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """Busiest hour and weekday of each zone; ties go to the smaller one."""
    totals = _daily(filters.apply(demand)).groupBy("location_id").agg(*_peak_parts())
    return totals.select("location_id", _busiest("hour", HOURS).cast("smallint").alias("peak_hour"),
                         _busiest("weekday", WEEKDAYS_ISO).alias("peak_weekday"))


def zone_details(demand: DataFrame, zones: DataFrame, adjacency: DataFrame,
                 filters: Filters = NO_FILTERS, location_id: int | None = None) -> DataFrame:
    """Scores, averages, activity and peaks of one zone or each selected zone.

    A zone outside the borough filter has no row. Percentiles always run over all
    selected zones, so ``location_id`` only narrows the result.
    """
    scored = _scored(demand, zones, adjacency, filters)
    if location_id is not None:
        scored = scored.where(F.col("location_id") == location_id)
    weekday_names = dict(enumerate(WEEKDAYS, start=1))
    return scored.select(
        "location_id", "zone_name", "borough", "trip_count",
        *_as_doubles("avg_total_amount", "avg_trip_distance"),
        "active_day_count", "total_day_count", "peak_weekday",
        lookup(F.col("peak_weekday"), weekday_names).alias("peak_weekday_name"),
        "peak_hour", *_as_doubles(*SCORE_COLUMNS),
        lookup(F.col("hotspot_score"), HOTSPOT_CLASSES).alias("hotspot_class"),
        priority_class(F.col("zone_score")).alias("priority_class"))
