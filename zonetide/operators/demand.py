"""Dashboard questions on the hourly rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters, check_range, iso_weekday
from zonetide.functions.numeric import ratio


def trip_total() -> Column:
    return F.coalesce(F.sum("trip_count"), F.lit(0)).cast("bigint").alias("trip_count")


def mean_amount() -> Column:
    """Total money per trip; trips without an amount count as zero."""
    return (ratio(F.sum("total_amount"), F.sum("trip_count"), 2)
            .cast("double").alias("avg_total_amount"))


def mean_distance() -> Column:
    """Trip-weighted mean of the rounded hourly distances."""
    weighted = F.sum(F.col("avg_trip_distance") * F.col("trip_count").cast("decimal(14,0)"))
    return ratio(weighted, F.sum("trip_count"), 2).cast("double").alias("avg_trip_distance")


def dataset_summary(trips: DataFrame, rejects: DataFrame, zones: DataFrame) -> DataFrame:
    """Row counts, pickup range and mean distance and amount of the loaded data."""
    totals = trips.agg(
        F.count("*").alias("total_trips"),
        F.min("pickup_datetime").alias("earliest_pickup"),
        F.max("pickup_datetime").alias("latest_pickup"),
        ratio(F.sum("trip_distance"), F.count("trip_distance"), 2)
        .cast("double").alias("average_trip_distance"),
        ratio(F.sum("total_amount"), F.count("total_amount"), 2)
        .cast("double").alias("average_total_amount"),
    )
    return totals.select(
        "total_trips",
        rejects.agg(F.count("*")).scalar().alias("rejected_trips"),
        zones.agg(F.count("*")).scalar().alias("total_zones"),
        "earliest_pickup", "latest_pickup", "average_trip_distance", "average_total_amount",
    )


def summary(demand: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """Total trips, zones with trips, mean amount and mean distance."""
    per_zone = filters.apply(demand).groupBy("location_id").agg(
        F.sum("trip_count").alias("trip_count"),
        F.sum("total_amount").alias("total_amount"),
        F.sum(F.col("avg_trip_distance") * F.col("trip_count").cast("decimal(14,0)"))
        .alias("weighted_distance"),
    )
    trips = F.sum("trip_count")
    return per_zone.agg(
        F.coalesce(trips, F.lit(0)).cast("bigint").alias("total_trips"),
        F.count("*").cast("int").alias("active_zones"),
        ratio(F.sum("total_amount"), trips, 2).cast("double").alias("avg_total_amount"),
        ratio(F.sum("weighted_distance"), trips, 2).cast("double").alias("avg_trip_distance"),
    )


def daily_trend(demand: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """Trips and mean amount per date; dates without trips are absent."""
    return (filters.apply(demand).groupBy("pickup_date")
            .agg(trip_total(), mean_amount()).orderBy("pickup_date"))


def weekday_hour(demand: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """Trips per ISO weekday and hour. Hour and weekday filters do not apply."""
    scoped = filters.only("borough", "date_from", "date_to").apply(demand)
    return (
        scoped.groupBy(iso_weekday("pickup_date").cast("smallint").alias("weekday"), "pickup_hour")
        .agg(trip_total()).orderBy("weekday", "pickup_hour")
    )


def _series(low: int, high: int) -> Column:
    return F.explode(F.sequence(F.lit(low).cast("smallint"), F.lit(high).cast("smallint")))


def weekday_hour_dense(spark: SparkSession, demand: DataFrame,
                       filters: Filters = NO_FILTERS) -> DataFrame:
    """The full 7 x 24 grid, 0 where there were no trips."""
    grid = (spark.range(1).select(_series(1, 7).alias("weekday"))
            .select("weekday", _series(0, 23).alias("pickup_hour")))
    cells = weekday_hour(demand, filters)
    return (
        grid.join(cells, ["weekday", "pickup_hour"], "left")
        .select("weekday", "pickup_hour",
                F.coalesce("trip_count", F.lit(0).cast("bigint")).alias("trip_count"))
        .orderBy("weekday", "pickup_hour")
    )


def heatmap_intensity(spark: SparkSession, demand: DataFrame,
                      filters: Filters = NO_FILTERS) -> DataFrame:
    """Dense grid with each cell's share of the busiest cell and its band 0..4."""
    cells = weekday_hour_dense(spark, demand, filters)
    # 168 rows: the window over all of them replaces a second pass over the rollup.
    busiest = F.max("trip_count").over(Window.partitionBy())
    share = F.when(busiest > 0, F.col("trip_count") / busiest).otherwise(0.0)
    return (
        cells.withColumn("intensity", share)
        .withColumn(
            "band",
            F.when(F.col("trip_count") <= 0, 0)
            .when(F.col("intensity") >= 0.75, 4)
            .when(F.col("intensity") >= 0.50, 3)
            .when(F.col("intensity") >= 0.25, 2)
            .otherwise(1).cast("smallint"))
        .orderBy("weekday", "pickup_hour")
    )


def boroughs(zones: DataFrame) -> DataFrame:
    return zones.where(F.col("borough").isNotNull()).select("borough").distinct().orderBy("borough")


def zone_by_id(zones: DataFrame, location_id: int) -> DataFrame:
    """The zone's row, or ``LookupError`` when the id is unknown (a one-row check)."""
    found = zones.where(F.col("location_id") == location_id).select(
        "location_id", "zone_name", "borough")
    if found.isEmpty():
        raise LookupError(f"Zone {location_id} not found.")
    return found


def _top(ranked: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` busiest zones with their position; ties go to the smaller id."""
    order = [F.desc("trip_count"), F.asc("location_id")]
    kept = ranked.orderBy(*order).limit(limit)
    # At most ``limit`` rows reach this window.
    return kept.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def zone_ranking(demand: DataFrame, filters: Filters = NO_FILTERS, limit: int = 10) -> DataFrame:
    """Busiest zones under the filters."""
    check_range("limit", limit, 1, 50)
    return _top(
        filters.apply(demand).groupBy("location_id", "zone_name", "borough")
        .agg(trip_total(), mean_amount(), mean_distance()),
        limit)


def top_zones(trips: DataFrame, zones: DataFrame, limit: int = 10) -> DataFrame:
    """Busiest zones over all loaded trips; plain averages of the non-null values."""
    check_range("limit", limit, 1, 100)
    counted = trips.groupBy(F.col("pickup_location_id").alias("location_id")).agg(
        F.count("*").alias("trip_count"),
        ratio(F.sum("trip_distance"), F.count("trip_distance"), 2)
        .cast("double").alias("avg_trip_distance"),
        ratio(F.sum("total_amount"), F.count("total_amount"), 2)
        .cast("double").alias("avg_total_amount"),
    )
    names = zones.select("location_id", "zone_name", "borough")
    return _top(counted.join(names, "location_id"), limit).select(
        "location_id", "zone_name", "borough", "trip_count", "avg_trip_distance",
        "avg_total_amount", "position")


def zone_hourly(demand: DataFrame, filters: Filters = NO_FILTERS,
                location_id: int | None = None) -> DataFrame:
    """Trips and mean amount by hour, for one zone or each zone.

    Only the weekday and date filters apply.
    """
    scoped = filters.only("weekday", "date_from", "date_to").apply(demand)
    if location_id is not None:
        scoped = scoped.where(F.col("location_id") == location_id)
    return (scoped.groupBy("location_id", "pickup_hour").agg(trip_total(), mean_amount())
            .orderBy("location_id", "pickup_hour"))


def zone_hourly_dense(demand: DataFrame, zones: DataFrame, filters: Filters = NO_FILTERS,
                      location_id: int | None = None) -> DataFrame:
    """All 24 hours per zone, 0 where there were no trips."""
    ids = zones.select("location_id")
    if location_id is not None:
        ids = ids.where(F.col("location_id") == location_id)
    hours = ids.select("location_id", _series(0, 23).alias("pickup_hour"))
    profile = zone_hourly(demand, filters, location_id)
    return (
        hours.join(profile, ["location_id", "pickup_hour"], "left")
        .select("location_id", "pickup_hour",
                F.coalesce("trip_count", F.lit(0).cast("bigint")).alias("trip_count"))
        .orderBy("location_id", "pickup_hour")
    )


def has_demand(result: DataFrame) -> bool:
    """Whether any zone of a map result has trips."""
    return not result.where(F.col("trip_count") > 0).limit(1).isEmpty()
