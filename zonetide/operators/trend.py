"""Demand of the latest days against the days before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters, check_range
from zonetide.functions.numeric import ratio

# Fixed value: percentage beyond which demand counts as rising or falling.
STABLE_BAND = 5


def trend_direction(current: Column, previous: Column, change: Column) -> Column:
    return (
        F.when((current == 0) & (previous == 0), "No Data")
        .when((previous == 0) & (current > 0), "Rising")
        .when(change > STABLE_BAND, "Rising")
        .when(change < -STABLE_BAND, "Falling")
        .otherwise("Stable")
    )


def zone_trend(demand: DataFrame, zones: DataFrame, filters: Filters = NO_FILTERS,
               period_days: int = 7, location_id: int | None = None) -> DataFrame:
    """Trips of the latest ``period_days`` days against as many days before, per zone.

    The period ends on the last date with any matching trips in any zone, or on
    ``date_to`` if that is earlier. Only the hour and weekday filters apply besides.
    """
    check_range("period_days", period_days, 2, 30)
    scoped = filters.only("hour", "weekday").apply(demand)
    latest = F.max("pickup_date")
    end = F.least(F.lit(filters.date_to), latest) if filters.date_to else latest
    # One value, known before the scan, which can then skip everything earlier.
    last_day = scoped.agg(end).scalar()
    if location_id is not None:
        scoped = scoped.where(F.col("location_id") == location_id)
        zones = zones.where(F.col("location_id") == location_id)
    window = scoped.where(
        (F.col("pickup_date") >= F.date_sub(last_day, 2 * period_days - 1))
        & (F.col("pickup_date") <= last_day))
    is_current = F.col("pickup_date") >= F.date_sub(last_day, period_days - 1)
    totals = window.groupBy("location_id").agg(
        F.sum(F.when(is_current, F.col("trip_count")).otherwise(0)).alias("current"),
        F.sum(F.when(is_current, 0).otherwise(F.col("trip_count"))).alias("previous"))

    def before(days: int) -> Column:
        return F.date_sub("current_period_end", days)

    current, previous = F.col("current_period_trip_count"), F.col("previous_period_trip_count")
    change = F.col("change_percentage")
    return (
        zones.select("location_id", "zone_name", "borough")
        .withColumn("current_period_end", last_day)
        .join(totals, "location_id", "left")
        .select(
            "location_id", "zone_name", "borough",
            F.lit(period_days).alias("period_days"),
            before(period_days - 1).alias("current_period_start"),
            "current_period_end",
            before(2 * period_days - 1).alias("previous_period_start"),
            before(period_days).alias("previous_period_end"),
            F.coalesce("current", F.lit(0).cast("bigint")).alias("current_period_trip_count"),
            F.coalesce("previous", F.lit(0).cast("bigint")).alias("previous_period_trip_count"))
        .withColumn("change_amount", current - previous)
        .withColumn("change_percentage",
                    ratio(F.col("change_amount") * 100, previous, 2))
        .withColumn("trend_direction", trend_direction(current, previous, change))
        .withColumn("change_percentage", change.cast("double"))
        .orderBy("location_id")
    )
