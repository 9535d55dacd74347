"""Days on which a zone's demand leaves its usual range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters, check_range, iso_weekday
from zonetide.functions.numeric import ratio

ITEM_COLUMNS = ("pickup_date", "trip_count", "expected_trip_count", "deviation_amount",
                "deviation_percentage", "z_score", "anomaly_type")


def spread(days: Column, total: Column, squares: Column) -> Column:
    """n * sum(x^2) - (sum x)^2, exactly."""
    n, s, q = (c.cast("decimal(38,0)") for c in (days, total, squares))
    return n * q - s * s


def sample_deviation(days: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two days."""
    pairs = (days * (days - 1)).cast("double")
    return F.when(days > 1, F.sqrt(spread(days, total, squares).cast("double") / pairs)
                  ).otherwise(0.0)


def square(value: str | Column) -> Column:
    wide = (F.col(value) if isinstance(value, str) else value).cast("decimal(19,0)")
    return wide * wide


def scored_days(demand: DataFrame, filters: Filters = NO_FILTERS, analysis_days: int = 28,
                location_id: int | None = None) -> DataFrame:
    """Every calendar day of each zone's analysis window with the window's statistics.

    A window ends on the zone's last day with matching trips, or on ``date_to`` if that
    is earlier. Days without trips count as 0; a weekday filter also thins the calendar.
    """
    scoped = filters.only("hour", "weekday").apply(demand)
    if location_id is not None:
        scoped = scoped.where(F.col("location_id") == location_id)
    daily = scoped.groupBy("location_id", "pickup_date").agg(
        F.sum("trip_count").alias("trip_count"))
    latest = F.max("pickup_date")
    end = F.least(F.lit(filters.date_to), latest) if filters.date_to else latest
    calendar = (
        daily.groupBy("location_id").agg(end.alias("analysis_end"))
        .withColumn("analysis_start", F.date_sub("analysis_end", analysis_days - 1))
        .withColumn("pickup_date", F.explode(F.sequence("analysis_start", "analysis_end")))
    )
    if filters.weekday is not None:
        calendar = calendar.where(iso_weekday("pickup_date") == filters.weekday)
    days = calendar.join(daily, ["location_id", "pickup_date"], "left").withColumn(
        "trip_count", F.coalesce("trip_count", F.lit(0).cast("bigint")))
    day = F.struct("pickup_date", "trip_count")
    # At most ``analysis_days`` (<= 90) entries per zone.
    return days.groupBy("location_id", "analysis_start", "analysis_end").agg(
        F.count("*").alias("n"), F.sum("trip_count").alias("s"),
        F.sum(square("trip_count")).alias("q"), F.collect_list(day).alias("days"))


def zone_anomalies(demand: DataFrame, zones: DataFrame, filters: Filters = NO_FILTERS,
                   analysis_days: int = 28, z_threshold: float = 2.0,
                   location_id: int | None = None) -> DataFrame:
    """One row per zone: window, mean, deviation and the list of anomalous days.

    The days are ordered by the size of the rounded z-score, then by date, both
    descending. The threshold is compared with the unrounded z-score. A zone without
    matching trips has null dates and no observations.
    """
    check_range("analysis_days", analysis_days, 14, 90)
    check_range("z_threshold", z_threshold, 1.0, 4.0)
    if location_id is not None:
        zones = zones.where(F.col("location_id") == location_id)
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    windows = (
        scored_days(demand, filters, analysis_days, location_id)
        .withColumn("deviation", sample_deviation(n, s, q))
        # z = (x - s/n) / deviation = (n x - s) / z_unit
        .withColumn("z_unit", F.when(n > 1, F.sqrt(
            n * spread(n, s, q).cast("double") / (n - 1))).otherwise(0.0))
    )

    def item(day: Column) -> Column:
        off = n * day["trip_count"] - s
        z = F.when(F.col("z_unit") == 0, 0.0).otherwise(off / F.col("z_unit"))
        kind = F.when(z >= z_threshold, "High Demand").when(z <= -z_threshold, "Low Demand")
        return F.struct(
            day["pickup_date"].alias("pickup_date"),
            day["trip_count"].alias("trip_count"),
            ratio(s, n, 2).cast("double").alias("expected_trip_count"),
            ratio(off, n, 2).cast("double").alias("deviation_amount"),
            ratio(off * 100, s, 2).cast("double").alias("deviation_percentage"),
            F.round(z, 2).alias("z_score"),
            kind.alias("anomaly_type"))

    def order(a: Column, b: Column) -> Column:
        size_a, size_b = F.abs(a["z_score"]), F.abs(b["z_score"])
        return (F.when(size_a > size_b, -1).when(size_a < size_b, 1)
                .when(a["pickup_date"] > b["pickup_date"], -1)
                .when(a["pickup_date"] < b["pickup_date"], 1).otherwise(0))

    flagged = F.filter(F.transform("days", item), lambda d: d["anomaly_type"].isNotNull())
    found = windows.withColumn("items", F.array_sort(flagged, order))
    empty = F.array().cast(found.schema["items"].dataType)
    return (
        zones.select("location_id", "zone_name", "borough")
        .join(found, "location_id", "left")
        .select(
            "location_id", "zone_name", "borough",
            F.lit(analysis_days).alias("analysis_days"),
            "analysis_start", "analysis_end",
            F.coalesce(n, F.lit(0)).cast("int").alias("observation_count"),
            F.coalesce(ratio(s, n, 2).cast("double"), F.lit(0.0)).alias("mean_daily_trips"),
            F.coalesce(F.round("deviation", 2), F.lit(0.0)).alias("standard_deviation"),
            F.lit(float(z_threshold)).alias("z_threshold"),
            F.coalesce(F.size("items"), F.lit(0)).alias("anomaly_count"),
            F.coalesce("items", empty).alias("items"))
    )


def anomaly_items(anomalies: DataFrame) -> DataFrame:
    """One row per anomalous day."""
    return anomalies.select("location_id", F.explode("items").alias("i")).select(
        "location_id", *[f"i.{c}" for c in ITEM_COLUMNS])
