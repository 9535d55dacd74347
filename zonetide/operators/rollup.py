"""Hourly demand per zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.functions.numeric import ratio
from zonetide.schemas import ROLLUP_KEY

# Exact partial sums kept beside the rounded averages, so that rollups can be merged.
MEASURES = {
    "trip_distance": ("distance_sum", "distance_rows", "decimal(20,3)"),
    "trip_duration_seconds": ("duration_sum", "duration_rows", "bigint"),
    "total_amount": ("amount_sum", "amount_rows", "decimal(20,2)"),
}


def zone_hourly_demand(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips per pickup date, hour and zone, with averages and totals.

    Trips are counted by zone id first; the zone names are joined to the (much
    smaller) result. Sums combine before the shuffle, so one zone holding most of
    the trips costs nothing extra. Trips from unknown zones drop out.
    """
    sums = [F.count("*").alias("trip_count")]
    for source, (total, rows, dtype) in MEASURES.items():
        sums += [F.sum(source).cast(dtype).alias(total), F.count(source).alias(rows)]
    counted = trips.groupBy(
        "pickup_date", "pickup_hour", F.col("pickup_location_id").alias("location_id")
    ).agg(*sums)
    named = counted.join(zones.select("location_id", "zone_name", "borough"), "location_id")
    return _with_averages(named)


def merge_rollups(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Combine two rollups of disjoint trips."""
    sums = [F.sum("trip_count").alias("trip_count")]
    for total, rows, dtype in MEASURES.values():
        sums += [F.sum(total).cast(dtype).alias(total), F.sum(rows).alias(rows)]
    columns = [*ROLLUP_KEY, "trip_count",
               *[c for total, rows, _ in MEASURES.values() for c in (total, rows)]]
    both = current.select(*columns).unionByName(delta.select(*columns))
    return _with_averages(both.groupBy(*ROLLUP_KEY).agg(*sums))


def _with_averages(sums: DataFrame) -> DataFrame:
    def average(source: str, places: int):
        total, rows, _ = MEASURES[source]
        return ratio(F.col(total), F.col(rows), places)

    return sums.select(
        *ROLLUP_KEY,
        "trip_count",
        average("trip_distance", 3).cast("decimal(10,3)").alias("avg_trip_distance"),
        average("trip_duration_seconds", 2).cast("decimal(12,2)").alias("avg_duration_seconds"),
        average("total_amount", 2).cast("decimal(10,2)").alias("avg_total_amount"),
        F.col("amount_sum").alias("total_amount"),
        *[c for total, rows, _ in MEASURES.values() for c in (total, rows)],
    )
