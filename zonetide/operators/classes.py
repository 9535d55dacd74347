"""Percentile demand classes of zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters
from zonetide.functions.percentile import zone_cume_dist, zone_grain
from zonetide.labels import DEMAND_CLASSES, lookup
from zonetide.operators.demand import mean_amount, mean_distance, trip_total

# Upper percentile bounds of classes 1..4.
CLASS_BOUNDS = (0.20, 0.40, 0.60, 0.80)


def demand_class_id(percentile: Column) -> Column:
    """Class 1..5 by percentile; 0 where there is no percentile."""
    chain = F.lit(5)
    for number, bound in reversed(list(enumerate(CLASS_BOUNDS, start=1))):
        chain = F.when(percentile <= bound, number).otherwise(chain)
    return F.when(percentile.isNull(), 0).otherwise(chain).cast("smallint")


def demand_classes(demand: DataFrame, zones: DataFrame,
                   filters: Filters = NO_FILTERS) -> DataFrame:
    """Demand class of every selected zone, with its geometry.

    Percentiles are taken among the zones that have trips.
    """
    measured = (
        zone_grain(filters.apply(demand)).groupBy("location_id")
        .agg(trip_total(), mean_amount(), mean_distance())
        .where(F.col("trip_count") > 0)
        .withColumn("percentile", zone_cume_dist("trip_count"))
    )
    class_id = demand_class_id(F.col("percentile"))
    return (
        filters.select_zones(zones)
        .join(measured, "location_id", "left")
        .select(
            "location_id", "zone_name", "borough",
            F.coalesce("trip_count", F.lit(0).cast("bigint")).alias("trip_count"),
            "avg_total_amount", "avg_trip_distance",
            class_id.alias("demand_class_id"),
            lookup(class_id, dict(enumerate(DEMAND_CLASSES))).alias("demand_class"),
            *[c for c in zones.columns if c == "geom"])
    )
