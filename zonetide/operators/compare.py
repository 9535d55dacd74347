"""Zones side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ZONES = 3

# Compared metrics, in display order.
METRICS = ("trip_count", "zone_score", "demand_score", "hotspot_component_score",
           "consistency_score", "avg_total_amount", "avg_trip_distance", "peak_weekday_name",
           "peak_hour", "priority_class")
SERIES = ("zone_score", "demand_score", "hotspot_component_score", "consistency_score")


def add_zone(chosen: Sequence[int], location_id: int) -> tuple[int, ...]:
    """Add a zone to a comparison; repeats and a fourth zone are refused."""
    if location_id in chosen:
        raise ValueError(f"Zone {location_id} is already being compared.")
    if len(chosen) >= MAX_ZONES:
        raise ValueError(f"At most {MAX_ZONES} zones can be compared.")
    return (*chosen, location_id)


def _chosen(details: DataFrame, location_ids: Sequence[int]) -> DataFrame:
    chosen: tuple[int, ...] = ()
    for location_id in location_ids:
        chosen = add_zone(chosen, location_id)
    if len(chosen) < 2:
        raise ValueError("At least 2 zones are needed for a comparison.")
    return details.where(F.col("location_id").isin(*chosen))


def _text(metric: str) -> Column:
    """The metric as text: numbers with two decimals, counts and hours as they are."""
    value = F.col(metric)
    if metric in ("trip_count", "peak_weekday_name", "priority_class"):
        shown = value.cast("string")
    elif metric == "peak_hour":
        shown = F.format_string("%02d:00", value)
    else:
        shown = value.cast("decimal(18,2)").cast("string")
    return F.when(value.isNull(), "-").otherwise(shown)


def compare_zones(details: DataFrame, location_ids: Sequence[int]) -> DataFrame:
    """One row per metric, one column ``zone_<id>`` per zone."""
    cells = [F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"),
                      _text(m).alias("value")) for i, m in enumerate(METRICS, start=1)]
    long = _chosen(details, location_ids).select(
        "location_id", F.explode(F.array(*cells)).alias("cell")).select("location_id", "cell.*")
    columns = [F.max(F.when(F.col("location_id") == i, F.col("value"))).alias(f"zone_{i}")
               for i in location_ids]
    return long.groupBy("position", "metric").agg(*columns).orderBy("position")


def comparison_series(details: DataFrame, location_ids: Sequence[int]) -> DataFrame:
    """The four score series of the compared zones; missing scores count as 0."""
    points = [F.struct(F.lit(i).alias("position"), F.lit(s).alias("series"),
                       F.coalesce(s, F.lit(0.0)).alias("value"))
              for i, s in enumerate(SERIES, start=1)]
    return (_chosen(details, location_ids)
            .select("location_id", "zone_name", F.explode(F.array(*points)).alias("p"))
            .select("location_id", "zone_name", "p.*").orderBy("location_id", "position"))
