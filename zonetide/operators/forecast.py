"""Same-weekday baseline forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters, check_range, iso_weekday
from zonetide.functions.numeric import ratio
from zonetide.operators.anomalies import spread, square


def demand_forecast(demand: DataFrame, filters: Filters = NO_FILTERS, forecast_days: int = 7,
                    history_weeks: int = 4) -> DataFrame:
    """Mean of the last ``history_weeks`` available dates with the same weekday.

    Covers the ``forecast_days`` days after the last date of the (borough-filtered)
    data; the band is one population standard deviation wide on each side. Dates whose
    weekday has no history drop out.
    """
    check_range("forecast_days", forecast_days, 1, 30)
    check_range("history_weeks", history_weeks, 2, 12)
    scoped = filters.only("borough").apply(demand)
    daily = scoped.groupBy("pickup_date").agg(F.sum("trip_count").alias("trip_count"))
    recent = Window.partitionBy("weekday").orderBy(F.desc("pickup_date"))
    # All forecast dates lie after the last date, so each weekday needs its history once.
    history = (
        daily.withColumn("weekday", iso_weekday("pickup_date").cast("smallint"))
        .withColumn("recency", F.row_number().over(recent))
        .where(F.col("recency") <= history_weeks)
        .groupBy("weekday").agg(
            F.count("*").alias("n"), F.sum("trip_count").alias("s"),
            F.sum(square("trip_count")).alias("q"))
    )
    n, s = F.col("n"), F.col("s")
    # n times the population standard deviation
    width = F.sqrt(spread(n, s, F.col("q")).cast("double"))

    def whole(value: Column) -> Column:
        return F.round(value, 0).cast("bigint")

    last_day = scoped.agg(F.max("pickup_date")).scalar()
    days = F.sequence(F.date_add("last_day", 1), F.date_add("last_day", forecast_days))
    dates = history.withColumn("last_day", last_day).withColumn("forecast_date", F.explode(days))
    return dates.where(iso_weekday("forecast_date") == F.col("weekday")).select(
        "forecast_date",
        "weekday",
        whole(ratio(s, n, 0)).alias("predicted_trip_count"),
        F.greatest(whole((s - width) / n), F.lit(0).cast("bigint")).alias("lower_bound"),
        whole((s + width) / n).alias("upper_bound"),
        n.cast("int").alias("sample_count"),
    ).orderBy("forecast_date")
