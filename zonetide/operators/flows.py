"""Origin-destination analysis: flows between zones, their balance, and matrices fitted to given totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters, check_range
from zonetide.functions.numeric import ratio
from zonetide.plans.shared import stored

PAIR = ("origin_id", "destination_id")
ROUNDS_A_JOB = 4  # rounds of fitting in one plan, before their residual is looked at


def od_rollup(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips per pickup date, hour, origin and destination, with exact sums; a rollup beside the one by zone.

    Counts combine before the shuffle. Trips whose origin or destination is unknown drop out. ``borough`` is the origin's.
    """
    counted = trips.groupBy("pickup_date", "pickup_hour", F.col("pickup_location_id").alias("origin_id"),
                            F.col("dropoff_location_id").alias("destination_id")).agg(
        F.count("*").alias("trip_count"),
        F.sum("trip_duration_seconds").cast("bigint").alias("duration_sum"),
        F.sum("total_amount").cast("decimal(20,2)").alias("amount_sum"))
    origins = zones.select(F.col("location_id").alias("origin_id"), "borough")
    destinations = zones.select(F.col("location_id").alias("destination_id"))
    return counted.join(origins, "origin_id").join(destinations, "destination_id")


def od_matrix(flows: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """Trips of each pair of zones that has some: number, share of the origin's and of the destination's trips (6
    decimals), mean duration and amount. Filters concern the pickup."""
    totals = filters.apply(flows).groupBy(*PAIR).agg(
        F.sum("trip_count").alias("trip_count"), F.sum("duration_sum").alias("seconds"),
        F.sum("amount_sum").alias("amount"))
    # Totals of the matrix, not of the flows: one more small shuffle each, joined by zone.
    out = totals.groupBy("origin_id").agg(F.sum("trip_count").alias("out"))
    into = totals.groupBy("destination_id").agg(F.sum("trip_count").alias("into"))
    n = F.col("trip_count")
    return totals.join(out, "origin_id").join(into, "destination_id").select(
        *PAIR, "trip_count", ratio(n, F.col("out"), 6).cast("double").alias("origin_share"),
        ratio(n, F.col("into"), 6).cast("double").alias("destination_share"),
        ratio(F.col("seconds"), n, 2).cast("double").alias("avg_duration_seconds"),
        ratio(F.col("amount"), n, 2).cast("double").alias("avg_total_amount"))


def flow_balance(flows: DataFrame, zones: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """Trips that leave, reach and stay inside every zone, their difference, and how many zones they go to and
    come from. All zones of the borough are listed; their flows are those whose pickup the other filters hold for."""
    pairs = filters.without("borough").apply(flows).groupBy(*PAIR).agg(F.sum("trip_count").alias("n"))
    n, inside = F.col("n"), F.col("origin_id") == F.col("destination_id")

    def side(key: str, name: str) -> DataFrame:
        return pairs.groupBy(F.col(key).alias("location_id")).agg(
            F.sum(F.when(~inside, n)).alias(f"{name}_trips"), F.sum(F.when(inside, n)).alias(f"{name}_inside"),
            F.count(F.when(~inside, 1)).alias(f"{name}_zones"))

    def count(name: str):
        return F.coalesce(name, F.lit(0)).cast("bigint")

    rows = (filters.select_zones(zones).select("location_id", "zone_name", "borough")
            .join(side("origin_id", "out"), "location_id", "left").join(side("destination_id", "in"), "location_id", "left"))
    return rows.select(
        "location_id", "zone_name", "borough", count("out_trips").alias("outflow"), count("in_trips").alias("inflow"),
        count("out_inside").alias("internal"), (count("in_trips") - count("out_trips")).alias("net_inflow"),
        count("out_zones").cast("int").alias("destinations"), count("in_zones").cast("int").alias("origins"))


def balanced(seed: DataFrame, origins: DataFrame, destinations: DataFrame, limit: float = 1e-9,
             most_rounds: int = 200) -> DataFrame:
    """The matrix with the totals given that is nearest to ``seed``, by iterative proportional fitting.

    ``seed`` has origin_id, destination_id, trip_count; ``origins`` (origin_id, total) and ``destinations``
    (destination_id, total) say what its rows and columns shall sum up to. Rows and columns are scaled in turn until, with
    the rows right, no column is off by more than ``limit`` of the overall total. Cells without trips stay without; zones without a total get 0.
    Only the factors of rows and columns are carried from round to round; what is summed combines before each shuffle.

    Columns: the pair, trip_count, ``fitted`` (double) and ``residual``, the part of the overall total that a column is
    still off by at most: above ``limit`` where no matrix with the seed's cells has these totals or ``most_rounds`` were too few.
    """
    check_range("most_rounds", most_rounds, 1, 10_000)
    rows, columns = PAIR
    # Stored, as every job reads them.
    cells = stored(seed.where("trip_count > 0").select(*PAIR, F.col("trip_count").cast("double").alias("cell")), "cells")
    wanted = {key: stored(given.select(key, F.col("total").cast("double").alias("total")), "totals")
              for key, given in ((rows, origins), (columns, destinations))}
    overall = wanted[rows].agg(F.sum("total")).first()[0] or 0.0

    def summed(by: str, other: str, factors: DataFrame) -> DataFrame:
        return cells.join(factors, other).groupBy(by).agg(F.sum(F.col("cell") * F.col("factor")).alias("now"))

    def scaled(by: str, other: str, factors: DataFrame) -> DataFrame:
        """The factors with which the rows (or columns) have the totals wanted."""
        return summed(by, other, factors).join(wanted[by], by, "left").select(
            by, F.coalesce(F.col("total") / F.nullif(F.col("now"), F.lit(0.0)), F.lit(0.0)).alias("factor"))

    down = cells.select(columns).distinct().withColumn("factor", F.lit(1.0))
    done, residual = 0, None
    while residual is None or (residual > limit and done < most_rounds):
        for _ in range(ROUNDS_A_JOB):
            across = scaled(rows, columns, down)
            down = scaled(columns, rows, across)
        down = stored(down, "columns")
        done += ROUNDS_A_JOB
        across = stored(scaled(rows, columns, down), "rows")
        # The rows are right now; the columns tell how far that puts them off.
        now = summed(columns, rows, across).join(down, columns).join(wanted[columns], columns, "left")
        off = now.agg(F.max(F.abs(F.col("now") * F.col("factor") - F.coalesce("total", F.lit(0.0))))).first()[0]
        residual = (off or 0.0) / overall if overall else 0.0
    fitted = cells.join(across.withColumnRenamed("factor", "_r"), rows).join(
        down.withColumnRenamed("factor", "_c"), columns)
    return fitted.select(*PAIR, F.col("cell").cast("bigint").alias("trip_count"),
                         (F.col("cell") * F.col("_r") * F.col("_c")).alias("fitted"), F.lit(residual).alias("residual"))
