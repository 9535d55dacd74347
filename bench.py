"""Times the headline queries and prints one JSON line.

A warehouse is filled first: zones and trips from $BENCH_SF_DIR (default sf0.1), once as
they are and once copied up to the 3.7 million trips and 265 zones that the published
scan the trips and answer the same question as the query without ``raw_``, all others read the hourly rollup. Each
time is the median of three runs after a warm-up, from building the query to fetching its rows
(large results are computed in full but not fetched); ``spread`` is the slowest run less the fastest.
Boundaries have 128 vertices each, common ones with their neighbours.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide import Filters, build_session
from zonetide.operators import demand as d
from zonetide.operators.adjacency import zone_adjacency
from zonetide.operators.anomalies import zone_anomalies
from zonetide.operators.classes import demand_classes
from zonetide.operators.cleaning import clean_trips
from zonetide.operators.export import to_features
from zonetide.operators.flows import od_matrix, od_rollup
from zonetide.operators.forecast import demand_forecast
from zonetide.operators.forecasting import forecast_comparison, holt_winters_forecast, sarima_forecast
from zonetide.operators.hotspots import hotspots
from zonetide.operators.rollup import zone_hourly_demand
from zonetide.operators.scores import zone_details, zone_scores
from zonetide.operators.spatial_statistics import gi_star, lisa, morans_i, zone_values
from zonetide.operators.trend import zone_trend
from zonetide.plans.warehouse import Warehouse
from zonetide.sources import fixtures as fx

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
REFERENCE_TRIPS = 3_700_000
REFERENCE_ZONES = 265
LARGE = ("rollup_build", "sf_zone_adjacency")  # results that stay distributed
WEEK = Filters(date_from=date(2024, 1, 8), date_to=date(2024, 1, 14))


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def reference_zones(spark: SparkSession) -> DataFrame:
    parcels = fx.bordered_parcels(spark, SF_DIR).where(F.col("location_id") < REFERENCE_ZONES)
    return parcels.withColumn("location_id", (F.col("location_id") + 1).cast("smallint"))


def reference_trips(spark: SparkSession) -> DataFrame:
    """Events copied to the reference's number of trips, spread over its number of zones."""
    events = fx.raw_trips(spark, SF_DIR)
    copies = max(1, round(REFERENCE_TRIPS / events.count()))
    zone = F.pmod(F.col("PULocationID") * 31 + F.col("copy") * 7 + F.col("source_row_number"),
                  F.lit(REFERENCE_ZONES)) + 1
    return (events.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
            .withColumns({"PULocationID": zone, "DOLocationID": zone}).drop("copy"))


def main() -> None:
    spark = build_session("zonetide-bench", master=f"local[{CPUS}]", **{
        "spark__sql__shuffle__partitions": CPUS, "spark__ui__enabled": "false",
        # Small writes would otherwise be merged into a single task.
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "2m",
        "spark__driver__memory": "12g", "spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="zonetide-bench-")
    times: dict[str, float] = {}

    # Load path at the reference's scale: clean, validate, append, roll up.
    landing = f"{root}/landing"
    (reference_trips(spark).drop("source_file", "source_row_number")
     .repartition(2 * int(CPUS)).write.parquet(landing))
    store = Warehouse(spark, f"{root}/reference")
    times["load_zones"] = timed(lambda: store.load_zones(reference_zones(spark)))
    times["load_trips"] = timed(lambda: store.load_trips(landing))

    # The test tables as they are.
    zones = fx.zones(spark, SF_DIR)
    clean_trips(fx.raw_trips(spark, SF_DIR), zones).valid.write.parquet(f"{root}/trips")
    zone_hourly_demand(fx.lineitem_trips(spark, SF_DIR), zones).write.parquet(f"{root}/long")
    long = spark.read.parquet(f"{root}/long")
    small_trips = spark.read.parquet(f"{root}/trips")

    trips, rollup = store.trips(), store.demand()
    store_zones, shapes, adjacency = store.zones(), store.published_zones(), store.adjacency()

    def raw_summary(filters: Filters) -> DataFrame:
        rows = filters.only("hour", "weekday", "date_from", "date_to").apply(trips)
        return d.summary(zone_hourly_demand(rows, store_zones), filters)

    queries = {
        "raw_zone_ranking": lambda: d.zone_ranking(zone_hourly_demand(trips, store_zones)),
        "zone_ranking": lambda: d.zone_ranking(rollup),
        "raw_date_filtered_summary": lambda: raw_summary(WEEK),
        "date_filtered_summary": lambda: d.summary(rollup, WEEK),
        "summary": lambda: d.summary(rollup),
        "daily_trend": lambda: d.daily_trend(rollup),
        "weekday_hour_heatmap": lambda: d.weekday_hour(rollup),
        "zone_hourly": lambda: d.zone_hourly(rollup, location_id=7),
        "dataset_summary": lambda: d.dataset_summary(trips, store.rejected_trips(), store_zones),
        "geojson_full": lambda: to_features(demand_classes(rollup, store_zones)),
        "geojson_simplified": lambda: to_features(demand_classes(rollup, shapes)),
        "zone_hotspots": lambda: hotspots(rollup, shapes, adjacency),
        "zone_scores": lambda: zone_scores(rollup, shapes, adjacency),
        "zone_details": lambda: zone_details(rollup, shapes, adjacency, location_id=7),
        "zone_trend": lambda: zone_trend(rollup, store_zones),
        "zone_anomalies": lambda: zone_anomalies(rollup, store_zones),
        "demand_forecast": lambda: demand_forecast(rollup),
        "zone_gi_star": lambda: gi_star(zone_values(rollup, store_zones), adjacency),
        "zone_morans_i": lambda: morans_i(zone_values(rollup, store_zones), adjacency),
        "zone_lisa": lambda: lisa(zone_values(rollup, store_zones), adjacency),
        "forecast_comparison": lambda: forecast_comparison(rollup),
        "sf_long_holt_winters": lambda: holt_winters_forecast(long),
        "sf_long_sarima": lambda: sarima_forecast(long),
        "raw_od_matrix": lambda: od_matrix(od_rollup(trips, store_zones)),
        "rollup_build": lambda: zone_hourly_demand(trips, store_zones),
        "sf_top_zones": lambda: d.top_zones(small_trips, zones),
        "sf_long_summary": lambda: d.summary(long),
        "sf_long_zone_trend": lambda: zone_trend(long, zones),
        "sf_zone_adjacency": lambda: zone_adjacency(fx.parcels(spark, SF_DIR)),
    }
    spread: dict[str, float] = {}
    for name, query in queries.items():
        def run(query=query, large=name in LARGE) -> None:
            if large:
                query().write.format("noop").mode("overwrite").save()
            else:
                query().collect()
        run()
        runs = [timed(run) for _ in range(RUNS)]
        times[name], spread[name] = statistics.median(runs), max(runs) - min(runs)

    size = {name: sum(len(r.feature.encode()) for r in queries[name]().collect())
            for name in ("geojson_full", "geojson_simplified")}
    print(json.dumps({
        "metric": "total_seconds_all_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 4) for name, value in times.items()},
        "spread": {name: round(value, 4) for name, value in spread.items()},
        "sf": SF_DIR.rsplit("sf", 1)[-1],
        "reference_scale": {"trips": trips.count(), "rollup_rows": rollup.count()},
        "raw_to_rollup": {
            "zone_ranking": round(times["raw_zone_ranking"] / times["zone_ranking"], 2),
            "date_filtered_summary": round(
                times["raw_date_filtered_summary"] / times["date_filtered_summary"], 2)},
        "geojson_bytes": size,
        "load_trips_per_second": round(trips.count() / times["load_trips"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
