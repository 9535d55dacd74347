"""Every operator as a query over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.filters import Filters
from zonetide.functions import geometry
from zonetide.functions.percentile import with_cume_dist
from zonetide.functions.projection import PROJECTIONS, reproject
from zonetide.functions.wall_clock import wall_clocks_to_utc
from zonetide.labels import in_turkish
from zonetide.operators import demand as d
from zonetide.operators.adjacency import zone_adjacency
from zonetide.operators.anomalies import anomaly_items, zone_anomalies
from zonetide.operators.classes import demand_classes
from zonetide.operators.cleaning import clean_trips
from zonetide.operators.compare import compare_zones, comparison_series
from zonetide.operators.export import to_features
from zonetide.operators.forecast import demand_forecast
from zonetide.operators.hotspots import hotspots, neighbour_stats
from zonetide.operators.rollup import merge_rollups, zone_hourly_demand
from zonetide.operators.scores import peaks, zone_details, zone_scores
from zonetide.operators.simplify import simplify
from zonetide.operators.trend import zone_trend
from zonetide.plans.shared import new_folder
from zonetide.plans.warehouse import (LoadReport, Warehouse, append_new, upsert,
                                      upsert_zones)
from zonetide.schemas import ROLLUP_COLUMNS, TRIP_KEY
from zonetide.sources import fixtures as fx
from zonetide.sources.profile import geometry_types, null_counts
from zonetide.sources.zones import zone_violations

Query = Callable[[SparkSession, str], DataFrame]

ASIA = Filters(borough="ASIA")
EUROPE_WEEKDAY = Filters(borough="EUROPE", weekday=3)
JANUARY_DAYS = Filters(date_from=date(2024, 1, 5), date_to=date(2024, 1, 20))
FRIDAY_EVENING = Filters(borough="AMERICA", hour=18, weekday=5,
                         date_from=date(2024, 1, 3), date_to=date(2024, 1, 28))
EARLY_MONDAYS = Filters(weekday=1, date_to=date(2024, 1, 24))
MORNING = Filters(hour=8, date_to=date(2024, 1, 25))
NOON = Filters(hour=12)


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned trips of the event fixture."""
    return clean_trips(fx.raw_trips(spark, sf), fx.zones(spark, sf)).valid


def demand(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rollup of the event fixture."""
    return zone_hourly_demand(trips(spark, sf), fx.zones(spark, sf))


def long_demand(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rollup over seven years of line items."""
    return zone_hourly_demand(fx.lineitem_trips(spark, sf), fx.zones(spark, sf))


def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Zone adjacency, part of each query's own plan."""
    return zone_adjacency(fx.zones(spark, sf))


def _loaded(spark: SparkSession, sf: str) -> tuple[Warehouse, str]:
    """A new warehouse with the events loaded from files, faults among them."""
    root = new_folder(spark, "warehouse")
    landing = f"{root}/landing"
    fx.dirty_trips(spark, sf, deal_out=True).drop("source_file", "source_row_number").write.parquet(landing)
    store = Warehouse(spark, f"{root}/store")
    store.load_zones(fx.zones(spark, sf))
    return store, landing


def _report(spark: SparkSession, report: LoadReport) -> DataFrame:
    return spark.range(1).select(
        F.lit(report.valid).cast("long").alias("valid"),
        F.lit(report.rejected).cast("long").alias("rejected"),
        F.lit(report.inserted).cast("long").alias("inserted"),
        F.lit(len(report.dates)).cast("long").alias("dates"))


def _warehouse_load(spark: SparkSession, sf: str) -> DataFrame:
    store, landing = _loaded(spark, sf)
    return _report(spark, store.load_trips(landing))


def _warehouse_reload(spark: SparkSession, sf: str) -> DataFrame:
    store, landing = _loaded(spark, sf)
    store.load_trips(landing)
    return _report(spark, store.load_trips(landing))


def _warehouse_rejects(spark: SparkSession, sf: str) -> DataFrame:
    store, landing = _loaded(spark, sf)
    store.load_trips(landing)
    store.load_trips(landing)
    return store.rejected_trips().groupBy("rejection_reason").agg(F.count("*").alias("trips"))


def _warehouse_rollup(spark: SparkSession, sf: str) -> DataFrame:
    store, landing = _loaded(spark, sf)
    store.load_trips(landing)
    return store.demand().groupBy("pickup_date", "location_id").agg(
        F.sum("trip_count").cast("long").alias("trips"),
        F.sum("total_amount").cast("double").alias("total_amount"))


def _dirty(spark: SparkSession, sf: str):
    return clean_trips(fx.dirty_trips(spark, sf), fx.zones(spark, sf))


def _spatial(operator: Callable[..., DataFrame], filters: Filters = Filters()) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        zones = fx.zones(spark, sf).drop("geom")
        return operator(demand(spark, sf), zones, adjacency(spark, sf), filters)
    return run


def _on_demand(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf: operator(demand(spark, sf), *args, **kwargs)


def _with_zones(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf: operator(
        demand(spark, sf), fx.zones(spark, sf).drop("geom"), *args, **kwargs)


def _dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    split = _dirty(spark, sf)
    result = d.dataset_summary(split.valid, split.rejected, fx.zones(spark, sf))
    return result.withColumns({
        c: F.col(c).cast("timestamp_ntz") for c in ("earliest_pickup", "latest_pickup")})


def _rollup_merge(spark: SparkSession, sf: str) -> DataFrame:
    zones, everything = fx.zones(spark, sf), trips(spark, sf)
    early = F.col("pickup_datetime") < F.lit("2024-01-15T17:30:00Z").cast("timestamp")
    parts = [zone_hourly_demand(everything.where(p), zones) for p in (early, ~early)]
    return merge_rollups(*parts).select(*ROLLUP_COLUMNS)


def _neighbour_stats(spark: SparkSession, sf: str) -> DataFrame:
    counted = demand(spark, sf).groupBy("location_id").agg(F.sum("trip_count").alias("trip_count"))
    selected = fx.zones(spark, sf).select("location_id").join(counted, "location_id", "left").select(
        "location_id", F.coalesce("trip_count", F.lit(0).cast("bigint")).alias("trip_count"))
    stats = neighbour_stats(selected, adjacency(spark, sf))
    return stats.select("location_id", "trip_count", "neighbour_count",
                        F.round("neighbour_mean", 2).cast("double").alias("neighbour_mean"))


def _hourly_share(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile of every trip amount, over all trips."""
    amounts = trips(spark, sf).select(
        "source_row_number", (F.col("total_amount") * 100).cast("bigint").alias("cents"))
    return with_cume_dist(amounts, "cents", "share")


def _details(spark: SparkSession, sf: str) -> DataFrame:
    return zone_details(demand(spark, sf), fx.zones(spark, sf), adjacency(spark, sf))


def _anomalies(filters: Filters = Filters(), **kwargs) -> Query:
    return lambda spark, sf: zone_anomalies(
        demand(spark, sf), fx.zones(spark, sf), filters, **kwargs).drop("items")


def _anomaly_items(filters: Filters = Filters(), **kwargs) -> Query:
    return lambda spark, sf: anomaly_items(zone_anomalies(
        demand(spark, sf), fx.zones(spark, sf), filters, **kwargs))


def _trip_validation(spark: SparkSession, sf: str) -> DataFrame:
    valid = _dirty(spark, sf).valid
    stamps = {c: F.col(c).cast("timestamp_ntz") for c in ("pickup_datetime", "dropoff_datetime")}
    money = {c: F.col(c).cast("double") for c in ("trip_distance", "total_amount")}
    return valid.withColumns(stamps).withColumns(money).select(
        "source_file", "source_row_number", *stamps, "passenger_count", *money,
        "store_and_fwd_flag", "pickup_location_id", "dropoff_location_id",
        "trip_duration_seconds", "pickup_date", "pickup_hour")


def _rejection_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _dirty(spark, sf).rejected.select("source_file", "source_row_number",
                                             "rejection_reason")


def _rejected_records(spark: SparkSession, sf: str) -> DataFrame:
    """Fields read back from the stored JSON."""
    def field(name: str):
        return F.get_json_object("raw_record", f"$.{name}")

    return _dirty(spark, sf).rejected.select(
        "source_row_number",
        field("pickup_datetime").alias("pickup"),
        field("pickup_location_id").cast("int").alias("pickup_zone"),
        field("store_and_fwd_flag").alias("flag"),
        field("trip_distance").cast("double").alias("distance"),
        field("dropoff_location_id").cast("int").alias("dropoff_zone"),
        *[field(c).cast("int").alias(c) for c in (
            "vendor_id", "passenger_count", "rate_code_id", "payment_type")],
        *[field(c).cast("double").alias(c) for c in (
            "fare_amount", "extra_amount", "mta_tax", "tip_amount", "tolls_amount",
            "improvement_surcharge", "total_amount", "airport_fee")],
        field("source_file").alias("source_file"),
        field("rejection_reason").alias("reason"),
        F.size(F.json_object_keys("raw_record")).alias("field_count"))


def _trip_coercion(spark: SparkSession, sf: str) -> DataFrame:
    """Text, fractions and infinities: what is rejected and what is read."""
    split = clean_trips(fx.messy_trips(spark, sf), fx.zones(spark, sf))
    valid = split.valid.select(
        "source_row_number", F.lit(None).cast("string").alias("rejection_reason"),
        F.col("trip_distance").cast("double").alias("trip_distance"),
        F.col("airport_fee").cast("double").alias("airport_fee"))
    none = F.lit(None).cast("double")
    return valid.unionByName(split.rejected.select(
        "source_row_number", "rejection_reason", none.alias("trip_distance"),
        none.alias("airport_fee")))


def _trip_dst_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as half-past wall-clock times in New York."""
    wall = F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int), 30, 0)")
    walls = fx.table(spark, sf, "lineitem").select(wall.alias("wall"))
    pattern = "yyyy-MM-dd HH:mm"
    return (
        wall_clocks_to_utc(walls.withColumn("utc", F.col("wall")), ["utc"])
        .groupBy(F.date_format("wall", pattern).alias("wall"),
                 F.date_format("utc", pattern).alias("utc"))
        .agg(F.count("*").alias("row_count"))
    )


def _load_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """Load everything after the first half was loaded: only the rest is appended."""
    incoming = trips(spark, sf)
    existing = incoming.where(F.col("pickup_date") < F.lit(date(2024, 1, 16)))
    appended = append_new(existing, incoming, TRIP_KEY)
    return appended.select("source_file", "source_row_number", "pickup_date",
                           F.col("total_amount").cast("double").alias("total_amount"))


def _rejects_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rejects of an earlier load, partly replaced."""
    fresh = _dirty(spark, sf).rejected.select("source_file", "source_row_number",
                                              "rejection_reason")
    earlier = fresh.withColumn("rejection_reason", F.lit("earlier load"))
    return upsert(earlier, fresh.where(F.col("rejection_reason").contains("location")), TRIP_KEY)


def _zones_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels of customers in debt are known already; all customers arrive again."""
    created = F.lit("2020-01-01T00:00:00Z").cast("timestamp")
    debtors = fx.table(spark, sf, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").cast("int").alias("location_id"))
    incoming = fx.parcels(spark, sf).drop("geom").withColumn("geom", F.lit(None).cast("string"))
    existing = incoming.join(debtors, "location_id", "left_semi").select(
        "location_id", F.lit("old name").alias("zone_name"), "borough",
        F.lit("Old Service").alias("service_zone"), "geom", created.alias("created_at"))
    return upsert_zones(existing, incoming).select(
        "location_id", "zone_name", "borough", "service_zone",
        (F.col("created_at") == created).alias("is_known"))


def _simplify_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    thin = geometry.vertices(simplify(fx.wavy_parcels(spark, sf)))
    return thin.select("location_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _reproject_vertices(spark: SparkSession, sf: str) -> DataFrame:
    points = geometry.vertices(fx.projected_parcels(spark, sf))
    degrees = reproject(points, PROJECTIONS["EPSG:2263"])
    return degrees.select("location_id", "seq", F.round("x", 7).alias("lon"),
                          F.round("y", 7).alias("lat"))


def _geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    return to_features(fx.parcels(spark, sf).drop("service_zone"))


def _table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return null_counts(fx.dirty_trips(spark, sf))


def queries() -> dict[str, Query]:
    return {
        "zone_hourly_demand": lambda s, sf: demand(s, sf).select(*ROLLUP_COLUMNS),
        "zone_hourly_demand_long": lambda s, sf: long_demand(s, sf).select(*ROLLUP_COLUMNS),
        "rollup_merge": _rollup_merge,
        "dataset_summary": _dataset_summary,
        "dashboard_summary": _on_demand(d.summary),
        "dashboard_summary_filtered": _on_demand(d.summary, FRIDAY_EVENING),
        "dashboard_summary_long": lambda s, sf: d.summary(long_demand(s, sf)),
        "daily_trend": _on_demand(d.daily_trend),
        "daily_trend_dates": _on_demand(d.daily_trend, JANUARY_DAYS),
        "weekday_hour_heatmap": _on_demand(d.weekday_hour),
        "weekday_hour_heatmap_borough": _on_demand(d.weekday_hour, FRIDAY_EVENING),
        "weekday_hour_dense": lambda s, sf: d.weekday_hour_dense(s, demand(s, sf), JANUARY_DAYS),
        "heatmap_intensity": lambda s, sf: d.heatmap_intensity(s, demand(s, sf)),
        "boroughs": lambda s, sf: d.boroughs(fx.zones(s, sf)),
        "zone_ranking": _on_demand(d.zone_ranking),
        "zone_ranking_dates": _on_demand(d.zone_ranking, JANUARY_DAYS, limit=50),
        "zone_ranking_borough": _on_demand(d.zone_ranking, EUROPE_WEEKDAY),
        "top_zones": lambda s, sf: d.top_zones(trips(s, sf), fx.zones(s, sf)),
        "zone_hourly": _on_demand(d.zone_hourly),
        "zone_hourly_weekday": _on_demand(d.zone_hourly, EUROPE_WEEKDAY),
        "zone_hourly_one": _on_demand(d.zone_hourly, location_id=7),
        "zone_hourly_dense": _with_zones(d.zone_hourly_dense, NOON),
        "demand_classes": _with_zones(demand_classes),
        "demand_classes_filtered": _with_zones(demand_classes, FRIDAY_EVENING),
        "demand_classes_turkish": lambda s, sf: in_turkish(
            demand_classes(demand(s, sf), fx.zones(s, sf).drop("geom"))),
        "cume_dist_amounts": _hourly_share,
        "zone_adjacency": lambda s, sf: zone_adjacency(fx.zones(s, sf)),
        "parcel_adjacency": lambda s, sf: zone_adjacency(fx.parcels(s, sf)),
        "mixed_parcel_adjacency": lambda s, sf: zone_adjacency(fx.mixed_parcels(s, sf)),
        "neighbour_stats": _neighbour_stats,
        "zone_hotspots": _spatial(hotspots),
        "zone_hotspots_borough": _spatial(hotspots, ASIA),
        "zone_hotspots_filtered": _spatial(hotspots, MORNING),
        "zone_scores": _spatial(zone_scores),
        "zone_scores_weekday": _spatial(zone_scores, EUROPE_WEEKDAY),
        "zone_scores_filtered": _spatial(zone_scores, MORNING),
        "zone_peaks": _on_demand(peaks),
        "zone_details": _details,
        "zone_details_filtered": _spatial(zone_details, FRIDAY_EVENING),
        "compare_zones": lambda s, sf: compare_zones(_details(s, sf), (3, 7, 12)),
        "comparison_series": lambda s, sf: comparison_series(_details(s, sf), (3, 7)),
        "zone_trend": _with_zones(zone_trend),
        "zone_trend_filtered": _with_zones(zone_trend, MORNING, period_days=10),
        "zone_trend_weekday": _with_zones(zone_trend, EARLY_MONDAYS, period_days=14),
        "zone_anomalies": _anomalies(),
        "zone_anomalies_filtered": _anomalies(MORNING, analysis_days=14, z_threshold=1.5),
        "zone_anomaly_items": _anomaly_items(),
        "zone_anomaly_items_weekday": _anomaly_items(EARLY_MONDAYS, analysis_days=60,
                                                     z_threshold=1.0),
        "demand_forecast": _on_demand(demand_forecast),
        "demand_forecast_borough": _on_demand(demand_forecast, FRIDAY_EVENING, forecast_days=30,
                                              history_weeks=3),
        "zone_extent": lambda s, sf: geometry.extent(fx.zones(s, sf), by="borough"),
        "parcel_extent": lambda s, sf: geometry.extent(fx.parcels(s, sf), by="borough"),
        "trip_validation": _trip_validation,
        "rejection_reasons": _rejection_reasons,
        "rejected_records": _rejected_records,
        "trip_coercion": _trip_coercion,
        "trip_dst_guard": _trip_dst_guard,
        "load_idempotent": _load_idempotent,
        "warehouse_load": _warehouse_load,
        "warehouse_reload": _warehouse_reload,
        "warehouse_rejects": _warehouse_rejects,
        "warehouse_rollup": _warehouse_rollup,
        "rejects_upsert": _rejects_upsert,
        "zones_upsert": _zones_upsert,
        "table_profile": _table_profile,
        "geometry_types": lambda s, sf: geometry_types(fx.parcels(s, sf)),
        "geometry_types_mixed": lambda s, sf: geometry_types(fx.mixed_parcels(s, sf)),
        "zone_violations": lambda s, sf: zone_violations(fx.faulty_parcels(s, sf)),
        "geojson_features": _geojson_features,
        "simplify_boundaries": _simplify_boundaries,
        "reproject_vertices": _reproject_vertices,
    }


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Zone scores of the event fixture."""
    return _spatial(zone_scores)(spark, sf)
