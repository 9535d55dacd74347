"""Spatial statistics, forecasting and network queries over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters
from zonetide.functions import geometry
from zonetide.functions.projection import PROJECTIONS, forward, projection_of, reproject
from zonetide.operators import forecasting as fc
from zonetide.operators import spatial_statistics as stats
from zonetide.operators.accessibility import accessibility, link_times
from zonetide.operators.adjacency import zone_adjacency
from zonetide.operators.arcs import simplify_map
from zonetide.operators.export import to_features
from zonetide.operators.flows import balanced, flow_balance, od_matrix, od_rollup
from zonetide.operators.segments import hourly_profiles, spanning_tree, weighted_edges, zone_segments
from zonetide.plans.catalog import ASIA, MORNING, Query, adjacency, demand, long_demand, trips
from zonetide.plans.shared import new_folder, stored
from zonetide.plans.warehouse import Warehouse
from zonetide.sources import fixtures as fx
from zonetide.sources.zones import read_zones
from zonetide.streaming.ingest import load_landing_folder


def _zone_statistic(operator: Callable[..., DataFrame], filters: Filters = NO_FILTERS, **kwargs) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        values = stats.zone_values(demand(spark, sf), fx.zones(spark, sf).drop("geom"), filters)
        return operator(values, adjacency(spark, sf), **kwargs)
    return run


def parcel_values(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each customer, at their parcels."""
    orders = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("int").alias("location_id")).agg(
        F.count("*").alias("trip_count"))
    return fx.parcels(spark, sf).select("location_id").join(orders, "location_id", "left").withColumn(
        "trip_count", F.coalesce("trip_count", F.lit(0).cast("bigint")))


def _parcel_statistic(operator: Callable[..., DataFrame], **kwargs) -> Query:
    return lambda spark, sf: operator(
        parcel_values(spark, sf), zone_adjacency(fx.parcels(spark, sf)), **kwargs)


def _on_demand(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf: operator(demand(spark, sf), *args, **kwargs)


def _on_long_demand(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf: operator(long_demand(spark, sf), *args, **kwargs)


def _simplified_map(spark: SparkSession, sf: str) -> DataFrame:
    thin = geometry.vertices(simplify_map(fx.bordered_parcels(spark, sf)))
    return thin.select("location_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).distinct()


PARCELS_A_DOCUMENT = 300
MERCATOR_NORTH = 85.0  # degrees; the square of Web Mercator ends shortly after


def _zones_from_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels written in three ways into one folder, by id % 3: a feature a line; collections, one a line; indented collections
    in Web Mercator, or in degrees if they reach beyond the latitude where that ends."""
    folder = new_folder(spark, "zones")
    parcels = fx.parcels(spark, sf)
    kind, number = F.col("location_id") % 3, F.floor(F.col("location_id") / PARCELS_A_DOCUMENT)
    north = F.floor(((number + 1) * PARCELS_A_DOCUMENT - 1) / fx.PARCEL_COLUMNS + 1) * fx.PARCEL_SIDE

    def features(rows: DataFrame) -> DataFrame:
        named = rows.drop("service_zone").withColumnsRenamed({"location_id": "LocationID", "zone_name": "zone"})
        return to_features(named).select("feature", F.get_json_object("feature", "$.properties.LocationID")
                                         .cast("int").alias("location_id"))

    features(parcels.where(kind == 0)).select("feature").write.text(f"{folder}/lines")

    def collections(rows: DataFrame, crs: str, gap: str) -> DataFrame:
        head = f'{{"type":"FeatureCollection",{gap}"crs":{{"type":"name","properties":{{"name":"{crs}"}}}},{gap}"features":['
        return features(rows).groupBy(number.alias("document")).agg(F.concat(
            F.lit(head + gap), F.array_join(F.sort_array(F.collect_list("feature")), f",{gap}"),
            F.lit(f"{gap}]}}")).alias("text"))

    collections(parcels.where(kind == 1), "urn:ogc:def:crs:OGC:1.3:CRS84", "").select("text").write.text(f"{folder}/rows")

    def to_metres(v: Column) -> Column:
        x, y = forward(v["x"], v["y"], PROJECTIONS["EPSG:3857"])
        return F.struct(x.alias("x"), y.alias("y"))

    indented = parcels.where(kind == 2)
    metres = indented.where(north <= MERCATOR_NORTH).withColumn("geom", geometry.map_vertices(F.col("geom"), to_metres))
    documents = collections(metres, "urn:ogc:def:crs:EPSG::3857", "\n").unionByName(
        collections(indented.where(north > MERCATOR_NORTH), "urn:ogc:def:crs:OGC:1.3:CRS84", "\n"))
    # One file for each document.
    documents.write.partitionBy("document").text(f"{folder}/documents")
    found = read_zones(spark, f"{folder}/*/*", source_crs="EPSG:4326", id_type="int")
    points = geometry.vertices(found, "zone_name", "borough")
    return points.select(F.col("location_id").cast("int").alias("location_id"), "zone_name", "borough", "seq",
                         F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _reprojected(code: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        points = geometry.vertices(fx.metric_parcels(spark, sf))
        degrees = reproject(points, projection_of(code))
        return degrees.select("location_id", "seq", F.round("x", 7).alias("lon"), F.round("y", 7).alias("lat"))
    return run


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows of the event fixture."""
    return od_rollup(trips(spark, sf), fx.zones(spark, sf))


def _balanced(spark: SparkSession, sf: str) -> DataFrame:
    """All flows, fitted to the totals of the days from January 16 on."""
    everything = flows(spark, sf)
    late = everything.where(F.col("pickup_date") >= F.lit(date(2024, 1, 16)))
    total = F.sum("trip_count").alias("total")
    fitted = balanced(od_matrix(everything), late.groupBy("origin_id").agg(total), late.groupBy("destination_id").agg(total))
    return fitted.select("origin_id", "destination_id", "trip_count", F.round("fitted", 3).alias("fitted"))


def _accessibility(spark: SparkSession, sf: str) -> DataFrame:
    values = stats.zone_values(demand(spark, sf), fx.zones(spark, sf).drop("geom"))
    return accessibility(values, link_times(flows(spark, sf), adjacency(spark, sf)))


def _parcel_accessibility(spark: SparkSession, sf: str) -> DataFrame:
    """Links take 4 to 8 minutes, by the ids of both ends."""
    seconds = 240 + (F.col("location_id") * 7 + F.col("neighbour_id") * 3) % 5 * 60
    links = zone_adjacency(fx.parcels(spark, sf)).select(
        F.col("location_id").alias("origin_id"), F.col("neighbour_id").alias("destination_id"), seconds.alias("seconds"))
    return accessibility(parcel_values(spark, sf), links, (5, 15))


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return hourly_profiles(demand(spark, sf), fx.zones(spark, sf).drop("geom"))


def _spanning_tree(spark: SparkSession, sf: str) -> DataFrame:
    return spanning_tree(weighted_edges(_profiles(spark, sf), adjacency(spark, sf)))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return zone_segments(_profiles(spark, sf), adjacency(spark, sf), 4)


def _common_borders(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the simplified parcels, by how many parcels have them."""
    edges = geometry.edges(simplify_map(fx.bordered_parcels(spark, sf)))
    one, other = (F.struct(F.col(f"x{end}").alias("x"), F.col(f"y{end}").alias("y")) for end in (1, 2))
    return (edges.groupBy(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
            .agg(F.count("*").alias("zones")).groupBy("zones").agg(F.count("*").alias("edges")))


def _stream_load(spark: SparkSession, sf: str) -> DataFrame:
    """The events, faults among them, in files that arrive between three runs of a stream; the last one finds nothing new."""
    root = new_folder(spark, "stream")
    landing, checkpoint = f"{root}/landing", f"{root}/checkpoint"
    store = Warehouse(spark, f"{root}/store")
    store.load_zones(fx.zones(spark, sf))
    # Stored first: what arrives early would else be picked before the events are dealt out.
    raw = stored(fx.dirty_trips(spark, sf, deal_out=True).drop("source_file", "source_row_number"), "arriving")
    early = F.coalesce(F.col("DOLocationID") <= 12, F.lit(False))
    for arrives in (early, ~early, None):
        if arrives is not None:
            raw.where(arrives).write.mode("append").parquet(landing)
        load_landing_folder(store, landing, checkpoint).awaitTermination()
    return store.demand().groupBy("pickup_date", "location_id").agg(
        F.sum("trip_count").cast("long").alias("trips"),
        F.sum("total_amount").cast("double").alias("total_amount"))


ZONE = ("location_id",)


def queries() -> dict[str, Query]:
    return {
        "zone_gi_star": _zone_statistic(stats.gi_star),
        "zone_gi_star_filtered": _zone_statistic(stats.gi_star, MORNING, rate=0.2),
        "zone_gi_star_borough": _zone_statistic(stats.gi_star, ASIA),
        "parcel_gi_star": _parcel_statistic(stats.gi_star),
        "zone_morans_i": _zone_statistic(stats.morans_i),
        "zone_morans_i_borough": _zone_statistic(stats.morans_i, ASIA),
        "parcel_morans_i": _parcel_statistic(stats.morans_i),
        "zone_lisa": _zone_statistic(stats.lisa),
        "zone_lisa_filtered": _zone_statistic(stats.lisa, MORNING, permutations=199, alpha=0.1),
        "parcel_lisa": _parcel_statistic(stats.lisa, permutations=99),
        "od_rollup": lambda s, sf: flows(s, sf).select(
            "pickup_date", "pickup_hour", "origin_id", "destination_id", "borough", "trip_count", "duration_sum",
            F.col("amount_sum").cast("double").alias("amount_sum")),
        "od_matrix": lambda s, sf: od_matrix(flows(s, sf)),
        "od_matrix_filtered": lambda s, sf: od_matrix(flows(s, sf), MORNING),
        "od_matrix_long": lambda s, sf: od_matrix(od_rollup(fx.lineitem_trips(s, sf), fx.zones(s, sf))),
        "flow_balance": lambda s, sf: flow_balance(flows(s, sf), fx.zones(s, sf)),
        "flow_balance_borough": lambda s, sf: flow_balance(flows(s, sf), fx.zones(s, sf), ASIA),
        "od_balanced": _balanced,
        "zone_accessibility": _accessibility,
        "parcel_accessibility": _parcel_accessibility,
        "stream_load": _stream_load,
        "zone_spanning_tree": _spanning_tree,
        "zone_segments": _segments,
        "zones_from_geojson": _zones_from_geojson,
        "reproject_utm": _reprojected("EPSG:32618"),
        "reproject_web_mercator": _reprojected("EPSG:3857"),
        "simplify_map": _simplified_map,
        "simplified_common_borders": _common_borders,
        "forecast_backtest": _on_demand(fc.forecast_backtest),
        "forecast_backtest_long": _on_long_demand(fc.forecast_backtest, horizon=30, origins=26, step=7),
        "forecast_backtest_zones": _on_demand(fc.forecast_backtest, ZONE, horizon=14, origins=4, step=3),
        "holt_winters_backtest": _on_demand(fc.forecast_backtest, model="holt_winters"),
        "sarima_backtest": _on_demand(fc.forecast_backtest, model="sarima"),
        "holt_winters_forecast": _on_demand(fc.holt_winters_forecast, horizon=14),
        "holt_winters_zones": _on_demand(fc.holt_winters_forecast, ZONE),
        "holt_winters_forecast_long": _on_long_demand(fc.holt_winters_forecast, horizon=30),
        "sarima_forecast": _on_demand(fc.sarima_forecast, horizon=14),
        "sarima_forecast_long": _on_long_demand(fc.sarima_forecast, horizon=30),
        "forecast_comparison": _on_demand(fc.forecast_comparison),
        "forecast_comparison_zones": _on_demand(fc.forecast_comparison, ZONE, origins=7),
    }
