"""All questions of the dashboard, asked of a warehouse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.filters import NO_FILTERS, Filters
from zonetide.functions.geometry import extent
from zonetide.labels import in_turkish
from zonetide.operators import demand as d
from zonetide.operators.accessibility import MINUTES, accessibility, link_times
from zonetide.operators.anomalies import zone_anomalies
from zonetide.operators.classes import demand_classes
from zonetide.operators.compare import compare_zones, comparison_series
from zonetide.operators.export import to_features
from zonetide.operators.flows import flow_balance, od_matrix, od_rollup
from zonetide.operators.forecast import demand_forecast
from zonetide.operators.forecasting import (forecast_backtest, forecast_comparison, holt_winters_forecast,
                                            sarima_forecast)
from zonetide.operators.hotspots import hotspots
from zonetide.operators.scores import zone_details, zone_scores
from zonetide.operators.segments import hourly_profiles, zone_segments
from zonetide.operators.spatial_statistics import gi_star, lisa, morans_i, zone_values
from zonetide.operators.trend import zone_trend
from zonetide.plans.warehouse import Warehouse


class Dashboard:
    """Lazy results over the stored rollup, zones and adjacency.

    Maps carry the simplified boundaries in ``geom``; ``features`` turns them into GeoJSON.
    Questions about one zone raise ``LookupError`` when the zone does not exist.
    """

    def __init__(self, warehouse: Warehouse, turkish: bool = False) -> None:
        self.warehouse = warehouse
        self._labelled = in_turkish if turkish else lambda result: result

    # Tables are looked up for each question, so that it sees the last load.
    @property
    def demand(self) -> DataFrame:
        return self.warehouse.demand()

    @property
    def zones(self) -> DataFrame:
        return self.warehouse.zones()

    @property
    def map_zones(self) -> DataFrame:
        return self.warehouse.published_zones()

    @property
    def adjacency(self) -> DataFrame:
        return self.warehouse.adjacency()

    def _known(self, location_id: int) -> int:
        d.zone_by_id(self.zones, location_id)
        return location_id

    def dataset_summary(self) -> DataFrame:
        store = self.warehouse
        return d.dataset_summary(store.trips(), store.rejected_trips(), self.zones)

    def summary(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return d.summary(self.demand, filters)

    def daily_trend(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return d.daily_trend(self.demand, filters)

    def weekday_hour_heatmap(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return d.weekday_hour(self.demand, filters)

    def heatmap_grid(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return d.heatmap_intensity(self.warehouse.spark, self.demand, filters)

    def boroughs(self) -> DataFrame:
        return d.boroughs(self.zones)

    def top_zones(self, limit: int = 10) -> DataFrame:
        return d.top_zones(self.warehouse.trips(), self.zones, limit)

    def ranking(self, filters: Filters = NO_FILTERS, limit: int = 10) -> DataFrame:
        return d.zone_ranking(self.demand, filters, limit)

    def demand_map(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return self._labelled(demand_classes(self.demand, self.map_zones, filters)).orderBy(
            "location_id")

    def hotspot_map(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return self._labelled(
            hotspots(self.demand, self.map_zones, self.adjacency, filters)).orderBy("location_id")

    def score_map(self, filters: Filters = NO_FILTERS) -> DataFrame:
        """Best zones first."""
        return self._labelled(zone_scores(
            self.demand, self.map_zones, self.adjacency, filters)).orderBy(
            F.desc("zone_score"), "location_id")

    def _values(self, filters: Filters) -> DataFrame:
        return zone_values(self.demand, self.zones, filters)

    def gi_star_map(self, filters: Filters = NO_FILTERS, rate: float = 0.05) -> DataFrame:
        found = gi_star(self._values(filters), self.adjacency, rate)
        return found.join(self.map_zones.select("location_id", "geom"), "location_id").orderBy("location_id")

    def lisa_map(self, filters: Filters = NO_FILTERS, permutations: int = 999) -> DataFrame:
        found = lisa(self._values(filters), self.adjacency, permutations)
        return found.join(self.map_zones.select("location_id", "geom"), "location_id").orderBy("location_id")

    def morans_i(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return morans_i(self._values(filters), self.adjacency)

    def map_extent(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return extent(filters.select_zones(self.map_zones))

    @staticmethod
    def features(map_result: DataFrame) -> DataFrame:
        return to_features(map_result)

    def zone_hourly(self, location_id: int, filters: Filters = NO_FILTERS) -> DataFrame:
        return d.zone_hourly(self.demand, filters, self._known(location_id))

    def zone_day_profile(self, location_id: int, filters: Filters = NO_FILTERS) -> DataFrame:
        return d.zone_hourly_dense(self.demand, self.zones, filters, self._known(location_id))

    def zone_details(self, location_id: int, filters: Filters = NO_FILTERS) -> DataFrame:
        return self._labelled(zone_details(
            self.demand, self.zones, self.adjacency, filters, self._known(location_id)))

    def zone_trend(self, location_id: int, filters: Filters = NO_FILTERS,
                   period_days: int = 7) -> DataFrame:
        return self._labelled(zone_trend(
            self.demand, self.zones, filters, period_days, self._known(location_id)))

    def zone_anomalies(self, location_id: int, filters: Filters = NO_FILTERS,
                       analysis_days: int = 28, z_threshold: float = 2.0) -> DataFrame:
        return self._labelled(zone_anomalies(
            self.demand, self.zones, filters, analysis_days, z_threshold,
            self._known(location_id)))

    def forecast(self, filters: Filters = NO_FILTERS, forecast_days: int = 7,
                 history_weeks: int = 4) -> DataFrame:
        return demand_forecast(self.demand, filters, forecast_days, history_weeks)

    def holt_winters(self, by: Sequence[str] = ("borough",), horizon: int = 7) -> DataFrame:
        return holt_winters_forecast(self.demand, by, horizon).orderBy(*by, "horizon")

    def sarima(self, by: Sequence[str] = ("borough",), horizon: int = 7) -> DataFrame:
        return sarima_forecast(self.demand, by, horizon).orderBy(*by, "horizon")

    def forecast_evaluation(self, by: Sequence[str] = ("borough",), model: str = "same_weekday",
                            horizon: int = 7, origins: int = 14) -> DataFrame:
        return forecast_backtest(self.demand, by, model, horizon, origins).orderBy(*by, "horizon")

    def model_comparison(self, by: Sequence[str] = ("borough",), horizon: int = 7, origins: int = 14) -> DataFrame:
        return forecast_comparison(self.demand, by, horizon, origins).orderBy(*by, "place")

    @property
    def flows(self) -> DataFrame:
        """Origin-destination rollup, made of the stored trips."""
        return od_rollup(self.warehouse.trips(), self.zones)

    def od_matrix(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return od_matrix(self.flows, filters).orderBy("origin_id", "destination_id")

    def flow_balance(self, filters: Filters = NO_FILTERS) -> DataFrame:
        return flow_balance(self.flows, self.zones, filters).orderBy("location_id")

    def accessibility(self, filters: Filters = NO_FILTERS, minutes: Sequence[int] = MINUTES) -> DataFrame:
        links = link_times(filters.without("borough").apply(self.flows), self.adjacency)
        return accessibility(self._values(filters), links, minutes).orderBy("location_id", "minutes")

    def segments(self, filters: Filters = NO_FILTERS, segments: int = 5) -> DataFrame:
        profiles = hourly_profiles(self.demand, self.zones, filters)
        return zone_segments(profiles, self.adjacency, segments).orderBy("location_id")

    def _all_details(self, filters: Filters) -> DataFrame:
        return self._labelled(zone_details(self.demand, self.zones, self.adjacency, filters))

    def comparison(self, location_ids: Sequence[int],
                   filters: Filters = NO_FILTERS) -> DataFrame:
        return compare_zones(self._all_details(filters), location_ids)

    def comparison_chart(self, location_ids: Sequence[int],
                         filters: Filters = NO_FILTERS) -> DataFrame:
        return comparison_series(self._all_details(filters), location_ids)
