"""Every dashboard question over a loaded warehouse."""

import json
from datetime import date

import pytest

from zonetide import Filters
from zonetide.plans.dashboard import Dashboard
from zonetide.plans.warehouse import Warehouse
from zonetide.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dashboard(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("dashboard")
    store = Warehouse(spark, str(root / "store"))
    store.load_zones(fx.zones(spark, SF))
    fx.raw_trips(spark, SF).drop("source_file", "source_row_number").write.parquet(
        str(root / "trips"))
    store.load_trips(str(root / "trips"))
    return Dashboard(store)


def test_questions_about_everything(dashboard):
    total = dashboard.dataset_summary().first()
    assert (total.total_trips, total.rejected_trips, total.total_zones) == (1000, 0, 25)
    assert dashboard.summary().first().total_trips == 1000
    assert dashboard.daily_trend().count() == 30
    assert sum(r.trip_count for r in dashboard.weekday_hour_heatmap().collect()) == 1000
    assert dashboard.heatmap_grid().count() == 168
    assert dashboard.boroughs().count() == 5
    assert dashboard.top_zones().count() == 10
    assert dashboard.ranking(limit=3).count() == 3
    assert dashboard.forecast().count() == 7


def test_maps_as_geojson(dashboard):
    for result in (dashboard.demand_map(), dashboard.hotspot_map(), dashboard.score_map()):
        features = [json.loads(r.feature) for r in dashboard.features(result).collect()]
        assert len(features) == 25
        feature = features[0]
        assert feature["geometry"]["type"] == "MultiPolygon"
        assert "geom" not in feature["properties"]
    assert tuple(dashboard.map_extent(Filters(borough="ASIA")).first()) == (2.0, 0.0, 3.0, 5.0)


def test_statistics_models_and_flows(dashboard):
    assert {r.gi_bin for r in dashboard.gi_star_map().collect()} <= set(range(-3, 4))
    assert all(r.geom for r in dashboard.lisa_map(permutations=9).collect())
    assert dashboard.morans_i(Filters(borough="ASIA")).first().zones == 5
    assert {r.model for r in dashboard.model_comparison(origins=3).collect()} == {"holt_winters", "same_weekday", "sarima"}
    assert dashboard.holt_winters(horizon=2).count() == dashboard.sarima(horizon=2).count() == 10
    assert dashboard.forecast_evaluation(model="sarima", origins=2).count() == 10
    assert sum(r.trip_count for r in dashboard.od_matrix().collect()) == 1000
    assert sum(r.net_inflow for r in dashboard.flow_balance().collect()) == 0
    assert {r.location_id for r in dashboard.accessibility(Filters(borough="ASIA"), (60,)).collect()} == {3, 8, 13, 18, 23}
    assert len({r.segment for r in dashboard.segments(segments=3).collect()}) == 3


def test_questions_about_one_zone(dashboard):
    assert dashboard.zone_details(3).first().location_id == 3
    assert dashboard.zone_trend(3).first().period_days == 7
    assert dashboard.zone_anomalies(3).first().z_threshold == 2.0
    assert dashboard.zone_hourly(3).count() <= 24
    assert dashboard.zone_day_profile(3).count() == 24
    assert dashboard.comparison((3, 4)).count() == 10
    assert dashboard.comparison_chart((3, 4)).count() == 8


@pytest.mark.parametrize("question", ["zone_details", "zone_trend", "zone_anomalies",
                                      "zone_hourly", "zone_day_profile"])
def test_unknown_zones_are_reported(dashboard, question):
    with pytest.raises(LookupError, match="999"):
        getattr(dashboard, question)(999)


def test_turkish_labels(dashboard):
    turkish = Dashboard(dashboard.warehouse, turkish=True)
    assert turkish.zone_trend(3).first().trend_direction in {
        "Veri Yok", "Yükselen", "Düşen", "Stabil"}
    assert {r.priority_class for r in turkish.score_map().collect()} <= {
        "Çok Yüksek", "Yüksek", "Orta", "Düşük", "Çok Düşük"}


def test_a_live_dashboard_sees_the_next_load(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "store"))
    store.load_zones(fx.zones(spark, SF))
    raw = fx.raw_trips(spark, SF).drop("source_file", "source_row_number")
    raw.limit(400).write.parquet(str(tmp_path / "first"))
    raw.write.parquet(str(tmp_path / "second"))
    store.load_trips(str(tmp_path / "first"))
    live = Dashboard(store)
    assert live.summary().first().total_trips == 400
    store.load_trips(str(tmp_path / "second"))
    assert live.summary().first().total_trips == 1400


def test_dates_prune_months_of_the_stored_rollup(dashboard):
    week = Filters(date_from=date(2024, 1, 8), date_to=date(2024, 1, 14))
    plan = dashboard.summary(week)._jdf.queryExecution().executedPlan().toString()
    pruned = [line for line in plan.split("\n") if "PartitionFilters: [" in line]
    assert any("pickup_month" in line.split("PartitionFilters: [", 1)[1].split("]")[0]
               for line in pruned)
