from datetime import date, timedelta

import pytest
from conftest import DAY, box
from pyspark.sql import functions as F

from zonetide import Filters
from zonetide.labels import in_turkish
from zonetide.operators.anomalies import anomaly_items, zone_anomalies
from zonetide.operators.compare import add_zone, compare_zones, comparison_series
from zonetide.operators.forecast import demand_forecast
from zonetide.operators.trend import trend_direction, zone_trend


@pytest.fixture
def zones(make_zones):
    return make_zones({1: [[box(0, 0)]], 2: [[box(1, 0)]], 3: [[box(2, 0)]]})


def days(n, start=DAY):
    return [start + timedelta(days=i) for i in range(n)]


def test_trend_windows_and_percentage(make_demand, zones):
    last = date(2026, 2, 1)
    demand = make_demand([(last, 0, 1, 34200), (date(2026, 1, 25), 0, 1, 30400),
                          (date(2026, 1, 18), 0, 1, 999), (last, 0, 2, 3)])
    rows = {r.location_id: r for r in zone_trend(demand, zones).collect()}
    one = rows[1]
    assert (one.current_period_start, one.current_period_end) == (date(2026, 1, 26), last)
    assert (one.previous_period_start, one.previous_period_end) == (
        date(2026, 1, 19), date(2026, 1, 25))
    assert (one.change_amount, one.change_percentage, one.trend_direction) == (
        3800, 12.5, "Rising")
    assert (rows[2].change_percentage, rows[2].trend_direction) == (None, "Rising")
    assert rows[3].trend_direction == "No Data"


def test_trend_direction_bounds(spark):
    cases = spark.createDataFrame(
        [(105, 100, 5.0), (95, 100, -5.0), (10501, 10000, 5.01), (0, 100, -100.0), (0, 0, None),
         (1, 0, None)], "c bigint, p bigint, x double")
    assert [r[0] for r in cases.select(
        trend_direction(F.col("c"), F.col("p"), F.col("x"))).collect()] == [
        "Stable", "Stable", "Rising", "Falling", "No Data", "Rising"]


def test_trend_end_is_global_and_limited_by_date_to(make_demand, zones):
    demand = make_demand([(DAY, 0, 1, 5), (date(2024, 1, 9), 0, 2, 5)])
    assert {r.current_period_end for r in zone_trend(demand, zones).collect()} == {
        date(2024, 1, 9)}
    early = zone_trend(demand, zones, Filters(date_to=date(2024, 1, 4)), location_id=1).first()
    assert early.current_period_end == date(2024, 1, 4)
    assert early.current_period_trip_count == 5


def test_anomaly_window_fills_missing_days(make_demand, zones):
    demand = make_demand([(day, 0, 1, 10) for day in days(20)] + [(DAY + timedelta(27), 0, 1, 90)])
    row = zone_anomalies(demand, zones, location_id=1).first()
    assert (row.analysis_start, row.analysis_end) == (DAY, DAY + timedelta(27))
    assert row.observation_count == 28
    assert row.mean_daily_trips == 10.36  # 290 / 28
    assert row.anomaly_count == 1
    item = row["items"][0]
    assert (item.pickup_date, item.trip_count, item.anomaly_type) == (
        DAY + timedelta(27), 90, "High Demand")
    assert item.deviation_amount == 79.64
    assert item.deviation_percentage == 768.97


def test_anomalies_of_a_constant_series(make_demand, zones):
    row = zone_anomalies(make_demand([(d, 0, 1, 7) for d in days(28)]), zones).first()
    assert (row.standard_deviation, row.anomaly_count) == (0.0, 0)


def test_anomaly_bounds_are_per_zone_and_zone_without_demand(make_demand, zones):
    demand = make_demand([(DAY, 0, 1, 1), (date(2024, 2, 1), 0, 2, 1)])
    rows = {r.location_id: r for r in zone_anomalies(demand, zones).collect()}
    assert rows[1].analysis_end == DAY and rows[2].analysis_end == date(2024, 2, 1)
    empty = rows[3]
    assert (empty.analysis_start, empty.observation_count, empty["items"]) == (None, 0, [])


def test_anomaly_weekday_thins_the_calendar(make_demand, zones):
    demand = make_demand([(d, 0, 1, 5) for d in days(28)])
    row = zone_anomalies(demand, zones, Filters(weekday=1), location_id=1).first()
    assert row.observation_count == 4


def test_anomaly_items_order_and_low_days(make_demand, zones):
    counts = [100] * 26 + [10, 190]
    demand = make_demand([(d, 0, 1, n) for d, n in zip(days(28), counts, strict=True)])
    row = zone_anomalies(demand, zones, location_id=1).first()
    assert [i.anomaly_type for i in row["items"]] == ["High Demand", "Low Demand"]
    # Equal sizes: the later date first.
    assert row["items"][0].pickup_date > row["items"][1].pickup_date
    nested = in_turkish(zone_anomalies(demand, zones, location_id=1)).first()["items"]
    assert [i.anomaly_type for i in nested] == ["Yüksek Talep", "Düşük Talep"]
    flat = in_turkish(anomaly_items(zone_anomalies(demand, zones)))
    assert {r.anomaly_type for r in flat.collect()} == {"Yüksek Talep", "Düşük Talep"}


def test_forecast_uses_available_weekdays(make_demand):
    mondays = [DAY + timedelta(weeks=i) for i in (0, 2, 3)]  # one week is missing
    demand = make_demand([(d, 0, 1, n) for d, n in zip(mondays, (1, 2, 9), strict=True)])
    rows = demand_forecast(demand, forecast_days=14, history_weeks=2).collect()
    assert [r.forecast_date for r in rows] == [mondays[-1] + timedelta(weeks=i) for i in (1, 2)]
    first = rows[0]
    # mean 5.5, deviation 3.5
    assert (first.predicted_trip_count, first.lower_bound, first.upper_bound) == (6, 2, 9)
    assert (first.weekday, first.sample_count) == (1, 2)


def test_forecast_lower_bound_stops_at_zero_and_constant_band(make_demand):
    demand = make_demand([(DAY, 0, 1, 1), (DAY + timedelta(7), 0, 1, 100),
                          (DAY + timedelta(1), 0, 1, 4), (DAY + timedelta(8), 0, 1, 4)])
    rows = {r.weekday: r for r in demand_forecast(demand).collect()}
    assert rows[1].lower_bound == 1 and rows[1].upper_bound == 100
    assert (rows[2].lower_bound, rows[2].predicted_trip_count, rows[2].upper_bound) == (4, 4, 4)


DETAILS = ("location_id smallint, zone_name string, trip_count bigint, zone_score double, "
           "demand_score double, hotspot_component_score double, consistency_score double, "
           "avg_total_amount double, avg_trip_distance double, peak_weekday_name string, "
           "peak_hour smallint, priority_class string")


def test_comparison_limits_and_cells(spark):
    details = spark.createDataFrame([
        (1, "A", 5, 98.4, 99.23, 100.0, 93.94, 12.5, None, "Friday", 8, "Very High"),
        (2, "B", 0, 15.0, 0.0, 50.0, 0.0, None, None, None, None, "Very Low")], DETAILS)
    cells = {r.metric: (r.zone_1, r.zone_2) for r in compare_zones(details, (1, 2)).collect()}
    assert len(cells) == 10
    assert cells["zone_score"] == ("98.40", "15.00")
    assert cells["peak_hour"] == ("08:00", "-")
    assert cells["avg_trip_distance"] == ("-", "-")
    assert comparison_series(details, (1, 2)).count() == 8
    with pytest.raises(ValueError):
        compare_zones(details, (1,))
    with pytest.raises(ValueError):
        add_zone((1, 2, 3), 4)
    with pytest.raises(ValueError):
        add_zone((1, 2), 2)
