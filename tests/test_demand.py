from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import DAY, box
from pyspark.sql import functions as F

from zonetide import Filters
from zonetide.operators import demand as d
from zonetide.operators.classes import demand_classes
from zonetide.operators.rollup import merge_rollups, zone_hourly_demand
from zonetide.schemas import ROLLUP_COLUMNS

TRIPS = ("pickup_date date, pickup_hour smallint, pickup_location_id smallint, "
         "trip_distance decimal(10,3), trip_duration_seconds int, total_amount decimal(10,2), "
         "pickup_datetime timestamp")


@pytest.fixture
def zones(make_zones):
    return make_zones({1: [[box(0, 0)]], 2: [[box(1, 0)]]}, {1: "A", 2: "B"})


@pytest.fixture
def trips(spark):
    def at(minute):
        return datetime(2024, 1, 1, 5, minute)
    return spark.createDataFrame([
        (DAY, 0, 1, Decimal("1.000"), 61, Decimal("10.00"), at(0)),
        (DAY, 0, 1, Decimal("2.001"), 62, None, at(1)),
        (DAY, 0, 2, None, 60, Decimal("5.55"), at(2)),
        (DAY, 1, 1, Decimal("0.000"), 0, Decimal("0.01"), at(3)),
        (DAY, 1, 9, Decimal("7.000"), 5, Decimal("7.00"), at(4)),
    ], TRIPS)


def test_rollup_values_and_unknown_zone(trips, zones):
    rows = {(r.pickup_hour, r.location_id): r
            for r in zone_hourly_demand(trips, zones).collect()}
    assert set(rows) == {(0, 1), (0, 2), (1, 1)}
    first = rows[0, 1]
    assert (first.trip_count, first.borough) == (2, "A")
    assert first.avg_trip_distance == Decimal("1.501")  # 1.5005 rounds away from zero
    assert first.avg_duration_seconds == Decimal("61.50")
    assert first.avg_total_amount == Decimal("10.00")  # nulls do not count
    assert first.total_amount == Decimal("10.00")
    assert rows[0, 2].avg_trip_distance is None


def test_rollup_key_is_unique_and_keeps_every_known_trip(trips, zones):
    rollup = zone_hourly_demand(trips, zones)
    assert rollup.count() == rollup.select("pickup_date", "pickup_hour", "location_id"
                                           ).distinct().count()
    assert rollup.agg(F.sum("trip_count")).first()[0] == 4


def test_merging_rollups_equals_rolling_up_together(trips, zones):
    early = F.col("pickup_datetime") <= datetime(2024, 1, 1, 5, 0)
    parts = [zone_hourly_demand(trips.where(p), zones) for p in (early, ~early)]
    merged = merge_rollups(*parts).select(*ROLLUP_COLUMNS)
    whole = zone_hourly_demand(trips, zones).select(*ROLLUP_COLUMNS)
    assert sorted(merged.collect()) == sorted(whole.collect())


def test_null_hourly_mean_leaves_the_numerator_only(trips, zones):
    row = d.summary(zone_hourly_demand(trips, zones)).first()
    # (1.501 * 2 + 0 * 1) / 4 trips; amounts (10.00 + 5.55 + 0.01) / 4
    assert row.avg_trip_distance == 0.75
    assert row.avg_total_amount == 3.89
    assert (row.total_trips, row.active_zones) == (4, 2)


def test_summary_of_nothing(make_demand):
    row = d.summary(make_demand([(DAY, 0, 1, 1)]), Filters(hour=9)).first()
    assert row.asDict() == {"total_trips": 0, "active_zones": 0, "avg_total_amount": None,
                            "avg_trip_distance": None}


def test_daily_trend_has_no_empty_days(make_demand):
    rows = d.daily_trend(make_demand([(date(2024, 1, 3), 0, 1, 2), (DAY, 0, 1, 1)])).collect()
    assert [(r.pickup_date, r.trip_count) for r in rows] == [(DAY, 1), (date(2024, 1, 3), 2)]


def test_heatmap_ignores_hour_and_weekday(make_demand):
    demand = make_demand([(DAY, 0, 1, 1), (date(2024, 1, 7), 5, 1, 2)])
    rows = d.weekday_hour(demand, Filters(hour=5, weekday=7)).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 1), (7, 5, 2)]


def test_dense_heatmap_and_bands(spark, make_demand):
    demand = make_demand([(DAY, h, 1, n) for h, n in enumerate((100, 75, 50, 25, 24))])
    rows = d.heatmap_intensity(spark, demand).collect()
    assert len(rows) == 168
    assert [r.band for r in rows[:6]] == [4, 4, 3, 2, 1, 0]
    assert rows[1].intensity == 0.75


def test_ranking_breaks_ties_by_id(make_demand):
    rows = d.zone_ranking(make_demand([(DAY, 0, z, n) for z, n in ((3, 5), (1, 5), (2, 9))]),
                          limit=2).collect()
    assert [(r.position, r.location_id) for r in rows] == [(1, 2), (2, 1)]


def test_top_zones_use_plain_averages(trips, zones):
    rows = d.top_zones(trips, zones).collect()
    assert [r.location_id for r in rows] == [1, 2]
    assert rows[0].avg_trip_distance == 1.0
    assert rows[0].avg_total_amount == 5.01  # (10.00 + 0.01) / 2, null left out


def test_dataset_summary_counts_all_trips(spark, trips, zones):
    rejects = spark.range(3)
    row = d.dataset_summary(trips, rejects, zones).first()
    assert (row.total_trips, row.rejected_trips, row.total_zones) == (5, 3, 2)
    assert row.average_total_amount == 5.64
    assert row.earliest_pickup < row.latest_pickup


def test_zone_hourly_dense_has_24_hours(make_demand, zones):
    demand = make_demand([(DAY, 5, 1, 3)])
    rows = d.zone_hourly_dense(demand, zones, location_id=1).collect()
    assert [r.trip_count for r in rows] == [3 if h == 5 else 0 for h in range(24)]


def test_zone_lookup(zones):
    assert d.zone_by_id(zones, 2).first().borough == "B"
    with pytest.raises(LookupError):
        d.zone_by_id(zones, 77)


def test_boroughs_and_has_demand(make_demand, zones):
    assert [r.borough for r in d.boroughs(zones).collect()] == ["A", "B"]
    demand = make_demand([(DAY, 5, 1, 3)])
    assert d.has_demand(demand_classes(demand, zones))
    assert not d.has_demand(demand_classes(demand, zones, Filters(hour=1)))


def test_demand_classes_at_exact_fifths(make_demand, make_zones):
    shapes = {i: [[box(i, 0)]] for i in range(1, 7)}
    demand = make_demand([(DAY, 0, z, z) for z in range(1, 6)])
    rows = demand_classes(demand, make_zones(shapes)).collect()
    assert [r.demand_class_id for r in rows] == [1, 2, 3, 4, 5, 0]
    assert rows[0].demand_class == "Very Low" and rows[5].demand_class == "No Data"
    assert rows[5].trip_count == 0 and rows[5].avg_total_amount is None
