from datetime import date

import pytest

from zonetide import Filters
from zonetide.operators import demand as d
from zonetide.operators.anomalies import zone_anomalies
from zonetide.operators.forecast import demand_forecast
from zonetide.operators.trend import zone_trend

from conftest import DAY


@pytest.mark.parametrize("bad", [
    {"hour": 24}, {"hour": -1}, {"weekday": 0}, {"weekday": 8},
    {"date_from": date(2024, 2, 1), "date_to": date(2024, 1, 1)}])
def test_filters_refuse_values_out_of_range(bad):
    with pytest.raises(ValueError):
        Filters(**bad)


def test_start_after_end_names_the_problem():
    with pytest.raises(ValueError, match="Start date cannot be later than end date."):
        Filters(date_from=date(2024, 2, 1), date_to=date(2024, 1, 1))


def test_masking_keeps_only_named_filters():
    full = Filters("B", 3, 2, DAY, DAY)
    assert full.only("borough") == Filters("B")
    assert full.without("hour", "weekday") == Filters("B", None, None, DAY, DAY)


def test_each_filter_narrows(make_demand):
    demand = make_demand([(DAY, 0, 1, 1), (DAY, 5, 2, 2), (date(2024, 1, 2), 5, 1, 4)],
                         {1: "A", 2: "B"})

    def total(**kwargs):
        return d.summary(demand, Filters(**kwargs)).first().total_trips

    assert total() == 7
    assert total(borough="A") == 5
    assert total(hour=5) == 6
    assert total(weekday=1) == 3
    assert total(date_from=date(2024, 1, 2)) == 4
    assert total(date_to=DAY) == 3
    assert total(borough="nowhere") == 0


@pytest.mark.parametrize("limit", [0, 51])
def test_ranking_limit_range(make_demand, limit):
    with pytest.raises(ValueError):
        d.zone_ranking(make_demand([(DAY, 0, 1, 1)]), limit=limit)


@pytest.mark.parametrize("limit", [0, 101])
def test_top_zones_limit_range(limit):
    with pytest.raises(ValueError):
        d.top_zones(None, None, limit=limit)


@pytest.mark.parametrize(("operator", "bad"), [
    (zone_trend, {"period_days": 1}), (zone_trend, {"period_days": 31}),
    (zone_anomalies, {"analysis_days": 7}), (zone_anomalies, {"analysis_days": 91}),
    (zone_anomalies, {"z_threshold": 0.5}), (zone_anomalies, {"z_threshold": 4.1})])
def test_zone_operator_ranges(operator, bad):
    with pytest.raises(ValueError):
        operator(None, None, **bad)


@pytest.mark.parametrize("bad", [{"forecast_days": 31}, {"forecast_days": 0},
                                 {"history_weeks": 1}, {"history_weeks": 13}])
def test_forecast_ranges(bad):
    with pytest.raises(ValueError):
        demand_forecast(None, **bad)
