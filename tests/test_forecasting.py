"""Forecast models against plain Python, at rolling origins."""

import math
import random
from datetime import date, timedelta
from itertools import product

import numpy as np
import pytest

from zonetide.operators import forecasting as fc
from zonetide.operators.forecast import demand_forecast

START = date(2024, 1, 1)
RANDOM = random.Random(8)
WEEKLY = [100, 120, 130, 125, 160, 90, 60]


def day(i):
    return START + timedelta(days=i)


@pytest.fixture
def series(make_demand):
    """Demand of {borough number: daily trips}; None: no trips that day."""
    def build(values):
        rows = [(day(i), 8, zone, n) for zone, days in values.items() for i, n in enumerate(days) if n]
        return make_demand(rows, {zone: f"B{zone}" for zone in values})
    return build


def wavy(length, slope=0.7, noise=12):
    return [max(round(WEEKLY[i % 7] + slope * i + RANDOM.uniform(-noise, noise)), 1) for i in range(length)]


def winters(x, origin, horizon):
    """Best one-day-ahead parameters up to the origin, and the forecasts."""
    best = None
    for a, b, g in product(*fc.GRID.values()):
        m1, m2 = sum(x[:7]) / 7, sum(x[7:14]) / 7
        trend = (m2 - m1) / 7
        level = m2 + 3 * trend
        season = [(x[i] - m1 + x[i + 7] - m2) / 2 - trend * (i - 3) for i in range(7)]
        error = 0.0
        for t in range(14, origin + 1):
            error += (x[t] - level - trend - season[t % 7]) ** 2
            new = a * (x[t] - season[t % 7]) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            level = new
            season[t % 7] = g * (x[t] - level) + (1 - g) * season[t % 7]
        key = (round(error, 6), a, b, g)
        if best is None or key < best[0]:
            best = key, [max(level + h * trend + season[(origin + h) % 7], 0) for h in range(1, horizon + 1)]
    return best


def test_holt_winters(series):
    x = wavy(60)
    made = {(r.origin, r.horizon): r.predicted for r in
            fc.holt_winters_forecasts(series({1: x}), horizon=9, origins=5, step=3).collect()}
    assert len(made) == 5 * 9
    for left in range(3, 16, 3):
        origin = 59 - left
        _, ahead = winters(x, origin, 9)
        for h, value in enumerate(ahead, 1):
            assert math.isclose(made[day(origin), h], value, rel_tol=1e-9)
    row = fc.holt_winters_forecast(series({1: x}), horizon=1).first()
    (error, a, b, g), ahead = winters(x, 59, 1)
    assert (row.alpha, row.beta, row.gamma, row.predicted_trip_count) == (a, b, g, round(ahead[0]))
    assert row.sigma == round(math.sqrt(error / 46), 4)
    assert row.upper_bound == round(ahead[0] + 1.96 * math.sqrt(error / 46))


def test_sarima_by_least_squares(series):
    x = wavy(80)
    y = np.array([x[i] - x[i - 7] for i in range(7, 80)], float)
    rows = [(1.0, y[i - 1], y[i - 7]) for i in range(7, len(y))]
    c, phi, seasonal = np.linalg.lstsq(np.array(rows), y[7:], rcond=None)[0]
    found = fc.sarima_forecast(series({1: x}), horizon=8).orderBy("horizon").collect()
    assert np.allclose([found[0].c, found[0].phi, found[0].seasonal_phi], [c, phi, seasonal], atol=1e-5)
    values, differences = list(map(float, x)), list(y)
    for row in found:
        differences.append(c + phi * differences[-1] + seasonal * differences[-7])
        values.append(values[-7] + differences[-1])
        assert abs(row.predicted_trip_count - max(values[-1], 0)) <= 0.5001


def test_same_weekday_repeats_the_baseline(series):
    x = [None if i % 11 == 4 else n for i, n in enumerate(wavy(50))]
    made = {(r.origin, r.forecast_date): r.predicted for r in
            fc.same_weekday_forecasts(series({1: x}), horizon=10, origins=3, step=4).collect()}
    for left in (4, 8, 12):
        if x[49 - left] is None:  # the baseline starts after the last date with trips
            continue
        past = series({1: x[:50 - left]})
        for r in demand_forecast(past, forecast_days=10).collect():
            if (r.forecast_date - START).days < 50:
                assert made[day(49 - left), r.forecast_date] == r.predicted_trip_count


@pytest.mark.parametrize("model", fc.MODELS)
def test_forecasts_know_nothing_of_what_follows(series, model):
    x = wavy(40)
    changed = x[:33] + [5 * n + 3 for n in x[33:]]

    def at_origin(values):
        rows = fc.MODELS[model](series({1: values}), horizon=4, origins=7, step=7).collect()
        return {(r.origin, r.horizon): r.predicted for r in rows if r.origin == day(32)}

    assert at_origin(x) == at_origin(changed) and len(at_origin(x)) == 4


def test_constant_short_and_empty_series(series):
    demand = series({1: [50] * 30, 2: [None] * 16 + [9] * 14})
    for model in (fc.holt_winters_forecast, fc.sarima_forecast):
        rows = model(demand, horizon=3).collect()
        assert {(r.borough, r.predicted_trip_count) for r in rows} == {("B1", 50)} and len(rows) == 3
    nothing = demand.limit(0)
    assert fc.holt_winters_forecast(nothing).collect() == [] and fc.forecast_comparison(nothing).collect() == []


def test_days_without_trips_count_as_zero(series):
    x = [None if i % 7 == 6 else n for i, n in enumerate(wavy(43, noise=1))]
    rows = fc.holt_winters_forecast(series({1: x}), horizon=7).orderBy("horizon").collect()
    assert rows[5].predicted_trip_count < 20 < min(r.predicted_trip_count for r in rows if r.horizon != 6)


def test_errors(series, spark):
    demand = series({1: [10, 20, None, 40]})
    forecasts = spark.createDataFrame(
        [("B1", day(0), 1, day(1), 25.0), ("B1", day(0), 2, day(2), 3.4), ("B1", day(0), 3, day(3), 30.0),
         ("B1", day(0), 4, day(4), 99.0)],
        "borough string, origin date, horizon int, forecast_date date, predicted double")
    row = fc.forecast_errors(forecasts, demand, ["borough"], ["borough"]).first()
    assert (row.forecasts, row.mae, row.mean_error) == (3, 6.0, round((5 + 3 - 10) / 3, 4))
    assert row.rmse == round(math.sqrt((25 + 9 + 100) / 3), 4) and row.mape == 25.0


def test_comparison_ranks_models(series):
    rows = fc.forecast_comparison(series({1: wavy(60), 2: wavy(60, slope=3)}), origins=10).collect()
    assert len(rows) == 6 and {r.place for r in rows} == {1, 2, 3}
    # With a steep trend the mean of past weeks lags behind.
    assert next(r.place for r in rows if (r.borough, r.model) == ("B2", "same_weekday")) == 3


def test_ranges(series):
    demand = series({1: [1] * 20})
    for wrong in ({"horizon": 0}, {"horizon": 31}, {"origins": 0}, {"step": 0}, {"history_weeks": 1}):
        with pytest.raises(ValueError, match="must be between"):
            fc.same_weekday_forecasts(demand, **wrong)
