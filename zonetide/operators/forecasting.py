"""Forecast models and their evaluation at rolling origins.

A series is the daily trips of one group (``by``: borough, zone, ...). Its calendar runs from its first day to the last day
of the data; days without trips count as 0. A forecast made at an origin knows the days up to the origin, nothing later.
All origins, series and parameters are rows of one plan: a series is folded over in the JVM, where its past is an array
of at most as many numbers as there are days. All models give ``by``, origin, horizon, forecast_date, predicted.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonetide.filters import check_range, iso_weekday
from zonetide.functions.numeric import ratio
from zonetide.operators.anomalies import square

SEASON = 7
LEAST_DAYS = 2 * SEASON + 1
GRID = {"alpha": (0.1, 0.3, 0.5, 0.8), "beta": (0.0, 0.1, 0.3), "gamma": (0.1, 0.3, 0.6)}
BAND = 1.96          # standard deviations on either side: 95 %
LEAST_EQUATIONS = 8  # below, the seasonal model has no coefficients
LARGEST_COEFFICIENT = 0.95


def daily_trips(demand: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trips of each group and date that has some."""
    return demand.groupBy(*by, "pickup_date").agg(F.sum("trip_count").alias("trip_count"))


def filled_series(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """``daily`` with a row for every day, and ``last_day``, the last day of all series."""
    last = daily.agg(F.max("pickup_date")).scalar()
    calendar = (daily.groupBy(*by).agg(F.min("pickup_date").alias("first_day")).withColumn("last_day", last)
                .withColumn("pickup_date", F.explode(F.sequence("first_day", "last_day"))).drop("first_day"))
    known = daily.select(*by, "pickup_date", F.col("trip_count").alias("known"))
    return calendar.join(known, [*by, "pickup_date"], "left").select(
        *by, "pickup_date", "last_day", F.coalesce("known", F.lit(0).cast("bigint")).alias("trip_count"),
        F.col("known").isNotNull().alias("has_trips"))


def is_origin(days_left: Column, origins: int, step: int) -> Column:
    """Whether forecasts start on a day with ``days_left`` days after it. With no origins only the last day does."""
    if not origins:
        return days_left == 0
    return (days_left > 0) & (days_left <= origins * step) & (days_left % step == 0)


def _check(horizon: int, origins: int, step: int) -> None:
    check_range("horizon", horizon, 1, 30)
    check_range("origins", origins, 0, 366)
    check_range("step", step, 1, 366)


def same_weekday_forecasts(demand: DataFrame, by: Sequence[str] = ("borough",), horizon: int = 7, origins: int = 14,
                           step: int = 1, history_weeks: int = 4) -> DataFrame:
    """What ``demand_forecast`` would have said at each origin: the mean of the last ``history_weeks`` dates with trips and
    the same weekday, rounded. Dates without any such history have no forecast."""
    _check(horizon, origins, step)
    check_range("history_weeks", history_weeks, 2, 12)
    check_range("origins", origins, 1, 366)
    by = list(by)
    daily = daily_trips(demand, by)
    dated = Window.partitionBy(*by, "weekday").orderBy("day")
    recent = dated.rowsBetween(1 - history_weeks, 0)
    day = F.unix_date("pickup_date")
    means = (daily.withColumns({"weekday": iso_weekday("pickup_date"), "day": day})
             .select(*by, "pickup_date", F.struct(F.sum("trip_count").over(recent).alias("s"),
                                                  F.count("*").over(recent).alias("n")).alias("mean")))
    weeks = range(1, -(-horizon // SEASON) + 1)
    rows = (filled_series(daily, by).join(means, [*by, "pickup_date"], "left")
            .withColumns({"weekday": iso_weekday("pickup_date"), "day": day}))
    # The newest mean that is at least that many weeks old.
    known = rows.select(*by, "pickup_date", "last_day", F.array(*[
        F.last("mean", ignorenulls=True).over(dated.rangeBetween(Window.unboundedPreceding, -SEASON * week))
        for week in weeks]).alias("means"))
    dates = known.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    made = dates.withColumns({
        "origin": F.date_sub("pickup_date", F.col("horizon")),
        "mean": F.get("means", F.floor((F.col("horizon") - 1) / SEASON).cast("int"))})
    left = F.datediff("last_day", "origin")
    return made.where(is_origin(left, origins, step) & F.col("mean").isNotNull()).select(
        *by, "origin", "horizon", F.col("pickup_date").alias("forecast_date"),
        ratio(F.col("mean.s"), F.col("mean.n"), 0).cast("double").alias("predicted"))


def _as_arrays(series: DataFrame, by: list[str]) -> DataFrame:
    """One row a series: its values in order, as doubles."""
    day = F.struct("pickup_date", F.col("trip_count").cast("double").alias("x"))
    return series.groupBy(*by).agg(
        F.max("last_day").alias("last_day"), F.sort_array(F.collect_list(day)).alias("days")).select(
        *by, "last_day", F.transform("days", lambda d: d["x"]).alias("x"), F.size("days").alias("length"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def holt_winters_states(series: DataFrame, by: Sequence[str], origins: int = 0, step: int = 1) -> DataFrame:
    """State of the additive Holt-Winters recursion with a weekly season at each origin, with the parameters that forecast
    best up to there: those of the least sum of squared one-day-ahead errors so far (ties: the smallest parameters).

    The first two weeks start the recursion; series of fewer than 15 days have no rows. Columns: ``by``, origin, level,
    trend, season (the next day's first), alpha, beta, gamma, sigma (root mean square of those errors).
    """
    by = list(by)
    x = F.col("x")
    weeks = [F.slice(x, 1, SEASON), F.slice(x, SEASON + 1, SEASON)]
    starts = (_as_arrays(series, by).where(F.col("length") >= LEAST_DAYS)
              .withColumns({"_m1": _total(weeks[0]) / SEASON, "_m2": _total(weeks[1]) / SEASON})
              .withColumn("_trend", (F.col("_m2") - F.col("_m1")) / SEASON)
              .withColumn("_level", F.col("_m2") + 3 * F.col("_trend"))
              .withColumn("_season", F.transform(F.sequence(F.lit(0), F.lit(SEASON - 1)), lambda i: (
                  (F.get(x, i) - F.col("_m1") + F.get(x, i + SEASON) - F.col("_m2")) / 2
                  - F.col("_trend") * (i - 3)))))
    grid = F.array(*[F.struct(*[F.lit(v).alias(name) for name, v in zip(GRID, values, strict=True)])
                     for values in product(*GRID.values())])
    rows = starts.withColumn("p", F.explode(grid))
    kept_type = "array<struct<left:int,level:double,trend:double,season:array<double>,error:double>>"
    start = F.struct(F.col("_level").alias("level"), F.col("_trend").alias("trend"), F.col("_season").alias("season"),
                     F.lit(0.0).alias("error"), F.array().cast(kept_type).alias("kept"))

    def step_on(state: Column, at: Column) -> Column:
        alpha, beta, gamma = (F.col("p")[name] for name in GRID)
        now, first = F.get(x, at), F.get(state["season"], F.lit(0))
        miss = now - (state["level"] + state["trend"] + first)
        level = alpha * (now - first) + (1 - alpha) * (state["level"] + state["trend"])
        trend = beta * (level - state["level"]) + (1 - beta) * state["trend"]
        season = F.concat(F.slice(state["season"], 2, SEASON - 1),
                          F.array(gamma * (now - level) + (1 - gamma) * first))
        error = state["error"] + miss * miss
        left = F.col("length") - 1 - at
        here = F.array(F.struct(left.alias("left"), level.alias("level"), trend.alias("trend"),
                                season.alias("season"), error.alias("error"))).cast(kept_type)
        return F.struct(level.alias("level"), trend.alias("trend"), season.alias("season"), error.alias("error"),
                        F.when(is_origin(left, origins, step), F.concat(state["kept"], here))
                        .otherwise(state["kept"]).alias("kept"))

    states = F.aggregate(F.sequence(F.lit(LEAST_DAYS - 1), F.col("length") - 1), start, step_on,
                         lambda state: state["kept"])
    made = rows.select(*by, "last_day", "length", "p", F.explode(states).alias("s"))
    best = made.groupBy(*by, "last_day", "length", F.col("s.left").alias("left")).agg(
        F.min_by(F.struct("s", "p"), F.struct(F.round("s.error", 6), "p")).alias("best"))
    errors = F.col("length") - F.col("left") - (LEAST_DAYS - 1)
    return best.select(*by, F.date_sub("last_day", F.col("left")).alias("origin"), "best.s.level", "best.s.trend",
                       "best.s.season", "best.p.alpha", "best.p.beta", "best.p.gamma",
                       F.sqrt(F.col("best.s.error") / errors).alias("sigma"))


def _ahead(states: DataFrame, horizon: int) -> DataFrame:
    h = F.col("horizon")
    return states.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumns({
        "forecast_date": F.date_add("origin", h),
        "predicted": F.greatest(F.col("level") + h * F.col("trend") + F.get("season", (h - 1) % SEASON), F.lit(0.0))})


def holt_winters_forecasts(demand: DataFrame, by: Sequence[str] = ("borough",), horizon: int = 7, origins: int = 14,
                           step: int = 1) -> DataFrame:
    """Holt-Winters forecasts at every origin; parameters are chosen anew at each, from what was known there."""
    _check(horizon, origins, step)
    states = holt_winters_states(filled_series(daily_trips(demand, by), by), by, origins, step)
    return _ahead(states, horizon).select(*by, "origin", "horizon", "forecast_date", "predicted")


def holt_winters_forecast(demand: DataFrame, by: Sequence[str] = ("borough",), horizon: int = 7) -> DataFrame:
    """Forecast after the last day, with a 95 % band and the smoothing parameters chosen.

    The band has the width that the errors seen so far give the additive model at each horizon.
    """
    _check(horizon, 0, 1)
    ahead = _ahead(holt_winters_states(filled_series(daily_trips(demand, by), by), by), horizon)
    alpha, beta, gamma, h = F.col("alpha"), F.col("beta"), F.col("gamma"), F.col("horizon")

    def grown(total: Column, j: Column) -> Column:
        weight = alpha * (1 + j * beta) + F.when(j % SEASON == 0, gamma * (1 - alpha)).otherwise(0.0)
        return total + weight * weight

    growth = F.when(h == 1, 1.0).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(h - 1, F.lit(1))), F.lit(1.0), grown))
    width = F.lit(BAND) * F.col("sigma") * F.sqrt("_growth")
    return ahead.withColumn("_growth", growth).select(
        *by, "forecast_date", "horizon", *_whole_band(F.col("predicted"), width),
        "alpha", "beta", "gamma", F.round("sigma", 4).alias("sigma"))


def _whole(value: Column) -> Column:
    return F.round(value, 0).cast("bigint")


def _whole_band(predicted: Column, width: Column) -> list[Column]:
    return [_whole(predicted).alias("predicted_trip_count"),
            _whole(F.greatest(predicted - width, F.lit(0.0))).alias("lower_bound"),
            _whole(predicted + width).alias("upper_bound")]


def seasonal_ar_states(series: DataFrame, by: Sequence[str], origins: int = 0, step: int = 1) -> DataFrame:
    """SARIMA (1,0,0)(1,1,0) with a weekly season, by conditional least squares, at each origin.

    The difference of a day to the same weekday before is regressed on a constant, the day before's and the week before's
    difference. The sums of the normal equations run along each series, so every origin has those of its past; the three
    equations are solved in column expressions. With fewer than 8 equations, or where they don't determine the
    coefficients, all are 0, which repeats the last week. Coefficients are held within 0.95. Series of fewer than 15
    days have no rows. Columns: ``by``, origin, c, phi, seasonal_phi, x and y (the last week's values and differences).
    """
    by = list(by)
    dated = Window.partitionBy(*by).orderBy("pickup_date")
    value = F.col("trip_count")

    def back(days: int) -> Column:
        return F.lag("trip_count", days).over(dated)

    lagged = series.withColumns({
        "y": value - back(7), "y1": back(1) - back(8), "y7": back(7) - back(14),
        "left": F.datediff("last_day", "pickup_date")})
    sofar = dated.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"n": F.lit(1), "s1": F.col("y1"), "s7": F.col("y7"), "s": F.col("y"), "s11": F.col("y1") * F.col("y1"),
            "s77": F.col("y7") * F.col("y7"), "s17": F.col("y1") * F.col("y7"), "sy1": F.col("y") * F.col("y1"),
            "sy7": F.col("y") * F.col("y7")}
    whole = F.col("y7").isNotNull()
    rows = lagged.withColumns({
        **{name: F.sum(F.when(whole, term)).over(sofar).cast("double") for name, term in sums.items()},
        "x": F.collect_list(value.cast("double")).over(dated.rowsBetween(1 - SEASON, 0)),
        "d": F.collect_list(F.col("y").cast("double")).over(dated.rowsBetween(1 - SEASON, 0))})
    at = rows.where(is_origin(F.col("left"), origins, step) & F.col("y7").isNotNull())
    n, s1, s7, s, s11, s77, s17, sy1, sy7 = (F.col(c) for c in sums)
    # Centred, the constant drops out of the equations.
    centred = at.withColumns({
        "v11": n * s11 - s1 * s1, "v77": n * s77 - s7 * s7, "v17": n * s17 - s1 * s7,
        "vy1": n * sy1 - s * s1, "vy7": n * sy7 - s * s7})
    v11, v77, v17, vy1, vy7 = (F.col(c) for c in ("v11", "v77", "v17", "vy1", "vy7"))
    determined = centred.withColumn("det", v11 * v77 - v17 * v17)
    solvable = (n >= LEAST_EQUATIONS) & (F.col("det") > 1e-9 * v11 * v77)

    def held(numerator: Column) -> Column:
        exact = F.when(solvable, numerator / F.col("det")).otherwise(0.0)
        return F.greatest(F.least(exact, F.lit(LARGEST_COEFFICIENT)), F.lit(-LARGEST_COEFFICIENT))

    solved = determined.withColumns({"phi": held(vy1 * v77 - vy7 * v17), "seasonal_phi": held(vy7 * v11 - vy1 * v17)})
    constant = F.when(solvable, (s - F.col("phi") * s1 - F.col("seasonal_phi") * s7) / n).otherwise(0.0)
    return solved.withColumn("c", constant).select(
        *by, F.col("pickup_date").alias("origin"), "c", "phi", "seasonal_phi", "x", F.col("d").alias("y"))


def _seasonal_ahead(states: DataFrame, horizon: int) -> DataFrame:
    start = F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.array().cast("array<double>").alias("out"))

    def next_day(state: Column, _: Column) -> Column:
        y = F.col("c") + F.col("phi") * F.get(state["y"], F.lit(SEASON - 1)) + F.col("seasonal_phi") * F.get(
            state["y"], F.lit(0))
        x = F.get(state["x"], F.lit(0)) + y

        def shifted(values: Column, last: Column) -> Column:
            return F.concat(F.slice(values, 2, SEASON - 1), F.array(last))

        return F.struct(shifted(state["x"], x).alias("x"), shifted(state["y"], y).alias("y"),
                        F.concat(state["out"], F.array(x)).alias("out"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, next_day, lambda state: state["out"])
    days = states.select("*", F.posexplode(out).alias("place", "ahead")).withColumn("horizon", F.col("place") + 1)
    return days.withColumns({"forecast_date": F.date_add("origin", F.col("horizon")),
                             "predicted": F.greatest("ahead", F.lit(0.0))})


def sarima_forecasts(demand: DataFrame, by: Sequence[str] = ("borough",), horizon: int = 7, origins: int = 14,
                     step: int = 1) -> DataFrame:
    """Seasonal autoregressive forecasts at every origin, with coefficients from the days up to it."""
    _check(horizon, origins, step)
    states = seasonal_ar_states(filled_series(daily_trips(demand, by), by), by, origins, step)
    return _seasonal_ahead(states, horizon).select(*by, "origin", "horizon", "forecast_date", "predicted")


def sarima_forecast(demand: DataFrame, by: Sequence[str] = ("borough",), horizon: int = 7) -> DataFrame:
    """Forecast after the last day, with the coefficients (6 decimals)."""
    _check(horizon, 0, 1)
    states = seasonal_ar_states(filled_series(daily_trips(demand, by), by), by)
    return _seasonal_ahead(states, horizon).select(
        *by, "forecast_date", "horizon", _whole(F.col("predicted")).alias("predicted_trip_count"),
        *[F.round(c, 6).alias(c) for c in ("c", "phi", "seasonal_phi")])


def forecast_errors(forecasts: DataFrame, demand: DataFrame, by: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Errors of forecasts (rounded to whole trips) against what came, by ``groups``: number, MAE, RMSE, MAPE and mean error
    (positive: too high), 4 decimals. Days after the data don't count; days without trips count, but not for MAPE, which
    is null if there are no others."""
    by = list(by)
    actual = filled_series(daily_trips(demand, by), by).select(
        *by, F.col("pickup_date").alias("forecast_date"), F.col("trip_count").alias("actual"))
    error = F.col("error")
    errors = forecasts.join(actual, [*by, "forecast_date"]).withColumn(
        "error", _whole(F.col("predicted")) - F.col("actual"))
    share = F.abs(error) / F.nullif(F.col("actual"), F.lit(0).cast("bigint"))
    n = F.count("*")
    return errors.groupBy(*groups).agg(
        n.cast("int").alias("forecasts"),
        ratio(F.sum(F.abs(error)), n, 4).cast("double").alias("mae"),
        F.round(F.sqrt(F.sum(square(error)).cast("double") / n), 4).alias("rmse"),
        F.round(100 * F.avg(share), 4).alias("mape"),
        ratio(F.sum(error), n, 4).cast("double").alias("mean_error"))


MODELS = {"same_weekday": same_weekday_forecasts, "holt_winters": holt_winters_forecasts, "sarima": sarima_forecasts}


def forecast_backtest(demand: DataFrame, by: Sequence[str] = ("borough",), model: str = "same_weekday",
                      horizon: int = 7, origins: int = 14, step: int = 1) -> DataFrame:
    """Errors of a model by series and horizon over the last ``origins`` origins, ``step`` days apart."""
    made = MODELS[model](demand, by, horizon=horizon, origins=origins, step=step)
    return forecast_errors(made, demand, by, [*by, "horizon"])


def forecast_comparison(demand: DataFrame, by: Sequence[str] = ("borough",), horizon: int = 7, origins: int = 14,
                        step: int = 1) -> DataFrame:
    """Errors of all models by series, over all horizons, and their place: 1 for the least MAE, ties by RMSE and name."""
    both = None
    for name, model in MODELS.items():
        made = model(demand, by, horizon=horizon, origins=origins, step=step).withColumn("model", F.lit(name))
        both = made if both is None else both.unionByName(made)
    errors = forecast_errors(both, demand, by, [*by, "model"])
    place = F.row_number().over(Window.partitionBy(*by).orderBy("mae", "rmse", "model"))
    return errors.withColumn("place", place)
