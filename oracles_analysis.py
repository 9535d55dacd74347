"""DuckDB SQL giving the expected result of each query in ``zonetide.plans.analysis``."""

from __future__ import annotations

from oracles import BASE, DIRTY, LONG_BASE, LONG_TRIPS, PARCELS, TRIPS, ZONES, half_away, half_up, scaled


def two_sided(z: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * (abs({z}) / sqrt(2.0::DOUBLE))))"
    a = [f"{c}::DOUBLE" for c in (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)]
    tail = f"((((({a[4]} * {t} + {a[3]}) * {t}) + {a[2]}) * {t} + {a[1]}) * {t} + {a[0]}) * {t}"
    return f"round({tail} * exp(-({z}) * ({z}) / 2), 6)"


def zone_values(where: str = "true", zones: str = "true") -> str:
    return f"""{BASE}, vals AS (
  SELECT z.location_id, z.zone_name, z.borough, z.gx, z.gy, CAST(coalesce(sum(n), 0) AS BIGINT) AS x
  FROM (SELECT * FROM zones WHERE {zones}) z
  LEFT JOIN (SELECT * FROM demand WHERE {where}) d ON d.location_id = z.location_id GROUP BY ALL)"""


PARCEL_VALUES = f"""WITH {PARCELS}, vals AS (
  SELECT p.location_id, p.gx, p.gy, CAST(coalesce(o.n, 0) AS BIGINT) AS x
  FROM parcels p LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o
    ON o.o_custkey = p.location_id)"""

# Pairs of touching squares, among the given ones.
STEPS = """pairs AS (
  SELECT a.location_id, b.location_id AS other, b.x AS other_x
  FROM (SELECT location_id, gx + dx AS nx, gy + dy AS ny
        FROM vals CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy)) a
  JOIN vals b ON b.gx = a.nx AND b.gy = a.ny AND b.location_id <> a.location_id)"""
TOTALS = """totals AS (
  SELECT count(*) AS n, CAST(sum(x) AS HUGEINT) AS s,
         count(*) * CAST(sum(x * x) AS HUGEINT) - CAST(sum(x) AS HUGEINT) * CAST(sum(x) AS HUGEINT) AS spread
  FROM vals)"""


def gi_star(values: str, names: str, rate: float = 0.05) -> str:
    return f"""{values}, {STEPS}, {TOTALS}, around AS (
  SELECT v.*, count(p.other) AS k, coalesce(sum(p.other_x), 0) AS lag
  FROM vals v LEFT JOIN pairs p ON p.location_id = v.location_id GROUP BY ALL), parts AS (
  SELECT a.*, CAST(n * (x + lag) - s * (k + 1) AS DOUBLE) AS difference,
         CAST(spread AS DOUBLE) / (n - 1) * CAST((k + 1) * (n - k - 1) AS DOUBLE) AS variance
  FROM around a CROSS JOIN totals), scored AS (
  SELECT *, CASE WHEN variance > 0 THEN difference / sqrt(variance) ELSE 0 END AS z FROM parts), tested AS (
  SELECT *, round(z, 4) + 0 AS gi_star,
         CASE WHEN variance > 0 THEN {two_sided('z')} ELSE 1 END AS p_value FROM scored), ranked AS (
  SELECT *, cume_dist() OVER (ORDER BY p_value) AS share FROM tested), binned AS (
  SELECT *, coalesce(p_value <= (SELECT max(p_value) FROM ranked WHERE p_value <= {rate}::DOUBLE * share), false)
           AS fdr_significant,
         CAST(sign(gi_star) * CASE WHEN p_value <= 0.01 THEN 3 WHEN p_value <= 0.05 THEN 2
              WHEN p_value <= 0.1 THEN 1 ELSE 0 END AS INTEGER) AS gi_bin FROM ranked)
SELECT location_id{names}, x AS trip_count, CAST(k AS INTEGER) AS neighbour_count, gi_star, p_value, fdr_significant,
       gi_bin, CASE gi_bin WHEN 3 THEN 'Hotspot 99%' WHEN 2 THEN 'Hotspot 95%' WHEN 1 THEN 'Hotspot 90%'
         WHEN 0 THEN 'Not Significant' WHEN -1 THEN 'Coldspot 90%' WHEN -2 THEN 'Coldspot 95%'
         ELSE 'Coldspot 99%' END AS gi_class
FROM binned"""


DEVIATIONS = """deviations AS (
  SELECT v.*, t.n, t.spread, CAST(t.n * x - t.s AS HUGEINT) AS d FROM vals v CROSS JOIN totals t), local AS (
  SELECT d.*, coalesce(l.k, 0) AS k, coalesce(l.lag, 0) AS lag FROM deviations d LEFT JOIN (
    SELECT p.location_id, count(*) AS k, CAST(sum(o.d) AS HUGEINT) AS lag
    FROM pairs p JOIN deviations o ON o.location_id = p.other GROUP BY 1) l ON l.location_id = d.location_id)"""


def morans_i(values: str) -> str:
    return f"""{values}, {STEPS}, {TOTALS}, {DEVIATIONS}, sums AS (
  SELECT count(*) AS zones, CAST(sum(k) AS BIGINT) AS links, CAST(sum(k * k) AS DOUBLE) AS squares,
         CAST(sum(d * lag) AS DOUBLE) AS crossed, CAST(max(spread) AS DOUBLE) AS spread,
         sum(pow(CAST(d AS DOUBLE) / sqrt(nullif(CAST(spread AS DOUBLE), 0)), 4)) / count(*) AS b,
         CAST(count(*) AS DOUBLE) AS n, nullif(CAST(sum(k) AS DOUBLE), 0) AS w
  FROM local), found AS (
  SELECT *, crossed / (w * nullif(spread, 0)) AS i, -1 / nullif(n - 1, 0) AS e,
         (n * ((n * n - 3 * n + 3) * 2 * w - n * 4 * squares + 3 * w * w)
          - b * ((n * n - n) * 2 * w - 2 * n * 4 * squares + 6 * w * w))
           / (nullif((n - 1) * (n - 2) * (n - 3), 0) * w * w) AS second FROM sums), spreads AS (
  SELECT *, greatest(second - e * e, 0) AS v FROM found), tested AS (
  SELECT *, CASE WHEN zones > 3 THEN (i - e) / sqrt(nullif(v, 0)) END AS z FROM spreads)
SELECT zones, links, round(i, 6) + 0 AS morans_i, round(e, 6) + 0 AS expected_i,
       CASE WHEN zones > 3 AND i IS NOT NULL THEN round(v, 6) END AS variance, round(z, 6) + 0 AS z_score,
       {two_sided('z')} AS p_value
FROM tested"""


def lisa(values: str, names: str, replicates: str, permutations: int, alpha: float) -> str:
    quadrant = """CASE WHEN d > 0 AND lag > 0 THEN 'High-High' WHEN d < 0 AND lag < 0 THEN 'Low-Low'
         WHEN d > 0 AND lag < 0 THEN 'High-Low' WHEN d < 0 AND lag > 0 THEN 'Low-High' ELSE 'Undefined' END"""
    return f"""{values}, {STEPS}, {TOTALS}, {DEVIATIONS}, dealt AS (
  SELECT r, location_id, d, row_number() OVER (
    PARTITION BY r ORDER BY md5(r || ':' || location_id), location_id) AS place
  FROM local CROSS JOIN range(1, {permutations + 1}) reps(r)), {replicates}, tested AS (
  SELECT s.location_id, round((least(count(*) FILTER (total >= lag), count(*) FILTER (total <= lag)) + 1)
                              / {permutations + 1}::DOUBLE, 6) AS p_value
  FROM sampled s JOIN local l ON l.location_id = s.location_id GROUP BY 1), named AS (
  SELECT l.*, p_value, CASE WHEN k > 0 THEN {quadrant} END AS quadrant
  FROM local l LEFT JOIN tested t ON t.location_id = l.location_id)
SELECT location_id{names}, x AS trip_count, CAST(k AS INTEGER) AS neighbour_count,
       CASE WHEN k > 0 THEN round(CAST(d AS DOUBLE) * CAST(lag AS DOUBLE)
            / (k * nullif(CAST(spread AS DOUBLE), 0)), 6) + 0 END AS local_i, quadrant, p_value,
       CASE WHEN k = 0 THEN 'No Neighbours' WHEN p_value <= {alpha}::DOUBLE THEN quadrant
            ELSE 'Not Significant' END AS cluster
FROM named"""


# Every zone takes the first k of the others in each replicate's order: all others are ranked.
RANKED_OTHERS = """others AS (
  SELECT i.location_id, i.k, a.r, a.d, row_number() OVER (PARTITION BY i.location_id, a.r ORDER BY a.place) AS nth
  FROM local i JOIN dealt a ON a.location_id <> i.location_id WHERE i.k > 0), sampled AS (
  SELECT location_id, r, sum(d) AS total FROM others WHERE nth <= k GROUP BY 1, 2)"""
# The same for many parcels: places 1 to k + 1, the own one and, if it isn't among them, the last one left out.
NEAR_OTHERS = """wanted AS (
  SELECT i.location_id, i.k, a.r, a.place AS own, unnest(range(1, i.k + 2)) AS place
  FROM local i JOIN dealt a ON a.location_id = i.location_id WHERE i.k > 0), sampled AS (
  SELECT w.location_id, w.r, sum(a.d) AS total FROM wanted w JOIN dealt a ON a.r = w.r AND a.place = w.place
  WHERE w.place <> w.own AND w.place <= w.k + CASE WHEN w.own <= w.k THEN 1 ELSE 0 END GROUP BY 1, 2)"""

def filled(base: str, by: str) -> str:
    """Every day of each series, with the days since its start (t) and to the end (days_left)."""
    return f"""{base.replace("WITH", "WITH RECURSIVE", 1)}, daily AS (
  SELECT {by}, pickup_date, CAST(sum(n) AS BIGINT) AS x FROM demand GROUP BY 1, 2), ending AS (
  SELECT max(pickup_date) AS last_day FROM daily), calendar AS (
  SELECT {by}, last_day, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS pickup_date
  FROM (SELECT {by}, min(pickup_date) AS first_day FROM daily GROUP BY 1) CROSS JOIN ending), filled AS (
  SELECT c.{by}, c.pickup_date, coalesce(d.x, 0) AS x, last_day - c.pickup_date AS days_left,
         row_number() OVER (PARTITION BY c.{by} ORDER BY c.pickup_date) - 1 AS t
  FROM calendar c LEFT JOIN daily d ON d.{by} = c.{by} AND d.pickup_date = c.pickup_date)"""


def is_origin(origins: int, step: int) -> str:
    if not origins:
        return "days_left = 0"
    return f"days_left BETWEEN 1 AND {origins * step} AND days_left % {step} = 0"


def horizons(horizon: int) -> str:
    return f"(SELECT CAST(h AS INTEGER) AS horizon FROM range(1, {horizon + 1}) r(h))"


def same_weekday(by: str, horizon: int, origins: int, step: int, weeks: int = 4) -> str:
    """CTE same_weekday: every past date of the same weekday is listed for each forecast, newest first."""
    return f"""weekday_dates AS (
  SELECT f.{by}, f.pickup_date AS origin, horizon, f.pickup_date + horizon AS forecast_date
  FROM filled f CROSS JOIN {horizons(horizon)} WHERE {is_origin(origins, step)}), weekday_past AS (
  SELECT w.*, d.x, row_number() OVER (PARTITION BY w.{by}, origin, horizon ORDER BY d.pickup_date DESC) AS r
  FROM weekday_dates w JOIN daily d ON d.{by} = w.{by} AND d.pickup_date <= w.origin
    AND isodow(d.pickup_date) = isodow(w.forecast_date)), same_weekday AS (
  SELECT {by}, origin, horizon, forecast_date, CAST({half_up('sum(x)', 'count(*)')} AS DOUBLE) AS predicted
  FROM weekday_past WHERE r <= {weeks} GROUP BY 1, 2, 3, 4)"""


def holt_winters(by: str, horizon: int, origins: int, step: int) -> str:
    """CTEs best (states at origins) and holt_winters. The recursion runs over days and carries all parameters."""
    return f"""firsts AS (
  SELECT {by}, list(CAST(x AS DOUBLE) ORDER BY t) AS xs, count(*) AS length
  FROM filled GROUP BY 1 HAVING count(*) >= 15), weeks AS (
  SELECT *, (xs[1] + xs[2] + xs[3] + xs[4] + xs[5] + xs[6] + xs[7]) / 7 AS m1,
         (xs[8] + xs[9] + xs[10] + xs[11] + xs[12] + xs[13] + xs[14]) / 7 AS m2 FROM firsts), starts AS (
  SELECT *, (m2 - m1) / 7 AS slope FROM weeks), params AS (
  SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g FROM (
    SELECT unnest([0.1, 0.3, 0.5, 0.8]) AS a) CROSS JOIN (SELECT unnest([0.0, 0.1, 0.3]) AS b)
    CROSS JOIN (SELECT unnest([0.1, 0.3, 0.6]) AS g)), states AS (
  SELECT {by}, length, a, b, g, CAST(13 AS BIGINT) AS t, m2 + 3 * slope AS level, slope AS trend,
         [(xs[i + 1] - m1 + xs[i + 8] - m2) / 2 - slope * (i - 3) for i in range(0, 7)] AS season,
         0.0::DOUBLE AS error
  FROM starts CROSS JOIN params
  UNION ALL
  SELECT {by}, length, a, b, g, t, l2 AS level, b * (l2 - level) + (1 - b) * trend AS trend,
         list_concat(season[2:7], [g * (x - l2) + (1 - g) * season[1]]) AS season,
         error + (x - (level + trend + season[1])) * (x - (level + trend + season[1])) AS error
  FROM (SELECT s.* EXCLUDE (t), f.t, f.x, a * (f.x - season[1]) + (1 - a) * (level + trend) AS l2
        FROM states s JOIN filled f ON f.{by} = s.{by} AND f.t = s.t + 1)), kept AS (
  SELECT s.*, f.pickup_date AS origin FROM states s JOIN filled f ON f.{by} = s.{by} AND f.t = s.t
  WHERE s.t >= 14 AND {is_origin(origins, step)}), best AS (
  SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {by}, origin ORDER BY round(error, 6), a, b, g) = 1),
holt_winters AS (
  SELECT {by}, origin, horizon, origin + horizon AS forecast_date, a, b, g, sqrt(error / (t - 13)) AS sigma,
         greatest(level + horizon * trend + season[(horizon - 1) % 7 + 1], 0) AS predicted
  FROM best CROSS JOIN {horizons(horizon)})"""


def sarima(by: str, horizon: int, origins: int, step: int) -> str:
    """CTEs coefficients (at origins) and sarima: least squares over all days up to each origin, joined anew."""
    return f"""lagged AS (
  SELECT {by}, pickup_date, days_left, t, x, x - lag(x, 7) OVER w AS y, lag(x, 1) OVER w - lag(x, 8) OVER w AS y1,
         lag(x, 7) OVER w - lag(x, 14) OVER w AS y7
  FROM filled WINDOW w AS (PARTITION BY {by} ORDER BY t)), equations AS (
  SELECT o.{by}, o.pickup_date AS origin, o.t, CAST(count(*) AS DOUBLE) AS n,
         {", ".join(f"CAST(sum({e}) AS DOUBLE) AS {name}" for name, e in (
             ("s1", "l.y1"), ("s7", "l.y7"), ("s", "l.y"), ("s11", "l.y1 * l.y1"), ("s77", "l.y7 * l.y7"),
             ("s17", "l.y1 * l.y7"), ("sy1", "l.y * l.y1"), ("sy7", "l.y * l.y7")))}
  FROM lagged o JOIN lagged l ON l.{by} = o.{by} AND l.t <= o.t AND l.y7 IS NOT NULL
  WHERE o.t >= 14 AND {is_origin(origins, step).replace("days_left", "o.days_left")} GROUP BY 1, 2, 3), centred AS (
  SELECT *, n * s11 - s1 * s1 AS v11, n * s77 - s7 * s7 AS v77, n * s17 - s1 * s7 AS v17,
         n * sy1 - s * s1 AS vy1, n * sy7 - s * s7 AS vy7 FROM equations), determined AS (
  SELECT *, v11 * v77 - v17 * v17 AS det FROM centred), solved AS (
  SELECT *, n >= 8 AND det > 1e-9 * v11 * v77 AS solvable FROM determined), held AS (
  SELECT *, greatest(least(CASE WHEN solvable THEN (vy1 * v77 - vy7 * v17) / det ELSE 0 END, 0.95), -0.95) AS phi,
         greatest(least(CASE WHEN solvable THEN (vy7 * v11 - vy1 * v17) / det ELSE 0 END, 0.95), -0.95)
           AS seasonal_phi FROM solved), coefficients AS (
  SELECT *, CASE WHEN solvable THEN (s - phi * s1 - seasonal_phi * s7) / n ELSE 0 END AS c FROM held), ahead AS (
  SELECT o.{by}, o.origin, CAST(0 AS INTEGER) AS horizon, c, phi, seasonal_phi,
         list(CAST(l.x AS DOUBLE) ORDER BY l.t) AS xs, list(CAST(l.y AS DOUBLE) ORDER BY l.t) AS ys
  FROM coefficients o JOIN lagged l ON l.{by} = o.{by} AND l.t BETWEEN o.t - 6 AND o.t GROUP BY ALL
  UNION ALL
  SELECT {by}, origin, horizon + 1, c, phi, seasonal_phi,
         list_concat(xs[2:7], [xs[1] + (c + phi * ys[7] + seasonal_phi * ys[1])]),
         list_concat(ys[2:7], [c + phi * ys[7] + seasonal_phi * ys[1]])
  FROM ahead WHERE horizon < {horizon}), sarima AS (
  SELECT {by}, origin, horizon, origin + horizon AS forecast_date, c, phi, seasonal_phi,
         greatest(xs[7], 0) AS predicted FROM ahead WHERE horizon > 0)"""


def errors(forecasts: str, by: str, groups: str) -> str:
    return f"""
SELECT {groups}, CAST(count(*) AS INTEGER) AS forecasts,
       {scaled(half_up('10000 * sum(abs(e))', 'count(*)'), 10000)} AS mae,
       round(sqrt(CAST(sum(e * e) AS DOUBLE) / count(*)), 4) AS rmse,
       round(100 * avg(CAST(abs(e) AS DOUBLE) / nullif(actual, 0)), 4) AS mape,
       {scaled(half_away('10000 * sum(e)', 'count(*)'), 10000)} AS mean_error
FROM (SELECT p.*, f.x AS actual, CAST(round(predicted) AS BIGINT) - f.x AS e
      FROM ({forecasts}) p JOIN filled f ON f.{by} = p.{by} AND f.pickup_date = p.forecast_date) GROUP BY ALL"""


CTES = {"same_weekday": same_weekday, "holt_winters": holt_winters, "sarima": sarima}


def backtest(base: str, by: str, model: str, horizon: int = 7, origins: int = 14, step: int = 1) -> str:
    return (f"{filled(base, by)}, {CTES[model](by, horizon, origins, step)}"
            + errors(f"SELECT * FROM {model}", by, f"{by}, horizon"))


def comparison(base: str, by: str, horizon: int = 7, origins: int = 14, step: int = 1) -> str:
    models = ", ".join(cte(by, horizon, origins, step) for cte in CTES.values())
    union = " UNION ALL ".join(f"SELECT {by}, forecast_date, predicted, '{name}' AS model FROM {name}" for name in CTES)
    return f"""{filled(base, by)}, {models}, compared AS ({errors(union, by, f"{by}, model")})
SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY mae, rmse, model) AS INTEGER) AS place FROM compared"""


def holt_winters_forecast(base: str, by: str, horizon: int = 7) -> str:
    weight = "a * (1 + j * b) + CASE WHEN j % 7 = 0 THEN g * (1 - a) ELSE 0 END"
    return f"""{filled(base, by)}, {holt_winters(by, horizon, 0, 1)}, widths AS (
  SELECT *, 1.96::DOUBLE * sigma * sqrt(1 + coalesce(list_sum(
    [({weight}) * ({weight}) for j in range(1, horizon)]), 0)) AS width FROM holt_winters)
SELECT {by}, forecast_date, horizon, CAST(round(predicted) AS BIGINT) AS predicted_trip_count,
       CAST(round(greatest(predicted - width, 0)) AS BIGINT) AS lower_bound,
       CAST(round(predicted + width) AS BIGINT) AS upper_bound, a AS alpha, b AS beta, g AS gamma,
       round(sigma, 4) AS sigma
FROM widths"""


def sarima_forecast(base: str, by: str, horizon: int = 7) -> str:
    return f"""{filled(base, by)}, {sarima(by, horizon, 0, 1)}
SELECT {by}, forecast_date, horizon, CAST(round(predicted) AS BIGINT) AS predicted_trip_count,
       round(c, 6) + 0 AS c, round(phi, 6) + 0 AS phi, round(seasonal_phi, 6) + 0 AS seasonal_phi
FROM sarima"""


# Sides of the parcels with 32 steps: corners stay, and the middle of a side that is bent by more than 0.0001.
BORDERS = f"""WITH {PARCELS}, sides AS (
  SELECT location_id, gx, gy, false AS upright FROM parcels
  UNION ALL SELECT location_id, gx, gy + 1, false FROM parcels
  UNION ALL SELECT location_id, gx, gy, true FROM parcels
  UNION ALL SELECT location_id, gx + 1, gy, true FROM parcels), bent AS (
  SELECT *, CASE WHEN NOT upright THEN ((gx * 5 + gy * 11) * 7 + 3) % 21 - 10 WHEN gx % 128 = 0 THEN 0
            ELSE ((gx * 3 + gy * 13) * 7 + 3) % 21 - 10 END AS bend FROM sides)"""

SIMPLIFIED_MAP = f"""{BORDERS}, points AS (
  SELECT location_id, (gx + dx) * 0.25::DOUBLE AS x, (gy + dy) * 0.25::DOUBLE AS y
  FROM parcels CROSS JOIN range(0, 2) a(dx) CROSS JOIN range(0, 2) b(dy)
  UNION ALL SELECT location_id,
    CASE WHEN upright THEN gx * 0.25::DOUBLE + bend * 0.000018::DOUBLE ELSE gx * 0.25::DOUBLE + 0.125 END,
    CASE WHEN upright THEN gy * 0.25::DOUBLE + 0.125 ELSE gy * 0.25::DOUBLE + bend * 0.000018::DOUBLE END
  FROM bent WHERE abs(bend) >= 6)
SELECT DISTINCT location_id, round(x, 6) AS x, round(y, 6) AS y FROM points"""

COMMON_BORDERS = f"""{BORDERS}, shared AS (
  SELECT gx, gy, upright, CASE WHEN abs(max(bend)) >= 6 THEN 2 ELSE 1 END AS edges, count(*) AS zones
  FROM bent GROUP BY 1, 2, 3)
SELECT zones, CAST(sum(edges) AS BIGINT) AS edges FROM shared GROUP BY 1"""


ZONES_FROM_GEOJSON = f"""WITH {PARCELS}
SELECT location_id, zone_name, borough, CAST(s AS INTEGER) AS seq,
       (gx + CASE WHEN s IN (1, 2) THEN 1 ELSE 0 END) * 0.25::DOUBLE AS x,
       (gy + CASE WHEN s IN (2, 3) THEN 1 ELSE 0 END) * 0.25::DOUBLE AS y
FROM parcels CROSS JOIN range(0, 5) r(s)"""

METRIC = f"""WITH {PARCELS}, corners AS (
  SELECT location_id, CAST(s AS INTEGER) AS seq,
         (gx + 436 + CASE WHEN s IN (1, 2) THEN 1 ELSE 0 END) * 1000.0::DOUBLE AS x,
         (gy + 4500 + CASE WHEN s IN (2, 3) THEN 1 ELSE 0 END) * 1000.0::DOUBLE AS y
  FROM parcels CROSS JOIN range(0, 5) r(s))"""

WEB_MERCATOR = f"""{METRIC}
SELECT location_id, seq, round(degrees(x / 6378137), 7) AS lon,
       round(degrees(2 * atan(exp(y / 6378137)) - pi() / 2), 7) AS lat FROM corners"""


def utm() -> str:
    """Zone 18: back from the grid by the series in the third flattening; latitude by Newton's method."""
    beta = ("n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360", "n2 / 48 + n3 / 15 - 437 * n4 / 1440",
            "17 * n3 / 480 - 37 * n4 / 840", "4397 * n4 / 161280")

    def waves(a: str, b: str) -> str:
        return " - ".join(f"({c}) * {a}({2 * j} * u) * {b}({2 * j} * v)" for j, c in enumerate(beta, start=1))

    steps = []
    for i in range(5):
        # tau is the tangent of the latitude; its conformal counterpart has to become tau0.
        sigma = f"sinh(e * atanh(e * t{i} / sqrt(1 + t{i} * t{i})))"
        steps.append(f"""s{i} AS (SELECT *, t{i} * sqrt(1 + pow({sigma}, 2)) - {sigma} * sqrt(1 + t{i} * t{i}) AS c{i}
  FROM {f"t{i}" if i else "start"}), t{i + 1} AS (
  SELECT *, t{i} + (tau0 - c{i}) / sqrt(1 + c{i} * c{i}) * (1 + (1 - e * e) * t{i} * t{i})
         / ((1 - e * e) * sqrt(1 + t{i} * t{i})) AS t{i + 1} FROM s{i})""")
    return f"""{METRIC}, ellipsoid AS (
  SELECT f / (2 - f) AS n, pow(f / (2 - f), 2) AS n2, pow(f / (2 - f), 3) AS n3, pow(f / (2 - f), 4) AS n4,
         sqrt(f * (2 - f)) AS e
  FROM (SELECT 1 / 298.257223563::DOUBLE AS f)), grid AS (
  SELECT *, y / (0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n2 / 4 + n4 / 64)) AS u,
         (x - 500000) / (0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n2 / 4 + n4 / 64)) AS v
  FROM corners CROSS JOIN ellipsoid), sphere AS (
  SELECT *, u - {waves('sin', 'cosh')} AS xi, v - {waves('cos', 'sinh')} AS eta FROM grid), start AS (
  SELECT *, sin(xi) / sqrt(pow(sinh(eta), 2) + pow(cos(xi), 2)) AS tau0,
         sin(xi) / sqrt(pow(sinh(eta), 2) + pow(cos(xi), 2)) AS t0 FROM sphere), {', '.join(steps)}
SELECT location_id, seq, round(degrees(atan2(sinh(eta), cos(xi))) - 75, 7) AS lon,
       round(degrees(atan(t5)), 7) AS lat FROM t5"""


# Destinations of the event trips follow from k, those of line items from the part.
FLOWS = f"""WITH RECURSIVE {ZONES}, {TRIPS}, flows AS (
  SELECT pickup_date, pickup_hour, t.location_id AS origin_id, CAST(k % 25 + 1 AS SMALLINT) AS destination_id,
         o.borough, count(*) AS n, CAST(sum(seconds) AS BIGINT) AS seconds, CAST(sum(cents) AS BIGINT) AS cents
  FROM trips t JOIN zones o ON o.location_id = t.location_id JOIN zones d ON d.location_id = k % 25 + 1 GROUP BY ALL)"""
LONG_FLOWS = f"""WITH {ZONES}, {LONG_TRIPS.replace("SELECT CAST(pickup", "SELECT l_partkey % 25 + 1 AS destination, CAST(pickup", 1)},
flows AS (
  SELECT pickup_date, pickup_hour, location_id AS origin_id, CAST(destination AS SMALLINT) AS destination_id,
         count(*) AS n, CAST(sum(seconds) AS BIGINT) AS seconds, CAST(sum(cents) AS BIGINT) AS cents
  FROM trips GROUP BY ALL)"""


def od_matrix(flows: str, where: str = "true") -> str:
    return f"""{flows}, pairs AS (
  SELECT origin_id, destination_id, CAST(sum(n) AS BIGINT) AS n, sum(seconds) AS seconds, sum(cents) AS cents
  FROM flows WHERE {where} GROUP BY 1, 2), shares AS (
  SELECT *, sum(n) OVER (PARTITION BY origin_id) AS out_n, sum(n) OVER (PARTITION BY destination_id) AS in_n FROM pairs)
SELECT origin_id, destination_id, n AS trip_count,
       {scaled(half_up('1000000 * n', 'out_n'), 1000000)} AS origin_share,
       {scaled(half_up('1000000 * n', 'in_n'), 1000000)} AS destination_share,
       {scaled(half_up('100 * seconds', 'n'), 100)} AS avg_duration_seconds,
       {scaled(half_up('cents', 'n'), 100)} AS avg_total_amount FROM shares"""


def flow_balance(zones: str = "true") -> str:
    def total(condition: str) -> str:
        return f"CAST(coalesce(sum(n) FILTER (WHERE {condition}), 0) AS BIGINT)"

    out, into = "origin_id = z AND destination_id <> z", "destination_id = z AND origin_id <> z"
    return f"""{FLOWS}, pairs AS (
  SELECT origin_id, destination_id, sum(n) AS n FROM flows GROUP BY 1, 2), touched AS (
  SELECT z.location_id AS z, zone_name, z.borough, p.* FROM (SELECT * FROM zones WHERE {zones}) z
  LEFT JOIN pairs p ON p.origin_id = z.location_id OR p.destination_id = z.location_id)
SELECT z AS location_id, zone_name, borough, {total(out)} AS outflow, {total(into)} AS inflow,
       {total("origin_id = z AND destination_id = z")} AS internal, {total(into)} - {total(out)} AS net_inflow,
       CAST(count(*) FILTER (WHERE {out}) AS INTEGER) AS destinations,
       CAST(count(*) FILTER (WHERE {into}) AS INTEGER) AS origins
FROM touched GROUP BY 1, 2, 3"""


# Rows and columns are scaled in turn, 400 times over.
BALANCED = f"""{FLOWS}, seed AS (
  SELECT origin_id AS i, destination_id AS j, CAST(sum(n) AS BIGINT) AS n FROM flows GROUP BY 1, 2), late AS (
  SELECT * FROM flows WHERE pickup_date >= DATE '2024-01-16'), row_totals AS (
  SELECT origin_id AS i, CAST(sum(n) AS DOUBLE) AS total FROM late GROUP BY 1), column_totals AS (
  SELECT destination_id AS j, CAST(sum(n) AS DOUBLE) AS total FROM late GROUP BY 1), fit AS (
  SELECT 0 AS step, j, 1.0::DOUBLE AS factor FROM (SELECT DISTINCT j FROM seed)
  UNION ALL
  SELECT step + 1, s.j, coalesce(max(c.total) / sum(s.n * r.factor), 0) AS factor
  FROM (SELECT step, s.i, coalesce(max(t.total) / sum(s.n * f.factor), 0) AS factor
        FROM fit f JOIN seed s ON s.j = f.j LEFT JOIN row_totals t ON t.i = s.i WHERE step < 400 GROUP BY 1, 2) r
  JOIN seed s ON s.i = r.i LEFT JOIN column_totals c ON c.j = s.j GROUP BY 1, 2), last AS (
  SELECT * FROM fit WHERE step = 400), rows_ AS (
  SELECT s.i, coalesce(max(t.total) / sum(s.n * f.factor), 0) AS factor
  FROM last f JOIN seed s ON s.j = f.j LEFT JOIN row_totals t ON t.i = s.i GROUP BY 1)
SELECT s.i AS origin_id, s.j AS destination_id, s.n AS trip_count, round(s.n * r.factor * c.factor, 3) AS fitted
FROM seed s JOIN rows_ r ON r.i = s.i JOIN last c ON c.j = s.j"""


def accessibility(links: str, values: str, minutes: tuple[int, ...], rounds: int) -> str:
    """Relaxed over all links in every round, links of a zone to itself among them."""
    return f"""{links}, stays AS (
  SELECT * FROM links WHERE c <= {60 * max(minutes)}
  UNION ALL SELECT location_id, location_id, 0 FROM ({values})), times AS (
  SELECT 0 AS step, location_id AS i, location_id AS j, CAST(0 AS BIGINT) AS s FROM ({values})
  UNION ALL
  SELECT step + 1, t.i, l.b AS j, min(s + c) AS s FROM times t JOIN stays l ON l.a = t.j
  WHERE step < {rounds} AND s + c <= {60 * max(minutes)} GROUP BY 1, 2, 3), reached AS (
  SELECT i, minutes, count(*) AS zones, CAST(sum(x) AS BIGINT) AS x, sum(s * x) AS weighted
  FROM times t JOIN ({values}) v ON v.location_id = t.j CROSS JOIN (SELECT unnest({list(minutes)}) AS minutes)
  WHERE step = {rounds} AND s <= 60 * minutes GROUP BY 1, 2)
SELECT i AS location_id, CAST(minutes AS INTEGER) AS minutes, CAST(zones AS INTEGER) AS reachable_zones,
       x AS reachable_trips, {scaled(half_up(f'1000000 * x', f'(SELECT CAST(sum(x) AS BIGINT) FROM ({values}))'), 1000000)}
         AS trip_share, {scaled(half_up('100 * weighted', '60 * x'), 100)} AS mean_minutes
FROM reached"""


ZONE_LINKS = f"""{FLOWS}, links AS (
  SELECT a.location_id AS a, b.location_id AS b, greatest(coalesce(m.mean, 900), 1) AS c
  FROM zones a JOIN zones b ON a.location_id <> b.location_id AND greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) = 1
  LEFT JOIN (SELECT origin_id, destination_id, {half_up('sum(seconds)', 'sum(n)')} AS mean FROM flows GROUP BY 1, 2) m
    ON m.origin_id = a.location_id AND m.destination_id = b.location_id)"""
ZONE_TRIPS = """SELECT z.location_id, CAST(coalesce(t.x, 0) AS BIGINT) AS x FROM zones z
  LEFT JOIN (SELECT location_id, count(*) AS x FROM trips GROUP BY 1) t ON t.location_id = z.location_id"""
PARCEL_LINKS = f"""{PARCEL_VALUES.replace("WITH", "WITH RECURSIVE", 1)}, {STEPS}, links AS (
  SELECT location_id AS a, other AS b, 240 + (location_id * 7 + other * 3) % 5 * 60 AS c FROM pairs)"""


# An edge belongs to the tree if its ends aren't joined by lighter ones.
TREE = f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)}, counted AS (
  SELECT location_id, pickup_hour AS h, sum(n) AS n FROM demand GROUP BY 1, 2), profile AS (
  SELECT z.location_id, h, coalesce({half_up('1000 * n', 'sum(n) OVER (PARTITION BY z.location_id)')}, 0) AS p
  FROM zones z CROSS JOIN range(0, 24) hours(h) LEFT JOIN counted USING (location_id, h)), edges AS (
  SELECT a.location_id AS a, b.location_id AS b, CAST(sum((p.p - q.p) * (p.p - q.p)) AS BIGINT) AS weight
  FROM zones a JOIN zones b ON a.location_id < b.location_id AND greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) = 1
  JOIN profile p ON p.location_id = a.location_id JOIN profile q ON q.location_id = b.location_id AND q.h = p.h
  GROUP BY 1, 2), lighter AS (
  SELECT e.a AS ea, e.b AS eb, l.a, l.b FROM edges e JOIN edges l ON (l.weight, l.a, l.b) < (e.weight, e.a, e.b)),
joined AS (
  SELECT a AS ea, b AS eb, a AS node FROM edges
  UNION SELECT j.ea, j.eb, CASE WHEN l.a = j.node THEN l.b ELSE l.a END
  FROM joined j JOIN lighter l ON l.ea = j.ea AND l.eb = j.eb AND j.node IN (l.a, l.b)), tree AS (
  SELECT * FROM edges e WHERE NOT EXISTS (
    SELECT 1 FROM joined j WHERE j.ea = e.a AND j.eb = e.b AND j.node = e.b))"""


def segments(cuts: int) -> str:
    """All edges of the forest are tried in each step: what lies on their far side, and what lies in their whole part."""
    steps, forest = [], "tree"
    for i in range(cuts):
        steps.append(f"""side{i} AS (
  SELECT a, b, b AS node FROM {forest}
  UNION SELECT s.a, s.b, CASE WHEN f.a = s.node THEN f.b ELSE f.a END
  FROM side{i} s JOIN {forest} f ON s.node IN (f.a, f.b) AND NOT (f.a = s.a AND f.b = s.b)), whole{i} AS (
  SELECT a, b, a AS node FROM {forest}
  UNION SELECT w.a, w.b, CASE WHEN f.a = w.node THEN f.b ELSE f.a END
  FROM whole{i} w JOIN {forest} f ON w.node IN (f.a, f.b)), hours{i} AS (
  SELECT w.a, w.b, h, count(s.node) AS n, count(*) AS all_n, coalesce(sum(p) FILTER (s.node IS NOT NULL), 0) AS p,
         sum(p) AS all_p, coalesce(sum(p * p) FILTER (s.node IS NOT NULL), 0) AS q, sum(p * p) AS all_q
  FROM whole{i} w JOIN profile r ON r.location_id = w.node
  LEFT JOIN side{i} s ON s.a = w.a AND s.b = w.b AND s.node = w.node GROUP BY 1, 2, 3), gains{i} AS (
  SELECT a, b, (CAST(sum(all_q) AS DOUBLE) - CAST(sum(all_p * all_p) AS DOUBLE) / max(all_n))
       - (CAST(sum(q) AS DOUBLE) - CAST(sum(p * p) AS DOUBLE) / max(n))
       - (CAST(sum(all_q - q) AS DOUBLE) - CAST(sum((all_p - p) * (all_p - p)) AS DOUBLE) / (max(all_n) - max(n))) AS gain
  FROM hours{i} GROUP BY 1, 2), forest{i} AS (
  SELECT f.* FROM {forest} f JOIN gains{i} g USING (a, b)
  QUALIFY row_number() OVER (ORDER BY gain DESC, a, b) > 1)""")
        forest = f"forest{i}"
    return f"""{TREE}, {', '.join(steps)}, reach AS (
  SELECT location_id, location_id AS node FROM zones
  UNION SELECT r.location_id, CASE WHEN f.a = r.node THEN f.b ELSE f.a END
  FROM reach r JOIN {forest} f ON r.node IN (f.a, f.b)), named AS (
  SELECT location_id, min(node) AS segment FROM reach GROUP BY 1), totals AS (
  SELECT location_id, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY 1)
SELECT location_id, coalesce(n, 0) AS trip_count, segment FROM named LEFT JOIN totals USING (location_id)"""


ZONE_NAMES = ", zone_name, borough"
MORNING = "pickup_hour = 8 AND pickup_date <= DATE '2024-01-25'"
ASIA = ("borough = 'ASIA'", "borough = 'ASIA'")


def oracle_sql() -> dict[str, str]:
    return {
        "zone_gi_star": gi_star(zone_values(), ZONE_NAMES),
        "zone_gi_star_filtered": gi_star(zone_values(MORNING), ZONE_NAMES, 0.2),
        "zone_gi_star_borough": gi_star(zone_values(*ASIA), ZONE_NAMES),
        "parcel_gi_star": gi_star(PARCEL_VALUES, ""),
        "zone_morans_i": morans_i(zone_values()),
        "zone_morans_i_borough": morans_i(zone_values(*ASIA)),
        "parcel_morans_i": morans_i(PARCEL_VALUES),
        "zone_lisa": lisa(zone_values(), ZONE_NAMES, RANKED_OTHERS, 999, 0.05),
        "zone_lisa_filtered": lisa(zone_values(MORNING), ZONE_NAMES, RANKED_OTHERS, 199, 0.1),
        "parcel_lisa": lisa(PARCEL_VALUES, "", NEAR_OTHERS, 99, 0.05),
        "od_rollup": f"""{FLOWS}
SELECT pickup_date, pickup_hour, origin_id, destination_id, borough, n AS trip_count, seconds AS duration_sum,
       {scaled('cents', 100)} AS amount_sum FROM flows""",
        "od_matrix": od_matrix(FLOWS),
        "od_matrix_filtered": od_matrix(FLOWS, MORNING),
        "od_matrix_long": od_matrix(LONG_FLOWS),
        "flow_balance": flow_balance(),
        "flow_balance_borough": flow_balance("borough = 'ASIA'"),
        "od_balanced": BALANCED,
        "zone_accessibility": accessibility(ZONE_LINKS, ZONE_TRIPS, (15, 30, 60), 25),
        "parcel_accessibility": accessibility(PARCEL_LINKS, "SELECT location_id, x FROM vals", (5, 15), 4),
        "stream_load": f"""{DIRTY}
SELECT CAST(pickup AS DATE) AS pickup_date, CAST(pickup_zone AS SMALLINT) AS location_id,
       count(*) AS trips, CAST(sum(cents) / 100.0 AS DOUBLE) AS total_amount
FROM reasons WHERE reason = '' GROUP BY 1, 2""",
        "zone_spanning_tree": TREE + " SELECT a, b, weight FROM tree",
        "zone_segments": segments(3),
        "zones_from_geojson": ZONES_FROM_GEOJSON,
        "reproject_utm": utm(),
        "reproject_web_mercator": WEB_MERCATOR,
        "simplify_map": SIMPLIFIED_MAP,
        "simplified_common_borders": COMMON_BORDERS,
        "forecast_backtest": backtest(BASE, "borough", "same_weekday"),
        "forecast_backtest_long": backtest(LONG_BASE, "borough", "same_weekday", 30, 26, 7),
        "forecast_backtest_zones": backtest(BASE, "location_id", "same_weekday", 14, 4, 3),
        "holt_winters_backtest": backtest(BASE, "borough", "holt_winters"),
        "sarima_backtest": backtest(BASE, "borough", "sarima"),
        "holt_winters_forecast": holt_winters_forecast(BASE, "borough", 14),
        "holt_winters_zones": holt_winters_forecast(BASE, "location_id"),
        "holt_winters_forecast_long": holt_winters_forecast(LONG_BASE, "borough", 30),
        "sarima_forecast": sarima_forecast(BASE, "borough", 14),
        "sarima_forecast_long": sarima_forecast(LONG_BASE, "borough", 30),
        "forecast_comparison": comparison(BASE, "borough"),
        "forecast_comparison_zones": comparison(BASE, "location_id", 7, 7, 1),
    }
