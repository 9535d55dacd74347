"""DuckDB SQL giving the expected result of each query in the catalog.

Averages are rounded with integer arithmetic on scaled values: round half up of a / b is
(2a + b) // (2b). The fixtures are described in FIXTURES.md.
"""

from __future__ import annotations

ZONES = """
zones AS (
  SELECT CAST(n_nationkey + 1 AS SMALLINT) AS location_id, n_name AS zone_name,
         r_name AS borough, n_nationkey % 5 AS gx, n_nationkey // 5 AS gy
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

TRIPS = """
trips AS (
  SELECT event_id + 1 AS row_number, ts, CAST(ts AS DATE) AS pickup_date,
         CAST(extract(hour FROM ts) AS SMALLINT) AS pickup_hour,
         CAST(user_id % 25 + 1 AS SMALLINT) AS location_id, k,
         k * 100 AS metres, 60 + 30 * k AS seconds,
         CAST(CAST(CAST(value AS VARCHAR) AS DECIMAL(10,2)) * 100 AS BIGINT) AS cents
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"""

LONG_TRIPS = """
trips AS (
  SELECT CAST(pickup AS DATE) AS pickup_date,
         CAST(extract(hour FROM pickup) AS SMALLINT) AS pickup_hour,
         CAST(s_nationkey + 1 AS SMALLINT) AS location_id,
         CAST(CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(10,3)) * 1000 AS BIGINT) AS metres,
         l_linenumber * 60 AS seconds,
         CAST(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(10,2)) * 100 AS BIGINT) AS cents
  FROM (SELECT *, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS pickup
        FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey)"""


def half_up(a: str, b: str) -> str:
    """Rounded a / b for a >= 0; null when b is 0."""
    return f"((2 * ({a}) + ({b})) // nullif(2 * ({b}), 0))"


def half_away(a: str, b: str) -> str:
    """Rounded a / b of any sign."""
    return f"(sign({a}) * {half_up(f'abs({a})', b)})"


def scaled(a: str, by: int) -> str:
    return f"CAST({a} AS DOUBLE) / {by}::DOUBLE"


DEMAND = f"""
demand AS (
  SELECT pickup_date, pickup_hour, z.location_id, zone_name, borough, count(*) AS n,
         {half_up('sum(metres)', 'count(*)')} AS mean_metres,
         {half_up('100 * sum(seconds)', 'count(*)')} AS mean_centiseconds,
         {half_up('sum(cents)', 'count(*)')} AS mean_cents, sum(cents) AS cents
  FROM trips t JOIN zones z ON t.location_id = z.location_id
  GROUP BY ALL)"""

BASE = f"WITH {ZONES}, {TRIPS}, {DEMAND}"
LONG_BASE = f"WITH {ZONES}, {LONG_TRIPS}, {DEMAND}"

TRIP_SUM = "CAST(coalesce(sum(n), 0) AS BIGINT)"
MEAN_AMOUNT = f"{scaled(half_up('sum(cents)', 'sum(n)'), 100)} AS avg_total_amount"
# mean_metres carries 3 decimals, the result 2
MEAN_DISTANCE = (f"{scaled(half_up('sum(mean_metres * n)', '10 * sum(n)'), 100)}"
                 " AS avg_trip_distance")

DATES = "pickup_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
FRIDAY = ("borough = 'AMERICA' AND pickup_hour = 18 AND isodow(pickup_date) = 5 "
          "AND pickup_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'")
EUROPE = "borough = 'EUROPE' AND isodow(pickup_date) = 3"
MORNING = "pickup_hour = 8 AND pickup_date <= DATE '2024-01-25'"

ROLLUP = f"""
SELECT pickup_date, pickup_hour, location_id, zone_name, borough, n AS trip_count,
       CAST({scaled('mean_metres', 1000)} AS DECIMAL(10,3)) AS avg_trip_distance,
       CAST({scaled('mean_centiseconds', 100)} AS DECIMAL(12,2)) AS avg_duration_seconds,
       CAST({scaled('mean_cents', 100)} AS DECIMAL(10,2)) AS avg_total_amount,
       CAST(CAST(cents AS DECIMAL(18,0)) / 100 AS DECIMAL(20,2)) AS total_amount
FROM demand"""


def summary(base: str, where: str = "true") -> str:
    return f"""{base}
SELECT {TRIP_SUM} AS total_trips, CAST(count(DISTINCT location_id) AS INTEGER) AS active_zones,
       {MEAN_AMOUNT}, {MEAN_DISTANCE}
FROM demand WHERE {where}"""


def daily(where: str = "true") -> str:
    return f"""{BASE}
SELECT pickup_date, {TRIP_SUM} AS trip_count, {MEAN_AMOUNT}
FROM demand WHERE {where} GROUP BY pickup_date"""


def heatmap(where: str = "true") -> str:
    return f"""{BASE}
SELECT CAST(isodow(pickup_date) AS SMALLINT) AS weekday, pickup_hour, {TRIP_SUM} AS trip_count
FROM demand WHERE {where} GROUP BY 1, 2"""


def dense(where: str = "true") -> str:
    return f"""{BASE}, cells AS (
  SELECT CAST(w AS SMALLINT) AS weekday, CAST(h AS SMALLINT) AS pickup_hour,
         CAST(coalesce(sum(n), 0) AS BIGINT) AS trip_count
  FROM range(1, 8) a(w) CROSS JOIN range(0, 24) b(h)
  LEFT JOIN (SELECT * FROM demand WHERE {where}) d
    ON isodow(pickup_date) = w AND pickup_hour = h
  GROUP BY 1, 2)"""


def ranking(where: str = "true", limit: int = 10) -> str:
    return f"""{BASE}, ranked AS (
  SELECT location_id, zone_name, borough, {TRIP_SUM} AS trip_count, {MEAN_AMOUNT}, {MEAN_DISTANCE}
  FROM demand WHERE {where} GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (ORDER BY trip_count DESC, location_id) AS INTEGER) AS position
FROM ranked ORDER BY trip_count DESC, location_id LIMIT {limit}"""


def hourly(where: str = "true") -> str:
    return f"""{BASE}
SELECT location_id, pickup_hour, {TRIP_SUM} AS trip_count, {MEAN_AMOUNT}
FROM demand WHERE {where} GROUP BY 1, 2"""


def classes(where: str = "true", zones: str = "true", labels: tuple[str, ...] = (
        "No Data", "Very Low", "Low", "Medium", "High", "Very High")) -> str:
    cases = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
    return f"""{BASE}, counted AS (
  SELECT location_id, {TRIP_SUM} AS trip_count, {MEAN_AMOUNT}, {MEAN_DISTANCE}
  FROM demand WHERE {where} GROUP BY 1), shares AS (
  SELECT *, cume_dist() OVER (ORDER BY trip_count) AS share FROM counted), classed AS (
  SELECT z.location_id, zone_name, borough, coalesce(trip_count, 0) AS trip_count,
         avg_total_amount, avg_trip_distance,
         CAST(CASE WHEN share IS NULL THEN 0 WHEN share <= 0.2::DOUBLE THEN 1
                   WHEN share <= 0.4::DOUBLE THEN 2 WHEN share <= 0.6::DOUBLE THEN 3
                   WHEN share <= 0.8::DOUBLE THEN 4 ELSE 5 END AS SMALLINT) AS demand_class_id
  FROM zones z LEFT JOIN shares s ON z.location_id = s.location_id WHERE {zones})
SELECT *, CASE demand_class_id {cases} END AS demand_class FROM classed"""


def around(where: str, zones: str) -> str:
    """Selected zones with activity and neighbourhood."""
    return f"""{BASE}, scoped AS (SELECT * FROM demand WHERE {where}),
selected AS (
  SELECT z.location_id, z.zone_name, z.borough, z.gx, z.gy, coalesce(sum(n), 0) AS trip_count,
         CAST(count(DISTINCT pickup_date) AS INTEGER) AS active,
         (SELECT CAST(count(DISTINCT pickup_date) AS INTEGER) FROM scoped) AS total,
         {scaled(half_up('sum(cents)', 'sum(n)'), 100)} AS avg_total_amount,
         {scaled(half_up('sum(mean_metres * n)', '10 * sum(n)'), 100)} AS avg_trip_distance
  FROM (SELECT * FROM zones WHERE {zones}) z LEFT JOIN scoped d ON d.location_id = z.location_id
  GROUP BY 1, 2, 3, 4, 5),
neighbours AS (
  SELECT a.location_id, CAST(count(b.location_id) AS INTEGER) AS neighbour_count,
         coalesce(sum(b.trip_count), 0) AS around_trips
  FROM selected a LEFT JOIN selected b
    ON a.location_id <> b.location_id AND greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) = 1
  GROUP BY 1),
measured AS (
  SELECT s.*, neighbour_count,
         coalesce({half_up('100 * around_trips', 'neighbour_count')}, 0) AS mean_cents,
         CASE WHEN neighbour_count = 0 THEN 0::DOUBLE
              ELSE CAST(around_trips AS DOUBLE) / neighbour_count END AS mean_exact
  FROM selected s JOIN neighbours USING (location_id))"""


def score(zone: str, around_: str) -> str:
    return f"""CAST(CASE WHEN neighbour_count = 0 THEN 0
      WHEN {zone} >= 0.8::DOUBLE AND {around_} >= 0.8::DOUBLE THEN 2
      WHEN {zone} >= 0.6::DOUBLE AND {around_} >= 0.6::DOUBLE THEN 1
      WHEN {zone} <= 0.2::DOUBLE AND {around_} <= 0.2::DOUBLE THEN -2
      WHEN {zone} <= 0.4::DOUBLE AND {around_} <= 0.4::DOUBLE THEN -1
      ELSE 0 END AS SMALLINT)"""


HOTSPOT_LABEL = """CASE hotspot_score WHEN -2 THEN 'Coldspot' WHEN -1 THEN 'Potential Coldspot'
      WHEN 0 THEN 'Neutral' WHEN 1 THEN 'Potential Hotspot' WHEN 2 THEN 'Hotspot' END"""


def hotspots(where: str = "true", zones: str = "true") -> str:
    return f"""{around(where, zones)}, shares AS (
  SELECT *, cume_dist() OVER (ORDER BY trip_count) AS zone_share,
         cume_dist() OVER (ORDER BY mean_cents) AS around_share FROM measured), scored AS (
  SELECT *, {score('zone_share', 'around_share')} AS hotspot_score FROM shares)
SELECT location_id, zone_name, borough, CAST(trip_count AS BIGINT) AS trip_count,
       neighbour_count, {scaled('mean_cents', 100)} AS neighbour_avg_trip_count, hotspot_score,
       {HOTSPOT_LABEL} AS hotspot_class FROM scored"""


def scored(where: str, zones: str) -> str:
    """Score parts in hundredths."""
    return f"""{around(where, zones)}, positive AS (
  SELECT location_id, cume_dist() OVER (ORDER BY trip_count) AS zone_share,
         count(*) OVER (ORDER BY trip_count RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k,
         count(*) OVER () AS n
  FROM measured WHERE trip_count > 0), shares AS (
  SELECT m.*, zone_share, cume_dist() OVER (ORDER BY mean_exact) AS around_share,
         coalesce({half_up('10000 * k', 'n')}, 0) AS demand_part,
         coalesce({half_up('10000 * active', 'total')}, 0) AS consistency_part
  FROM measured m LEFT JOIN positive USING (location_id)), rated AS (
  SELECT *, {score('zone_share', 'around_share')} AS hotspot_score FROM shares), parts AS (
  SELECT *, 5000 + 2500 * CAST(hotspot_score AS BIGINT) AS hotspot_part,
         {half_up('50 * demand_part + 30 * (5000 + 2500 * CAST(hotspot_score AS BIGINT)) + 20 * consistency_part',
                  '100')} AS score_part
  FROM rated)"""


SCORE_COLUMNS = f"""{scaled('demand_part', 100)} AS demand_score,
       {scaled('hotspot_part', 100)} AS hotspot_component_score,
       {scaled('consistency_part', 100)} AS consistency_score,
       {scaled('score_part', 100)} AS zone_score"""
PRIORITY = """CASE WHEN score_part >= 8000 THEN 'Very High' WHEN score_part >= 6000 THEN 'High'
       WHEN score_part >= 4000 THEN 'Medium' WHEN score_part >= 2000 THEN 'Low'
       ELSE 'Very Low' END AS priority_class"""


def scores(where: str = "true", zones: str = "true") -> str:
    return f"""{scored(where, zones)}
SELECT location_id, zone_name, borough, CAST(trip_count AS BIGINT) AS trip_count,
       active AS active_day_count, total AS total_day_count, {SCORE_COLUMNS}, {PRIORITY}
FROM parts"""


PEAKS = """hours AS (
  SELECT location_id, pickup_hour AS peak_hour FROM (
    SELECT location_id, pickup_hour, row_number() OVER (
      PARTITION BY location_id ORDER BY sum(n) DESC, pickup_hour) AS r
    FROM scoped GROUP BY 1, 2) WHERE r = 1),
weekdays AS (
  SELECT location_id, peak_weekday FROM (
    SELECT location_id, CAST(isodow(pickup_date) AS INTEGER) AS peak_weekday,
      row_number() OVER (PARTITION BY location_id ORDER BY sum(n) DESC, isodow(pickup_date)) AS r
    FROM scoped GROUP BY location_id, isodow(pickup_date)) WHERE r = 1)"""


def details_cte(where: str = "true", zones: str = "true") -> str:
    return f"""{scored(where, zones)}, {PEAKS}, details AS (
SELECT location_id, zone_name, borough, CAST(trip_count AS BIGINT) AS trip_count,
       avg_total_amount, avg_trip_distance, active AS active_day_count,
       total AS total_day_count, peak_weekday,
       CASE peak_weekday WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday'
         WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday'
         WHEN 7 THEN 'Sunday' END AS peak_weekday_name,
       peak_hour, {SCORE_COLUMNS}, {HOTSPOT_LABEL} AS hotspot_class, {PRIORITY}
FROM parts LEFT JOIN hours USING (location_id) LEFT JOIN weekdays USING (location_id))"""


def compare(ids: tuple[int, ...]) -> str:
    texts = {
        "trip_count": "CAST(trip_count AS VARCHAR)",
        "zone_score": "", "demand_score": "", "hotspot_component_score": "",
        "consistency_score": "", "avg_total_amount": "", "avg_trip_distance": "",
        "peak_weekday_name": "peak_weekday_name",
        "peak_hour": "lpad(CAST(peak_hour AS VARCHAR), 2, '0') || ':00'",
        "priority_class": "priority_class",
    }
    rows = []
    for i, (metric, text) in enumerate(texts.items(), start=1):
        text = text or f"CAST(CAST({metric} AS DECIMAL(18,2)) AS VARCHAR)"
        columns = ", ".join(
            f"coalesce(max(CASE WHEN location_id = {z} THEN {text} END), '-') AS zone_{z}"
            for z in ids)
        rows.append(f"SELECT CAST({i} AS INTEGER) AS position, '{metric}' AS metric, {columns} "
                    "FROM details")
    return details_cte() + " " + " UNION ALL ".join(rows)


def series(ids: tuple[int, ...]) -> str:
    names = ("zone_score", "demand_score", "hotspot_component_score", "consistency_score")
    rows = [f"SELECT location_id, zone_name, CAST({i} AS INTEGER) AS position, "
            f"'{s}' AS series, coalesce({s}, 0) AS value FROM details "
            f"WHERE location_id IN {ids}" for i, s in enumerate(names, start=1)]
    return details_cte() + " " + " UNION ALL ".join(rows)


def trend(where: str = "true", date_to: str = "DATE '9999-01-01'", days: int = 7) -> str:
    return f"""{BASE}, scoped AS (SELECT * FROM demand WHERE {where}), last AS (
  SELECT least({date_to}, max(pickup_date)) AS e FROM scoped), totals AS (
  SELECT z.location_id, z.zone_name, z.borough, e,
    CAST(coalesce(sum(CASE WHEN pickup_date BETWEEN e - {days - 1} AND e THEN n END), 0)
      AS BIGINT) AS cur,
    CAST(coalesce(sum(CASE WHEN pickup_date BETWEEN e - {2 * days - 1} AND e - {days}
      THEN n END), 0) AS BIGINT) AS prev
  FROM zones z CROSS JOIN last LEFT JOIN scoped d ON d.location_id = z.location_id
  GROUP BY 1, 2, 3, 4), changes AS (
  SELECT *, CASE WHEN prev <> 0 THEN {half_away('10000 * (cur - prev)', 'prev')} END AS pct
  FROM totals)
SELECT location_id, zone_name, borough, CAST({days} AS INTEGER) AS period_days,
  e - {days - 1} AS current_period_start, e AS current_period_end,
  e - {2 * days - 1} AS previous_period_start, e - {days} AS previous_period_end,
  cur AS current_period_trip_count, prev AS previous_period_trip_count,
  cur - prev AS change_amount, {scaled('pct', 100)} AS change_percentage,
  CASE WHEN cur = 0 AND prev = 0 THEN 'No Data' WHEN prev = 0 THEN 'Rising'
       WHEN pct > 500 THEN 'Rising' WHEN pct < -500 THEN 'Falling' ELSE 'Stable'
  END AS trend_direction
FROM changes"""


def anomaly_cte(where: str, weekday: str, date_to: str, days: int, threshold: float) -> str:
    return f"""{BASE}, scoped AS (SELECT * FROM demand WHERE {where}), daily AS (
  SELECT location_id, pickup_date, sum(n) AS x FROM scoped GROUP BY 1, 2), bounds AS (
  SELECT location_id, least({date_to}, max(pickup_date)) AS e FROM daily GROUP BY 1), calendar AS (
  SELECT location_id, e, CAST(unnest(generate_series(e - {days - 1}, e, INTERVAL 1 DAY)) AS DATE)
         AS pickup_date FROM bounds), filled AS (
  SELECT c.location_id, e, c.pickup_date, coalesce(x, 0) AS x
  FROM calendar c LEFT JOIN daily d
    ON c.location_id = d.location_id AND c.pickup_date = d.pickup_date
  WHERE {weekday}), stats AS (
  SELECT location_id, e, count(*) AS n, sum(x) AS s, sum(x * x) AS q
  FROM filled GROUP BY 1, 2), widths AS (
  SELECT *, CASE WHEN n > 1 THEN sqrt(CAST(n * q - s * s AS DOUBLE)
                                      / CAST(n * (n - 1) AS DOUBLE)) ELSE 0 END AS deviation,
         CASE WHEN n > 1 THEN sqrt(CAST(n AS DOUBLE) * CAST(n * q - s * s AS DOUBLE)
                                   / CAST(n - 1 AS DOUBLE)) ELSE 0 END AS unit
  FROM stats), items AS (
  SELECT location_id, pickup_date, CAST(x AS BIGINT) AS trip_count,
         {scaled(half_up('100 * s', 'n'), 100)} AS expected_trip_count,
         {scaled(half_away('100 * (n * x - s)', 'n'), 100)} AS deviation_amount,
         {scaled(half_away('10000 * (n * x - s)', 's'), 100)} AS deviation_percentage,
         CASE WHEN unit = 0 THEN 0::DOUBLE ELSE CAST(n * x - s AS DOUBLE) / unit END AS z
  FROM filled JOIN widths USING (location_id, e)), flagged AS (
  SELECT * FROM items WHERE abs(z) >= {threshold}::DOUBLE)"""


def anomalies(where: str = "true", weekday: str = "true", date_to: str = "DATE '9999-01-01'",
              days: int = 28, threshold: float = 2.0) -> str:
    return f"""{anomaly_cte(where, weekday, date_to, days, threshold)}
SELECT z.location_id, z.zone_name, z.borough, CAST({days} AS INTEGER) AS analysis_days,
       e - {days - 1} AS analysis_start, e AS analysis_end,
       CAST(coalesce(n, 0) AS INTEGER) AS observation_count,
       coalesce({scaled(half_up('100 * s', 'n'), 100)}, 0) AS mean_daily_trips,
       coalesce(round(deviation, 2), 0) AS standard_deviation,
       {threshold}::DOUBLE AS z_threshold,
       CAST((SELECT count(*) FROM flagged f WHERE f.location_id = z.location_id) AS INTEGER)
         AS anomaly_count
FROM zones z LEFT JOIN widths USING (location_id)"""


def anomaly_items(where: str = "true", weekday: str = "true", date_to: str = "DATE '9999-01-01'",
                  days: int = 28, threshold: float = 2.0) -> str:
    return f"""{anomaly_cte(where, weekday, date_to, days, threshold)}
SELECT location_id, pickup_date, trip_count, expected_trip_count, deviation_amount,
       deviation_percentage, round(z, 2) AS z_score,
       CASE WHEN z > 0 THEN 'High Demand' ELSE 'Low Demand' END AS anomaly_type
FROM flagged"""


def forecast(where: str = "true", days: int = 7, weeks: int = 4) -> str:
    return f"""{BASE}, daily AS (
  SELECT pickup_date, sum(n) AS x FROM demand WHERE {where} GROUP BY 1), dates AS (
  SELECT (SELECT max(pickup_date) FROM daily) + CAST(i AS INTEGER) AS forecast_date
  FROM range(1, {days + 1}) r(i)), candidates AS (
  SELECT forecast_date, x, row_number() OVER (
    PARTITION BY forecast_date ORDER BY pickup_date DESC) AS r
  FROM dates JOIN daily
    ON isodow(pickup_date) = isodow(forecast_date) AND pickup_date < forecast_date), stats AS (
  SELECT forecast_date, count(*) AS n, sum(x) AS s,
         sqrt(CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE)) AS width
  FROM candidates WHERE r <= {weeks} GROUP BY 1)
SELECT forecast_date, CAST(isodow(forecast_date) AS SMALLINT) AS weekday,
       CAST({half_up('s', 'n')} AS BIGINT) AS predicted_trip_count,
       CAST(greatest(round((CAST(s AS DOUBLE) - width) / n), 0) AS BIGINT) AS lower_bound,
       CAST(round((CAST(s AS DOUBLE) + width) / n) AS BIGINT) AS upper_bound,
       CAST(n AS INTEGER) AS sample_count
FROM stats"""


# The trips with planted faults: kind = event_id % 20.
DIRTY = f"""WITH {ZONES}, {TRIPS}, dirty AS (
  SELECT row_number, (row_number - 1) % 20 AS kind, k,
         CASE WHEN (row_number - 1) % 20 <> 0 THEN ts END AS pickup,
         CASE WHEN (row_number - 1) % 20 = 1 THEN ts - INTERVAL 1 HOUR
              ELSE ts + to_seconds(seconds) END AS dropoff,
         CASE WHEN (row_number - 1) % 20 IN (2, 8) THEN -1 - k / 10.0::DOUBLE
              ELSE k / 10.0::DOUBLE END AS distance,
         CASE WHEN (row_number - 1) % 20 = 3 THEN -1 ELSE k % 5 END AS passengers,
         CASE WHEN (row_number - 1) % 20 IN (4, 8) THEN 99 ELSE location_id END AS pickup_zone,
         CASE WHEN (row_number - 1) % 20 <> 5 THEN k % 25 + 1 END AS dropoff_zone,
         CASE WHEN (row_number - 1) % 20 = 6 THEN 'X' WHEN (row_number - 1) % 20 = 7 THEN 'Y'
              WHEN k % 2 = 0 THEN 'Y' ELSE 'N' END AS flag, cents, seconds
  FROM trips), reasons AS (
  SELECT *, concat_ws('; ',
    CASE WHEN pickup IS NULL THEN 'pickup_datetime_missing_or_invalid' END,
    CASE WHEN dropoff < pickup THEN 'dropoff_before_pickup' END,
    CASE WHEN distance < 0 THEN 'negative_trip_distance' END,
    CASE WHEN passengers < 0 THEN 'negative_passenger_count' END,
    CASE WHEN pickup_zone NOT IN (SELECT location_id FROM zones)
      THEN 'invalid_pickup_location_id' END,
    CASE WHEN dropoff_zone IS NULL THEN 'invalid_dropoff_location_id' END,
    CASE WHEN flag NOT IN ('Y', 'N') THEN 'invalid_store_and_fwd_flag' END) AS reason
  FROM dirty)"""

DATASET_SUMMARY = f"""{DIRTY}
SELECT count(*) AS total_trips,
       (SELECT count(*) FROM reasons WHERE reason <> '') AS rejected_trips,
       (SELECT count(*) FROM zones) AS total_zones,
       min(pickup) + INTERVAL 5 HOUR AS earliest_pickup,
       max(pickup) + INTERVAL 5 HOUR AS latest_pickup,
       {scaled(half_up('sum(k * 10)', 'count(*)'), 100)} AS average_trip_distance,
       {scaled(half_up('sum(cents)', 'count(*)'), 100)} AS average_total_amount
FROM reasons WHERE reason = ''"""

TRIP_VALIDATION = f"""{DIRTY}
SELECT 'events' AS source_file, row_number AS source_row_number,
       pickup + INTERVAL 5 HOUR AS pickup_datetime, dropoff + INTERVAL 5 HOUR AS dropoff_datetime,
       CAST(passengers AS SMALLINT) AS passenger_count, distance AS trip_distance,
       {scaled('cents', 100)} AS total_amount, flag AS store_and_fwd_flag,
       CAST(pickup_zone AS SMALLINT) AS pickup_location_id,
       CAST(dropoff_zone AS SMALLINT) AS dropoff_location_id,
       CAST(seconds AS INTEGER) AS trip_duration_seconds, CAST(pickup AS DATE) AS pickup_date,
       CAST(extract(hour FROM pickup) AS SMALLINT) AS pickup_hour
FROM reasons WHERE reason = ''"""

REJECTED_RECORDS = f"""{DIRTY}
SELECT row_number AS source_row_number,
       replace(strftime(pickup + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '')
         || '+00:00' AS pickup,
       CAST(pickup_zone AS INTEGER) AS pickup_zone, flag, distance,
       CAST(dropoff_zone AS INTEGER) AS dropoff_zone, CAST(1 + k % 2 AS INTEGER) AS vendor_id,
       CAST(passengers AS INTEGER) AS passenger_count, CAST(1 AS INTEGER) AS rate_code_id,
       CAST(1 + k % 4 AS INTEGER) AS payment_type,
       cents / 100.0::DOUBLE AS fare_amount, 0::DOUBLE AS extra_amount, 0::DOUBLE AS mta_tax,
       0::DOUBLE AS tip_amount, 0::DOUBLE AS tolls_amount, 0::DOUBLE AS improvement_surcharge,
       cents / 100.0::DOUBLE AS total_amount, CAST(NULL AS DOUBLE) AS airport_fee,
       'events' AS source_file, reason,
       CAST(26 AS INTEGER) AS field_count
FROM reasons WHERE reason <> ''"""

TRIP_COERCION = f"""WITH {ZONES}, {TRIPS}, kinds AS (
  SELECT row_number, k, (row_number - 1) % 20 AS kind FROM trips)
SELECT row_number AS source_row_number,
       CASE kind WHEN 9 THEN 'non_integer_passenger_count' WHEN 10 THEN 'infinite_amount'
                 WHEN 12 THEN 'pickup_datetime_missing_or_invalid'
                 WHEN 13 THEN 'non_integer_pickup_location_id' END AS rejection_reason,
       CASE WHEN kind NOT BETWEEN 9 AND 13 THEN k / 10.0::DOUBLE END AS trip_distance,
       CASE WHEN kind NOT IN (9, 10, 12, 13) THEN 1.75::DOUBLE END AS airport_fee
FROM kinds"""

DST_GUARD = """WITH walls AS (
  SELECT l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) + INTERVAL 30 MINUTE AS wall
  FROM lineitem), counted AS (
  SELECT wall, count(*) AS row_count,
         make_date(extract(year FROM wall), 4, 1) AS april,
         make_date(extract(year FROM wall), 10, 31) AS october
  FROM walls GROUP BY wall), rules AS (
  SELECT wall, row_count,
         CAST(april + CAST((7 - isodow(april)) % 7 AS INTEGER) AS TIMESTAMP) AS starts,
         CAST(october - CAST(isodow(october) % 7 AS INTEGER) AS TIMESTAMP) AS ends
  FROM counted)
SELECT strftime(wall, '%Y-%m-%d %H:%M') AS wall, row_count,
  CASE WHEN wall >= starts + INTERVAL 2 HOUR AND wall < starts + INTERVAL 3 HOUR THEN NULL
       WHEN wall >= ends + INTERVAL 1 HOUR AND wall < ends + INTERVAL 2 HOUR THEN NULL
       WHEN wall >= starts AND wall < ends + INTERVAL 1 HOUR
            AND wall >= starts + INTERVAL 3 HOUR
         THEN strftime(wall + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M')
       ELSE strftime(wall + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') END AS utc
FROM rules"""

PARCELS = """
parcels AS (
  SELECT CAST(c_custkey AS INTEGER) AS location_id, 'PARCEL_' || c_custkey AS zone_name,
         'NATION_' || c_nationkey AS borough, c_custkey % 128 AS gx, c_custkey // 128 AS gy,
         c_acctbal
  FROM customer)"""

PARCEL_ADJACENCY = f"""WITH {PARCELS}, steps AS (
  SELECT CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy
  FROM range(-1, 2) a(dx) CROSS JOIN range(-1, 2) b(dy) WHERE dx <> 0 OR dy <> 0), wanted AS (
  SELECT location_id, gx + dx AS gx, gy + dy AS gy FROM parcels CROSS JOIN steps)
SELECT w.location_id, p.location_id AS neighbour_id
FROM wanted w JOIN parcels p ON w.gx = p.gx AND w.gy = p.gy"""

# Bar -1 lies below the lowest row; islands -id fill the holes of parcels with id % 4 = 2.
MIXED_ADJACENCY = PARCEL_ADJACENCY + """
UNION ALL SELECT -1, location_id FROM parcels WHERE gy = 0
UNION ALL SELECT location_id, -1 FROM parcels WHERE gy = 0
UNION ALL SELECT location_id, -location_id FROM parcels WHERE location_id % 4 = 2
UNION ALL SELECT -location_id, location_id FROM parcels WHERE location_id % 4 = 2"""

GEOJSON = f"""WITH {PARCELS}, boxes AS (
  SELECT *, gx * 0.25::DOUBLE AS x1, gy * 0.25::DOUBLE AS y1,
         gx * 0.25::DOUBLE + 0.25::DOUBLE AS x2, gy * 0.25::DOUBLE + 0.25::DOUBLE AS y2
  FROM parcels)
SELECT '{{"type":"Feature","geometry":{{"type":"MultiPolygon","coordinates":[[['
  || concat_ws(',', '[' || x1 || ',' || y1 || ']', '[' || x2 || ',' || y1 || ']',
               '[' || x2 || ',' || y2 || ']', '[' || x1 || ',' || y2 || ']',
               '[' || x1 || ',' || y1 || ']')
  || ']]]}},"properties":{{"location_id":' || location_id || ',"zone_name":"' || zone_name
  || '","borough":"' || borough || '"}}}}' AS feature
FROM boxes"""

# Corners stay; a bent middle stays when it lies more than 0.0001 off its side.
SIMPLIFIED = """WITH parcels AS (
  SELECT CAST(c_custkey AS INTEGER) AS location_id, c_custkey AS key,
         (c_custkey % 128) * 0.25::DOUBLE AS x, (c_custkey // 128) * 0.25::DOUBLE AS y
  FROM customer), bends AS (
  SELECT *, (key * 7) % 21 - 10 AS b0, (key * 7 + 13) % 21 - 10 AS b1,
         (key * 7 + 26) % 21 - 10 AS b2, (key * 7 + 39) % 21 - 10 AS b3 FROM parcels), points AS (
  SELECT location_id, x AS px, y AS py, true AS stays FROM bends
  UNION ALL SELECT location_id, x, y, true FROM bends
  UNION ALL SELECT location_id, x + 0.25, y, true FROM bends
  UNION ALL SELECT location_id, x + 0.25, y + 0.25, true FROM bends
  UNION ALL SELECT location_id, x, y + 0.25, true FROM bends
  UNION ALL SELECT location_id, x + 0.125, y + b0 * 0.000018::DOUBLE, abs(b0) >= 6 FROM bends
  UNION ALL SELECT location_id, x + 0.25 + b1 * 0.000018::DOUBLE, y + 0.125, abs(b1) >= 6 FROM bends
  UNION ALL SELECT location_id, x + 0.125, y + 0.25 + b2 * 0.000018::DOUBLE, abs(b2) >= 6 FROM bends
  UNION ALL SELECT location_id, x + b3 * 0.000018::DOUBLE, y + 0.125, abs(b3) >= 6 FROM bends)
SELECT location_id, round(px, 6) AS x, round(py, 6) AS y FROM points WHERE stays"""


def reprojected() -> str:
    """Inverse conformal conic by fixed-point iteration."""
    phi = "pi() / 2 - 2 * atan(t)"
    steps = []
    for i in range(6):
        steps.append(f"p{i} AS (SELECT *, {phi} AS phi{i} FROM {'polar' if i == 0 else f'p{i - 1}'})")
        e_sin = f"(e * sin(phi{i}))"
        phi = f"pi() / 2 - 2 * atan(t * pow((1 - {e_sin}) / (1 + {e_sin}), e / 2))"
    return f"""WITH ellipsoid AS (
  SELECT 6378137.0::DOUBLE * 3937 / 1200 AS a, sqrt(f * (2 - f)) AS e,
         radians(41 + 2 / 60.0::DOUBLE) AS l1, radians(40 + 40 / 60.0::DOUBLE) AS l2,
         radians(40 + 10 / 60.0::DOUBLE) AS l0
  FROM (SELECT 1 / 298.257222101::DOUBLE AS f)), m AS (
  SELECT *, cos(l1) / sqrt(1 - pow(e * sin(l1), 2)) AS m1,
         cos(l2) / sqrt(1 - pow(e * sin(l2), 2)) AS m2,
         tan(pi() / 4 - l1 / 2) / pow((1 - e * sin(l1)) / (1 + e * sin(l1)), e / 2) AS t1,
         tan(pi() / 4 - l2 / 2) / pow((1 - e * sin(l2)) / (1 + e * sin(l2)), e / 2) AS t2,
         tan(pi() / 4 - l0 / 2) / pow((1 - e * sin(l0)) / (1 + e * sin(l0)), e / 2) AS t0
  FROM ellipsoid), cone0 AS (
  SELECT *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS n FROM m), cone AS (
  SELECT *, a * m1 / (n * pow(t1, n)) AS af, a * m1 / (n * pow(t1, n)) * pow(t0, n) AS r0
  FROM cone0), corners AS (
  SELECT CAST(c_custkey AS INTEGER) AS location_id, CAST(s AS INTEGER) AS seq,
         (c_custkey % 128 + 900 + CASE WHEN s IN (1, 2) THEN 1 ELSE 0 END) * 1000.0::DOUBLE AS x,
         (c_custkey // 128 + 100 + CASE WHEN s IN (2, 3) THEN 1 ELSE 0 END) * 1000.0::DOUBLE AS y
  FROM customer CROSS JOIN range(0, 5) r(s)), polar AS (
  SELECT location_id, seq, e, n,
         atan2(x - 984250, r0 - y) AS theta,
         pow(sqrt(pow(x - 984250, 2) + pow(r0 - y, 2)) / af, 1 / n) AS t
  FROM corners CROSS JOIN cone), {', '.join(steps)}
SELECT location_id, seq, round(degrees(theta / n) - 74, 7) AS lon,
       round(degrees({phi}), 7) AS lat
FROM p5"""


VIOLATIONS = f"""WITH {PARCELS}
SELECT location_id, 'ring not closed' AS violation FROM parcels WHERE location_id % 11 = 0
UNION ALL SELECT location_id, 'boundary crosses itself' FROM parcels WHERE location_id % 11 = 1
UNION ALL SELECT location_id, 'coordinate out of range' FROM parcels WHERE location_id % 11 = 2
UNION ALL SELECT location_id, 'null zone_name' FROM parcels WHERE location_id % 11 = 3
UNION ALL SELECT location_id, 'duplicate location_id' FROM parcels WHERE location_id % 11 = 4"""

PROFILE_COLUMNS = {
    "VendorID": "int", "tpep_pickup_datetime": "timestamp_ntz",
    "tpep_dropoff_datetime": "timestamp_ntz", "passenger_count": "int",
    "trip_distance": "double", "RatecodeID": "int", "store_and_fwd_flag": "string",
    "PULocationID": "bigint", "DOLocationID": "int", "payment_type": "int",
    "fare_amount": "double", "extra": "double", "mta_tax": "double", "tip_amount": "double",
    "tolls_amount": "double", "improvement_surcharge": "double", "total_amount": "double",
    "source_file": "string", "source_row_number": "bigint",
}
# Kinds of faulty rows that are planted as nulls.
PLANTED_NULLS = {"tpep_pickup_datetime": 0, "DOLocationID": 5}


def profile() -> str:
    rows = [f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{t}' AS data_type, "
            f"count(*) AS row_count, count(*) FILTER (kind = {PLANTED_NULLS.get(c, -1)}) AS null_count "
            "FROM dirty"
            for i, (c, t) in enumerate(PROFILE_COLUMNS.items(), start=1)]
    return DIRTY + " " + " UNION ALL ".join(rows)


def oracle_sql() -> dict[str, str]:
    to_24 = "DATE '2024-01-24'"
    to_25 = "DATE '2024-01-25'"
    monday = "isodow(pickup_date) = 1"
    monday_calendar = "isodow(c.pickup_date) = 1"
    return {
        "zone_hourly_demand": BASE + ROLLUP,
        "zone_hourly_demand_long": LONG_BASE + ROLLUP,
        "rollup_merge": BASE + ROLLUP,
        "dataset_summary": DATASET_SUMMARY,
        "dashboard_summary": summary(BASE),
        "dashboard_summary_filtered": summary(BASE, FRIDAY),
        "dashboard_summary_long": summary(LONG_BASE),
        "daily_trend": daily(),
        "daily_trend_dates": daily(DATES),
        "weekday_hour_heatmap": heatmap(),
        "weekday_hour_heatmap_borough": heatmap(
            "borough = 'AMERICA' AND pickup_date BETWEEN DATE '2024-01-03' "
            "AND DATE '2024-01-28'"),
        "weekday_hour_dense": dense(DATES) + " SELECT * FROM cells",
        "heatmap_intensity": dense() + """, shares AS (
  SELECT *, trip_count / CAST(max(trip_count) OVER () AS DOUBLE) AS intensity FROM cells)
SELECT *, CAST(CASE WHEN trip_count <= 0 THEN 0 WHEN intensity >= 0.75 THEN 4
  WHEN intensity >= 0.5 THEN 3 WHEN intensity >= 0.25 THEN 2 ELSE 1 END AS SMALLINT) AS band
FROM shares""",
        "boroughs": f"WITH {ZONES} SELECT DISTINCT borough FROM zones",
        "zone_ranking": ranking(),
        "zone_ranking_dates": ranking(DATES, 50),
        "zone_ranking_borough": ranking(EUROPE),
        "top_zones": f"""WITH {ZONES}, {TRIPS}, ranked AS (
  SELECT z.location_id, zone_name, borough, count(*) AS trip_count,
         {scaled(half_up('sum(metres)', '10 * count(*)'), 100)} AS avg_trip_distance,
         {scaled(half_up('sum(cents)', 'count(*)'), 100)} AS avg_total_amount
  FROM trips t JOIN zones z ON t.location_id = z.location_id GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (ORDER BY trip_count DESC, location_id) AS INTEGER) AS position
FROM ranked ORDER BY trip_count DESC, location_id LIMIT 10""",
        "zone_hourly": hourly(),
        "zone_hourly_weekday": hourly("isodow(pickup_date) = 3"),
        "zone_hourly_one": hourly("location_id = 7"),
        "zone_hourly_dense": f"""{BASE}
SELECT z.location_id, CAST(h AS SMALLINT) AS pickup_hour, {TRIP_SUM} AS trip_count
FROM zones z CROSS JOIN range(0, 24) r(h)
LEFT JOIN demand d ON d.location_id = z.location_id AND d.pickup_hour = h GROUP BY 1, 2""",
        "demand_classes": classes(),
        "demand_classes_filtered": classes(FRIDAY, "borough = 'AMERICA'"),
        "demand_classes_turkish": classes(labels=(
            "Veri Yok", "Çok Düşük", "Düşük", "Orta", "Yüksek", "Çok Yüksek")),
        "cume_dist_amounts": f"""WITH {TRIPS}
SELECT row_number AS source_row_number, cents,
       cume_dist() OVER (ORDER BY cents) AS share FROM trips""",
        "zone_adjacency": f"""WITH {ZONES}
SELECT a.location_id, b.location_id AS neighbour_id FROM zones a JOIN zones b
  ON a.location_id <> b.location_id AND greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) = 1""",
        "parcel_adjacency": PARCEL_ADJACENCY,
        "mixed_parcel_adjacency": MIXED_ADJACENCY,
        "neighbour_stats": f"""{around('true', 'true')}
SELECT location_id, CAST(trip_count AS BIGINT) AS trip_count, neighbour_count,
       {scaled('mean_cents', 100)} AS neighbour_mean FROM measured""",
        "zone_hotspots": hotspots(),
        "zone_hotspots_borough": hotspots("borough = 'ASIA'", "borough = 'ASIA'"),
        "zone_hotspots_filtered": hotspots(MORNING),
        "zone_scores": scores(),
        "zone_scores_weekday": scores(EUROPE, "borough = 'EUROPE'"),
        "zone_scores_filtered": scores(MORNING),
        "zone_peaks": f"{BASE}, scoped AS (SELECT * FROM demand), {PEAKS} "
                      "SELECT * FROM hours JOIN weekdays USING (location_id)",
        "zone_details": details_cte() + " SELECT * FROM details",
        "zone_details_filtered": details_cte(FRIDAY, "borough = 'AMERICA'")
        + " SELECT * FROM details",
        "compare_zones": compare((3, 7, 12)),
        "comparison_series": series((3, 7)),
        "zone_trend": trend(),
        "zone_trend_filtered": trend("pickup_hour = 8", to_25, 10),
        "zone_trend_weekday": trend(monday, to_24, 14),
        "zone_anomalies": anomalies(),
        "zone_anomalies_filtered": anomalies("pickup_hour = 8", date_to=to_25, days=14,
                                             threshold=1.5),
        "zone_anomaly_items": anomaly_items(),
        "zone_anomaly_items_weekday": anomaly_items(monday, monday_calendar, to_24, 60, 1.0),
        "demand_forecast": forecast(),
        "demand_forecast_borough": forecast("borough = 'AMERICA'", 30, 3),
        "zone_extent": f"""WITH {ZONES}
SELECT borough, CAST(min(gx) AS DOUBLE) AS min_x, CAST(min(gy) AS DOUBLE) AS min_y,
       CAST(max(gx) + 1 AS DOUBLE) AS max_x, CAST(max(gy) + 1 AS DOUBLE) AS max_y
FROM zones GROUP BY 1""",
        "parcel_extent": f"""WITH {PARCELS}
SELECT borough, min(gx) * 0.25::DOUBLE AS min_x, min(gy) * 0.25::DOUBLE AS min_y,
       (max(gx) + 1) * 0.25::DOUBLE AS max_x, (max(gy) + 1) * 0.25::DOUBLE AS max_y
FROM parcels GROUP BY 1""",
        "trip_validation": TRIP_VALIDATION,
        "rejection_reasons": f"""{DIRTY}
SELECT 'events' AS source_file, row_number AS source_row_number, reason AS rejection_reason
FROM reasons WHERE reason <> ''""",
        "rejected_records": REJECTED_RECORDS,
        "trip_coercion": TRIP_COERCION,
        "trip_dst_guard": DST_GUARD,
        "load_idempotent": f"""WITH {TRIPS}
SELECT 'events' AS source_file, row_number AS source_row_number, pickup_date,
       {scaled('cents', 100)} AS total_amount
FROM trips WHERE pickup_date >= DATE '2024-01-16'""",
        "warehouse_load": f"""{DIRTY}
SELECT count(*) FILTER (WHERE reason = '') AS valid, count(*) FILTER (WHERE reason <> '') AS rejected,
       count(*) FILTER (WHERE reason = '') AS inserted,
       count(DISTINCT CAST(pickup AS DATE)) FILTER (WHERE reason = '') AS dates FROM reasons""",
        "warehouse_reload": f"""{DIRTY}
SELECT count(*) FILTER (WHERE reason = '') AS valid, count(*) FILTER (WHERE reason <> '') AS rejected,
       CAST(0 AS BIGINT) AS inserted,
       count(DISTINCT CAST(pickup AS DATE)) FILTER (WHERE reason = '') AS dates FROM reasons""",
        "warehouse_rejects": f"""{DIRTY}
SELECT reason AS rejection_reason, count(*) AS trips FROM reasons WHERE reason <> '' GROUP BY 1""",
        "warehouse_rollup": f"""{DIRTY}
SELECT CAST(pickup AS DATE) AS pickup_date, CAST(pickup_zone AS SMALLINT) AS location_id,
       count(*) AS trips, CAST(sum(cents) / 100.0 AS DOUBLE) AS total_amount
FROM reasons WHERE reason = '' GROUP BY 1, 2""",
        "rejects_upsert": f"""{DIRTY}
SELECT 'events' AS source_file, row_number AS source_row_number,
       CASE WHEN contains(reason, 'location') THEN reason ELSE 'earlier load' END
         AS rejection_reason
FROM reasons WHERE reason <> ''""",
        "zones_upsert": f"""WITH {PARCELS}
SELECT location_id, zone_name, borough,
       CASE WHEN c_acctbal < 0 THEN 'Old Service' END AS service_zone,
       c_acctbal < 0 AS is_known
FROM parcels""",
        "table_profile": profile(),
        "geometry_types": f"WITH {PARCELS} SELECT 'Polygon' AS geometry_type, "
                          "count(*) AS zone_count FROM parcels",
        "geometry_types_mixed": f"""WITH {PARCELS}, shapes AS (
  SELECT CASE WHEN location_id % 4 = 3 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type FROM parcels
  UNION ALL SELECT 'Polygon' FROM parcels WHERE location_id % 4 = 2
  UNION ALL SELECT 'Polygon')
SELECT geometry_type, count(*) AS zone_count FROM shapes GROUP BY 1""",
        "zone_violations": VIOLATIONS,
        "geojson_features": GEOJSON,
        "simplify_boundaries": SIMPLIFIED,
        "reproject_vertices": reprojected(),
    }
