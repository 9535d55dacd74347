import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import box
from pyspark.sql import functions as F

from zonetide.functions.wall_clock import wall_clocks_to_utc
from zonetide.operators.cleaning import clean_trips
from zonetide.sources.profile import profile
from zonetide.sources.trips import read_trips, require_columns

RAW = ("VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
       "passenger_count double, trip_distance double, RatecodeID double, "
       "store_and_fwd_flag string, PULocationID int, DOLocationID int, payment_type bigint, "
       "fare_amount double, extra double, mta_tax double, tip_amount double, "
       "tolls_amount double, improvement_surcharge double, total_amount double, "
       "Airport_fee double, note string, source_file string, source_row_number bigint")
GOOD = {
    "VendorID": 1, "tpep_pickup_datetime": datetime(2024, 7, 1, 12, 0),
    "tpep_dropoff_datetime": datetime(2024, 7, 1, 12, 10, 0, 500000), "passenger_count": 1.0,
    "trip_distance": 1.2345, "RatecodeID": 1.0, "store_and_fwd_flag": " n\t", "PULocationID": 1,
    "DOLocationID": 2, "payment_type": 1, "fare_amount": 0.285, "extra": 0.0, "mta_tax": 0.5,
    "tip_amount": 0.0, "tolls_amount": 0.0, "improvement_surcharge": 0.0, "total_amount": 10.0,
    "Airport_fee": 1.25, "note": "kept", "source_file": "f.parquet", "source_row_number": 1}


@pytest.fixture
def zones(make_zones):
    return make_zones({1: [[box(0, 0)]], 2: [[box(1, 0)]]})


@pytest.fixture
def split(spark, zones):
    def run(*changes):
        rows = [{**GOOD, "source_row_number": i, **c} for i, c in enumerate(changes, start=1)]
        raw = spark.createDataFrame(
            [tuple(r[f.split()[0]] for f in RAW.split(", ")) for r in rows], RAW)
        return clean_trips(raw, zones)
    return run


def test_valid_row_is_standardised(split):
    row = split({}).valid.first()
    assert row.pickup_date == date(2024, 7, 1) and row.pickup_hour == 12
    assert row.trip_duration_seconds == 600  # 600.5 rounds to even
    assert row.store_and_fwd_flag == "N"
    assert row.trip_distance == Decimal("1.235")
    assert row.fare_amount == Decimal("0.29")
    assert row.airport_fee == Decimal("1.25")
    assert row.cbd_congestion_fee is None


def test_instants_are_utc(split):
    shown = split({}).valid.select(F.date_format("pickup_datetime", "yyyy-MM-dd HH:mm")).first()[0]
    assert shown == "2024-07-01 16:00"


REASONS = [
    ({"tpep_pickup_datetime": None}, "pickup_datetime_missing_or_invalid"),
    ({"tpep_dropoff_datetime": None}, "dropoff_datetime_missing_or_invalid"),
    ({"tpep_dropoff_datetime": datetime(2024, 7, 1, 11, 0)}, "dropoff_before_pickup"),
    ({"trip_distance": -0.0001}, "negative_trip_distance"),
    ({"passenger_count": -1.0}, "negative_passenger_count"),
    ({"PULocationID": 99}, "invalid_pickup_location_id"),
    ({"PULocationID": None}, "invalid_pickup_location_id"),
    ({"DOLocationID": None}, "invalid_dropoff_location_id"),
    ({"store_and_fwd_flag": ""}, "invalid_store_and_fwd_flag"),
    ({"passenger_count": 1.5}, "non_integer_passenger_count"),
    ({"total_amount": float("inf")}, "infinite_amount"),
    ({"trip_distance": -1.0, "PULocationID": 99},
     "negative_trip_distance; invalid_pickup_location_id"),
    ({"tpep_pickup_datetime": datetime(2026, 3, 8, 2, 30)},
     "pickup_datetime_missing_or_invalid"),
]


def test_reasons_in_rule_order(split):
    result = split(*[c for c, _ in REASONS])
    found = {r.source_row_number: r.rejection_reason for r in result.rejected.collect()}
    expected = dict(enumerate((r for _, r in REASONS), start=1))
    # The skipped hour lies after the default drop-off.
    assert found == expected
    assert result.valid.count() == 0


def test_nulls_pass_where_allowed(split):
    result = split({"trip_distance": None}, {"passenger_count": None},
                   {"store_and_fwd_flag": None}, {"passenger_count": float("nan")})
    assert result.valid.count() == 4 and result.rejected.count() == 0


def test_valid_and_rejected_add_up(split):
    result = split(*[c for c, _ in REASONS], {}, {})
    assert result.valid.count() + result.rejected.count() == len(REASONS) + 2


def test_rejected_record_keeps_everything(split):
    record = split({"PULocationID": 99, "passenger_count": 1.5}).rejected.first()
    fields = json.loads(record.raw_record)
    assert fields["pickup_datetime"] == "2024-07-01T16:00:00+00:00"
    assert fields["dropoff_datetime"] == "2024-07-01T16:10:00.500000+00:00"
    assert fields["passenger_count"] == 1.5 and fields["rate_code_id"] == 1
    assert fields["note"] == "kept"
    assert fields["cbd_congestion_fee"] is None
    assert fields["pickup_date"] == "2024-07-01"
    assert fields["rejection_reason"] == (
        "invalid_pickup_location_id; non_integer_passenger_count")
    assert "_pickup_zone" not in fields


def test_money_out_of_range_raises(split):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|cannot be represented"):
        split({"total_amount": 1e9}).valid.collect()


def test_clock_changes(spark):
    walls = ["2026-03-08 02:30", "2026-11-01 01:30", "2026-11-01 00:59", "2026-11-01 02:00"]
    df = spark.createDataFrame([(w,) for w in walls], "w string").select(
        "w", F.col("w").cast("timestamp_ntz").alias("t"))
    rows = {r.w: r.u for r in wall_clocks_to_utc(df, ["t"]).select(
        "w", F.date_format("t", "HH:mm").alias("u")).collect()}
    assert [rows[w] for w in walls] == [None, None, "04:59", "07:00"]


def test_text_columns_are_coerced(spark, zones):
    text = ", ".join(f"{f.split()[0]} string" for f in RAW.split(", ")[:-1])
    raw = spark.createDataFrame([tuple(
        str(GOOD[f.split()[0]]) for f in RAW.split(", ")[:-1])], text).withColumn(
        "source_row_number", F.lit(1).cast("bigint"))
    split_ = clean_trips(raw, zones)
    assert split_.valid.count() == 1
    broken = raw.withColumn("tpep_pickup_datetime", F.lit("soon")).withColumn(
        "trip_distance", F.lit("far"))
    assert clean_trips(broken, zones).rejected.first().rejection_reason == (
        "pickup_datetime_missing_or_invalid")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match=r"\['PULocationID', 'VendorID'\]"):
        require_columns(spark.range(1), ("VendorID", "id", "PULocationID"))


def test_row_identity_and_missing_path(spark, tmp_path):
    columns = [f for f in RAW.split(", ")[:17]]
    raw = spark.createDataFrame([tuple(GOOD[f.split()[0]] for f in columns)] * 5,
                                ", ".join(columns))
    path = str(tmp_path / "trips")
    raw.coalesce(1).write.parquet(path)
    rows = read_trips(spark, path).collect()
    assert sorted(r.source_row_number for r in rows) == [1, 2, 3, 4, 5]
    assert {r.source_file for r in rows} and rows[0].source_file.endswith(".parquet")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_trips(spark, str(tmp_path / "absent"))


def test_profile(spark, zones):
    p = profile(zones)
    assert p.crs == "EPSG:4326" and p.head.count() == 2
    counts = {r.column_name: (r.row_count, r.null_count) for r in p.null_counts.collect()}
    assert counts["service_zone"] == (2, 2) and counts["geom"] == (2, 0)
    assert [tuple(r) for r in p.geometry_types.collect()] == [("Polygon", 2)]
    assert profile(spark.range(3)).geometry_types is None
