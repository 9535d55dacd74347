"""Table schemas and column lists."""

from __future__ import annotations

# Source column -> standard name, in source order.
SOURCE_NAMES = {
    "VendorID": "vendor_id",
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
    "passenger_count": "passenger_count",
    "trip_distance": "trip_distance",
    "RatecodeID": "rate_code_id",
    "store_and_fwd_flag": "store_and_fwd_flag",
    "PULocationID": "pickup_location_id",
    "DOLocationID": "dropoff_location_id",
    "payment_type": "payment_type",
    "fare_amount": "fare_amount",
    "extra": "extra_amount",
    "mta_tax": "mta_tax",
    "tip_amount": "tip_amount",
    "tolls_amount": "tolls_amount",
    "improvement_surcharge": "improvement_surcharge",
    "total_amount": "total_amount",
    "congestion_surcharge": "congestion_surcharge",
    "Airport_fee": "airport_fee",
    "airport_fee": "airport_fee",
    "cbd_congestion_fee": "cbd_congestion_fee",
}
# Standard names of columns that a source may lack.
OPTIONAL_COLUMNS = ("congestion_surcharge", "airport_fee", "cbd_congestion_fee")
REQUIRED_COLUMNS = tuple(
    source for source, name in SOURCE_NAMES.items() if name not in OPTIONAL_COLUMNS)

# Standard names by kind.
TIME_COLUMNS = ("pickup_datetime", "dropoff_datetime")
INTEGER_COLUMNS = ("vendor_id", "passenger_count", "rate_code_id", "pickup_location_id",
                   "dropoff_location_id", "payment_type")
MONEY_COLUMNS = ("fare_amount", "extra_amount", "mta_tax", "tip_amount", "tolls_amount",
                 "improvement_surcharge", "congestion_surcharge", "airport_fee",
                 "cbd_congestion_fee", "total_amount")

# Stored trip columns and their types.
TRIP_TYPES = {
    "vendor_id": "smallint",
    "pickup_datetime": "timestamp",
    "dropoff_datetime": "timestamp",
    "passenger_count": "smallint",
    "trip_distance": "decimal(10,3)",
    "rate_code_id": "smallint",
    "store_and_fwd_flag": "string",
    "pickup_location_id": "smallint",
    "dropoff_location_id": "smallint",
    "payment_type": "smallint",
    **{c: "decimal(10,2)" for c in MONEY_COLUMNS},
    "trip_duration_seconds": "int",
    "pickup_date": "date",
    "pickup_hour": "smallint",
    "source_file": "string",
    "source_row_number": "bigint",
}
TRIP_KEY = ("source_file", "source_row_number")
REJECT_SCHEMA = ("source_file string, source_row_number bigint, rejection_reason string, "
                 "raw_record string, rejected_at timestamp")

# polygons -> rings (first = shell, others = holes) -> vertices
GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
ZONE_SCHEMA = ("location_id smallint, zone_name string, borough string, service_zone string, "
               f"geom {GEOMETRY}")

ROLLUP_KEY = ("pickup_date", "pickup_hour", "location_id", "zone_name", "borough")
ROLLUP_COLUMNS = (*ROLLUP_KEY, "trip_count", "avg_trip_distance", "avg_duration_seconds",
                  "avg_total_amount", "total_amount")
# The stored rollup: the columns above, exact sums for merging, and the partition column.
ROLLUP_SCHEMA = (
    "pickup_date date, pickup_hour smallint, location_id smallint, zone_name string, "
    "borough string, trip_count bigint, avg_trip_distance decimal(10,3), "
    "avg_duration_seconds decimal(12,2), avg_total_amount decimal(10,2), "
    "total_amount decimal(20,2), distance_sum decimal(20,3), distance_rows bigint, "
    "duration_sum bigint, duration_rows bigint, amount_sum decimal(20,2), amount_rows bigint, "
    "pickup_month string")
