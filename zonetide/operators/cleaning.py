"""Standardising and validating raw trips."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonetide.functions.wall_clock import iso_text, utc_to_wall_clock, wall_clocks_to_utc
from zonetide.schemas import (
    INTEGER_COLUMNS,
    MONEY_COLUMNS,
    OPTIONAL_COLUMNS,
    SOURCE_NAMES,
    TIME_COLUMNS,
    TRIP_TYPES,
)
from zonetide.sources.trips import require_columns

WHITESPACE = " \t\n\r\f\v"


@dataclass(frozen=True)
class CleanTrips:
    """Valid trips with stored types, and rejected rows with reason and record."""

    valid: DataFrame
    rejected: DataFrame


def _number(df: DataFrame, name: str) -> Column:
    """Whole numbers as bigint, others as double; unreadable text and NaN become null."""
    value, dtype = F.col(name), df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        return value.cast("bigint")
    if isinstance(dtype, T.DecimalType):
        return value.cast("double")
    value = value.try_cast("double")
    return F.when(~F.isnan(value), value)


def standardise(raw: DataFrame) -> DataFrame:
    """Standard names, UTC instants, coerced numbers and derived columns.

    Columns outside the standard set are kept for the rejected records. Integer columns
    read from fractional types stay doubles here, so that fractions can be told apart.
    The steps stay separate projections: each compiles to a method of its own, small
    enough for the JIT compiler.
    """
    require_columns(raw)
    df = raw.withColumnsRenamed({s: t for s, t in SOURCE_NAMES.items() if s in raw.columns})
    df = df.withColumns({c: F.lit(None).cast("double") for c in OPTIONAL_COLUMNS
                         if c not in df.columns})
    naive = [c for c in TIME_COLUMNS if not isinstance(df.schema[c].dataType, T.TimestampType)]
    df = df.withColumns({
        # Naive New York time; unreadable text becomes null.
        **{c: F.col(c).try_cast("timestamp_ntz") for c in naive},
        **{c: _number(df, c) for c in (*INTEGER_COLUMNS, "trip_distance", *MONEY_COLUMNS)},
        "store_and_fwd_flag": F.upper(F.trim(
            F.col("store_and_fwd_flag").cast("string"), F.lit(WHITESPACE))),
    })
    if "pickup_datetime" in naive:
        df = df.withColumn("_local", F.col("pickup_datetime"))
    else:
        df = df.withColumn("_local", utc_to_wall_clock(F.col("pickup_datetime")))
    df = wall_clocks_to_utc(df, naive)
    micros = F.unix_micros("dropoff_datetime") - F.unix_micros("pickup_datetime")
    has_pickup = F.col("pickup_datetime").isNotNull()
    return df.withColumns({
        "trip_duration_seconds": F.rint(micros / 1e6).cast("bigint"),
        "pickup_date": F.when(has_pickup, F.to_date("_local")),
        "pickup_hour": F.when(has_pickup, F.hour("_local")),
    }).drop("_local")


def with_zone_matches(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Add ``_pickup_zone`` and ``_dropoff_zone``: the id when the zone exists, else null.

    The zone side is left unhinted: Spark broadcasts it while its size stays below the
    broadcast threshold and otherwise joins by shuffle, splitting hot zones at run time.
    """
    ids = zones.select(F.col("location_id").cast("bigint").alias("_id"))
    for name in ("pickup", "dropoff"):
        found = ids.withColumnRenamed("_id", f"_{name}_zone")
        wanted = F.col(f"{name}_location_id").try_cast("bigint")
        trips = trips.join(found, wanted == F.col(f"_{name}_zone"), "left")
    return trips


def _fractional(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if isinstance(df.schema[c].dataType, T.DoubleType)]


def broken_rules(df: DataFrame) -> dict[str, Column]:
    """Rejection reasons in reporting order, each with the condition that raises it.

    A condition that compares with null is null and raises nothing.
    """
    amounts = _fractional(df, ("trip_distance", *MONEY_COLUMNS))
    infinite = {"infinite_amount": F.greatest(*[F.abs(F.col(c)) for c in amounts], F.lit(0.0))
                == float("inf")} if amounts else {}
    # Names of the reasons, in reporting order.
    return {
        "pickup_datetime_missing_or_invalid": F.col("pickup_datetime").isNull(),
        "dropoff_datetime_missing_or_invalid": F.col("dropoff_datetime").isNull(),
        "dropoff_before_pickup": F.col("dropoff_datetime") < F.col("pickup_datetime"),
        "negative_trip_distance": F.col("trip_distance") < 0,
        "negative_passenger_count": F.col("passenger_count") < 0,
        "invalid_pickup_location_id": F.col("_pickup_zone").isNull(),
        "invalid_dropoff_location_id": F.col("_dropoff_zone").isNull(),
        "invalid_store_and_fwd_flag": ~F.col("store_and_fwd_flag").isin("Y", "N"),
        **{f"non_integer_{c}": F.col(c) != F.floor(c)
           for c in _fractional(df, INTEGER_COLUMNS)},
        **infinite,
    }


def fault_count(rules: dict[str, Column]) -> Column:
    """Number of broken rules.

    Filtering on one number, not on a conjunction, keeps the optimiser from pushing the
    rules apart and repeating the time conversions under each of them.
    """
    return reduce(add, [F.when(broken, 1).otherwise(0) for broken in rules.values()])


def rejection_reason(rules: dict[str, Column]) -> Column:
    return F.concat_ws("; ", *[F.when(broken, name) for name, broken in rules.items()])


def stored_trip(trips: DataFrame) -> DataFrame:
    """Cast to the stored types. Rounds half up; values out of range raise (ANSI)."""
    return trips.select(*[F.col(c).cast(t).alias(c) for c, t in TRIP_TYPES.items()])


def rejected_record(rejected: DataFrame) -> DataFrame:
    """Key, reason and the whole row as JSON, with nulls and fractional integers kept."""
    mixed = _fractional(rejected, INTEGER_COLUMNS)

    def shown(name: str) -> Column:
        value = F.col(name)
        if name in TIME_COLUMNS:
            value = iso_text(value)
        elif name in mixed:
            whole = value.try_cast("bigint")
            value = F.when(value == whole, whole.cast("variant")).otherwise(value.cast("variant"))
        return value.alias(name)

    return rejected.select(
        "source_file", "source_row_number", "rejection_reason",
        F.to_json(F.struct(*[shown(c) for c in rejected.columns]),
                  {"ignoreNullFields": "false"}).alias("raw_record"),
        F.current_timestamp().alias("rejected_at"))


def clean_trips(raw: DataFrame, zones: DataFrame) -> CleanTrips:
    """Split raw trips (with source_file and source_row_number) by the quality rules."""
    matched = with_zone_matches(standardise(raw), zones)
    rules = broken_rules(matched)
    faults = fault_count(rules)
    rejected = matched.where(faults > 0).withColumn("rejection_reason", rejection_reason(rules))
    return CleanTrips(
        valid=stored_trip(matched.where(faults == 0)),
        rejected=rejected_record(rejected.drop("_pickup_zone", "_dropoff_zone")))
