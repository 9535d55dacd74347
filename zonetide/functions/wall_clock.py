"""Wall-clock times of a time zone with daylight saving."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
HOUR = 3_600_000_000


def wall_clocks_to_utc(df: DataFrame, columns: Iterable[str], zone: str = NEW_YORK) -> DataFrame:
    """Turn naive wall-clock columns into instants; null where the clock skips or repeats.

    Spark resolves both cases silently, taking the earlier instant of a repeated time, so
    the result is converted back. Almost always an hour later reads an hour later, which
    rules out both cases at once; only around a clock change is more to compare.
    """
    columns = list(columns)
    df = df.withColumns({
        f"_{c}_utc": F.to_utc_timestamp(F.col(c).cast("timestamp"), zone) for c in columns})

    def unique(name: str) -> Column:
        # Plain microseconds: adding an interval would consult the session's time zone.
        wall, utc = F.unix_micros(F.col(name).cast("timestamp")), F.col(f"_{name}_utc")

        def shown(instant: Column) -> Column:
            return F.unix_micros(F.from_utc_timestamp(instant, zone))

        hour_later = shown(F.timestamp_micros(F.unix_micros(utc) + HOUR))
        return F.when(hour_later == wall + HOUR, utc).when(
            (shown(utc) == wall) & (hour_later != wall), utc)

    return df.withColumns({c: unique(c) for c in columns}).drop(
        *[f"_{c}_utc" for c in columns])


def utc_to_wall_clock(utc: Column, zone: str = NEW_YORK) -> Column:
    return F.from_utc_timestamp(utc, zone)


def iso_text(instant: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only when there are any."""
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(instant, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction),
                    F.lit("+00:00"))
