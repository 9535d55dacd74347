"""Cumulative distribution over a whole frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ShortType

DIGIT_BITS = 16
DIGITS = 4


def zone_grain(zones: DataFrame) -> DataFrame:
    """The frame, if its zone ids have the type that bounds their number."""
    if zones.schema["location_id"].dataType != ShortType():
        raise TypeError("Zones are ranked in one task: location_id has to be a smallint.")
    return zones


def zone_cume_dist(value: str, *within: Column) -> Column:
    """``cume_dist`` over zone-grain rows.

    A global window sorts in one task. Zone-grain frames (``zone_grain``) are bounded by the key
    type (``location_id`` is a smallint: at most 65 536 rows whatever the number of
    trips), so one task is the right size. Use ``with_cume_dist`` for anything else.
    """
    return F.cume_dist().over(Window.partitionBy(*within).orderBy(value))


def with_cume_dist(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``cume_dist() over (order by value)`` without a global sort.

    ``value`` is a bigint column (scale decimals first). Rows are counted per
    distinct value, which absorbs hot values map-side; the running total over the
    distinct values is then summed digit by digit in base 65 536. Every window
    group is one digit position below one prefix, so it never exceeds 65 536 rows,
    and since nothing depends on sampled boundaries, a recomputed task gives the
    same result. Null values come first, as in an ascending window.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    known = counts.where(F.col(value).isNotNull())
    total = F.sum("_n").cast("bigint")

    def prefix(level: int) -> Column:
        return F.shiftright(F.col(value), DIGIT_BITS * (DIGITS - 1 - level))

    level_totals = known.select("_n", *[prefix(i).alias(f"_p{i}") for i in range(DIGITS)])
    before = []
    for level in reversed(range(DIGITS)):
        prefixes = [f"_p{i}" for i in range(level + 1)]
        level_totals = level_totals.groupBy(*prefixes).agg(total.alias("_n"))
        parent = Window.partitionBy(*prefixes[:-1]) if level else Window.partitionBy(F.lit(0))
        earlier = parent.orderBy(prefixes[-1]).rowsBetween(Window.unboundedPreceding, -1)
        before.insert(0, level_totals.select(
            *prefixes, "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    # Down the digits: what lies before a prefix lies before all values below it.
    running = before[0]
    for level in range(1, DIGITS):
        above = running.withColumnRenamed("_before", "_above").drop("_n")
        running = before[level].join(above, [f"_p{i}" for i in range(level)]).withColumn(
            "_before", F.col("_before") + F.col("_above")).drop("_above")

    nulls = F.coalesce(
        counts.where(F.col(value).isNull()).agg(F.sum("_n")).scalar(), F.lit(0))
    size = counts.agg(F.sum("_n")).scalar()
    below = F.col("_before") + F.col("_n")
    # The last prefix is the value itself.
    shares = running.select(F.col(f"_p{DIGITS - 1}").alias(value),
                            ((below + nulls) / size).cast("double").alias(out))
    null_share = (nulls / size).cast("double")
    joined = df.join(shares, value, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), null_share)).select(*df.columns, out)
