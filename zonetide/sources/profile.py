"""A first look at a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Size, schema and sample of a table; the frames are lazy."""

    columns: list[str]
    dtypes: dict[str, str]
    head: DataFrame
    null_counts: DataFrame
    geometry_types: DataFrame | None
    crs: str | None


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: name, position, type, rows and nulls, from a single scan."""
    counted = df.agg(F.count("*").alias("row_count"), *[
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"),
                      F.lit(t).alias("data_type"), F.col(f"n{i}").alias("null_count"))
             for i, (c, t) in enumerate(df.dtypes)]
    return counted.select("row_count", F.explode(F.array(*cells)).alias("c")).select(
        "c.position", "c.column_name", "c.data_type", "row_count", "c.null_count")


def geometry_types(zones: DataFrame) -> DataFrame:
    """Number of zones per geometry type; several parts make a multipolygon."""
    kind = (F.when(F.col("geom").isNull(), None)
            .when(F.size("geom") == 1, "Polygon").otherwise("MultiPolygon"))
    return zones.groupBy(kind.alias("geometry_type")).agg(F.count("*").alias("zone_count"))


def profile(df: DataFrame, rows: int = 10, crs: str | None = None) -> Profile:
    has_geometry = "geom" in df.columns
    return Profile(
        columns=df.columns, dtypes=dict(df.dtypes), head=df.limit(rows),
        null_counts=null_counts(df),
        geometry_types=geometry_types(df) if has_geometry else None,
        crs=(crs or "EPSG:4326") if has_geometry else None)
