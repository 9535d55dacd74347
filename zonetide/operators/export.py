"""GeoJSON features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.functions.geometry import map_vertices

DECIMALS = 6


def geojson_geometry(geom: Column, decimals: int = DECIMALS) -> Column:
    """GeoJSON MultiPolygon as a struct, coordinates rounded."""
    positions = map_vertices(geom, lambda v: F.array(
        F.round(v["x"], decimals), F.round(v["y"], decimals)))
    return F.when(geom.isNotNull(), F.struct(
        F.lit("MultiPolygon").alias("type"), positions.alias("coordinates")))


def to_features(result: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    """One GeoJSON Feature per row in column ``feature``; null properties are kept."""
    names = properties or [c for c in result.columns if c != "geom"]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        geojson_geometry(F.col("geom")).alias("geometry"),
        F.struct(*names).alias("properties"))
    return result.select(
        F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_features(result: DataFrame, path: str, properties: Sequence[str] | None = None) -> None:
    """Newline-delimited GeoJSON, written in parallel."""
    to_features(result, properties).withColumnRenamed("feature", "value").write.text(path)

