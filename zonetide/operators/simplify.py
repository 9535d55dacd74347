"""Fewer vertices within a tolerance, without changing a zone's topology."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.functions import straighten
from zonetide.schemas import GEOMETRY

# Sent along with the function: executors need not have this package installed.
cloudpickle.register_pickle_by_value(straighten)

# Fixed value: tolerance in degrees used for published boundaries.
DEFAULT_TOLERANCE = 0.0001


def simplify(zones: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Zones with ``geom`` simplified; every other column unchanged.

    Zones are independent, so the work spreads over the rows: they are dealt out to all
    cores first, as zone files are small but slow to simplify. A call handles the rings of
    one row, which already had to fit there. Only coordinates travel to Python and only
    vertex positions come back.
    """
    cores = zones.sparkSession.sparkContext.defaultParallelism
    zones = zones.repartition(cores, "location_id")

    @F.pandas_udf("array<array<int>>")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([
                [] if x is None or not len(x) else straighten.keep_vertices(
                    [np.column_stack(pair) for pair in zip(x, y, strict=True)], tolerance)
                for x, y in zip(xs, ys, strict=True)])

    def coordinates(axis: str) -> Column:
        return F.transform(F.flatten("geom"), lambda ring: F.transform(ring, lambda v: v[axis]))

    with_kept = zones.withColumn("_keep", kept(coordinates("x"), coordinates("y"))).withColumn(
        # Rings before each polygon, to find its part of the flat list.
        "_first", F.transform(F.col("geom"), lambda p, i: F.aggregate(
            F.slice("geom", 1, i), F.lit(0), lambda n, q: n + F.size(q))))

    def thin_ring(polygon_number: Column, ring: Column, ring_number: Column) -> Column:
        positions = F.get("_keep", F.get("_first", polygon_number) + ring_number)
        return F.transform(positions, lambda at: F.get(ring, at))

    thin = F.transform("geom", lambda polygon, p: F.transform(
        polygon, lambda ring, r: thin_ring(p, ring, r)))
    return with_kept.withColumn("geom", thin.cast(GEOMETRY)).drop("_keep", "_first")
