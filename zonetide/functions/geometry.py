"""Planar geometry as column expressions over nested vertex arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relative rounding bound of the floating-point orientation determinant
# (Shewchuk 1997, "ccwerrboundA").
ORIENTATION_ERROR = 3.3306690738754716e-16
EXACT = "decimal(18,12)"

Point = tuple[Column, Column]


def point(x: str, y: str) -> Point:
    return F.col(x), F.col(y)


def orientation(a: Point, b: Point, c: Point) -> Column:
    """Sign of the turn a -> b -> c: 1 left, -1 right, 0 straight.

    Floating point decides whenever its error bound allows; the rest is computed in
    exact decimals with 12 fractional digits (a tenth of a micrometre in degrees).
    """
    left = (b[0] - a[0]) * (c[1] - a[1])
    right = (b[1] - a[1]) * (c[0] - a[0])
    det = left - right
    (ax, ay), (bx, by), (cx, cy) = [(x.cast(EXACT), y.cast(EXACT)) for x, y in (a, b, c)]
    exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    bound = (F.abs(left) + F.abs(right)) * ORIENTATION_ERROR
    return (F.when(F.abs(det) >= bound, F.signum(det))
            .otherwise(F.signum(exact.cast("double"))).cast("int"))


def in_box(p: Point, a: Point, b: Point) -> Column:
    """Whether p lies in the bounding box of a and b."""
    return ((p[0] >= F.least(a[0], b[0])) & (p[0] <= F.greatest(a[0], b[0]))
            & (p[1] >= F.least(a[1], b[1])) & (p[1] <= F.greatest(a[1], b[1])))


def equal(p: Point, q: Point) -> Column:
    return (p[0] == q[0]) & (p[1] == q[1])


def without_repeats(ring: Column) -> Column:
    """Drop vertices equal to their predecessor."""
    return F.filter(ring, lambda v, i: (i == 0) | (v != F.get(ring, i - 1)))


def signed_area(ring: Column) -> Column:
    """Area of a closed ring, positive when it turns left (counter-clockwise)."""
    origin = F.get(ring, F.lit(0))

    def add(total: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        cross = ((a["x"] - origin["x"]) * (b["y"] - origin["y"])
                 - (a["y"] - origin["y"]) * (b["x"] - origin["x"]))
        return total + cross / 2

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), add)


def map_vertices(geom: Column, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to each vertex of a multipolygon."""
    return F.transform(geom, lambda polygon: F.transform(
        polygon, lambda ring: F.transform(ring, change)))


def rings(zones: DataFrame, *keep: str) -> DataFrame:
    """One row per ring: location_id, poly, ring, vertices."""
    return (
        # For an inner explode Spark adds a filter on ``geom``, which moves down and makes every boundary once more, before
        # zones are dealt out.
        zones.select("location_id", *keep, F.posexplode_outer("geom").alias("poly", "polygon"))
        .where("polygon IS NOT NULL")
        .select("location_id", *keep, "poly",
                F.posexplode("polygon").alias("ring", "vertices"))
    )


def vertices(zones: DataFrame, *keep: str) -> DataFrame:
    """One row per vertex: location_id, poly, ring, seq, x, y."""
    return (
        rings(zones, *keep)
        .select("location_id", *keep, "poly", "ring",
                F.posexplode("vertices").alias("seq", "v"))
        .select("location_id", *keep, "poly", "ring", "seq", "v.x", "v.y")
    )


def edges(zones: DataFrame) -> DataFrame:
    """One row per directed edge, with the vertex before it.

    Rings are turned so that the interior lies on the left: shells counter-clockwise,
    holes clockwise. (px, py) precedes (x1, y1); everything happens inside the row that
    holds the ring, so no shuffle is needed.
    """
    clean = rings(zones).withColumn("vertices", without_repeats(F.col("vertices")))
    wrong_way = (signed_area(F.col("vertices")) > 0) != (F.col("ring") == 0)
    turned = clean.where(F.size("vertices") >= 4).withColumn(
        "vertices", F.when(wrong_way, F.reverse("vertices")).otherwise(F.col("vertices")))
    last = F.size("vertices") - 2

    def edge(i: Column) -> Column:
        before = F.get("vertices", F.when(i == 0, last).otherwise(i - 1))
        return F.struct(before.alias("p"), F.get("vertices", i).alias("a"),
                        F.get("vertices", i + 1).alias("b"))

    return (
        turned.select("location_id", "poly", "ring",
                      F.posexplode(F.transform(F.sequence(F.lit(0), last), edge))
                      .alias("seq", "e"))
        .select("location_id", "poly", "ring", "seq",
                F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"),
                F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"),
                F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    )


def extent(zones: DataFrame, by: str | None = None) -> DataFrame:
    """Bounding box of the given zones, or one per value of ``by``."""
    points = vertices(zones, *([by] if by else []))
    box = [F.min("x").alias("min_x"), F.min("y").alias("min_y"),
           F.max("x").alias("max_x"), F.max("y").alias("max_y")]
    return points.groupBy(by).agg(*box) if by else points.agg(*box)
