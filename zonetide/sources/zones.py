"""Zone boundaries: reading, checks, reprojection."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.functions.geometry import map_vertices
from zonetide.functions.projection import inverse, projection_of
from zonetide.operators.adjacency import edge_pairs, stored_edges, with_turns
from zonetide.schemas import GEOMETRY
from zonetide.sources.trips import require_columns

POSITIONS = "array<array<array<double>>>"
# Coordinates stay text here, as their depth depends on the type.
FEATURE = "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"
DOCUMENT = (f"{FEATURE}, crs struct<properties:struct<name:string>>, "
            "features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>")


def read_zones(spark: SparkSession, path: str, source_crs: str | None = "EPSG:4326",
               names: dict[str, str] | None = None, id_type: str = "smallint") -> DataFrame:
    """Zones from GeoJSON files: Features and FeatureCollections, one per line or one per file, in any mixture.

    Each file is taken for what it is. A ``crs`` member holds for its own collection or feature in the place of ``source_crs``.
    ``names`` maps the id, name and borough properties of the file; polygons become multipolygons and coordinates
    longitude / latitude. ``id_type`` is the type of the ids: the stored one, or a wider one for maps of more zones than that
    can number. Documents of another type raise ``ValueError``.
    """
    names = names or {"LocationID": "location_id", "zone": "zone_name", "borough": "borough"}
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    kind = F.get_json_object("line", "$.type")
    is_document = (kind.isin("Feature", "FeatureCollection") & F.json_object_keys("line").isNotNull()
                   & F.col("line").endswith("}"))
    # Zone files are few: each holds a part of at most 65 536 zones.
    files = lines.where("line <> ''").groupBy("file").agg(
        F.min(F.coalesce(is_document, F.lit(False))).alias("by_line")).collect()
    documents = spark.createDataFrame([], DOCUMENT)
    for by_line in (True, False):
        chosen = [unquote(r["file"]) for r in files if r["by_line"] is by_line]
        if chosen:
            documents = documents.unionByName(
                spark.read.schema(DOCUMENT).option("multiLine", not by_line).json(chosen))
    single = F.array(F.struct("properties", "geometry"))
    features = documents.select(F.col("crs.properties.name").alias("crs"), F.explode(
        F.when(F.col("type") == "Feature", single).otherwise(F.coalesce("features", F.array(F.struct(
            F.raise_error(F.lit("not a GeoJSON Feature or FeatureCollection")).cast("map<string,string>")
            .alias("properties"), F.lit(None).cast("struct<type:string, coordinates:string>").alias("geometry")))))).alias("f"))
    # One plan for each coordinate system declared.
    declared = sorted({r["crs"] for r in documents.select("crs.properties.name").distinct()
                       .withColumnRenamed("name", "crs").collect()} if files else {None}, key=str)
    parts = [(features.where(F.col("crs").eqNullSafe(F.lit(name))).select("f.properties", "f.geometry"),
              _code(name) if name else source_crs) for name in declared]
    zones = None
    for found, crs in parts:
        kind, coordinates = F.col("geometry.type"), F.col("geometry.coordinates")
        nested = (F.when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{POSITIONS}>"))
                  .when(kind == "Polygon", F.array(F.from_json(coordinates, POSITIONS))))
        part = standardise_zones(found.select(
            *[F.col("properties")[source].alias(target) for source, target in names.items()],
            F.col("properties")["service_zone"].alias("service_zone"),
            map_vertices(nested, _vertex).alias("geom")), crs, id_type)
        zones = part if zones is None else zones.unionByName(part)
    return zones


def _code(name: str) -> str:
    """EPSG code of a ``crs`` name such as urn:ogc:def:crs:EPSG::2263."""
    return "EPSG:4326" if name.upper().endswith("CRS84") else f"EPSG:{name.rsplit(':', 1)[-1]}"


def _vertex(position: Column) -> Column:
    return F.struct(F.get(position, F.lit(0)).alias("x"), F.get(position, F.lit(1)).alias("y"))


def read_zone_table(spark: SparkSession, path: str) -> DataFrame:
    """Zones stored as Parquet with nested-array geometry."""
    return standardise_zones(spark.read.parquet(path))


def standardise_zones(zones: DataFrame, source_crs: str | None = "EPSG:4326", id_type: str = "smallint") -> DataFrame:
    """Zone columns with their stored types, in longitude / latitude."""
    require_columns(zones, ("location_id", "zone_name", "borough", "geom"))
    if source_crs is None:
        raise ValueError("The source does not declare its coordinate system.")
    geom, projection = F.col("geom").cast(GEOMETRY), projection_of(source_crs)
    if projection is not None:
        def to_degrees(v: Column) -> Column:
            lon, lat = inverse(v["x"], v["y"], projection)
            return F.struct(lon.alias("x"), lat.alias("y"))

        geom = map_vertices(geom, to_degrees)
    service = F.col("service_zone") if "service_zone" in zones.columns else F.lit(None)
    return zones.select(
        F.col("location_id").cast(id_type).alias("location_id"),
        F.col("zone_name").cast("string").alias("zone_name"),
        F.col("borough").cast("string").alias("borough"),
        service.cast("string").alias("service_zone"),
        geom.alias("geom"))


def zone_violations(zones: DataFrame, check_crossings: bool = True) -> DataFrame:
    """Faults that make a zone unusable, one row per (location_id, violation)."""
    def outside(v: Column) -> Column:
        return ~F.coalesce((F.abs(v["x"]) <= 180) & (F.abs(v["y"]) <= 90), F.lit(False))

    def any_ring(condition: Callable[[Column], Column]) -> Column:
        return F.exists(F.flatten("geom"), condition)

    faults = {
        **{f"null {c}": F.col(c).isNull()
           for c in ("location_id", "zone_name", "borough", "geom")},
        "empty geometry": (F.size("geom") == 0) | F.exists("geom", lambda p: F.size(p) == 0),
        "ring with fewer than 4 points": any_ring(lambda r: F.size(r) < 4),
        "ring not closed": any_ring(lambda r: F.element_at(r, 1) != F.element_at(r, -1)),
        "coordinate out of range": any_ring(lambda r: F.exists(r, outside)),
    }
    listed = F.array_compact(F.array(*[F.when(f, name) for name, f in faults.items()]))
    zones = zones.withColumn("_faults", listed)
    repeated = zones.groupBy("location_id").count().where("count > 1")
    result = zones.select("location_id", F.explode("_faults").alias("violation")).unionByName(
        repeated.select("location_id", F.lit("duplicate location_id").alias("violation")))
    if check_crossings:
        # Only zones that are sound otherwise: their edges are finite and not too long.
        crossed = self_crossings(zones.where(F.size("_faults") == 0).drop("_faults"))
        result = result.unionByName(
            crossed.select("location_id", F.lit("boundary crosses itself").alias("violation")))
    return result.distinct()


def self_crossings(zones: DataFrame) -> DataFrame:
    """Zones with two boundary edges crossing each other."""
    return (with_turns(edge_pairs(stored_edges(zones), same_zone=True))
            .where("crossing").select("location_id").distinct())


def validate_zones(zones: DataFrame, check_crossings: bool = True) -> DataFrame:
    """The zones, or ``ValueError`` naming all faults. Ids are smallints, which bounds them."""
    shown = zone_violations(zones, check_crossings).orderBy("location_id", "violation").collect()
    if shown:
        listing = ", ".join(f"{r.location_id}: {r.violation}" for r in shown)
        raise ValueError(f"Invalid zones: {listing}")
    return zones
