"""Trips and zones derived from the shared test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.schemas import GEOMETRY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ring(*corners: tuple[Column, Column]) -> Column:
    vertices = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
                for x, y in (*corners, corners[0])]
    return F.array(*vertices)


def square(gx: Column, gy: Column, side: float = 1.0) -> Column:
    """Square number (gx, gy) of a grid, as a multipolygon."""
    x, y = gx * side, gy * side
    ring = _ring((x, y), (x + side, y), (x + side, y + side), (x, y + side))
    return F.array(F.array(ring)).cast(GEOMETRY)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 zones on a 5 x 5 grid; one borough per vertical strip."""
    key = F.col("n_nationkey")
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            (key + 1).cast("smallint").alias("location_id"),
            F.col("n_name").alias("zone_name"),
            F.col("r_name").alias("borough"),
            F.lit(None).cast("string").alias("service_zone"),
            square(key % 5, F.floor(key / 5)).alias("geom"),
        )
    )


PARCEL_COLUMNS = 128
PARCEL_SIDE = 0.25
SHAPE_TASKS = 48


def _parcel_grid() -> tuple[Column, Column]:
    key = F.col("c_custkey")
    return key % PARCEL_COLUMNS, F.floor(key / PARCEL_COLUMNS)


def _parcels(spark: SparkSession, sf_dir: str, geom: Column) -> DataFrame:
    key = F.col("c_custkey")
    # Dealt out first: a task reads many customers, and their shapes take much longer to make.
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return customers.repartition(SHAPE_TASKS, "c_custkey").select(
        key.cast("int").alias("location_id"),
        F.concat(F.lit("PARCEL_"), key).alias("zone_name"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("borough"),
        F.lit(None).cast("string").alias("service_zone"),
        geom.alias("geom"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square per customer on a grid 128 wide: a zone map that grows with the data."""
    return _parcels(spark, sf_dir, square(*_parcel_grid(), PARCEL_SIDE))


def wavy_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels whose sides are bent at the middle by -10 .. 10 steps of 0.000018."""
    gx, gy = _parcel_grid()
    x, y, side = gx * PARCEL_SIDE, gy * PARCEL_SIDE, PARCEL_SIDE

    def bend(number: int) -> Column:
        return ((F.col("c_custkey") * 7 + number * 13) % 21 - 10) * 0.000018

    ring = _ring((x, y), (x + side / 2, y + bend(0)), (x + side, y),
                 (x + side + bend(1), y + side / 2), (x + side, y + side),
                 (x + side / 2, y + side + bend(2)), (x, y + side),
                 (x + bend(3), y + side / 2))
    return _parcels(spark, sf_dir, F.array(F.array(ring)).cast(GEOMETRY))


BORDER_STEPS = 32


def _border(gx: Column, gy: Column, upright: bool) -> Column:
    """Vertices, without the last one, of the side that starts at grid point (gx, gy): bent to its middle by -10 .. 10
    steps of 0.000018, with a ripple of 0.000002. Upright sides on the left and right edge of the grid are straight."""
    straight = (gx % PARCEL_COLUMNS == 0) if upright else F.lit(False)
    number = gx * 3 + gy * 13 if upright else gx * 5 + gy * 11
    bend = F.when(straight, 0).otherwise((number * 7 + 3) % 21 - 10) * 0.000018
    half = BORDER_STEPS // 2

    def vertex(k: Column) -> Column:
        ripple = F.when(straight | (k % half == 0), 0).otherwise((k * 7 + gx) % 5 - 2) * 0.000001
        off = bend * (1 - F.abs(k - half) / half) + ripple
        step = k / BORDER_STEPS
        x, y = (gx, gy + step) if upright else (gx + step, gy)
        x, y = x * PARCEL_SIDE, y * PARCEL_SIDE
        x, y = (x + off, y) if upright else (x, y + off)
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(BORDER_STEPS - 1)), vertex)


def bordered_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with 128 vertices each; neighbours have the vertices of their common side in common."""
    gx, gy = _parcel_grid()

    def backwards(side: Column, last: Column) -> Column:
        """The side from its end to its start, without the start."""
        return F.concat(F.slice(last, 1, 1), F.reverse(F.slice(side, 2, BORDER_STEPS - 1)))

    low, right = _border(gx, gy, False), _border(gx + 1, gy, True)
    high, left = _border(gx, gy + 1, False), _border(gx, gy, True)
    far, over = _border(gx + 1, gy + 1, False), high
    ring = F.concat(low, right, backwards(high, far), backwards(left, over), F.slice(low, 1, 1))
    return _parcels(spark, sf_dir, F.array(F.array(ring)).cast(GEOMETRY))


def mixed_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of four shapes by id % 4: plain; with 64 edges of 2^-20 on the lower side; with a hole, which
    island -id fills; in two parts, left and right. Zone -1 is a bar below all others."""
    gx, gy = _parcel_grid()
    x, y, side = gx * PARCEL_SIDE, gy * PARCEL_SIDE, PARCEL_SIDE

    def box(left: float, low: float, right: float, high: float) -> Column:
        return _ring((x + left, y + low), (x + right, y + low), (x + right, y + high), (x + left, y + high))

    whole, hole = box(0, 0, side, side), box(side / 4, side / 4, side / 2, side / 2)
    corners = box(0, 0, side, side)
    steps = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.struct(
        (x + side / 2 + i * 2.0 ** -20).alias("x"), y.cast("double").alias("y")))
    fine = F.concat(F.slice(corners, 1, 1), steps, F.slice(corners, 2, 4))
    parts = [box(0, 0, side / 4, side), box(3 * side / 4, 0, side, side)]
    kind = F.col("c_custkey") % 4
    geom = (F.when(kind == 0, F.array(F.array(whole))).when(kind == 1, F.array(F.array(fine)))
            .when(kind == 2, F.array(F.array(whole, hole)))
            .otherwise(F.array(*[F.array(p) for p in parts])))
    mixed = _parcels(spark, sf_dir, geom.cast(GEOMETRY))
    islands = (_parcels(spark, sf_dir, F.array(F.array(hole)).cast(GEOMETRY))
               .where("location_id % 4 = 2").withColumn("location_id", -F.col("location_id")))
    width, below = F.lit(PARCEL_COLUMNS * PARCEL_SIDE), F.lit(-1.0)
    ground = _ring((F.lit(0.0), below), (width, below), (width, F.lit(0.0)), (F.lit(0.0), F.lit(0.0)))
    bar = spark.range(1).select(
        F.lit(-1).alias("location_id"), F.lit("BAR").alias("zone_name"), F.lit("NONE").alias("borough"),
        F.lit(None).cast("string").alias("service_zone"),
        F.array(F.array(ground)).cast(GEOMETRY).alias("geom"))
    return mixed.unionByName(islands).unionByName(bar)


def projected_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of 1000 feet in New York Long Island state plane coordinates."""
    gx, gy = _parcel_grid()
    return _parcels(spark, sf_dir, square(gx + 900, gy + 100, 1000.0))


def metric_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of 1000 metres from (436 000, 4 500 000) on."""
    gx, gy = _parcel_grid()
    return _parcels(spark, sf_dir, square(gx + 436, gy + 4500, 1000.0))


GLOBE_ROWS = 256  # rows of parcels from the equator to 64 degrees


def faulty_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with faults planted by id: kind = id % 11. Rows beyond 64 degrees start at the equator again, so that
    however many there are only those of kind 2 lie off the globe."""
    gx, gy = _parcel_grid()
    gy = gy % GLOBE_ROWS
    x, y, side = gx * PARCEL_SIDE, gy * PARCEL_SIDE, PARCEL_SIDE
    kind = F.col("c_custkey") % 11
    bow = F.array(F.array(_ring((x, y), (x + side, y + side), (x + side, y), (x, y + side))))
    whole = square(gx, gy, PARCEL_SIDE)
    opened = F.transform(whole, lambda p: F.transform(p, lambda r: F.slice(r, 1, 4)))
    geom = (F.when(kind == 0, opened).when(kind == 1, bow.cast(GEOMETRY))
            .when(kind == 2, square(gx + 1000, gy, PARCEL_SIDE)).otherwise(whole))
    parcels_ = _parcels(spark, sf_dir, geom).withColumn(
        "zone_name", F.when(F.col("location_id") % 11 != 3, F.col("zone_name")))
    return parcels_.unionByName(parcels_.where(F.col("location_id") % 11 == 4))


def raw_trips(spark: SparkSession, sf_dir: str, deal_out: bool = False) -> DataFrame:
    """Events as trips in the source layout; ``ts`` is New York wall-clock time. Dealt out, they can be written to several
    files even if one task reads all events."""
    k = F.get_json_object("props", "$.k").cast("int")
    money = F.lit(0.0)
    events = table(spark, sf_dir, "events")
    return (
        (events.repartition("event_id") if deal_out else events)
        .withColumn("k", k)
        .select(
            (1 + F.col("k") % 2).alias("VendorID"),
            F.col("ts").alias("tpep_pickup_datetime"),
            F.expr("ts + make_dt_interval(0, 0, 0, 60 + 30 * k)").alias("tpep_dropoff_datetime"),
            (F.col("k") % 5).alias("passenger_count"),
            (F.col("k") / 10).alias("trip_distance"),
            F.lit(1).alias("RatecodeID"),
            F.when(F.col("k") % 2 == 0, "Y").otherwise("N").alias("store_and_fwd_flag"),
            (F.col("user_id") % 25 + 1).alias("PULocationID"),
            (F.col("k") % 25 + 1).alias("DOLocationID"),
            (1 + F.col("k") % 4).alias("payment_type"),
            F.col("value").alias("fare_amount"),
            *[money.alias(c) for c in ("extra", "mta_tax", "tip_amount", "tolls_amount",
                                       "improvement_surcharge")],
            F.col("value").alias("total_amount"),
            F.lit("events").alias("source_file"),
            (F.col("event_id") + 1).alias("source_row_number"),
        )
    )


def dirty_trips(spark: SparkSession, sf_dir: str, deal_out: bool = False) -> DataFrame:
    """The same trips with faults planted by row number (FIXTURES.md 2.4)."""
    kind = (F.col("source_row_number") - 1) % 20
    raw = raw_trips(spark, sf_dir, deal_out)
    faults = {
        "tpep_pickup_datetime": [((0,), F.lit(None))],
        "tpep_dropoff_datetime": [
            ((1,), F.col("tpep_pickup_datetime") - F.expr("INTERVAL 1 HOUR"))],
        "trip_distance": [((2, 8), -1 - F.col("trip_distance"))],
        "passenger_count": [((3,), F.lit(-1))],
        "PULocationID": [((4, 8), F.lit(99))],
        "DOLocationID": [((5,), F.lit(None))],
        "store_and_fwd_flag": [((6,), F.lit("x ")), ((7,), F.lit(" y"))],
    }
    columns = []
    for name in raw.columns:
        value = F.col(name)
        for kinds, fault in faults.get(name, []):
            value = F.when(kind.isin(*kinds), fault).otherwise(value)
        columns.append(value.alias(name))
    return raw.select(*columns)


def messy_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trips as text and doubles, with an Airport_fee. By (row number - 1) % 20: 9 half
    a passenger, 10 an infinite total, 11 an unreadable distance, 12 an unreadable pickup, 13 zone 1.5."""
    kind = (F.col("source_row_number") - 1) % 20
    passengers, total = F.col("passenger_count"), F.col("total_amount")
    return raw_trips(spark, sf_dir).withColumns({
        "passenger_count": F.when(kind == 9, passengers + 0.5).otherwise(passengers.cast("double")),
        "total_amount": F.when(kind == 10, F.lit(float("inf"))).otherwise(total),
        "trip_distance": F.when(kind == 11, "far").otherwise(F.col("trip_distance").cast("string")),
        "tpep_pickup_datetime": F.when(kind == 12, "soon").otherwise(
            F.col("tpep_pickup_datetime").cast("string")),
        "PULocationID": F.when(kind == 13, "1.5").otherwise(F.col("PULocationID").cast("string")),
        "Airport_fee": F.lit(1.75)})


def lineitem_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cleaned trips over seven years (rollup and demand queries only)."""
    pickup = F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int), 0, 0)")
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("pickup", pickup)
        .select(
            F.to_timestamp("pickup").alias("pickup_datetime"),
            (F.col("s_nationkey") + 1).cast("smallint").alias("pickup_location_id"),
            (F.col("l_partkey") % 25 + 1).cast("smallint").alias("dropoff_location_id"),
            F.col("l_quantity").cast("decimal(10,3)").alias("trip_distance"),
            (F.col("l_linenumber") * 60).cast("int").alias("trip_duration_seconds"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("total_amount"),
            F.to_date("pickup").alias("pickup_date"),
            F.hour("pickup").cast("smallint").alias("pickup_hour"),
        )
    )
