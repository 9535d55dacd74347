"""Stored tables and the jobs that load them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.operators.adjacency import zone_adjacency
from zonetide.operators.arcs import simplify_map
from zonetide.operators.cleaning import clean_trips
from zonetide.operators.rollup import zone_hourly_demand
from zonetide.operators.simplify import DEFAULT_TOLERANCE
from zonetide.schemas import REJECT_SCHEMA, ROLLUP_SCHEMA, TRIP_KEY, TRIP_TYPES, ZONE_SCHEMA
from zonetide.sources.trips import read_trips
from zonetide.sources.zones import validate_zones

TRIP_SCHEMA = ", ".join(f"{c} {t}" for c, t in TRIP_TYPES.items()) + ", loaded_at timestamp"
REJECT_TABLE_SCHEMA = f"{REJECT_SCHEMA}, load_date date"
ZONE_TABLE_SCHEMA = f"{ZONE_SCHEMA}, created_at timestamp"


@dataclass(frozen=True)
class LoadReport:
    """Row counts of one load and the pickup dates of its files."""

    valid: int
    rejected: int
    inserted: int
    dates: list[date]


def append_new(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...],
               unique: bool = False) -> DataFrame:
    """Incoming rows whose key does not exist yet, one per key.

    ``unique`` says that the incoming keys do not repeat, which saves a shuffle.
    """
    once = incoming if unique else incoming.dropDuplicates(list(key))
    return once.join(existing.select(*key), list(key), "left_anti").select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Existing rows, replaced by the incoming ones where the key matches.

    Incoming keys must not repeat.
    """
    kept = existing.join(incoming.select(*key), list(key), "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def only_files(files: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function keeping the stored rows that came from the given files."""
    return lambda stored: stored.join(files, "source_file", "left_semi")


def upsert_zones(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace zones by id, keeping ``created_at`` and a service zone already known."""
    known = existing.select("location_id", F.col("created_at").alias("_created"),
                            F.col("service_zone").alias("_service"))
    stamped = incoming.join(known, "location_id", "left").select(
        "location_id", "zone_name", "borough",
        F.coalesce("service_zone", "_service").alias("service_zone"), "geom",
        F.coalesce("_created", F.current_timestamp()).alias("created_at"))
    return upsert(existing, stamped, ("location_id",))


class Warehouse:
    """Parquet tables under one root folder.

    ``core/trips`` is append-only and partitioned by pickup date. ``raw/rejected_trips``
    is partitioned by the date of the first load and ``analytics/zone_hourly_demand`` by month; updates
    rewrite only the touched partitions. Zone tables are small and written whole, each
    time as a new version. Every job can be repeated after a failure: trips already stored
    are skipped by key, and the rollup is recomputed for all dates of the load.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str, schema: str) -> DataFrame:
        """The stored table, or an empty frame before the first load."""
        try:
            return self.spark.read.schema(schema).parquet(self._path(table))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _latest(self, table: str, schema: str) -> DataFrame:
        versions = self._read(table, f"{schema}, version int")
        newest = versions.agg(F.max("version")).scalar()
        return versions.where(F.col("version") == newest).drop("version")

    def _write_version(self, df: DataFrame, table: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self._path(table)}/version={version}")

    def trips(self) -> DataFrame:
        return self._read("core/trips", TRIP_SCHEMA)

    def rejected_trips(self) -> DataFrame:
        return self._read("raw/rejected_trips", REJECT_TABLE_SCHEMA).drop("load_date")

    def zones(self) -> DataFrame:
        return self._latest("core/zones", ZONE_TABLE_SCHEMA)

    def published_zones(self) -> DataFrame:
        """Zones with simplified boundaries, for map results; neighbours keep their common border."""
        return self._latest("analytics/published_zones", ZONE_TABLE_SCHEMA)

    def adjacency(self) -> DataFrame:
        return self._latest("analytics/zone_adjacency",
                            "location_id smallint, neighbour_id smallint")

    def demand(self) -> DataFrame:
        """The hourly rollup, with the month it is partitioned by, which date filters prune."""
        return self._read("analytics/zone_hourly_demand", ROLLUP_SCHEMA)

    def landing_schemas(self) -> DataFrame:
        """Schemas (JSON) of the folders that streams load from."""
        return self._read("raw/landing_schemas", "landing string, schema string")

    def keep_landing_schema(self, landing: str, schema: str) -> None:
        self.spark.createDataFrame([(landing, schema)], "landing string, schema string").coalesce(1).write.mode(
            "append").parquet(self._path("raw/landing_schemas"))

    def load_zones(self, incoming: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> None:
        """Validate and upsert zones; rebuild what depends on them.

        These are adjacency, published boundaries and, if they changed, the zone names in
        the rollup.
        """
        validate_zones(incoming)
        stored = self._read("core/zones", f"{ZONE_TABLE_SCHEMA}, version int")
        version = 1 + (stored.agg(F.max("version")).first()[0] or 0)
        self._write_version(upsert_zones(self.zones(), incoming), "core/zones", version)
        zones = self.zones()
        self._write_version(zone_adjacency(zones), "analytics/zone_adjacency", version)
        self._write_version(simplify_map(zones, tolerance), "analytics/published_zones", version)
        self._rename_in_rollup(zones.select("location_id", "zone_name", "borough"))

    def _rename_in_rollup(self, names: DataFrame) -> None:
        table = "analytics/zone_hourly_demand"
        rollup = self._read(table, ROLLUP_SCHEMA)
        renamed = rollup.select(*names.columns).distinct().join(
            names, names.columns, "left_anti")
        if not renamed.isEmpty():
            current = rollup.drop("zone_name", "borough").join(names, "location_id")
            self._replace(current.select(*rollup.columns), table, "pickup_month")

    def load_trips(self, path: str | list[str]) -> LoadReport:
        """Load trip files. Their full paths and row numbers identify the rows."""
        return self.load_raw(read_trips(self.spark, path))

    def load_raw(self, raw: DataFrame) -> LoadReport:
        """Clean raw trips, append the new ones, record rejects, refresh the rollup.

        ``raw`` carries source_file and source_row_number, unique together.

        The source is read once for the valid and once for the rejected rows, which costs
        less than writing it out in between. Only files seen before are compared with the
        stored trips; a first load therefore shuffles no keys.
        """
        split = clean_trips(raw, self.zones())
        loaded_at = F.lit(datetime.now(timezone.utc))
        from_files = only_files(raw.select("source_file").distinct())

        valid = split.valid
        known = from_files(self.trips())
        if not known.isEmpty():
            valid = append_new(known, valid, TRIP_KEY, unique=True)
        (valid.withColumn("loaded_at", loaded_at)
         # One run of files per date, hot dates split, small ones merged.
         .hint("rebalance", "pickup_date")
         .write.mode("append").partitionBy("pickup_date").parquet(self._path("core/trips")))

        self._store_rejects(split.rejected.withColumn("rejected_at", loaded_at), from_files, loaded_at)

        # Counted in the tables: what is reported is what is stored.
        refused = from_files(self.rejected_trips()).where(
            F.col("rejected_at") == loaded_at).count()
        loaded = from_files(self.trips())
        inserted = loaded.where(F.col("loaded_at") == loaded_at).count()
        dates = sorted(r.pickup_date for r in loaded.select("pickup_date").distinct().collect())
        self.refresh_rollup(dates)
        return LoadReport(valid=raw.count() - refused, rejected=refused, inserted=inserted,
                          dates=dates)

    def _store_rejects(self, rejected: DataFrame, from_files: Callable[[DataFrame], DataFrame],
                       loaded_at: Column) -> None:
        """Upsert by key. A row rejected before stays in the partition of its first load."""
        table, today = "raw/rejected_trips", F.to_date(loaded_at)
        stored = self._read(table, REJECT_TABLE_SCHEMA)
        earlier = from_files(stored)
        if earlier.isEmpty():
            # Dealt out by row: all of them have one date, whose rows Spark splits only by the tasks they come from.
            (rejected.withColumn("load_date", today).hint("rebalance", *TRIP_KEY)
             .write.mode("append").partitionBy("load_date").parquet(self._path(table)))
            return
        # Listed, not joined: a date is one key for all rows loaded on it. Rows keep the date of their first load or get today's.
        dates = [r.load_date for r in earlier.select("load_date").distinct().collect()]
        rest = stored.where(F.col("load_date").isin(dates) | (F.col("load_date") == today))
        values = F.struct(*[c for c in rejected.columns if c not in TRIP_KEY])
        # One join keeps, replaces and adds rows.
        met = (rest.select(*TRIP_KEY, values.alias("_known"), F.col("load_date").alias("_first"))
               .join(rejected.select(*TRIP_KEY, values.alias("_new")), list(TRIP_KEY), "full"))
        rows = met.select(*TRIP_KEY, F.coalesce("_new", "_known").alias("_values"), F.coalesce("_first", today).alias("load_date"))
        self._replace(rows.select(*TRIP_KEY, "_values.*", "load_date"), table, "load_date")

    def refresh_rollup(self, dates: list[date] | None = None) -> None:
        """Recompute the rollup of the given pickup dates, or of all dates."""
        trips, table = self.trips(), "analytics/zone_hourly_demand"
        month = F.date_format("pickup_date", "yyyy-MM").alias("pickup_month")
        if dates is None:
            fresh = zone_hourly_demand(trips, self.zones())
            self._replace(fresh.select("*", month), table, "pickup_month", whole=True)
        elif dates:
            touched = F.col("pickup_date").isin(dates)
            fresh = zone_hourly_demand(trips.where(touched), self.zones()).select("*", month)
            months = sorted({f"{d:%Y-%m}" for d in dates})
            rest = self._read(table, ROLLUP_SCHEMA).where(
                F.col("pickup_month").isin(months) & ~touched)
            self._replace(rest.unionByName(fresh), table, "pickup_month")

    def _replace(self, rows: DataFrame, table: str, by: str, whole: bool = False) -> None:
        """Overwrite the partitions present in ``rows`` (or the whole table).

        Spark writes the new files aside and swaps partitions when the job commits, so
        ``rows`` may read the partitions it replaces.
        """
        (rows.hint("rebalance", by).write.mode("overwrite")
         .option("partitionOverwriteMode", "static" if whole else "dynamic")
         .partitionBy(by).parquet(self._path(table)))
