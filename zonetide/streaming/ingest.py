"""Incremental trip loading from a landing folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from zonetide.plans.warehouse import Warehouse
from zonetide.sources.trips import require_columns


def landing_schema(warehouse: Warehouse, landing: str) -> StructType:
    """The schema of the landing folder's files. It is read off the files at the first run and kept in the warehouse, so
    later runs don't list and open them for it. Columns that only later files have are not read."""
    kept = warehouse.landing_schemas().where(F.col("landing") == landing).select("schema").first()
    if kept:
        return StructType.fromJson(json.loads(kept["schema"]))
    found = require_columns(warehouse.spark.read.parquet(landing)).schema
    warehouse.keep_landing_schema(landing, found.json())
    return found


def load_landing_folder(warehouse: Warehouse, landing: str, checkpoint: str,
                        files_per_batch: int = 1000) -> StreamingQuery:
    """Load all files that are new since the last run, then stop.

    Spark's checkpoint remembers which files were taken. Every batch runs the same load as
    a batch job; since that skips stored trips by key, a batch repeated after a failure
    inserts nothing twice.
    """
    spark = warehouse.spark
    schema = landing_schema(warehouse, landing)
    files = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
        .select("*", F.col("_metadata.file_path").alias("source_file"),
                (F.col("_metadata.row_index") + 1).alias("source_row_number"))
    )

    def load(batch: DataFrame, _batch_id: int) -> None:
        warehouse.load_raw(batch)

    return (files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
