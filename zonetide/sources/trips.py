"""Trip files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.schemas import REQUIRED_COLUMNS


def require_columns(df: DataFrame, columns: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Raise ``ValueError`` naming the missing columns, sorted."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"The source lacks required columns: {missing}")
    return df


def read_trips(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet trips with their identity: full path and 1-based row number in the file."""
    paths = [path] if isinstance(path, str) else path
    return require_columns(spark.read.parquet(*paths)).select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        (F.col("_metadata.row_index") + 1).alias("source_row_number"),
    )
