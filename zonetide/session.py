"""Spark session settings the library relies on."""

from __future__ import annotations

import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# UTC and ANSI arithmetic are part of the semantics: dates derive from explicit zone
# conversions, and overflow must raise rather than turn into null.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}
SPEED = {
    "spark.sql.adaptive.enabled": "true",
    # The JVM leaves larger methods uncompiled. Above this size Spark splits a stage's
    # expressions into small methods instead of fusing them into one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# Settings fixed when the session starts. Recording the Python call site of every column,
# only used in error messages, takes longer than the rest of building a query.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to an existing session."""
    for key, value in (SEMANTICS | SPEED).items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "zonetide", master: str | None = None,
                  **extra: str) -> SparkSession:
    """Create (or fetch) a session with the settings applied.

    Everything else, such as parallelism and memory, is left to the cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in (SEMANTICS | SPEED | AT_START).items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, for functions that run in Python there."""
    context = spark.sparkContext
    if not getattr(context, "_has_zonetide", False):
        package = Path(__file__).resolve().parent
        if package.parent.is_dir():  # else it came in an archive itself
            folder = tempfile.mkdtemp(prefix="zonetide-package-")
            path = list(sys.path)
            context.addPyFile(shutil.make_archive(f"{folder}/zonetide", "zip",
                                                  package.parent, package.name))
            sys.path[:] = path  # the driver goes on with the files it has
        context._has_zonetide = True
