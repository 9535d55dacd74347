from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from zonetide import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "zonetide-tests", master="local[8]",
        **{"spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false",
           "spark__driver__memory": "6g", "spark__ui__showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf():
    return SF


DEMAND_SCHEMA = (
    "pickup_date date, pickup_hour smallint, location_id smallint, zone_name string, "
    "borough string, trip_count bigint, avg_trip_distance decimal(10,3), "
    "avg_duration_seconds decimal(12,2), avg_total_amount decimal(10,2), "
    "total_amount decimal(20,2)")


@pytest.fixture
def make_demand(spark):
    """Rollup rows from (date, hour, zone, trips) with 2 money units and 1 mile per trip."""
    def build(rows, boroughs=None):
        return spark.createDataFrame([
            (d, h, z, f"Z{z}", (boroughs or {}).get(z, "B"), n, Decimal("1.000"),
             Decimal("60.00"), Decimal("2.00"), Decimal(2 * n))
            for d, h, z, n in rows], DEMAND_SCHEMA)
    return build


def ring(*points):
    """A closed ring of (x, y) vertices."""
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def box(x, y, width=1.0, height=1.0):
    return ring((x, y), (x + width, y), (x + width, y + height), (x, y + height))


@pytest.fixture
def make_zones(spark):
    """Zones from {id: multipolygon}, a multipolygon being a list of lists of rings."""
    from zonetide.schemas import ZONE_SCHEMA

    def build(shapes, boroughs=None):
        return spark.createDataFrame([
            (i, f"Z{i}", (boroughs or {}).get(i, "B"), None, geom)
            for i, geom in shapes.items()], ZONE_SCHEMA)
    return build


DAY = date(2024, 1, 1)
