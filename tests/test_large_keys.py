"""Queries on parcels far down the grid, as larger tables have them."""

import duckdb
import pytest

import __spark_entry__ as entry
from test_queries import table

# Rows that reach 64, 85 and 90 degrees, ids beyond a smallint, and far off the globe.
KEYS = [*range(32_700, 32_830), *range(43_400, 43_900), *range(46_000, 46_200), *range(899_900, 900_000)]


@pytest.mark.parametrize("name", ["zone_violations", "zones_from_geojson"])
def test_parcels_of_large_keys(spark, tmp_path, name):
    spark.createDataFrame([(k, k % 25, 1.0) for k in KEYS], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(
        str(tmp_path / "customer.parquet"))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    found, expected = entry.queries()[name](spark, str(tmp_path)), connection.sql(entry.oracle_sql()[name])
    assert table(found.columns, found.collect()) == table(expected.columns, expected.fetchall())
