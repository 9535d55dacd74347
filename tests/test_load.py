from pyspark.sql import functions as F

import pytest

from zonetide.operators.rollup import zone_hourly_demand
from zonetide.plans.warehouse import REJECT_TABLE_SCHEMA, Warehouse, append_new, upsert
from zonetide.schemas import ROLLUP_COLUMNS
from zonetide.sources import fixtures as fx
from zonetide.streaming.ingest import load_landing_folder


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two trip files and a warehouse with zones."""
    root = tmp_path_factory.mktemp("warehouse")
    raw = fx.dirty_trips(spark, "/root/testdata/sf0.001").drop("source_file", "source_row_number")
    early = F.col("DOLocationID") <= 12
    raw.where(early).coalesce(1).write.parquet(str(root / "first"))
    raw.where(~F.coalesce(early, F.lit(False))).coalesce(1).write.parquet(str(root / "second"))
    store = Warehouse(spark, str(root / "store"))
    store.load_zones(fx.zones(spark, "/root/testdata/sf0.001"))
    return root, store


def test_load_is_idempotent_and_rollup_follows(folder):
    root, store = folder
    first = store.load_trips(str(root / "first"))
    again = store.load_trips(str(root / "first"))
    second = store.load_trips([str(root / "first"), str(root / "second")])
    assert first.inserted == first.valid > 0 and first.rejected > 0
    assert (again.inserted, again.valid, again.rejected) == (0, first.valid, first.rejected)
    assert second.inserted == second.valid - first.valid
    assert store.trips().count() == second.valid
    assert store.rejected_trips().count() == second.rejected
    assert second.valid + second.rejected == 1000
    rebuilt = zone_hourly_demand(store.trips(), store.zones()).select(*ROLLUP_COLUMNS)
    assert sorted(store.demand().select(*ROLLUP_COLUMNS).collect()) == sorted(rebuilt.collect())


def test_full_refresh_equals_partial(folder):
    root, store = folder
    store.load_trips(str(root / "second"))
    before = sorted(store.demand().collect())
    store.refresh_rollup()
    assert sorted(store.demand().collect()) == before


def test_zone_reload_keeps_creation_time_and_service_zone(spark, folder):
    _, store = folder
    created = {r.location_id: r.created_at for r in store.zones().collect()}
    counted = store.demand().agg(F.sum("trip_count"), F.count("*")).first()
    renamed = fx.zones(spark, "/root/testdata/sf0.001").withColumn("zone_name", F.lit("new"))
    store.load_zones(renamed.withColumn("service_zone", F.lit("Yellow Zone")))
    store.load_zones(renamed)
    rows = store.zones().collect()
    assert len(rows) == 25
    assert {r.location_id: r.created_at for r in rows} == created
    assert {(r.zone_name, r.service_zone) for r in rows} == {("new", "Yellow Zone")}
    assert {r.zone_name for r in store.demand().select("zone_name").distinct().collect()} == {
        "new"}
    assert store.demand().agg(F.sum("trip_count"), F.count("*")).first() == counted
    assert store.adjacency().count() == 144
    assert store.published_zones().count() == 25


def test_stream_loads_each_file_once(spark, folder, tmp_path):
    root, store = folder
    fresh = Warehouse(spark, str(tmp_path / "store"))
    store.zones().drop("created_at").transform(lambda z: fresh.load_zones(z) or z)
    for _ in range(2):
        query = load_landing_folder(fresh, str(root / "first"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
    raw_rows = spark.read.parquet(str(root / "first")).count()
    assert fresh.trips().count() + fresh.rejected_trips().count() == raw_rows
    assert fresh.demand().agg(F.sum("trip_count")).first()[0] == fresh.trips().count()


def test_files_of_equal_names_in_two_folders_lose_nothing(spark, folder, tmp_path):
    root, store = folder
    source = next((root / "first").glob("part-*.parquet"))
    fresh = Warehouse(spark, str(tmp_path / "store"))
    fresh.load_zones(store.zones().drop("created_at"))
    reports = []
    for copy in ("a", "b"):
        (tmp_path / copy).mkdir()
        (tmp_path / copy / "same.parquet").write_bytes(source.read_bytes())
        reports.append(fresh.load_trips(str(tmp_path / copy)))
    assert reports[0].inserted == reports[1].inserted == reports[1].valid > 0
    assert fresh.trips().count() == 2 * reports[0].valid
    assert fresh.rejected_trips().count() == 2 * reports[0].rejected > 0


def test_rejects_keep_the_date_of_their_first_load_and_meet_by_row(spark, folder, tmp_path, monkeypatch):
    root, store = folder
    fresh = Warehouse(spark, str(tmp_path / "store"))
    fresh.load_zones(store.zones().drop("created_at"))
    first = fresh.load_trips(str(root / "first"))
    rejects = tmp_path / "store" / "raw" / "rejected_trips"
    next(rejects.glob("load_date=*")).rename(rejects / "load_date=2020-01-01")
    replaced, replace = [], fresh._replace
    monkeypatch.setattr(fresh, "_replace", lambda rows, table, *rest: replaced.append((table, rows)) or replace(rows, table, *rest))
    both = fresh.load_trips([str(root / "first"), str(root / "second")])
    again = fresh.load_trips(str(root / "second"))
    kept = fresh._read("raw/rejected_trips", REJECT_TABLE_SCHEMA)
    assert kept.where("load_date = DATE'2020-01-01'").count() == first.rejected
    assert kept.count() == kept.select("source_file", "source_row_number").distinct().count() == both.rejected
    assert again.rejected == both.rejected - first.rejected > 0
    # A date is one key for all rows loaded on it: nothing may be joined by dates.
    plans = [rows._jdf.queryExecution().optimizedPlan().toString() for table, rows in replaced if table == "raw/rejected_trips"]
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert len(plans) == 2 and joins and not any("load_date" in line for line in joins)


def test_append_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, v string")
    assert [tuple(r) for r in append_new(old, new, ("k",)).collect()] == [(3, "y")]
    merged = upsert(old, new.distinct(), ("k",))
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a"), (2, "x"), (3, "y")]


def test_an_empty_warehouse_answers(spark, tmp_path):
    empty = Warehouse(spark, str(tmp_path / "empty"))
    assert empty.demand().count() == empty.trips().count() == empty.zones().count() == 0


def test_events_are_dealt_out_before_they_are_made_trips(spark, sf):
    plain, dealt = fx.dirty_trips(spark, sf), fx.dirty_trips(spark, sf, deal_out=True)
    lines = dealt._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealing, reading = (next(i for i, line in enumerate(lines) if name in line)
                        for name in ("RepartitionByExpression", "get_json_object"))
    assert reading < dealing  # above it in the plan
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_rejects_of_a_date_are_dealt_out_by_row(spark, folder, tmp_path):
    root, store = folder
    fresh = Warehouse(spark, str(tmp_path / "store"))
    fresh.load_zones(store.zones().drop("created_at"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        report = fresh.load_trips(str(root / "first"))  # one file, read by one task
    finally:
        spark.conf.unset(merging)
    assert len(list((tmp_path / "store" / "raw" / "rejected_trips").glob("load_date=*/part-*"))) > 1
    assert fresh.rejected_trips().count() == report.rejected > 1


def test_a_reload_joins_rejects_once(spark, folder, tmp_path, monkeypatch):
    root, store = folder
    fresh = Warehouse(spark, str(tmp_path / "store"))
    fresh.load_zones(store.zones().drop("created_at"))
    fresh.load_trips(str(root / "first"))
    before = fresh.rejected_trips()
    kept = sorted(before.drop("rejected_at").collect())
    replaced, replace = [], fresh._replace
    monkeypatch.setattr(fresh, "_replace", lambda rows, table, *rest: replaced.append((table, rows)) or replace(rows, table, *rest))
    fresh.load_trips(str(root / "second"))  # none of its rejects is stored
    fresh.load_trips(str(root / "first"))
    assert [r for r in sorted(fresh.rejected_trips().drop("rejected_at").collect()) if r in kept] == kept
    stamps = fresh.rejected_trips().groupBy("source_file").agg(F.count_distinct("rejected_at").alias("n"), F.max("rejected_at").alias("at"))
    assert [r.n for r in stamps.collect()] == [1, 1]
    newest = stamps.orderBy(F.desc("at")).first().source_file
    assert "/first/" in newest
    plans = [rows._jdf.queryExecution().optimizedPlan().toString() for table, rows in replaced if table == "raw/rejected_trips"]
    assert len(plans) == 1
    lines = plans[0].splitlines()
    # The trips are read once, and no union stands before the write.
    assert sum("tpep_pickup_datetime" in x and "Relation [" in x for x in lines) == 1
    assert sum("Join FullOuter" in x for x in lines) == 1 and not any("Union" in x for x in lines)
