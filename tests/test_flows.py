"""Flows, fitted matrices and accessibility against plain Python."""

import heapq
import random
from datetime import date
from decimal import Decimal

import numpy as np
import pytest

from zonetide.filters import Filters
from zonetide.operators import accessibility as reach
from zonetide.operators.accessibility import accessibility, link_times, shortest_times
from zonetide.operators.flows import balanced, flow_balance, od_matrix, od_rollup

DAY = date(2024, 1, 1)
TRIPS = ("pickup_date date, pickup_hour smallint, pickup_location_id smallint, dropoff_location_id smallint, "
         "trip_duration_seconds int, total_amount decimal(10,2)")


@pytest.fixture
def zones(make_zones):
    return make_zones({i: [] for i in range(1, 5)}, {1: "A", 2: "A", 3: "B", 4: "B"})


@pytest.fixture
def flows(spark, zones):
    trips = [(DAY, 8, a, b, 60 * a, Decimal(b)) for a, b, n in
             ((1, 2, 3), (1, 1, 2), (2, 1, 1), (3, 1, 4), (3, 9, 5), (9, 1, 5)) for _ in range(n)]
    trips += [(DAY, 9, 1, 2, None, None), (DAY, 9, 1, None, 5, Decimal(1))]
    return od_rollup(spark.createDataFrame(trips, TRIPS), zones)


def test_matrix(flows):
    rows = {(r.origin_id, r.destination_id): r for r in od_matrix(flows).collect()}
    assert {p: r.trip_count for p, r in rows.items()} == {(1, 2): 4, (1, 1): 2, (2, 1): 1, (3, 1): 4}
    assert rows[1, 2].origin_share == 0.666667 and rows[3, 1].destination_share == 0.571429
    assert rows[1, 2].avg_duration_seconds == 45.0 and rows[3, 1].avg_total_amount == 1.0
    assert {(r.origin_id, r.destination_id) for r in od_matrix(flows, Filters(borough="B")).collect()} == {(3, 1)}
    assert od_matrix(flows, Filters(hour=23)).collect() == []


def test_balance(flows, zones):
    rows = {r.location_id: tuple(r)[3:] for r in flow_balance(flows, zones).collect()}
    assert rows == {1: (4, 5, 2, 1, 1, 2), 2: (1, 4, 0, 3, 1, 1), 3: (4, 0, 0, -4, 1, 0), 4: (0, 0, 0, 0, 0, 0)}
    assert {r.location_id for r in flow_balance(flows, zones, Filters(borough="B")).collect()} == {3, 4}


def matrix(spark, cells):
    return spark.createDataFrame([(i, j, n) for (i, j), n in cells.items()],
                                 "origin_id int, destination_id int, trip_count long")


def totals(spark, key, values):
    return spark.createDataFrame(list(values.items()), f"{key} int, total long")


def test_fitting(spark):
    random.seed(2)
    cells = {(i, j): random.randint(1, 30) for i in range(6) for j in range(5)}
    rows, columns = {i: 40 + 5 * i for i in range(6)}, dict(zip(range(5), (100, 80, 60, 50, 25), strict=True))
    found = balanced(matrix(spark, cells), totals(spark, "origin_id", rows), totals(spark, "destination_id", columns)).collect()
    fitted = {(r.origin_id, r.destination_id): r.fitted for r in found}
    for i, total in rows.items():
        assert sum(fitted[i, j] for j in columns) == pytest.approx(total, rel=1e-8)
    for j, total in columns.items():
        assert sum(fitted[i, j] for i in rows) == pytest.approx(total, rel=1e-6)
    # Cross ratios are the seed's.
    for i in range(5):
        for j in range(4):
            ratio = fitted[i, j] * fitted[i + 1, j + 1] / (fitted[i, j + 1] * fitted[i + 1, j])
            assert ratio == pytest.approx(cells[i, j] * cells[i + 1, j + 1] / (cells[i, j + 1] * cells[i + 1, j]), rel=1e-8)
    assert found[0].residual <= 1e-9


def test_totals_that_cannot_be_met_leave_a_residual(spark):
    found = balanced(matrix(spark, {(1, 1): 5, (2, 2): 5}), totals(spark, "origin_id", {1: 10, 2: 1}),
                     totals(spark, "destination_id", {1: 1, 2: 10}), most_rounds=8).collect()
    assert found[0].residual > 0.5
    found = balanced(matrix(spark, {(1, 1): 5, (2, 1): 5}), totals(spark, "origin_id", {1: 3}),
                     totals(spark, "destination_id", {1: 3})).collect()
    assert {r.origin_id: r.fitted for r in found} == {1: 3.0, 2: 0.0}
    assert balanced(matrix(spark, {(1, 1): 5}).limit(0), totals(spark, "origin_id", {1: 3}),
                    totals(spark, "destination_id", {1: 3})).collect() == []


def dijkstra(links, start, limit):
    best, queue = {}, [(0, start)]
    while queue:
        time, place = heapq.heappop(queue)
        if place not in best:
            best[place] = time
            for a, b, seconds in links:
                if a == place and b not in best and time + seconds <= limit:
                    heapq.heappush(queue, (time + seconds, b))
    return best


def test_shortest_times(spark):
    random.seed(6)
    links = [(random.randint(1, 40), random.randint(1, 40), random.randint(1, 90)) for _ in range(150)]
    links += [(1, j, 70) for j in range(2, 40)]  # a hub
    places = spark.createDataFrame([(i,) for i in range(1, 41)], "location_id int")
    given = spark.createDataFrame([*links, (1, 99, 1), (98, 1, 1), (2, 3, -5), (3, 4, None)],
                                  "origin_id int, destination_id int, seconds int")
    found = {(r.origin_id, r.destination_id): r.seconds for r in shortest_times(places, given, 200).collect()}
    assert found == {(i, j): s for i in range(1, 41) for j, s in dijkstra(links, i, 200).items()}


def test_rounds_end_where_no_link_leads_on(spark, monkeypatch):
    """Ways of one link need no round, nor do those that not even the shortest link can go on from."""
    kept, plain = [], reach.stored
    monkeypatch.setattr(reach, "stored", lambda df, name: kept.append(name) or plain(df, name))
    places = spark.createDataFrame([(i,) for i in range(1, 7)], "location_id int")
    links = spark.createDataFrame([(i, i + 1, 240 + i) for i in range(1, 6)], "origin_id int, destination_id int, seconds int")
    found = {(r.origin_id, r.destination_id): r.seconds for r in shortest_times(places, links, 900).collect()}
    assert found == {(i, j): sum(240 + k for k in range(i, j)) for i in range(1, 7) for j in range(i, min(i + 3, 6) + 1)}
    assert kept.count("times") == 2  # two links, three links


def test_accessibility(spark):
    values = spark.createDataFrame([(1, 10), (2, 30), (3, 0), (4, 60)], "location_id int, trip_count long")
    links = spark.createDataFrame([(1, 2, 120), (2, 3, 90), (3, 4, 60), (4, 1, 600)],
                                  "origin_id int, destination_id int, seconds int")
    rows = {(r.location_id, r.minutes): tuple(r)[2:] for r in accessibility(values, links, (2, 5)).collect()}
    assert rows[1, 2] == (2, 40, 0.4, 1.5) and rows[1, 5] == (4, 100, 1.0, 3.3)
    assert rows[3, 2] == (2, 60, 0.6, 1.0) and rows[4, 5] == (1, 60, 0.6, 0.0)
    assert accessibility(values.limit(0), links, (5,)).collect() == []
    lonely = accessibility(values.where("location_id = 3"), links.limit(0), (5,)).first()
    assert tuple(lonely) == (3, 5, 1, 0, None, None)


def test_link_times(spark, flows):
    adjacency = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "location_id smallint, neighbour_id smallint")
    found = {(r.origin_id, r.destination_id): r.seconds for r in link_times(flows, adjacency, 300).collect()}
    assert found == {(1, 2): 45, (2, 1): 120, (3, 2): 300}


def test_numpy_agrees_on_a_sparse_fit(spark):
    cells = {(0, 0): 1, (0, 1): 2, (1, 1): 3, (2, 0): 4, (2, 2): 5, (1, 2): 6}
    rows, columns = {0: 10, 1: 20, 2: 30}, {0: 25, 1: 15, 2: 20}
    a = np.zeros((3, 3))
    for (i, j), n in cells.items():
        a[i, j] = n
    for _ in range(2000):
        a *= (np.array(list(columns.values())) / a.sum(axis=0))[None]
        a *= (np.array(list(rows.values())) / a.sum(axis=1))[:, None]
    for r in balanced(matrix(spark, cells), totals(spark, "origin_id", rows), totals(spark, "destination_id", columns)).collect():
        assert r.fitted == pytest.approx(a[r.origin_id, r.destination_id], abs=1e-5)
