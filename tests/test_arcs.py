"""Simplification of whole maps."""

import math
import random

from conftest import box, ring

from pyspark.sql import functions as F

from zonetide.functions.geometry import rings
from zonetide.operators import arcs
from zonetide.operators.arcs import simplify_map
from zonetide.sources.fixtures import bordered_parcels, wavy_parcels


def edges(geom):
    return {frozenset(((a.x, a.y), (b.x, b.y))) for p in geom for r in p for a, b in zip(r, r[1:])}


def points(geom):
    return {(v.x, v.y) for p in geom for r in p for v in r}


def simplified(zones, tolerance):
    return {r.location_id: r.geom for r in simplify_map(zones, tolerance).collect()}


def test_neighbours_keep_their_common_border(make_zones):
    random.seed(1)
    middle = [(1 + random.uniform(-0.01, 0.01), y / 100) for y in range(1, 100)]
    low = [(x / 100, random.uniform(-0.01, 0.01)) for x in range(1, 100)]
    island = [(0.5 + 0.1 * math.cos(t / 10), 0.5 + 0.1 * math.sin(t / 10)) for t in range(62)]
    shapes = {
        1: [[ring((0, 0), *low, (1, 0), *middle, (1, 1), (0, 1)), ring(*reversed(island))]],
        2: [[ring((1, 0), (2, 0), (2, 1), (1, 1), *reversed(middle))]],
        3: [[ring(*island[20:], *island[:20])]],
        4: [[ring((0, -1), (1, -1), (1, 0), *reversed(low), (0, 0))]],
        5: [[box(3, 3)], [box(5, 5)]],
    }
    thin = simplified(make_zones(shapes), 0.004)
    before = {i: {tuple(v) for p in g for r in p for v in ((x["x"], x["y"]) for x in r)} for i, g in shapes.items()}
    for i, geom in thin.items():
        assert points(geom) <= before[i]
        assert all(r[0] == r[-1] and len(r) >= 4 for p in geom for r in p)
    line = {(1.0, 0.0), (1.0, 1.0), *middle}
    common = edges(thin[1]) & edges(thin[2])
    assert 2 < len(common) < 90 and {p for e in common for p in e} == points(thin[1]) & line == points(thin[2]) & line
    assert edges([thin[1][0][1:]]) == edges(thin[3])
    assert len(edges(thin[4]) & edges(thin[1])) > 2 and points(thin[5]) == before[5]
    # Everything dropped lies within the tolerance of what is kept.
    for i in (1, 2, 3, 4):
        segments = [tuple(e) for e in edges(thin[i])]
        for p in before[i]:
            assert min(distance(p, *s) for s in segments) <= 0.004


def distance(p, a, b):
    (px, py), (ax, ay), (bx, by) = p, a, b
    length = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length))
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def test_borders_that_would_meet_are_kept_apart(make_zones):
    # Two arcs between the same junctions: as chords they would be the same line.
    lens = ring((0, 0), (0.5, -0.00005), (1, 0), (0.5, 0.00005))
    above = ring((0, 0), (0.5, 0.00005), (1, 0), (1, 1), (0, 1))
    below = ring((0, -1), (1, -1), (1, 0), (0.5, -0.00005), (0, 0))
    thin = simplified(make_zones({1: [[lens]], 2: [[above]], 3: [[below]]}), 0.0001)
    assert len(edges(thin[1])) >= 3 and edges(thin[1]) <= edges(thin[2]) | edges(thin[3])


def test_a_dent_doesnt_jump_over_an_island(make_zones):
    shell = ring((0, 0), (0.5, -0.00009), (1, 0), (1, 1), (0, 1))
    hole = ring((0.4999, -0.00004), (0.5001, -0.00004), (0.5, -0.00001))
    thin = simplified(make_zones({1: [[shell, hole]], 2: [[hole[::-1]]]}), 0.0001)
    assert (0.5, -0.00009) in points(thin[1]) and edges([thin[1][0][1:]]) == edges(thin[2])


def test_tiny_islands_keep_three_vertices(make_zones):
    tiny = ring(*[(5 + 1e-6 * math.cos(t), 5 + 1e-6 * math.sin(t)) for t in range(6)])
    thin = simplified(make_zones({1: [[box(0, 0)]], 2: [[tiny]]}), 0.0001)
    assert len(points(thin[2])) >= 3 and len(points(thin[1])) == 4


def test_null_empty_and_no_boundaries(make_zones):
    thin = simplified(make_zones({1: None, 2: [], 3: [[box(0, 0)]]}), 0.1)
    assert thin[1] is None and thin[2] == [] and len(points(thin[3])) == 4
    assert simplify_map(make_zones({1: None}).limit(0)).collect() == []


def test_boundaries_are_made_after_dealing_out(spark, sf):
    plan = rings(bordered_parcels(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.rsplit("Repartition", 1)
    assert "lambda" in above and "lambda" not in below


def test_wavy_boundaries_are_made_after_dealing_out(spark, sf):
    plan = rings(wavy_parcels(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.rsplit("Repartition", 1)
    assert "struct(x, " in above and "struct(x, " not in below


def open_rings(spark, shapes):
    """Open rings of {zone: points}."""
    return spark.createDataFrame(
        [(i, 0, 0, [(float(x), float(y)) for x, y in points_]) for i, points_ in shapes.items()],
        "location_id int, poly int, ring int, v array<struct<x:double,y:double>>")


def test_junctions_are_found_in_every_block(spark):
    """Rings through common points in any order, some of them within one block, some through many."""
    random.seed(7)
    grid = [(x / 4, y / 4) for x in range(12) for y in range(12)]
    shapes = {i: random.sample(grid, random.randint(3, 30)) for i in range(8)} | {
        20 + i: [(p[0] + 9000, p[1]) for p in grid[4 * i:4 * i + 4]] for i in range(5)} | {
        40: [(9000.0, 0.0), (9000.0, 0.25), (9000.0, 0.5), (9000.0, 0.75)], 41: [(9000.0, 0.25), (0.0, 0.0), (9000.0, 0.75)],
        42: [(5.0, 5.0), (6.0, 5.0), (5.0, 5.0), (5.0, 6.0)], 43: [(7.0, 5.0), (8.0, 5.0), (9.0, 5.0)]}
    around = {}
    for ring_ in shapes.values():
        for k, p in enumerate(ring_):
            around.setdefault(p, set()).update((ring_[k - 1], ring_[(k + 1) % len(ring_)]))
    expected = {(i, k) for i, ring_ in shapes.items() for k, p in enumerate(ring_) if len(around[p]) > 2}
    for edges_ in (1, 4, 64):
        arcs.BLOCK_EDGES, before = edges_, arcs.BLOCK_EDGES
        try:
            found = arcs.junctions(open_rings(spark, shapes)).select("location_id", "seq").collect()
        finally:
            arcs.BLOCK_EDGES = before
        assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert 0 < len(expected) < sum(map(len, shapes.values()))


def test_rings_are_shuffled_in_few_runs(spark, sf):
    """Not point by point: parcels have 128 points each."""
    found = rings(bordered_parcels(spark, sf)).select(*arcs.RING, F.slice("vertices", 1, 128).alias("v"))
    runs = arcs._runs(found)
    assert runs.count() < 4 * found.count()
    points_ = runs.select(F.sum(F.size("points") - 2), F.sum(F.size("points"))).first()
    assert points_[0] == 128 * found.count() and points_[1] < 1.07 * points_[0]


def test_points_of_arcs_are_not_brought_together(make_zones, monkeypatch):
    """What is stored of arcs apart from their rings has only the points that are left."""
    kept, plain = {}, arcs.stored
    monkeypatch.setattr(arcs, "stored", lambda df, name: kept.setdefault(name, []).append(df.columns) or plain(df, name))
    simplified(make_zones({1: [[box(0, 0)]], 2: [[box(1, 0)]]}), 0.1)
    assert {name for name, tables in kept.items() if "points" in tables[0]} == {"spans"}
    assert set(kept["lines"][0]) == {"arc", "tolerance", "spans", "line"}
