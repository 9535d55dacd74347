import itertools
import math
import random

import pytest
from conftest import DAY, box, ring
from pyspark.sql import functions as F

from zonetide import Filters
from zonetide.functions import geometry as g
from zonetide.functions.projection import PROJECTIONS, forward, inverse
from zonetide.operators import adjacency
from zonetide.operators.adjacency import MOST_PIECES, _in_pieces, edge_pairs, zone_adjacency
from zonetide.operators.hotspots import hotspots
from zonetide.operators.scores import priority_class, weighted_score, zone_details, zone_scores
from zonetide.operators.simplify import simplify
from zonetide.operators.export import to_features, write_features
from zonetide.sources.fixtures import mixed_parcels, parcels
from zonetide.sources.zones import read_zone_table, read_zones, standardise_zones, validate_zones, zone_violations


def touching(zones):
    return {(r.location_id, r.neighbour_id) for r in zone_adjacency(zones).collect()}


SQUARE = [[box(0, 0)]]
CASES = {
    "shared edge": ([[box(1, 0)]], True),
    "part of an edge": ([[box(1, 0.25, 1, 0.5)]], True),
    "shared corner": ([[box(1, 1)]], True),
    "corner on an edge": ([[ring((1, 0.5), (2, 0), (2, 1))]], True),
    "apart": ([[box(3, 0)]], False),
    "apart but boxes overlap": ([[ring((1.5, -1), (1.5, 1.5), (-1, 1.5), (1.4, 1.4))]], False),
    "overlapping": ([[box(0.5, 0.5)]], False),
    "equal": ([[box(0, 0)]], False),
    "inside": ([[box(0.25, 0.25, 0.5, 0.5)]], False),
    "inside at an edge": ([[box(0, 0.25, 0.5, 0.5)]], False),
    "inside at a corner": ([[ring((0, 0), (0.5, 0.25), (0.25, 0.5))]], False),
    "crossing corners only": ([[ring((0, 0), (1, 1), (0, 2))]], False),
    "around with a fitting hole": ([[box(-1, -1, 3, 3), box(0, 0)]], True),
    "around with a larger hole": ([[box(-2, -2, 5, 5), box(-1, -1, 3, 3)]], False),
    "touching part and swallowed part": ([[box(1, 0)], [box(0.25, 0.25, 0.5, 0.5)]], False),
    "touching part and distant part": ([[box(1, 0)], [box(5, 5)]], True),
}


@pytest.mark.parametrize("turned", [False, True], ids=["counter-clockwise", "clockwise"])
def test_touches_cases_in_one_map(make_zones, turned):
    """Each case on its own patch of the plane; ring direction must not matter."""
    shapes, expected = {}, set()
    for number, (other, touches) in enumerate(CASES.values()):
        ids = (2 * number + 1, 2 * number + 2)
        for zone, geom in zip(ids, (SQUARE, other), strict=True):
            moved = [[[{"x": v["x"] + 20 * number, "y": v["y"]} for v in r] for r in p]
                     for p in geom]
            shapes[zone] = [[r[::-1] for r in p] for p in moved] if turned else moved
        if touches:
            expected |= {ids, ids[::-1]}
    assert touching(make_zones(shapes)) == expected


def test_far_away_zone_and_tiny_edges(make_zones):
    """A fine coast and a remote zone do not disturb the grid."""
    coast = [(1 + 0.001 * math.sin(i), i / 200) for i in range(201)]
    left = ring((0, 0), *coast, (0, 1))
    right = ring(*[(x, y) for x, y in reversed(coast)], (2, 0), (2, 1))
    shapes = {1: [[left]], 2: [[right]], 3: [[box(150, 80, 0.5, 0.5)]]}
    assert touching(make_zones(shapes)) == {(1, 2), (2, 1)}


def test_random_boxes_against_interval_logic(make_zones):
    rng = random.Random(3)
    sizes = {i: (rng.randrange(12), rng.randrange(12), rng.randrange(1, 4), rng.randrange(1, 4))
             for i in range(1, 41)}
    zones = make_zones({i: [[box(*s)]] for i, s in sizes.items()})

    def expected(a, b):
        (ax, ay, aw, ah), (bx, by, bw, bh) = sizes[a], sizes[b]
        meet = ax <= bx + bw and bx <= ax + aw and ay <= by + bh and by <= ay + ah
        overlap = ax < bx + bw and bx < ax + aw and ay < by + bh and by < ay + ah
        return meet and not overlap

    pairs = {p for p in itertools.permutations(sizes, 2) if expected(*p)}
    assert touching(zones) == pairs


def test_adjacency_plan_has_no_nested_loop_and_no_python(make_zones):
    plan = zone_adjacency(make_zones({1: SQUARE, 2: [[box(1, 0)]]}))
    text = plan._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "Python" not in text


def test_hotspots_count_selected_neighbours_only(make_zones, make_demand):
    shapes = {i: [[box(i, 0)]] for i in range(1, 6)}
    boroughs = {1: "A", 2: "A", 3: "B", 4: "B", 5: "B"}
    zones = make_zones(shapes, boroughs)
    demand = make_demand([(DAY, 0, z, 10 * z) for z in range(1, 5)], boroughs)
    adjacency = zone_adjacency(zones)
    everywhere = {r.location_id: r for r in hotspots(demand, zones, adjacency).collect()}
    assert [everywhere[z].neighbour_count for z in range(1, 6)] == [1, 2, 2, 2, 1]
    assert everywhere[4].neighbour_avg_trip_count == 15.0
    assert everywhere[5].trip_count == 0
    only_a = hotspots(demand, zones, adjacency, Filters(borough="A")).collect()
    assert [r.neighbour_count for r in only_a] == [1, 1]


def test_zone_without_neighbours_is_neutral(make_zones, make_demand):
    zones = make_zones({1: SQUARE, 2: [[box(5, 5)]]})
    demand = make_demand([(DAY, 0, 1, 5)])
    adjacency = zone_adjacency(zones)
    assert [r.hotspot_class for r in hotspots(demand, zones, adjacency).collect()] == [
        "Neutral", "Neutral"]
    scores = {r.location_id: r for r in zone_scores(demand, zones, adjacency).collect()}
    assert scores[1].zone_score == 0.5 * 100 + 0.3 * 50 + 0.2 * 100
    # No trips: demand 0, neutral 50, consistency 0.
    assert scores[2].zone_score == 15.0
    assert scores[2].priority_class == "Very Low"


def test_score_vector(spark):
    row = spark.range(1).select(
        weighted_score(F.lit("99.23").cast("decimal(7,2)"), F.lit(100),
                       F.lit("93.94").cast("decimal(7,2)")).alias("s")).first()
    assert float(row.s) == 98.40


def test_priority_bounds(spark):
    scores = spark.createDataFrame([(v,) for v in (80.0, 79.99, 60.0, 40.0, 20.0, 19.99)], "s double")
    assert [r[0] for r in scores.select(priority_class(F.col("s"))).collect()] == [
        "Very High", "High", "High", "Medium", "Low", "Very Low"]


def test_details_consistency_and_peaks(make_zones, make_demand):
    zones = make_zones({1: SQUARE, 2: [[box(1, 0)]]})
    import datetime as dt
    days = [DAY + dt.timedelta(days=i) for i in range(33)]
    rows = [(day, 9, 1, 1) for day in days] + [(day, 9, 2, 1) for day in days[:31]]
    rows += [(days[0], 3, 2, 31)]  # as many as in hour 9: the smaller hour wins
    details = {r.location_id: r for r in zone_details(
        make_demand(rows), zones, zone_adjacency(zones)).collect()}
    assert details[2].consistency_score == 93.94
    assert (details[2].active_day_count, details[2].total_day_count) == (31, 33)
    assert details[2].peak_hour == 3
    assert details[2].peak_weekday_name == "Monday"


def test_details_outside_the_borough_filter_have_no_row(make_zones, make_demand):
    zones = make_zones({1: SQUARE, 2: [[box(1, 0)]]}, {1: "A", 2: "B"})
    demand = make_demand([(DAY, 0, 1, 1)], {1: "A"})
    assert zone_details(demand, zones, zone_adjacency(zones), Filters(borough="A"),
                        location_id=2).count() == 0


def test_simplify_keeps_corners_and_topology(make_zones):
    wave = [(x / 100, 0.00004 * (-1) ** x) for x in range(1, 100)]
    shell = ring((0, 0), *wave, (1, 0), (1, 1), (0, 1))
    # A tiny hole between a shallow dent and its chord must stay inside.
    dent = ring((0, 0), (0.5, -0.00009), (1, 0), (1, 1), (0, 1))
    hole = ring((0.4999, -0.00004), (0.5001, -0.00004), (0.5, -0.00001))
    zones = make_zones({1: [[shell]], 2: [[dent, hole]], 3: [[box(0, 0, 1e-5, 1e-5)]]})
    thin = {r.location_id: r.geom for r in simplify(zones).collect()}
    assert len(thin[1][0][0]) == 5
    assert len(thin[2][0][0]) == 6  # the dent stays
    assert len(thin[2][0][1]) >= 4
    assert len(thin[3][0][0]) >= 4
    for geom in thin.values():
        for polygon in geom:
            for r in polygon:
                assert r[0] == r[-1]


def test_simplified_vertices_are_a_subset_within_tolerance(make_zones):
    rng = random.Random(1)
    points = [((1 + 0.01 * rng.random()) * math.cos(a), (1 + 0.01 * rng.random()) * math.sin(a))
              for a in (2 * math.pi * i / 500 for i in range(500))]
    zones = make_zones({1: [[ring(*points)]]})
    kept = [tuple(v) for v in simplify(zones, 0.004).first().geom[0][0]]
    assert set(kept) <= set(points) and 4 <= len(kept) < 400

    def distance(p, a, b):
        (px, py), (ax, ay), (bx, by) = p, a, b
        length = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length))
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    assert all(min(distance(p, a, b) for a, b in itertools.pairwise(kept)) <= 0.004
               for p in points)


def test_projection_origin_and_round_trip(spark):
    p = PROJECTIONS["EPSG:2263"]
    df = spark.createDataFrame([(984250.0, 0.0), (913175.1, 120121.9), (1067382.5, 272844.3)],
                               "x double, y double")
    lon, lat = inverse(F.col("x"), F.col("y"), p)
    back_x, back_y = forward(F.col("lon"), F.col("lat"), p)
    rows = df.withColumns({"lon": lon, "lat": lat}).withColumns({"bx": back_x, "by": back_y}).collect()
    assert rows[0].lon == pytest.approx(-74, abs=1e-12)
    assert rows[0].lat == pytest.approx(40 + 1 / 6, abs=1e-11)
    for r in rows:
        assert (r.bx, r.by) == (pytest.approx(r.x, abs=1e-6), pytest.approx(r.y, abs=1e-6))


def test_extent(make_zones):
    zones = make_zones({1: SQUARE, 2: [[box(4, 2)]]}, {1: "A", 2: "B"})
    assert tuple(g.extent(zones).first()) == (0.0, 0.0, 5.0, 3.0)
    assert tuple(g.extent(Filters(borough="B").select_zones(zones)).first()) == (4.0, 2.0, 5.0, 3.0)


def test_violations_name_the_fault(make_zones):
    good = {1: SQUARE}
    bad = {2: [[box(1, 0)[:4]]], 3: [[ring((0, 0), (1, 1), (1, 0), (0, 1))]],
           4: [[[{"x": 0.0, "y": 0.0}] * 2]], 5: [[box(400, 0)]], 6: None}
    found = {(r.location_id, r.violation) for r in zone_violations(make_zones(good | bad)).collect()}
    assert found == {
        (2, "ring not closed"), (3, "boundary crosses itself"),
        (4, "ring with fewer than 4 points"), (5, "coordinate out of range"), (6, "null geom")}
    with pytest.raises(ValueError, match="3: boundary crosses itself"):
        validate_zones(make_zones(good | bad))
    repeated = make_zones(good).unionByName(make_zones(good))
    with pytest.raises(ValueError, match="duplicate location_id"):
        validate_zones(repeated)


def test_geojson_in_and_out(spark, tmp_path):
    lines = [
        '{"type":"Feature","properties":{"LocationID":1,"zone":"One","borough":"A"},'
        '"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1.12345678],[0,0]]]}}',
        '{"type":"Feature","properties":{"LocationID":2,"zone":"Two","borough":"B"},'
        '"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6],[5,5]]]]}}']
    (tmp_path / "zones.geojsonl").write_text("\n".join(lines))
    zones = read_zones(spark, str(tmp_path / "zones.geojsonl"))
    rows = {r.location_id: r for r in zones.collect()}
    assert rows[1].zone_name == "One" and len(rows[1].geom) == 1
    assert tuple(rows[2].geom[0][0][0]) == (5.0, 5.0)
    features = [r.feature for r in to_features(zones).collect()]
    assert '"coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.123457],[0.0,0.0]]]]' in features[0]
    assert '"service_zone":null' in features[0]
    document = '{"type":"FeatureCollection",\n"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:%s"}},' \
               '\n"features":[%s]}'
    (tmp_path / "whole.json").write_text(document % ("OGC:1.3:CRS84", ",\n".join(lines)))
    assert sorted(map(str, read_zones(spark, str(tmp_path / "whole.json")).collect())) == sorted(
        map(str, zones.collect()))
    (tmp_path / "other.json").write_text(document % ("EPSG::9999", ",\n".join(lines)))
    with pytest.raises(ValueError, match="EPSG:2263"):
        read_zones(spark, str(tmp_path / "other.json"))


def test_far_vertices_are_reported(make_zones):
    far = make_zones({1: SQUARE, 2: [[box(1e12, 0)]], 3: [[ring((0, 0), (float("inf"), 0), (1, 1), (0, 1))]]})
    found = {(r.location_id, r.violation) for r in zone_violations(far).collect()}
    assert found == {(2, "coordinate out of range"), (3, "coordinate out of range")}



def test_zones_need_a_coordinate_system_and_columns(spark, make_zones):
    with pytest.raises(ValueError, match="coordinate system"):
        standardise_zones(make_zones({1: SQUARE}), None)
    with pytest.raises(ValueError, match="geom"):
        standardise_zones(spark.range(1))
    feet = make_zones({1: [[box(984250, 0, 1000, 1000)]]})
    x, y = standardise_zones(feet, "EPSG:2263").first().geom[0][0][0]
    assert (x, y) == (pytest.approx(-74), pytest.approx(40.1666667))


def test_boundaries_stay_out_of_the_ranking_task(make_zones, make_demand):
    zones = make_zones({1: SQUARE, 2: [[box(1, 0)]]})
    demand, adjacency = make_demand([(DAY, 0, 1, 5)]), zone_adjacency(zones)
    for operator in (hotspots, zone_scores):
        plan = operator(demand, zones, adjacency)._jdf.queryExecution().optimizedPlan()
        windows = [line for line in plan.toString().splitlines() if "Window [" in line]
        assert windows and not any("geom" in line for line in windows)
        assert "geom" in operator(demand, zones, adjacency).columns


def test_written_features_and_tables_read_back(spark, make_zones, tmp_path):
    zones = make_zones({1: SQUARE, 2: [[box(1, 0)], [box(5, 5), box(5.25, 5.25, 0.5, 0.5)]]})
    write_features(zones, str(tmp_path / "features"))
    same = {"location_id": "location_id", "zone_name": "zone_name", "borough": "borough"}
    expected = sorted(zones.collect())
    assert sorted(read_zones(spark, str(tmp_path / "features"), names=same).collect()) == expected
    zones.write.parquet(str(tmp_path / "table"))
    assert sorted(read_zone_table(spark, str(tmp_path / "table")).collect()) == expected


def test_slanted_mesh_with_shared_vertices(make_zones):
    """A grid with displaced vertices touches like a grid; every other ring is reversed."""
    rng = random.Random(11)
    size = 7
    at = {(i, j): (-74 + 0.01 * i + 0.004 * rng.random(), 40.5 + 0.01 * j + 0.004 * rng.random())
          for i in range(size + 1) for j in range(size + 1)}
    shapes, place = {}, {}
    for i, j in itertools.product(range(size), repeat=2):
        number = i * size + j + 1
        corners = [at[i, j], at[i + 1, j], at[i + 1, j + 1], at[i, j + 1]]
        shapes[number] = [[ring(*(corners[::-1] if number % 2 else corners))]]
        place[number] = (i, j)
    expected = {(a, b) for a, b in itertools.permutations(place, 2)
                if max(abs(place[a][0] - place[b][0]), abs(place[a][1] - place[b][1])) == 1}
    assert touching(make_zones(shapes)) == expected


def test_fine_coast_beside_very_long_sides(make_zones):
    """Edges of a millionth of a degree beside sides of 20 to 40 degrees: few cells for each."""
    coast = [(1e-6 * (i % 2), 1e-6 * i) for i in range(401)]
    left = ring(*coast, (0, 20), (-40, 20), (-40, 0))
    right = ring((40, 0), (40, 20), (0, 20), *coast[::-1])
    zones = make_zones({1: [[left]], 2: [[right]], 3: [[box(-10, -5, 20, 5)]]})
    assert touching(zones) == {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)}
    assert zone_violations(zones).count() == 0


def test_long_slanted_edges_meet_only_what_is_near(spark):
    rng = random.Random(1)
    rows = [(i, x, y, x + 0.01, y + 0.01) for i in range(1000) for x, y in [(rng.random() * 100, rng.random() * 100)]]
    rows += [(5000 + i, x, y, x + 50, y + 50) for i in range(50) for x, y in [(rng.random() * 50, rng.random() * 50)]]
    edges_ = spark.createDataFrame(rows, "location_id int, x1 double, y1 double, x2 double, y2 double").selectExpr(
        "location_id", "0 AS poly", "0 AS ring", "0 AS seq", "x1 AS px", "y1 AS py", "x1", "y1", "x2", "y2")
    pairs = edge_pairs(edges_).select("a_location_id", "b_location_id").collect()
    assert len(pairs) < 10_000  # of 50 000 whose boxes may meet

    def gap(p, q):
        """How far apart two slanted edges run, if they lie beside each other."""
        return abs((p[1] - p[2]) - (q[1] - q[2])) if max(p[1], q[1]) <= min(p[3], q[3]) else 1.0

    close = {(p[0], q[0]) for i, p in enumerate(rows) for q in rows[i + 1:] if q[0] >= 5000 and gap(p, q) < 1e-9}
    assert close <= {tuple(p) for p in pairs}


def test_long_edges_are_cut_into_bounded_numbers(spark, sf):
    """Most edges are of a millionth of a degree: all others are long beside them."""
    found = g.edges(mixed_parcels(spark, sf))
    pieces = _in_pieces(found)
    assert found.count() < pieces.count() <= MOST_PIECES * found.count()
    assert {r.own for r in pieces.select("own").distinct().collect()} == set(pieces.first().levels)


def test_zones_are_dealt_out_before_their_edges_are_made(spark, sf, monkeypatch):
    kept = []
    monkeypatch.setattr(adjacency, "stored", lambda df, name: kept.append(df) or df)
    adjacency.stored_edges(parcels(spark, sf).coalesce(1))
    lines = kept[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt, edges = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line), next(
        i for i, line in enumerate(lines) if "posexplode" in line)
    assert edges < dealt  # above it in the plan


def test_turns_are_computed_only_for_edges_that_may_make_a_contact(spark, sf, monkeypatch):
    """One pair for two squares at a corner, of all edges that meet there. Where no zone has several rings, none is looked for
    inside another zone."""
    kept, plain = [], adjacency.with_turns
    monkeypatch.setattr(adjacency, "with_turns", lambda pairs: kept.append(pairs) or plain(pairs))
    monkeypatch.setattr(adjacency, "_swallowed", None)
    found = zone_adjacency(parcels(spark, sf).where("location_id % 128 < 8"))  # two rows of eight
    assert found.count() == 2 * (14 + 8 + 14)
    assert kept[0].count() == 7 * 6 + 16  # seven corners of four squares, sixteen of two


def plain_edges(spark, rows):
    """Edges of (zone, x1, y1, x2, y2, poly)."""
    return spark.createDataFrame(rows, "location_id int, x1 double, y1 double, x2 double, y2 double, poly int").selectExpr(
        "location_id", "poly", "0 AS ring", "0 AS seq", "x1 AS px", "y1 AS py", "x1", "y1", "x2", "y2")


def test_straight_edges_meet_all_they_touch(spark):
    """Level and upright edges, both ways, on a grid that is also that of the cells: their boxes are all there is to them."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        size = rng.choice((0.25, 0.25, 0.25, 0.25, 1, 3, 16, 40)) * rng.choice((-1, 1))
        x, y, poly = rng.randrange(-80, 80) / 4, rng.randrange(-80, 80) / 4, rng.randrange(2)
        rows.append((i, x, y, x + size, y, poly) if rng.random() < 0.5 else (i, x, y, x, y + size, poly))
    rows.append((999, -900.0, 300.0, 900.0, 300.0, 0))  # far from all others

    def meet(a, b):
        return all(min(a[k], a[k + 2]) <= max(b[k], b[k + 2]) and min(b[k], b[k + 2]) <= max(a[k], a[k + 2]) for k in (1, 2))

    expected = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if meet(a, b)}
    edges_ = plain_edges(spark, rows)
    assert {tuple(r) for r in edge_pairs(edges_).select("a_location_id", "b_location_id").collect()} == expected
    unlike = {(a, b) for a, b in expected if rows[a][5] != rows[b][5]}
    assert 10 < len(unlike) < len(expected) and {tuple(r) for r in edge_pairs(edges_, kind="poly").select(
        "a_location_id", "b_location_id").collect()} == unlike


def test_pieces_of_straight_edges_fill_few_cells(spark, sf, monkeypatch):
    """Cut edges that lie on the borders of cells: they filled six at home for each edge and eight in all."""
    kept, plain = [], adjacency._in_cells
    monkeypatch.setattr(adjacency, "_in_cells", lambda edges: kept.append(plain(edges)) or kept[-1])
    found = g.edges(mixed_parcels(spark, sf))
    edge_pairs(found)
    edges_, at_home, visiting = found.count(), kept[0].count(), kept[-1].count()
    assert len(kept) == 3 and kept[0].sameSemantics(kept[1])  # pieces at home meet each other: shuffled once
    assert at_home < 3 * edges_ and at_home + visiting < 5 * edges_
