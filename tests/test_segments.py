"""Spanning trees and connected segments against plain Python."""

import random

import pytest

from zonetide.operators.segments import HOURS, spanning_tree, weighted_edges, zone_segments

SCHEMA = "location_id int, trip_count long, profile array<bigint>"


def profile(level):
    return [level] * 12 + [10] * (HOURS - 12)


def kruskal(edges):
    name, kept = {}, set()

    def find(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for weight, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            name[find(a)] = find(b)
            kept.add((a, b, weight))
    return kept


def test_spanning_tree(spark):
    random.seed(3)
    edges = {(a, b): random.randint(1, 6) for a, b in (sorted(random.sample(range(60), 2)) for _ in range(220))}
    edges |= {(100, 101): 5, (101, 102): 5, (100, 102): 5}  # a part of its own, with ties
    rows = [(a, b, w) for (a, b), w in edges.items()]
    found = {tuple(r) for r in spanning_tree(spark.createDataFrame(rows, "a int, b int, weight long")).collect()}
    assert found == kruskal(rows)
    assert spanning_tree(spark.createDataFrame([], "a int, b int, weight long")).collect() == []


@pytest.fixture
def grid(spark):
    """A 6 x 6 grid of zones whose left, upper right and lower right parts differ, and an island."""
    levels = {6 * y + x: 100 if x < 3 else 400 if y < 3 else 900 for x in range(6) for y in range(6)}
    rows = [(i, 5, profile(level + i % 3)) for i, level in levels.items()] + [(99, 0, profile(0))]
    links = [(6 * y + x, 6 * y + x + 1) for y in range(6) for x in range(5)]
    links += [(6 * y + x, 6 * y + x + 6) for y in range(5) for x in range(6)]
    pairs = [p for a, b in links for p in ((a, b), (b, a))]
    return (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(pairs, "location_id int, neighbour_id int"), levels,
            links)


def test_segments_follow_the_profiles_and_are_connected(grid):
    profiles, adjacency, levels, links = grid
    found = {r.location_id: r.segment for r in zone_segments(profiles, adjacency, 4).collect()}
    assert len(found) == 37 and found[99] == 99
    assert {(levels[i], s) for i, s in found.items() if i != 99} == {(100, 0), (400, 3), (900, 21)}
    for segment in set(found.values()):
        members = {i for i, s in found.items() if s == segment}
        reached, frontier = {min(members)}, [min(members)]
        while frontier:
            at = frontier.pop()
            for a, b in links:
                for x, y in ((a, b), (b, a)):
                    if x == at and y in members and y not in reached:
                        reached.add(y)
                        frontier.append(y)
        assert reached == members and segment == min(members)


def test_no_cut_without_gain(spark, grid):
    profiles, adjacency, _, _ = grid
    same = profiles.selectExpr("location_id", "trip_count", "array_repeat(7L, 24) AS profile")
    assert {r.segment for r in zone_segments(same, adjacency, 9).collect()} == {0, 99}
    # Islands are segments whatever the number asked for.
    assert len({r.segment for r in zone_segments(same, adjacency, 1).collect()}) == 2
    assert zone_segments(profiles.limit(0), adjacency, 3).collect() == []


def test_weights(grid):
    profiles, adjacency, _, _ = grid
    weights = {(r.a, r.b): r.weight for r in weighted_edges(profiles, adjacency).collect()}
    assert len(weights) == 60 and weights[2, 3] == 12 * (400 + 0 - 100 - 2) ** 2
