"""Gi*, Moran's I and LISA against plain Python."""

import hashlib
import math
import random
import statistics

import pytest

from zonetide.operators import spatial_statistics as stats

SCHEMA = "location_id smallint, trip_count bigint"


@pytest.fixture
def make(spark):
    """(values, adjacency) of {id: value} and undirected links."""
    def build(values, links):
        pairs = [p for a, b in links for p in ((a, b), (b, a))]
        return (spark.createDataFrame(list(values.items()), SCHEMA),
                spark.createDataFrame(pairs, "location_id smallint, neighbour_id smallint"))
    return build


def neighbours(values, links):
    return {i: sorted({b for a, b in links if a == i} | {a for a, b in links if b == i} & set(values)) for i in values}


RANDOM = random.Random(4)
VALUES = {i: RANDOM.randint(0, 50) for i in range(1, 31)}
LINKS = [(i, i + 1) for i in range(1, 28)] + [(1, j) for j in range(3, 20)] + [(5, 20), (7, 25)]  # 1 is a hub, 29, 30 islands


def test_gi_star(make):
    found = {r.location_id: r for r in stats.gi_star(*make(VALUES, LINKS)).collect()}
    n, mean, deviation = len(VALUES), statistics.fmean(VALUES.values()), statistics.pstdev(VALUES.values())
    p_values = []
    for i, around in neighbours(VALUES, LINKS).items():
        held = [i, *around]
        w = len(held)
        z = (sum(VALUES[j] for j in held) - mean * w) / (deviation * math.sqrt((n * w - w * w) / (n - 1)))
        p = math.erfc(abs(z) / math.sqrt(2))
        p_values.append(p)
        assert math.isclose(found[i].gi_star, z, abs_tol=6e-5) and abs(found[i].p_value - p) < 2e-6
        bin_ = (3 if p <= 0.01 else 2 if p <= 0.05 else 1 if p <= 0.1 else 0) * (1 if z > 0 else -1)
        assert found[i].gi_bin == bin_ and found[i].gi_class == stats.GI_CLASSES[bin_]
    ranked = sorted(p_values)
    limit = max([p for k, p in enumerate(ranked, 1) if p <= 0.05 * k / n], default=-1)
    assert sum(r.fdr_significant for r in found.values()) == sum(p <= limit for p in p_values)


def test_gi_star_where_nothing_differs(make):
    for values, links in (({1: 5}, []), ({1: 5, 2: 5}, [(1, 2)]), ({1: 1, 2: 9}, [(1, 2)])):
        rows = stats.gi_star(*make(values, links)).collect()
        assert len(rows) == len(values)
        assert {(r.gi_star, r.p_value, r.gi_bin, r.fdr_significant) for r in rows} == {(0.0, 1.0, 0, False)}
    assert stats.gi_star(*make({}, [])).collect() == []


def test_false_discovery_of_wide_ids(spark, make):
    values, adjacency = make(VALUES, LINKS)
    narrow = {r.location_id: r for r in stats.gi_star(values, adjacency, 0.4).collect()}
    wide = stats.gi_star(values.selectExpr("cast(location_id AS bigint)", "trip_count"),
                         adjacency.selectExpr("cast(location_id AS bigint)", "cast(neighbour_id AS bigint)"), 0.4)
    assert {r.location_id: tuple(r)[1:] for r in wide.collect()} == {i: tuple(r)[1:] for i, r in narrow.items()}


def test_morans_i(make):
    row = stats.morans_i(*make(VALUES, LINKS)).first()
    n, mean = len(VALUES), statistics.fmean(VALUES.values())
    d = {i: v - mean for i, v in VALUES.items()}
    around = neighbours(VALUES, LINKS)
    links = sum(map(len, around.values()))
    cross = sum(d[i] * d[j] for i in d for j in around[i])
    statistic = n / links * cross / sum(x * x for x in d.values())
    assert (row.zones, row.links) == (n, links)
    assert row.morans_i == round(statistic, 6) and row.expected_i == round(-1 / (n - 1), 6)
    # The variance under randomisation, from many shuffles of the values.
    sample, values = [], list(d.values())
    for _ in range(4000):
        RANDOM.shuffle(values)
        x = dict(zip(d, values, strict=True))
        sample.append(n / links * sum(x[i] * x[j] for i in x for j in around[i]) / sum(v * v for v in values))
    assert math.isclose(row.variance, statistics.variance(sample), rel_tol=0.1)
    assert math.isclose(row.z_score, (statistic + 1 / (n - 1)) / math.sqrt(row.variance), rel_tol=1e-3)


def test_morans_i_without_links_or_difference(make):
    assert stats.morans_i(*make({1: 4, 2: 5}, [])).first().morans_i is None
    assert stats.morans_i(*make({1: 4, 2: 4}, [(1, 2)])).first().morans_i is None
    assert stats.morans_i(*make({1: 4, 2: 5}, [(1, 2)])).first()[2:5] == (-1.0, -1.0, None)
    assert stats.morans_i(*make({}, [])).first().zones == 0


def test_lisa_by_plain_permutation(make):
    replicates = 99
    found = {r.location_id: r for r in stats.lisa(*make(VALUES, LINKS), permutations=replicates, alpha=0.2).collect()}
    n, mean = len(VALUES), statistics.fmean(VALUES.values())
    d = {i: n * v - sum(VALUES.values()) for i, v in VALUES.items()}
    second = statistics.pvariance(VALUES.values())
    orders = [sorted(VALUES, key=lambda i: (hashlib.md5(f"{r}:{i}".encode()).hexdigest(), i))
              for r in range(1, replicates + 1)]
    for i, around in neighbours(VALUES, LINKS).items():
        row = found[i]
        if not around:
            assert (row.local_i, row.quadrant, row.p_value, row.cluster) == (None, None, None, "No Neighbours")
            continue
        local = (VALUES[i] - mean) * statistics.fmean(VALUES[j] - mean for j in around) / second
        assert math.isclose(row.local_i, local, abs_tol=2e-6)
        lag = sum(d[j] for j in around)
        sums = [sum([d[j] for j in order if j != i][:len(around)]) for order in orders]
        p = (min(sum(s >= lag for s in sums), sum(s <= lag for s in sums)) + 1) / (replicates + 1)
        assert row.p_value == round(p, 6)
        quadrant = ("High" if d[i] > 0 else "Low") + "-" + ("High" if lag > 0 else "Low")
        assert row.quadrant == (quadrant if d[i] and lag else "Undefined")
        assert row.cluster == (row.quadrant if p <= 0.2 else "Not Significant")


def test_lisa_of_a_whole_clique_and_of_nothing(make):
    values = {1: 1, 2: 2, 3: 9}
    rows = stats.lisa(*make(values, [(1, 2), (2, 3), (1, 3)]), permutations=19).collect()
    # Every replicate holds the same two others, so nothing is significant.
    assert {(r.p_value, r.cluster) for r in rows} == {(1.0, "Not Significant")}
    assert stats.lisa(*make({}, [])).collect() == []
    assert [r.cluster for r in stats.lisa(*make({1: 5}, [])).collect()] == ["No Neighbours"]
    with pytest.raises(ValueError, match="permutations"):
        stats.lisa(*make(values, []), permutations=0)


def test_replicates_are_dealt_out_and_few_zones_sorted(spark, monkeypatch):
    zones, replicates, places = 3000, 9, 10
    own = spark.range(zones).selectExpr("id location_id", "id * 7 % 101 - 50 _d").coalesce(1)
    passes = []
    monkeypatch.setattr(stats, "stored", lambda df, name: passes.append(df) or df)

    def found():
        passes.clear()
        return sorted((r.replicate, r.place, r.location_id, r.sum)
                      for r in stats._drawn(own, zones, replicates, places).collect())

    expected = []
    for r in range(1, replicates + 1):
        order = sorted(range(zones), key=lambda i: hashlib.md5(f"{r}:{i}".encode()).hexdigest())[:places]
        expected += [(r, k + 1, i, sum(j * 7 % 101 - 50 for j in order[:k + 1])) for k, i in enumerate(order)]
    assert found() == expected and len(passes) == 1
    plan = passes[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "_order" in plan and f"{2 ** 48 * 104 // zones:012x}" in plan
    # Too few at first: replicates that come out short are drawn from more.
    monkeypatch.setattr(stats, "SPARE", -36)
    assert found() == expected and len(passes) > 1
