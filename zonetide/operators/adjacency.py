"""Which zones touch: boundaries meet, interiors do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.functions import geometry as g
from zonetide.plans.shared import stored


LEVEL_BITS = 2  # from level to level cells grow fourfold
MOST_SPLITS = 3  # levels by which a long edge is cut finer: into up to 64 pieces
MOST_PIECES = 5  # pieces for each edge, over all
SLACK = 1e-12    # by which the boxes of pieces are widened, of the largest coordinate, since their ends are rounded


def level_of(length: Column, farthest: Column) -> Column:
    """Power of two of the cell that something of this length belongs to: at least as large, so
    that it reaches into two cells a direction. ``farthest`` is its largest coordinate: cells
    never get so small that their numbers exceed what a double can hold."""
    power = F.greatest(F.log2(length), F.log2(farthest) - 50)
    return F.ceil(power / LEVEL_BITS) * LEVEL_BITS


def _strips(level: Column, one: Column, other: Column) -> Column:
    """Numbers of the cells of a level between two coordinates."""
    side = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(F.least(one, other) / side), F.floor(F.greatest(one, other) / side))


def _in_cells(edges: DataFrame) -> DataFrame:
    """One row per cell (cx, cy) of its ``level`` that the box of an edge's piece meets. A piece that goes on where its box
    ends leaves the cell that only begins there to the next one."""
    side = F.pow(F.lit(2.0), F.col("level"))

    def strips(least: str, most: str) -> Column:
        first, last = F.floor(F.col(least) / side), F.floor(F.col(most) / side)
        return F.sequence(first, F.when(F.col("goes_on"), F.greatest(first, F.ceil(F.col(most) / side) - 1)).otherwise(last))

    return (edges.withColumn("cx", F.explode(strips("left", "right")))
            .withColumn("cy", F.explode(strips("low", "high"))).drop("goes_on"))


BOX = ("left", "low", "right", "high")


def _splits(own: Column, usual: Column) -> Column:
    """Levels by which an edge of level ``own`` is cut finer."""
    return F.greatest(F.least((own - usual) / LEVEL_BITS, F.lit(float(MOST_SPLITS))), F.lit(0.0))


def _sizes(levelled: DataFrame, kind: tuple[str, ...]) -> Column:
    """``usual``, the lowest level down to which edges can be cut without making more than ``MOST_PIECES`` pieces for each
    edge there is, ``levels``, those of all pieces, and ``extents``, where there are any. All comes from the numbers and
    boxes of edges by level, one pass."""
    extent = [by(by_end(f"{axis}1", f"{axis}2")).alias(name) for name, axis, by, by_end in (
        ("left", "x", F.min, F.least), ("low", "y", F.min, F.least),
        ("right", "x", F.max, F.greatest), ("high", "y", F.max, F.greatest))]
    counted = levelled.groupBy("own", *kind).agg(F.count("*").alias("n"), *extent).agg(
        F.collect_list(F.struct("own", "n", *kind, *BOX)).alias("found"))

    def pieces(usual: Column) -> Column:
        return F.aggregate("found", F.lit(0.0), lambda total, level: total + level["n"] * F.pow(
            F.lit(2.0), LEVEL_BITS * _splits(level["own"], usual)))

    edges = F.aggregate("found", F.lit(0.0), lambda total, level: total + level["n"])
    owns = F.transform("found", lambda level: level["own"])
    usual = F.array_min(F.filter(owns, lambda own: pieces(own) <= MOST_PIECES * edges))
    def cut(level: Column) -> Column:
        return level["own"] - LEVEL_BITS * F.floor(_splits(level["own"], F.col("usual")))

    # About 1000 levels cover all doubles.
    return counted.select("found", usual.alias("usual")).select(F.struct(
        "usual", F.array_distinct(F.transform("found", cut)).alias("levels"), F.transform("found", lambda level: F.struct(
            cut(level).alias("level"), *[level[name].alias(name) for name in (*kind, *BOX)])).alias("extents"))).scalar()


def _in_pieces(edges: DataFrame, kind: tuple[str, ...] = ()) -> DataFrame:
    """Edges cut into pieces, each with its box, the level (``own``) of its length, the ``levels`` there are and their
    ``extents``, and whether its box, that of a level or upright edge, ends where the next piece's begins (``goes_on``).

    Edges longer than most are cut, so that boxes lie along them: the box of a long slanted edge would take in every
    short one around it. The longest are cut first, as long as there are at most ``MOST_PIECES`` pieces for each edge, over all.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    farthest = F.greatest(F.abs(x1), F.abs(y1), F.abs(x2), F.abs(y2))
    levelled = edges.withColumn("own", level_of(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)), farthest))
    sized = levelled.withColumn("_sizes", _sizes(levelled, kind))
    cut = sized.withColumn("_splits", _splits(F.col("own"), F.col("_sizes.usual")).cast("int")).withColumn(
        "_n", F.pow(F.lit(2.0), LEVEL_BITS * F.col("_splits"))).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))

    def end(a: Column, b: Column, k: Column) -> Column:
        return F.when(k == F.col("_n"), b).otherwise(a + (b - a) * (k / F.col("_n")))

    # Rounded cuts are off a slanted edge. Level and upright edges have theirs on them: each piece begins where another ends.
    k, straight = F.col("_k"), (x1 == x2) | (y1 == y2)
    slack = F.when((F.col("_n") == 1) | straight, 0.0).otherwise(farthest * SLACK)
    forward = (x1 <= x2) & (y1 <= y2)
    goes_on = straight & F.when(forward, k < F.col("_n") - 1).otherwise(k > 0)
    ends = {"x": (end(x1, x2, k), end(x1, x2, k + 1)), "y": (end(y1, y2, k), end(y1, y2, k + 1))}
    box = {name: side(*ends[axis]) + sign * slack for name, axis, side, sign in (
        ("left", "x", F.least, -1), ("low", "y", F.least, -1), ("right", "x", F.greatest, 1), ("high", "y", F.greatest, 1))}
    # A piece is as many levels lower as it was cut finer; widened boxes still reach into two cells a direction.
    return cut.withColumns(box).withColumn("own", F.col("own") - LEVEL_BITS * F.col("_splits")).select(
        *edges.columns, "own", *BOX, goes_on.alias("goes_on"), F.col("_sizes.levels").alias("levels"),
        F.col("_sizes.extents").alias("extents"))


def stored_edges(zones: DataFrame) -> DataFrame:
    """The edges of the zones, stored, as they are read several times. Zones are dealt out first: a small file, read by one
    task, may hold very many."""
    return stored(g.edges(zones.select("location_id", "geom").repartition("location_id")), "edges")


def edge_pairs(edges: DataFrame, same_zone: bool = False, kind: str | None = None) -> DataFrame:
    """Pairs of edges whose boxes meet, found through shared grid cells; with ``kind``, those that differ in this column.

    Edges much longer than most are cut into pieces. Every piece is at home on the level of its own length, in four cells at
    most (nine where it was widened), and visits the coarser levels that exist around it, so that each pair meets where the longer
    piece is at home. Neither very short nor very long edges cover many cells, and a long edge meets only those near it.

    Columns of the two sides are prefixed ``a_`` and ``b_``; across zones a has the
    smaller zone id. A pair sharing several cells is listed once per cell and pieces: the callers only
    ask whether a pair exists, and repeating a test is cheaper than a shuffle to remove repeats.
    """
    kinds = (kind,) if kind else ()
    pieces = _in_pieces(edges, kinds)
    own = pieces.drop("levels", "extents")

    def around(e: Column) -> Column:
        near = ((F.col("left") <= e["right"]) & (e["left"] <= F.col("right"))
                & (F.col("low") <= e["high"]) & (e["low"] <= F.col("high")))
        return near & (e[kind] != F.col(kind)) if kind else near

    visiting = pieces.withColumn("level", F.explode(F.filter("levels", lambda level: (level > F.col("own")) & F.exists(
        "extents", lambda e: (e["level"] == level) & around(e))))).select(*own.columns, "level")
    at_home = pieces.where(F.exists("extents", lambda e: (e["level"] <= F.col("own")) & around(e))).select(
        *own.columns, F.col("own").alias("level"))
    # The first key decides most comparisons of the sort; there are few levels.
    keys = ["cy", "cx", "level", *(["location_id"] if same_zone else [])]
    whole = {name: by(f"{axis}1", f"{axis}2") for name, axis, by in (
        ("left", "x", F.least), ("low", "y", F.least), ("right", "x", F.greatest), ("high", "y", F.greatest))}

    def side(prefix: str, levelled: DataFrame) -> DataFrame:
        # What the edge tells is null, so that it takes no room in the shuffle.
        short = _in_cells(levelled.drop("own")).withColumns(
            {c: F.when(F.col(c) != value, F.col(c)) for c, value in whole.items()})
        return short.withColumnsRenamed({c: f"{prefix}_{c}" for c in short.columns if c not in keys})

    def low(side_: str, axis: str) -> Column:
        return F.least(f"{side_}_{axis}1", f"{side_}_{axis}2")

    def high(side_: str, axis: str) -> Column:
        return F.greatest(f"{side_}_{axis}1", f"{side_}_{axis}2")

    boxes_meet = F.lit(True)
    for axis, first, last in (("x", "left", "right"), ("y", "low", "high")):
        for one, other in ("ab", "ba"):
            boxes_meet = boxes_meet & (low(one, axis) <= high(other, axis)) & (
                F.coalesce(f"{one}_{first}", low(one, axis)) <= F.coalesce(f"{other}_{last}", high(other, axis)))
    # Pieces at home meet each other and those that visit. They are shuffled once, since all sides but the visitors' are the
    # same but for names. Sizes estimated from the zone file say little about the gridded edges, so the sides
    # are never broadcast; hot cells are split at run time.
    at_homes = [side(prefix, at_home) for prefix in "ab"]
    if same_zone:
        earlier, other = F.struct("a_poly", "a_ring", "a_seq") < F.struct("b_poly", "b_ring", "b_seq"), F.lit(True)
    else:
        zone_a, zone_b = F.col("a_location_id"), F.col("b_location_id")
        earlier, other = zone_a < zone_b, zone_a != zone_b
    if kind:
        boxes_meet = boxes_meet & (F.col(f"a_{kind}") != F.col(f"b_{kind}"))
    pairs = None
    for a, once in ((at_homes[0], earlier), (side("a", visiting), other)):
        met = a.hint("merge").join(at_homes[1], keys).where(once & boxes_meet).drop(
            "level", "cx", "cy", *[f"{side_}_{name}" for side_ in "ab" for name in BOX])
        pairs = met if pairs is None else pairs.unionByName(met)
    if same_zone:
        return pairs
    ordered = zone_a < zone_b
    return pairs.select(*[
        F.when(ordered, F.col(f"{first}_{c}")).otherwise(F.col(f"{second}_{c}")).alias(f"{first}_{c}")
        for first, second in (("a", "b"), ("b", "a")) for c in edges.columns])


def with_turns(pairs: DataFrame) -> DataFrame:
    """Add where each end of one edge lies relative to the other edge, and ``crossing``."""
    a1, a2 = g.point("a_x1", "a_y1"), g.point("a_x2", "a_y2")
    b1, b2 = g.point("b_x1", "b_y1"), g.point("b_x2", "b_y2")
    return pairs.withColumns({
        "b1_turn": g.orientation(a1, a2, b1), "b2_turn": g.orientation(a1, a2, b2),
        "a1_turn": g.orientation(b1, b2, a1), "a2_turn": g.orientation(b1, b2, a2),
    }).withColumn("crossing", F.expr("b1_turn * b2_turn < 0 AND a1_turn * a2_turn < 0"))


def _sector(origin: str, start: str, end: str, other_start: str, other_end: str) -> Column:
    """A common boundary point with the interior sectors of both zones there."""
    names = ("o", "s", "e", "t", "f")
    ends = (origin, start, end, other_start, other_end)
    return F.struct(*[F.col(p.replace("?", axis)).alias(f"{n}{axis}")
                      for n, p in zip(names, ends, strict=True) for axis in "xy"])


def _may_meet(pairs: DataFrame) -> DataFrame:
    """The pairs that can make a contact, by comparisons only: turns take much longer, and most pairs only have an end in common
    that starts one of the two edges. Edges with a common end don't cross; each answers for its first vertex."""
    a1, a2 = g.point("a_x1", "a_y1"), g.point("a_x2", "a_y2")
    b1, b2 = g.point("b_x1", "b_y1"), g.point("b_x2", "b_y2")
    apart = ~g.equal(a1, b1) & ~g.equal(a1, b2) & ~g.equal(a2, b1) & ~g.equal(a2, b2)
    return pairs.where(g.equal(a1, b1) | apart | (g.in_box(a1, b1, b2) & ~g.equal(a1, b2))
                       | (g.in_box(b1, a1, a2) & ~g.equal(b1, a2)))


PAIR = ("a_location_id", "b_location_id")
RINGS = ("a_location_id", "a_poly", "a_ring", "b_location_id", "b_poly", "b_ring")


def _contacts(pairs: DataFrame, by: tuple[str, ...] = RINGS) -> DataFrame:
    """Pairs of rings (or zones) that meet, with whether the interiors overlap at some common point.

    Every edge answers for its first vertex only, so each boundary vertex is tested once
    per edge of the other zone. A sector turns left from the outgoing to the incoming
    edge; at a vertex inside an edge of the other zone, that zone's sector is the half
    plane left of the edge. Two open sectors overlap exactly when one starts inside, or
    together with, the other.
    """
    a1, a2 = g.point("a_x1", "a_y1"), g.point("a_x2", "a_y2")
    b1, b2 = g.point("b_x1", "b_y1"), g.point("b_x2", "b_y2")
    at_corner = g.equal(a1, b1)
    a_inside_b = ((F.col("a1_turn") == 0) & g.in_box(a1, b1, b2)
                  & ~g.equal(a1, b1) & ~g.equal(a1, b2))
    b_inside_a = ((F.col("b1_turn") == 0) & g.in_box(b1, a1, a2)
                  & ~g.equal(b1, a1) & ~g.equal(b1, a2))
    meetings = F.array(
        F.when(at_corner, _sector("a_?1", "a_?2", "a_p?", "b_?2", "b_p?")),
        F.when(a_inside_b, _sector("a_?1", "a_?2", "a_p?", "b_?2", "b_?1")),
        F.when(b_inside_a, _sector("b_?1", "a_?2", "a_?1", "b_?2", "b_p?")),
    )
    points = (
        with_turns(_may_meet(pairs))
        .select(*by, "crossing", F.explode(meetings).alias("m"))
        .where("crossing OR m IS NOT NULL")
        .select(*by, "crossing", "m.*")
    )
    o, s, e, t, f = (g.point(f"{n}x", f"{n}y") for n in "oset" + "f")
    turns = points.withColumns({
        "se": g.orientation(o, s, e), "st": g.orientation(o, s, t),
        "te": g.orientation(o, t, e), "tf": g.orientation(o, t, f),
        "sf": g.orientation(o, s, f),
        "ahead": (s[0] - o[0]) * (t[0] - o[0]) + (s[1] - o[1]) * (t[1] - o[1]),
    })
    overlap = F.expr("""
        crossing
        OR (st = 0 AND ahead > 0)
        OR CASE WHEN se > 0 THEN st > 0 AND te > 0
                WHEN se < 0 THEN NOT (st <= 0 AND te <= 0)
                ELSE st > 0 END
        OR CASE WHEN tf > 0 THEN st < 0 AND sf > 0
                WHEN tf < 0 THEN NOT (st >= 0 AND sf <= 0)
                ELSE st < 0 END
    """)
    return turns.groupBy(*by).agg(F.max(F.coalesce(overlap, F.lit(False))).alias("overlap"))


def _both_ways(pairs: DataFrame, first: str, second: str) -> DataFrame:
    a, b = F.col("a_location_id"), F.col("b_location_id")
    ways = F.array(F.struct(a.alias(first), b.alias(second)),
                   F.struct(b.alias(first), a.alias(second)))
    return pairs.select(F.explode(ways).alias("w")).select("w.*")


def _touching(contacts: DataFrame) -> DataFrame:
    return contacts.where(~F.col("overlap")).select(*PAIR)


def _several_rings(edges: DataFrame) -> DataFrame:
    return edges.where("seq = 0").groupBy("location_id").count().where("count > 1")


def _swallowed(touching: DataFrame, contacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Touching pairs where a ring without contact lies inside the other zone.

    Only zones with several rings can have one. The ring's first vertex is tested against
    the other zone's edges by counting crossings of a ray to the right. Points and edges
    meet on (zone, height strip), so no zone is compared as a whole; strips have levels as
    the cells of edges have.
    """
    ring_of_a = F.struct(F.col("a_location_id").alias("location_id"),
                         F.col("b_location_id").alias("other"),
                         F.col("a_poly").alias("poly"), F.col("a_ring").alias("ring"))
    ring_of_b = F.struct(F.col("b_location_id").alias("location_id"),
                         F.col("a_location_id").alias("other"),
                         F.col("b_poly").alias("poly"), F.col("b_ring").alias("ring"))
    met = (contacts.where(~F.col("overlap"))
           .select(F.explode(F.array(ring_of_a, ring_of_b)).alias("r")).select("r.*"))
    y1, y2 = F.col("y1"), F.col("y2")
    upright = edges.where("y1 <> y2").select(
        F.col("location_id").alias("other"), "x1", "y1", "x2", "y2",
        level_of(F.abs(y2 - y1), F.greatest(F.abs(y1), F.abs(y2))).alias("level"))
    walls = upright.withColumn("cy", F.explode(_strips(F.col("level"), y1, y2)))
    levels = upright.agg(F.collect_set("level")).scalar()
    qy = F.col("qy")
    firsts = edges.where("seq = 0").select(
        "location_id", "poly", "ring", F.col("x1").alias("qx"), F.col("y1").alias("qy"))
    points = (
        firsts.join(_several_rings(edges), "location_id", "left_semi")
        .join(_both_ways(touching, "location_id", "other"), "location_id")
        .join(met, ["location_id", "other", "poly", "ring"], "left_anti")
        .withColumn("level", F.explode(levels))
        .withColumn("cy", F.explode(_strips(F.col("level"), qy, qy))))
    q, a, b = g.point("qx", "qy"), g.point("x1", "y1"), g.point("x2", "y2")
    spans = (a[1] <= q[1]) != (b[1] <= q[1])
    upward = F.when(b[1] > a[1], 1).otherwise(-1)
    hits = F.when(spans & (g.orientation(a, b, q) * upward > 0), 1).otherwise(0)
    return (
        points.join(walls, ["other", "level", "cy"])
        .groupBy("location_id", "other", "poly", "ring").agg(F.sum(hits).alias("hits"))
        .where(F.col("hits") % 2 == 1)
        .select(F.least("location_id", "other").alias("a_location_id"),
                F.greatest("location_id", "other").alias("b_location_id"))
    )


def zone_adjacency(zones: DataFrame) -> DataFrame:
    """All ordered pairs (location_id, neighbour_id) of zones that touch.

    Works on the unsimplified geometry. Contact in a single corner counts.
    """
    edges = stored_edges(zones)
    if _several_rings(edges).isEmpty():
        return _both_ways(_touching(_contacts(edge_pairs(edges), PAIR)), "location_id", "neighbour_id")
    contacts = _contacts(edge_pairs(edges))
    touching = _touching(contacts.groupBy(*PAIR).agg(F.max("overlap").alias("overlap")))
    kept = touching.join(_swallowed(touching, contacts, edges), list(PAIR), "left_anti")
    return _both_ways(kept, "location_id", "neighbour_id")
