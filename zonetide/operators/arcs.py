"""Simplified boundaries of a whole map: neighbours keep their common border, vertex by vertex.

Rings are cut at junctions, the points where borders part. What lies between is an arc, the same one for the zones on
its two sides, and simplified once (Douglas-Peucker). Arcs are folded over in the JVM, all of a pass at the same time; a pass
goes on where the last one stopped, until no stretch is left to split.

Where simplified arcs would cross or touch, jump over a ring, or leave a ring with fewer than three vertices, the arcs
concerned are simplified again with a smaller tolerance, at last not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonetide.functions import geometry as g
from zonetide.operators.adjacency import edge_pairs, with_turns
from zonetide.operators.simplify import DEFAULT_TOLERANCE
from zonetide.plans.shared import stored
from zonetide.schemas import GEOMETRY

ROUNDS = 8          # of splitting in one pass
FINER = 8           # times smaller each time arcs get in each other's way
COARSEST_SHARE = 500  # below this share of the tolerance arcs stay as they are
RING = ("location_id", "poly", "ring")
BLOCK_EDGES = 64    # width of the blocks in which junctions are looked for, in edges
BLOCK_SHIFT = 0.381966
SPANS = "array<struct<i:int,j:int,open:boolean>>"


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _runs(rings: DataFrame) -> DataFrame:
    """Rings cut where they leave a block of the plane: block (bx, by), ring, where the run starts, and its points with
    the one before and the one after. Blocks are some edges wide, by the geometric mean of their lengths."""
    n = F.size("v")
    lengths = F.transform("v", lambda p, i: _with(F.get("v", (i + 1) % n), lambda q: F.log2(
        F.greatest(F.abs(q["x"] - p["x"]), F.abs(q["y"] - p["y"])))))
    usual = rings.select(F.explode(lengths).alias("length")).agg(F.avg("length").alias("usual"))
    sided = rings.withColumn("side", F.pow(F.lit(2.0), F.round(usual.scalar())) * BLOCK_EDGES)

    def block(p: Column) -> Column:
        # Borders along a grid shouldn't lie between two blocks.
        return F.struct(*[F.floor(p[axis] / F.col("side") + BLOCK_SHIFT).alias(f"b{axis}") for axis in "xy"])

    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: block(F.get("v", i)) != block(F.get("v", (i + n - 1) % n)))

    def run(starts: Column, start: Column, number: Column) -> Column:
        end = F.coalesce(F.get(starts, number + 1), F.get(starts, F.lit(0)) + n)
        return F.struct(start.alias("start"), F.transform(F.sequence(start - 1, end), lambda i: F.get("v", (i + n) % n))
                        .alias("points"))

    runs = _with(F.when(F.size(starts) > 0, starts).otherwise(F.array(F.lit(0))), lambda starts: F.transform(
        starts, lambda start, number: run(starts, start, number)))
    return sided.select(*RING, "side", F.size("v").alias("n"), F.explode(runs).alias("run")).select(
        block(F.get("run.points", F.lit(1))).alias("block"), *RING, "n", "run.*").select("block.*", *RING, "n", "start", "points")


def junctions(rings: DataFrame) -> DataFrame:
    """Where (seq) rings go through points with more than two different neighbours along all boundaries. ``rings`` has open
    rings ``v``. What meets in a point meets in its block, so rings are shuffled in runs, not point by point."""
    runs = _runs(rings).repartition("bx", "by")
    around = F.transform(F.slice("points", F.lit(2), F.size("points") - 2), lambda p, i: F.struct(
        p["x"].alias("x"), p["y"].alias("y"), ((F.col("start") + i) % F.col("n")).alias("seq"),
        F.least(F.get("points", i), F.get("points", i + 2)).alias("a"),
        F.greatest(F.get("points", i), F.get("points", i + 2)).alias("b")))
    ends = runs.select("bx", "by", *RING, F.explode(around).alias("e")).select("bx", "by", *RING, "e.*")
    point = Window.partitionBy("bx", "by", "x", "y")
    bounds = ends.withColumns({"least": F.min("a").over(point), "most": F.max("b").over(point)})
    another = F.lit(False)
    for end in "ab":
        another = another | ((F.col(end) != F.col("least")) & (F.col(end) != F.col("most")))
    return bounds.withColumn("others", F.max(another).over(point)).where("others").select(*RING, "seq")


def ring_arcs(zones: DataFrame) -> DataFrame:
    """Arcs of every ring in order: ring, place, points, and whether the ring runs against them."""
    clean = g.rings(zones.select("location_id", "geom")).withColumn("vertices", g.without_repeats(F.col("vertices")))
    # Dealt out once, and read again from there.
    rings = clean.where(F.size("vertices") >= 4).select(
        *RING, F.slice("vertices", F.lit(1), F.size("vertices") - 1).alias("v")).repartition(*RING)
    cuts = junctions(rings).groupBy(*RING).agg(F.sort_array(F.collect_list("seq")).alias("cuts"))
    n = F.size("v")
    # Without a junction a ring is one arc from its smallest point, whichever zone it is taken from.
    smallest = F.array((F.array_position("v", F.array_min("v")) - 1).cast("int"))
    cut = rings.join(cuts, list(RING), "left").withColumn("cuts", F.coalesce("cuts", smallest))

    def arc(start: Column, number: Column) -> Column:
        end = F.coalesce(F.get("cuts", number + 1), F.get("cuts", F.lit(0)) + n)
        return F.transform(F.sequence(start, end), lambda i: F.get("v", i % n))

    arcs = cut.select(*RING, F.posexplode(F.transform("cuts", arc)).alias("place", "along"))
    canonical = F.least("along", F.reverse("along"))
    return (arcs.withColumn("points", canonical)
            .select(*RING, "place", "points", (F.col("along") != F.col("points")).alias("against"),
                    F.xxhash64("points").alias("arc")))


def _chord(a: Column, b: Column) -> Column:
    """Start, difference of the ends and squared length of the segment a-b."""
    return _with(F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")),
                 lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["dx"].alias("dx"), c["dy"].alias("dy"),
                                    (c["dx"] * c["dx"] + c["dy"] * c["dy"]).alias("length")))


def _distance2(p: Column, chord: Column) -> Column:
    """Squared distance of p from a segment."""
    dx, dy, length = chord["dx"], chord["dy"], chord["length"]

    def from_start(q: Column) -> Column:
        along = F.when(length > 0, F.greatest(F.least(
            (q["x"] * dx + q["y"] * dy) / length, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
        return _with(along, lambda t: _with(
            F.struct((q["x"] - t * dx).alias("x"), (q["y"] - t * dy).alias("y")), lambda d: d["x"] * d["x"] + d["y"] * d["y"]))

    return _with(p, lambda v: _with(F.struct((v["x"] - chord["x"]).alias("x"), (v["y"] - chord["y"]).alias("y")), from_start))


def _split(span: Column) -> Column:
    """The span, closed, or its two parts at the vertex farthest from its chord."""
    i, j = span["i"], span["j"]
    a, b = F.get("points", i), F.get("points", j)
    closed = F.struct(i.alias("i"), j.alias("j"), F.lit(False).alias("open"))

    def farthest(chord: Column) -> Column:
        def farther(best: Column, k: Column) -> Column:
            return _with(_distance2(F.get("points", k), chord), lambda d: F.when(
                d > best["d"], F.struct(d.alias("d"), k.alias("k"))).otherwise(best))

        return F.aggregate(F.sequence(i + 1, j - 1), F.struct(F.lit(-1.0).alias("d"), F.lit(0).alias("k")), farther)

    def decide(far: Column) -> Column:
        parts = F.array(F.struct(i.alias("i"), far["k"].alias("j"), F.lit(True).alias("open")),
                        F.struct(far["k"].alias("i"), j.alias("j"), F.lit(True).alias("open")))
        # An arc that ends where it starts has no chord: it is split in any case.
        whole = (i == 0) & (j == F.size("points") - 1) & (a == b)
        return F.when((far["d"] > F.col("tolerance") * F.col("tolerance")) | whole, parts).otherwise(F.array(closed))

    return F.when(~span["open"] | (j - i < 2), F.array(closed)).otherwise(_with(_with(_chord(a, b), farthest), decide))


def _thinned(arcs: DataFrame) -> DataFrame:
    """Arcs with the ``spans`` that are left when no stretch is farther than ``tolerance`` from its chord."""
    whole = F.array(F.struct(F.lit(0).alias("i"), (F.size("points") - 1).alias("j"), F.lit(True).alias("open")))
    arcs = arcs.withColumn("spans", whole.cast(SPANS))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col("spans"),
                       lambda spans, _: F.flatten(F.transform(spans, _split)).cast(SPANS))
    unfinished = F.exists("spans", lambda s: s["open"])
    while True:
        arcs = stored(arcs.withColumn("spans", F.when(unfinished, step).otherwise(F.col("spans"))), "spans")
        if arcs.where(unfinished).isEmpty():
            return arcs


def _lines(uses: DataFrame) -> DataFrame:
    """Each arc once: the points (``line``) that are left of it, its spans and tolerance, but not all of its points."""
    kept = F.concat(F.transform("spans", lambda s: F.get("points", s["i"])), F.array(F.element_at("points", -1)))
    return stored(uses.select("arc", "tolerance", "spans", kept.alias("line")).dropDuplicates(["arc"]), "lines")


def _simple_edges(lines: DataFrame) -> DataFrame:
    """Edges of the simplified arcs, as the edges of zones are given elsewhere, and whether they pass over points;
    ``location_id`` is the arc."""
    spans = lines.select(F.col("arc").alias("location_id"), "line", F.posexplode("spans").alias("seq", "s")).select(
        "location_id", "seq", F.get("line", F.col("seq")).alias("a"), F.get("line", F.col("seq") + 1).alias("b"),
        (F.col("s.j") - F.col("s.i") > 1).alias("passes"))
    zero = F.lit(0)
    return spans.select("location_id", zero.alias("poly"), zero.alias("ring"), "seq", F.col("a.x").alias("px"),
                        F.col("a.y").alias("py"), F.col("a.x").alias("x1"), F.col("a.y").alias("y1"),
                        F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), "passes")


def _meeting() -> Column:
    """Whether two edges have a point in common that isn't an end of both, or both ends."""
    a, b = [g.point("a_x1", "a_y1"), g.point("a_x2", "a_y2")], [g.point("b_x1", "b_y1"), g.point("b_x2", "b_y2")]
    found = F.col("crossing")
    for turn, p, (q, r) in (("b1_turn", b[0], a), ("b2_turn", b[1], a), ("a1_turn", a[0], b), ("a2_turn", a[1], b)):
        found = found | ((F.col(turn) == 0) & g.in_box(p, q, r) & ~g.equal(p, q) & ~g.equal(p, r))
    same = (g.equal(a[0], b[0]) & g.equal(a[1], b[1])) | (g.equal(a[0], b[1]) & g.equal(a[1], b[0]))
    return found | same


def _jumped(uses: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """Arcs one of whose stretches has the start of another arc between itself and its chord."""
    starts = lines.select("arc", F.get("line", F.lit(0)).alias("p")).select(
        F.col("arc").alias("location_id"), F.lit(1).alias("poly"), F.lit(0).alias("ring"), F.lit(0).alias("seq"),
        F.col("p.x").alias("px"), F.col("p.y").alias("py"),
        *[(F.col(f"p.{axis}") + sign * tolerance).alias(f"{axis}{end}")
          for end, sign in ((1, -1), (2, 1)) for axis in "xy"])
    stretches = _simple_edges(lines).where("passes").drop("passes")
    pairs = edge_pairs(stretches.unionByName(starts.select(*stretches.columns)), kind="poly")
    near = None
    for edge, other in (("a", "b"), ("b", "a")):
        start, ends = g.point(f"{other}_px", f"{other}_py"), [g.point(f"{edge}_x{end}", f"{edge}_y{end}") for end in (1, 2)]
        # The ends of a stretch are on it.
        side = pairs.where((F.col(f"{edge}_poly") == 0) & (F.col(f"{other}_poly") == 1)
                           & ~g.equal(start, ends[0]) & ~g.equal(start, ends[1])).select(
            F.col(f"{edge}_location_id").alias("arc"), F.col(f"{edge}_seq").alias("seq"),
            F.col(f"{other}_px").alias("x"), F.col(f"{other}_py").alias("y"))
        near = side if near is None else near.union(side)
    # All points of arcs are looked at only where a start is near. Stored, since few usually are: no points are shuffled for them.
    found = uses.select("arc", "points", "spans").join(stored(near.distinct(), "near"), "arc")

    def encloses(loop: Column) -> Column:
        n = F.size(loop)

        def crossed(i: Column) -> Column:
            a, b = F.get(loop, i), F.get(loop, (i + 1) % n)
            spans = (a["y"] <= F.col("y")) != (b["y"] <= F.col("y"))
            # The division is only reached where the edge isn't level.
            return F.when(spans, a["x"] + (F.col("y") - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]) > F.col("x")
                          ).otherwise(False)

        rays = F.size(F.filter(F.sequence(F.lit(0), n - 1), crossed))
        on_it = F.exists(loop, lambda v: (v["x"] == F.col("x")) & (v["y"] == F.col("y")))
        return (rays % 2 == 1) & ~on_it

    loop = _with(F.get("spans", F.col("seq")), lambda s: F.slice("points", s["i"] + 1, s["j"] - s["i"] + 1))
    return found.where(_with(loop, encloses)).select("arc")


def _in_the_way(uses: DataFrame, tolerance: float) -> DataFrame:
    """Arcs to be simplified less."""
    lines = _lines(uses)
    edges = _simple_edges(lines).drop("passes")
    met = []
    for same in (False, True):
        pairs = with_turns(edge_pairs(edges, same_zone=same)).where(_meeting())
        met += [pairs.select(F.col(c).alias("arc")) for c in (["location_id"] if same else
                                                              ["a_location_id", "b_location_id"])]
    small = (uses.select(*RING, "arc", F.size("spans").alias("n")).groupBy(*RING)
             .agg(F.sum("n").alias("n"), F.collect_set("arc").alias("arcs")).where("n < 3")
             .select(F.explode("arcs").alias("arc")))
    found = small.union(_jumped(uses, lines, tolerance))
    for one in met:
        found = found.union(one)
    return stored(found.distinct().join(lines.where("tolerance > 0").select("arc"), "arc"), "in_the_way")


def simplify_map(zones: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Zones with ``geom`` simplified, every other column unchanged.

    No vertex moves, so borders that were equal stay equal, and everything dropped lies within the tolerance of what is
    kept. Rings keep at least three different vertices; a ring may start at another vertex than before. Rings of fewer than three
    vertices drop out; null and empty boundaries stay. Work is bounded by arcs: a single one is folded over as a whole.
    """
    # Both uses of an arc are thinned, in the same way: that takes less than to bring them together.
    uses = _thinned(ring_arcs(zones).withColumn("tolerance", F.lit(float(tolerance))))
    least = tolerance / COARSEST_SHARE
    while not (wrong := _in_the_way(uses, tolerance)).isEmpty():
        finer = F.when(F.col("tolerance") / FINER < least, 0.0).otherwise(F.col("tolerance") / FINER)
        again = uses.join(wrong, "arc", "left_semi").withColumn("tolerance", finer)
        unchanged = uses.join(wrong, "arc", "left_anti")
        uses = unchanged.unionByName(_thinned(again.drop("spans")).select(*unchanged.columns))
    kept = F.transform("spans", lambda s: F.get("points", s["i"]))
    last = F.array(F.element_at("points", -1))
    thin = uses.select(*RING, "place", "against", F.concat(kept, last).alias("kept"))
    along = F.when(F.col("against"), F.reverse("kept")).otherwise(F.col("kept"))
    pieces = thin.select(*RING, "place", F.slice(along, F.lit(1), F.size("kept") - 1).alias("piece"))

    def in_order(rows: DataFrame, keys: tuple[str, ...], place: str, value: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(place, value)))
        return rows.groupBy(*keys).agg(F.transform(listed, lambda s: s[value]).alias("parts"))

    rings = in_order(pieces, RING, "place", "piece").withColumn("open", F.flatten("parts")).select(
        *RING, F.concat("open", F.slice("open", 1, 1)).alias("vertices"))
    polygons = in_order(rings, RING[:2], "ring", "vertices").withColumnRenamed("parts", "rings")
    geoms = in_order(polygons, RING[:1], "poly", "rings").select("location_id", F.col("parts").cast(GEOMETRY).alias("thin"))
    # What zones without a ring keep: null or empty boundaries.
    others = zones.withColumn("geom", F.when(F.col("geom").isNotNull(), F.array().cast(GEOMETRY)))
    return others.join(geoms, "location_id", "left").withColumn("geom", F.coalesce("thin", "geom")).select(*zones.columns)
