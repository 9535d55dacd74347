"""Statistical hotspots and clusters: Getis-Ord Gi*, global and local Moran's I.

Weights are binary: touching zones have weight 1, others 0; Gi* counts the zone itself too. All operators take
``values`` (location_id, trip_count) and ``adjacency``; other columns of ``values`` are kept. Only neighbours
among the given zones count. Sums and differences are whole numbers, n times the distance from the mean
standing for the distance, so equal inputs give equal results whatever their order.

Ids may be of any integer type: nothing here ranks all zones in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ShortType

from zonetide.filters import NO_FILTERS, Filters, check_range
from zonetide.functions.normal import with_two_sided
from zonetide.functions.percentile import with_cume_dist, zone_cume_dist
from zonetide.operators.anomalies import spread, square
from zonetide.plans.shared import stored

#: Two-sided levels of a Gi* class, best first.
LEVELS = (0.01, 0.05, 0.10)
GI_CLASSES = {3: "Hotspot 99%", 2: "Hotspot 95%", 1: "Hotspot 90%", 0: "Not Significant",
              -1: "Coldspot 90%", -2: "Coldspot 95%", -3: "Coldspot 99%"}
P_UNIT = 1_000_000  # p values carry 6 decimals
SPARE = 64          # zones drawn in a replicate beyond those needed, on average
TASKS_A_CORE = 4


def zone_values(demand: DataFrame, zones: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """Trips of every selected zone, 0 where there are none."""
    counted = filters.apply(demand).groupBy("location_id").agg(F.sum("trip_count").alias("trip_count"))
    return (filters.select_zones(zones).select("location_id", "zone_name", "borough")
            .join(counted, "location_id", "left")
            .withColumn("trip_count", F.coalesce("trip_count", F.lit(0).cast("bigint"))))


def _with_totals(values: DataFrame) -> DataFrame:
    """Adds ``_n``, ``_s`` and ``_spread`` (n * sum of squares - square of sum) of all zones, one pass for all three."""
    totals = values.agg(F.struct(F.count("*").alias("n"), F.sum("trip_count").alias("s"),
                                 F.sum(square("trip_count")).alias("q"))).scalar()
    return (values.withColumn("_all", totals)
            .withColumns({"_n": F.col("_all.n"), "_s": F.col("_all.s"),
                          "_spread": spread(F.col("_all.n"), F.col("_all.s"), F.col("_all.q"))}).drop("_all"))


def _around(values: DataFrame, adjacency: DataFrame, column: str) -> DataFrame:
    """Adds the number of neighbours (``neighbour_count``) and the sum of their ``column`` (``_around``).

    The sums combine before the shuffle, so a zone with very many neighbours is no hot key.
    """
    given = values.select(F.col("location_id").alias("neighbour_id"), F.col(column).alias("_given"))
    sums = adjacency.join(given, "neighbour_id").groupBy("location_id").agg(
        F.count("*").cast("int").alias("neighbour_count"), F.sum("_given").alias("_around"))
    return values.join(sums, "location_id", "left").withColumns({
        "neighbour_count": F.coalesce("neighbour_count", F.lit(0)),
        "_around": F.coalesce("_around", F.lit(0)).cast("bigint")})


def with_false_discovery(df: DataFrame, p_value: str, rate: float, out: str) -> DataFrame:
    """Flags the p values (6 decimals) that stay significant when the expected share of false ones among
    them is held at ``rate`` (Benjamini and Hochberg). Ranks are exact and need no sort of all rows in one task."""
    units = df.withColumn("_units", F.round(F.col(p_value) * P_UNIT).cast("bigint"))
    if df.schema["location_id"].dataType == ShortType():  # 65 536 rows at most
        ranked = units.withColumn("_share", zone_cume_dist("_units"))
    else:
        ranked = with_cume_dist(units, "_units", "_share")
    passes = F.col(p_value) <= rate * F.col("_share")
    largest = ranked.agg(F.max(F.when(passes, F.col("_units")))).scalar()
    return ranked.withColumn(out, F.coalesce(F.col("_units") <= largest, F.lit(False))).drop("_units", "_share")


def gi_star(values: DataFrame, adjacency: DataFrame, rate: float = 0.05) -> DataFrame:
    """Getis-Ord Gi* of each zone: z score (4 decimals), two-sided p value, class and whether it stays significant with
    the false discovery rate held at ``rate``.

    A zone whose neighbourhood holds all zones, or where all zones have equal values, has z 0 and p 1.
    """
    check_range("rate", rate, 0, 1)
    local = _around(_with_totals(values), adjacency, "trip_count")
    n, s = F.col("_n"), F.col("_s")
    members = F.col("neighbour_count") + 1
    held = F.col("trip_count") + F.col("_around")
    difference = (n.cast("decimal(19,0)") * held.cast("decimal(19,0)")
                  - s.cast("decimal(19,0)") * members.cast("decimal(19,0)")).cast("double")
    variance = (F.col("_spread").cast("double") / F.nullif(n - 1, F.lit(0)).cast("double")
                * (members.cast("bigint") * (n - members)).cast("double"))
    exact = local.withColumn("_difference", difference).withColumn("_variance", variance).withColumn(
        "_z", F.when(F.col("_variance") > 0, F.col("_difference") / F.sqrt("_variance")))
    # Stored: ranking reads it several times.
    scored = stored(with_two_sided(exact, "_z", "_p").select(
        *values.columns, "neighbour_count", F.coalesce(F.round("_z", 4), F.lit(0.0)).alias("gi_star"),
        F.coalesce("_p", F.lit(1.0)).alias("p_value")), "scored")
    level = F.lit(0)
    for strength, limit in enumerate(reversed(LEVELS), start=1):
        level = F.when(F.col("p_value") <= limit, strength).otherwise(level)
    signed = (level * F.signum("gi_star")).cast("int")
    names = F.create_map(*[F.lit(v) for pair in GI_CLASSES.items() for v in pair])
    return (with_false_discovery(scored, "p_value", rate, "fdr_significant")
            .withColumn("gi_bin", signed).withColumn("gi_class", names[F.col("gi_bin")]))


def _deviations(values: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Adds ``_d`` (n times the distance from the mean), the neighbours' number and the sum of their ``_d``."""
    centred = _with_totals(values).withColumn(
        "_d", F.col("_n") * F.col("trip_count") - F.col("_s"))
    return _around(centred, adjacency, "_d")


def morans_i(values: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Global Moran's I: one row with I, its expected value, and variance, z score and two-sided p value under
    randomisation (6 decimals). I is null without links or without any difference between zones, the
    variance also for fewer than 4 zones."""
    d, around = F.col("_d").cast("decimal(19,0)"), F.col("_around").cast("decimal(19,0)")
    k = F.col("neighbour_count").cast("bigint")
    deviation = F.col("_d").cast("double") / F.sqrt(F.nullif(F.col("_spread"), F.lit(0)).cast("double"))
    sums = _deviations(values, adjacency).agg(
        F.count("*").alias("zones"), F.sum(k).alias("links"), F.sum(k * k).alias("squared_degrees"),
        F.sum(d * around).alias("cross"), F.max("_spread").alias("spread"),
        F.sum(deviation * deviation * deviation * deviation).alias("fourth"))
    n, links = F.col("zones").cast("double"), F.nullif(F.col("links"), F.lit(0)).cast("double")
    s0, s1, s2 = links, 2 * links, 4 * F.col("squared_degrees").cast("double")
    # Sum of fourth powers over the squared sum of squares: n * sum(d^4) / (sum(d^2))^2, where sum(d^2) = n * spread.
    kurtosis = F.col("fourth") / n
    # Null where fewer than four zones make it undefined.
    below = F.nullif((n - 1) * (n - 2) * (n - 3), F.lit(0.0)) * s0 * s0
    moment = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
              - kurtosis * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / below
    expected = -1 / F.nullif(n - 1, F.lit(0.0))
    statistic = F.col("cross").cast("double") / (s0 * F.nullif(F.col("spread"), F.lit(0)).cast("double"))
    found = (sums.withColumn("_i", statistic).withColumn("_e", expected).withColumn("_moment", moment)
             .withColumn("_v", F.greatest(F.col("_moment") - F.col("_e") * F.col("_e"), F.lit(0.0)))
             .withColumn("_z", F.when(F.col("zones") > 3, (F.col("_i") - F.col("_e"))
                                      / F.sqrt(F.nullif(F.col("_v"), F.lit(0.0))))))
    return with_two_sided(found, "_z", "p_value").select(
        "zones", F.coalesce("links", F.lit(0)).alias("links"), F.round("_i", 6).alias("morans_i"),
        F.round("_e", 6).alias("expected_i"),
        F.when((F.col("zones") > 3) & F.col("_i").isNotNull(), F.round("_v", 6)).alias("variance"),
        F.round("_z", 6).alias("z_score"), "p_value")


def _quadrant(own: Column, around: Column) -> Column:
    return (F.when((own > 0) & (around > 0), "High-High").when((own < 0) & (around < 0), "Low-Low")
            .when((own > 0) & (around < 0), "High-Low").when((own < 0) & (around > 0), "Low-High")
            .otherwise("Undefined"))


def _drawn(own: DataFrame, zones: int, permutations: int, places: int) -> DataFrame:
    """The first ``places`` of all ``zones`` in each replicate, in order, with their ``place`` and the running sum of ``_d``.

    Of 2^48 orders only the lowest are sorted, enough for four times ``places`` zones and some more in a replicate of average
    luck. Should a replicate come out short all the same, more are taken. Zones are dealt out first: each is a row for each
    replicate, and a small file, read by one task, holds very many.
    """
    tasks = TASKS_A_CORE * own.sparkSession.sparkContext.defaultParallelism
    needed = min(places, zones)
    replicates = F.explode(F.sequence(F.lit(1), F.lit(permutations)))
    everything = (own.select("location_id", "_d").repartition(tasks, "location_id").withColumn("replicate", replicates)
                  .withColumn("_order", F.md5(F.concat_ws(":", "replicate", "location_id").cast("binary"))))
    order = Window.partitionBy("replicate").orderBy("_order", "location_id")
    wanted = 4 * needed + SPARE
    while True:
        lowest = F.col("_order") < f"{2 ** 48 * wanted // zones:012x}" if wanted < zones else F.lit(True)
        drawn = stored(everything.where(lowest).withColumn("place", F.row_number().over(order))
                       .where(F.col("place") <= places)
                       .withColumn("sum", F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0))), "drawn")
        if wanted >= zones or drawn.where(F.col("place") == needed).count() == permutations:
            return drawn
        wanted *= 8


def lisa(values: DataFrame, adjacency: DataFrame, permutations: int = 999, alpha: float = 0.05) -> DataFrame:
    """Local Moran's I of each zone, its quadrant, pseudo p value and cluster.

    Pseudo p values come from a conditional permutation test: in each replicate a zone keeps its value and gets as many of
    the others' as it has neighbours. Replicate r puts all zones in the order of md5("r:location_id"); a zone
    takes the first ones, itself left out. So a replicate is a running sum over one order, of which only as many zones as
    the largest neighbourhood are kept, and few more are sorted; a zone needs that sum at its number of neighbours, and one
    place further where it comes among the first itself. p is the smaller of the
    shares of replicates at least, and at most, as large as the neighbours' sum, the observed one counted in.

    Zones without neighbours have null statistics and the cluster "No Neighbours". A value at the mean, or neighbours
    whose mean is the mean of all, have the quadrant "Undefined".
    """
    check_range("permutations", permutations, 1, 99_999)
    check_range("alpha", alpha, 0, 1)
    local = stored(_deviations(values, adjacency), "local")
    own = local.select("location_id", "_d", "_around", F.col("neighbour_count").alias("_k"))
    largest, zones = own.agg(F.max("_k"), F.count("*")).first()
    largest = largest or 0

    drawn = _drawn(own, zones, permutations, largest + 1)
    sizes = own.where("_k > 0").select(F.col("_k").alias("place")).distinct()
    sums = drawn.join(sizes, "place").groupBy(F.col("place").alias("_k")).agg(F.collect_list("sum").alias("_sums"))

    def reaching(sums_: Column, compare) -> Column:
        return F.size(F.filter(sums_, compare))

    counted = own.where("_k > 0").join(sums, "_k").select(
        "location_id", "_k", "_d", "_around",
        reaching(F.col("_sums"), lambda x: x >= F.col("_around")).alias("above"),
        reaching(F.col("_sums"), lambda x: x <= F.col("_around")).alias("below"))
    # Replicates in which a zone comes among the first itself: at most permutations * (largest + 1) rows.
    among = drawn.select("location_id", "replicate", "place").join(
        own.select("location_id", "_k", "_d", "_around"), "location_id").where("place <= _k")
    at = drawn.select("replicate", F.col("place").alias("_k"), F.col("sum").alias("with_itself"))
    further = drawn.select("replicate", (F.col("place") - 1).alias("_k"), F.col("sum").alias("one_more"))
    without = F.col("one_more") - F.col("_d")

    def change(compare) -> Column:
        return F.sum(compare(without).cast("int") - compare(F.col("with_itself")).cast("int"))

    corrected = (among.join(at, ["replicate", "_k"]).join(further, ["replicate", "_k"]).groupBy("location_id")
                 .agg(change(lambda x: x >= F.col("_around")).alias("more_above"),
                      change(lambda x: x <= F.col("_around")).alias("more_below")))
    zero = F.lit(0)
    reached = F.least(F.col("above") + F.coalesce("more_above", zero), F.col("below") + F.coalesce("more_below", zero))
    p_values = counted.join(corrected, "location_id", "left").select(
        "location_id", F.round((reached + 1) / F.lit(permutations + 1.0), 6).alias("p_value"))
    statistic = (F.col("_d").cast("double") * F.col("_around").cast("double")
                 / (F.col("neighbour_count") * F.nullif(F.col("_spread"), F.lit(0)).cast("double")))
    linked = F.col("neighbour_count") > 0
    quadrant = F.when(linked, _quadrant(F.col("_d"), F.col("_around")))
    return local.join(p_values, "location_id", "left").select(
        *values.columns, "neighbour_count", F.when(linked, F.round(statistic, 6)).alias("local_i"),
        quadrant.alias("quadrant"), "p_value",
        F.when(~linked, "No Neighbours").when(F.col("p_value") <= alpha, quadrant)
        .otherwise("Not Significant").alias("cluster"))
