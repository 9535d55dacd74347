import random

import pytest
from pyspark.sql import functions as F

from zonetide.functions.percentile import with_cume_dist, zone_cume_dist, zone_grain
from zonetide.functions.numeric import percent_of, ratio


def test_distributed_form_agrees_with_the_window(spark):
    rng = random.Random(5)
    values = [rng.choice([None, 0, -3, rng.randrange(-10**6, 10**6),
                          rng.randrange(-2**62, 2**62)]) for _ in range(3000)]
    values += [7] * 1500  # a third of all rows share one value
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v bigint")
    expected = df.withColumn("share", zone_cume_dist("v"))
    found = with_cume_dist(df, "v", "share")
    assert sorted(found.collect()) == sorted(expected.collect())


def test_ratio_rounds_half_away_from_zero(spark):
    rows = spark.createDataFrame([(1, 8), (-1, 8), (5, 0), (2, 3)], "a bigint, b bigint")
    found = [r[0] for r in rows.select(
        ratio(F.col("a"), F.col("b"), 2).cast("double")).collect()]
    assert found == [0.13, -0.13, None, 0.67]


def test_percent_of_drops_binary_noise(spark):
    row = spark.range(1).select(percent_of(F.lit(1) / F.lit(800)).alias("p"),
                                percent_of(F.lit(2) / F.lit(3)).alias("q")).first()
    assert (float(row.p), float(row.q)) == (0.13, 66.67)


def test_only_smallint_zones_are_ranked_in_one_task(spark):
    assert zone_grain(spark.sql("SELECT 1S AS location_id")).count() == 1
    with pytest.raises(TypeError, match="smallint"):
        zone_grain(spark.sql("SELECT 1 AS location_id"))
