"""The normal distribution in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the complementary error function
# (Abramowitz and Stegun 7.1.26; off by less than 1.5e-7).
ERFC_SCALE = 0.3275911
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def with_two_sided(df: DataFrame, z: str, out: str) -> DataFrame:
    """Adds the probability of a standard normal value as far from 0 as ``z``, to 6 decimals; null stays null.

    The steps are columns of their own, so that the series doesn't repeat what ``z`` is made of.
    """
    x, t = F.col("_x"), F.col("_t")
    tail = F.lit(0.0)
    for coefficient in reversed(ERFC):
        tail = (tail + coefficient) * t
    return (df.withColumn("_x", F.abs(z) / F.sqrt(F.lit(2.0)))
            .withColumn("_t", 1 / (1 + ERFC_SCALE * x))
            .withColumn(out, F.round(tail * F.exp(-x * x), 6)).drop("_x", "_t"))
