"""Exact decimal quotients, rounded half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` with 17 decimals; null when the divisor is 0.

    The operand widths are chosen so that Spark keeps 17 decimals in the result:
    with divisors below 1e14 a quotient that is not a rounding tie can then never
    be mistaken for one. Values beyond the widths raise (ANSI), never wrap.
    """
    return (numerator.cast("decimal(24,3)")
            / F.nullif(denominator.cast("decimal(14,0)"), F.lit(0).cast("decimal(14,0)")))


def ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """Rounded exact quotient."""
    return F.round(quotient(numerator, denominator), places)


def percent_of(fraction: Column) -> Column:
    """A share k/n (double) as a percentage with 2 decimals.

    Twelve decimals first, to drop binary noise around exact ties.
    """
    return F.round((fraction * 100).cast("decimal(18,12)"), 2)
