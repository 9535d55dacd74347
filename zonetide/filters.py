"""Dashboard filters and argument range checks."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the filters, and below the ranges and texts of their errors.
FIELDS = ("borough", "hour", "weekday", "date_from", "date_to")


def check_range(name: str, value: float, low: float, high: float) -> None:
    """Raise ``ValueError`` when an argument leaves its closed range."""
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}.")


def iso_weekday(day: str | Column) -> Column:
    """ISO day of week: 1 = Monday ... 7 = Sunday."""
    return F.weekday(day) + 1


@dataclass(frozen=True)
class Filters:
    """Optional filters of the dashboard; ``None`` leaves a dimension open."""

    borough: str | None = None
    hour: int | None = None
    weekday: int | None = None
    date_from: date | None = None
    date_to: date | None = None

    def __post_init__(self) -> None:
        if self.hour is not None:
            check_range("Hour", self.hour, 0, 23)
        if self.weekday is not None:
            check_range("Weekday", self.weekday, 1, 7)
        if (self.date_from is not None and self.date_to is not None
                and self.date_from > self.date_to):
            raise ValueError("Start date cannot be later than end date.")

    def only(self, *names: str) -> Filters:
        """Keep the named filters and clear the others."""
        return replace(self, **{n: None for n in FIELDS if n not in names})

    def without(self, *names: str) -> Filters:
        """Clear the named filters."""
        return replace(self, **{n: None for n in names})

    def predicates(self) -> list[Column]:
        """One predicate per active filter, so the scan can prune and push down."""
        day = F.col("pickup_date")
        built = {
            "borough": lambda v: F.col("borough") == v,
            "hour": lambda v: F.col("pickup_hour") == v,
            "weekday": lambda v: iso_weekday(day) == v,
            "date_from": lambda v: day >= F.lit(v),
            "date_to": lambda v: day <= F.lit(v),
        }
        return [built[n](getattr(self, n)) for n in FIELDS
                if getattr(self, n) is not None]

    def apply(self, demand: DataFrame) -> DataFrame:
        for predicate in self.predicates():
            demand = demand.where(predicate)
        if "pickup_month" in demand.columns:  # the stored rollup is partitioned by it
            month = F.col("pickup_month")
            if self.date_from is not None:
                demand = demand.where(month >= f"{self.date_from:%Y-%m}")
            if self.date_to is not None:
                demand = demand.where(month <= f"{self.date_to:%Y-%m}")
        return demand

    def select_zones(self, zones: DataFrame) -> DataFrame:
        """Zones inside the borough filter; the other filters do not concern them."""
        return zones if self.borough is None else zones.where(F.col("borough") == self.borough)


NO_FILTERS = Filters()
