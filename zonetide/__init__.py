"""Trip demand analytics by zone and time, as Spark DataFrame operators."""

from zonetide.filters import Filters
from zonetide.session import build_session

__all__ = ["Filters", "build_session"]
