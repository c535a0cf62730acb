"""Month keys as whole numbers YYYYMM and the windows built from a closed month."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def month_index(closed_month: date) -> int:
    """Months since year 0 of the last closed month, the one before `closed_month`."""
    return closed_month.year * 12 + closed_month.month - 2


def index_to_key(index: int) -> int:
    return index // 12 * 100 + index % 12 + 1


def window_months(closed_month: date, n: int) -> list[int]:
    """The `n` closed months ending just before `closed_month`, oldest first."""
    last = month_index(closed_month)
    return [index_to_key(last - back) for back in range(n - 1, -1, -1)]


def window_start(closed_month: date, n: int) -> int:
    return window_months(closed_month, n)[0]


def first_day(key: int) -> date:
    return date(key // 100, key % 100, 1)


def previous_month_key(today: date) -> int:
    return index_to_key(today.year * 12 + today.month - 2)
