"""Small Column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _sql_literal(value: Any) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def map_literal(table: Mapping[Any, Any]) -> Column:
    """The whole dictionary as one literal, parsed in a single call."""
    return F.expr(f"map({', '.join(_sql_literal(x) for x in chain.from_iterable(table.items()))})")


def map_value(col: Column, table: Mapping[Any, Any], default: Column | None = None) -> Column:
    """Dictionary lookup inside the row; keys absent from `table` give `default` (null)."""
    if not table:
        return F.lit(None) if default is None else default
    found = F.try_element_at(map_literal(table), col)  # null for a null key
    return found if default is None else F.coalesce(found, default)


def literal_rows(spark: SparkSession, columns: str, rows: Iterable[tuple]) -> DataFrame:
    """Constants as a frame whose size the optimiser knows, so that it picks the join by it."""
    listed = ", ".join(f"({', '.join('NULL' if x is None else _sql_literal(x) for x in row)})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({columns})")


def round_half_up(col: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(col + F.lit(0.5))


def thousands(col: Column) -> Column:
    """Whole number with a dot between groups of three digits."""
    return F.translate(F.format_number(F.floor(col).cast("long"), 0), ",", ".")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_true(col: Column) -> Column:
    """Three-valued logic closed to false."""
    return F.coalesce(col, F.lit(False))


def yes_no(condition: Column) -> Column:
    return F.when(condition, F.lit("Si")).otherwise(F.lit("No"))


def is_yes(col: Column) -> Column:
    return F.lower(col).isin("si", "sí")


def first_by(value: Column, order: Column) -> Column:
    """Value of the row with the smallest `order` among rows where the value is present."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def side_by_side(counts: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of several frames as one row, one column each."""
    singles = [
        frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("nombre"), "n")
        for name, frame in counts.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b), singles)
    return stacked.agg(
        *[F.sum(F.when(F.col("nombre") == name, F.col("n"))).alias(name) for name in counts]
    )
