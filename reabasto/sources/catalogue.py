"""Catalogue file: many rows per code to one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reabasto import fixed_values as V
from reabasto.functions import text as T
from reabasto.functions.columns import first_by


def aggregate_catalogue(
    raw: DataFrame,
    order: str = "fila",
    text: Mapping[str, str] | None = None,
    numeric: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per code: first filled value of each field in file order, summed stock."""
    text = dict(text or V.CATALOGUE_TEXT)
    numeric = dict(numeric or V.CATALOGUE_NUMERIC)
    code = text.pop("Producto", "producto")

    def source(name: str) -> Column:
        return F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")

    typed = raw.select(
        T.blank_to_null(F.col("Producto")).alias(code),
        F.col(order).alias("_orden"),
        *[T.blank_to_null(source(h)).alias(f) for h, f in text.items()],
        *[T.upload_number(source(h), currency=False).alias(f) for h, f in numeric.items()],
    ).filter(F.col(code).isNotNull())
    totals = [
        F.coalesce(F.sum(f), F.lit(0.0)).alias(f) for f in numeric.values() if f == "stock_total"
    ]
    firsts = [
        first_by(F.col(f), F.col("_orden")).alias(f)
        for f in [*text.values(), *numeric.values()]
        if f != "stock_total"
    ]
    return typed.groupBy(code).agg(*firsts, *totals)


def catalogue_counts(raw: DataFrame) -> DataFrame:
    """Rows read, rows skipped for lack of a code, products kept."""
    code = T.blank_to_null(F.col("Producto"))
    return raw.agg(
        F.count(F.lit(1)).alias("leidas"),
        F.count_if(code.isNull()).alias("saltadas"),
        F.countDistinct(code).alias("productos"),
    )
