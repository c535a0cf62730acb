"""Post-sale sheet: summary, KPIs, series, lines and export."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reabasto import fixed_values as V
from reabasto.functions import text as T
from reabasto.functions.text import like_any
from reabasto.operators.serving import page_of
from reabasto.params import Params
from reabasto.sources.files import write_csv
from reabasto.sources.postsale import sheet_index

BYTE_ORDER_MARK = "﻿"


def _cells() -> Column:
    return F.from_json("datos", "array<string>")


def _cell(place: int | None) -> Column:
    return F.lit(None).cast("string") if place is None else F.get(_cells(), F.lit(place))


def postventa_summary(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Amount, units and lines per month and branch of stored rows; rows without a month are left out."""
    return summarise_cells(rows.select("periodo", "sucursal", _cells().alias("valores")), headers)


def summarise_cells(rows: DataFrame, headers: list[str]) -> DataFrame:
    """The same from the cells as they are loaded, without a way through their stored text."""
    amount = sheet_index(headers, "total_neta", "neto", "total")
    units = sheet_index(headers, "cantidad", "items")

    def total(place: int | None) -> Column:
        cell = F.lit(None).cast("string") if place is None else F.get("valores", F.lit(place))
        return F.coalesce(F.sum(T.upload_number(cell)), F.lit(0.0))

    return (
        rows.filter(F.col("periodo").isNotNull())
        .groupBy("periodo", "sucursal")
        .agg(
            total(amount).alias("total_clp"),
            total(units).alias("total_unidades"),
            F.count(F.lit(1)).alias("n_lineas"),
        )
    )


def periods(summary: DataFrame) -> DataFrame:
    filled = F.col("periodo") != ""
    return summary.filter(filled).select("periodo").distinct().orderBy("periodo")


def _by_period(summary: DataFrame) -> DataFrame:
    return (
        summary.filter(F.col("periodo") != "")
        .groupBy("periodo")
        .agg(
            F.coalesce(F.sum("total_clp"), F.lit(0.0)).alias("clp"),
            F.coalesce(F.sum("total_unidades"), F.lit(0.0)).alias("unidades"),
            F.coalesce(F.sum("n_lineas"), F.lit(0)).alias("n_lineas"),
        )
    )


def sales_kpis(summary: DataFrame) -> DataFrame:
    """Newest period against the one present before it; change is null on a zero base."""
    columns = ("periodo", "clp", "unidades", "n_lineas")
    two = _by_period(summary).orderBy(F.col("periodo").desc()).limit(2)
    ends = two.agg(
        F.max(F.struct(*columns)).alias("a"), F.min(F.struct(*columns)).alias("b"), F.count(F.lit(1)).alias("n")
    ).filter("n > 0")
    there = F.col("n") > 1

    def before(name: str) -> Column:
        return F.when(there, F.col(f"b.{name}"))

    def change(name: str) -> Column:
        return F.try_divide(F.col(f"a.{name}") - before(name), before(name)) * 100.0

    return ends.select(
        *[F.col(f"a.{c}").alias(c) for c in columns],
        before("periodo").alias("periodo_anterior"),
        *[F.coalesce(before(c), F.lit(0)).alias(f"{c}_anterior") for c in columns[1:]],
        change("clp").alias("var_clp_pct"),
        change("unidades").alias("var_unidades_pct"),
    )


def monthly_series(summary: DataFrame, n: int = 12) -> DataFrame:
    last = _by_period(summary).select("periodo", "clp", "unidades")
    return last.orderBy(F.col("periodo").desc()).limit(n).orderBy("periodo")


def by_branch(summary: DataFrame, params: Params, period: str | None = None) -> DataFrame:
    """Totals of one period by branch, the newest period when none is given."""
    if period is None:
        newest = summary.agg(F.max("periodo").alias("periodo"))
        kept = summary.join(newest, "periodo", "left_semi")
    else:
        kept = summary.filter(F.col("periodo") == period)
    label = F.coalesce(F.nullif(F.col("sucursal"), F.lit("")), F.lit(params.no_branch_label))
    return (
        kept.groupBy(label.alias("sucursal"))
        .agg(
            F.coalesce(F.sum("total_clp"), F.lit(0.0)).alias("clp"),
            F.coalesce(F.sum("total_unidades"), F.lit(0.0)).alias("unidades"),
            F.coalesce(F.sum("n_lineas"), F.lit(0)).alias("n_lineas"),
        )
        .orderBy(F.col("clp").desc(), "sucursal")
    )


@dataclass(frozen=True)
class LineFilters:
    """Month range, exact-day range, branch and free text. Days given decide the months."""

    periodo_desde: str | None = None
    periodo_hasta: str | None = None
    fecha_desde: date | None = None
    fecha_hasta: date | None = None
    sucursal: str | None = None
    q: str | None = None

    @property
    def months(self) -> tuple[str | None, str | None]:
        first = f"{self.fecha_desde:%Y%m}" if self.fecha_desde else self.periodo_desde
        last = f"{self.fecha_hasta:%Y%m}" if self.fecha_hasta else self.periodo_hasta
        return first, last


def sheet_day(cell: Column) -> Column:
    """Day of a sheet cell: month first, else day first, else ISO; time of day ignored."""
    text = F.get(F.split(F.trim(cell), " "), F.lit(0))
    slashed = text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.coalesce(
        F.when(slashed, F.try_to_date(text, "M/d/yyyy")),
        F.when(slashed, F.try_to_date(text, "d/M/yyyy")),
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d")),
    )


def filter_lines(rows: DataFrame, headers: list[str], f: LineFilters) -> DataFrame:
    """The month predicate goes first, on a plain column; then the day inside the JSON.

    A row whose day cannot be read passes the day filter.
    """
    first, last = f.months
    kept = rows
    if first:
        kept = kept.filter(F.col("periodo") >= first)
    if last:
        kept = kept.filter(F.col("periodo") <= last)
    if f.sucursal:
        kept = kept.filter(F.col("sucursal") == f.sucursal)
    if f.q and f.q.strip():
        kept = kept.filter(like_any(f.q.strip(), F.col("datos")))
    place = sheet_index(headers, "fecha")
    if place is not None and (f.fecha_desde or f.fecha_hasta):
        day = sheet_day(_cell(place))
        inside = F.lit(True)
        if f.fecha_desde:
            inside = inside & (day >= F.lit(f.fecha_desde))
        if f.fecha_hasta:
            inside = inside & (day <= F.lit(f.fecha_hasta))
        kept = kept.filter(day.isNull() | inside)
    return kept


def named_cells(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Positional JSON cells under their header names."""
    parsed = rows.withColumn("_c", _cells())
    return parsed.select("id", *[F.get("_c", F.lit(i)).alias(h) for i, h in enumerate(headers)])


def sales_lines(
    rows: DataFrame, headers: list[str], f: LineFilters, page: int = 1, limit: int = 100
) -> DataFrame:
    """Newest lines first, one page, cells under their names."""
    keys = [F.col("periodo").desc_nulls_last(), F.col("id").desc()]
    return named_cells(page_of(filter_lines(rows, headers, f), keys, page, limit), headers)


def sales_count(rows: DataFrame, headers: list[str], f: LineFilters) -> DataFrame:
    return filter_lines(rows, headers, f).agg(F.count(F.lit(1)).alias("filas"))


def sales_export(rows: DataFrame, headers: list[str], f: LineFilters, numeric: bool = False) -> DataFrame:
    """Filtered lines under their names in load order, missing cells empty; optionally the
    number columns as numbers (a cell that is none keeps no value)."""
    named = named_cells(filter_lines(rows, headers, f), headers)

    def cell(i: int, name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        if numeric and sheet_index([name], *V.POSTSALE_NUMERIC) == 0:
            return F.replace(text, F.lit(","), F.lit(".")).try_cast("double").alias(name)
        return text.alias(name)

    return named.orderBy("id").select(*[cell(i, h) for i, h in enumerate(headers)])


def write_sales_export(
    rows: DataFrame, headers: list[str], f: LineFilters, path: str, sheet: bool = False
) -> None:
    """CSV with a byte-order mark; nothing to write, or too much for a sheet, is refused."""
    n = sales_count(rows, headers, f).first()["filas"]
    if n == 0:
        raise ValueError("no rows for these filters")
    if sheet and n > V.SHEET_MAX_ROWS:
        raise ValueError(f"{n} rows are more than the {V.SHEET_MAX_ROWS} a sheet holds")
    table = sales_export(rows, headers, f, numeric=sheet)
    write_csv(table.withColumnRenamed(headers[0], BYTE_ORDER_MARK + headers[0]), path)


def last_periods_extract(sales: DataFrame, n: int = 12) -> DataFrame:
    """Units per product, branch and month of the last `n` present months."""
    monthly = sales.groupBy("producto", "sucursal_id", "mes").agg(F.sum("cantidad").alias("cantidad"))
    last = sales.select("mes").distinct().orderBy(F.col("mes").desc()).limit(n)
    return monthly.join(F.broadcast(last), "mes", "left_semi")
