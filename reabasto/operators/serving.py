"""Queries over the published suggestion table: filters, pages, totals, details."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields
from datetime import date, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto import fixed_values as V
from reabasto.functions.columns import any_of, is_true, is_yes
from reabasto.functions.months import previous_month_key
from reabasto.functions.text import like_any
from reabasto.params import Params

PAIR = ("producto", "sucursal_id")
SEARCHED = (
    "producto",
    "descripcion",
    "nombre_sucursal",
    "proveedor",
    "filtro1_final",
    "tipo_origen",
    "clasificacion_abc",
    "abastece_cd",
)
# Columns a suggestion row may be grouped by.
GROUPINGS = {
    "sucursal": "nombre_sucursal",
    "marca": "filtro1_final",
    "proveedor": "proveedor",
}
DEFAULT_SORT = "-total_sugerido_suc"


@dataclass(frozen=True)
class Filters:
    """What the user asked for; empty lists and None mean no restriction."""

    q: str | None = None
    sucursales: tuple[str, ...] = ()
    abc: tuple[str, ...] = ()
    filtro1: tuple[str, ...] = ()
    tipo_origen: tuple[str, ...] = ()
    proveedores: tuple[str, ...] = ()
    proveedor: str | None = None
    solo_pedir: bool = True
    solo_nacionales: bool = False
    vista: str = "todas"

    @classmethod
    def from_json(cls, text: str | None) -> Filters:
        given = json.loads(text or "{}")
        known = {f.name for f in fields(cls)}
        return cls(
            **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known}
        )

    @property
    def searching(self) -> bool:
        return bool(self.q and self.q.strip())


def _visible(params: Params) -> Column:
    return ~any_of(F.lower("producto").startswith(p.lower()) for p in params.hidden_prefixes)


def view_condition(view: str, params: Params) -> Column:
    """The three steps of the purchase process; any other name shows everything."""
    at_cd = F.col("sucursal_id") == params.cd_id
    via_cd = is_true(is_yes(F.col("abastece_cd")))
    if view == "sucursales":
        return ~at_cd & ~via_cd
    if view == "cd":
        return at_cd
    if view == "distribucion":
        moves = is_true(F.col("sugerido_traslado") > 0) | is_true(F.col("total_sugerido_suc") > 0)
        return ~at_cd & via_cd & moves
    return F.lit(True)


def suggestion_condition(f: Filters, params: Params) -> Column:
    """All restrictions of `f` as one condition. A text search switches off the order, national
    and view restrictions, so that every match shows."""
    wanted = [_visible(params)]
    if f.searching:
        wanted.append(like_any(f.q, *[F.col(c) for c in SEARCHED]))
    lists = {
        "nombre_sucursal": f.sucursales,
        "clasificacion_abc": f.abc,
        "filtro1_final": f.filtro1,
        "tipo_origen": f.tipo_origen,
        "proveedor": f.proveedores,
    }
    wanted += [F.col(column).isin(*values) for column, values in lists.items() if values]
    if f.proveedor:
        wanted.append(like_any(f.proveedor, F.col("proveedor")))
    if not f.searching:
        if f.solo_pedir:
            wanted.append(F.lower("pedir") == "si")
        if f.solo_nacionales:
            wanted.append(~is_true(F.col("es_importado")))
        wanted.append(view_condition((f.vista or "todas").lower(), params))
    return reduce(and_, wanted)


def filter_suggestions(rows: DataFrame, f: Filters, params: Params) -> DataFrame:
    return rows.filter(suggestion_condition(f, params))


def sort_order(sort: str | None, columns: list[str], default: str, ties: tuple[str, ...]) -> tuple[list[str], bool]:
    """Columns to sort by and whether the first one falls; unknown fields fall back to the default."""
    wanted = sort if sort and sort.removeprefix("-") in columns else default
    name = wanted.removeprefix("-")
    return [name, *[c for c in ties if c != name]], wanted.startswith("-")


def sort_keys(sort: str | None, columns: list[str], default: str, ties: tuple[str, ...]) -> list[Column]:
    """`field` or `-field`, nulls last either way; unknown fields fall back to the default."""
    (name, *rest), falls = sort_order(sort, columns, default, ties)
    first = F.col(name).desc_nulls_last() if falls else F.col(name).asc_nulls_last()
    return [first, *[F.col(c) for c in rest]]


def is_after(last: Mapping[str, object], names: list[str], falls: bool) -> Column:
    """Whether a row stands after the row `last` in the order of `sort_order`; nulls of the first column
    come last, those of the others first."""
    found, same = F.lit(False), F.lit(True)
    for place, name in enumerate(names):
        col, value = F.col(name), F.lit(last[name])
        if place == 0:
            beyond = F.lit(False) if last[name] is None else is_true(col < value if falls else col > value) | col.isNull()
        else:
            beyond = col.isNotNull() if last[name] is None else is_true(col > value)
        found, same = found | (same & beyond), same & col.eqNullSafe(value)
    return found


def page_after(
    rows: DataFrame,
    last: Mapping[str, object] | None,
    limit: int,
    sort: str | None,
    default: str,
    ties: tuple[str, ...],
) -> DataFrame:
    """The `limit` rows that follow the row `last` (its sort columns; None: the first ones), in order.

    The same pages as by number, but a page costs the same however deep it lies: the rows before it are
    filtered out where they are read, and of the others each task keeps no more than `limit`. The ties
    must tell rows apart, or rows equal to `last` in all columns of the order would be left out.
    """
    names, falls = sort_order(sort, rows.columns, default, ties)
    kept = rows if last is None else rows.filter(is_after(last, names, falls))
    return kept.orderBy(*sort_keys(sort, rows.columns, default, ties)).limit(limit)


def page_of(rows: DataFrame, keys: list[Column], page: int, limit: int) -> DataFrame:
    return rows.orderBy(*keys).offset((page - 1) * limit).limit(limit)


def placed_page(rows: DataFrame, keys: list[Column], page: int, limit: int) -> DataFrame:
    """A page with the place of each row in it, so that its order survives what comes after."""
    return page_of(rows, keys, page, limit).withColumn("pos", F.row_number().over(Window.orderBy(*keys)))


def suggestion_total(rows: DataFrame, f: Filters, params: Params) -> DataFrame:
    """How many rows all pages of `suggestion_page` hold."""
    return filter_suggestions(rows, f, params).agg(F.count(F.lit(1)).alias("total"))


def suggestion_page(
    rows: DataFrame, f: Filters, params: Params, page: int = 1, limit: int = 50, sort: str | None = None
) -> DataFrame:
    return placed_suggestions(rows, f, params, page, limit, sort).orderBy("pos").drop("pos")


def placed_suggestions(
    rows: DataFrame, f: Filters, params: Params, page: int = 1, limit: int = 50, sort: str | None = None
) -> DataFrame:
    keys = sort_keys(sort, rows.columns, DEFAULT_SORT, PAIR)
    return placed_page(filter_suggestions(rows, f, params), keys, page, limit)


def suggestion_page_after(
    rows: DataFrame,
    f: Filters,
    params: Params,
    last: Mapping[str, object] | None = None,
    limit: int = 50,
    sort: str | None = None,
) -> DataFrame:
    """The page of `suggestion_page` that follows a page whose last row is `last`."""
    return page_after(filter_suggestions(rows, f, params), last, limit, sort, DEFAULT_SORT, PAIR)


def kpis(rows: DataFrame, f: Filters, params: Params) -> DataFrame:
    """Totals and counts of products and suppliers. Rows are summed per product and supplier first,
    so the two distinct counts expand those sums, not the rows."""
    zero = F.lit(0.0)
    sums = filter_suggestions(rows, f, params).groupBy("producto", "proveedor").agg(
        F.sum("total_sugerido_suc").alias("total"), F.sum("total_valor_sugerido_clp").alias("valor")
    )
    return sums.agg(
        F.coalesce(F.sum("total"), zero).alias("total_sugerido"),
        F.coalesce(F.sum("valor"), zero).alias("valor_total_clp"),
        F.countDistinct("producto").alias("n_productos"),
        F.countDistinct("proveedor").alias("n_proveedores"),
    )


def grouped(rows: DataFrame, f: Filters, by: str, params: Params, n: int = 15) -> DataFrame:
    """The `n` groups of largest value; rows without a group value are left out."""
    column = GROUPINGS[by]
    zero = F.lit(0.0)
    return (
        filter_suggestions(rows, f, params)
        .filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("grupo"))
        .agg(
            F.coalesce(F.sum("total_sugerido_suc"), zero).alias("total_sugerido"),
            F.coalesce(F.sum("total_valor_sugerido_clp"), zero).alias("valor_clp"),
            F.countDistinct("producto").alias("n_productos"),
        )
        .orderBy(F.col("valor_clp").desc(), "grupo")
        .limit(n)
    )


def ranking(rows: DataFrame, by: str, params: Params, n: int = 10, vista: str = "todas") -> DataFrame:
    """The `n` groups asked for, of one view."""
    return grouped(rows, Filters(vista=vista), by, params, n)


def summary(
    rows: DataFrame, params: Params, vista: str = "todas", supplier: str | None = None
) -> DataFrame:
    return kpis(rows, Filters(vista=vista, proveedor=supplier), params)


def filtered_pairs(rows: DataFrame, f: Filters, params: Params) -> DataFrame:
    return filter_suggestions(rows, f, params).select(*PAIR)


def detail(rows: DataFrame, product: str, branch: str) -> DataFrame:
    return rows.filter((F.col("producto") == product) & (F.col("sucursal_id") == branch))


def rule_stock_without_sale(rows: DataFrame, monthly_sales: DataFrame, today: date) -> DataFrame:
    """Stock covers the month and nothing sold (net) last month: flags go to No."""
    sold = (
        monthly_sales.filter(F.col("mes") == str(previous_month_key(today)))
        .groupBy(*PAIR)
        .agg(F.sum("cantidad").alias("_vendido"))
    )
    demand = F.col("demanda_mensual")
    covered = is_true((demand > 0) & (F.col("stock_activo_suc") >= demand))
    still = F.coalesce("_vendido", F.lit(0.0)) <= 0
    named = F.coalesce("producto", F.lit("")) != ""
    placed = F.coalesce("sucursal_id", F.lit("")) != ""
    stop = covered & still & named & placed
    return (
        rows.join(sold, list(PAIR), "left")
        .withColumns({c: F.when(stop, "No").otherwise(F.col(c)) for c in ("pedir", "pedir_flag")})
        .drop("_vendido")
    )


def enrich_replacements(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Empty replacement text filled from the catalogue."""
    known = catalogue.groupBy("producto").agg(F.min("reemplazo").alias("_reemplazo"))
    given = F.nullif(F.col("reemplazos"), F.lit(""))
    return (
        rows.join(known, "producto", "left")
        .withColumn("reemplazos", F.coalesce(given, "_reemplazo"))
        .drop("_reemplazo")
    )


def units_from_days(pairs: DataFrame, days: int | Column) -> DataFrame:
    """Stock days to units, at least one; pairs without daily demand drop out."""
    span = F.lit(days) if isinstance(days, int) else days
    return pairs.filter(F.col("demanda_diaria") > 0).withColumn(
        "unidades", F.greatest(F.lit(1), F.ceil(F.col("demanda_diaria") * span)).cast("long")
    )


def list_by_ids(rows: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of the given positive ids in the given order; `pos` holds the place."""
    wanted = rows.sparkSession.createDataFrame(
        [(i, place) for place, i in enumerate(ids) if i > 0], "id long, pos int"
    )
    return rows.join(wanted, "id").orderBy("pos")


def sales_12m(
    monthly_sales: DataFrame, product: str | None = None, branch: str | None = None, months: int = 12
) -> DataFrame:
    """Last present months of each product: all branches, and one branch beside it.

    Each series keeps its own last months; a month only one of them has shows 0 in the other.
    """
    rows = monthly_sales if product is None else monthly_sales.filter(F.col("producto") == product)
    here = F.lit(False) if branch is None else is_true(F.col("sucursal_id") == branch)
    by_month = rows.groupBy("producto", "mes").agg(
        F.coalesce(F.sum("cantidad"), F.lit(0.0)).alias("general"),
        F.coalesce(F.sum(F.when(here, F.col("cantidad"))), F.lit(0.0)).alias("sucursal"),
        F.bool_or(here).alias("con_sucursal"),
    )
    newest = Window.partitionBy("producto").orderBy(F.col("mes").desc())
    per_branch = Window.partitionBy("producto", "con_sucursal").orderBy(F.col("mes").desc())
    ranked = by_month.withColumns(
        {
            "_g": F.row_number().over(newest) <= months,
            "_s": F.col("con_sucursal") & (F.row_number().over(per_branch) <= months),
        }
    ).filter(F.col("_g") | F.col("_s"))
    return ranked.select(
        "producto",
        "mes",
        F.when(F.col("_g"), F.col("general")).otherwise(0.0).alias("cantidad_general"),
        F.when(F.col("_s"), F.col("sucursal")).otherwise(0.0).alias("cantidad_sucursal"),
    )


def sales_12m_totals(series: DataFrame) -> DataFrame:
    """Totals of both series and their means over the merged months."""
    return series.groupBy("producto").agg(
        F.sum("cantidad_general").alias("total_general"),
        F.sum("cantidad_sucursal").alias("total_sucursal"),
        F.avg("cantidad_general").alias("promedio_general"),
        F.avg("cantidad_sucursal").alias("promedio_sucursal"),
    )


def stock_coverage(rows: DataFrame, params: Params) -> DataFrame:
    """Optimal stock, share of it at hand, what is available, and transfer against purchase.

    The order cycle of a direct purchase is used on every row, also where the centre supplies.
    """

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    optimal = number("demanda_diaria") * (params.cycle_days + number("lt_efectivo")) + number(
        "stock_seguridad"
    )
    moved, bought = number("sugerido_traslado"), number("sugerido_compra_neto")
    return rows.withColumn("stock_optimo", optimal).withColumns(
        {
            "cobertura_pct": F.when(
                F.col("stock_optimo") > 0,
                F.least(F.lit(100.0), number("stock_activo_suc") / F.col("stock_optimo") * 100),
            ).otherwise(0.0),
            "disponible": number("stock_activo_suc") + number("stock_en_transito_suc"),
            "parte_traslado": F.when(moved + bought > 0, moved / (moved + bought)),
        }
    )


def export_columns(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Known columns under their labels; the default seven when none is known."""
    wanted = [c for c in columns or [] if c in V.EXPORT_LABELS] or list(V.EXPORT_DEFAULT)
    return rows.select(
        *[
            (F.col(c) if c in rows.columns else F.lit(None)).alias(V.EXPORT_LABELS.get(c, c))
            for c in wanted
        ]
    )


def supplier_list(rows: DataFrame) -> DataFrame:
    named = F.coalesce("proveedor", F.lit("")) != ""
    return rows.filter(named).select("proveedor").distinct().orderBy("proveedor")


def pair_id() -> Column:
    """A positive number for a product and branch, the same in every publication."""
    digits = F.substring(F.md5(F.concat_ws("|", *PAIR)), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def from_contract(rows: DataFrame) -> DataFrame:
    """Published contract columns under their serving names and types, and an `id` of the pair."""
    renamed = {
        "Stock de Seguridad": "stock_seguridad",
        "Unidad de Medida": "unidad_medida",
        "SucursalID": "sucursal_id",
    }
    whole = ("lt_efectivo", "lead_time_dias", "punto_de_pedido")

    def target(header: str) -> str:
        key = header.lower().replace("(", "").replace(")", "").replace(" ", "_")
        return renamed.get(header, V.SUGGESTION_ALIASES.get(key, key))

    def typed(header: str) -> Column:
        name, col = target(header), F.col(f"`{header}`")
        return (F.bround(col, 0).cast("long") if name in whole else col).alias(name)

    return rows.select(*[typed(c) for c in rows.columns]).withColumn("id", pair_id())
