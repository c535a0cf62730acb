"""Registered queries of the calculation engine, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto.operators import abc_class, enrich, leadtime, suggest, transfer
from reabasto.operators import demand as demand_ops
from reabasto.plans import driver_tables as D
from reabasto.plans.pipeline import contract_text, run_pipeline
from reabasto.session import configured
from reabasto.sources import sales as sales_source

Query = Callable[[SparkSession, str], DataFrame]
P = D.PARAMS
PAIR = list(abc_class.PAIR)
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = configured(fn)
    return QUERIES[fn.__name__]


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def _cube(spark: SparkSession, d: str) -> DataFrame:
    return abc_class.monthly_cube(D.sales(spark, d), D.mapping(spark, d), D.dim_product(spark, d), P)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return abc_class.abc(
        D.sales(spark, d), D.mapping(spark, d), D.dim_product(spark, d), D.CLOSED_MONTH, P
    )


def _lead_time(spark: SparkSession, d: str, pairs: DataFrame, today: date | None = None) -> DataFrame:
    """With `today` the units on the way come along, from the same pass over the orders."""
    orders = D.tracking(spark, d, "base" if today is None else "transit")
    lookup = leadtime.supplier_lookup_from_tracking(D.tracking(spark, d, "lead_time"), P)
    return leadtime.lead_time(
        pairs, orders, lookup, D.dim_branch(spark, d), D.imported(spark, d), P, today
    )


def _stocked(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    return suggest.attach_stock(
        pairs,
        D.all_stock(spark, d),
        None,
        None if "en_camino" in pairs.columns else D.tracking(spark, d, "transit"),
        D.mapping(spark, d),
        D.dim_branch(spark, d),
        D.TODAY,
        P,
    )


def _safety(spark: SparkSession, d: str) -> DataFrame:
    pairs = demand_ops.demand(_pairs(spark, d), P)
    return suggest.safety_stock(_lead_time(spark, d, pairs, D.TODAY), P)


def _suggestion(spark: SparkSession, d: str) -> DataFrame:
    return suggest.suggestion(_stocked(spark, d, _safety(spark, d)), P)


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    return transfer.transfers(_suggestion(spark, d), P)


@query
def signed_sales(spark, d):
    return sales_source.normalize_sales_main(D.raw_sales_main(spark, d), P)


@query
def border_sales(spark, d):
    return sales_source.normalize_sales_border(D.raw_sales_border(spark, d), P)


@query
def sales_union(spark, d):
    return D.sales_by_company(spark, d).groupBy("Fuente", "SUCURSAL").agg(
        F.count(F.lit(1)).alias("lineas"), F.sum("CantidadAjustada").alias("unidades")
    )


@query
def sales_years(spark, d):
    kept = sales_source.select_sales_years(D.sales(spark, d), D.CLOSED_MONTH, P)
    return kept.select("Producto", "SUCURSAL", "Fecha", "CantidadAjustada")


@query
def tracking_union(spark, d):
    return D.tracking_by_origin(spark, d)


@query
def tracking_transit(spark, d):
    return D.tracking_by_origin(spark, d, "transit")


@query
def tracking_lead_time(spark, d):
    return D.tracking_by_origin(spark, d, "lead_time")


@query
def prepare_sales(spark, d):
    prepared = abc_class.prepare_sales(
        D.sales(spark, d), D.mapping(spark, d), D.dim_product(spark, d), P
    )
    return prepared.select("Producto", *PAIR, "mes", "CantidadAjustada", "Fuente")


@query
def months_with_sale(spark, d):
    pairs = abc_class.pair_frame(_cube(spark, d), D.CLOSED_MONTH, P)
    counted = abc_class.classify(pairs, D.CLOSED_MONTH, P)
    return counted.filter("m12 > 0").select(*PAIR, "m3", "m6", "m12")


@query
def abc(spark, d):
    return _pairs(spark, d).select(
        *PAIR, "m3", "m6", "m12", "m3a", "m6a", "m12a", "clasificacion_abc", "clasificacion_abc_agregada"
    )


@query
def cd_synthetic(spark, d):
    pairs = abc_class.pair_frame(_cube(spark, d), D.CLOSED_MONTH, P)
    classified = abc_class.classify(pairs, D.CLOSED_MONTH, P)
    before = classified.filter("en_ventana").select(*PAIR)
    return (
        abc_class.add_cd_rows(classified, P)
        .join(before, PAIR, "left_anti")
        .select("producto_master", "m12a", "clasificacion_abc_agregada")
    )


@query
def dense_series(spark, d):
    months = F.array(*[F.lit(str(m)) for m in abc_class.window_months(D.CLOSED_MONTH, P.window_long)])
    series = F.explode(F.arrays_zip(months.alias("mes"), F.col("serie").alias("total")))
    return _pairs(spark, d).select(*PAIR, series.alias("s")).select(*PAIR, "s.mes", "s.total")


@query
def demand_local(spark, d):
    local = demand_ops.demand_local(_pairs(spark, d), P)
    columns = ["demanda_mensual", "desv_std_mensual"]
    return rounded(local.select(*PAIR, *columns), *columns, digits=6)


@query
def demand_cd(spark, d):
    merged = demand_ops.consolidated_series(_pairs(spark, d), P).filter("serie_cd IS NOT NULL")
    made = demand_ops.winsorize(merged, "serie_cd", P.window_long, P, "demanda_mensual", "desv_std_mensual")
    kept = made.select("producto_master", "demanda_mensual", "desv_std_mensual")
    return rounded(kept, "demanda_mensual", "desv_std_mensual", digits=6)


@query
def demand(spark, d):
    made = demand_ops.demand(_pairs(spark, d), P)
    columns = ["demanda_mensual", "desv_std_mensual"]
    kept = rounded(made.select(*PAIR, *columns, "demanda_diaria"), *columns, digits=6)
    return rounded(kept, "demanda_diaria", digits=8)


@query
def lead_time_supplier(spark, d):
    return rounded(
        leadtime.lead_time_supplier(D.tracking(spark, d, "lead_time"), P), "Lead Time Dias"
    )


@query
def lead_time_supplier_branch(spark, d):
    return rounded(
        leadtime.lead_time_supplier_branch(D.tracking(spark, d, "lead_time"), P), "Lead Time Dias"
    )


@query
def deduced_supplier(spark, d):
    assigned = leadtime.assign_supplier(_pairs(spark, d), D.tracking(spark, d), P)
    return assigned.select(*PAIR, "proveedor_lt")


@query
def latest_supplier(spark, d):
    return (
        leadtime.order_suppliers(D.tracking(spark, d), P)
        .filter("reciente IS NOT NULL")
        .select("Producto", "SucursalID", F.col("reciente.nombre").alias("reciente"))
    )


@query
def lead_time(spark, d):
    made = _lead_time(spark, d, _pairs(spark, d)).select(
        *PAIR,
        "proveedor",
        "proveedor_lt",
        "lead_time_dias",
        "lt_origen",
        "lt_cd_a_sucursal_dias",
        "es_importado",
        "abastece_cd",
        "lt_efectivo",
    )
    return rounded(made, "lead_time_dias", "lt_efectivo")


@query
def safety_stock(spark, d):
    return _safety(spark, d).select(*PAIR, "stock_seguridad")


@query
def members(spark, d):
    return suggest.replacement_members(_pairs(spark, d), D.mapping(spark, d))


@query
def active_stock(spark, d):
    held = suggest.active_stock(D.stock(spark, d), D.stock_border(spark, d), D.mapping(spark, d))
    return held.join(_pairs(spark, d).select("producto_master").distinct(), "producto_master", "left_semi")


@query
def in_transit(spark, d):
    return suggest.in_transit(D.tracking(spark, d, "transit"), D.TODAY, P)


@query
def suggestion(spark, d):
    return _suggestion(spark, d).select(
        *PAIR, "stock_activo", "stock_transito", "sugerido", "necesidad_bruta", "punto_pedido", "pedir"
    )


@query
def transfers(spark, d):
    return _transfers(spark, d).select(
        *PAIR, "prioridad_cd", "stock_cd", "necesidad_bruta", "sugerido_traslado"
    )


@query
def buy_at_cd(spark, d):
    return _transfers(spark, d).filter("comprar_en_cd IS NOT NULL").select(*PAIR, "comprar_en_cd")


@query
def net_purchase(spark, d):
    return _transfers(spark, d).filter("sugerido > 0").select(*PAIR, "compra_neta")


@query
def lateral_text(spark, d):
    return _transfers(spark, d).filter("trasladar_desde IS NOT NULL").select(*PAIR, "trasladar_desde")


@query
def company_flag(spark, d):
    flag = enrich.company(F.col("de_frontera"), F.col("de_principal"), P)
    return _pairs(spark, d).select(*PAIR, flag.alias("empresa"))


@query
def replacements(spark, d):
    return enrich.replacements(D.mapping(spark, d))


@query
def cd_sources(spark, d):
    listed = enrich.cd_sources(_pairs(spark, d), P)
    return listed.filter("sucursales_origen_cd IS NOT NULL").select(
        "producto_master", "sucursales_origen_cd"
    )


@query
def stock_pivot(spark, d):
    pivoted = enrich.stock_pivot(_stocked(spark, d, _pairs(spark, d)), P)
    return pivoted.select("producto_master", *[F.col(f"`Stock {b}`") for b in P.stock_columns]).distinct()


@query
def stock_at_cd(spark, d):
    return enrich.products_in_cd(D.stock(spark, d), D.stock_border(spark, d), P).select("producto_master")


@query
def catalogue_lookup(spark, d):
    return enrich.catalogue_columns(D.catalogue(spark, d))


@query
def cost_value(spark, d):
    costs = enrich.unit_costs(D.cost(spark, d))
    valued = enrich.suggested_value(_transfers(spark, d).join(costs, "producto_master", "left"))
    kept = rounded(valued.select(*PAIR, "costo_unitario", "valor_clp"), "costo_unitario")
    return rounded(kept, "valor_clp", digits=2)


@query
def contract(spark, d):
    rows = run_pipeline(D.sources(spark, d), D.CLOSED_MONTH, D.TODAY, P)
    published = contract_text(rows, P)
    tidy = rounded(
        published,
        "Lead Time Dias",
        "LT Efectivo",
        "Costo Unitario",
    )
    tidy = rounded(tidy, "Demanda Mensual", "Desv Std Mensual", digits=6)
    tidy = rounded(tidy, "Demanda Diaria", digits=8)
    return rounded(tidy, "total_valor_sugerido_clp", digits=2)
