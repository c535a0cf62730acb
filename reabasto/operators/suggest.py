"""Safety stock, stock at hand and on the way, and the suggested quantity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reabasto.functions.columns import is_true, map_value, round_half_up, yes_no
from reabasto.operators.leadtime import is_pending
from reabasto.params import Params


def _order_cycle(params: Params) -> Column:
    return F.when(F.col("abastece_cd") == "Si", F.lit(params.cycle_days_cd)).otherwise(
        F.lit(params.cycle_days)
    )


def _own_class(params: Params) -> Column:
    """The class that counts: the overall one on the centre's row, the local one elsewhere."""
    return F.when(
        F.col("sucursal_final") == params.cd_id, F.col("clasificacion_abc_agregada")
    ).otherwise(F.col("clasificacion_abc"))


def safety_stock(pairs: DataFrame, params: Params) -> DataFrame:
    klass = _own_class(params)
    usual = map_value(klass, params.z_by_class, F.lit(0.0))
    imported_via_cd = (F.col("abastece_cd") == "Si") & F.col("es_importado")
    z = F.when(
        imported_via_cd, F.coalesce(map_value(klass, params.z_imported_via_cd), usual)
    ).otherwise(usual)
    span = (F.col("lt_efectivo") + _order_cycle(params)) / params.working_days
    units = round_half_up(z * F.col("desv_std_mensual") * F.sqrt(span))
    return pairs.withColumn("stock_seguridad", units.cast("long"))


def replacement_members(products: DataFrame, mapping: DataFrame) -> DataFrame:
    """(head, member): each head itself and every product mapped to it."""
    heads = products.select("producto_master").distinct()
    own = heads.withColumn("miembro", F.col("producto_master"))
    mapped = mapping.select(
        F.col("Producto_Master").alias("producto_master"), F.col("Producto").alias("miembro")
    ).join(heads, "producto_master", "left_semi")
    return own.unionByName(mapped).distinct()


def _stock_sums(stock: DataFrame, stock_border: DataFrame | None, mapping: DataFrame) -> DataFrame:
    """Stock summed per product and branch, then once for the product and once for its head.

    A product with many warehouse rows reaches the group lookup as one row per branch.
    `propio` marks the product's own rows, `hay` branches where some row of it is positive.
    """
    columns = ["Producto", "SucursalID", "Stock"]
    rows = stock.select(*columns)
    if stock_border is not None:
        rows = rows.unionByName(stock_border.select(*columns))
    per_product = rows.groupBy("Producto", "SucursalID").agg(
        F.sum("Stock").alias("Stock"), is_true(F.max("Stock") > 0).alias("hay")
    )
    targets = mapping.select(
        "Producto", F.explode(F.array("Producto", "Producto_Master")).alias("cabeza")
    ).distinct()
    return per_product.join(targets, "Producto", "left").select(
        F.coalesce("cabeza", "Producto").alias("producto_master"),
        F.col("SucursalID").alias("sucursal_final"),
        "Stock",
        (F.col("hay") & (F.coalesce("cabeza", "Producto") == F.col("Producto"))).alias("propio"),
    )


def active_stock(stock: DataFrame, stock_border: DataFrame | None, mapping: DataFrame) -> DataFrame:
    """Stock of both companies per head and branch; a mapped product counts for its heads and for itself."""
    sums = _stock_sums(stock, stock_border, mapping)
    return sums.groupBy("producto_master", "sucursal_final").agg(F.sum("Stock").alias("stock_activo"))


def in_transit(tracking: DataFrame, today: date, params: Params) -> DataFrame:
    """Units on valid pending orders per product and branch; replacements do not pool."""
    return (
        tracking.filter(is_pending(today, params))
        .groupBy(
            F.col("Producto").alias("producto_master"), F.col("SucursalID").alias("sucursal_final")
        )
        .agg(F.sum("Cantidad").alias("stock_transito"))
    )


def by_branch_map(frame: DataFrame, value: Column, name: str) -> DataFrame:
    """Rows (head, branch, value) to one row per head with a branch map.

    The frame holds one row per head and branch, so a map is no larger than the branch
    dimension; every later need (own stock, centre stock, pivot, lateral text) reads it.
    """
    entry = F.struct("sucursal_final", value)
    return (
        frame.filter(F.col("producto_master").isNotNull() & F.col("sucursal_final").isNotNull())
        .groupBy("producto_master")
        .agg(F.map_from_entries(F.collect_list(entry)).alias(name))
    )


def attach_stock(
    pairs: DataFrame,
    stock: DataFrame,
    stock_border: DataFrame | None,
    tracking_transit: DataFrame | None,
    mapping: DataFrame,
    dim_branch: DataFrame,
    today: date,
    params: Params,
) -> DataFrame:
    """Branch maps of stock (with branch names) and of units on the way, by head, and whether the
    head has stock of its own at the centre.

    `stock_border` is None where `stock` holds both companies, `tracking_transit` where the pairs
    already have the units on the way.
    """
    names = dim_branch.select(F.col("SucursalID").alias("sucursal_final"), "Nombre")
    at_cd = F.col("sucursal_final") == params.cd_id
    stocked = (
        _stock_sums(stock, stock_border, mapping)
        .groupBy("producto_master", "sucursal_final")
        .agg(F.sum("Stock").alias("stock"), F.bool_or(F.col("propio") & at_cd).alias("en_cd"))
        .join(names, "sucursal_final", "left")
    )
    entry = F.struct("sucursal_final", F.struct("stock", F.col("Nombre").alias("nombre")))
    held = (
        stocked.filter(F.col("producto_master").isNotNull() & F.col("sucursal_final").isNotNull())
        .groupBy("producto_master")
        .agg(
            F.map_from_entries(F.collect_list(entry)).alias("existencias"),
            F.bool_or("en_cd").alias("tiene_stock_cd"),
        )
    )
    rows = pairs.join(held, "producto_master", "left")
    if tracking_transit is None:
        return rows
    coming = by_branch_map(
        in_transit(tracking_transit, today, params), F.col("stock_transito"), "en_camino"
    )
    return rows.join(coming, "producto_master", "left")


def suggestion(pairs: DataFrame, params: Params) -> DataFrame:
    """Suggested units, the need without the class gate, reorder point and order flag."""
    branch = F.col("sucursal_final")
    stocked = pairs.withColumns(
        {
            "stock_activo": F.coalesce(
                F.try_element_at("existencias", branch).getField("stock"), F.lit(0)
            ),
            "stock_transito": F.coalesce(F.try_element_at("en_camino", branch), F.lit(0)),
        }
    ).drop("en_camino")
    daily, days = F.col("demanda_diaria"), F.col("lt_efectivo")
    safety = F.coalesce("stock_seguridad", F.lit(0))
    gross = daily * (_order_cycle(params) + days) + safety - F.col("stock_activo") - F.col(
        "stock_transito"
    )
    need = F.when(
        daily.isNotNull(), F.greatest(round_half_up(gross).cast("double"), F.lit(0.0))
    ).otherwise(0.0)
    buys = is_true(_own_class(params).isin(*params.buying_classes))
    return (
        stocked.withColumns(
            {
                "necesidad_bruta": need,
                "punto_pedido": round_half_up(daily * days + safety).cast("double"),
            }
        )
        .withColumn("sugerido", F.when(buys, F.col("necesidad_bruta")).otherwise(0.0))
        .withColumn("pedir", yes_no(F.col("sugerido") > 0))
    )
