"""Supplier, lead time and supply route of every pair."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reabasto.functions.columns import is_true, map_value, yes_no
from reabasto.operators.abc_class import is_routed_tail
from reabasto.params import Params

SUPPLIER = "Razon Social Proveedor"
# Interpolated cuts can land a hair under the whole day they stand for.
CUT_SLACK = 1e-9


def _is_replenishment(params: Params) -> Column:
    return (F.col("Origen") != params.origin_national) | (
        F.lower(F.col("Motivo")) == params.reason_replenish
    )


def order_days(tracking: DataFrame, keys: tuple[str, ...], params: Params) -> DataFrame:
    """Orders counted by key and days from order to receipt: all that the percentile, the
    mean and the choice of cut need, and a few rows per key however many orders it has."""
    national = F.col("Origen") == params.origin_national
    replenish = F.lower(F.col("Motivo")) == params.reason_replenish
    short = F.col("dias") < params.lead_time_cap
    valid = (~national | replenish) & ((F.col("Origen") == params.origin_imported) | short)
    return (
        tracking.filter(F.col("FechaPE") >= F.col("FechaOC"))
        .withColumn("dias", F.datediff("FechaPE", "FechaOC"))
        .groupBy(*keys, "dias")
        .agg(
            F.count_if(valid).alias("validas"),
            F.count_if(national & replenish & short).alias("nacionales"),
            F.count_if(~national).alias("otras"),
        )
    )


def lead_time_from_days(days: DataFrame, keys: tuple[str, ...], params: Params) -> DataFrame:
    """Mean days of the orders at or under the percentile cut, and how many they are.

    The cut is the lower percentile where national replenishment orders outnumber the
    foreign ones. Groups without a valid order are absent; a null key is a group.
    """
    cuts = F.array(F.lit(params.cut_national), F.lit(params.cut_other))
    grouped = days.groupBy(*keys).agg(
        F.percentile("dias", cuts, F.col("validas")).alias("cortes"),
        F.collect_list(
            F.when(F.col("validas") > 0, F.struct(F.col("dias"), F.col("validas").alias("n")))
        ).alias("histograma"),
        (F.sum("nacionales") > F.sum("otras")).alias("manda_nacional"),
    )
    cut = F.when(F.col("manda_nacional"), F.get("cortes", F.lit(0))).otherwise(
        F.get("cortes", F.lit(1))
    )
    under = F.filter("histograma", lambda h: h["dias"] <= F.col("corte") + CUT_SLACK)
    zero = F.struct(F.lit(0).cast("long").alias("suma"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(
        "bajo_corte",
        zero,
        lambda a, h: F.struct(
            (a["suma"] + h["dias"] * h["n"]).alias("suma"), (a["n"] + h["n"]).alias("n")
        ),
    )
    return (
        grouped.filter(F.size("histograma") > 0)
        .withColumn("corte", cut)
        .withColumn("bajo_corte", under)
        .withColumn("t", total)
        .select(
            *keys,
            (F.col("t.suma") / F.col("t.n")).alias("Lead Time Dias"),
            F.col("t.n").alias("N Muestras"),
        )
    )


def lead_time_by(tracking: DataFrame, keys: tuple[str, ...], params: Params) -> DataFrame:
    return lead_time_from_days(order_days(tracking, keys, params), keys, params)


def lead_time_supplier(tracking: DataFrame, params: Params) -> DataFrame:
    table = lead_time_by(tracking, ("RazonSocial",), params)
    return table.withColumnRenamed("RazonSocial", SUPPLIER).drop("N Muestras")


def _known_place(params: Params) -> Column:
    return (F.col("SucursalID") != params.unknown_branch) & F.col("RazonSocial").isNotNull()


def lead_time_supplier_branch(tracking: DataFrame, params: Params) -> DataFrame:
    table = lead_time_by(
        tracking.filter(_known_place(params)), ("RazonSocial", "SucursalID"), params
    )
    return table.withColumnRenamed("RazonSocial", SUPPLIER)


def supplier_lookup(lt_supplier: DataFrame, lt_supplier_branch: DataFrame) -> DataFrame:
    """One row per supplier from the two ready tables: its overall days and, by branch, the
    days of branches with samples."""
    by_branch = (
        lt_supplier_branch.filter((F.col("N Muestras") >= 1) & F.col("SucursalID").isNotNull())
        .groupBy(SUPPLIER, "SucursalID")
        .agg(F.max("Lead Time Dias").alias("dias"))
        .select(SUPPLIER, F.col("SucursalID").alias("sucursal"), "dias")
    )
    overall = lt_supplier.select(SUPPLIER, F.lit(None).cast("string").alias("sucursal"), F.col("Lead Time Dias").alias("dias"))
    return _fold_branches(overall.unionByName(by_branch))


def supplier_lookup_from_tracking(tracking: DataFrame, params: Params) -> DataFrame:
    """The same lookup computed from the orders in one pass over them.

    Each counted day goes to the supplier as a whole and, where the branch is known, to
    the branch too, after the orders are already counted.
    """
    keys = ("RazonSocial", "SucursalID")
    everywhere = F.lit(None).cast("string")
    places = F.when(_known_place(params), F.array(everywhere, F.col("SucursalID"))).otherwise(
        F.array(everywhere)
    )
    days = order_days(tracking.filter(F.col("RazonSocial").isNotNull()), keys, params)
    both = days.withColumn("SucursalID", F.explode(places))
    table = lead_time_from_days(both, keys, params)
    return _fold_branches(
        table.select(
            F.col("RazonSocial").alias(SUPPLIER),
            F.col("SucursalID").alias("sucursal"),
            F.col("Lead Time Dias").alias("dias"),
        )
    )


def _fold_branches(table: DataFrame) -> DataFrame:
    """Rows (supplier, branch or null, days) to one row per supplier; branches per supplier
    are bounded by the branch dimension."""
    entry = F.when(F.col("sucursal").isNotNull(), F.struct("sucursal", "dias"))
    return (
        table.filter(F.col(SUPPLIER).isNotNull())
        .groupBy(F.col(SUPPLIER).alias("proveedor_lt"))
        .agg(
            F.max(F.when(F.col("sucursal").isNull(), F.col("dias"))).alias("lt_global"),
            F.map_from_entries(F.collect_list(entry)).alias("lt_por_sucursal"),
        )
    )


# Largest order number the latest-order key leaves room for.
ORDER_NUMBERS = "1e19"


def order_suppliers(tracking: DataFrame, params: Params, pending: Column | None = None) -> DataFrame:
    """Per product and branch: smallest supplier name among replenishment orders, among all
    orders, and the supplier of the latest dated replenishment order; with `pending`, also the
    units (`en_camino`) of the orders it holds for, in the same pass.

    Orders are first counted down to one row per product, branch and supplier. That step
    keeps numbers only (the order key is day and order number as one decimal), so it hashes;
    the texts are compared on what is left, a few suppliers per product.
    """
    name = F.col("RazonSocial")
    day = F.unix_date("FechaOC").cast("decimal(10,0)")
    number = F.coalesce(F.col("NOC"), F.lit(-1)).cast("decimal(20,0)")
    key = day * F.lit(ORDER_NUMBERS).cast("decimal(20,0)") + number
    replenish = is_true(_is_replenishment(params))
    wanted = F.col("Producto").isNotNull() & (name.isNotNull() if pending is None else name.isNotNull() | pending)
    units = [] if pending is None else [F.sum(F.when(pending, F.col("Cantidad"))).alias("en_camino")]
    per_supplier = (
        tracking.filter(wanted)
        .groupBy("Producto", "SucursalID", "RazonSocial")
        .agg(
            F.bool_or(replenish).alias("repone"),
            F.max(F.when(replenish, key)).alias("orden"),
            *units,
        )
    )
    sortable = F.when(name.isNotNull(), F.struct(F.lower(name).alias("clave"), name.alias("nombre")))
    recent = F.struct(F.col("orden"), name.alias("nombre"))
    return per_supplier.groupBy("Producto", "SucursalID").agg(
        F.min(F.when(F.col("repone"), sortable)).alias("filtrado"),
        F.min(sortable).alias("todo"),
        F.max(F.when(F.col("orden").isNotNull() & name.isNotNull(), recent)).alias("reciente"),
        *([F.sum("en_camino").alias("en_camino")] if units else []),
    )


def product_suppliers(tracking: DataFrame, params: Params, pending: Column | None = None) -> DataFrame:
    """The same folded to one row per product: branch entries in maps, overall names aside."""
    here = F.col("SucursalID").isNotNull()
    entry = F.struct(
        F.col("SucursalID"),
        F.struct(
            F.col("filtrado.nombre").alias("filtrado"),
            F.col("todo.nombre").alias("todo"),
            F.col("reciente.nombre").alias("reciente"),
        ),
    )
    coming = F.when(here & F.col("en_camino").isNotNull(), F.struct("SucursalID", "en_camino"))
    maps = {"proveedores": F.when(here, entry)} | ({} if pending is None else {"en_camino": coming})
    return (
        order_suppliers(tracking, params, pending)
        .groupBy(F.col("Producto").alias("producto_master"))
        .agg(
            *[F.map_from_entries(F.collect_list(e)).alias(n) for n, e in maps.items()],
            F.min("filtrado").getField("nombre").alias("prov_global"),
            F.min("todo").getField("nombre").alias("prov_global_todo"),
        )
    )


def assign_supplier(
    pairs: DataFrame, tracking: DataFrame, params: Params, pending: Column | None = None
) -> DataFrame:
    """`proveedor_lt` deduced from the names, `proveedor` from the latest order first."""
    here = F.try_element_at("proveedores", F.col("sucursal_final"))
    return (
        pairs.join(product_suppliers(tracking, params, pending), "producto_master", "left")
        .withColumn("_aqui", here)
        .withColumn(
            "proveedor_lt",
            F.coalesce("_aqui.filtrado", "prov_global", "_aqui.todo", "prov_global_todo"),
        )
        .withColumn("proveedor", F.coalesce("_aqui.reciente", "proveedor_lt"))
        .drop("proveedores", "prov_global", "prov_global_todo", "_aqui")
    )


def is_pending(today: date, params: Params) -> Column:
    """Whether an order is valid and still on its way; never null."""
    origin, reason = F.lower(F.col("Origen")), F.lower(F.col("Motivo"))
    ordered = F.datediff(F.lit(today), F.col("FechaOC"))
    documented = F.datediff(F.lit(today), F.col("FechaDoc"))
    national = (
        (origin == params.origin_national.lower())
        & (reason == params.reason_replenish)
        & (ordered <= params.transit_days_national)
    )
    imported = (origin == params.origin_imported.lower()) & (
        ordered <= params.transit_days_imported
    )
    main = (
        (F.lower(F.col("EstadoOC")) == params.state_pending)
        & F.col("FechaOC").isNotNull()
        & (national | imported)
    )
    border = (
        (origin == params.origin_border.lower())
        & (F.lower(F.col("EstadoDoc")) == params.state_pending)
        & (documented <= params.transit_days_border)
    )
    return is_true(main) | is_true(border)


def cd_days(branch: Column, region: Column, params: Params) -> Column:
    return F.coalesce(
        map_value(branch, params.cd_days_special),
        F.when(region == params.home_region, F.lit(params.cd_days_home_region)),
        F.lit(params.cd_days_other),
    ).cast("int")


def lead_time(
    pairs: DataFrame,
    tracking: DataFrame,
    lt_lookup: DataFrame,
    dim_branch: DataFrame,
    imported: DataFrame,
    params: Params,
    today: date | None = None,
) -> DataFrame:
    """Supplier, its days, days from the centre, route and effective days of every pair.

    With `today` the orders are those with states and quantities, and the units on the way come
    out of the same pass over them as `en_camino`, a map by branch.
    """
    pending = None if today is None else is_pending(today, params)
    spec = F.try_element_at("lt_por_sucursal", F.col("sucursal_final"))
    regions = dim_branch.select(F.col("SucursalID").alias("sucursal_final"), "Region")
    marked = imported.select(F.col("Producto").alias("producto_master")).distinct()
    at_cd = F.col("sucursal_final") == params.cd_id
    return (
        assign_supplier(pairs, tracking, params, pending)
        .join(marked.withColumn("_importado", F.lit(True)), "producto_master", "left")
        .join(lt_lookup, "proveedor_lt", "left")
        .join(regions, "sucursal_final", "left")
        .withColumn("_espec", spec)
        .withColumns(
            {
                "lead_time_dias": F.coalesce(
                    "_espec", "lt_global", F.lit(float(params.lead_time_fallback))
                ),
                "lt_origen": F.when(F.col("_espec").isNotNull(), "Por sucursal")
                .when(F.col("lt_global").isNotNull(), "Global proveedor")
                .otherwise(f"Fallback {params.lead_time_fallback} dias"),
                "lt_cd_a_sucursal_dias": cd_days(F.col("sucursal_final"), F.col("Region"), params),
                "es_importado": is_true(F.col("_importado")),
            }
        )
        .withColumn(
            "abastece_cd",
            yes_no(F.col("es_importado") | (~at_cd & is_routed_tail(params))),
        )
        .withColumn(
            "lt_efectivo",
            F.when(
                F.col("abastece_cd") == "Si", F.col("lt_cd_a_sucursal_dias").cast("double")
            ).otherwise(F.col("lead_time_dias")),
        )
        .drop("_importado", "_espec", "lt_por_sucursal", "lt_global", "Region")
    )
