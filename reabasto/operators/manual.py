"""Manual units: active sums, the list with them, and the carts per supplier."""

from __future__ import annotations

from datetime import date, datetime
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.functions.columns import is_true
from reabasto.functions.text import like_any
from reabasto.operators.serving import (
    PAIR,
    Filters,
    enrich_replacements,
    filter_suggestions,
    placed_suggestions,
    rule_stock_without_sale,
    suggestion_condition,
    suggestion_page,
)
from reabasto.params import Params


def is_active(now: datetime) -> Column:
    expires = F.col("expira_en")
    return ~is_true(F.col("archivada")) & (expires.isNull() | (expires > F.lit(now)))


def active_manual_units(manual: DataFrame, now: datetime, q: str | None = None) -> DataFrame:
    """Units per pair still in force; only positive sums."""
    rows = manual.filter(is_active(now))
    if q:
        rows = rows.filter(like_any(q, F.col("producto")))
    return rows.groupBy(*PAIR).agg(F.sum("unidades").alias("manual")).filter("manual > 0")


def with_units(rows: DataFrame, where: Column) -> DataFrame:
    """Units of the column `manual` added to total, net purchase and value, where the condition holds; flags go to Si.

    Where the net purchase is 0 or missing it starts from the total that already holds the
    units, so they count twice there: the published behaviour.
    """
    extra, cost = F.col("manual"), F.col("costo_unitario")
    total = F.coalesce("total_sugerido_suc", F.lit(0.0)) + extra
    net = F.coalesce(F.nullif(F.col("sugerido_compra_neto"), F.lit(0.0)), total) + extra
    value = F.coalesce("total_valor_sugerido_clp", F.lit(0.0)) + extra * cost
    has = extra.isNotNull() & where
    changed = {
        "total_sugerido_suc": F.when(has, total).otherwise(F.col("total_sugerido_suc")),
        "sugerido_compra_neto": F.when(has, net).otherwise(F.col("sugerido_compra_neto")),
        "total_valor_sugerido_clp": F.when(has & (cost != 0), value).otherwise(
            F.col("total_valor_sugerido_clp")
        ),
        "pedir": F.when(has, "Si").otherwise(F.col("pedir")),
        "pedir_flag": F.when(has, "Si").otherwise(F.col("pedir_flag")),
    }
    return rows.withColumns(changed)


def add_manual(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Active units added to the rows of their pair."""
    return with_units(rows.join(units, list(PAIR), "left"), F.lit(True)).drop("manual")


def _catalogue_rows(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(
        "producto",
        F.col("glosa").alias("descripcion"),
        F.col("procedencia").alias("tipo_origen"),
        F.col("unidad").alias("unidad_medida"),
        F.col("costo").alias("costo_unitario"),
        F.col("reemplazo").alias("reemplazos"),
    )


def _known_products(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Products that some suggestion or some of the units are of."""
    return rows.select("producto").unionByName(units.select("producto")).distinct()


def search_rows(
    rows: DataFrame, shown: DataFrame, units: DataFrame, catalogue: DataFrame, stock: DataFrame, q: str
) -> DataFrame:
    """The shown rows, the manual-only rows and the catalogue-only rows of a search, told apart by `origen`.

    One full join of the page with the units marks the first two kinds: pairs that have units and aren't shown
    are manual-only. Catalogue products that match and are in no suggestion nor have
    matching units come with their stock over all branches.
    """
    marked = shown.withColumn("origen", F.lit("sugerido")).join(units, list(PAIR), "full")
    quantity, alone = F.col("manual").cast("double"), F.col("origen").isNull()
    paired = with_units(marked.withColumns({c: F.when(alone, quantity).otherwise(F.col(c)) for c in ("sugerido_compra_neto", "total_sugerido_suc")}), ~alone)
    known = catalogue.join(_known_products(rows, units).withColumn("_conocido", F.lit(True)), "producto", "left")
    entry = known.select(F.struct(*[F.col(c) for c in catalogue.columns], "_conocido").alias("_c")).withColumn("producto", F.col("_c.producto"))
    offered = like_any(q, F.col("producto"), F.col("_c.glosa")) & F.col("_c._conocido").isNull()
    # of the catalogue only the entry of a listed product, or one that is offered, comes out of the second full join
    listed = paired.withColumn("_listado", F.lit(True)).join(entry, "producto", "full").filter(F.col("_listado") | offered)
    fresh = F.col("_listado").isNull()
    from_catalogue = F.col("origen").isNull()
    totals = stock.groupBy("producto").agg(F.sum("stock").alias("_stock"))
    described = {
        "descripcion": "glosa", "tipo_origen": "procedencia", "unidad_medida": "unidad", "costo_unitario": "costo",
    }
    filled = {c: F.when(from_catalogue, F.col(f"_c.{source}")).otherwise(F.col(c)) for c, source in described.items()}
    made = (
        listed.join(totals, "producto", "left")
        .withColumns(filled)
        .withColumns(
            {
                "reemplazos": F.coalesce(F.when(~from_catalogue, F.nullif("reemplazos", F.lit(""))), "_c.reemplazo"),
                "nombre_sucursal": F.when(from_catalogue, F.col("sucursal_id")).otherwise(F.col("nombre_sucursal")),
                "stock_activo_suc": F.when(fresh, F.col("_stock")).otherwise(F.col("stock_activo_suc")),
                "total_valor_sugerido_clp": F.when(from_catalogue & (F.col("costo_unitario") != 0), quantity * F.col("costo_unitario")).otherwise(F.col("total_valor_sugerido_clp")),
                "pedir": F.when(from_catalogue & ~fresh, "Si").otherwise(F.col("pedir")),
                "pedir_flag": F.when(from_catalogue & ~fresh, "Si").otherwise(F.col("pedir_flag")),
            }
        )
        .withColumn("origen", F.when(fresh, "catalogo").when(from_catalogue, "manual").otherwise("sugerido"))
    )
    return made.select(*shown.columns, "origen")


def list_suggestions(
    rows: DataFrame,
    manual: DataFrame,
    catalogue: DataFrame,
    stock: DataFrame,
    monthly_sales: DataFrame,
    f: Filters,
    params: Params,
    now: datetime,
    page: int = 1,
    limit: int = 50,
    sort: str | None = None,
) -> DataFrame:
    """One page with manual units; a search also appends manual-only and catalogue-only
    rows, on every page. `origen` tells the three kinds apart, and they come in that order, the
    first as sorted, the others by product and branch."""
    text = (f.q or "").strip() or None
    units = active_manual_units(manual, now, text)
    shown = placed_suggestions(rows, f, params, page, limit, sort)
    if text:
        listed = search_rows(rows, shown, units, catalogue, stock, text)
    else:
        listed = enrich_replacements(add_manual(shown, units), catalogue).withColumn("origen", F.lit("sugerido"))
    ruled = rule_stock_without_sale(listed, monthly_sales, now.date())
    kind = F.when(F.col("origen") == "sugerido", 0).when(F.col("origen") == "manual", 1).otherwise(2)
    return ruled.orderBy(kind, "pos", *PAIR).drop("pos")


def list_total(
    rows: DataFrame,
    manual: DataFrame,
    catalogue: DataFrame,
    f: Filters,
    params: Params,
    now: datetime,
    page: int = 1,
    limit: int = 50,
    sort: str | None = None,
) -> DataFrame:
    """The total that goes with `list_suggestions`: all matching rows, and with a search the manual-only
    and catalogue-only rows of that page.

    Rows are counted by product, which at once tells the products that are known; one full join with the units and
    the catalogue then gives all but the page, whose pairs are taken off the manual-only ones.
    """
    text = (f.q or "").strip() or None
    if not text:
        return filter_suggestions(rows, f, params).agg(F.count(F.lit(1)).alias("total"))
    matches = is_true(suggestion_condition(f, params))
    units = active_manual_units(manual, now, text)
    own = rows.groupBy("producto").agg(F.count_if(matches).alias("propias"), F.lit(True).alias("_conocido"))
    asked = units.groupBy("producto").agg(F.count(F.lit(1)).alias("manuales"))
    offered = catalogue.filter(like_any(text, F.col("producto"), F.col("glosa"))).select("producto", F.lit(1).alias("ofrecido"))
    counted = own.join(asked, "producto", "full").join(offered, "producto", "full")
    other = F.when(F.col("_conocido").isNull() & F.col("manuales").isNull(), F.col("ofrecido"))
    sums = counted.agg(F.sum(F.coalesce("propias", F.lit(0)) + F.coalesce("manuales", F.lit(0)) + F.coalesce(other, F.lit(0))).alias("n"))
    shown = suggestion_page(rows, f, params, page, limit, sort).select(*PAIR)
    paired = units.join(shown, list(PAIR), "left_semi").agg((-F.count(F.lit(1))).alias("n"))
    return sums.unionByName(paired).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def list_by_ids_with_manual(
    picked: DataFrame,
    manual: DataFrame,
    catalogue: DataFrame,
    monthly_sales: DataFrame,
    now: datetime,
) -> DataFrame:
    """Rows picked by id as the grid shows them, in the picked order."""
    listed = add_manual(picked, active_manual_units(manual, now))
    filled = enrich_replacements(listed, catalogue)
    return rule_stock_without_sale(filled, monthly_sales, now.date()).orderBy("pos")


def suggestion_with_manual(rows: DataFrame, manual: DataFrame, now: datetime) -> DataFrame:
    """Rows with the active units beside the published total."""
    units = manual.filter(is_active(now)).groupBy(*PAIR).agg(F.sum("unidades").alias("_u"))
    extra = F.coalesce("_u", F.lit(0)).cast("long")
    return (
        rows.join(units, list(PAIR), "left")
        .withColumn("ajuste_manual_vigente", extra)
        .withColumn(
            "total_sugerido_con_manual",
            F.coalesce("total_sugerido_suc", F.lit(0.0)) + F.col("ajuste_manual_vigente"),
        )
        .drop("_u")
    )


def cart_lines(
    rows: DataFrame,
    manual: DataFrame,
    catalogue: DataFrame,
    f: Filters,
    params: Params,
    now: datetime,
) -> DataFrame:
    """What to buy of each supplier: one line per product, manual units included.

    Products that only manual entries ask for stand under a label of their own, unless the
    filters narrow supplier, brand, origin or class.
    """
    units = manual.filter(is_active(now)).groupBy(*PAIR).agg(F.sum("unidades").alias("manual"))
    with_alone = not (f.proveedor or f.filtro1 or f.tipo_origen or f.abc)
    own = F.col("_propia")
    quantity = F.coalesce("sugerido_compra_neto", "total_sugerido_suc", F.lit(0.0)) + F.coalesce(
        "manual", F.lit(0)
    )
    bought = is_true(own) & is_true(suggestion_condition(f, params)) & F.col("proveedor").isNotNull()

    def of_bought(column: Column) -> Column:
        return F.when(bought, column)

    # one join of rows and units: units without a row of their pair stay, under no supplier
    paired = rows.withColumn("_propia", F.lit(True)).join(units, list(PAIR), "full" if with_alone else "left")
    lines = paired.groupBy("proveedor", "producto").agg(
        F.max(of_bought(F.col("descripcion"))).alias("descripcion"),
        F.max(of_bought(F.col("clasificacion_abc"))).alias("clasificacion_abc"),
        F.max(of_bought(F.col("costo_unitario"))).alias("costo_unitario"),
        F.sum(of_bought(quantity)).alias("cantidad"),
        is_true(F.bool_or(own)).alias("propio"),
        F.sum(F.when(own.isNull(), F.col("manual"))).cast("double").alias("pedidas"),
    )
    if with_alone:
        listed = F.max("propio").over(Window.partitionBy("producto"))
        alone = ~F.col("listado") & (F.col("pedidas") > 0)
        lines = (
            lines.withColumn("listado", listed)
            .filter(alone | (F.col("propio") & (F.col("cantidad") > 0)))
            .join(_catalogue_rows(catalogue).select("producto", F.col("descripcion").alias("_glosa"), F.col("costo_unitario").alias("_costo")), "producto", "left")
            .select(
                F.when(alone, F.lit(params.no_supplier_label)).otherwise(F.col("proveedor")).alias("proveedor"),
                "producto",
                F.when(alone, F.col("_glosa")).otherwise(F.col("descripcion")).alias("descripcion"),
                "clasificacion_abc",
                F.when(alone, F.nullif(F.col("_costo"), F.lit(0.0))).otherwise(F.col("costo_unitario")).alias("costo_unitario"),
                F.when(alone, F.col("pedidas")).otherwise(F.col("cantidad")).alias("cantidad"),
            )
        )
    else:
        lines = lines.filter("cantidad > 0").drop("propio", "pedidas")
    return lines.withColumn(
        "subtotal_clp", F.col("cantidad") * F.coalesce("costo_unitario", F.lit(0.0))
    )


def cart_report(lines: DataFrame, *levels: tuple[str, ...]) -> DataFrame:
    """Lines, supplier totals and grand totals in one aggregate over grouping sets.

    `nivel` is 0 on a line, 1 on a supplier's total, 2 on the grand total; sums and the number of lines. `levels` names the sets wanted, all three by default. Totals are summed on the map
    side, so a supplier that holds a third of all lines is one row of each task.
    """
    wanted = levels or (("proveedor", "producto"), ("proveedor",), ())
    keys = [F.col("proveedor"), F.col("producto")]
    sets = [[F.col(c) for c in level] for level in wanted]
    # a line per product: on its own level every max is the line's own value
    single = lambda c: F.when(F.grouping("producto") == 0, F.max(c)).alias(c)
    made = lines.groupingSets(sets, *keys).agg(
        (F.grouping("proveedor") + F.grouping("producto")).cast("int").alias("nivel"),
        single("descripcion"),
        single("clasificacion_abc"),
        single("costo_unitario"),
        F.coalesce(F.sum("cantidad"), F.lit(0.0)).alias("cantidad"),
        F.coalesce(F.sum("subtotal_clp"), F.lit(0.0)).alias("subtotal_clp"),
        F.count(F.lit(1)).alias("n_productos"),
    )
    return made.select("nivel", "proveedor", "producto", "descripcion", "clasificacion_abc", "costo_unitario", "cantidad", "subtotal_clp", "n_productos")


def cart_totals(lines: DataFrame) -> DataFrame:
    """One row per supplier, largest value first. Lines stay flat: a supplier may hold a
    large part of them, so they are never gathered into one row."""
    return (
        lines.groupBy("proveedor")
        .agg(
            F.count(F.lit(1)).alias("n_productos"),
            F.sum("cantidad").alias("total_unidades"),
            F.sum("subtotal_clp").alias("total_clp"),
        )
        .orderBy(F.col("total_clp").desc(), "proveedor")
    )


def cart_grand_totals(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.countDistinct("proveedor").alias("total_proveedores"),
        F.coalesce(F.sum("subtotal_clp"), F.lit(0.0)).alias("total_clp"),
        F.coalesce(F.sum("cantidad"), F.lit(0.0)).alias("total_unidades"),
    )


def sorted_cart_lines(lines: DataFrame) -> DataFrame:
    """Suppliers by value, inside each the lines by subtotal: one distributed sort."""
    totals = lines.groupBy("proveedor").agg(F.sum("subtotal_clp").alias("_total"))
    return (
        lines.join(totals, "proveedor")
        .orderBy(F.col("_total").desc(), "proveedor", F.col("subtotal_clp").desc(), "producto")
        .drop("_total")
    )


def purchase_orders(lines: DataFrame, supplier: str | None = None) -> DataFrame:
    """Order lines with the supplier's total as its last line (`renglon` 1 after 0)."""
    kept = lines if supplier is None else lines.filter(F.col("proveedor") == supplier)
    total = F.col("nivel") == 1
    line = lambda c: F.when(~total, F.col(c))
    return cart_report(kept, ("proveedor", "producto"), ("proveedor",)).select(
        "proveedor",
        F.col("nivel").alias("renglon"),
        F.when(total, "TOTAL").otherwise(F.col("producto")).alias("Producto"),
        F.col("descripcion").alias("Descripcion"),
        F.col("clasificacion_abc").alias("ABC"),
        line("cantidad").alias("Cantidad"),
        F.col("costo_unitario").alias("Costo Unitario"),
        F.col("subtotal_clp").alias("Subtotal"),
    )


def write_purchase_orders(orders: DataFrame, path: str) -> None:
    """One folder per supplier; a supplier with many lines is spread over several files."""
    (
        orders.repartitionByRange("proveedor", "renglon", "Producto")
        .sortWithinPartitions("proveedor", "renglon", F.col("Subtotal").desc())
        .write.mode("overwrite")
        .partitionBy("proveedor")
        .option("header", True)
        .csv(path)
    )
