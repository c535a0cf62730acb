"""Clean sales and sale-frequency classes.

The sales table is the large input, so it is reduced first: one row per product, branch
and month, summed on the map side. Products are renamed to their group head only after
that, so the lookup never shuffles raw lines and a product that holds a third of them
costs no more than its months and branches.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.functions.columns import is_true, literal_rows
from reabasto.functions.months import month_key, window_months, window_start
from reabasto.params import Params

PAIR = ("producto_master", "sucursal_final")


def final_branch(branch: str, mobile: bool, params: Params) -> str:
    """Mobile sales of one branch apart, merged branches together, special ones to the CD."""
    if mobile and branch == params.mobile_branch:
        merged = params.mobile_branch_final
    else:
        merged = params.branch_merges.get(branch, branch)
    return params.cd_id if merged in params.cd_special_branches else merged


def branch_lookup(spark: SparkSession, params: Params) -> DataFrame:
    """Branches as sold from (and whether by a mobile sale) to the final one, null where that is excluded.

    Holds only those that the parameters name; any other branch is its own final one.
    """
    named = {params.mobile_branch, *params.branch_merges, *params.cd_special_branches, *params.excluded_branches}
    rows = []
    for branch in sorted(named):
        for mobile in (False, True):
            final = final_branch(branch, mobile, params)
            rows.append((branch, mobile, None if final in params.excluded_branches else final))
    found = literal_rows(spark, "SUCURSAL, _movil, _final", rows)
    return found.select("SUCURSAL", "_movil", F.col("_final").cast("string"), F.lit(True).alias("_nombrada"))


def _master_lookup(mapping: DataFrame) -> DataFrame:
    """One head per product; a repeated product takes the smallest head."""
    return mapping.groupBy("Producto").agg(F.min("Producto_Master").alias("_cabeza"))


def _to_masters(rows: DataFrame, mapping: DataFrame, dim_product: DataFrame, params: Params):
    """Head of each product; excluded heads and products of excluded categories dropped."""
    excluded = dim_product.filter(F.col("Categoria").isin(*params.excluded_categories)).select(
        "Producto"
    )
    return (
        rows.join(excluded, "Producto", "left_anti")
        .join(_master_lookup(mapping), "Producto", "left")
        .withColumn("producto_master", F.coalesce("_cabeza", "Producto"))
        .drop("_cabeza")
        .filter(~F.col("producto_master").isin(*params.excluded_products))
    )


def _kept_lines(sales: DataFrame, params: Params) -> DataFrame:
    """Lines with their final branch, looked up by a join: as an expression it would be repeated in
    filter and keys for every line, more code than gets compiled."""
    marked = sales.withColumn("_movil", is_true(F.col("TipoVenta") == params.mobile_sale_type))
    lookup = branch_lookup(sales.sparkSession, params)
    final = F.when(F.col("_nombrada"), F.col("_final")).otherwise(F.col("SUCURSAL"))
    return (
        marked.filter(F.col("Producto").isNotNull() & F.col("SUCURSAL").isNotNull())
        .join(lookup, ["SUCURSAL", "_movil"], "left")
        .withColumn("sucursal_final", final)
        .filter(F.col("sucursal_final").isNotNull())
        .drop("_movil", "_final", "_nombrada")
    )


def prepare_sales(
    sales: DataFrame, mapping: DataFrame, dim_product: DataFrame, params: Params
) -> DataFrame:
    """Sales line by line with group head, final branch and month `YYYYMM`."""
    lines = _to_masters(_kept_lines(sales, params), mapping, dim_product, params)
    return lines.withColumn("mes", month_key(F.col("Fecha")).cast("string"))


def monthly_cube(
    sales: DataFrame, mapping: DataFrame, dim_product: DataFrame, params: Params
) -> DataFrame:
    """Sales reduced to product, final branch and month, then renamed to the group head.

    `vendio` tells whether any line was positive; `de_frontera` and `de_principal` which
    company sold.
    """
    quantity, source = F.col("CantidadAjustada"), F.col("Fuente")
    cube = (
        _kept_lines(sales, params)
        .groupBy("Producto", "sucursal_final", month_key(F.col("Fecha")).alias("mes"))
        .agg(
            F.sum(quantity).alias("total"),
            is_true(F.bool_or(quantity > 0)).alias("vendio"),
            is_true(F.bool_or(source == params.source_border)).alias("de_frontera"),
            is_true(F.bool_or(source == params.source_main)).alias("de_principal"),
        )
    )
    return _to_masters(cube, mapping, dim_product, params)


def _monthly_totals(months: list[int]) -> Column:
    """Aggregate: the totals of the given months in order, 0 where there is none."""
    return F.array(
        *[
            F.coalesce(F.sum(F.when(F.col("mes") == m, F.col("total"))), F.lit(0)).cast("double")
            for m in months
        ]
    )


def dense_monthly_series(
    totals: DataFrame, keys: tuple[str, ...], months: list[int], name: str = "serie"
) -> DataFrame:
    """One row per key with its dense monthly series."""
    return totals.groupBy(*keys).agg(_monthly_totals(months).alias(name))


def frequency_class(short: Column, mid: Column, long: Column, params: Params) -> Column:
    """Class by the number of months with a sale in the last 3, 6 and 12."""
    at_c = mid == params.months_c
    recent = short >= params.recent_months_c
    return (
        F.when(mid >= params.months_a, F.lit("A"))
        .when(mid == params.months_b, F.lit("B"))
        .when(at_c & recent, F.lit("C"))
        .when((long > params.long_months_c) & at_c & ~recent, F.lit("C"))
        .otherwise(F.lit("D"))
    )


def _months_since(months: Column, start: int) -> Column:
    return F.size(F.filter(months, lambda m: m >= start)).cast("long")


def pair_frame(cube: DataFrame, closed_month: date, params: Params) -> DataFrame:
    """One row per group head and branch.

    Holds the dense series of the closed months, the set of months with a sale, and the
    company flags over all loaded months: one aggregate feeds classes and demand alike.
    Pairs sold only before the window stay, marked by `en_ventana`, until `add_cd_rows`:
    a made centre row takes its company flags from them.
    """
    months = window_months(closed_month, params.window_long)
    start = window_start(closed_month, params.window_long)
    counted = F.col("vendio") & (F.col("mes") >= start)
    in_window = F.col("mes") >= start
    if params.closed_months_only:
        counted = counted & (F.col("mes") <= months[-1])
        in_window = in_window & (F.col("mes") <= months[-1])
    return cube.groupBy(*PAIR).agg(
        _monthly_totals(months).alias("serie"),
        F.collect_set(F.when(counted, F.col("mes"))).alias("meses"),
        F.bool_or(in_window).alias("en_ventana"),
        F.bool_or("de_frontera").alias("de_frontera"),
        F.bool_or("de_principal").alias("de_principal"),
    )


def classify(pairs: DataFrame, closed_month: date, params: Params) -> DataFrame:
    """Months with a sale and class, for the pair and for the group head as a whole."""
    by_master = Window.partitionBy("producto_master")
    starts = {
        "3": window_start(closed_month, params.window_short),
        "6": window_start(closed_month, params.window_mid),
        "12": window_start(closed_month, params.window_long),
    }
    whole = F.array_distinct(F.flatten(F.collect_list("meses").over(by_master)))
    counted = pairs.withColumn("_meses_agg", whole)
    counted = counted.withColumns(
        {f"m{n}": _months_since(F.col("meses"), s) for n, s in starts.items()}
        | {f"m{n}a": _months_since(F.col("_meses_agg"), s) for n, s in starts.items()}
    ).drop("_meses_agg", "meses")
    return counted.withColumns(
        {
            "clasificacion_abc": frequency_class(F.col("m3"), F.col("m6"), F.col("m12"), params),
            "clasificacion_abc_agregada": frequency_class(
                F.col("m3a"), F.col("m6a"), F.col("m12a"), params
            ),
        }
    )


def is_routed_tail(params: Params) -> Column:
    """Slow in its branch, fast as a whole: supplied through the distribution centre."""
    return F.col("clasificacion_abc").isin(*params.tail_classes) & F.col(
        "clasificacion_abc_agregada"
    ).isin(*params.buying_classes)


def add_cd_rows(pairs: DataFrame, params: Params) -> DataFrame:
    """A distribution-centre row for every head that has a routed tail and no such row.

    The row is made next to the head's first row, so the classified frame is read once.
    """
    by_master = Window.partitionBy("producto_master")
    at_cd, current = F.col("sucursal_final") == params.cd_id, F.col("en_ventana")
    first = by_master.orderBy(F.col("en_ventana").desc(), "sucursal_final")
    marked = pairs.withColumns(
        {
            "_falta_cd": F.bool_or(current & is_routed_tail(params)).over(by_master)
            & ~F.bool_or(current & at_cd).over(by_master),
            "_primera": F.row_number().over(first) == 1,
            "_frontera": F.bool_or(at_cd & F.col("de_frontera")).over(by_master),
            "_principal": F.bool_or(at_cd & F.col("de_principal")).over(by_master),
        }
    ).filter("en_ventana")
    blank = {
        "sucursal_final": F.lit(params.cd_id),
        "m3": F.lit(0),
        "m6": F.lit(0),
        "m12": F.lit(0),
        "clasificacion_abc": F.lit("D"),
        "serie": F.transform("serie", lambda _: F.lit(0.0)),
        "de_frontera": F.col("_frontera"),
        "de_principal": F.col("_principal"),
    }
    copies = F.when(
        F.col("_falta_cd") & F.col("_primera"), F.array(F.lit(False), F.lit(True))
    ).otherwise(F.array(F.lit(False)))
    # The head stays an untouched column, so the layout by head survives the explode.
    return (
        marked.withColumn("_hecha", F.explode(copies))
        .withColumns(
            {c: F.when(F.col("_hecha"), made).otherwise(F.col(c)) for c, made in blank.items()}
        )
        .select(*[c for c in pairs.columns if c != "en_ventana"])
    )


def abc(
    sales: DataFrame,
    mapping: DataFrame,
    dim_product: DataFrame,
    closed_month: date,
    params: Params,
) -> DataFrame:
    """Classified pairs with their monthly series, distribution-centre rows included."""
    cube = monthly_cube(sales, mapping, dim_product, params)
    pairs = classify(pair_frame(cube, closed_month, params), closed_month, params)
    return add_cd_rows(pairs, params)
