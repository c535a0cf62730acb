"""Descriptive columns of the output contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.functions import text as T
from reabasto.functions.columns import is_true, map_value
from reabasto.operators.abc_class import is_routed_tail
from reabasto.params import Params


def branch_names(pairs: DataFrame, dim_branch: DataFrame, params: Params) -> DataFrame:
    names = dim_branch.select(F.col("SucursalID").alias("sucursal_final"), F.col("Nombre").alias("_nombre"))
    branch = F.col("sucursal_final")
    return (
        pairs.join(names, "sucursal_final", "left")
        .withColumn(
            "nombre_sucursal",
            F.coalesce("_nombre", map_value(branch, params.branch_name_fallback), branch),
        )
        .drop("_nombre")
    )


def company(from_border: Column, from_main: Column, params: Params) -> Column:
    return (
        F.when(from_border & ~from_main, F.lit(f"Solo {params.source_border}"))
        .when(from_border, F.lit("Ambas"))
        .otherwise(F.lit(f"Solo {params.source_main}"))
    )


def replacements(mapping: DataFrame) -> DataFrame:
    """The other members of each group as one text, in code order."""
    return (
        mapping.filter(F.col("Producto") != F.col("Producto_Master"))
        .groupBy(F.col("Producto_Master").alias("producto_master"))
        .agg(F.array_join(F.array_sort(F.collect_list("Producto")), ", ").alias("reemplazos"))
    )


def cd_sources(pairs: DataFrame, params: Params) -> DataFrame:
    """On the centre's row of a fast head: the branches whose tail it buys for."""
    by_master = Window.partitionBy("producto_master")
    at_cd = F.col("sucursal_final") == params.cd_id
    tail = F.when(~at_cd & is_routed_tail(params), F.col("sucursal_final"))
    listed = F.array_sort(F.collect_list(tail).over(by_master))
    fast = F.col("clasificacion_abc_agregada").isin(*params.buying_classes)
    return pairs.withColumn(
        "sucursales_origen_cd",
        F.when(at_cd & fast & (F.size(listed) > 0), F.array_join(listed, ", ")),
    )


def stock_pivot(pairs: DataFrame, params: Params) -> DataFrame:
    """One column per fixed branch, read from the stock map."""
    return pairs.withColumns(
        {
            f"Stock {branch}": F.try_element_at("existencias", F.lit(branch)).getField("stock")
            for branch in params.stock_columns
        }
    )


def products_in_cd(stock: DataFrame, stock_border: DataFrame, params: Params) -> DataFrame:
    """Codes with stock of their own at the centre in either company."""
    columns = ["Producto", "SucursalID", "Stock"]
    return (
        stock.select(*columns)
        .unionByName(stock_border.select(*columns))
        .filter((F.col("SucursalID") == params.cd_id) & (F.col("Stock") > 0))
        .select(F.col("Producto").alias("producto_master"))
        .distinct()
        .withColumn("tiene_stock_cd", F.lit(True))
    )


def catalogue_columns(catalogue: DataFrame) -> DataFrame:
    """One catalogue row per code; a repeated code takes its smallest row."""
    row = F.struct(
        F.col("Descripcion").alias("descripcion_cat"),
        F.col("FILTRO1_Final").alias("filtro1_cat"),
        F.col("UnidadMedida").alias("unidad_cat"),
    )
    return (
        catalogue.groupBy(F.col("Producto").alias("producto_master"))
        .agg(F.min(row).alias("c"))
        .select("producto_master", "c.*")
    )


def unit_costs(cost: DataFrame) -> DataFrame:
    value = T.locale_number(F.col("Costo"))
    return (
        cost.groupBy(F.col("Producto").alias("producto_master"))
        .agg(F.max(value).alias("costo_unitario"))
        .filter(F.col("costo_unitario").isNotNull())
    )


def suggested_value(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn(
        "valor_clp",
        F.when(F.col("sugerido") > 0, F.col("sugerido") * F.col("costo_unitario")),
    )


def enrich(
    pairs: DataFrame,
    mapping: DataFrame,
    dim_branch: DataFrame,
    catalogue: DataFrame | None,
    cost: DataFrame | None,
    params: Params,
) -> DataFrame:
    """Every lookup is one row per head, joined on the head the frame is already laid out by. Stock at
    the centre came with the stock maps."""
    rows = cd_sources(stock_pivot(pairs, params), params)
    rows = rows.join(replacements(mapping), "producto_master", "left")
    if catalogue is not None:
        rows = rows.join(catalogue_columns(catalogue), "producto_master", "left")
    else:
        empty = F.lit(None).cast("string")
        rows = rows.withColumns({"descripcion_cat": empty, "filtro1_cat": empty, "unidad_cat": empty})
    if cost is not None:
        rows = rows.join(unit_costs(cost), "producto_master", "left")
    else:
        rows = rows.withColumn("costo_unitario", F.lit(None).cast("double"))
    rows = rows.withColumns(
        {
            "empresa": company(F.col("de_frontera"), F.col("de_principal"), params),
            "tiene_stock_cd": is_true(F.col("tiene_stock_cd")),
            "tipo_origen": F.when(F.col("es_importado"), "Importado").otherwise("Nacional"),
        }
    )
    return branch_names(suggested_value(rows), dim_branch, params)
