"""Transfers from the distribution centre and between branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.functions.columns import is_true, map_value, thousands
from reabasto.operators.abc_class import is_routed_tail
from reabasto.params import Params


def cd_priority(pairs: DataFrame, params: Params) -> DataFrame:
    """Turn of each branch and the group's stock at the centre (null where none is known)."""
    return pairs.withColumns(
        {
            "prioridad_cd": map_value(
                F.col("sucursal_final"), params.cd_priority, F.lit(params.cd_priority_default)
            ),
            "stock_cd": F.try_element_at("existencias", F.lit(params.cd_id)).getField("stock"),
        }
    )


def transfer_allocation(pairs: DataFrame, params: Params) -> DataFrame:
    """Centre stock handed out by priority; equal priorities go by branch name.

    A group head has at most one row per branch, so the running sum stays short.
    """
    turn = (
        Window.partitionBy("producto_master")
        .orderBy("prioridad_cd", "sucursal_final")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    eligible = is_true((F.col("sucursal_final") != params.cd_id) & is_routed_tail(params))
    need, stock = F.col("necesidad_bruta"), F.col("stock_cd")
    asked = F.when(eligible, need).otherwise(0.0)
    step = pairs.withColumn("_elegible", eligible).withColumn("_acumulada", F.sum(asked).over(turn))
    left = F.greatest(stock - (F.col("_acumulada") - asked), F.lit(0.0))
    moved = F.floor(F.least(need, left)).cast("double")
    short = stock.isNull() | (stock <= 0) | (F.col("_acumulada") > stock)
    return step.withColumns(
        {
            "sugerido_traslado": F.when(
                F.col("_elegible") & (need > 0) & (stock > 0) & (F.least(need, left) > 0), moved
            ),
            "comprar_en_cd": F.when(
                F.col("_elegible"), F.when(short, F.lit("Si")).otherwise(F.lit("No"))
            ),
        }
    ).drop("_elegible", "_acumulada")


def net_purchase(pairs: DataFrame) -> DataFrame:
    moved = F.coalesce("sugerido_traslado", F.lit(0.0))
    return pairs.withColumn(
        "compra_neta",
        F.when(F.col("sugerido") > 0, F.floor(F.col("sugerido") - moved).cast("double")),
    )


def lateral_sources(pairs: DataFrame, params: Params) -> DataFrame:
    """Other operating branches that hold the group, largest stock first, as one text."""
    rank = {branch: place for place, branch in enumerate(params.operating_branches)}
    entries = F.filter(
        F.map_entries("existencias"),
        lambda e: e["key"].isin(*params.operating_branches)
        & (e["key"] != F.col("sucursal_final"))
        & (e["value"]["stock"] > 0),
    )
    ordered = F.array_sort(
        F.transform(
            entries,
            lambda e: F.struct(
                (-e["value"]["stock"]).alias("menos_stock"),
                map_value(e["key"], rank).alias("orden"),
                F.coalesce(e["value"]["nombre"], e["key"]).alias("nombre"),
            ),
        )
    )
    lines = F.transform(
        ordered,
        lambda e: F.concat(
            thousands(F.least(F.col("sugerido"), -e["menos_stock"])),
            F.lit(" unidades desde "),
            e["nombre"],
        ),
    )
    text = F.array_join(lines, "; ")
    return pairs.withColumn(
        "trasladar_desde", F.when((F.col("sugerido") > 0) & (F.size(lines) > 0), text)
    )


def transfers(pairs: DataFrame, params: Params) -> DataFrame:
    allocated = transfer_allocation(cd_priority(pairs, params), params)
    return lateral_sources(net_purchase(allocated), params)
