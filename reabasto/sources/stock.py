"""Warehouse stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reabasto.functions import text as T
from reabasto.functions.columns import map_value
from reabasto.params import Params


def read_stock(raw: DataFrame, params: Params) -> DataFrame:
    """Warehouse rows to branch rows; the family is kept for the product dimension."""
    by_lower = {name.lower(): branch for name, branch in params.warehouse_map.items()}
    warehouse = F.lower(F.coalesce(F.col("Bodega"), F.lit("")))
    optional = [
        F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
        for c in ("Costo", "Familia")
    ]
    return raw.filter(F.col("Producto").isNotNull()).select(
        "Producto",
        map_value(warehouse, by_lower, F.lit(params.unknown_branch)).alias("SucursalID"),
        T.to_int(F.col("Stock")).alias("Stock"),
        *optional,
    )
