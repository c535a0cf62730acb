"""Delivery log of the sources: how old is the newest delivery of each."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reabasto import fixed_values as V
from reabasto.functions.columns import map_value


def source_freshness(
    log: DataFrame, today: date, limits: Mapping[str, int] | None = None
) -> DataFrame:
    """Age of the newest delivery of each limited source; `vencida` where it is too old.

    A source that never arrived is not listed.
    """
    limit = map_value(F.col("fuente"), limits or V.FRESHNESS_DAYS)
    return (
        log.groupBy("fuente")
        .agg(F.max("entregado").alias("entregado"))
        .withColumn("limite_dias", limit)
        .filter(F.col("limite_dias").isNotNull())
        .withColumn("edad_dias", F.datediff(F.lit(today), F.col("entregado")))
        .withColumn("vencida", F.col("edad_dias") > F.col("limite_dias"))
    )


def check_freshness(freshness: DataFrame, official: bool, ignore: bool = False) -> list[str]:
    """Names of stale sources; an official load refuses to go on with any."""
    stale = [
        r.fuente for r in freshness.filter("vencida").select("fuente").orderBy("fuente").collect()
    ]
    if stale and official and not ignore:
        raise ValueError(f"stale sources: {', '.join(stale)}")
    return stale
