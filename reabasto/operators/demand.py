"""Monthly demand and its spread from the winsorised monthly series of a pair."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.params import Params


def median_of(values: list[Column]) -> Column:
    """Median of a known number of values, none null."""
    ordered, n = F.sort_array(F.array(*values)), len(values)
    return (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2


def winsorize(df: DataFrame, series: str, months: int, params: Params, mean: str, spread: str) -> DataFrame:
    """Cap the last `months` of the series from above at median + k * scale * MAD, then mean and
    sample deviation.

    A series whose MAD is 0 stays as it is; a missing one gives null. The number of months is
    known, so all of it is arithmetic on that many columns, inside generated code.
    """
    column, last = F.col(series), F.slice(series, -months, months)
    step = df.withColumn("_x", F.when(column.isNotNull(), last))
    x = [F.get("_x", F.lit(i)) for i in range(months)]
    there = F.col("_x").isNotNull()
    step = step.withColumn("_med", F.when(there, median_of(x)))
    step = step.withColumn("_mad", F.when(there, median_of([F.abs(v - F.col("_med")) for v in x])))
    cap = F.col("_med") + F.lit(params.winsor_k * params.mad_scale) * F.col("_mad")
    step = step.withColumn("_cap", F.when(F.col("_mad") != 0, cap))
    capped = [F.least(v, F.col("_cap")) for v in x]  # without a cap the value itself
    step = step.withColumn(mean, reduce(add, capped, F.lit(0.0)) / months)
    squares = [F.pow(v - F.col(mean), F.lit(2.0)) for v in capped]
    variance = reduce(add, squares, F.lit(0.0)) / max(1, months - 1)
    step = step.withColumn(spread, F.when(there, F.sqrt(variance)) if months > 1 else F.lit(None).cast("double"))
    return step.drop("_x", "_med", "_mad", "_cap")


def demand_local(pairs: DataFrame, params: Params) -> DataFrame:
    """Six closed months for the fast local classes, twelve for the slow ones."""
    fast = F.col("clasificacion_abc").isin(*params.buying_classes)
    halves = pairs.withColumns({"_corta": F.when(fast, F.col("serie")), "_larga": F.when(~fast, F.col("serie"))})
    both = winsorize(halves, "_corta", params.window_mid, params, "_media_corta", "_desv_corta")
    both = winsorize(both, "_larga", params.window_long, params, "_media_larga", "_desv_larga")
    return both.withColumns(
        {
            "demanda_mensual": F.coalesce("_media_corta", "_media_larga"),
            "desv_std_mensual": F.coalesce("_desv_corta", "_desv_larga"),
        }
    ).drop("_corta", "_larga", "_media_corta", "_desv_corta", "_media_larga", "_desv_larga")


def consolidated_series(pairs: DataFrame, params: Params) -> DataFrame:
    """Adds `serie_cd`: on distribution-centre rows of fast heads, the monthly totals of the
    centre itself plus the branches that are slow in their own right."""
    by_master = Window.partitionBy("producto_master")
    at_cd = F.col("sucursal_final") == params.cd_id
    joins_in = at_cd | F.col("clasificacion_abc").isin(*params.tail_classes)
    totals = F.array(
        *[
            F.sum(F.when(joins_in, F.get("serie", F.lit(i)))).over(by_master)
            for i in range(params.window_long)
        ]
    )
    fast = F.col("clasificacion_abc_agregada").isin(*params.buying_classes)
    return pairs.withColumn("serie_cd", F.when(at_cd & fast, totals))


def demand(pairs: DataFrame, params: Params) -> DataFrame:
    """Monthly demand, its deviation and the daily rate of every pair."""
    local = demand_local(consolidated_series(pairs, params), params)
    both = winsorize(local, "serie_cd", params.window_long, params, "_demanda_cd", "_desv_cd")
    return (
        both.withColumns(
            {
                "demanda_mensual": F.coalesce("_demanda_cd", "demanda_mensual"),
                "desv_std_mensual": F.coalesce("_desv_cd", "desv_std_mensual"),
            }
        )
        .withColumn("demanda_diaria", F.col("demanda_mensual") / params.working_days)
        .drop("serie_cd", "_demanda_cd", "_desv_cd")
    )
