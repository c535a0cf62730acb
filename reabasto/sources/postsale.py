"""Post-sale sheet: rows of any columns kept as JSON arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reabasto.functions import text as T


def sheet_index(headers: list[str], *names: str) -> int | None:
    """Place of the first of `names` among the headers; earlier names win."""
    keys = [_sheet_key(h) for h in headers]
    return next((keys.index(n) for n in names if n in keys), None)


def _sheet_key(header: str) -> str:
    """Header key on the driver, for the handful of sheet headers."""
    plain = header.strip().lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))
    for mark in " -/.°":
        plain = plain.replace(mark, "_")
    return "_".join(part for part in plain.split("_") if part)


def load_postventa(raw: DataFrame, headers: list[str]) -> DataFrame:
    """Schema-less sheet rows (`valores array<string>`): padded or cut to the header width,
    period and branch taken out, the rest stored as a JSON array."""
    return sheet_cells(raw, headers).withColumn("datos", F.to_json("valores")).drop("valores")


def sheet_cells(raw: DataFrame, headers: list[str]) -> DataFrame:
    """The same rows with their cells still in `valores`, for what is summed while loading."""
    width = len(headers)
    cells = F.transform("valores", lambda v: F.coalesce(v, F.lit("")))
    missing = F.greatest(F.lit(width) - F.size("valores"), F.lit(0))
    fixed = F.slice(F.concat(cells, F.array_repeat(F.lit(""), missing)), 1, width)
    period, branch = sheet_index(headers, "periodo", "mes"), sheet_index(headers, "sucursal", "local")

    def taken(place: int | None) -> Column:
        if place is None:
            return F.lit(None).cast("string")
        return T.blank_to_null(F.get(F.col("valores"), F.lit(place)))

    kept = [c for c in raw.columns if c != "valores"]
    return raw.withColumn("valores", fixed).select(
        *kept,
        taken(period).alias("periodo"),
        taken(branch).alias("sucursal"),
        "valores",
    )


def postventa_meta(rows: DataFrame) -> DataFrame:
    """Rows (campo, valor, filas): each period and each branch of the loaded sheet with its number
    of rows, and the number of all rows. Rows, not one list, since both texts are free."""
    pairs = F.explode(
        F.array(
            F.struct(F.lit("filas").alias("campo"), F.lit(None).cast("string").alias("valor")),
            F.struct(F.lit("periodo").alias("campo"), F.col("periodo").alias("valor")),
            F.struct(F.lit("sucursal").alias("campo"), F.col("sucursal").alias("valor")),
        )
    )
    per_pair = rows.groupBy("periodo", "sucursal").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_pair.select(pairs.alias("p"), "n")
        .select("p.*", "n")
        .filter((F.col("campo") == "filas") | F.col("valor").isNotNull())
        .groupBy("campo", "valor")
        .agg(F.sum("n").alias("filas"))
    )
