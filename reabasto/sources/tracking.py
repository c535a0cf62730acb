"""Purchase-order tracking of the three origins."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reabasto import fixed_values as V
from reabasto.functions import text as T
from reabasto.functions.columns import map_value
from reabasto.params import Params
from reabasto.sources.grid import read_report

# Columns of the three projections and the type of each column.
BASE = ("Producto", "SucursalID", "RazonSocial", "FechaOC", "NOC", "Origen", "Motivo")
TRANSIT = BASE + ("Cantidad", "EstadoOC", "EstadoDoc", "FechaDoc")
LEAD_TIME = ("RazonSocial", "SucursalID", "FechaOC", "FechaPE", "Origen", "Motivo")
PROJECTIONS = {"base": BASE, "transit": TRANSIT, "lead_time": LEAD_TIME}
TYPES = {
    "FechaOC": "date",
    "FechaPE": "date",
    "FechaDoc": "date",
    "NOC": "long",
    "Cantidad": "long",
}


def read_tracking(grid: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One tracking report layout; days and quantity typed."""
    report = read_report(grid, columns, [c for c in ("Producto", "Cantidad") if c in columns])
    days = {
        c: T.to_date_multi(F.col(c)) for c in ("FechaOC", "FechaDoc", "FechaPE") if c in columns
    }
    return report.withColumns({**days, "Cantidad": T.to_int(F.col("Cantidad"))})


def read_tracking_national(grid: DataFrame) -> DataFrame:
    return read_tracking(grid, V.REPORT_TRACKING_NATIONAL)


def read_tracking_imported(grid: DataFrame) -> DataFrame:
    return read_tracking(grid, V.REPORT_TRACKING_IMPORTED)


def read_tracking_border(grid: DataFrame) -> DataFrame:
    return read_tracking(grid, V.REPORT_TRACKING_BORDER)


def national_tracking_extract(table: DataFrame) -> DataFrame:
    """The eleven wanted columns of the wide national table."""
    return table.select(*[F.col(f"`{src}`").alias(dst) for dst, src in V.REPORT_TRACKING_NATIONAL.items()])


def normalize_tracking(
    raw: DataFrame,
    params: Params,
    origin: str,
    branch_map: Mapping[str, str],
    branch_column: str = "Sucursal",
    mode: str = "base",
) -> DataFrame:
    """Branch code to branch, origin tag, and one of the three projections.

    Unknown codes, and reports without the branch column, go to the unknown branch;
    columns the origin lacks come out null.
    """
    unknown = F.lit(params.unknown_branch)
    branch = (
        map_value(F.col(branch_column), branch_map, unknown)
        if branch_column in raw.columns
        else unknown
    )
    tagged = raw.withColumns({"SucursalID": branch, "Origen": F.lit(origin)})

    def pick(name: str):
        kind = TYPES.get(name, "string")
        value = F.col(name) if name in tagged.columns else F.lit(None)
        return value.try_cast(kind).alias(name)

    return tagged.select(*[pick(c) for c in PROJECTIONS[mode]])


def normalize_tracking_national(raw: DataFrame, params: Params, mode: str = "base") -> DataFrame:
    return normalize_tracking(
        raw, params, params.origin_national, params.tracking_map_national, "Sucursal", mode
    )


def normalize_tracking_imported(raw: DataFrame, params: Params, mode: str = "base") -> DataFrame:
    return normalize_tracking(
        raw, params, params.origin_imported, params.tracking_map_imported, "Sucursal", mode
    )


def normalize_tracking_border(raw: DataFrame, params: Params, mode: str = "base") -> DataFrame:
    return normalize_tracking(
        raw, params, params.origin_border, params.tracking_map_border, "NombreLocal", mode
    )


def union_tracking(
    national: DataFrame | None = None,
    imported: DataFrame | None = None,
    border: DataFrame | None = None,
) -> DataFrame:
    present = [f for f in (national, imported, border) if f is not None]
    if not present:
        raise ValueError("union_tracking needs at least one origin")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)
