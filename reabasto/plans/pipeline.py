"""The daily calculation as one lazy plan, its output contract and its export."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto import fixed_values as V
from reabasto import schemas as S
from reabasto.operators.abc_class import abc
from reabasto.operators.demand import demand
from reabasto.operators.enrich import enrich
from reabasto.operators.leadtime import (
    lead_time,
    supplier_lookup,
    supplier_lookup_from_tracking,
)
from reabasto.operators.suggest import attach_stock, safety_stock, suggestion
from reabasto.operators.transfer import transfers
from reabasto.params import Params
from reabasto.sources.files import Sources, read_csv, write_csv


def lead_time_lookup(sources: Sources, params: Params) -> DataFrame:
    """Supplier days computed from the orders where they are given, else the ready tables."""
    if sources.tracking_lead_time is not None:
        return supplier_lookup_from_tracking(sources.tracking_lead_time, params)
    return supplier_lookup(sources.lt_supplier, sources.lt_supplier_branch)


def run_pipeline(
    sources: Sources, closed_month: date, today: date, params: Params | None = None
) -> DataFrame:
    """Sales, tracking and stock to one row per group head and branch.

    Sales and stock are read once, orders once for suppliers and units on the way and once for
    lead times (where those aren't given). Each is reduced to one row per head (or per head,
    branch and month) before any join; the pair frame then gains columns stage by stage and is
    never joined with itself.
    """
    params = params or Params()
    one_pass = sources.tracking is None
    pairs = abc(sources.sales, sources.mapping, sources.dim_product, closed_month, params)
    pairs = demand(pairs, params)
    pairs = lead_time(
        pairs,
        sources.tracking_transit if one_pass else sources.tracking,
        lead_time_lookup(sources, params),
        sources.dim_branch,
        sources.imported,
        params,
        today if one_pass else None,
    )
    pairs = safety_stock(pairs, params)
    pairs = attach_stock(
        pairs,
        sources.stock,
        sources.stock_border,
        None if one_pass else sources.tracking_transit,
        sources.mapping,
        sources.dim_branch,
        today,
        params,
    )
    pairs = transfers(suggestion(pairs, params), params)
    return enrich(
        pairs,
        sources.mapping,
        sources.dim_branch,
        sources.catalogue,
        sources.cost,
        params,
    ).drop("serie", "existencias")


def contract(rows: DataFrame, params: Params | None = None) -> DataFrame:
    """The 53 published columns, in order."""
    params = params or Params()
    fixed = [F.col(inner).alias(header) for header, inner in V.CONTRACT]
    return rows.select(*fixed, *[F.col(f"`Stock {b}`") for b in params.stock_columns])


def contract_text(rows: DataFrame, params: Params | None = None) -> DataFrame:
    """The contract with its two flags spelled `True` and `False`."""
    flags = {
        c: F.when(F.col(f"`{c}`"), F.lit("True")).otherwise(F.lit("False"))
        for c in ("Es Importado", "Tiene Stock CD")
    }
    return contract(rows, params).withColumns(flags)


def read_contract(spark: SparkSession, path: str, params: Params | None = None, **options: object) -> DataFrame:
    """An exported contract under its own types again, to be published or compared without a new calculation.

    Columns are found by their headers; one that is missing stops the read. Texts with line breaks need `multiLine=True`.
    """
    params = params or Params()
    kinds = {name: kind for kind, names in S.CONTRACT_TYPES.items() for name in names}
    kinds |= {f"Stock {b}": "long" for b in params.stock_columns}
    headers = [header for header, _ in V.CONTRACT] + [f"Stock {b}" for b in params.stock_columns]
    return read_csv(spark, path, ", ".join(f"`{h}` {kinds.get(h, 'string')}" for h in headers), **options)


def export_csv(rows: DataFrame, path: str, params: Params | None = None) -> None:
    write_csv(contract_text(rows, params), path)
