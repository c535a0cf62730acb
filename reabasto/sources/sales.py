"""Sales: yearly reports, the two companies and their union."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto import fixed_values as V
from reabasto.functions import text as T
from reabasto.functions.columns import map_value
from reabasto.functions.months import first_day, window_start
from reabasto.params import Params
from reabasto.sources.grid import read_report

RAW_COLUMNS = ("Producto", "SUCURSAL", "Tipo-Venta", "Fecha", "Cantidad", "tipoDocto", "tipoproducto")


def type_sales_report(report: DataFrame) -> DataFrame:
    """Day, quantity, product type and branch of the text report put in the usual form."""
    return report.withColumns(
        {
            "Fecha": T.to_date_multi(F.col("Fecha")),
            "Cantidad": T.to_int(F.col("Cantidad")),
            "tipoproducto": T.part_product_type(F.col("tipoproducto")),
            "SUCURSAL": T.strip_branch_prefix(F.col("SUCURSAL")),
        }
    )


def read_sales(grid: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Yearly sales reports, all files of the grid in one pass."""
    return type_sales_report(
        read_report(
            grid, columns or V.REPORT_SALES, ["Producto", "Cantidad", "tipoDocto", "tipoproducto"]
        )
    )


def read_border_sales(grid: DataFrame) -> DataFrame:
    report = read_report(
        grid,
        V.REPORT_SALES_BORDER,
        ["producto", "cantidad", "Documento", "Docto-Emitido", "tipoproducto"],
    )
    return report.withColumns(
        {"fecha": T.to_date_multi(F.col("fecha")), "cantidad": T.to_int(F.col("cantidad"))}
    )


def read_mix(grid: DataFrame) -> DataFrame:
    """Replacement report: a product and up to three replacements."""
    return read_report(grid, V.REPORT_MIX, ["Producto", "Reem1"])


def signed_quantity(document: Column, quantity: Column, params: Params) -> Column:
    """Credit notes subtract, every other document adds, whatever sign the row has."""
    size = F.abs(quantity)
    return F.when(document.isin(*params.credit_note_types), -size).otherwise(size)


def normalize_sales_main(
    raw: DataFrame, params: Params, history: DataFrame | None = None
) -> DataFrame:
    """Sales of the main company; an older history is put before the rules apply."""
    if history is not None:
        raw = raw.select(*RAW_COLUMNS).unionByName(history.select(*RAW_COLUMNS))
    return raw.filter(F.col("tipoproducto").isin(*params.part_product_types)).select(
        "Producto",
        "SUCURSAL",
        F.col("Tipo-Venta").alias("TipoVenta"),
        "Fecha",
        signed_quantity(F.col("tipoDocto"), F.col("Cantidad"), params).alias("CantidadAjustada"),
        F.lit(params.source_main).alias("Fuente"),
    )


def normalize_sales_border(raw: DataFrame, params: Params) -> DataFrame:
    """Sales of the border company: issued part documents. Its credit note type is not in
    the subtracting list, so its credit notes add."""
    kept = raw.filter(
        (F.col("tipoproducto") == params.border_product_type)
        & (F.col("Docto-Emitido") == params.border_issued)
        & F.col("Documento").isin(*params.border_documents)
    )
    branch = F.col("SUCURSAL")
    return kept.select(
        F.col("producto").alias("Producto"),
        map_value(branch, params.border_branch_prefixes, branch).alias("SUCURSAL"),
        F.col("Tipo-Venta").alias("TipoVenta"),
        F.col("fecha").alias("Fecha"),
        signed_quantity(F.col("Documento"), F.col("cantidad"), params).alias("CantidadAjustada"),
        F.lit(params.source_border).alias("Fuente"),
    )


def normalize_sales(raw: DataFrame, border: Column, params: Params) -> DataFrame:
    """Sales of both companies from one frame, where `border` tells whose a row is: the rules of
    each, in one pass. Columns: Producto, SUCURSAL, Tipo-Venta, Fecha, Cantidad, documento,
    emitido, tipoproducto."""
    kind, document, branch = F.col("tipoproducto"), F.col("documento"), F.col("SUCURSAL")
    of_border = (
        (kind == params.border_product_type)
        & (F.col("emitido") == params.border_issued)
        & document.isin(*params.border_documents)
    )
    kept = F.when(border, of_border).otherwise(kind.isin(*params.part_product_types))
    return raw.filter(kept).select(
        "Producto",
        F.when(border, map_value(branch, params.border_branch_prefixes, branch)).otherwise(branch).alias("SUCURSAL"),
        F.col("Tipo-Venta").alias("TipoVenta"),
        "Fecha",
        signed_quantity(document, F.col("Cantidad"), params).alias("CantidadAjustada"),
        F.when(border, params.source_border).otherwise(params.source_main).alias("Fuente"),
    )


def union_sales(*frames: DataFrame | None) -> DataFrame:
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("union_sales needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b), present)


def select_sales_years(sales: DataFrame, closed_month: date, params: Params) -> DataFrame:
    """The calendar years that hold the months the engine looks at: a plain predicate on the day
    (pushed to the files) and, where the table is split by `anio`, one on the partition."""
    first = first_day(window_start(closed_month, params.window_long)).year
    years = range(min(first, closed_month.year - 1), closed_month.year + 1)
    kept = sales.filter(F.col("Fecha") >= F.lit(date(years[0], 1, 1)))
    if "anio" in sales.columns:
        kept = kept.filter(F.col("anio").isin(*years))
    return kept


def write_sales_by_year(sales: DataFrame, path: str) -> None:
    """Sales in a folder per calendar year (`anio`); a year with much more rows than others is split over several tasks."""
    kept = sales.withColumn("anio", F.year("Fecha")).hint("rebalance", "anio")
    kept.write.mode("overwrite").partitionBy("anio").parquet(path)


def read_sales_years(spark: SparkSession, path: str, closed_month: date, params: Params) -> DataFrame:
    """The years of `write_sales_by_year` that the engine looks at; the folders of other years are not listed."""
    return select_sales_years(spark.read.parquet(path), closed_month, params).drop("anio")


def main_sales_extract(table: DataFrame, company: str, since: date) -> DataFrame:
    """Sales of a company from a day on, all columns: two plain comparisons, which files and databases evaluate themselves."""
    return table.filter((F.col("Empresa") == company) & (F.col("Fecha") >= F.lit(since)))


def _series(model: Column) -> Column:
    pick = None
    for pattern, name in V.SERIES_PATTERNS:
        hit = model.like(pattern)
        pick = F.when(hit, name) if pick is None else pick.when(hit, name)
    return pick.otherwise(V.SERIES_OTHER)


def _product_kind(kind: Column, product: Column) -> Column:
    part = kind == "REPUESTO"
    return (
        F.when(part & product.isin(*V.LUBRICANT_CODES), "LUBRICANTE")
        .when(part, "REPUESTOS")
        .when(kind == "MO_TERC", "SERV. 3ro")
        .when((kind == "INTERNO") & product.like("AJUSTE ST"), "MECANICA")
        .when((kind == "MO_ST") & product.like("MO_%"), "MECANICA")
        .when((kind == "MO_ST") & product.like("INS%"), "INSUMOS")
        .otherwise("OTROS PROD")
    )


def border_sales_extract(
    documents: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    company: str,
    since: date,
    until: date,
) -> DataFrame:
    """Document lines of the border company with the six derived columns.

    The document filters run before the joins, and the line table is read once.
    """
    head = documents.filter(
        (F.col("empresa") == company)
        & F.col("tipodocto").isin(*V.EXTRACT_DOCUMENTS)
        & F.col("fecha").between(F.lit(since), F.lit(until))
        & (F.col("vigencia") != "A")
    )
    joined = (
        lines.filter(F.col("empresa") == company)
        .join(head, ["empresa", "tipodocto", "correlativo"])
        .join(products.filter(F.col("empresa") == company), ["empresa", "producto"])
    )
    document = F.col("tipodocto")
    sign = F.when(document == V.CREDIT_DOCUMENT, -1).when(document.isin(*V.EXTRACT_DOCUMENTS), 1)
    pending = document.isin(*V.ISSUABLE_DOCUMENTS) & (F.col("emitido") == "N")
    return joined.select(
        F.col("periodolibro").alias("Periodo"),
        document.alias("Documento"),
        "numero",
        "fecha",
        F.col("tipo_venta").alias("Tipo-Venta"),
        F.col("marca").alias("Marca"),
        F.col("modelo").alias("Modelo"),
        "producto",
        F.substring("glosa", 1, 20).alias("Descripcion Producto"),
        F.col("linea").alias("Items"),
        "cantidad",
        "neto",
        "total",
        "local",
        "tipoproducto",
        _series(F.col("modelo")).alias("SERIE UNIDAD"),
        _product_kind(F.col("tipoproducto"), F.col("producto")).alias("TIPO PRODUCTO"),
        map_value(F.col("local"), V.EXTRACT_BRANCHES, F.lit(V.EXTRACT_BRANCH_OTHER)).alias("SUCURSAL"),
        (F.col("costo") * sign).alias("Costo Neto"),
        (F.col("total") * sign).alias("Total Neta"),
        F.when(pending, "Emision Pendiente").otherwise("Emitido").alias("Docto-Emitido"),
    )
