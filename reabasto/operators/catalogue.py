"""Catalogue, stock and product lookups."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.functions.text import like_any
from reabasto.operators.serving import page_after, page_of, placed_page, sort_keys


@dataclass(frozen=True)
class CatalogueFilters:
    q: str | None = None
    familia: tuple[str, ...] = ()
    procedencia: tuple[str, ...] = ()
    categoria: tuple[str, ...] = ()
    con_stock: bool = False


def stock_total(stock: DataFrame) -> DataFrame:
    return stock.groupBy("producto").agg(
        F.coalesce(F.sum("stock"), F.lit(0.0)).alias("stock_total")
    )


def stock_by_branch(stock: DataFrame, product: str) -> DataFrame:
    return (
        stock.filter(F.col("producto") == product)
        .select("bodega", "sucursal_id", F.coalesce("stock", F.lit(0.0)).alias("stock"), "origen")
        .orderBy(F.col("stock").desc(), "bodega", "origen")
    )


def filter_catalogue(catalogue: DataFrame, f: CatalogueFilters) -> DataFrame:
    kept = catalogue
    if f.q:
        kept = kept.filter(like_any(f.q, F.col("producto"), F.col("glosa")))
    for column in ("familia", "procedencia", "categoria"):
        if values := getattr(f, column):
            kept = kept.filter(F.col(column).isin(*values))
    return kept.filter("stock_total > 0") if f.con_stock else kept


def _with_stock(rows: DataFrame, stock: DataFrame) -> DataFrame:
    """Stock of the branches where it is known, the catalogue's own figure elsewhere."""
    current = stock_total(stock).withColumnRenamed("stock_total", "_stock")
    return (
        rows.join(current, "producto", "left")
        .withColumn("stock_total", F.coalesce("_stock", "stock_total"))
        .drop("_stock")
    )


def catalogue_list(
    catalogue: DataFrame,
    stock: DataFrame,
    f: CatalogueFilters,
    page: int = 1,
    limit: int = 100,
    sort: str | None = None,
) -> DataFrame:
    """One page in the order asked for, with the stock of the branches."""
    keys = sort_keys(sort, catalogue.columns, "producto", ("producto",))
    shown = placed_page(filter_catalogue(catalogue, f), keys, page, limit)
    return _with_stock(shown, stock).orderBy("pos").drop("pos")


def catalogue_list_after(
    catalogue: DataFrame,
    stock: DataFrame,
    f: CatalogueFilters,
    last: Mapping[str, object] | None = None,
    limit: int = 100,
    sort: str | None = None,
) -> DataFrame:
    """The page of `catalogue_list` that follows a page whose last catalogue row is `last`."""
    shown = page_after(filter_catalogue(catalogue, f), last, limit, sort, "producto", ("producto",))
    keys = sort_keys(sort, catalogue.columns, "producto", ("producto",))
    placed = shown.withColumn("pos", F.row_number().over(Window.orderBy(*keys)))  # of one page
    return _with_stock(placed, stock).orderBy("pos").drop("pos")


def catalogue_total(catalogue: DataFrame, f: CatalogueFilters) -> DataFrame:
    """How many products all pages of `catalogue_list` hold."""
    return filter_catalogue(catalogue, f).agg(F.count(F.lit(1)).alias("total"))


def catalogue_detail(catalogue: DataFrame, stock: DataFrame, product: str) -> DataFrame:
    """The catalogue row, its stock per warehouse (largest first) and the total."""
    entry = F.struct(
        (-F.coalesce("stock", F.lit(0.0))).alias("orden"),
        "bodega",
        "sucursal_id",
        F.coalesce("stock", F.lit(0.0)).alias("stock"),
        "origen",
    )
    split = (
        stock.filter(F.col("producto") == product)
        .groupBy("producto")
        .agg(F.array_sort(F.collect_list(entry)).alias("_partes"), F.sum("stock").alias("_stock"))
    )
    parts = F.transform(
        F.coalesce("_partes", F.array()),
        lambda e: F.struct(e["bodega"], e["sucursal_id"], e["stock"], e["origen"]),
    )
    return (
        catalogue.filter(F.col("producto") == product)
        .join(split, "producto", "left")
        .withColumns(
            {"stock_total": F.coalesce("_stock", "stock_total"), "stock_por_sucursal": parts}
        )
        .drop("_partes", "_stock")
    )


def filter_options(catalogue: DataFrame) -> DataFrame:
    """Distinct filled values of the three filter columns as (campo, valor)."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("campo"), F.col(c).alias("valor"))
                for c in ("familia", "procedencia", "categoria")
            ]
        )
    )
    return (
        catalogue.select(pairs.alias("o"))
        .select("o.*")
        .filter(F.col("valor") != "")
        .distinct()
        .orderBy("campo", "valor")
    )


def product_card(catalogue: DataFrame, rows: DataFrame, product: str | None = None) -> DataFrame:
    """Catalogue row with the number of branches that list it and their total suggestion."""
    kept = catalogue if product is None else catalogue.filter(F.col("producto") == product)
    listed = rows.groupBy("producto").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_sugerido_suc").alias("total")
    )
    return kept.join(listed, "producto", "left").select(
        "producto",
        F.col("glosa").alias("descripcion"),
        "familia",
        "procedencia",
        F.col("costo").alias("costo_unitario"),
        F.col("stock_total").alias("stock_total_catalogo"),
        "reemplazo",
        "unidad",
        F.coalesce("n", F.lit(0)).alias("en_sugerido_sucursales"),
        F.coalesce("total", F.lit(0.0)).alias("total_sugerido_todas_sucursales"),
    )


def _matching(frame: DataFrame, q: str | None, text: str) -> DataFrame:
    return frame if not q else frame.filter(like_any(q, F.col("producto"), F.col(text)))


def search_products(
    dim: DataFrame, catalogue: DataFrame, q: str | None, page: int = 1, limit: int = 20
) -> DataFrame:
    """A page of the product dimension, filled up from the catalogue when it falls short.

    A page can take away `limit` of the catalogue's matches at most, so twice as many of these, in order, are
    enough to fill it up; of a product in both the dimension's row stays.
    """
    keys = [F.col("producto")]
    fields = (
        "producto",
        "descripcion",
        "filtro1_final",
        "unidad_medida",
        "costo_unitario",
        "proveedor",
        "es_importado",
    )
    shown = page_of(_matching(dim, q, "descripcion"), keys, page, limit).select(*fields).withColumn("orden", F.lit(0))
    if not q:
        return shown
    extra = (
        _matching(catalogue, q, "glosa")
        .orderBy("producto")
        .limit(2 * limit)
        .select(
            "producto",
            F.col("glosa").alias("descripcion"),
            F.col("unidad").alias("unidad_medida"),
            F.col("costo").alias("costo_unitario"),
            F.lit(1).alias("orden"),
        )
    )
    both = shown.unionByName(extra, allowMissingColumns=True)
    listed = F.min("orden").over(Window.partitionBy("producto"))  # of a few pages of rows
    fresh = both.withColumn("_primero", listed).filter(F.col("orden") == F.col("_primero")).drop("_primero")
    return fresh.orderBy("orden", "producto").limit(limit)


def search_total(
    dim: DataFrame, catalogue: DataFrame, q: str | None, page: int = 1, limit: int = 20
) -> DataFrame:
    """Matches of the dimension plus, when the page falls short, the catalogue's others.

    One full join by product counts both sides and what they share. How many rows the page holds follows from the
    first count; a first page that falls short holds all of them, a later one is read for what it shares.
    """
    matching = _matching(dim, q, "descripcion")
    if not q:
        return matching.agg(F.count(F.lit(1)).alias("total"))
    own = matching.groupBy("producto").agg(F.count(F.lit(1)).alias("propios"))
    others = _matching(catalogue, q, "glosa").select("producto", F.lit(1).alias("otros"))
    counts = own.join(others, "producto", "full").agg(
        F.coalesce(F.sum("propios"), F.lit(0)).alias("propios"),
        F.count("otros").alias("otros"),
        F.count_if(F.col("propios").isNotNull() & F.col("otros").isNotNull()).alias("en_pagina"),
    )
    if page > 1:
        shown = page_of(matching, [F.col("producto")], page, limit).select("producto")
        shared = others.join(shown, "producto", "left_semi").agg(F.count(F.lit(1)).alias("compartidos"))
        counts = counts.withColumn("en_pagina", shared.scalar())
    held = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("propios") - (page - 1) * limit))
    filled = F.when(held < limit, F.col("otros") - F.col("en_pagina")).otherwise(0)
    return counts.select((F.col("propios") + filled).alias("total"))


def search_catalogue(catalogue: DataFrame, text: str, limit: int = 10) -> DataFrame:
    return (
        _matching(catalogue, text, "glosa")
        .orderBy("producto")
        .limit(limit)
        .select("producto", F.col("glosa").alias("descripcion"), "familia", "costo")
    )


def list_branches(dim_branch: DataFrame) -> DataFrame:
    return dim_branch.orderBy(F.col("prioridad_cd").asc_nulls_first(), "sucursal_id")
