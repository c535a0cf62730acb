"""Dimension builders: branches, products, replacement groups, imported products."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto import fixed_values as V
from reabasto import schemas as S
from reabasto.functions.columns import first_by, is_true, map_value
from reabasto.functions.months import first_day, window_start
from reabasto.functions.text import blank_to_null
from reabasto.params import Params

REPLACEMENTS = ("Reem1", "Reem2", "Reem3")


def dim_branch(spark: SparkSession) -> DataFrame:
    rows = [
        (branch, name, region, kind, operating, code)
        for branch, name, code, region, kind, operating in V.BRANCH_ROWS
    ]
    return spark.createDataFrame(rows, S.DIM_BRANCH)


def rubro(family: Column, product: Column) -> Column:
    """Number after `RUBRO ` in the family, else the digits that lead the code."""
    from_family = F.when(
        family.contains("RUBRO "), F.trim(F.replace(family, F.lit("RUBRO "))).try_cast("long")
    )
    from_code = F.nullif(F.regexp_extract(product, r"^(\d+)\s", 1), F.lit("")).try_cast("long")
    return F.coalesce(from_family, from_code)


def product_family(product: Column, number: Column, in_border: Column, params: Params) -> Column:
    return (
        F.when(product.rlike(r"^\d{7}-"), F.lit("GILDEMEISTER LIVIANOS"))
        .when(number.isNull() & is_true(in_border), F.lit("CHEVROLET"))
        .otherwise(map_value(number.cast("int"), params.rubro_family))
    )


def unit_of_measure(product: Column, description: Column) -> Column:
    text = F.upper(F.coalesce(description, F.lit("")))
    code = F.upper(F.coalesce(product, F.lit("")))
    return (
        F.when(text.contains("(ML)"), "ML")
        .when(text.contains("ML)") & text.contains("("), "ML")
        .when(code.endswith("TML"), "ML")
        .when(text.contains("(LT)"), "LITRO")
        .when(text.contains("(KG)"), "KG")
        .when(text.contains("(GR)"), "GR")
        .otherwise("UNIDAD")
    )


def dim_product(
    sales: DataFrame,
    master_list: DataFrame,
    stock: DataFrame,
    params: Params,
    border_products: DataFrame | None = None,
) -> DataFrame:
    """One row per product sold: category, description, family and unit.

    Every side is reduced to one row per product before the joins. The master list may
    repeat a code; the smallest (category, text) pair stands for it.
    """
    sold = (
        sales.filter(F.col("Producto").isNotNull())
        .groupBy("Producto")
        .agg(F.min("Descripcion Producto").alias("descripcion"))
    )
    family = (
        stock.filter(F.col("Familia").isNotNull())
        .groupBy("Producto")
        .agg(F.max("Familia").alias("familia"))
    )
    gloss = F.col("Glosa") if "Glosa" in master_list.columns else F.lit(None).cast("string")
    listed = (
        master_list.filter(F.col("Producto").isNotNull())
        .groupBy("Producto")
        .agg(F.min(F.struct(F.col("Categoria").alias("categoria"), gloss.alias("glosa"))).alias("m"))
    )
    joined = sold.join(family, "Producto", "left").join(listed, "Producto", "left")
    if border_products is None:
        joined = joined.withColumn("en_frontera", F.lit(False))
    else:
        marked = border_products.select("Producto").distinct().withColumn("en_frontera", F.lit(True))
        joined = joined.join(marked, "Producto", "left")
    product, description = F.col("Producto"), F.coalesce("descripcion", "m.glosa")
    number = rubro(F.col("familia"), product)
    return joined.select(
        "Producto",
        F.col("m.categoria").alias("Categoria"),
        description.alias("Descripcion"),
        product_family(product, number, F.col("en_frontera"), params).alias("FILTRO1_Final"),
        unit_of_measure(product, description).alias("UnidadMedida"),
    )


def master_map(mix: DataFrame, sales: DataFrame, closed_month: date, params: Params) -> DataFrame:
    """Product to the head of its replacement group.

    A product with replacements heads a group unless it replaces another product or shares
    a replacement with another head. The final head is the member that sold most in the
    closed six months; ties go to the original head, then to the larger code.

    Two grouped passes: one over what the rows say of each product (whom it lists, whether it replaces any), one over
    members and sales together (how many heads list a product, what it sold). They carry flags and sums
    only, so a replacement that very many list is no single task's work; what is gathered is a product's own
    replacements.
    """
    code = lambda c: blank_to_null(F.col(c).cast("string"))
    listed = mix.select(code("Producto").alias("cabeza"), F.array_compact(F.array(*[code(c) for c in REPLACEMENTS])).alias("reems"))
    roles = F.transform("reems", lambda r: F.struct(r.alias("p"), F.lit(None).cast("string").alias("reem"), F.lit(True).alias("es_reem")))
    heads = F.transform("reems", lambda r: F.struct(F.col("cabeza").alias("p"), r.alias("reem"), F.lit(False).alias("es_reem")))
    named = listed.filter(F.col("cabeza").isNotNull()).select(F.explode(F.concat(roles, heads)).alias("r")).select("r.*")
    products = named.groupBy("p").agg(F.collect_set("reem").alias("reems"), F.bool_or("es_reem").alias("es_reem"))
    own = products.filter((F.size("reems") > 0) & ~F.col("es_reem"))
    members = own.select(F.col("p").alias("master"), F.explode(F.array_union(F.array("p"), "reems")).alias("Producto"))
    start = first_day(window_start(closed_month, params.window_mid))
    sold = sales.filter((F.col("Fecha") >= F.lit(start)) & (F.col("Fecha") < F.lit(closed_month))).select(
        "Producto", F.lit(0).alias("listas"), F.col("Cantidad").alias("ventas")
    )
    listed_or_sold = members.select("Producto", F.lit(1).alias("listas"), F.lit(0).cast("long").alias("ventas")).unionByName(sold)
    sums = listed_or_sold.groupBy("Producto").agg((F.sum("listas") > 1).alias("compartido"), F.coalesce(F.sum("ventas"), F.lit(0)).alias("ventas"))
    ranked = members.join(sums, "Producto")
    group = Window.partitionBy("master")
    score = F.struct("ventas", (F.col("Producto") == F.col("master")).cast("int").alias("es_master"), "Producto")
    return (
        ranked.withColumns({"_mala": F.bool_or("compartido").over(group), "_mejor": F.max(score).over(group)})
        .filter(~F.col("_mala"))
        .select("Producto", F.col("_mejor.Producto").alias("Producto_Master"))
    )


def imported_products(tracking_imported: DataFrame) -> DataFrame:
    return (
        tracking_imported.filter(F.col("Producto").isNotNull())
        .select("Producto")
        .distinct()
        .orderBy("Producto")
    )


def _first_rows(rows: DataFrame, key: str, columns: dict[str, str], order: str) -> DataFrame:
    """The earliest row of each key, as one map-side reduced aggregate."""
    whole = F.struct(*[F.col(src).alias(dst) for src, dst in columns.items()])
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(first_by(whole, F.col(order)).alias("fila"))
        .select(key, "fila.*")
    )


def dim_product_from_upload(rows: DataFrame, order: str = "fila") -> DataFrame:
    """Product dimension of a published upload: what its first row says."""
    fields = (
        "descripcion",
        "filtro1_final",
        "unidad_medida",
        "costo_unitario",
        "proveedor",
        "es_importado",
    )
    return _first_rows(rows, "producto", {f: f for f in fields}, order)


def dim_branch_from_upload(rows: DataFrame, order: str = "fila") -> DataFrame:
    fields = {
        "nombre_sucursal": "nombre",
        "abastece_cd": "abastece_desde_cd",
        "prioridad_cd": "prioridad_cd",
    }
    return _first_rows(rows, "sucursal_id", fields, order)
