"""Domain tables as views over the star-schema test tables.

Products are `size brand`, branches are nations of the supplier, tracking lines are order
lines, manual entries are purchase events. Everything is derived row by row or by grouping
from the given tables, so the work grows with them.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto.functions.columns import map_value
from reabasto.params import Params
from reabasto.sources import sales as sales_source
from reabasto.sources import tracking as tracking_source
from reabasto.sources.files import Sources

CLOSED_MONTH = date(2001, 11, 1)
TODAY = date(2001, 8, 1)
NOW = datetime(2024, 1, 20)

BRANCHES = [f"NATION_{k}" for k in range(25)]
PARAMS = Params(
    cd_id="NATION_0",
    excluded_branches=("NATION_20",),
    cd_special_branches=("NATION_23", "NATION_24", "NATION_7 VTA MOVIL"),
    branch_merges={"NATION_22": "NATION_21"},
    mobile_branch="NATION_7",
    mobile_branch_final="NATION_7 VTA MOVIL",
    operating_branches=tuple(BRANCHES[1:11]),
    stock_columns={b: f"stock_{b.lower()}" for b in BRANCHES[:11]},
    branch_name_fallback={"NATION_19": "Suc nineteen"},
    excluded_products=("7 Brand#24", "11 Brand#8"),
    excluded_categories=("PROMO",),
    border_branch_prefixes={f"{k:02d} NATION_{k}": f"NATION_{k}" for k in (0, 5, 10, 15)},
    tracking_map_national={f"SUC{10 * k:03d}": f"NATION_{k}" for k in range(21)},
    tracking_map_imported={f"SUC{10 * k:03d}": f"NATION_{k}" for k in range(0, 25, 2)},
    tracking_map_border={f"NATION_{k}": f"NATION_{k}" for k in range(0, 25, 3)},
    warehouse_map={f"BODEGA {k}": f"NATION_{k}" for k in range(20)},
    home_region="AMERICA",
    cd_days_special={"NATION_9": 2, "NATION_5": 1},
    cd_priority={f"NATION_{k}": k for k in range(1, 12)},
    hidden_prefixes=("13 BRAND#1", "14 brand#2"),
)


# Columns of the test tables, stated so that no read infers them.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def product_code() -> Column:
    return F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their part, supplier and nation."""
    part = table(spark, sf_dir, "part").withColumn("Producto", product_code())
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )


def _is_border() -> Column:
    return (F.col("l_linestatus") == "O") & (F.col("s_nationkey") % 5 == 0)


def raw_sales_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    return (
        lines(spark, sf_dir)
        .filter(~_is_border())
        .select(
            "Producto",
            F.col("n_name").alias("SUCURSAL"),
            F.when(number == 1, "VTA MOVIL").otherwise("VTA MESON").alias("Tipo-Venta"),
            F.to_date("l_shipdate").alias("Fecha"),
            F.col("l_quantity").cast("long").alias("Cantidad"),
            F.when(F.col("l_returnflag") == "R", "NC CLIENTE S/T").otherwise("FACTURA").alias("tipoDocto"),
            F.when(number == 7, "MO_ST").otherwise("REPUESTOS").alias("tipoproducto"),
            F.col("p_name").alias("Descripcion Producto"),
        )
    )


def _numbered_branch() -> Column:
    return F.concat(F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit(" "), F.col("n_name"))


def raw_sales_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, flag = F.col("l_linenumber"), F.col("l_returnflag")
    return (
        lines(spark, sf_dir)
        .filter(_is_border())
        .select(
            F.col("Producto").alias("producto"),
            _numbered_branch().alias("SUCURSAL"),
            F.lit("CLIENTE").alias("Tipo-Venta"),
            F.to_date("l_shipdate").alias("fecha"),
            F.col("l_quantity").cast("long").alias("cantidad"),
            F.when(flag == "R", "NOTA CREDITO ST")
            .when(flag == "A", "FACTURA ST")
            .when(number == 2, "FACTURA REPUESTOS (E)")
            .otherwise("CARGO INTERNO")
            .alias("Documento"),
            F.when(number == 3, "Emision Pendiente").otherwise("Emitido").alias("Docto-Emitido"),
            F.when(number == 7, "MO_ST").otherwise("REPUESTO").alias("tipoproducto"),
        )
    )


def sales_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of the two companies as the reports deliver them, each normalised, then united."""
    return sales_source.union_sales(
        sales_source.normalize_sales_main(raw_sales_main(spark, sf_dir), PARAMS),
        sales_source.normalize_sales_border(raw_sales_border(spark, sf_dir), PARAMS),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in one pass over the order lines."""
    number, flag, border = F.col("l_linenumber"), F.col("l_returnflag"), _is_border()
    raw = lines(spark, sf_dir).select(
        border.alias("frontera"),
        "Producto",
        F.when(border, _numbered_branch()).otherwise(F.col("n_name")).alias("SUCURSAL"),
        F.when(border, "CLIENTE").when(number == 1, "VTA MOVIL").otherwise("VTA MESON").alias("Tipo-Venta"),
        F.to_date("l_shipdate").alias("Fecha"),
        F.col("l_quantity").cast("long").alias("Cantidad"),
        F.when(border & (flag == "R"), "NOTA CREDITO ST")
        .when(border & (flag == "A"), "FACTURA ST")
        .when(border & (number == 2), "FACTURA REPUESTOS (E)")
        .when(border, "CARGO INTERNO")
        .when(flag == "R", "NC CLIENTE S/T")
        .otherwise("FACTURA")
        .alias("documento"),
        F.when(number == 3, "Emision Pendiente").otherwise("Emitido").alias("emitido"),
        F.when(number == 7, "MO_ST").when(border, "REPUESTO").otherwise("REPUESTOS").alias("tipoproducto"),
    )
    return sales_source.normalize_sales(raw, F.col("frontera"), PARAMS)


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd brands form one group each, headed by their smallest size."""
    part = table(spark, sf_dir, "part").filter(
        F.substring("p_brand", 7, 10).cast("int") % 2 == 1
    )
    head = part.groupBy("p_brand").agg(F.min("p_size").alias("menor"))
    return (
        part.select("p_brand", "p_size")
        .distinct()
        .join(head, "p_brand")
        .select(
            product_code().alias("Producto"),
            F.concat_ws(" ", F.col("menor").cast("string"), "p_brand").alias("Producto_Master"),
        )
    )


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .groupBy(product_code().alias("Producto"))
        .agg(F.min("p_type").alias("Categoria"))
    )


def dim_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation but the nineteenth is named."""
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .filter(F.col("n_nationkey") != 19)
        .select(
            F.col("n_name").alias("SucursalID"),
            F.concat(F.lit("Suc "), "n_name").alias("Nombre"),
            F.col("r_name").alias("Region"),
        )
    )


def raw_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as purchase orders; `origen` 0 national, 1 imported, 2 border."""
    part = table(spark, sf_dir, "part").select("p_partkey", product_code().alias("Producto"))
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    place, ordered = F.col("l_orderkey") % 25, F.to_date("o_orderdate")
    nameless = (F.col("l_linenumber") == 6) & (F.col("s_suppkey") % 10 == 0)
    return joined.select(
        (F.col("s_suppkey") % 3).alias("origen"),
        "Producto",
        F.concat(F.lit("SUC"), F.lpad((place * 10).cast("string"), 3, "0")).alias("Sucursal"),
        F.concat(F.lit("NATION_"), place.cast("string")).alias("NombreLocal"),
        F.when(~nameless, F.col("s_name")).alias("RazonSocial"),
        F.when(F.col("l_returnflag") == "A", "Reposicion")
        .when(F.col("l_returnflag") == "N", "REPOSICION")
        .otherwise("Compra calzada")
        .alias("Motivo"),
        ordered.alias("FechaOC"),
        F.col("o_orderkey").alias("NOC"),
        F.col("l_quantity").cast("long").alias("Cantidad"),
        F.when(F.col("o_orderstatus") == "P", "Pendiente").otherwise("Cerrado").alias("EstadoOC"),
        F.when(F.col("o_orderstatus") == "O", "PENDIENTE").otherwise("Cerrado").alias("EstadoDoc"),
        F.date_add(ordered, F.lit(3)).alias("FechaDoc"),
        F.when(
            F.col("l_linenumber") != 2, F.date_add(ordered, F.col("l_quantity").cast("int"))
        ).alias("FechaPE"),
    )


def tracking_by_origin(spark: SparkSession, sf_dir: str, mode: str = "base") -> DataFrame:
    """The three origins as the reports deliver them, each normalised, then united."""
    raw = raw_tracking(spark, sf_dir)
    border = raw.filter("origen = 2").drop("NOC", "Motivo")
    return tracking_source.union_tracking(
        tracking_source.normalize_tracking_national(raw.filter("origen = 0"), PARAMS, mode),
        tracking_source.normalize_tracking_imported(raw.filter("origen = 1"), PARAMS, mode),
        tracking_source.normalize_tracking_border(border, PARAMS, mode),
    )


def tracking(spark: SparkSession, sf_dir: str, mode: str = "base") -> DataFrame:
    """The same rows in one pass over the order lines."""
    kind, unknown = F.col("origen"), F.lit(PARAMS.unknown_branch)
    border = kind == 2
    branch = (
        F.when(kind == 0, map_value(F.col("Sucursal"), PARAMS.tracking_map_national))
        .when(kind == 1, map_value(F.col("Sucursal"), PARAMS.tracking_map_imported))
        .otherwise(map_value(F.col("NombreLocal"), PARAMS.tracking_map_border))
    )
    origin = (
        F.when(kind == 0, PARAMS.origin_national)
        .when(kind == 1, PARAMS.origin_imported)
        .otherwise(PARAMS.origin_border)
    )
    return (
        raw_tracking(spark, sf_dir)
        .withColumns(
            {
                "SucursalID": F.coalesce(branch, unknown),
                "Origen_": origin,
                "NOC": F.when(~border, F.col("NOC")),
                "Motivo": F.when(~border, F.col("Motivo")),
            }
        )
        .drop("origen")
        .withColumnRenamed("Origen_", "Origen")
        .select(*tracking_source.PROJECTIONS[mode])
    )


def _stock_rows(spark: SparkSession, sf_dir: str, kept: Column) -> DataFrame:
    """Every order line is a stock line of one of the two companies, most of them of nothing."""
    held = F.greatest(F.col("l_quantity") - 46, F.lit(0)).cast("long")
    return lines(spark, sf_dir).filter(kept).select("Producto", F.col("n_name").alias("SucursalID"), held.alias("Stock"))


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stock_rows(spark, sf_dir, F.col("l_orderkey") % 4 != 0)


def stock_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stock_rows(spark, sf_dir, F.col("l_orderkey") % 4 == 0)


def all_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of both companies in one pass."""
    return _stock_rows(spark, sf_dir, F.lit(True))


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .filter(F.col("p_brand").isin("Brand#1", "Brand#2"))
        .select(product_code().alias("Producto"))
        .distinct()
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        product_code().alias("Producto"),
        F.col("p_name").alias("Descripcion"),
        F.col("p_brand").alias("FILTRO1_Final"),
        F.col("p_type").alias("UnidadMedida"),
    )


def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.translate(F.format_string("%.2f", "p_retailprice"), ".", ",")
    return table(spark, sf_dir, "part").select(
        product_code().alias("Producto"),
        F.when(F.col("p_partkey") % 10 == 0, " -").otherwise(text).alias("Costo"),
    )


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    return Sources(
        sales=sales(spark, sf_dir),
        mapping=mapping(spark, sf_dir),
        dim_product=dim_product(spark, sf_dir),
        dim_branch=dim_branch(spark, sf_dir),
        tracking=None,
        tracking_transit=tracking(spark, sf_dir, "transit"),
        tracking_lead_time=tracking(spark, sf_dir, "lead_time"),
        imported=imported(spark, sf_dir),
        stock=all_stock(spark, sf_dir),
        stock_border=None,
        catalogue=catalogue(spark, sf_dir),
        cost=cost(spark, sf_dir),
    )


# Serving tables


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published table: one row per product and branch, figures from the order lines.

    Only numbers are aggregated over the lines; names come afterwards from the part and the
    supplier with the smallest key.
    """
    quantity = F.col("l_quantity")
    numbers = (
        lines(spark, sf_dir)
        .groupBy(
            F.col("Producto").alias("producto"),
            F.col("p_brand").alias("filtro1_final"),
            F.col("n_name").alias("sucursal_id"),
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
            F.min("l_partkey").alias("_parte"),
            F.min("l_suppkey").alias("_prov"),
            F.max("p_retailprice").alias("_costo"),
            F.sum(quantity).alias("_q"),
            F.sum(F.when(F.col("l_returnflag") == "A", quantity)).alias("total_sugerido_suc"),
            F.sum(F.when(F.col("l_tax") > 0.07, quantity)).alias("stock_activo_suc"),
            F.sum(F.when(F.col("l_tax") < 0.01, quantity)).alias("stock_en_transito_suc"),
        )
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("_parte"), F.col("p_name").alias("descripcion"), F.col("p_type").alias("unidad_medida")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("_prov"), F.col("s_name").alias("_proveedor")
    )
    base = numbers.join(parts, "_parte").join(suppliers, "_prov").drop("_parte", "_prov")
    n, total = F.col("n"), F.col("total_sugerido_suc")
    foreign = F.col("filtro1_final").isin("Brand#1", "Brand#2")
    order = F.when(total > 0, "Si").otherwise("No")
    moved = F.when(n % 6 == 0, F.floor(total / 2).cast("double"))
    return base.withColumns(
        {
            "nombre_sucursal": F.concat(F.lit("Suc "), "sucursal_id"),
            "clasificacion_abc": F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1)),
            "proveedor": F.when(n % 11 != 0, F.col("_proveedor")),
            "tipo_origen": F.when(foreign, "Importado").otherwise("Nacional"),
            "es_importado": F.when(n % 5 != 0, foreign),
            "abastece_cd": F.when(n % 3 == 0, "Si").when(n % 3 == 1, "No"),
            "demanda_mensual": F.col("_q") / 84,
            "demanda_diaria": F.when(n % 7 != 0, F.col("_q") / 84 / 22),
            "lt_efectivo": n % 9,
            "stock_seguridad": F.floor(F.col("_q") / 100),
            "costo_unitario": F.when(n % 13 != 0, F.col("_costo")),
            "sugerido_traslado": moved,
            "sugerido_compra_neto": F.when(n % 10 == 0, 0.0).when(
                n % 10 != 1, total - F.coalesce(moved, F.lit(0.0))
            ),
            "total_valor_sugerido_clp": total * F.when(n % 13 != 0, F.col("_costo")),
            "pedir": order,
            "pedir_flag": order,
            "reemplazos": F.when(n % 2 == 1, ""),
        }
    ).drop("n", "_proveedor", "_costo", "_q")


def serving_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the parts, and as many codes of their own that no suggestion has."""
    part = table(spark, sf_dir, "part")
    codes = F.array(product_code(), F.concat(F.lit("X"), F.col("p_partkey").cast("string")))
    return (
        part.withColumn("producto", F.explode(codes))
        .groupBy("producto")
        .agg(
            F.min("p_name").alias("glosa"),
            F.min("p_type").alias("familia"),
            F.when(F.min("p_partkey") % 3 == 0, "IMPORTADO").otherwise("NACIONAL").alias("procedencia"),
            F.max("p_brand").alias("categoria"),
            F.max("p_retailprice").alias("costo"),
            F.lit("UN").alias("unidad"),
            F.concat(F.lit("R-"), F.min("p_partkey").cast("string")).alias("reemplazo"),
            F.sum(F.col("p_size") - 25).cast("double").alias("stock_total"),
        )
    )


def unified_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        lines(spark, sf_dir)
        .groupBy(
            F.col("Producto").alias("producto"),
            F.concat(F.lit("B"), (F.col("l_orderkey") % 3).cast("string")).alias("bodega"),
            F.col("n_name").alias("sucursal_id"),
            F.when(_is_border(), "B").otherwise("M").alias("origen"),
        )
        .agg(F.sum("l_quantity").alias("stock"))
    )


def monthly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return (
        lines(spark, sf_dir)
        .groupBy(
            F.col("Producto").alias("producto"),
            F.col("n_name").alias("sucursal_id"),
            F.date_format("l_shipdate", "yyyyMM").alias("mes"),
        )
        .agg(F.sum(signed).alias("cantidad"))
    )


def _event_products(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of a kind with the product of the part numbered like their user."""
    part = table(spark, sf_dir, "part").select("p_partkey", product_code().alias("codigo"))
    number = F.col("event_id")
    own = F.concat(F.lit("X"), F.col("user_id").cast("string"))
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == kind)
        .join(part, F.col("user_id") == F.col("p_partkey"))
        .withColumns(
            {
                "producto": F.when(number % 9 == 0, own).otherwise(F.col("codigo")),
                "sucursal_id": F.concat(F.lit("NATION_"), (number % 25).cast("string")),
            }
        )
    )


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id")
    return _event_products(spark, sf_dir, "purchase").select(
        F.concat(F.lit("M"), number.cast("string")).alias("id"),
        "producto",
        "sucursal_id",
        F.ceil("value").cast("long").alias("unidades"),
        F.lit(None).cast("string").alias("motivo"),
        F.lit("ana").alias("creado_por"),
        F.date_trunc("second", "ts").alias("creado_en"),
        (number % 7 == 0).alias("archivada"),
        F.when(number % 5 == 0, F.concat(F.lit("R"), (number % 500).cast("string"))).alias("recurrente_id"),
        F.when(number % 3 == 0, F.concat(F.lit("L"), (number % 20).cast("string"))).alias("lote_id"),
        F.when(
            number % 4 != 0, F.timestamp_add("DAY", F.ceil("value").cast("int"), F.date_trunc("day", "ts"))
        ).alias("expira_en"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, day = F.col("event_id"), F.to_date("ts")
    brand = F.concat(F.lit("Brand#"), (number % 25 + 1).cast("string"))
    branch = F.concat(F.lit("Suc NATION_"), (number % 25).cast("string"))
    narrow = F.concat(
        F.lit('{"sucursales":["'), branch, F.lit('"],"abc":["A","B"],"filtro1":["'), brand, F.lit('"]}')
    )
    wide = F.concat(
        F.lit('{"abc":["C"],"filtro1":["'), brand, F.lit('"],"solo_pedir":false,"vista":"sucursales"}')
    )
    return _event_products(spark, sf_dir, "signup").select(
        F.concat(F.lit("R"), number.cast("string")).alias("id"),
        F.when(number % 3 == 0, "grupo").otherwise("individual").alias("modo"),
        "producto",
        "sucursal_id",
        F.when(number % 3 == 0, F.when(number % 2 == 0, narrow).otherwise(wide)).alias("filtros"),
        (number % 5 + 1).alias("unidades"),
        F.when(number % 4 == 0, 60).alias("dias_inventario"),
        F.lit(None).cast("string").alias("motivo"),
        (number % 7 + 1).cast("int").alias("cada_dias"),
        day.alias("proxima_ejecucion"),
        F.when(number % 5 == 0, F.date_add(day, (number % 30).cast("int"))).alias("fecha_fin"),
        (number % 6 != 0).alias("activa"),
        F.lit(None).cast("date").alias("ultima_ejecucion"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("accion"),
        F.date_trunc("second", "ts").alias("creado_en"),
        F.col("props").alias("detalle"),
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id")
    seen = F.when(number % 3 == 0, "").when(number % 3 == 1, "ana,beto").otherwise(" caro , ana,")
    return (
        table(spark, sf_dir, "events")
        .filter("event_type = 'error'")
        .select(
            number.cast("string").alias("id"),
            F.date_trunc("second", "ts").alias("creado_en"),
            F.when(number % 4 != 0, seen).alias("vistas_por"),
        )
    )


def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(kind == "click", "stock_bodegas")
        .when(kind == "view", "seguimiento_frontera")
        .when(kind == "error", "ventas_frontera")
        .when(kind == "signup", "catalogo")
        .otherwise("otra")
        .alias("fuente"),
        F.to_date("ts").alias("entregado"),
    )


SHEET_HEADERS = ["Periodo", "Local", "SUCURSAL", "Producto", "Fecha", "Cantidad", "Total", "Total Neta"]


def raw_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheet rows: some one cell short, some one too long, days in four spellings."""
    number, day = F.col("o_orderkey"), F.col("o_orderdate")
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    spelled = (
        F.when(number % 4 == 0, F.date_format(day, "MM/dd/yyyy HH:mm:ss"))
        .when(number % 4 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(number % 4 == 2, F.date_format(day, "yyyy-MM-dd"))
        .otherwise("sin fecha")
    )
    amount = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    cells = F.array(
        F.when(number % 50 != 0, F.date_format(day, "yyyyMM")).otherwise(" "),
        F.concat(F.lit("SUC"), F.col("n_nationkey").cast("string")),
        F.when(number % 40 != 0, F.concat(F.lit(" "), "n_name")),
        F.col("o_orderpriority"),
        spelled,
        (number % 9).cast("string"),
        F.format_string("%.2f", "o_totalprice"),
        amount,
    )
    cut = F.when(number % 5 == 0, F.slice(cells, 1, 7)).when(
        number % 7 == 0, F.concat(cells, F.array(F.lit("sobra")))
    )
    return joined.select(number.alias("id"), F.coalesce(cut, cells).alias("valores"))


def catalogue_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue lines: several per code, blanks and both number spellings."""
    number = F.col("p_partkey")
    price = F.format_number("p_retailprice", 2)
    return table(spark, sf_dir, "part").select(
        number.alias("fila"),
        F.when(number % 97 != 0, F.concat(F.lit(" "), product_code())).otherwise(" ").alias("Producto"),
        F.when(number % 3 != 0, F.col("p_name")).otherwise("").alias("Glosa"),
        F.when(number % 4 != 0, F.col("p_type")).alias("Familia"),
        F.lit("UN").alias("Unidad"),
        F.when(number % 2 == 0, F.translate(price, ",.", ".,")).otherwise(
            F.translate(F.format_string("%.2f", "p_retailprice"), ".", ",")
        ).alias("Costo"),
        F.when(number % 5 != 0, (F.col("p_size") * 2).cast("string")).alias("Stock"),
        F.when(number % 6 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("StockMinimo"),
    )


def report_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines as four report files: title rows, then a header row in another column order in
    each, in the last one far down."""
    return _flagged(report_tops(spark, sf_dir, 4), report_lines(spark, sf_dir))


def _flagged(tops: DataFrame, data: DataFrame) -> DataFrame:
    """A grid that tells the rows above the data, among which its headers are."""
    return tops.withColumn("cabecera", F.lit(True)).unionByName(data.withColumn("cabecera", F.lit(False)))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data rows of the report files."""
    number = F.col("l_linenumber")
    day = (
        F.when(number % 3 == 0, F.date_format("l_shipdate", "dd/MM/yyyy"))
        .when(number % 3 == 1, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.datediff("l_shipdate", F.lit("1899-12-30").cast("date")).cast("string"))
    )
    code = F.concat(F.col("Producto"), F.lit(" "))
    quantity = F.col("l_quantity").cast("string")
    kind = F.when(number == 7, "1M.O.").otherwise("4Repuesto")
    document = F.when(F.col("l_returnflag") == "R", "NC LIQ FACT").otherwise("FACTURA")
    sale = F.lit("VTA MESON")
    none, noise, branch = F.lit(None).cast("string"), F.lit("ruido"), _numbered_branch()
    cells = (
        F.when(F.col("l_suppkey") % 4 == 0, F.array(code, branch, sale, day, quantity, document, noise, kind, none))
        .when(F.col("l_suppkey") % 4 == 1, F.array(kind, document, quantity, day, sale, branch, noise, code, none))
        .when(F.col("l_suppkey") % 4 == 2, F.array(day, quantity, kind, document, code, noise, none, branch, sale))
        .otherwise(F.array(day, quantity, kind, document, code, none, none, branch, sale))
    )
    return lines(spark, sf_dir).select(
        _report_file(F.col("l_suppkey")).alias("archivo"), (F.col("l_orderkey") + 100).alias("fila"), cells.alias("celdas")
    )


def _report_file(key: Column) -> Column:
    return F.concat(F.lit("informe_"), (key % 4).cast("string"))


def report_tops(spark: SparkSession, sf_dir: str, headed: int) -> DataFrame:
    """The rows above the data of the report files: titles, and the headers of the first `headed` files."""
    file_of = _report_file
    titles = table(spark, sf_dir, "nation").select(
        file_of(F.col("n_nationkey")).alias("archivo"),
        F.floor(F.col("n_nationkey") / 4).alias("fila"),
        F.array(F.col("n_name"), *[F.lit(None).cast("string")] * 8).alias("celdas"),
    )
    layouts = [
        ["Producto", "SUCURSAL", "Tipo-Venta", "Fecha", "Cantidad", "tipoDocto", "Tipo Producto", "tipoproducto", "x"],
        ["TIPOPRODUCTO", "tipo docto", "Cantidad ", "FECHA", "Tipo Venta", "Sucursal", "Código", "producto", "x"],
        ["Fecha", "Cantidad", "tipoproducto", "tipoDocto", "Producto", "Producto", "x", "SUCURSAL", "Tipo-Venta"],
        ["Fecha", "Cantidad", "tipoproducto", "TIPO DOCTO", "Producto", "y", "z", "SUCURSAL", "Tipo-Venta"],
    ]
    header = F.lit(None)
    for i, names in enumerate(layouts):
        header = F.when(F.col("r_regionkey") == i, F.array(*[F.lit(n) for n in names])).otherwise(header)
    headers = (
        table(spark, sf_dir, "region")
        .filter(F.col("r_regionkey") < headed)
        .select(
            file_of(F.col("r_regionkey")).alias("archivo"),
            F.when(F.col("r_regionkey") == 3, 60).otherwise(9).cast("long").alias("fila"),
            header.alias("celdas"),
        )
    )
    return titles.unionByName(headers)


def upload_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock uploads of three layouts, header in the first row."""
    file_of = lambda key: F.concat(F.lit("stock_"), (key % 3).cast("string"))
    layouts = [
        ["Código", "Bodega", "Sucursal ID", "Stock", "Empresa", "Nota"],
        ["Stock", "ORIGEN", "Producto", "bodega", "SUCURSAL", "Cantidad"],
        ["Codigo-Producto", "producto", "Bodega.", "stock", "otro %", "origen"],
    ]
    header = F.lit(None)
    for i, names in enumerate(layouts):
        header = F.when(F.col("r_regionkey") == i, F.array(*[F.lit(n) for n in names])).otherwise(header)
    headers = (
        table(spark, sf_dir, "region")
        .filter("r_regionkey < 3")
        .select(file_of(F.col("r_regionkey")).alias("archivo"), F.lit(0).cast("long").alias("fila"), header.alias("celdas"))
    )
    place = F.concat(F.lit("B"), (F.col("l_orderkey") % 3).cast("string"))
    amount = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    tag, note = F.when(F.col("l_linenumber") > 3, "M").otherwise(" "), F.lit("nota")
    cells = (
        F.when(F.col("l_suppkey") % 3 == 0, F.array("Producto", place, "n_name", amount, tag, note))
        .when(F.col("l_suppkey") % 3 == 1, F.array(F.lit("1"), tag, F.col("Producto"), place, F.col("n_name"), amount))
        .otherwise(F.array(note, F.col("Producto"), place, amount, note, tag))
    )
    data = lines(spark, sf_dir).select(
        file_of(F.col("l_suppkey")).alias("archivo"), (F.col("l_orderkey") + 1).alias("fila"), cells.alias("celdas")
    )
    return _flagged(headers, data)


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement base with planted conflicts and shared replacements."""
    number = F.col("p_partkey")
    code = lambda step: F.concat(F.lit("K"), (number + step).cast("string"))
    first = F.when(number % 4 == 0, code(1)).when(number % 40 == 1, code(1)).when(number % 60 == 58, code(3))
    second = F.when(number % 8 == 0, code(2)).otherwise(" ")
    third = F.when(number % 16 == 0, code(3))
    return table(spark, sf_dir, "part").select(
        F.concat(code(0), F.lit(" ")).alias("Producto"),
        first.alias("Reem1"),
        second.alias("Reem2"),
        third.alias("Reem3"),
    )


def mix_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("K"), F.col("l_partkey").cast("string")).alias("Producto"),
        F.to_date("l_shipdate").alias("Fecha"),
        F.col("l_quantity").cast("long").alias("Cantidad"),
    )


# Reports and uploads as grids


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _grid(spark: SparkSession, sf_dir: str, rows: DataFrame, name: str, fila: Column, at: int, cells: dict[str, Column]) -> DataFrame:
    """Rows as one report file: titles, a header row at place `at`, then the cells under their headers."""
    tops = table(spark, sf_dir, "region").filter("r_regionkey < 2").select(
        F.lit(name).alias("archivo"),
        F.when(F.col("r_regionkey") == 0, at).otherwise(0).cast("long").alias("fila"),
        F.when(F.col("r_regionkey") == 0, F.array(*[F.lit(h) for h in cells]))
        .otherwise(F.array(F.lit("Informe"), *[F.lit(None).cast("string")] * (len(cells) - 1)))
        .alias("celdas"),
    )
    if at == 0:  # an upload has nothing above its header
        tops = tops.filter(F.size(F.array_compact("celdas")) == len(cells))
    return _flagged(tops, rows.select(F.lit(name).alias("archivo"), (fila + 100).alias("fila"), F.array(*cells.values()).alias("celdas")))


def border_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border sales as their report delivers them."""
    rows = raw_sales_border(spark, sf_dir).withColumns(
        {"fecha": F.date_format("fecha", "dd/MM/yyyy"), "cantidad": F.concat(_text("cantidad"), F.lit(".0"))}
    )
    headers = {"Docto-Emitido": "Docto-Emitido", "cantidad": "Cantidad", "SUCURSAL": "Sucursal", "producto": "PRODUCTO", "fecha": "fecha",
               "Documento": "documento", "Tipo-Venta": "Tipo Venta", "tipoproducto": "tipoproducto"}
    cells = {h: F.col(f"`{c}`") for c, h in headers.items()}
    return _grid(spark, sf_dir, rows, "frontera", F.monotonically_increasing_id(), 50, cells)


def tracking_grid(spark: SparkSession, sf_dir: str, kind: int, headers: dict[str, str]) -> DataFrame:
    """Orders of one origin as its report delivers them; the border report has no order number."""
    rows = raw_tracking(spark, sf_dir).filter(F.col("origen") == kind)
    made = {
        c: F.date_format(c, "yyyy-MM-dd") if tracking_source.TYPES.get(c) == "date" else _text(c)
        for c in headers
    }
    if kind == 2:
        made["NOC"] = F.lit(None).cast("string")
    cells = {headers[c]: v for c, v in made.items() if not (kind == 2 and c == "FechaOC")}
    return _grid(spark, sf_dir, rows, f"seguimiento_{kind}", F.monotonically_increasing_id(), 7, cells)


def mix_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = {"Reem1": F.col("Reem1"), "Nota": F.lit("x"), "producto": F.col("Producto"), "REEM3": F.col("Reem3"), "Reem2": F.col("Reem2")}
    return _grid(spark, sf_dir, mix(spark, sf_dir), "mix", F.monotonically_increasing_id(), 44, cells)


def _local(column: str) -> Column:
    return F.translate(F.format_number(column, 2), ",.", ".,")


def suggestion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestion uploads of two layouts."""
    rows, even = suggestions(spark, sf_dir), F.col("id") % 2 == 0
    flag = F.when(F.col("es_importado"), " SÍ").when(~F.col("es_importado"), "no").otherwise("")
    one = {"Código": F.col("producto"), "Sucursal": F.col("sucursal_id"), "Total Sugerido": _local("total_sugerido_suc"),
           "Es Importado?": flag, "LT Efectivo": F.concat(_text("lt_efectivo"), F.lit(",4")), "Marca": F.col("filtro1_final")}
    two = {"ABC": F.col("clasificacion_abc"), "valor sugerido (CLP)": F.concat(F.lit("$ "), _local("total_valor_sugerido_clp")),
           "SucursalID": F.concat(F.lit(" "), "sucursal_id"), "Producto": F.col("producto"), "Otra": F.lit("x")}
    return _grid(spark, sf_dir, rows.filter(even), "sugerido_a", F.col("id"), 0, one).unionByName(
        _grid(spark, sf_dir, rows.filter(~even), "sugerido_b", F.col("id"), 0, two)
    )


def sales_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sales uploads of two layouts."""
    rows, even = monthly_sales(spark, sf_dir), F.length("producto") % 2 == 0
    one = {"Codigo": F.col("producto"), "Periodo": F.col("mes"), "Sucursal": F.col("sucursal_id"), "Unidades": _local("cantidad")}
    two = {"ventas": _text("cantidad"), "Año-Mes": F.lit(""), "MES": F.col("mes"), "Nombre Sucursal": F.col("sucursal_id"), "producto": F.col("producto")}
    number = F.monotonically_increasing_id()
    return _grid(spark, sf_dir, rows.filter(even), "ventas_a", number, 0, one).unionByName(
        _grid(spark, sf_dir, rows.filter(~even), "ventas_b", number, 0, two)
    )
