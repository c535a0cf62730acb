"""Registered queries of sources, dimensions, serving and state, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto import fixed_values as V
from reabasto.functions import text as T
from reabasto.operators import catalogue as catalogue_ops
from reabasto.operators import dims, manual, match, parity, postsale, serving, state
from reabasto.operators.serving import Filters
from reabasto.plans import driver_tables as D
from reabasto.plans import publish
from reabasto.plans.pipeline import contract, run_pipeline
from reabasto.session import configured
from reabasto.sources import catalogue as catalogue_source
from reabasto.sources import freshness, grid, postsale as sheet, sales, stock, tracking

Query = Callable[[SparkSession, str], DataFrame]
P = D.PARAMS
PAIR = list(serving.PAIR)
SERVED_DAY = date(2001, 8, 15)
ALL = Filters(solo_pedir=False)
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = configured(fn)
    return QUERIES[fn.__name__]


def rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


# Sources


@query
def text_numbers(spark, d):
    """Number, flag and label spellings over prices of the parts."""
    price = F.format_number("p_retailprice", 2)
    local = F.translate(price, ",.", ".,")
    number = F.col("p_partkey")
    flag = F.when(number % 4 == 0, " SÍ").when(number % 4 == 1, "falso").when(number % 4 == 2, "quizás")
    label = F.concat(F.lit("  Año "), F.col("p_name"), F.lit(" / N° (%) "), F.col("p_brand"))
    return D.table(spark, d, "part").select(
        number.alias("p_partkey"),
        F.round(T.locale_number(local), 2).alias("es_cl"),
        F.round(T.locale_number(price), 2).alias("con_miles"),
        F.round(T.upload_number(F.concat(F.lit("$ "), local)), 2).alias("subida"),
        T.to_bool(flag).alias("marca"),
        T.to_int_round(F.col("p_size") / 2).alias("al_par"),
        T.to_int(F.col("p_size") / 3).alias("entero"),
        T.label_compact(label).alias("clave_compacta"),
        T.label_upload(label).alias("clave_subida"),
        T.label_sheet(label).alias("clave_planilla"),
    )


@query
def sales_report(spark, d):
    return sales.read_sales(D.report_grid(spark, d), {k: v for k, v in V.REPORT_SALES.items() if k not in ("Empresa", "Descripcion Producto")})


@query
def report_without_header(spark, d):
    return grid.files_without_header(
        D.report_tops(spark, d, 3).unionByName(D.report_lines(spark, d)), {k: v for k, v in V.REPORT_SALES.items() if k not in ("Empresa", "Descripcion Producto")}, ["Producto", "Cantidad", "tipoDocto", "tipoproducto"]
    )


@query
def upload_stock(spark, d):
    made = grid.conform_uploads(D.upload_grid(spark, d), V.STOCK_ALIASES)
    return rounded(made.drop("fila"), "stock")


@query
def upload_ignored(spark, d):
    return grid.ignored_headers(D.upload_grid(spark, d), V.STOCK_ALIASES)


@query
def upload_suggestions(spark, d):
    made = grid.conform_uploads(D.suggestion_grid(spark, d), V.SUGGESTION_ALIASES)
    kept = made.select(
        "archivo", *PAIR, "total_sugerido_suc", "es_importado", "lt_efectivo", "filtro1_final", "clasificacion_abc", "total_valor_sugerido_clp"
    )
    return rounded(kept, "total_valor_sugerido_clp")


@query
def upload_sales(spark, d):
    made = grid.conform_uploads(D.sales_grid(spark, d), V.SALES_ALIASES)
    return publish.monthly_sales_rows(made)


@query
def border_report(spark, d):
    return sales.normalize_sales_border(sales.read_border_sales(D.border_grid(spark, d)), P)


@query
def tracking_reports(spark, d):
    return tracking.union_tracking(
        tracking.normalize_tracking_national(tracking.read_tracking_national(D.tracking_grid(spark, d, 0, V.REPORT_TRACKING_NATIONAL)), P),
        tracking.normalize_tracking_imported(tracking.read_tracking_imported(D.tracking_grid(spark, d, 1, V.REPORT_TRACKING_IMPORTED)), P),
        tracking.normalize_tracking_border(tracking.read_tracking_border(D.tracking_grid(spark, d, 2, V.REPORT_TRACKING_BORDER)), P),
    )


@query
def mix_report(spark, d):
    return dims.master_map(sales.read_mix(D.mix_grid(spark, d)), D.mix_sales(spark, d), D.CLOSED_MONTH, P)


@query
def sales_with_history(spark, d):
    raw, since = D.raw_sales_main(spark, d), F.lit(date(1999, 7, 1))
    return sales.normalize_sales_main(raw.filter(F.col("Fecha") >= since), P, raw.filter(F.col("Fecha") < since))


@query
def stock_by_branch_map(spark, d):
    raw = D.lines(spark, d).select(
        F.when(F.col("l_partkey") % 50 != 0, F.col("Producto")).alias("Producto"),
        F.concat(F.lit("Bodega "), F.col("s_nationkey").cast("string")).alias("Bodega"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("string")).otherwise("s/i").alias("Stock"),
        F.lit(" -").alias("Costo"),
    )
    return stock.read_stock(raw, P).drop("Familia")


@query
def border_extract(spark, d):
    orders = D.table(spark, d, "orders")
    number, docs = F.col("o_orderkey"), V.EXTRACT_DOCUMENTS
    pick = F.lit("OTRO")
    for i, name in enumerate(docs):
        pick = F.when(number % 9 == i, name).otherwise(pick)
    documents = orders.select(
        F.when(number % 11 == 0, "E01").otherwise("E07").alias("empresa"),
        pick.alias("tipodocto"),
        number.alias("correlativo"),
        number.alias("numero"),
        F.date_format("o_orderdate", "yyyyMM").alias("periodolibro"),
        F.to_date("o_orderdate").alias("fecha"),
        F.lit("CLIENTE").alias("tipo_venta"),
        F.lit(None).cast("string").alias("marca"),
        F.when(number % 5 == 0, "CAMION NPR 75").when(number % 5 == 1, "D-MAX DMAX").otherwise("X").alias("modelo"),
        F.when(number % 3 == 0, "SUC070").when(number % 3 == 1, "CASA MATRIZ").otherwise("?").alias("local"),
        F.when(number % 6 == 0, "N").otherwise("S").alias("emitido"),
        F.when(number % 13 == 0, "A").otherwise("V").alias("vigencia"),
    )
    keys = documents.select("empresa", "tipodocto", "correlativo")
    lines = D.table(spark, d, "lineitem").join(keys, F.col("l_orderkey") == F.col("correlativo")).select(
        "empresa",
        "tipodocto",
        "correlativo",
        F.col("l_partkey").cast("string").alias("producto"),
        F.col("l_linenumber").alias("linea"),
        F.col("l_quantity").alias("cantidad"),
        F.col("l_extendedprice").alias("neto"),
        F.col("l_extendedprice").alias("total"),
        F.col("l_quantity").alias("costo"),
    )
    part, code = D.table(spark, d, "part"), F.col("p_partkey")
    products = part.select(
        F.explode(F.array(F.lit("E01"), F.lit("E07"))).alias("empresa"),
        code.cast("string").alias("producto"),
        F.concat("p_name", F.lit(" de veinte letras")).alias("glosa"),
        F.when(code % 3 == 0, "REPUESTO").when(code % 3 == 1, "MO_TERC").otherwise("MO_ST").alias("tipoproducto"),
    )
    made = sales.border_sales_extract(
        documents, lines, products, "E07", date(1996, 1, 1), date(2000, 12, 31)
    )
    kept = made.drop("Tipo-Venta", "Marca", "Modelo", "neto", "local")
    return rounded(kept, "total", "Total Neta")


@query
def national_extract(spark, d):
    raw = D.raw_tracking(spark, d).filter("origen = 0")
    wide = raw.select(*[F.col(c).alias(h) for c, h in V.REPORT_TRACKING_NATIONAL.items()], F.lit(1).alias("Otra"))
    return tracking.national_tracking_extract(wide)


@query
def main_extract(spark, d):
    orders = D.table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("Empresa"), F.col("o_orderdate").alias("Fecha"), F.col("o_orderkey").alias("Numero"), F.col("o_totalprice").alias("Total")
    )
    return rounded(sales.main_sales_extract(orders, "F", date(1998, 12, 31)), "Total")


@query
def source_freshness(spark, d):
    return freshness.source_freshness(D.delivery_log(spark, d), date(2024, 2, 5))


@query
def aggregate_catalogue(spark, d):
    made = catalogue_source.aggregate_catalogue(D.catalogue_file(spark, d))
    kept = made.select("producto", "glosa", "familia", "unidad", "costo", "stock_minimo", "stock_total")
    return rounded(kept, "costo")


@query
def catalogue_counts(spark, d):
    return catalogue_source.catalogue_counts(D.catalogue_file(spark, d))


def _sheet(spark, d):
    return sheet.load_postventa(D.raw_sheet(spark, d), D.SHEET_HEADERS)


def _summary(spark, d):
    return postsale.summarise_cells(sheet.sheet_cells(D.raw_sheet(spark, d), D.SHEET_HEADERS), D.SHEET_HEADERS)


@query
def postventa_summary_stored(spark, d):
    return rounded(postsale.postventa_summary(_sheet(spark, d), D.SHEET_HEADERS), "total_clp")


@query
def load_postventa(spark, d):
    return _sheet(spark, d)


@query
def postventa_meta(spark, d):
    return sheet.postventa_meta(_sheet(spark, d))


# Dimensions


@query
def dim_product(spark, d):
    sold = D.raw_sales_main(spark, d).select("Producto", "Descripcion Producto")
    part = D.table(spark, d, "part")
    listed = part.filter("p_partkey % 3 <> 0").select(
        D.product_code().alias("Producto"), F.col("p_type").alias("Categoria"), F.concat("p_name", F.lit(" (LT)")).alias("Glosa")
    )
    held = part.filter("p_partkey % 4 = 0").select(
        D.product_code().alias("Producto"), F.concat(F.lit("RUBRO "), (F.col("p_size") + 5).cast("string")).alias("Familia")
    )
    return dims.dim_product(sold, listed, held, P, D.raw_sales_border(spark, d))


@query
def units_of_measure(spark, d):
    number = F.col("p_partkey")
    mark = (
        F.when(number % 6 == 0, " (ML)").when(number % 6 == 1, " (500ML)").when(number % 6 == 2, " (lt)")
        .when(number % 6 == 3, " (KG)").when(number % 6 == 4, " (gr)").otherwise("")
    )
    code = F.concat(F.lpad(number.cast("string"), 7, "0"), F.when(number % 7 == 0, "-TML").otherwise("X"))
    return D.table(spark, d, "part").select(
        code.alias("producto"),
        dims.unit_of_measure(code, F.concat("p_name", mark)).alias("unidad"),
        dims.product_family(code, dims.rubro(F.lit(None).cast("string"), code), number % 2 == 0, P).alias("familia"),
    )


@query
def master_map(spark, d):
    return dims.master_map(D.mix(spark, d), D.mix_sales(spark, d), D.CLOSED_MONTH, P)


@query
def imported(spark, d):
    return dims.imported_products(D.raw_tracking(spark, d).filter("origen = 1"))


@query
def dim_product_upload(spark, d):
    rows = D.suggestions(spark, d).withColumn("fila", F.col("id") * 100 + F.substring("sucursal_id", 8, 3).cast("long"))
    return dims.dim_product_from_upload(rows)


@query
def dim_branch_upload(spark, d):
    rows = D.suggestions(spark, d).withColumns(
        {"fila": F.struct("id", "producto"), "prioridad_cd": F.substring("sucursal_id", 8, 3).cast("int")}
    )
    return dims.dim_branch_from_upload(rows)


# Serving


@query
def filter_suggestions(spark, d):
    f = Filters(abc=("A", "B"), tipo_origen=("Nacional",), proveedor="plier#00000000", solo_nacionales=True)
    kept = serving.filter_suggestions(D.suggestions(spark, d), f, P)
    return kept.select(*PAIR, "proveedor", "clasificacion_abc", "es_importado", "pedir")


@query
def search_suggestions(spark, d):
    f = Filters(q="RAND#17", sucursales=("Suc NATION_3", "Suc NATION_9"), vista="cd")
    return serving.filter_suggestions(D.suggestions(spark, d), f, P).select(*PAIR, "pedir")


@query
def views_sucursales(spark, d):
    return serving.filtered_pairs(D.suggestions(spark, d), Filters(vista="sucursales"), P)


@query
def views_cd(spark, d):
    return serving.filtered_pairs(D.suggestions(spark, d), Filters(vista="cd"), P)


@query
def views_distribucion(spark, d):
    return serving.filtered_pairs(D.suggestions(spark, d), Filters(vista="distribucion", solo_pedir=False), P)


@query
def suggestion_page(spark, d):
    page = serving.suggestion_page(D.suggestions(spark, d), ALL, P, page=3, limit=40, sort="costo_unitario")
    return page.select(*PAIR, "costo_unitario")


@query
def suggestion_page_seek(spark, d):
    last = {"costo_unitario": 980.0, "producto": "25 Brand#13", "sucursal_id": "NATION_7"}
    page = serving.suggestion_page_after(D.suggestions(spark, d), ALL, P, last, limit=40, sort="costo_unitario")
    return page.select(*PAIR, "costo_unitario")


@query
def suggestion_total(spark, d):
    return serving.suggestion_total(D.suggestions(spark, d), Filters(), P)


@query
def list_search_total(spark, d):
    return manual.list_total(
        D.suggestions(spark, d), D.manual(spark, d), D.serving_catalogue(spark, d), Filters(q="x1"), P, D.NOW, limit=30
    )


@query
def published(spark, d):
    rows = run_pipeline(D.sources(spark, d), D.CLOSED_MONTH, D.TODAY, P)
    return serving.from_contract(contract(rows, P)).select("id", *PAIR, "total_sugerido_suc", "lt_efectivo", "pedir")


@query
def manual_active(spark, d):
    return manual.active_manual_units(D.manual(spark, d), D.NOW)


NUMBERS = ("total_sugerido_suc", "sugerido_compra_neto", "total_valor_sugerido_clp")


@query
def list_with_manual(spark, d):
    units = manual.active_manual_units(D.manual(spark, d), D.NOW)
    made = manual.add_manual(D.suggestions(spark, d), units)
    return rounded(made.select(*PAIR, *NUMBERS, "pedir", "pedir_flag"), "total_valor_sugerido_clp")


@query
def list_search(spark, d):
    made = manual.list_suggestions(
        D.suggestions(spark, d), D.manual(spark, d), D.serving_catalogue(spark, d), D.unified_stock(spark, d),
        D.monthly_sales(spark, d), Filters(q="x1"), P, D.NOW, limit=30,
    )
    kept = made.select("origen", *PAIR, "descripcion", "costo_unitario", "stock_activo_suc", *NUMBERS, "pedir", "reemplazos")
    return rounded(kept, "total_valor_sugerido_clp", "costo_unitario")


@query
def list_by_ids(spark, d):
    ids = [7, -3, 100, 59, 7, 1234, 60, 88]
    picked = serving.list_by_ids(D.suggestions(spark, d), ids)
    made = manual.list_by_ids_with_manual(
        picked, D.manual(spark, d), D.serving_catalogue(spark, d), D.monthly_sales(spark, d), D.NOW
    )
    return made.select("pos", "id", *PAIR, "total_sugerido_suc", "pedir", "reemplazos")


@query
def enrich_replacements(spark, d):
    made = serving.enrich_replacements(D.suggestions(spark, d), D.serving_catalogue(spark, d))
    return made.select(*PAIR, "reemplazos")


@query
def rule_stock_without_sale(spark, d):
    made = serving.rule_stock_without_sale(D.suggestions(spark, d), D.monthly_sales(spark, d), SERVED_DAY)
    return made.select(*PAIR, "pedir", "pedir_flag")


@query
def kpis(spark, d):
    return rounded(serving.kpis(D.suggestions(spark, d), Filters(), P), "valor_total_clp")


@query
def summary_view(spark, d):
    made = serving.summary(D.suggestions(spark, d), P, "sucursales", "plier#00000001")
    return rounded(made, "valor_total_clp")


def _grouped(spark, d, by):
    return rounded(serving.grouped(D.suggestions(spark, d), Filters(), by, P), "valor_clp")


@query
def grouped_branch(spark, d):
    return _grouped(spark, d, "sucursal")


@query
def grouped_brand(spark, d):
    return _grouped(spark, d, "marca")


@query
def grouped_supplier(spark, d):
    return _grouped(spark, d, "proveedor")


@query
def ranking(spark, d):
    return rounded(serving.ranking(D.suggestions(spark, d), "marca", P, 7, "cd"), "valor_clp")


@query
def units_from_days(spark, d):
    return serving.units_from_days(D.suggestions(spark, d).select(*PAIR, "demanda_diaria"), 45).select(*PAIR, "unidades")


@query
def detail(spark, d):
    return serving.detail(D.suggestions(spark, d), "11 Brand#2", "NATION_9").select(
        *PAIR, "descripcion", "total_sugerido_suc", "proveedor"
    )


@query
def sales_12m(spark, d):
    return serving.sales_12m(D.monthly_sales(spark, d), branch="NATION_4")


@query
def sales_12m_totals(spark, d):
    made = serving.sales_12m_totals(serving.sales_12m(D.monthly_sales(spark, d), branch="NATION_4"))
    return rounded(made, "promedio_general", "promedio_sucursal", digits=4)


@query
def coverage(spark, d):
    made = serving.stock_coverage(D.suggestions(spark, d), P)
    return rounded(
        made.select(*PAIR, "stock_optimo", "cobertura_pct", "disponible", "parte_traslado"),
        "stock_optimo", "cobertura_pct", "parte_traslado", digits=4,
    )


def _cart(spark, d, f=Filters()):
    return manual.cart_lines(D.suggestions(spark, d), D.manual(spark, d), D.serving_catalogue(spark, d), f, P, D.NOW)


@query
def cart_lines(spark, d):
    return rounded(manual.sorted_cart_lines(_cart(spark, d)), "subtotal_clp")


@query
def cart_totals(spark, d):
    return rounded(manual.cart_totals(_cart(spark, d)), "total_clp")


@query
def cart_grand_totals(spark, d):
    return rounded(manual.cart_grand_totals(_cart(spark, d, Filters(abc=("A",)))), "total_clp")


@query
def cart_report(spark, d):
    return rounded(manual.cart_report(_cart(spark, d)), "subtotal_clp")


@query
def purchase_orders(spark, d):
    return rounded(manual.purchase_orders(_cart(spark, d)), "Subtotal")


@query
def export_columns(spark, d):
    made = serving.export_columns(D.suggestions(spark, d), ["producto", "nada", "sucursal_id", "pedir", "lt_efectivo"])
    return made


@query
def suggestion_with_manual(spark, d):
    made = manual.suggestion_with_manual(D.suggestions(spark, d), D.manual(spark, d), D.NOW)
    return made.select(*PAIR, "ajuste_manual_vigente", "total_sugerido_con_manual")


@query
def supplier_list(spark, d):
    return serving.supplier_list(D.suggestions(spark, d))


@query
def catalogue_list(spark, d):
    f = catalogue_ops.CatalogueFilters(q="red", procedencia=("NACIONAL",), con_stock=True)
    made = catalogue_ops.catalogue_list(D.serving_catalogue(spark, d), D.unified_stock(spark, d), f, 2, 25, "-costo")
    return made.select("producto", "glosa", "costo", "stock_total")


@query
def catalogue_list_seek(spark, d):
    f = catalogue_ops.CatalogueFilters(q="red", procedencia=("NACIONAL",), con_stock=True)
    last = {"costo": 990.0, "producto": "25 Brand#13"}
    made = catalogue_ops.catalogue_list_after(D.serving_catalogue(spark, d), D.unified_stock(spark, d), f, last, 25, "-costo")
    return made.select("producto", "glosa", "costo", "stock_total")


@query
def catalogue_total(spark, d):
    f = catalogue_ops.CatalogueFilters(q="red", procedencia=("NACIONAL",), con_stock=True)
    return catalogue_ops.catalogue_total(D.serving_catalogue(spark, d), f)


@query
def catalogue_detail(spark, d):
    made = catalogue_ops.catalogue_detail(D.serving_catalogue(spark, d), D.unified_stock(spark, d), "11 Brand#2")
    parts = F.transform("stock_por_sucursal", lambda e: F.concat_ws("|", e["bodega"], e["sucursal_id"], e["origen"], e["stock"].cast("int").cast("string")))
    return made.select("producto", "stock_total", F.array_join(parts, ";").alias("partes"))


@query
def filter_options(spark, d):
    return catalogue_ops.filter_options(D.serving_catalogue(spark, d))


@query
def stock_totals(spark, d):
    return catalogue_ops.stock_total(D.unified_stock(spark, d))


@query
def stock_of_product(spark, d):
    return catalogue_ops.stock_by_branch(D.unified_stock(spark, d), "11 Brand#2")


@query
def product_card(spark, d):
    return catalogue_ops.product_card(D.serving_catalogue(spark, d), D.suggestions(spark, d)).drop("reemplazo", "unidad")


def _dim_upload(spark, d):
    return dim_product_upload(spark, d)


@query
def product_search(spark, d):
    made = catalogue_ops.search_products(_dim_upload(spark, d), D.serving_catalogue(spark, d), "brand#7", limit=60)
    return made.select("producto", "descripcion", "unidad_medida", "orden")


@query
def product_search_total(spark, d):
    return catalogue_ops.search_total(_dim_upload(spark, d), D.serving_catalogue(spark, d), "brand#7", limit=60)


@query
def catalogue_search(spark, d):
    return catalogue_ops.search_catalogue(D.serving_catalogue(spark, d), "blue g")


@query
def list_branches(spark, d):
    return catalogue_ops.list_branches(dim_branch_upload(spark, d))


@query
def postventa_summary(spark, d):
    return rounded(_summary(spark, d), "total_clp")


@query
def periods(spark, d):
    return postsale.periods(_summary(spark, d))


@query
def sales_kpis(spark, d):
    return rounded(postsale.sales_kpis(_summary(spark, d)), "clp", "clp_anterior", "var_clp_pct", "var_unidades_pct")


@query
def monthly_series(spark, d):
    return rounded(postsale.monthly_series(_summary(spark, d)), "clp")


@query
def by_branch(spark, d):
    return rounded(postsale.by_branch(_summary(spark, d), P, "200003"), "clp")


@query
def by_branch_newest(spark, d):
    return rounded(postsale.by_branch(_summary(spark, d), P), "clp")


LINE_DAYS = postsale.LineFilters(fecha_desde=date(1998, 3, 5), fecha_hasta=date(1998, 7, 20), q="urgent")


@query
def sales_lines(spark, d):
    return postsale.sales_lines(_sheet(spark, d), D.SHEET_HEADERS, LINE_DAYS, 2, 50)


@query
def sales_count(spark, d):
    return postsale.sales_count(_sheet(spark, d), D.SHEET_HEADERS, LINE_DAYS)


@query
def sales_export(spark, d):
    f = postsale.LineFilters(periodo_desde="200001", sucursal="NATION_4")
    return rounded(postsale.sales_export(_sheet(spark, d), D.SHEET_HEADERS, f, numeric=True), "Total")


@query
def last_periods_extract(spark, d):
    return postsale.last_periods_extract(D.monthly_sales(spark, d))


CODES = ["11 Brand#2", "1 brand#1", "RAND#25", "nada", "7 Brand#2", "50"]


@query
def code_match(spark, d):
    return match.match_codes(D.suggestions(spark, d), "producto", CODES, P)


@query
def code_match_counts(spark, d):
    return match.match_counts(match.match_codes(D.suggestions(spark, d), "producto", CODES, P))


@query
def column_filter(spark, d):
    rows = D.suggestions(spark, d)
    named = match.column_filter(rows, "proveedor", P, values=["(en blanco)", "Supplier#000000007"])
    return match.column_filter(named, "producto", P, contains="brand#2").select(*PAIR, "proveedor")


@query
def distinct_values(spark, d):
    return match.distinct_values(D.suggestions(spark, d), "producto", P)


@query
def manual_batches(spark, d):
    return state.manual_batches(D.manual(spark, d))


@query
def single_entries(spark, d):
    return state.single_entries(D.manual(spark, d)).select("id", *PAIR, "creado_en")


def _versions(spark, d):
    """Two versions of the table: the second dropped some rows, added some, changed totals."""
    rows = D.suggestions(spark, d).withColumn("k", F.concat_ws("@", *PAIR))
    old = rows.filter("lt_efectivo <> 3")
    new = rows.filter("lt_efectivo <> 4").withColumns(
        {
            "total_sugerido_suc": F.when(F.col("lt_efectivo") == 5, F.col("total_sugerido_suc") + 1).otherwise(F.col("total_sugerido_suc")),
            "pedir": F.when(F.col("lt_efectivo") == 6, F.lit("No")).otherwise(F.col("pedir")),
        }
    )
    return old, new


@query
def shadow_compare(spark, d):
    old, new = _versions(spark, d)
    keys = {c: c for c in PAIR}
    return parity.shadow_compare(new, old, keys, {"total_sugerido_suc": "total_sugerido_suc"}, 0.5)


@query
def shadow_summary(spark, d):
    return rounded(parity.shadow_summary(shadow_compare(spark, d)), "paridad_pct")


@query
def shadow_worst(spark, d):
    return parity.worst_rows(shadow_compare(spark, d), PAIR, 10)


@query
def parity_mismatch(spark, d):
    old, new = _versions(spark, d)
    keys, compared = {c: c for c in PAIR}, {"total_sugerido_suc": "total_sugerido_suc"}
    return parity.parity_mismatch(new, old, keys, compared, 0.5)


@query
def parity_text(spark, d):
    old, new = _versions(spark, d)
    return parity.parity_mismatch(new, old, {c: c for c in PAIR}, {"pedir": "pedir"}).select(*PAIR)


# State


@query
def change_log(spark, d):
    old, new = _versions(spark, d)
    whole = {"total_sugerido_suc": F.col("total_sugerido_suc").cast("long")}
    return state.change_log(old.withColumns(whole), new.withColumns(whole), "k", ["total_sugerido_suc", "pedir"])


@query
def expire_at(spark, d):
    day = F.to_date("o_orderdate")
    return D.table(spark, d, "orders").select(
        "o_orderkey",
        state.expire_at(day, P).alias("expira_en"),
        state.expiry_accepted(day, date(1999, 1, 1), P).alias("aceptada"),
    )


@query
def bulk_manual(spark, d):
    f = Filters(abc=("B",), vista="sucursales")
    made = state.bulk_manual(D.suggestions(spark, d), f, P, "LOTE", D.NOW, "ana", days=30)
    return made.select("id", *PAIR, "unidades", "lote_id", "creado_en", "archivada")


@query
def bulk_counts(spark, d):
    return state.bulk_counts(D.suggestions(spark, d), Filters(abc=("B",), vista="sucursales"), P, days=30)


@query
def drop_batch(spark, d):
    return state.drop_batch(D.manual(spark, d), "L3").select("id", "lote_id", "recurrente_id")


@query
def list_manual(spark, d):
    return state.list_manual(D.manual(spark, d), branch="NATION_4", only_single=True).select("id", *PAIR, "unidades")


@query
def active_entries(spark, d):
    return state.active_entries(D.manual(spark, d), D.NOW, branch="NATION_5").select("id", "unidades", "creado_por")


@query
def active_rules(spark, d):
    return state.active_rules(D.rules(spark, d), branch="NATION_5").select("id", "modo", "unidades", "cada_dias", "proxima_ejecucion")


@query
def recurring_rules(spark, d):
    made = state.advance_rules(D.rules(spark, d), D.NOW.date())
    return made.select("id", "proxima_ejecucion", "activa", "ultima_ejecucion")


@query
def recurring_step(spark, d):
    _, entries = state.process_recurring(
        D.rules(spark, d), D.manual(spark, d), D.suggestions(spark, d), D.NOW.date(), D.NOW, P
    )
    return entries.select("id", *PAIR, "unidades", "archivada", "recurrente_id", "creado_por")


@query
def recurring_counts(spark, d):
    return state.recurring_counts(D.rules(spark, d), D.suggestions(spark, d), D.NOW.date(), D.NOW, P)


@query
def recurring_events(spark, d):
    made = state.recurring_events(D.rules(spark, d), D.suggestions(spark, d), D.NOW.date(), D.NOW, P)
    return made.select("accion", "entidad_id", *PAIR, "unidades", "detalle")


@query
def expired_event(spark, d):
    return state.expired_event(D.manual(spark, d), D.NOW).select("accion", "entidad", "detalle")


@query
def audit_total(spark, d):
    return state.audit_total(D.audit_log(spark, d), without=("error", "click"))


@query
def expire_manual(spark, d):
    return state.archive_expired(D.manual(spark, d), D.NOW).select("id", "archivada")


@query
def count_expired(spark, d):
    return state.count_expired(D.manual(spark, d), D.NOW)


@query
def audit_page(spark, d):
    return state.audit_page(D.audit_log(spark, d), without=("error", "click"), page=2, limit=100)


@query
def audit_page_seek(spark, d):
    return state.audit_after(D.audit_log(spark, d), (datetime(2024, 1, 12, 6), 100), without=("error", "click"))


@query
def last_event(spark, d):
    return state.last_event(D.audit_log(spark, d), "signup")


@query
def unread_notifications(spark, d):
    return state.notifications(D.notifications(spark, d), "ana", only_unread=True, limit=20).select("id", "creado_en", "leida")


@query
def unread_count(spark, d):
    return state.unread_count(D.notifications(spark, d), "ana")


@query
def mark_read(spark, d):
    return state.mark_read(D.notifications(spark, d), "beto").select("id", "vistas_por")


@query
def fixture_subset(spark, d):
    conditions = {
        "clase_a": (F.col("clasificacion_abc") == "A", 8),
        "importado": (F.col("tipo_origen") == "Importado", 10),
        "en_cd": (F.col("sucursal_id") == P.cd_id, 12),
        "grande": (F.col("total_sugerido_suc") > 100, 15),
    }
    return parity.fixture_subset(D.suggestions(spark, d), "producto", conditions, D.mapping(spark, d))


@query
def load_counts(spark, d):
    rows = D.suggestions(spark, d).withColumn("sucursal_id", F.nullif(F.col("sucursal_id"), F.lit("NATION_3")))
    return publish.load_counts(rows, ("producto", "sucursal_id"))


@query
def load_warnings(spark, d):
    return publish.load_warnings(D.suggestions(spark, d), P)


@query
def anomalous_products(spark, d):
    rows = D.suggestions(spark, d).withColumn("total_sugerido_suc", F.col("total_sugerido_suc") * 100)
    return publish.anomalous_products(rows, P)


@query
def replace_stock(spark, d):
    rows = D.unified_stock(spark, d).withColumn("stock", F.when(F.col("stock") < 40, F.col("stock")))
    return publish.stock_rows(rows)


@query
def replace_monthly_sales(spark, d):
    rows = D.monthly_sales(spark, d).withColumn("mes", F.nullif(F.col("mes"), F.lit("200105")))
    return publish.monthly_sales_rows(rows)


@query
def received_check(spark, d):
    kept = publish.valid_rows(D.serving_catalogue(spark, d).filter("stock_total > 0"), ("producto",))
    return publish.received_check(D.serving_catalogue(spark, d), kept, 2000)
