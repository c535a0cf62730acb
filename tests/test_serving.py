from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from reabasto import schemas as S
from reabasto.operators import catalogue as cat
from reabasto.operators import manual, match, parity, postsale, serving
from reabasto.operators.serving import Filters

NOW = datetime(2026, 7, 10, 12)
COLUMNS = {
    "id": "long", "producto": "string", "sucursal_id": "string", "descripcion": "string", "nombre_sucursal": "string",
    "clasificacion_abc": "string", "proveedor": "string", "filtro1_final": "string", "tipo_origen": "string", "es_importado": "boolean",
    "abastece_cd": "string", "unidad_medida": "string", "demanda_mensual": "double", "demanda_diaria": "double", "stock_activo_suc": "double",
    "stock_en_transito_suc": "double", "lt_efectivo": "long", "stock_seguridad": "long", "costo_unitario": "double",
    "total_sugerido_suc": "double", "total_valor_sugerido_clp": "double", "sugerido_traslado": "double", "sugerido_compra_neto": "double",
    "pedir": "string", "pedir_flag": "string", "reemplazos": "string",
}
BASE = {
    "id": 1, "producto": "P1", "sucursal_id": "TALCA", "descripcion": "filtro aceite", "nombre_sucursal": "Talca", "clasificacion_abc": "A",
    "proveedor": "ACME", "filtro1_final": "FORD", "tipo_origen": "Nacional", "es_importado": False, "abastece_cd": "No", "costo_unitario": 5000.0,
    "total_sugerido_suc": 10.0, "total_valor_sugerido_clp": 50000.0, "sugerido_compra_neto": 6.0, "pedir": "Si", "pedir_flag": "Si",
}


def table(spark, *changes):
    schema = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    made = [{**dict.fromkeys(COLUMNS), **BASE, **change} for change in changes]
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in made], schema)


def entries(spark, *given):
    """(product, branch, units[, archived[, expires]])"""
    full = [
        (f"m{i}", p, b, u, None, "ana", datetime(2026, 7, 1), *(rest[:1] or (False,)), None, None, rest[1] if len(rest) > 1 else None)
        for i, (p, b, u, *rest) in enumerate(given)
    ]
    return spark.createDataFrame(full, S.MANUAL)


CATALOGUE = "producto string, glosa string, familia string, procedencia string, categoria string, costo double, unidad string, reemplazo string, stock_total double"


def catalogue(spark, *given):
    return spark.createDataFrame([(p, g, "FAM", "NACIONAL", "CAT", c, "UN", r, 1.0) for p, g, c, r in given], CATALOGUE)


def test_hidden_products_and_search(spark, params, rows):
    df = table(spark, {}, {"producto": "d&p x"}, {"producto": "P2", "pedir": "No", "descripcion": "bujia"}, {"producto": "P3", "es_importado": True})
    assert rows(serving.filter_suggestions(df, Filters(), params), "producto") == [("P1",), ("P3",)]
    assert rows(serving.filter_suggestions(df, Filters(solo_nacionales=True), params), "producto") == [("P1",)]
    found = Filters(q="BUJIA", vista="cd", solo_nacionales=True)
    assert rows(serving.filter_suggestions(df, found, params), "producto") == [("P2",)]
    assert rows(serving.filter_suggestions(df, Filters(proveedores=("X",)), params)) == []


def test_views(spark, params, rows):
    df = table(
        spark, {"producto": "directa", "abastece_cd": None}, {"producto": "centro", "sucursal_id": "CD REPUESTOS"},
        {"producto": "mueve", "abastece_cd": "Sí", "total_sugerido_suc": None, "sugerido_traslado": 2.0}, {"producto": "quieta", "abastece_cd": "si", "total_sugerido_suc": 0.0},
    )
    seen = {v: [p for (p,) in rows(serving.filter_suggestions(df, Filters(vista=v), params), "producto")] for v in ("sucursales", "cd", "distribucion")}
    assert seen == {"sucursales": ["directa"], "cd": ["centro"], "distribucion": ["mueve"]}


def test_page_sorts_nulls_last(spark, params):
    df = table(spark, *[{"producto": f"P{i}", "costo_unitario": c} for i, c in enumerate([3.0, None, 1.0, 2.0])])
    order = lambda sort, **kw: [r.producto for r in serving.suggestion_page(df, Filters(), params, sort=sort, **kw).collect()]
    assert order("costo_unitario") == ["P2", "P3", "P0", "P1"]
    assert order("-costo_unitario", page=2, limit=2) == ["P2", "P1"]
    assert order("no_existe") == ["P0", "P1", "P2", "P3"]


@pytest.mark.parametrize("sort", ["costo_unitario", "-costo_unitario", "descripcion", "-total_sugerido_suc", None, "sucursal_id"])
def test_pages_by_their_last_row_are_those_by_number(spark, params, sort):
    costs = [3.0, None, 1.0, 2.0, 3.0, 3.0, None, None, 1.0]
    df = table(spark, *[{"producto": f"P{i % 5}", "sucursal_id": f"S{i}", "costo_unitario": c, "descripcion": None if i % 3 else f"d{i % 2}", "total_sugerido_suc": c} for i, c in enumerate(costs)])
    last, number = None, 0
    while True:
        number += 1
        page = serving.suggestion_page_after(df, Filters(solo_pedir=False), params, last, 2, sort).collect()
        other = serving.suggestion_page(df, Filters(solo_pedir=False), params, number, 2, sort)
        assert [(r.producto, r.sucursal_id) for r in page] == [(r.producto, r.sucursal_id) for r in other.collect()]
        if not page:
            break
        last = page[-1].asDict()
    assert number == 6


def test_a_deep_page_reads_no_sort_of_the_pages_before(spark, params):
    df = table(spark, {"producto": "P1"})
    last = {"costo_unitario": 5.0, "producto": "P", "sucursal_id": "S"}
    plan = serving.suggestion_page_after(df, Filters(), params, last, 50, "costo_unitario")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=50" in plan and "offset" not in plan.lower()


def test_catalogue_pages_by_their_last_row(spark):
    listed = catalogue(spark, *[(f"A{i}", f"g{i}", c, None) for i, c in enumerate([5.0, None, 7.0, 5.0, 1.0])])
    stock = spark.createDataFrame([("A0", "B", "TALCA", 4.0, "M")], S.STOCK_UNIFIED)
    f, last, seen = cat.CatalogueFilters(), None, []
    while page := cat.catalogue_list_after(listed, stock, f, last, 2, "-costo").collect():
        seen += [r.producto for r in page]
        last = page[-1].asDict()
    assert seen == ["A2", "A0", "A3", "A4", "A1"]


def test_manual_units_on_a_row(spark, rows):
    df = table(spark, {}, {"producto": "P2", "sugerido_compra_neto": 0.0, "costo_unitario": None}, {"producto": "P3"})
    units = manual.active_manual_units(entries(spark, ("P1", "TALCA", 15), ("P2", "TALCA", 4), ("P3", "TALCA", 9, True), ("P3", "TALCA", 9, False, datetime(2026, 7, 10, 12))), NOW)
    made = manual.add_manual(df, units)
    assert rows(made, "producto", "total_sugerido_suc", "sugerido_compra_neto", "total_valor_sugerido_clp") == [
        ("P1", 25.0, 21.0, 125000.0), ("P2", 14.0, 18.0, 50000.0), ("P3", 10.0, 6.0, 50000.0),
    ]


def test_stock_without_sale(spark, rows):
    sold = spark.createDataFrame([("vendio", "TALCA", "202606", 3.0), ("neto", "TALCA", "202606", 3.0), ("neto", "TALCA", "202606", -3.0), ("antes", "TALCA", "202605", 3.0)], S.MONTHLY_SALES)
    case = {"stock_activo_suc": 50.0, "demanda_mensual": 10.0}
    df = table(spark, *[{"producto": p, **case} for p in ("quieto", "vendio", "neto", "antes")], {"producto": "poco", "stock_activo_suc": 5.0, "demanda_mensual": 10.0}, {"producto": "cero", "stock_activo_suc": 5.0, "demanda_mensual": 0.0})
    made = dict(rows(serving.rule_stock_without_sale(df, sold, date(2026, 7, 10)), "producto", "pedir"))
    assert made == {"quieto": "No", "vendio": "Si", "neto": "No", "antes": "No", "poco": "Si", "cero": "Si"}


def test_search_list_adds_manual_and_catalogue_rows(spark, params, rows):
    df = table(spark, {"producto": "AB1"}, {"producto": "AB1", "sucursal_id": "CURICO", "nombre_sucursal": "Curico"})
    asked = entries(spark, ("AB1", "TALCA", 2), ("AB9", "TALCA", 3), ("ZZ", "TALCA", 7))
    listed = catalogue(spark, ("AB9", "nueve", 10.0, "r9"), ("AB5", "cinco", 1.0, None), ("AB1", "uno", 1.0, "r1"))
    stock = spark.createDataFrame([("AB5", "B", "TALCA", 4.0, "M"), ("AB5", "C", "TALCA", 2.0, "M")], S.STOCK_UNIFIED)
    sold = spark.createDataFrame([], S.MONTHLY_SALES)
    made = manual.list_suggestions(df, asked, listed, stock, sold, Filters(q="ab"), params, NOW)
    assert rows(made, "origen", "producto", "sucursal_id", "total_sugerido_suc", "stock_activo_suc", "reemplazos") == [
        ("catalogo", "AB5", None, None, 6.0, None), ("manual", "AB9", "TALCA", 3.0, None, "r9"),
        ("sugerido", "AB1", "CURICO", 10.0, None, "r1"), ("sugerido", "AB1", "TALCA", 12.0, None, "r1"),
    ]
    plain = manual.list_suggestions(df, asked, listed, stock, sold, Filters(), params, NOW)
    assert plain.count() == 2


def test_totals_and_groups(spark, params, rows):
    df = table(spark, {}, {"producto": "P2", "proveedor": None, "total_valor_sugerido_clp": None}, {"sucursal_id": "CURICO", "nombre_sucursal": "Curico", "total_valor_sugerido_clp": 90000.0})
    assert rows(serving.kpis(df, Filters(), params)) == [(30.0, 140000.0, 2, 1)]
    assert [tuple(r) for r in serving.grouped(df, Filters(), "sucursal", params).collect()] == [("Curico", 10.0, 90000.0, 1), ("Talca", 20.0, 50000.0, 2)]
    assert serving.ranking(df, "sucursal", params, n=999).count() == 2
    with pytest.raises(KeyError):
        serving.grouped(df, Filters(), "color", params)


def test_units_from_days(spark, rows):
    df = table(spark, {"demanda_diaria": 0.01}, {"producto": "P2", "demanda_diaria": 1.5}, {"producto": "P3", "demanda_diaria": 0.0})
    assert rows(serving.units_from_days(df, 3), "producto", "unidades") == [("P1", 1), ("P2", 5)]


def test_ids_keep_their_order(spark):
    df = table(spark, *[{"id": i, "producto": f"P{i}"} for i in (1, 2, 3)])
    assert [r.id for r in serving.list_by_ids(df, [3, -1, 1, 9, 3]).collect()] == [3, 1, 3]


def test_two_sales_series(spark, rows):
    months = [f"2025{m:02d}" for m in range(1, 13)] + ["202601"]
    sold = spark.createDataFrame([("P", "TALCA" if m < "202503" else "CURICO", m, 2.0) for m in months], S.MONTHLY_SALES)
    series = serving.sales_12m(sold, "P", "TALCA")
    made = rows(series, "mes", "cantidad_general", "cantidad_sucursal")
    assert len(made) == 13 and made[0] == ("202501", 0.0, 2.0) and made[1] == ("202502", 2.0, 2.0)
    assert rows(serving.sales_12m_totals(series))[0][1:3] == (24.0, 4.0)


def test_coverage(spark, params, rows):
    df = table(spark, {"demanda_diaria": 2.0, "lt_efectivo": 5, "stock_seguridad": 10, "stock_activo_suc": 15.0, "sugerido_traslado": 2.0}, {"producto": "Q", "sugerido_compra_neto": None})
    made = serving.stock_coverage(df, params)
    assert rows(made, "stock_optimo", "cobertura_pct", "parte_traslado") == [(0.0, 0.0, None), (30.0, 50.0, 0.25)]


def test_cart_report_is_one_aggregate(spark, params, rows):
    df = table(spark, {}, {"producto": "P2", "costo_unitario": None}, {"producto": "P3", "proveedor": "ZETA", "sugerido_compra_neto": 1.0})
    lines = manual.cart_lines(df, entries(spark), catalogue(spark), Filters(abc=("A",)), params, NOW)
    made = manual.cart_report(lines)
    assert rows(made, "nivel", "proveedor", "producto", "cantidad", "subtotal_clp", "n_productos") == [
        (0, "ACME", "P1", 6.0, 30000.0, 1), (0, "ACME", "P2", 6.0, 0.0, 1), (0, "ZETA", "P3", 1.0, 5000.0, 1),
        (1, "ACME", None, 12.0, 30000.0, 2), (1, "ZETA", None, 1.0, 5000.0, 1), (2, None, None, 13.0, 35000.0, 3),
    ]
    assert rows(made.filter("nivel = 0"), "producto", "descripcion", "costo_unitario")[1] == ("P2", "filtro aceite", None)
    empty = manual.cart_report(lines.limit(0)).collect()
    assert [(r.nivel, r.cantidad, r.n_productos) for r in empty] in ([], [(2, 0.0, 0)])


def test_carts(spark, params, rows):
    df = table(
        spark, {}, {"sucursal_id": "CURICO", "sugerido_compra_neto": None}, {"producto": "P2", "sugerido_compra_neto": 0.0}, {"producto": "P3", "proveedor": None},
        {"producto": "P4", "proveedor": "ZETA", "costo_unitario": 100_000.0, "sugerido_compra_neto": 1.0},
    )
    asked = entries(spark, ("P1", "TALCA", 4), ("SOLO", "TALCA", 7), ("P9", "X", -1))
    lines = manual.cart_lines(df, asked, catalogue(spark, ("SOLO", "suelto", 0.0, None)), Filters(), params, NOW)
    assert rows(lines, "proveedor", "producto", "cantidad", "subtotal_clp") == [
        ("ACME", "P1", 20.0, 100000.0), ("Sin proveedor asignado", "SOLO", 7.0, 0.0), ("ZETA", "P4", 1.0, 100000.0),
    ]
    assert [r.proveedor for r in manual.cart_totals(lines).collect()] == ["ACME", "ZETA", "Sin proveedor asignado"]
    assert rows(manual.cart_grand_totals(lines)) == [(3, 200000.0, 28.0)]
    narrowed = manual.cart_lines(df, asked, catalogue(spark), Filters(abc=("A",)), params, NOW)
    assert narrowed.filter("producto = 'SOLO'").count() == 0
    orders = manual.purchase_orders(lines, "ACME")
    assert rows(orders, "renglon", "Producto", "Subtotal") == [(0, "P1", 100000.0), (1, "TOTAL", 100000.0)]


def test_purchase_order_folders(spark, params, tmp_path, rows):
    lines = manual.cart_lines(table(spark, {}, {"producto": "P4", "proveedor": "ZETA"}), entries(spark), catalogue(spark), Filters(), params, NOW)
    manual.write_purchase_orders(manual.purchase_orders(lines), str(tmp_path / "oc"))
    back = spark.read.option("header", True).csv(str(tmp_path / "oc"))
    assert rows(back.groupBy("proveedor").count()) == [("ACME", 2), ("ZETA", 2)]


def test_export_columns(spark):
    df = table(spark, {})
    assert serving.export_columns(df, ["producto", "nada"]).columns == ["Producto"]
    assert len(serving.export_columns(df).columns) == 7


def test_contract_to_serving_names(spark, params):
    fields = ["Producto", "SucursalID", "LT Efectivo", "Stock de Seguridad", "Stock DIEZ DE JULIO (2)", "total_sugerido_suc", "Es Importado"]
    df = spark.createDataFrame([("P", "T", 2.5, 3, 4, 5.0, True)], "a string, b string, c double, d long, e long, f double, g boolean").toDF(*fields)
    made = serving.from_contract(df)
    assert made.columns == ["producto", "sucursal_id", "lt_efectivo", "stock_seguridad", "stock_diez_de_julio_2", "total_sugerido_suc", "es_importado", "id"]
    assert made.first().lt_efectivo == 2


def test_catalogue_queries(spark, rows):
    listed = catalogue(spark, ("B", "bujia", 2.0, None), ("A", "aceite", 1.0, None), ("C", "cable", None, None))
    stock = spark.createDataFrame([("A", "B1", "TALCA", 4.0, "M"), ("A", "B2", "TALCA", 9.0, "M"), ("A", "B3", "TALCA", None, "M")], S.STOCK_UNIFIED)
    assert [r.producto for r in cat.catalogue_list(listed, stock, cat.CatalogueFilters(q="B"), sort="-costo").collect()] == ["B", "C"]
    one = cat.catalogue_detail(listed, stock, "A").first()
    assert one.stock_total == 13.0 and [p.bodega for p in one.stock_por_sucursal] == ["B2", "B1", "B3"]
    assert cat.catalogue_detail(listed, stock, "B").first().stock_por_sucursal == []
    assert rows(cat.stock_total(stock)) == [("A", 13.0)]
    assert rows(cat.filter_options(listed), "campo", "valor") == [("categoria", "CAT"), ("familia", "FAM"), ("procedencia", "NACIONAL")]


def test_product_search_fills_up(spark, rows):
    dim = spark.createDataFrame([("X1", "uno")], "producto string, descripcion string").withColumns({c: F.lit(None).cast("string") for c in ("filtro1_final", "unidad_medida", "costo_unitario", "proveedor", "es_importado")})
    listed = catalogue(spark, ("X1", "uno", 1.0, None), ("X2", "dos", 1.0, None), ("X3", "tres", 1.0, None))
    assert [r.producto for r in cat.search_products(dim, listed, "x", limit=2).collect()] == ["X1", "X2"]
    assert cat.search_total(dim, listed, "x", limit=2).first().total == 3
    assert cat.search_total(dim, listed, "x", limit=1).first().total == 1
    assert cat.search_products(dim, listed, None).count() == 1


def test_product_search_against_brute_force(spark):
    fields = "producto string, descripcion string, filtro1_final string, unidad_medida string, costo_unitario string, proveedor string, es_importado string"
    own = [f"X{i}" for i in range(7)]
    dim = spark.createDataFrame([(p, "d", None, None, None, None, None) for p in own], fields)
    names = [f"X{i}" for i in range(4, 15)]
    listed = catalogue(spark, *[(p, "g", 1.0, None) for p in names])
    for limit in (2, 3, 5, 7, 20):
        for page in (1, 2, 3, 4):
            shown = sorted(own)[(page - 1) * limit : page * limit]
            others = sorted(set(names) - set(shown))
            made = cat.search_products(dim, listed, "x", page, limit).collect()
            assert [r.producto for r in made] == (shown + others)[:limit]
            total = cat.search_total(dim, listed, "x", page, limit).first().total
            assert total == len(own) + (len(others) if len(shown) < limit else 0)


HEADERS = ["Periodo", "SUCURSAL", "Fecha", "Cantidad", "Neto", "Total"]


def sheet_rows(spark, *given):
    import json

    return spark.createDataFrame([(i, p, b, json.dumps([p, b, f, c, n, t])) for i, (p, b, f, c, n, t) in enumerate(given)], "id long, periodo string, sucursal string, datos string")


def test_post_sale(spark, params, rows):
    df = sheet_rows(
        spark, ("202601", "TALCA", "01/31/2026 00:00:00", "2", "1.000,5", "9"), ("202603", "TALCA", "2026-03-02", "1", "10", "9"),
        ("202603", None, "31/03/2026", "x", "20", "9"), (None, "TALCA", "nada", "1", "1", "9"),
    )
    summary = postsale.postventa_summary(df, HEADERS)
    assert rows(summary, "periodo", "sucursal", "total_clp", "total_unidades", "n_lineas") == [
        ("202601", "TALCA", 1000.5, 2.0, 1), ("202603", "TALCA", 10.0, 1.0, 1), ("202603", None, 20.0, 0.0, 1),
    ]
    latest = postsale.sales_kpis(summary).first()
    assert (latest.periodo, latest.periodo_anterior, latest.unidades_anterior) == ("202603", "202601", 2.0)
    assert latest.var_unidades_pct == -50.0
    assert [r.sucursal for r in postsale.by_branch(summary, params).collect()] == ["(sin sucursal)", "TALCA"]
    ranged = postsale.LineFilters(fecha_desde=date(2026, 3, 3))
    assert rows(postsale.filter_lines(df, HEADERS, ranged), "id") == [(2,)]
    assert postsale.sales_count(df, HEADERS, postsale.LineFilters()).first().filas == 4
    assert [r.id for r in postsale.sales_lines(df, HEADERS, postsale.LineFilters(), limit=2).collect()] == [2, 1]


def test_post_sale_export(spark, tmp_path):
    df = sheet_rows(spark, ("202601", "a,b", "x", "1,5", 'say "hi"', "9"))
    postsale.write_sales_export(df, HEADERS, postsale.LineFilters(), str(tmp_path / "o"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("*.csv"))
    assert text.startswith("﻿Periodo") and '"a,b"' in text and '"say ""hi"""' in text
    with pytest.raises(ValueError):
        postsale.write_sales_export(df, HEADERS, postsale.LineFilters(sucursal="Z"), str(tmp_path / "p"))


def test_pasted_codes(spark, params, rows):
    assert match.split_pasted("a, b;;a\n c\td,") == ["a", "b", "c", "d"]
    values = ["19 HL3Z8005B", "19 HL3Z8005C", "19 hl3z", "X 19 HL", None, ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    made = match.match_codes(df, "v", ["19 HL3Z8005", "19 HL3Z", "9 HL", "nada", "(EN BLANCO)"], params)
    assert rows(made, "codigo", "valor", "tipo") == [
        ("(EN BLANCO)", "(en blanco)", "exacto"), ("19 HL3Z", "19 hl3z", "exacto"),
        ("19 HL3Z8005", "19 HL3Z8005B", "prefijo"), ("19 HL3Z8005", "19 HL3Z8005C", "prefijo"),
        ("9 HL", "19 HL3Z8005B", "contiene"), ("9 HL", "19 HL3Z8005C", "contiene"), ("9 HL", "19 hl3z", "contiene"), ("9 HL", "X 19 HL", "contiene"),
        ("nada", None, None),
    ]
    assert rows(match.match_counts(made)) == [(5, 2, 2, 1)]


def test_match_against_brute_force(spark, params, rows):
    values = [f"{a}{b}" for a in ("10", "1", "A1", "1a") for b in ("", "0", "1", "A")]
    codes = ["1", "10", "a1", "0", "1A", "A10", "zz"]
    expected = []
    for code in codes:
        low = code.lower()
        best = [v for v in set(values) if v.lower() == low] or [v for v in set(values) if v.lower().startswith(low)] or [v for v in set(values) if low in v.lower()]
        expected += [(code, v) for v in best] or [(code, None)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert rows(match.match_codes(df, "v", codes, params), "codigo", "valor") == sorted(expected, key=str)


def test_a_value_stands_under_its_grams_once(spark, params):
    df = spark.createDataFrame([("ababab",), ("abc",), ("a",)], "v string")
    sizes = F.array(F.lit(2), F.lit(3))
    made = {r.v: r.g for r in df.select("v", match.grams_of(F.col("v"), sizes).alias("g")).collect()}
    assert made == {"ababab": ["ab", "ba", "aba", "bab"], "abc": ["ab", "bc", "abc"], "a": []}


def test_a_code_is_looked_up_by_its_rarest_gram(spark, params, rows):
    """All values share most grams of the code; only those with the rare one are met."""
    df = spark.range(500).selectExpr("concat('Brand#', id, if(id % 100 = 7, ' xyz', '')) as v")
    made = match.match_codes(df, "v", ["brand#7 xyz", "Brand#107 XYZ"], params)
    assert rows(made, "codigo", "valor", "tipo") == [("Brand#107 XYZ", "Brand#107 xyz", "exacto"), ("brand#7 xyz", "Brand#7 xyz", "exacto")]
    assert rows(match.match_codes(df, "v", [], params)) == []


def test_column_filter_and_order(spark, params, rows):
    df = spark.createDataFrame([("P10",), ("P9",), ("p1",), (None,)], "v string")
    assert [r.valor for r in match.distinct_values(df, "v", params).collect()] == ["(en blanco)", "p1", "P9", "P10"]
    assert rows(match.column_filter(df, "v", params, contains="P1")) == [("P10",), ("p1",)]
    assert rows(match.column_filter(df, "v", params, values=["(en blanco)"])) == [(None,)]
    assert rows(match.column_filter(df, "v", params, values=[])) == []


def test_parity(spark, rows):
    golden = spark.createDataFrame([("P", "T", None, "x"), ("Q", "T", 5.0, None), ("R", "T", 1.0, "z")], "Producto string, SucursalID string, n double, t string")
    engine = spark.createDataFrame([("P", "T", 0.0, "x"), ("Q", "T", 5.6, None), ("S", "T", 1.0, "z")], "producto_master string, sucursal_final string, m double, u string")
    keys = {"producto_master": "Producto", "sucursal_final": "SucursalID"}
    assert rows(parity.parity_mismatch(engine, golden, keys, {"m": "n"}, 0.5), "Producto") == [("Q",), ("R",)]
    assert rows(parity.parity_mismatch(engine, golden, keys, {"u": "t"}), "Producto") == [("R",)]
    compared = parity.shadow_compare(engine, golden, keys, {"m": "n"}, 0.5)
    assert dict(rows(compared, "Producto", "estado")) == {"P": "igual", "Q": "distinta", "R": "solo_oficial", "S": "solo_motor"}
    assert rows(parity.shadow_summary(compared)) == [(2, 1, 1, 50.0)]
    assert [r.Producto for r in parity.worst_rows(compared, ["Producto"]).collect()] == ["Q"]


def test_fixture_subset(spark, rows):
    df = spark.createDataFrame([("C", "A"), ("A", "A"), ("B", "A"), ("Z", "D")], "p string, k string")
    mapping = spark.createDataFrame([("HIJO", "A"), ("OTRO", "C")], S.MAPPING)
    made = parity.fixture_subset(df, "p", {"a": (F.col("k") == "A", 2), "d": (F.col("k") == "D", 1)}, mapping)
    assert rows(made) == [("A",), ("B",), ("HIJO",), ("Z",)]
