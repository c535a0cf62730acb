from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from reabasto import fixed_values as V
from reabasto import schemas as S
from reabasto.functions import text
from reabasto.sources import catalogue, files, freshness, grid, postsale, sales, stock, tracking

DAY = date(2026, 1, 1)
RAW = "Producto string, SUCURSAL string, `Tipo-Venta` string, Fecha date, Cantidad long, tipoDocto string, tipoproducto string"
GRID = "archivo string, fila long, celdas array<string>"


def report(spark, name, header, body, before=0):
    blank = [None] * len(header)
    lines = [["titulo", *blank[1:]]] * before + [header, *body]
    return [(name, i, [None if c is None else str(c) for c in line]) for i, line in enumerate(lines)]


def test_signed_quantity(spark, params, rows):
    df = spark.createDataFrame(
        [("FACTURA", 5), ("NC CLIENTE S/T", 3), ("NC-ELECTR REPTO", -2), ("GUIA", -4)], "d string, q long"
    )
    made = df.select(sales.signed_quantity(F.col("d"), F.col("q"), params).alias("x"))
    assert [r.x for r in made.collect()] == [5, -3, -2, 4]


def test_main_sales_with_history(spark, params, rows):
    raw = spark.createDataFrame(
        [("A1", "LINDEROS", "VTA MESON", DAY, 5, "FACTURA", "REPUESTOS"), ("A2", "TALCA", "VTA MESON", DAY, 9, "FACTURA", "MO_ST")], RAW
    )
    history = spark.createDataFrame(
        [("H1", "CURICO", "VTA MESON", date(2019, 3, 1), 4, "NC-ELECTR REPTO", "REPUESTOS"), ("H2", "PLACILLA", "VTA MESON", date(2020, 4, 1), 3, "FACTURA", "REPUESTO")], RAW
    )
    made = sales.normalize_sales_main(raw, params, history)
    assert made.columns == ["Producto", "SUCURSAL", "TipoVenta", "Fecha", "CantidadAjustada", "Fuente"]
    assert rows(made, "Producto", "CantidadAjustada") == [("A1", 5), ("H1", -4), ("H2", 3)]
    assert rows(sales.normalize_sales_main(raw, params), "Producto") == [("A1",)]


def test_border_sales(spark, params, rows):
    schema = "producto string, SUCURSAL string, `Tipo-Venta` string, fecha date, cantidad long, Documento string, `Docto-Emitido` string, tipoproducto string"
    raw = spark.createDataFrame(
        [
            ("P1", "02 LINDEROS", "CLIENTE", DAY, 5, "FACTURA ST", "Emitido", "REPUESTO"),
            ("P2", "08 TALCA", "GARANTIA", DAY, 4, "NOTA CREDITO ST", "Emitido", "REPUESTO"),
            ("P3", "03 PLACILLA", "CLIENTE", DAY, 2, "FACTURA REPUESTOS (E)", "Emitido", "REPUESTO"),
            ("P4", "05 RANCAGUA", "CLIENTE", DAY, 7, "FACTURA ST", "Emision Pendiente", "REPUESTO"),
            ("P5", "07 CURICO", "VTA MEC", DAY, 3, "CARGO INTERNO", "Emitido", "MO_ST"),
        ],
        schema,
    )
    made = sales.normalize_sales_border(raw, params)
    assert rows(made, "Producto", "SUCURSAL", "CantidadAjustada") == [("P1", "LINDEROS", 5), ("P2", "08 TALCA", 4)]
    both = sales.union_sales(made, None, made)
    assert both.count() == 4
    with pytest.raises(ValueError):
        sales.union_sales(None)


def test_sales_reports_use_one_vocabulary(spark, params, rows):
    header = ["Empresa", "Periodo", "tipoDocto", "Fecha", "Tipo-Venta", "Producto", "Cantidad", "tipoproducto", "SUCURSAL"]
    body = [
        ["E01", "202401", "FACTURA S/T", "2024-01-09 00:00:00", "VTA MESON", "80 JOCKEY ", 3, "4Repuesto", "08 TALCA"],
        ["E01", "202401", "NC CLIENTE S/T", "45301", "VTA MESON", "80 JOCKEY", 2, "4Repuesto", "02 LINDEROS"],
        ["E01", "202401", "FACTURA S/T", "2024-01-11", "VTA MEC", "MO_FORD", 1, "1M.O.", "09 CHILLAN"],
        ["E01", "202401", "FACTURA S/T", "12/01/2024", "VTA MESON", "19 ABC", 4, "4Repuesto", "DIEZ DE JULIO (2)"],
    ]
    grids = report(spark, "2024", header, body, before=9) + report(spark, "2023", header, body[:1])
    read = sales.read_sales(spark.createDataFrame(grids, GRID))
    made = sales.normalize_sales_main(read, params)
    assert rows(made, "Producto", "SUCURSAL", "Fecha", "CantidadAjustada") == [
        ("19 ABC", "DIEZ DE JULIO (2)", date(2024, 1, 12), 4),
        ("80 JOCKEY", "LINDEROS", date(2024, 1, 10), -2),
        ("80 JOCKEY", "TALCA", date(2024, 1, 9), 3),
        ("80 JOCKEY", "TALCA", date(2024, 1, 9), 3),
    ]


def test_header_rules(spark, rows):
    wanted = {"tipo": "tipoproducto", "NOC": "N° Orden de Compra", "falta": "Motivo Compra"}
    grids = report(spark, "literal", ["Tipo Producto", "tipoproducto", "N Orden de Compra"], [["CAMION", "REPUESTO", "7"], [None, None, None]])
    grids += report(spark, "primera", ["TIPO PRODUCTO", "Tipoproducto", "n° orden de compra"], [["a", "b", " 8 "]], before=39)
    grids += report(spark, "tarde", ["tipoproducto", "N Orden de Compra"], [["x", "y"]], before=60)
    df = spark.createDataFrame(grids, GRID)
    assert rows(grid.read_report(df, wanted, ["tipo", "NOC"])) == [("REPUESTO", "7", None), ("a", "8", None), ("x", "y", None)]
    lost = spark.createDataFrame(grids + report(spark, "sin", ["tipoproducto", "otra"], [["x", "y"]]), GRID)
    assert rows(grid.files_without_header(lost, wanted, ["tipo", "NOC"])) == [("sin",)]
    with pytest.raises(Exception, match="no header row in sin.*Orden de Compra"):
        grid.read_report(lost, wanted, ["tipo", "NOC"]).collect()


def test_accents_of_any_letter(spark, rows):
    df = spark.createDataFrame([("Č Ź-ś ō ñ Ú º ế e\u0301",)], "t string")
    assert rows(df.select(text.label_compact(F.col("t")))) == [("czsonuoee",)]


def test_grid_from_files(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("titulo,,\nProducto,Cantidad,x\nP1,3,\nP2,4,z\n")
    (tmp_path / "b.csv").write_text("Cantidad,Producto,\n5,P3,\n")
    made = grid.grid_from_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], 3)
    read = grid.read_report(made, {"Producto": "Producto", "Cantidad": "Cantidad"})
    assert rows(read) == [("P1", "3"), ("P2", "4"), ("P3", "5")]


def test_uploads(spark, rows):
    grids = report(spark, "a", ["Código", "Sucursal", "Total Sugerido", "Es Importado?", "Lead Time Dias", "Otra"], [["P1", "S1", "1.234,5", "sí", "2,5", "z"]])
    grids += report(spark, "b", ["total_sugerido", "Producto", "SucursalID", "Codigo"], [["10", "viejo", " S2 ", "P2"]])
    df = spark.createDataFrame(grids, GRID)
    made = grid.conform_uploads(df, V.SUGGESTION_ALIASES)
    picked = rows(made, "producto", "sucursal_id", "total_sugerido_suc", "es_importado", "lead_time_dias")
    assert picked == [("P1", "S1", 1234.5, True, 2), ("P2", "S2", 10.0, None, None)]
    assert rows(grid.ignored_headers(df, V.SUGGESTION_ALIASES)) == [("a", "Otra")]


def test_tracking_projections(spark, params, rows):
    raw = spark.createDataFrame(
        [("P1", "SUC070", "A", DAY, 100, "reposicion", 10), ("P2", "SUC999", "B", DAY, 200, "X", 20), ("P3", None, "C", DAY, 300, "X", 30)],
        "Producto string, Sucursal string, RazonSocial string, FechaOC date, NOC long, Motivo string, Cantidad long",
    )
    base = tracking.normalize_tracking_national(raw, params)
    assert base.columns == ["Producto", "SucursalID", "RazonSocial", "FechaOC", "NOC", "Origen", "Motivo"]
    assert rows(base, "SucursalID") == [("DESCONOCIDO",), ("DESCONOCIDO",), ("LINDEROS",)]
    transit = tracking.normalize_tracking_national(raw, params, "transit")
    assert transit.columns[-4:] == ["Cantidad", "EstadoOC", "EstadoDoc", "FechaDoc"]
    border = tracking.normalize_tracking_border(raw.drop("Motivo", "NOC"), params)
    assert rows(border.select("SucursalID", "Motivo").distinct()) == [("DESCONOCIDO", None)]
    united = tracking.union_tracking(base, tracking.normalize_tracking_imported(raw, params), border)
    assert united.groupBy("Origen").count().count() == 3
    assert params.tracking_map_national["SUC160"] == "TALCA (2)" and params.tracking_map_imported["SUC160"] == "TALCA 2"


def test_border_report_takes_order_day_from_the_base_document(spark, params, rows):
    header = ["Producto", "Nombre Local", "Razón Social Proveedor", "Cantidad", "Estado Documento Base", "Fecha Documento Base", "N° Documento Base", "Fecha Recepción"]
    body = [["70 58", "BRASIL 18", "GM", 15, "Cerrado", "02/01/2025", "0000005758", "21/01/2025"]]
    df = spark.createDataFrame(report(spark, "f", header, body, before=8), GRID)
    made = tracking.normalize_tracking_border(tracking.read_tracking_border(df), params, "transit")
    assert rows(made, "SucursalID", "FechaOC", "FechaDoc", "NOC", "Cantidad") == [("BRASIL 18", date(2025, 1, 2), date(2025, 1, 2), 5758, 15)]


def test_stock_warehouses(spark, params, rows):
    names = ["BODEGA ML", "BODEGA DYP TALCA 2", "la florida", "RANCAGUA 3", "??", None]
    raw = spark.createDataFrame([("P", n, "3.0", " -") for n in names] + [(None, "TALCA", "1", "1")], "Producto string, Bodega string, Stock string, Costo string")
    made = stock.read_stock(raw, params)
    assert [r.SucursalID for r in made.collect()] == ["CD REPUESTOS", "TALCA (2)", "LA FLORIDA", "RANCAGUA", "DESCONOCIDO", "DESCONOCIDO"]
    assert made.columns == ["Producto", "SucursalID", "Stock", "Costo", "Familia"]


def test_source_folder(spark, tmp_path):
    texts = {
        "ventas_12m.csv": "Producto,SUCURSAL,TipoVenta,Fecha,CantidadAjustada,Fuente\n0012,TALCA,VTA MESON,2026-03-10,4,Curifor\n",
        "mapeo_master.csv": "Producto,Producto_Master\nA,A\n",
        "dim_producto.csv": "Producto,Categoria\n0012,MANTENCION\n",
        "dim_sucursal.csv": "SucursalID,Nombre,Region,Tipo,EsOperativa,CodigoLocal\nTALCA,Talca,Maule,Comercial,true,SUC150\n",
        "seguimiento.csv": "Producto,SucursalID,RazonSocial,FechaOC,NOC,Origen,Motivo\n0012,TALCA,P,2026-01-02,5,X,reposicion\n",
        "seguimiento_transito.csv": "Producto,SucursalID,RazonSocial,FechaOC,NOC,Origen,Motivo,Cantidad,EstadoOC,EstadoDoc,FechaDoc\n",
        "lt_proveedor.csv": "Lead Time Dias,Razon Social Proveedor\n2.5,P\n",
        "lt_proveedor_sucursal.csv": "Lead Time Dias,N Muestras,Razon Social Proveedor,SucursalID\n2.5,3,P,TALCA\n",
        "importados.csv": "Producto\n0012\n",
        "stock_bodegas.csv": "Producto,SucursalID,Stock\n0012,TALCA,9\n",
        "stock_frontera.csv": "Producto,SucursalID,Stock\n",
        "stock_costo.csv": "Producto,Costo\n0012,\"12,5\"\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    loaded = files.load_sources(spark, str(tmp_path))
    line = loaded.sales.first()
    assert (line.Producto, line.Fecha, line.CantidadAjustada) == ("0012", date(2026, 3, 10), 4)
    assert loaded.catalogue is None and loaded.cost.first().Costo == "12,5"
    assert loaded.dim_branch.first().EsOperativa is True


def test_master_list_keeps_stray_quotes(spark, tmp_path):
    path = tmp_path / "maestro.csv"
    path.write_bytes('Producto;Categoria;Glosa\n 15 A ;CAMPAÑAS;TUBO 15"/16\n'.encode("latin-1"))
    row = files.read_master_list(spark, str(path)).first()
    assert (row.Producto, row.Categoria, row.Glosa) == ("15 A", "CAMPAÑAS", 'TUBO 15"/16')
    bad = tmp_path / "otro.csv"
    bad.write_text("A;B\n1;2\n")
    with pytest.raises(ValueError):
        files.read_master_list(spark, str(bad))


def test_upload_delimiter(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text('﻿Producto;Glosa\nP1;"a;b"\n', encoding="utf-8")
    assert tuple(files.read_upload(spark, str(path)).first()) == ("P1", "a;b")
    assert files.read_upload(spark, str(path)).columns == ["Producto", "Glosa"]


def test_catalogue_first_filled_and_summed(spark, rows):
    raw = spark.createDataFrame(
        [(2, "P", "", "1,5", "1.000,5"), (1, "P", " ", None, "2"), (3, "P", "glosa", "9", "x"), (4, " ", "g", "1", "1")],
        "fila long, Producto string, Glosa string, Costo string, Stock string",
    )
    made = catalogue.aggregate_catalogue(raw)
    assert rows(made, "producto", "glosa", "costo", "stock_total") == [("P", "glosa", 1.5, 1002.5)]
    assert rows(catalogue.catalogue_counts(raw)) == [(4, 1, 1)]


def test_freshness_blocks_official_loads(spark, rows):
    log = spark.createDataFrame([("stock_bodegas", date(2026, 1, 1)), ("stock_bodegas", date(2026, 1, 5)), ("catalogo", date(2026, 1, 1))], "fuente string, entregado date")
    checked = freshness.source_freshness(log, date(2026, 1, 8))
    assert rows(checked, "fuente", "edad_dias", "vencida") == [("catalogo", 7, False), ("stock_bodegas", 3, True)]
    assert freshness.check_freshness(checked, official=False) == ["stock_bodegas"]
    with pytest.raises(ValueError):
        freshness.check_freshness(checked, official=True)
    assert freshness.check_freshness(checked, official=True, ignore=True) == ["stock_bodegas"]


def test_sheet_rows_are_padded_and_cut(spark, rows):
    headers = ["Mes", "Local", "SUCURSAL", "Total"]
    raw = spark.createDataFrame([(1, [" 202401 ", "SUC130"]), (2, ["", "b", " RANCAGUA ", "5", "sobra"])], "id long, valores array<string>")
    made = postsale.load_postventa(raw, headers)
    assert rows(made, "id", "periodo", "sucursal", "datos") == [
        (1, "202401", None, '[" 202401 ","SUC130","",""]'),
        (2, None, "RANCAGUA", '["","b"," RANCAGUA ","5"]'),
    ]


def test_extract_rows(spark, tmp_path, rows):
    (tmp_path / "e.json").write_text('{"producto": "P", "mes": "202601", "cantidad": 2}\n{"producto": "Q"}\n')
    schema = "producto string, mes string, cantidad double"
    assert rows(files.read_extract(spark, str(tmp_path / "e.json"), schema)) == [("P", "202601", 2.0), ("Q", None, None)]
    (tmp_path / "e.csv").write_text("cantidad,producto,mes\nx,P,202601\n")
    assert rows(files.read_extract(spark, str(tmp_path / "e.csv"), schema, "csv")) == [("P", "202601", None)]


def test_border_extract_columns(spark, rows):
    documents = spark.createDataFrame(
        [("E07", t, i, i, "202601", DAY, "CLIENTE", None, "xx NQR", "SUC070", "N", v) for i, (t, v) in enumerate([("NOTA CREDITO ST", "V"), ("CARGO INTERNO", "V"), ("FACTURA ST", "A")])],
        "empresa string, tipodocto string, correlativo int, numero int, periodolibro string, fecha date, tipo_venta string, marca string, modelo string, local string, emitido string, vigencia string",
    )
    lines = spark.createDataFrame([("E07", t, i, "2723982", 1, 2.0, 9.0, 10.0, 4.0) for i, t in enumerate(["NOTA CREDITO ST", "CARGO INTERNO", "FACTURA ST"])], "empresa string, tipodocto string, correlativo int, producto string, linea int, cantidad double, neto double, total double, costo double")
    products = spark.createDataFrame([("E07", "2723982", "aceite de motor diesel 4T", "REPUESTO")], "empresa string, producto string, glosa string, tipoproducto string")
    made = sales.border_sales_extract(documents, lines, products, "E07", DAY, DAY)
    assert rows(made, "Documento", "SERIE UNIDAD", "TIPO PRODUCTO", "SUCURSAL", "Total Neta", "Docto-Emitido", "Descripcion Producto") == [
        ("CARGO INTERNO", "SERIE N", "LUBRICANTE", "02 LINDEROS", 10.0, "Emitido", "aceite de motor dies"),
        ("NOTA CREDITO ST", "SERIE N", "LUBRICANTE", "02 LINDEROS", -10.0, "Emision Pendiente", "aceite de motor dies"),
    ]


def test_a_stored_grid_is_searched_for_its_header_once(spark, rows, tmp_path):
    header, columns = ["Producto", "Cantidad", "nota"], {"Producto": "Producto", "Cantidad": "cantidad"}
    lines = report(spark, "uno", header, [["A", "1", "Producto"], ["Producto", "Cantidad", "x"], ["B", "2", None]], before=2)
    lines += report(spark, "dos", ["x", "CANTIDAD", "producto"], [["n", "7", "C"]], before=40)
    made = spark.createDataFrame(lines, GRID)
    path = str(tmp_path / "grid")
    grid.write_grid(made, path, columns)
    stored = grid.read_grid(spark, path)
    want = [("A", "1"), ("B", "2"), ("C", "7"), ("Producto", "Cantidad")]
    assert rows(grid.read_report(stored, columns)) == rows(grid.read_report(made, columns)) == want
    assert rows(grid.files_without_header(stored, columns)) == []
    searched = grid.find_headers(stored, columns)
    assert len(searched.inputFiles()) > 0
    plan = searched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cabecera" in plan


def test_a_stored_upload_knows_its_first_row(spark, rows, tmp_path):
    made = spark.createDataFrame([("a", 0, ["Código", "Stock"]), ("a", 1, ["P1", "3,5"]), ("b", 4, ["stock", "producto"]), ("b", 9, ["2", "P2"])], GRID)
    path = str(tmp_path / "grid")
    grid.write_grid(made, path)
    stored = grid.read_grid(spark, path)
    assert rows(stored.filter("cabecera"), "archivo", "fila") == [("a", 0), ("b", 4)]
    assert rows(grid.conform_uploads(stored, V.STOCK_ALIASES), "producto", "stock") == [("P1", 3.5), ("P2", 2.0)]


def test_years_that_are_not_looked_at_are_not_read(spark, params, rows, tmp_path):
    sold = [(f"P{y}", "TALCA", "VTA MESON", date(y, m, 1), 1, "Principal") for y in range(2018, 2028) for m in (1, 12)]
    made = spark.createDataFrame(sold, S.SALES)
    path = str(tmp_path / "ventas")
    sales.write_sales_by_year(made, path)
    kept = sales.read_sales_years(spark, path, date(2026, 7, 1), params)
    assert rows(kept, "Producto") == rows(sales.select_sales_years(made, date(2026, 7, 1), params).filter("year(Fecha) <= 2026"), "Producto")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [anio" in plan and "PushedFilters: [IsNotNull(Fecha), GreaterThanOrEqual(Fecha,2025-01-01)]" in plan
    kept.collect()
    assert {p.split("anio=")[1][:4] for p in spark.read.parquet(path).filter("anio in (2025, 2026)").inputFiles()} >= {"2025", "2026"}


def test_main_extract_reaches_the_files(spark, rows, tmp_path):
    path = str(tmp_path / "prod")
    rows_in = [("E01", datetime(2018, 12, 30), 1), ("E01", datetime(2018, 12, 31), 2), ("E07", datetime(2020, 1, 1), 3), (None, datetime(2020, 1, 1), 4), ("E01", None, 5)]
    spark.createDataFrame(rows_in, "Empresa string, Fecha timestamp_ntz, n int").write.parquet(path)
    made = sales.main_sales_extract(spark.read.parquet(path), "E01", date(2018, 12, 31))
    assert rows(made, "n") == [(2,)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(Empresa,E01)" in pushed and "GreaterThanOrEqual(Fecha,2018-12-31" in pushed
