from datetime import date, timedelta
from statistics import mean, median, stdev

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reabasto import schemas as S
from reabasto.functions.months import first_day, window_months
from reabasto.operators import abc_class, demand, enrich, leadtime, serving, suggest, transfer
from reabasto.params import Params
from reabasto.plans import pipeline, publish
from reabasto.sources import files
from reabasto.sources.files import Sources

MONTH = date(2026, 7, 1)
TODAY = date(2026, 7, 10)
MONTHS = window_months(MONTH, 12)
PAIR = ["producto_master", "sucursal_final"]


def sales(spark, entries):
    """entries: (product, branch, month key, quantity[, type[, source]])"""
    made = [
        (p, b, rest[0] if rest else "VTA MESON", first_day(m), q, rest[1] if len(rest) > 1 else "Curifor")
        for p, b, m, q, *rest in entries
    ]
    return spark.createDataFrame(made, S.SALES)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def classified(spark, params, entries, mapping=(), categories=()):
    return abc_class.abc(
        sales(spark, entries),
        spark.createDataFrame(list(mapping), S.MAPPING),
        spark.createDataFrame(list(categories), S.DIM_PRODUCT),
        MONTH,
        params,
    )


def test_classes(spark, params):
    cases = {(1, 5, 5): "A", (0, 4, 9): "B", (2, 3, 3): "C", (1, 3, 7): "C", (1, 3, 6): "D", (0, 0, 12): "D"}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "a int, b int, c int, e string")
    assert df.filter(abc_class.frequency_class(F.col("a"), F.col("b"), F.col("c"), params) != F.col("e")).count() == 0


def test_only_pairs_of_the_last_year(spark, params, rows):
    made = classified(spark, params, [("P", "TALCA", 202603, 1), ("Q", "TALCA", 202501, 1)])
    assert rows(made, *PAIR, "m3", "m6", "m12") == [("P", "TALCA", 0, 1, 1)]


def test_clean_up(spark, params, rows):
    entries = [
        ("P", "LINDEROS", 202605, 1, "VTA MOVIL"),
        ("P", "LINDEROS", 202605, 1),
        ("P", "RANCAGUA 2", 202605, 1),
        ("P", "CANAL DIGITAL", 202605, 1),
        ("P", "LIRA", 202605, 1),
        ("X", "TALCA", 202605, 1),
        ("13 BH1X70005AA", "TALCA", 202605, 1),
        ("HIJO", "TALCA", 202605, 1),
    ]
    made = abc_class.prepare_sales(
        sales(spark, entries),
        spark.createDataFrame([("HIJO", "PADRE")], S.MAPPING),
        spark.createDataFrame([("X", "COLISION")], S.DIM_PRODUCT),
        params,
    )
    assert rows(made, *PAIR, "mes") == [
        ("P", "CD REPUESTOS", "202605"), ("P", "CD REPUESTOS", "202605"), ("P", "LINDEROS", "202605"),
        ("P", "RANCAGUA", "202605"), ("PADRE", "TALCA", "202605"),
    ]


def test_branches_are_resolved_by_a_small_join(spark, rows):
    """Mobile before merged, merged before special, excluded last; a branch that no parameter names stays."""
    params = Params(
        cd_id="CD", excluded_branches=("FUERA", "M"), cd_special_branches=("ESPECIAL", "MOVIL F"), branch_merges={"A": "B", "C": "FUERA", "D": "ESPECIAL"},
        mobile_branch="MOVIL", mobile_branch_final="MOVIL F", mobile_sale_type="VTA MOVIL",
    )
    entries = [(b, b, 202605, 1, t) for b in ("A", "B", "C", "D", "FUERA", "M", "ESPECIAL", "MOVIL", "OTRA", None) for t in ("VTA MOVIL", "VTA MESON", None)]
    made = abc_class.prepare_sales(sales(spark, entries), empty(spark, S.MAPPING), empty(spark, S.DIM_PRODUCT), params)
    want = {"A": "B", "B": "B", "D": "CD", "ESPECIAL": "CD", "OTRA": "OTRA"}
    expected = [(b, "VTA MOVIL" if t == 0 else "VTA MESON" if t == 1 else None, f) for b, f in want.items() for t in range(3)]
    expected += [("MOVIL", "VTA MOVIL", "CD"), ("MOVIL", "VTA MESON", "MOVIL"), ("MOVIL", None, "MOVIL")]
    assert rows(made, "Producto", "TipoVenta", "sucursal_final") == sorted(expected, key=str)
    assert "BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()


def test_a_month_counts_by_its_positive_lines(spark, params, rows):
    entries = [("P", "TALCA", 202606, 1), ("P", "TALCA", 202606, -5), ("P", "TALCA", 202605, -2), ("P", "TALCA", 202607, 3)]
    assert rows(classified(spark, params, entries), "m3", "m12") == [(2, 2)]
    closed = Params(closed_months_only=True)
    assert rows(classified(spark, closed, entries), "m3", "m12") == [(1, 1)]


def tail_and_fast(branches=("TALCA", "CURICO", "CHILLAN")):
    """Three branches take turns, so each is slow and the product is fast."""
    return [("P", branches[i % 3], m, 3) for i, m in enumerate(MONTHS)]


def test_dense_series(spark, rows):
    totals = spark.createDataFrame([("P", 202605, 3), ("P", 202606, 4), ("P", 202606, 1), ("Q", 202001, 9)], "p string, mes int, total long")
    made = abc_class.dense_monthly_series(totals, ("p",), [202604, 202605, 202606])
    assert rows(made) == [("P", [0.0, 3.0, 5.0]), ("Q", [0.0, 0.0, 0.0])]


def test_a_hot_product_is_reduced_before_the_lookup(spark, params, rows):
    """A third of the lines in one product: the rows that reach the lookups are its months."""
    hot = [("HOT", "TALCA", m, 1) for m in MONTHS for _ in range(50)]
    rest = [(f"P{i % 40}", "CURICO", MONTHS[i % 12], 1) for i in range(1200)]
    cube = abc_class.monthly_cube(
        sales(spark, hot + rest), empty(spark, S.MAPPING), empty(spark, S.DIM_PRODUCT), params
    )
    assert cube.filter("producto_master = 'HOT'").count() == 12
    assert rows(cube.groupBy().agg(F.sum("total"))) == [(1800,)]


def test_centre_row_is_made_once(spark, params, rows):
    made = classified(spark, params, tail_and_fast() + [("Q", "TALCA", 202606, 1)])
    cd = made.filter(F.col("sucursal_final") == "CD REPUESTOS")
    assert rows(cd, "producto_master", "m12", "m12a", "clasificacion_abc", "clasificacion_abc_agregada") == [("P", 0, 12, "D", "A")]
    own = classified(spark, params, tail_and_fast() + [("P", "CD REPUESTOS", 202606, 5)])
    assert rows(own.filter("sucursal_final = 'CD REPUESTOS'"), "m12", "clasificacion_abc") == [(1, "D")]


def test_centre_row_takes_its_company_from_older_sales(spark, params, rows):
    made = classified(spark, params, tail_and_fast() + [("P", "CD REPUESTOS", 202001, 5, "VTA MESON", "Frontera")])
    flag = enrich.company(F.col("de_frontera"), F.col("de_principal"), params)
    assert rows(made.withColumn("e", flag), "sucursal_final", "m12", "e")[0] == ("CD REPUESTOS", 0, "Solo Frontera")


def expected_demand(series):
    med = median(series)
    mad = median(abs(x - med) for x in series)
    cap = med + 3 * 1.4826 * mad
    kept = series if mad == 0 else [min(x, cap) for x in series]
    return mean(kept), stdev(kept)


@given(st.lists(st.integers(-50, 400), min_size=12, max_size=12))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_capped_demand(spark, series):
    df = spark.createDataFrame([([float(x) for x in series],)], "serie array<double>")
    row = demand.winsorize(df, "serie", len(series), Params(), "m", "s").first()
    m, s = expected_demand([float(x) for x in series])
    assert row.m == pytest.approx(m, abs=1e-9) and row.s == pytest.approx(s, abs=1e-9)


def test_window_follows_the_local_class(spark, params):
    entries = [("F", "TALCA", m, 10) for m in MONTHS[:6]] + [("F", "TALCA", m, 4) for m in MONTHS[6:]]
    entries += [("S", "TALCA", MONTHS[0], 24)]
    made = {r.producto_master: r for r in demand.demand(classified(spark, params, entries), params).collect()}
    assert made["F"].demanda_mensual == 4.0 and made["F"].desv_std_mensual == 0.0
    assert made["S"].demanda_mensual == 2.0
    assert made["F"].demanda_diaria == pytest.approx(4 / 22)


def test_centre_demand_pools_the_tail(spark, params):
    entries = tail_and_fast() + [("P", "CD REPUESTOS", m, 1) for m in MONTHS[:2]] + [("P", "PLACILLA", m, 100) for m in MONTHS]
    made = {r.sucursal_final: r for r in demand.demand(classified(spark, params, entries), params).collect()}
    m, s = expected_demand([4.0, 4.0] + [3.0] * 10)
    assert made["CD REPUESTOS"].demanda_mensual == pytest.approx(m)
    assert made["CD REPUESTOS"].desv_std_mensual == pytest.approx(s)
    assert made["PLACILLA"].demanda_mensual == 100.0


def orders(supplier, branch, days, origin="Curifor Nacional", reason="reposicion"):
    start = date(2026, 1, 1)
    return [(supplier, branch, start, start + timedelta(days=d), origin, reason) for d in days]


@pytest.mark.parametrize(
    "kind, days, expected",
    [
        ({}, [1, 1, 2, 2, 3, 10], (1.5, 4)),
        ({"origin": "Frontera Nacional", "reason": "x"}, [1, 2, 3, 4, 20], (2.5, 4)),
        ({}, [5, 10, 40, 60], (5.0, 1)),
        ({"origin": "Curifor Importado", "reason": "x"}, [10, 20, 40, 60], (70 / 3, 3)),
        ({"reason": "compra calzada"}, [5, 6], None),
    ],
)
def test_lead_time_cut(spark, params, kind, days, expected):
    df = spark.createDataFrame(orders("PROV", "TALCA", days, **kind), S.TRACKING_LEAD_TIME)
    got = leadtime.lead_time_supplier_branch(df, params).first()
    assert (got and (pytest.approx(got["Lead Time Dias"]), got["N Muestras"])) == expected


def test_lead_time_tables(spark, params, rows):
    entries = orders("A", "TALCA", [1, 2, 3]) + orders(None, "TALCA", [4]) + orders("B", "DESCONOCIDO", [6])
    df = spark.createDataFrame(entries, S.TRACKING_LEAD_TIME)
    overall = leadtime.lead_time_supplier(df, params)
    assert overall.columns == ["Razon Social Proveedor", "Lead Time Dias"]
    assert rows(overall, "Razon Social Proveedor") == [("A",), ("B",), (None,)]
    assert rows(leadtime.lead_time_supplier_branch(df, params), "Razon Social Proveedor") == [("A",)]
    computed = leadtime.supplier_lookup_from_tracking(df, params)
    ready = leadtime.supplier_lookup(overall, leadtime.lead_time_supplier_branch(df, params))
    assert rows(computed) == rows(ready)


def test_supplier_choice(spark, params, rows):
    pairs = spark.createDataFrame([("P", "TALCA"), ("P", "CURICO"), ("Q", "TALCA"), ("R", "TALCA")], "producto_master string, sucursal_final string")
    day = date(2026, 5, 1)
    entries = [
        ("P", "TALCA", "beta", day, 1, "Curifor Nacional", "Reposicion"),
        ("P", "TALCA", "ALFA", day, None, "Curifor Nacional", "reposicion"),
        ("P", "TALCA", "AAA", date(2026, 6, 1), 9, "Curifor Nacional", "otro"),
        ("P", "CHILLAN", "Aaron", day, 3, "Curifor Importado", None),
        ("Q", "CURICO", "sin motivo", day, 1, "Curifor Nacional", None),
    ]
    made = leadtime.assign_supplier(pairs, spark.createDataFrame(entries, S.TRACKING), params)
    assert rows(made, *PAIR, "proveedor_lt", "proveedor") == [
        ("P", "CURICO", "Aaron", "Aaron"), ("P", "TALCA", "ALFA", "beta"), ("Q", "TALCA", "sin motivo", "sin motivo"), ("R", "TALCA", None, None),
    ]


def staged(spark, entries):
    """Pairs ready for safety stock: (master, branch, local, overall, route, imported, days, sigma, daily)"""
    return spark.createDataFrame(
        entries,
        "producto_master string, sucursal_final string, clasificacion_abc string, clasificacion_abc_agregada string, "
        "abastece_cd string, es_importado boolean, lt_efectivo double, desv_std_mensual double, demanda_diaria double",
    )


def test_safety_stock(spark, params, rows):
    df = staged(spark, [
        ("P", "TALCA", "A", "A", "No", False, 17.0, 10.0, 1.0),
        ("P", "CURICO", "A", "A", "Si", True, 19.0, 10.0, 1.0),
        ("P", "CD REPUESTOS", "D", "B", "No", False, 17.0, 10.0, 1.0),
        ("P", "CHILLAN", "D", "A", "No", False, 17.0, 10.0, 1.0),
        ("Q", "TALCA", "A", "A", "No", False, 17.0, None, None),
    ])
    assert rows(suggest.safety_stock(df, params), *PAIR, "stock_seguridad") == [
        ("P", "CD REPUESTOS", 13), ("P", "CHILLAN", 0), ("P", "CURICO", 13), ("P", "TALCA", 16), ("Q", "TALCA", None),
    ]


def test_in_transit(spark, params, rows):
    def line(days, origin, reason="Reposicion", state="PENDIENTE", doc=None, quantity=1):
        return ("P", "TALCA", "A", TODAY - timedelta(days=days), 1, origin, reason, quantity, state, "pendiente", doc)

    entries = [
        line(30, "Curifor Nacional", quantity=1), line(31, "Curifor Nacional", quantity=10), line(5, "Curifor Nacional", reason="x", quantity=100),
        line(180, "CURIFOR IMPORTADO", reason=None, quantity=1000), line(5, "Curifor Importado", state="Cerrado", quantity=10_000),
        line(400, "Frontera Nacional", state="x", doc=TODAY - timedelta(days=30), quantity=100_000), line(1, "Frontera Nacional", quantity=1_000_000),
    ]
    made = suggest.in_transit(spark.createDataFrame(entries, S.TRACKING_TRANSIT), TODAY, params)
    assert rows(made) == [("P", "TALCA", 101_001)]


def test_stock_of_the_group(spark, rows):
    mapping = spark.createDataFrame([("M", "M"), ("H1", "M"), ("H2", "M")], S.MAPPING)
    main = spark.createDataFrame([("M", "TALCA", 2), ("H1", "TALCA", 3), ("Z", "TALCA", 7), ("H1", "TALCA", 1)], S.STOCK)
    border = spark.createDataFrame([("H2", "TALCA", 4), ("H2", "CURICO", 5)], S.STOCK)
    held = {(m, b): s for m, b, s in rows(suggest.active_stock(main, border, mapping))}
    assert held[("M", "TALCA")] == 10 and held[("M", "CURICO")] == 5 and held[("Z", "TALCA")] == 7
    heads = spark.createDataFrame([("M",), ("Z",)], "producto_master string")
    assert rows(suggest.replacement_members(heads, mapping)) == [("M", "H1"), ("M", "H2"), ("M", "M"), ("Z", "Z")]


def allocated(spark, params, need, stock, entries=None):
    rows_ = entries or [("P", b, n) for b, n in need.items()]
    df = spark.createDataFrame(
        [(p, b, "D" if b != "PLACILLA" else "A", "A", float(n), 0.0) for p, b, n in rows_],
        "producto_master string, sucursal_final string, clasificacion_abc string, clasificacion_abc_agregada string, necesidad_bruta double, sugerido double",
    )
    held = F.lit(None).cast("map<string,struct<stock:bigint,nombre:string>>")
    if stock is not None:
        held = F.create_map(F.lit(params.cd_id), F.struct(F.lit(stock).cast("long").alias("stock"), F.lit("Centro").alias("nombre")))
    made = transfer.transfers(df.withColumn("existencias", held), params)
    return {r.sucursal_final: (r.sugerido_traslado, r.comprar_en_cd) for r in made.collect()}


def test_centre_stock_goes_by_priority(spark, params):
    need = {"TALCA": 5, "LINDEROS": 4, "CURICO": 6, "PLACILLA": 50, "CD REPUESTOS": 9}
    assert allocated(spark, params, need, 12) == {
        "LINDEROS": (4.0, "No"), "CURICO": (6.0, "No"), "TALCA": (2.0, "Si"), "PLACILLA": (None, None), "CD REPUESTOS": (None, None),
    }
    assert allocated(spark, params, need, None)["LINDEROS"] == (None, "Si")
    assert allocated(spark, params, {"LINDEROS": 0, "CURICO": 3}, 2) == {"LINDEROS": (None, "No"), "CURICO": (2.0, "Si")}


def test_equal_priority_goes_by_name(spark, params):
    assert allocated(spark, params, {"ZETA": 5, "BETA": 5}, 7) == {"BETA": (5.0, "No"), "ZETA": (2.0, "Si")}


def full_sources(spark, entries, stock=(), tracking=(), mapping=(), cost=(), border=()):
    branches = [("TALCA", "Talca", "Maule"), ("CURICO", "Curicó", "Maule"), ("CD REPUESTOS", "Centro", "RM"), ("LINDEROS", "Linderos", "RM")]
    return Sources(
        sales=sales(spark, entries),
        mapping=spark.createDataFrame(list(mapping), S.MAPPING),
        dim_product=empty(spark, S.DIM_PRODUCT),
        dim_branch=spark.createDataFrame(branches, "SucursalID string, Nombre string, Region string"),
        tracking=spark.createDataFrame(list(tracking), S.TRACKING),
        tracking_transit=empty(spark, S.TRACKING_TRANSIT),
        imported=empty(spark, S.IMPORTED),
        stock=spark.createDataFrame(list(stock), S.STOCK),
        stock_border=spark.createDataFrame(list(border), S.STOCK),
        lt_supplier=spark.createDataFrame([(6.0, "ACME"), (2.0, None)], S.LEAD_TIME_SUPPLIER),
        lt_supplier_branch=spark.createDataFrame([(4.0, 2, "ACME", "TALCA")], S.LEAD_TIME_SUPPLIER_BRANCH),
        cost=spark.createDataFrame(list(cost), S.COST) if cost else None,
    )


def test_whole_plan(spark, params, tmp_path):
    entries = [("P", "TALCA", m, 22) for m in MONTHS] + [("P", "CURICO", m, 44) for m in MONTHS] + [("H", "LINDEROS", 202606, 1)]
    day = date(2026, 5, 1)
    made = pipeline.run_pipeline(
        full_sources(
            spark, entries,
            stock=[("P", "TALCA", 4), ("H", "LINDEROS", 1500), ("H", "CURICO", 3), ("P", "CD REPUESTOS", 2)],
            border=[("P", "LINDEROS", 1)],
            tracking=[("P", "TALCA", "ACME", day, 1, "Curifor Nacional", "reposicion")],
            mapping=[("P", "P"), ("H", "P")],
            cost=[("P", "1.000,5"), ("P", " -"), ("H", "9999999")],
        ),
        MONTH, TODAY, params,
    )
    table = pipeline.contract(made, params)
    assert len(table.columns) == 53
    by = {r["SucursalID"]: r for r in table.collect()}
    talca = by["TALCA"]
    # daily 1, five days of cycle and four of supply, no spread, four units at hand
    assert (talca["total_sugerido_suc"], talca["Punto de Pedido"], talca["LT Origen"]) == (5.0, 4.0, "Por sucursal")
    assert (talca["Costo Unitario"], talca["total_valor_sugerido_clp"]) == (1000.5, 5002.5)
    assert talca["trasladar_desde"] == "5 unidades desde Linderos; 3 unidades desde Curicó"
    assert by["CURICO"]["total_sugerido_suc"] == 19.0 and by["CURICO"]["LT Origen"] == "Global proveedor"
    assert by["LINDEROS"]["Abastece CD"] == "Si" and by["LINDEROS"]["LT Efectivo"] == 1.0
    assert by["LINDEROS"]["stock_activo_suc"] == 1501 and by["TALCA"]["Stock LINDEROS"] == 1501
    assert by["CD REPUESTOS"]["Sucursales Origen CD"] == "LINDEROS" and by["TALCA"]["Reemplazos"] == "H"
    assert talca["Tiene Stock CD"] is True and by["CD REPUESTOS"]["Empresa"] == "Solo Curifor"
    pipeline.export_csv(made, str(tmp_path / "out"), params)
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == table.columns
    assert {r[0] for r in back.select("`Es Importado`").distinct().collect()} == {"False"}
    text = pipeline.contract_text(made, params)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text.schema)
    again = files.read_csv(spark, str(tmp_path / "out"), schema)
    assert sorted(map(str, again.collect())) == sorted(map(str, text.collect()))
    # the exported contract is as good as the calculated one: same types, same rows, and it can be published
    reread = pipeline.read_contract(spark, str(tmp_path / "out"), params)
    assert [(f.name, f.dataType) for f in reread.schema] == [(f.name, f.dataType) for f in table.schema]
    assert sorted(map(str, reread.collect())) == sorted(map(str, table.collect()))
    assert publish.publish_snapshot(serving.from_contract(reread), str(tmp_path / "pub"), params) == table.count()
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "x.csv").write_text("Producto,SucursalID\nP,TALCA\n")
    with pytest.raises(Exception, match="Descripcion"):
        pipeline.read_contract(spark, str(tmp_path / "short"), params).collect()


def test_texts_with_line_breaks_come_back(spark, tmp_path):
    df = spark.createDataFrame([('a "b"\nc', 1), ("x,y", None)], "t string, n int")
    files.write_csv(df, str(tmp_path / "out"))
    again = files.read_csv(spark, str(tmp_path / "out"), "t string, n int", multiLine=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


def test_plan_shape(spark, params):
    """The sales table is read once, reduced before any lookup, and the pair frame keeps
    its layout through the made centre rows."""
    entries = tail_and_fast()
    made = classified(spark, params, entries, mapping=[("P", "P")])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("vendio") > 0 and plan.count("CantidadAjustada") < 40
    physical = demand.demand(made, params)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(producto_master") <= 2
