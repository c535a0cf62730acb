import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from reabasto import schemas as S
from reabasto.operators import serving, state
from reabasto.operators.serving import Filters
from reabasto.plans import driver_tables, publish
from reabasto.plans.pipeline import contract, run_pipeline
from tests.test_serving import NOW, entries, table

TODAY = date(2026, 7, 10)
FOLDER = os.environ.get("REABASTO_TEST_TABLES", "/root/testdata/sf0.001")
PARAMS = driver_tables.PARAMS


def inputs(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return driver_tables.sources(spark, FOLDER), driver_tables.CLOSED_MONTH, driver_tables.TODAY, PARAMS


def rules(spark, *given):
    base = {"id": "r", "modo": "individual", "producto": "P1", "sucursal_id": "TALCA", "unidades": 3, "cada_dias": 7, "proxima_ejecucion": TODAY, "activa": True}
    names = [c.split()[0] for c in S.RECURRING.split(", ")]
    made = [{**dict.fromkeys(names), **base, **g} for g in given]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in made], S.RECURRING)


def test_expiry_is_midnight_in_the_business_zone(spark, params):
    df = spark.createDataFrame([(date(2026, 7, 10),), (date(2026, 1, 10),), (date(2101, 1, 1),), (date(2026, 7, 9),)], "d date")
    made = df.select(state.expire_at(F.col("d"), params).cast("string").alias("x"), state.expiry_accepted(F.col("d"), TODAY, params).alias("ok")).collect()
    assert [r.x for r in made[:2]] == ["2026-07-11 04:00:00", "2026-01-11 03:00:00"]
    assert [r.ok for r in made] == [True, False, False, False]


def test_bulk_and_batches(spark, params, rows):
    df = table(spark, {"demanda_diaria": 2.0}, {"producto": "P2"}, {"producto": "P3", "pedir": "No"})
    made = state.bulk_manual(df, Filters(), params, "L", NOW, "ana", days=5)
    assert rows(made, "producto", "unidades", "lote_id") == [("P1", 10, "L")]
    assert rows(state.bulk_counts(df, Filters(), params, days=5)) == [(1, 1)]
    same = state.bulk_manual(df, Filters(), params, "L", NOW, "ana", units=4)
    assert rows(same, "producto", "unidades") == [("P1", 4), ("P2", 4)]
    ruled = same.withColumn("recurrente_id", F.when(F.col("producto") == "P2", "r"))
    assert rows(state.drop_batch(ruled, "L"), "producto") == [("P2",)]
    assert rows(state.manual_batches(same), "lote_id", "entradas") == [("L", 2)]
    assert state.single_entries(same).count() == 0
    with pytest.raises(ValueError):
        state.bulk_manual(df, Filters(), params, "L", NOW, "ana")


def test_change_log(spark, rows):
    old = spark.createDataFrame([(1, 5, "a"), (2, 1, "b"), (3, None, "c")], "id int, unidades int, motivo string")
    new = spark.createDataFrame([(1, 9, None), (3, None, "c"), (4, 1, "d")], "id int, unidades int, motivo string")
    assert rows(state.change_log(old, new, "id", ["unidades", "motivo"])) == [
        (1, "modificada", "unidades: 5 -> 9; motivo: a -> None"), (2, "eliminada", None), (4, "agregada", None),
    ]


def test_expired_entries(spark, rows):
    df = entries(spark, ("P1", "TALCA", 1, False, datetime(2026, 7, 10, 12)), ("P2", "TALCA", 1, False, datetime(2026, 7, 10, 13)), ("P3", "TALCA", 1, True, datetime(2026, 1, 1)), ("P4", "TALCA", 1))
    assert rows(state.archive_expired(df, NOW), "producto", "archivada") == [("P1", True), ("P2", False), ("P3", True), ("P4", False)]
    assert rows(state.count_expired(df, NOW)) == [(1,)]
    assert rows(state.list_manual(df, product="P4"), "producto") == [("P4",)]
    assert rows(state.active_entries(df, NOW), "producto") == [("P2",), ("P4",)]


def test_recurring_dates(spark, rows):
    df = rules(
        spark, {"id": "corre", "proxima_ejecucion": date(2026, 6, 1)}, {"id": "hoy"}, {"id": "futura", "proxima_ejecucion": date(2026, 7, 11)},
        {"id": "vencida", "fecha_fin": date(2026, 7, 9)}, {"id": "ultima", "fecha_fin": date(2026, 7, 12)}, {"id": "apagada", "activa": False},
    )
    made = {r.id: (r.proxima_ejecucion, r.activa, r.ultima_ejecucion) for r in state.advance_rules(df, TODAY).collect()}
    assert made["corre"] == (date(2026, 7, 13), True, TODAY)
    assert made["hoy"] == (date(2026, 7, 17), True, TODAY)
    assert made["futura"] == (date(2026, 7, 11), True, None)
    assert made["vencida"] == (TODAY, False, None)
    assert made["ultima"] == (date(2026, 7, 17), False, TODAY)
    assert made["apagada"] == (TODAY, False, None)


def test_recurring_entries(spark, params, rows):
    published = table(
        spark, {"demanda_diaria": 2.0}, {"producto": "P2", "clasificacion_abc": "B"}, {"producto": "P3", "sucursal_id": "CURICO", "nombre_sucursal": "Curico"},
        {"producto": "P4", "pedir": "No"},
    )
    df = rules(
        spark, {"id": "u"}, {"id": "d", "dias_inventario": 4, "unidades": 0}, {"id": "sin", "producto": "P2", "dias_inventario": 4},
        {"id": "g", "modo": "grupo", "filtros": json.dumps({"sucursales": ["Talca"], "abc": ["A"]})},
        {"id": "todo", "modo": "grupo", "filtros": None, "dias_inventario": 1}, {"id": "busca", "modo": "grupo", "filtros": json.dumps({"q": "p4"})},
    )
    before = entries(spark, ("P1", "TALCA", 1), ("P9", "X", 1)).withColumn("recurrente_id", F.when(F.col("producto") == "P1", "u"))
    _, made = state.process_recurring(df, before, published, TODAY, NOW, params)
    assert rows(made, "recurrente_id", "producto", "unidades", "archivada") == [
        ("busca", "P4", 3, False), ("d", "P1", 8, False), ("g", "P1", 3, False), ("todo", "P1", 2, False),
        ("u", "P1", 1, True), ("u", "P1", 3, False), (None, "P9", 1, False),
    ]
    assert rows(state.recurring_counts(df, published, TODAY, NOW, params)) == [(6, 5)]


@pytest.mark.parametrize(
    "given",
    [{}, {"abc": ["A"]}, {"sucursales": ["Talca"], "solo_pedir": False}, {"vista": "cd"}, {"vista": "distribucion", "solo_pedir": False}, {"q": "ford"}, {"proveedor": "acm", "solo_nacionales": True}],
)
def test_rule_filters_agree_with_the_grid(spark, params, rows, given):
    published = table(
        spark, {}, {"producto": "P2", "sucursal_id": "CD REPUESTOS", "nombre_sucursal": "CD"}, {"producto": "P3", "pedir": "No", "proveedor": None},
        {"producto": "P4", "abastece_cd": "Si", "filtro1_final": None, "clasificacion_abc": "C"}, {"producto": "P5", "es_importado": True}, {"producto": "MEC INSUMOS"},
    )
    df = rules(spark, {"id": "g", "modo": "grupo", "filtros": json.dumps(given)})
    made = rows(state.recurring_entries(df, published, TODAY, NOW, params), "producto")
    from reabasto.operators import serving

    assert made == rows(serving.filter_suggestions(published, Filters.from_json(json.dumps(given)), params), "producto")


def test_a_rule_that_names_nothing_is_dealt_by_its_measured_size(spark, params, rows):
    rows_ = spark.range(1000).selectExpr("concat('P', id) as producto", "'TALCA' as sucursal_id", "1 as _code", "if(id < 900, 'x', concat('y', id)) as _k")
    rules_ = spark.createDataFrame([(1, "x", "r1"), (1, "y950", "r2"), (1, "z", "r3")], "_code int, _k string, regla string")
    parts = {tuple(r) for r in state.key_parts(rows_, ["_code", "_k"], 100).collect()}
    assert parts == {(1, "x", 9)}  # only the large key
    met = state._met(rows_, rules_, ["_code", "_k"], 100)
    assert met.count() == 901 and met.select("producto").distinct().count() == 901
    assert met.filter("_k = 'x'").select("_salt").distinct().count() == 9
    largest = met.groupBy("_k", "_salt").count().agg(F.max("count")).first()[0]
    assert largest < 200


def test_audit_pages_by_their_last_event(spark):
    log = spark.createDataFrame([(i, "a" if i % 3 else "login", datetime(2026, 7, 1 + i % 4), None) for i in range(20)], "id long, accion string, creado_en timestamp, detalle string")
    last, number = None, 0
    while True:
        number += 1
        page = state.audit_after(log, last, without=("login",), limit=4).collect()
        assert [r.id for r in page] == [r.id for r in state.audit_page(log, without=("login",), page=number, limit=4).collect()]
        if not page:
            break
        last = (page[-1].creado_en, page[-1].id)
    assert number == 5


def test_notifications(spark, rows):
    events = spark.createDataFrame([(str(i), datetime(2026, 7, 1, i), v) for i, v in enumerate([None, "ana", " beto , ana ", "beto"])], "id string, creado_en timestamp, vistas_por string")
    assert rows(state.unread_count(events, "ana")) == [(2,)]
    assert rows(state.notifications(events, "ana", only_unread=True, limit=1), "id") == [("3",)]
    assert rows(state.notifications(events, "ana", limit=2), "id", "leida") == [("2", True), ("3", False)]
    assert rows(state.mark_read(events, "caro", ["2", "0"]), "vistas_por") == [("ana",), ("ana,beto,caro",), ("beto",), ("caro",)]


def test_audit(spark, rows):
    log = spark.createDataFrame([(i, a, datetime(2026, 7, i + 1), None) for i, a in enumerate(["login", "creada", "login", "sync"])], "id long, accion string, creado_en timestamp, detalle string")
    assert [r.id for r in state.audit_page(log, without=("login",)).collect()] == [3, 1]
    assert rows(state.audit_page(log, action="login", page=2, limit=1), "id") == [(0,)]
    assert state.last_event(log, "login").first().creado_en == datetime(2026, 7, 3)


def test_snapshot_guard_keeps_the_published_rows(spark, params, tmp_path, rows):
    base = str(tmp_path / "pub")
    big = table(spark, *[{"producto": f"P{i}", "id": i} for i in range(10)], {"producto": None}).withColumns({"fila": F.col("id"), "prioridad_cd": F.lit(1)})
    assert publish.publish_snapshot(big, base, params) == 10
    with pytest.raises(publish.ShrinkError):
        publish.publish_snapshot(big.filter("id < 6"), base, params)
    assert publish.read_current(spark, base, "sugerido").count() == 10
    assert publish.publish_snapshot(big.filter("id < 7"), base, params) == 7
    assert publish.current_version(spark, base) == (2, 7)
    assert publish.read_current(spark, base, "dim_producto").count() == 7
    assert rows(publish.read_current(spark, base, "dim_sucursal"), "sucursal_id", "nombre") == [("TALCA", "Talca")]
    with pytest.raises(ValueError):
        publish.publish_snapshot(big.drop("producto"), base, params)


def test_tables_have_versions_of_their_own(spark, params, tmp_path):
    base = str(tmp_path / "pub")
    big = table(spark, *[{"producto": f"P{i}", "id": i} for i in range(10)]).withColumn("prioridad_cd", F.lit(1))
    sold = spark.createDataFrame([("P", "T", "202601", 1.0)] * 40, S.MONTHLY_SALES)
    assert publish.publish_snapshot(big, base, params) == 10
    assert publish.replace_table(sold, base, "venta_mensual", ("producto",)) == 40
    assert publish.read_current(spark, base, "sugerido").count() == 10
    assert publish.publish_snapshot(big.filter("id < 8"), base, params) == 8
    assert publish.current_version(spark, base) == (2, 8)
    assert publish.current_version(spark, base, "venta_mensual") == (1, 40)
    assert publish.read_current(spark, base, "venta_mensual").count() == 40
    with pytest.raises(FileNotFoundError):
        publish.read_current(spark, base, "stock")


def test_a_taken_version_is_refused(spark, params, tmp_path, monkeypatch):
    base = str(tmp_path / "pub")
    big = table(spark, *[{"producto": f"P{i}", "id": i} for i in range(10)]).withColumn("prioridad_cd", F.lit(1))
    publish.publish_snapshot(big, base, params)
    seen = publish.current_version(spark, base)
    publish.publish_snapshot(big.filter("id < 9"), base, params)
    monkeypatch.setattr(publish, "current_version", lambda *_: seen)  # a publisher that looked before the other was done
    with pytest.raises(publish.VersionTakenError):
        publish.publish_snapshot(big, base, params)
    monkeypatch.undo()
    assert publish.read_current(spark, base, "sugerido").count() == 9


def test_a_failed_attempt_leaves_the_published_rows(spark, params, tmp_path):
    base = str(tmp_path / "pub")
    big = table(spark, *[{"producto": f"P{i}", "id": i} for i in range(10)]).withColumn("prioridad_cd", F.lit(1))
    publish.publish_snapshot(big, base, params)
    broken = big.withColumn("descripcion", F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception, match="lost"):
        publish.publish_snapshot(broken, base, params)
    assert publish.read_current(spark, base, "sugerido").count() == 10


@pytest.mark.parametrize("broken", ["dim_producto", "dim_sucursal", "_manifest"])
def test_a_fault_between_tables_leaves_the_old_three(spark, params, tmp_path, monkeypatch, broken):
    base = str(tmp_path)
    big = spark.range(10).selectExpr("concat('P', id) as producto", "'TALCA' as sucursal_id", "'Talca' as nombre_sucursal", "id")
    columns = ("descripcion", "filtro1_final", "unidad_medida", "costo_unitario", "proveedor", "es_importado", "abastece_cd", "prioridad_cd")
    big = big.selectExpr("*", *[f"cast(null as string) as {c}" for c in columns])
    publish.publish_snapshot(big, base, params)
    write, move = publish._write, publish.move_to_new

    def failing(rows, base, table, attempt):
        if table == broken:
            raise OSError("the store is gone")
        return write(rows, base, table, attempt)

    def not_moved(*_):
        raise OSError("the store is gone")

    with monkeypatch.context() as m:
        m.setattr(publish, "_write", failing)
        m.setattr(publish, "move_to_new", not_moved if broken == "_manifest" else move)
        with pytest.raises(OSError, match="gone"):
            publish.publish_snapshot(big.filter("id < 8").withColumn("sucursal_id", F.lit("CURICO")), base, params)
    old = publish.read_published(spark, base, "sugerido", "dim_producto", "dim_sucursal")
    assert [old[t].count() for t in old] == [10, 10, 1] and old["dim_sucursal"].first()["sucursal_id"] == "TALCA"
    assert publish.publish_snapshot(big.filter("id < 9"), base, params) == 9  # and the next one passes
    new = publish.read_published(spark, base, "sugerido", "dim_producto", "dim_sucursal")
    assert [new[t].count() for t in new] == [9, 9, 1] and publish.current_version(spark, base) == (2, 9)


def test_several_tables_are_replaced_together_or_not_at_all(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    tables = lambda n: {"venta": (spark.range(n).selectExpr("cast(id as string) as k"), ("k",)), "stock": (spark.range(2 * n).selectExpr("cast(id as string) as k"), ("k",))}
    assert publish.replace_tables(tables(3), base) == {"venta": 3, "stock": 6}
    assert publish.publications(spark, base).select("publicacion", "tabla", "version").orderBy("tabla").collect() == [(1, "stock", 1), (1, "venta", 1)]
    broken = tables(5) | {"stock": (spark.range(3).selectExpr("raise_error('no') as k"), ("k",))}
    with pytest.raises(Exception, match="no"):
        publish.replace_tables(broken, base)
    read = publish.read_published(spark, base, "venta", "stock")
    assert (read["venta"].count(), read["stock"].count()) == (3, 6)


def test_publishers_of_other_tables_do_not_lose(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    rows = spark.range(4).selectExpr("cast(id as string) as k")
    publish.replace_table(rows, base, "uno", ("k",))
    move, raced = publish.move_to_new, []

    def late(spark, source, target):  # between our look and our rename, another publication takes the number
        if not raced:
            raced.append(target)
            monkeypatch.setattr(publish, "move_to_new", move)
            publish.replace_table(rows.limit(1), base, "dos", ("k",))
        return move(spark, source, target)

    monkeypatch.setattr(publish, "move_to_new", late)
    assert publish.replace_table(rows.limit(2), base, "uno", ("k",)) == 2
    assert publish.current_version(spark, base, "uno") == (2, 2) and publish.current_version(spark, base, "dos") == (1, 1)
    assert sorted(r.publicacion for r in publish.publications(spark, base).collect()) == [1, 2, 3]


def test_engine_output_is_published_and_listed(spark, params, tmp_path, rows):
    base = str(tmp_path / "pub")
    made = serving.from_contract(contract(run_pipeline(*inputs(spark)), PARAMS))
    count = publish.publish_snapshot(made, base, PARAMS)
    read = publish.read_current(spark, base, "sugerido")
    assert count == made.count() == read.select("id").distinct().count() > 0
    some = [r.id for r in read.limit(3).collect()]
    assert [r.id for r in serving.list_by_ids(read, some).collect()] == some
    assert publish.read_current(spark, base, "dim_producto").count() == read.select("producto").distinct().count()


def test_other_tables_are_replaced(spark, tmp_path):
    base = str(tmp_path / "ventas")
    df = spark.createDataFrame([("P", "T", "202601", 1.0), ("P", "T", None, 1.0)], S.MONTHLY_SALES)
    assert publish.replace_table(publish.monthly_sales_rows(df), base, "venta_mensual", ("producto",)) == 1
    assert publish.replace_table(publish.monthly_sales_rows(df).limit(0), base, "venta_mensual", ("producto",)) == 0
    assert publish.read_current(spark, base, "venta_mensual").count() == 0


def test_load_warnings(spark, params, rows):
    df = table(spark, {"total_sugerido_suc": 10_001.0}, {"producto": "P2", "proveedor": None}, {"sucursal_id": ""}, {"producto": "P3", "total_sugerido_suc": None})
    assert rows(publish.load_warnings(df, params)) == [(1, 2, 1, 50.0)]
    assert rows(publish.anomalous_products(df, params)) == [("P1",)]
    assert rows(publish.received_check(df, df.limit(3), 4)) == [(4, 3, True, True)]
