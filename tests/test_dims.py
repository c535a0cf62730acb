from datetime import date

from pyspark.sql import functions as F

from reabasto.operators import dims

MIX = "Producto string, Reem1 string, Reem2 string, Reem3 string"
SOLD = "Producto string, Fecha date, Cantidad long"
MONTH = date(2026, 7, 1)


def mapped(spark, rows, params, mix, sold=()):
    made = dims.master_map(
        spark.createDataFrame(mix, MIX), spark.createDataFrame(list(sold), SOLD), MONTH, params
    )
    return dict(rows(made))


def test_branch_dimension(spark):
    df = dims.dim_branch(spark)
    assert df.count() == 53
    cd = df.filter("SucursalID = 'CD REPUESTOS'").first()
    assert (cd.Region, cd.Tipo, cd.CodigoLocal) == ("RM", "CD", "SUC280")


def test_head_that_is_also_a_replacement(spark, rows, params):
    made = mapped(spark, rows, params, [("A", "B", None, None), ("B", "C", None, None), ("SOLO", "R1", " ", None)])
    assert made == {"A": "A", "B": "A", "SOLO": "SOLO", "R1": "SOLO"}


def test_shared_replacement(spark, rows, params):
    assert mapped(spark, rows, params, [("A", "X", None, None), ("B", "X", None, None)]) == {}


def test_head_by_sales_in_the_window(spark, rows, params):
    sold = [("A", date(2026, 3, 1), 1), ("B", date(2026, 4, 1), 99), ("A", date(2025, 1, 1), 500)]
    assert mapped(spark, rows, params, [("A", "B", None, None)], sold) == {"A": "B", "B": "B"}


def brute_master(mix, sold):
    listed = {}
    for head, *reems in mix:
        if head and head.strip():
            listed.setdefault(head.strip(), set()).update(r.strip() for r in reems if r and r.strip())
    replaced = {r for reems in listed.values() for r in reems}
    clean = {h: reems for h, reems in listed.items() if reems and h not in replaced}
    count = {}
    for reems in clean.values():
        for r in reems:
            count[r] = count.get(r, 0) + 1
    made = {}
    for head, reems in clean.items():
        if all(count[r] == 1 for r in reems):
            members = {head, *reems}
            best = max(members, key=lambda p: (sum(n for q, d, n in sold if q == p and date(2026, 1, 1) <= d < MONTH), p == head, p))
            made |= dict.fromkeys(members, best)
    return made


def test_groups_against_brute_force(spark, rows, params):
    import random

    for seed in range(6):
        rng = random.Random(seed)
        codes = [f"C{i}" for i in range(25)]
        pick = lambda: rng.choice([*codes, None, " ", "Z " + rng.choice(codes)])
        mix = [(rng.choice([*codes, None, ""]) if rng.random() < 0.9 else rng.choice(codes) + " ", pick() if rng.random() < 0.6 else None, pick() if rng.random() < 0.3 else None, None) for _ in range(14)]
        mix += mix[:2]
        sold = [(rng.choice(codes), date(2026, rng.randrange(1, 8), 1), rng.randrange(-3, 5)) for _ in range(60)]
        assert mapped(spark, rows, params, mix, sold) == brute_master(mix, sold)


def test_a_replacement_that_very_many_list_is_flagged_not_gathered(spark, rows, params):
    mix = [(f"H{i}", "X", None, None) for i in range(2000)] + [("A", "B", None, None)]
    assert mapped(spark, rows, params, mix) == {"A": "A", "B": "A"}
    made = dims.master_map(spark.createDataFrame(mix, MIX), spark.createDataFrame([], SOLD), MONTH, params)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines()) <= 4


def test_rubro_brand_and_unit(spark, params):
    cases = [
        ("70 123", None, False, "CHEVROLET"),
        ("19 ABC", None, False, "FORD"),
        ("21 XYZ", None, False, "LUBRICANTES"),
        ("SINPREFIJO", None, False, None),
        ("SINPREFIJO", None, True, "CHEVROLET"),
        ("X", "RUBRO 72", False, "IVECO"),
        ("1234567-A", "RUBRO 72", False, "GILDEMEISTER LIVIANOS"),
        ("7 A", None, True, None),
    ]
    df = spark.createDataFrame([(i, p, f, b) for i, (p, f, b, _) in enumerate(cases)], "i int, p string, f string, b boolean")
    brand = dims.product_family(F.col("p"), dims.rubro(F.col("f"), F.col("p")), F.col("b"), params)
    assert [r.x for r in df.select("i", brand.alias("x")).orderBy("i").collect()] == [c[3] for c in cases]
    units = [("A", "ACEITE (ML)", "ML"), ("A", "x (500ML)", "ML"), ("A-TML", "x", "ML"), ("A", "(LT)", "LITRO"), ("A", "(kg)", "KG"), ("A", None, "UNIDAD")]
    df = spark.createDataFrame([(i, p, d) for i, (p, d, _) in enumerate(units)], "i int, p string, d string")
    made = df.select("i", dims.unit_of_measure(F.col("p"), F.col("d")).alias("u")).orderBy("i").collect()
    assert [r.u for r in made] == [u for *_, u in units]


def test_product_dimension(spark, rows, params):
    sales = spark.createDataFrame([("70 1", "zeta"), ("70 1", "alfa"), ("B", None), (None, "x")], "Producto string, `Descripcion Producto` string")
    listed = spark.createDataFrame([("B", "MANT", "glosa B")], "Producto string, Categoria string, Glosa string")
    held = spark.createDataFrame([("B", "RUBRO 15"), ("B", "RUBRO 10")], "Producto string, Familia string")
    made = dims.dim_product(sales, listed, held, params)
    assert rows(made) == [("70 1", None, "alfa", "CHEVROLET", "UNIDAD"), ("B", "MANT", "glosa B", "FORD", "UNIDAD")]


def test_first_upload_row_makes_the_dimension(spark, rows):
    df = spark.createDataFrame(
        [(2, "P", "S", "segunda", "b"), (1, "P", "S", None, "a"), (3, "Q", "S", "q", None)],
        "fila long, producto string, sucursal_id string, descripcion string, nombre_sucursal string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("filtro1_final", "unidad_medida", "costo_unitario", "proveedor", "es_importado", "abastece_cd", "prioridad_cd")})
    assert rows(dims.dim_product_from_upload(df), "producto", "descripcion") == [("P", None), ("Q", "q")]
    assert rows(dims.dim_branch_from_upload(df), "sucursal_id", "nombre") == [("S", "a")]


def test_imported_products(spark, rows):
    df = spark.createDataFrame([("B",), ("A",), ("B",), (None,)], "Producto string")
    assert [r.Producto for r in dims.imported_products(df).collect()] == ["A", "B"]
