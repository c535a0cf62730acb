from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reabasto.functions import columns as C
from reabasto.functions import months as M
from reabasto.functions import text as T


def evaluate(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_decimal_comma(spark):
    given_text = ["95233,75000000", "25933", "1.234,50", " -", None, "12.5"]
    assert evaluate(spark, given_text, T.locale_number) == [95233.75, 25933.0, 1234.5, None, None, 12.5]


def test_upload_number_drops_currency(spark):
    assert evaluate(spark, ["$ 1.234,5", "15%", "1.5", "x", ""], T.upload_number) == [1234.5, 15.0, 1.5, None, None]


def test_whole_numbers(spark):
    assert evaluate(spark, ["3.9", "-3.9", "7", "a", None], T.to_int) == [3, -3, 7, None, None]
    assert evaluate(spark, ["0.5", "1.5", "2.5", "2,6"], T.to_int_round) == [0, 2, 2, 3]


def test_days_in_every_spelling(spark):
    given_text = ["14/01/2025", "2024-01-09 00:00:00", "2024-01-09", "45684", "45684.7", "19999", "80001", "hoy", None]
    expected = [date(2025, 1, 14), date(2024, 1, 9), date(2024, 1, 9), date(2025, 1, 27), date(2025, 1, 27), None, None, None, None]
    assert evaluate(spark, given_text, T.to_date_multi) == expected


def test_labels(spark):
    assert evaluate(spark, [" N° Orden de Compra", "Razón Social", None], T.label_compact) == ["nordendecompra", "razonsocial", ""]
    assert evaluate(spark, ["¿Es Importado?", "LT CD-a/Sucursal  (días)", "Total $"], T.label_upload)[1:] == ["lt_cd_a_sucursal_dias", "total"]
    assert evaluate(spark, ["N° Doc.", "Total Neta"], T.label_sheet) == ["n_doc", "total_neta"]


def test_flags_and_vocabulary(spark):
    assert evaluate(spark, [" Sí", "X", "0", "Falso", "quizás"], T.to_bool) == [True, True, False, False, None]
    assert evaluate(spark, ["4Repuesto", "1M.O."], T.part_product_type) == ["REPUESTOS", "1M.O."]
    assert evaluate(spark, ["08 TALCA", "DIEZ DE JULIO (2)", "123 X"], T.strip_branch_prefix) == ["TALCA", "DIEZ DE JULIO (2)", "123 X"]


def test_round_half_up_below_zero(spark):
    assert evaluate(spark, [0.5, 1.5, -0.5, -1.5, 2.4], C.round_half_up, "double") == [1, 2, 0, -1, 2]


def test_thousands_group_fully(spark):
    assert evaluate(spark, [999.0, 1000.0, 131712.0, 1000000.0], C.thousands, "double") == ["999", "1.000", "131.712", "1.000.000"]


def test_lookup_keeps_nulls_and_default(spark):
    table = {"a": "A"}
    assert evaluate(spark, ["a", "b", None], lambda c: C.map_value(c, table)) == ["A", None, None]
    assert evaluate(spark, ["a", "b", None], lambda c: C.map_value(c, table, F.lit("?"))) == ["A", "?", "?"]


def test_search_text_is_not_a_pattern_escape(spark):
    assert evaluate(spark, ["a\\b", "ab", None], lambda c: T.like_any("A\\B", c)) == [True, False, False]


def test_month_windows():
    assert M.window_months(date(2026, 7, 1), 3) == [202604, 202605, 202606]
    assert M.window_start(date(2026, 1, 1), 12) == 202501
    assert M.first_day(202501) == date(2025, 1, 1)
    assert M.previous_month_key(date(2026, 1, 26)) == 202512


@given(st.dates(date(1990, 2, 1), date(2100, 1, 1)), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_month_windows_are_consecutive(day, n):
    keys = M.window_months(day, n)
    steps = [k // 100 * 12 + k % 100 for k in keys]
    assert len(keys) == n and all(b - a == 1 for a, b in zip(steps, steps[1:]))
    assert keys[-1] == M.previous_month_key(day)


@pytest.mark.parametrize("empty", [{}])
def test_empty_lookup(spark, empty):
    assert evaluate(spark, ["a"], lambda c: C.map_value(c, empty, F.lit("z"))) == ["z"]
