from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from reabasto.llm import line_runs

DOCS = "doc_id long, text string, key string, n_lines string, _id string, docs string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"k{n}", "x", "y", "z") for n, (i, t) in enumerate(rows)], DOCS)


def key_of(line):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, shortest=20, holders=3):
    low = lambda i: -1 if i is None else i
    split = [(i, (t or "").split("\n")) for i, t in rows]
    held = {}
    for i, lines in split:
        for k in {key_of(line) for line in lines}:
            held.setdefault(k, []).append(low(i))
    gone = lambda i, k: len(k) >= shortest and len(held[k]) >= holders and low(i) != max(held[k])
    return [(i, "\n".join(x for x in lines if not gone(i, key_of(x))), len(lines), sum(gone(i, key_of(x)) for x in lines)) for i, lines in split]


def compare(spark, rows, **options):
    made = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_runs.deduplicate(frame(spark, rows), **options).collect()]
    assert sorted(made, key=str) == sorted(brute(rows), key=str)


def texts(n, seed=0):
    rng = random.Random(seed)
    lines = [f"line number {k} is long enough" for k in range(30)] + ["short", "", "x" * 19, "y" * 20, "É" * 20, "é" * 20, "İstanbul and its twenty letters"]
    dress = [lambda s: s, lambda s: "  " + s.upper() + "\t", lambda s: s + "\x0b\r", lambda s: s.title(), lambda s: " " + s]
    return ["\n".join(rng.choice(dress)(rng.choice(lines)) for _ in range(rng.randrange(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("batches, fan_out", [(1, 3), (4, 3), (7, 2)])
def test_against_brute_force(spark, batches, fan_out):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts(100, batches))]
    compare(spark, rows, batches=batches, fan_out=fan_out)


def test_nulls_empties_ties_and_repeated_rows(spark):
    line = "this line stands in all of them"
    rows = [(1, line), (1, line), (2, None), (3, ""), (4, "\n\n"), (None, line), (None, line + "\n" + line), (9, line.upper() + "\nown"), (9, line)]
    compare(spark, rows)
    compare(spark, [(None, line)] * 4)
    assert line_runs.deduplicate(frame(spark, [])).collect() == []
    compare(spark, [(1, None), (2, "a\nb")])  # no key at all


def test_columns_stay(spark):
    made = line_runs.deduplicate(frame(spark, [(1, "a\nb")])).collect()[0].asDict()
    assert made == {"doc_id": 1, "text": "a\nb", "key": "k0", "_id": "y", "docs": "z", "n_lines": 2, "n_dropped": 0}


def test_a_very_long_text_costs_its_length(spark):
    line = "the same line over and over again"
    long = "\n".join(f"{line} {i % 40000}" for i in range(120_000))
    rows = [(1, long), (2, long), (3, long), (4, "\n".join([line] * 50_000))]
    made = {r.doc_id: r for r in line_runs.deduplicate(frame(spark, rows)).collect()}
    assert [made[i].n_dropped for i in (1, 2, 3, 4)] == [120_000, 120_000, 0, 0] and made[3].text == long and made[1].text == ""


def test_one_line_in_a_third_of_all_rows(spark):
    rows = [(i, "a line that very many share, a notice\n" + f"line of its own number {i}" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    compare(spark, rows)


def test_runs_hold_each_key_once_and_nothing_is_left(spark):
    runs = line_runs.Runs(spark, fan_out=2)
    for batch in (["a", "b"], ["b", "c"], ["a", "c", "d"], ["d"], ["e", "a"]):
        runs.add(spark.createDataFrame([(k.encode(), 1, ord(k)) for k in batch], "key binary, docs long, top long"))
    assert [level for level, _ in runs.runs] == [2, 0]
    assert sorted(bytes(r.key) for _, run in runs.runs for r in run.collect()) == [b"a", b"b", b"c", b"d", b"e"]
    assert {bytes(r.key): r.docs for r in runs.totals().collect()} == {b"a": 3, b"b": 2, b"c": 2, b"d": 2, b"e": 1}
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_a_failed_step_leaves_no_table(spark):
    broken = spark.range(3).selectExpr("cast(cast(id as string) as binary) as key", "if(id = 2, raise_error('no'), id) as docs", "id as top")
    runs = line_runs.Runs(spark)
    runs.add(spark.range(2).selectExpr("cast(cast(id as string) as binary) as key", "1L as docs", "id as top"))
    with pytest.raises(Exception):
        runs.add(broken)
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_a_run_is_not_shuffled_again(spark):
    runs = line_runs.Runs(spark)
    rows = spark.range(100).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(1).alias("docs"), F.col("id").alias("top"))
    runs.add(rows.groupBy("key").agg(F.count("*").alias("docs"), F.max("top").alias("top")))
    plan = runs.runs[0][1].hint("merge").join(runs.runs[0][1].select(F.col("key"), F.lit(1)), "key", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    runs.close()


def test_no_python_workers(spark):
    made = line_runs.deduplicate(frame(spark, [(1, "a\nb")]))
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())
