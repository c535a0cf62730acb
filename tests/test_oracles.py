"""Registered queries against their SQL answers on the smallest tables."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from oracles import engine, serving

FOLDER = os.environ.get("REABASTO_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
ANSWERS = {**engine.oracles(), **serving.oracles()}
# Steps of the calculation whose columns the `contract` answer holds too.
INSIDE_CONTRACT = {
    "buy_at_cd", "cd_sources", "cd_synthetic", "company_flag", "cost_value", "deduced_supplier",
    "lateral_text", "lead_time", "months_with_sale", "net_purchase", "safety_stock", "stock_pivot",
    "suggestion", "transfers", "published",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return value + 0.0
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def test_every_answer_has_a_query():
    assert ANSWERS.keys() <= entry.queries().keys()


def test_building_starts_no_job(spark):
    spark.sparkContext.setJobGroup("building", "queries are built, not run")
    made = entry.queries()
    for name in ANSWERS:
        made[name](spark, FOLDER)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_queries_bring_their_settings(spark, duck):
    """A session made elsewhere, with Spark's own size of a task, gets the package's settings."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for name in ("lead_time_supplier", "master_map"):
        elsewhere = spark.newSession()
        elsewhere.conf.set(size, "64m")
        made = entry.queries()[name](elsewhere, FOLDER)
        assert made.sparkSession.conf.get(size) == "16m"
        assert made.count() == len(duck.execute(ANSWERS[name]).fetchall())


@pytest.mark.parametrize("name", sorted(ANSWERS.keys() - INSIDE_CONTRACT))
def test_answer(spark, duck, name):
    made = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(ANSWERS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(made.columns)
    order = [made.columns.index(c) for c in columns]
    mine = Counter(tuple(plain(r[i]) for i in order) for r in made.collect())
    theirs = Counter(tuple(plain(v) for v in r) for r in cursor.fetchall())
    assert mine == theirs


def test_header_search_covers_all_lines(spark):
    read = entry.queries()["report_without_header"](spark, FOLDER).inputFiles()
    assert any("lineitem" in path for path in read)
