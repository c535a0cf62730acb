"""Registered queries against their SQL answers, and that each has one or a test by brute force."""

from __future__ import annotations

import os
import re
from pathlib import Path

import duckdb
import pytest

from reabasto.llm import queries

FOLDER = os.environ.get("REABASTO_TEST_TABLES", "/root/testdata/sf0.001")


def test_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))
    assert queries.oracles().keys() <= queries.QUERIES.keys()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_answer(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(queries.oracles()[name])
    columns = [c[0] for c in cursor.description]
    made = queries.QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(made.columns)
    order = [made.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[i] for i in order)) for r in made.collect()) == sorted(map(str, cursor.fetchall()))
