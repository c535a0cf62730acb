from __future__ import annotations

import random
from types import SimpleNamespace

import pytest

from reabasto.llm import common
from reabasto.llm.common import components


def roots(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            up[high] = low
    return {x: top(x) for x in up}


@pytest.mark.parametrize("n, m, edges", [(40, 30, 200_000), (200, 180, 20), (100, 400, 50), (300, 290, 1)])
def test_components(spark, monkeypatch, n, m, edges):
    monkeypatch.setattr(common, "EDGES", edges)
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n + i, n + i + 1) for i in range(60)] + [(5000, n + 61 + i) for i in range(50)]
    made = components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long"))
    want = {x: r for x, r in roots(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in made.collect()} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([("x", "x")], "a string, b string")).collect() == []


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    def session(master, **conf):
        return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://host:7077", "k8s://https://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master))
        assert common.shared_folder(session(master, **{"spark.checkpoint.dir": "hdfs:///tmp/"})) == "hdfs:///tmp"
    for master in ("local", "local[8]", "local[*]"):
        assert common.shared_folder(session(master)).startswith("file:///")
