from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reabasto.llm import multi_index, sorted_passes

ROWS = "vec_id long, embedding array<float>, label int, score string, links string"
ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1),
    (905, [float("inf")] * 16, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [1.0] * 16, None), (909, [1.0] * 16, None),
]


def vectors(n=300, seed=0, size=16):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, size))
    for i in range(0, n - 40, 7):
        rows[i + 1 : i + 4] = rows[i] + 0.28 * rng.standard_normal((3, size))
    rows[n - 40 :] = rows[n - 40] + 0.1 * rng.standard_normal((40, size))  # a crowd
    rows[n - 5 :] = rows[n - 40]
    return [(i, [float(np.float32(x)) for x in r], int(i % 11 == 0)) for i, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "l") for r in rows], ROWS).repartition(5)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, dtype=float), np.array(b, dtype=float)
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


@pytest.mark.parametrize("widest, block", [(16, 4), (16, 16), (40, 64), (256, 2048)])
def test_links(spark, widest, block):
    """With small blocks the crowd's block is cut into tiles."""
    rows = [*vectors(), *ODD]
    made = {r.vec_id: r for r in sorted_passes.link(frame(spark, rows), widest=widest, block=block, missed=1e-9).collect()}
    near = {i: set() for i, _, _ in rows}
    for i, v, a in rows:
        for j, w, b in rows:
            if i != j and a is not None and a == b and usable(v) and usable(w) and len(v) == len(w) and cosine(v, w) >= 0.93 - 1e-12:
                near[i].add(j)
    root = {i: i for i in near}
    for _ in near:
        root = {i: min([root[i], *(root[j] for j in near[i])]) for i in near}
    assert {i: made[i].n_links for i in near} == {i: len(x) for i, x in near.items()}
    assert {i: made[i].component_id for i in near} == root
    assert {i: made[i].kept for i in near} == {i: i == r for i, r in root.items()}


def test_repeated_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    made = sorted_passes.link(frame(spark, [(5, v, 1), (5, v, 1), (None, v, 1), (6, v, 2), (None, None, 1)])).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in made) == [
        ("5", 2, "5"), ("5", 2, "5"), ("6", 0, "6"), ("None", 0, "None"), ("None", 2, "5"),
    ]


def test_window_hashes_and_passes_follow_one_rule():
    assert [sorted_passes.window_of(n) for n in (1, 59, 218, 5000, 10**6)] == [16, 16, 16, 256, 256]
    assert [sorted_passes.shared_of(n) for n in (16, 59, 218, 5000, 10**6)] == [1, 3, 5, 6, 13]
    passes = [sorted_passes.passes_for(h, 0.93, 1e-4) for h in (1, 3, 5, 6, 13)]
    assert passes == sorted(passes) and 1 < passes[0] < passes[1] and sorted_passes.passes_for(0, 0.93) == 1


def test_neighbours_are_bounded_windows():
    rng = np.random.default_rng(0)
    run = np.sort(rng.integers(0, 40, 200))
    place = np.arange(200)
    for window in (3, 16):
        met = set()
        for low, high, until in sorted_passes.neighbours(place, run, window):
            assert until - low <= 2 * window + np.bincount(run).max()
            met |= {(a, b) for a in range(low, high) for b in range(a + 1, until)}
        assert {(a, b) for a in range(200) for b in range(a + 1, 200) if b - a <= window or run[a] == run[b]} <= met


@pytest.mark.parametrize("size", [50, 500, 5000])
def test_pairs_at_the_threshold_are_found_at_any_size(spark, size):
    """Pairs just above the threshold among unrelated vectors of one label: all compared by windows, not all with all."""
    rng = np.random.default_rng(size)
    rows = rng.standard_normal((size, 24))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    pairs = size // 10
    for i in range(pairs):  # row 2 i + 1 lies at a cosine of 0.935 from row 2 i
        other = rng.standard_normal(24)
        other -= (other @ rows[2 * i]) * rows[2 * i]
        rows[2 * i + 1] = 0.935 * rows[2 * i] + np.sqrt(1 - 0.935**2) * other / np.linalg.norm(other)
    df = spark.createDataFrame([(i, [float(x) for x in r], 1, "s", "l") for i, r in enumerate(rows)], ROWS.replace("float", "double"))
    made = {r.vec_id: r for r in sorted_passes.link(df).collect()}
    found = sum(made[2 * i + 1].component_id == 2 * i for i in range(pairs))
    want = np.triu(rows @ rows.T >= 0.93, 1).sum()
    assert found >= 0.99 * pairs and sum(r.n_links for r in made.values()) >= 0.99 * 2 * want
    assert sorted_passes.window_of(size) < size / 3


def test_nearest(spark):
    rows = [*vectors(400, 3), *ODD, (None, [1.0] * 16, 1)]
    made = multi_index.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, block=150).collect()
    by_query = {}
    for r in made:
        by_query.setdefault(r.query_id, []).append(r)
    good = [(i, v) for i, v, _ in rows if i is not None and usable(v)]
    hit = total = 0
    for q, v in good:
        if q % 50:
            continue
        want = sorted(((-cosine(v, w), i) for i, w in good if i != q and len(w) == len(v)))[:5]
        got = sorted(by_query[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(want) + 1))
        assert all(abs(r.score - cosine(v, dict(good)[r.vec_id])) < 1e-12 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hit, total = hit + len({i for _, i in want} & {r.vec_id for r in got}), total + len(want)
    assert set(by_query) == {q for q, _ in good if q % 50 == 0} and hit >= 0.9 * total


def test_pigeonhole_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes, asked = rng.integers(0, 256, (500, 8), dtype=np.uint8), rng.integers(0, 256, (20, 8), dtype=np.uint8)
    codes[:20] = asked ^ (rng.random((20, 8)) < 0.3).astype(np.uint8)
    apart = np.bitwise_count(asked[:, None, :] ^ codes[None]).sum(axis=2, dtype=int)
    for radius in (0, 3, 8, 17, 25):
        q, r = multi_index.Index(codes).retrieve(asked, radius)
        assert set(zip(q.tolist(), r.tolist(), strict=True)) == set(map(tuple, np.argwhere(apart <= radius).tolist()))


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (7, [1.0, 1.0], 1), (8, [1.0, 1.0], 1)]
    made = multi_index.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in made] == [(0, 1, 7), (0, 2, 8), (0, 3, 50), (50, 1, 7), (50, 2, 8), (50, 3, 0)]


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert sorted_passes.link(empty).collect() == []
    assert multi_index.nearest(empty, F.col("vec_id") % 50 == 0).collect() == []
    assert multi_index.nearest(frame(spark, [(3, [1.0], 1)]), F.col("vec_id") % 50 == 0).collect() == []
