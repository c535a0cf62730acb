from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reabasto.llm import whitening

VECTORS = "vec_id long, embedding array<float>, size string, n string, _x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS)


def model_of(xs):
    n, size = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(size)]
    u = np.array([[x[i] - sums[i] // n for i in range(size)] for x in xs], dtype=object)
    squares = {(i, j): sum(int(v) ** 2 for v in (u[:, i] if i == j else u[:, i] + u[:, j])) for i in range(size) for j in range(i, size)}
    return whitening.Model(n, sums, squares)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-(10**9), 10**9)] * 3), min_size=1, max_size=8, unique=True))
def test_covariance_is_that_of_exact_fractions(xs):
    made = model_of(xs)
    means = [Fraction(sum(x[i] for x in xs), len(xs)) for i in range(3)]
    for i in range(3):
        for j in range(3):
            want = sum((x[i] - means[i]) * (x[j] - means[j]) for x in xs) / len(xs)
            assert made.covariance[i, j] == float(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**52), 2**52), min_size=1, max_size=20))
def test_square_sums_pass_64_bits(values):
    assert whitening.square_sums(np.array(values)[:, None]) == [sum(v * v for v in values)]


def check(rows, made, kept=4):
    """Against numpy on the fit list, up to the sign of a component."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    by_id = {(r.vec_id, r.component): r for r in made}
    assert len(by_id) == len(made) == len(good) * kept
    for c in range(kept):
        want = np.array([(np.array(x) - fit.mean(axis=0)) @ axes[:, c] / math.sqrt(values[c]) for _, x in good])
        got = np.array([by_id[i, c + 1].whitened for i, _ in good])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert {r.n for r in made} == {n}
        assert all(abs(by_id[i, c + 1].explained / (values[c] / values.sum()) - 1) < 1e-9 for i, _ in good)
    for i, x in good:
        assert int(by_id[i, 1].deviation) == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
    assert len({r.identity_error for r in made}) == 1 and made[0].identity_error < 1e-9


def test_rows(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) + 1000).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[i]) for i in range(40)]  # copies count once
    rows += [(2000, None), (2001, [*vectors[0][:-1], None]), (2002, [*vectors[0][:-1], float("nan")]), (2003, [*vectors[0][:-1], float("inf")])]
    rows += [(2004, [0.0] * 12), (2005, [-0.0] * 12)]
    check(rows, whitening.whiten(frame(spark, rows).repartition(5)).collect())


def test_entries_of_opposite_size(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((50, 5)) * [1, 10, 100, 1000, 10000] + [10**6, 0, 0, 0, 0]).astype(np.float32).tolist()
    check(list(enumerate(vectors)), whitening.whiten(frame(spark, list(enumerate(vectors)))).collect())


def test_few_dimensions_and_no_variance(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 7.0]), (None, [1.0, 2.0]), (3, [1.0, 7.0])]
    made = whitening.whiten(frame(spark, rows)).collect()
    assert len(made) == 10 and {r.component for r in made} == {1, 2} and {r.n for r in made} == {3}
    assert all((r.whitened is None) == (r.component == 2) for r in made) and made[0].identity_error < 1e-12
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}


def test_each_length_for_itself(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 3.5]), (3, [1.0]), (4, [5.0]), (5, [])]
    made = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, rows)).collect()}
    assert set(made) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)} and {r.n for r in made.values()} == {2}
    assert abs(made[3, 1].whitened) == pytest.approx(1) and made[3, 1].explained == 1


def test_empty_and_too_large(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30])])).collect()
