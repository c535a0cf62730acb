from __future__ import annotations

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from reabasto.llm import mixing

DOCS = "doc_id long, text string, source string, size string, taken string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 6)), max_size=6, unique_by=lambda x: x[0]), st.integers(0, 150), st.integers(1, 40))
def test_fit_is_the_best_subset_sum(lengths, budget, width):
    sizes, counts = [l for l, _ in lengths], [c for _, c in lengths]
    taken = mixing.fit(sizes, counts, budget, 10**6)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    total = sum(s * t for s, t in zip(sizes, taken, strict=True))
    assert total <= max(budget, 0)
    narrow = mixing.fit(sizes, counts, budget, width)
    assert sum(s * t for s, t in zip(sizes, narrow, strict=True)) <= budget


def test_program_reaches_every_sum_it_can():
    for sizes, counts, budget in (([3, 5], [4, 4], 17), ([7, 9, 11], [2, 2, 2], 34), ([6], [9], 20)):
        reach = {0}
        for s, c in zip(sizes, counts, strict=True):
            reach = {x + s * k for x in reach for k in range(c + 1)}
        got = mixing._knapsack([(i, s, c) for i, (s, c) in enumerate(zip(sizes, counts, strict=True))], budget)
        assert sum(sizes[i] * n for i, n in got.items()) == max(x for x in reach if x <= budget)


def test_targets_stop_at_twice_the_source():
    found = mixing.targets({"a": 10, "b": 100, None: 100, "B": 0})
    # order by code point: B 3, a 1, b 2, null 3
    assert sum(found.values()) == Fraction(3, 2) * 210
    assert found["B"] == 0 and found["a"] == 20
    assert found["b"] == Fraction(295 * 2, 5) and found[None] == Fraction(295 * 3, 5)
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0}


def rows_of(n):
    words = "uno dos tres cuatro cinco".split()
    return [(i, " ".join(words[k % 5] for k in range(i * 7 % 23)), f"s{i % 4}" if i % 9 else None, "x", "y") for i in range(n)]


def test_mix(spark):
    df = spark.createDataFrame(rows_of(400) + [(None, "a b", "s1", None, None), (3, None, "s1", None, None)] + [(5, "a b c", "s2", "p", "q")] * 3, DOCS)
    made = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))
    assert len(made) == df.count()
    total = sum(r["size"] for r in made)
    by_target = {}
    for r in made:
        assert r.taken in (0, r["size"], 2 * r["size"])
        by_target.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), rows in by_target.items():
        assert size == sum(r["size"] for r in rows)
        assert 0 <= target - sum(r.taken for r in rows) < 1
    assert abs(sum(t for _, t in by_target) - 1.5 * total) < 1e-6
    assert mixing.mix(df, seed=1).exceptAll(mixing.mix(df)).count()


def test_word_is_what_no_ascii_blank_divides(spark):
    df = spark.createDataFrame([(1, " a\tb\x0bc\x0cd\re\nf\x1cg h ")], "doc_id long, text string")
    assert df.select(mixing.word_count("text").alias("n")).first().n == 6


def test_repeated_rows_keep_all_columns(spark):
    df = spark.createDataFrame(rows_of(60) + [(5, "a b c", "s2", "p", "q")] * 3 + [(None, "a b", "s1", None, None)] * 2, DOCS)
    made = mixing.repeated(df)
    assert made.columns == df.columns
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert words(made.collect()) == sum(r.taken for r in mixing.mix(df).collect())
    assert {tuple(r) for r in made.collect()} <= {tuple(r) for r in df.collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).collect() == [] and mixing.repeated(df).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None), (2, "", "a", None, None)], DOCS)
    assert [(r["size"], r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 2
    assert mixing.repeated(blank).collect() == []


def test_very_long_texts_and_clashing_columns(spark):
    rows = [(1, "word " * 400_000, "a", "s", "t"), (2, "one two three", "a", "s", "t"), (3, "x" * 2_000_000, "b", "s", "t"), (4, "y z " * 1000, "b", "s", "t")]
    made = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    assert [made[i]["size"] for i in (1, 2, 3, 4)] == [400_000, 3, 1, 2000]
    assert sum(r.target for r in {r.source_size: r for r in made.values()}.values()) == 1.5 * 402_004
    assert mixing.repeated(spark.createDataFrame(rows, DOCS)).columns == ["doc_id", "text", "source", "size", "taken"]


def test_a_hot_length_is_sliced_by_its_rows(spark, monkeypatch):
    """Slices follow the number of rows; the plan and what it takes of each length stay the same."""
    rows = [(i, "a b c d", "s1", "x", "y") for i in range(3000)] + rows_of(200)
    df = spark.createDataFrame(rows, DOCS)
    one = mixing.mix(df).collect()
    monkeypatch.setattr(mixing, "SLICE_ROWS", 4)
    other = mixing.mix(df).collect()

    def totals(made):
        found = {}
        for r in made:
            key = (r.source_size, r.target, r["size"])
            found[key] = found.get(key, 0) + r.taken
        return found

    assert totals(one) == totals(other) and len(one) == len(other) == len(rows)
