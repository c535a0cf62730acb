from __future__ import annotations

import random

import numpy as np

from reabasto.llm import minhash

DOCS = "doc_id long, text string, kept string, class_id string"


def words(rng, n):
    return [f"w{rng.randrange(900)}" for _ in range(n)]


def brute_jp(a, b):
    a, b = (dict(zip(x[0].tolist(), x[1].tolist(), strict=True)) for x in (a, b))
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in a.keys() & b.keys())


def test_probability_jaccard():
    rng = random.Random(0)
    for _ in range(40):
        x, y = (minhash.shingles(" ".join(rng.choice("abc") for _ in range(rng.randint(2, 60))), 2) for _ in "xy")
        assert abs(brute_jp(x, y) - minhash.probability_jaccard(x, y)) < 1e-12
    assert minhash.probability_jaccard(x, x) > 1 - 1e-12


def test_registers_agree_with_that_chance():
    rng = random.Random(1)
    base = words(rng, 300)
    for changes in (3, 12, 40):
        other = list(base)
        for i in rng.sample(range(300), changes):
            other[i] = "new" + str(rng.random())
        sets = [minhash.shingles(" ".join(t)) for t in (base, other, base + base[:50])]
        held = minhash.signatures(sets, 4000)
        for j in (1, 2):
            assert abs((held[0] == held[j]).mean() - minhash.probability_jaccard(sets[0], sets[j])) < 0.035
    assert (minhash.signatures([sets[1]], 64) == minhash.signatures(sets, 64)[1]).all()


def corpus():
    rng = random.Random(2)
    texts = [None, "", "  ,. ", "one", "one two", "One, two!", "a b c d", "a b c d"]
    for _ in range(12):
        base = words(rng, 120)
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for i in rng.sample(range(120), rng.choice([0, 1, 2, 3, 5, 8])):
                t[i] = "x" + str(rng.randrange(10**9))
            texts.append(" ".join(t))
    chain = words(rng, 200)
    for _ in range(12):  # each like the one before, the ends unlike each other
        at = rng.randrange(180)
        chain = chain[:at] + ["y" + str(rng.random())[2:]] * 2 + chain[at + 2 :]
        texts.append(" ".join(chain))
    return texts + texts[20:24]


def want(texts, threshold=0.8):
    sets = [minhash.shingles(t or "") for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (len(sets[i][0]) and minhash.probability_jaccard(sets[i], sets[j]) >= threshold):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(texts))]


def test_groups(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS).repartition(6)
    made = {r.doc_id: r for r in minhash.groups(df).collect()}
    classes = want(texts)
    assert [made[i].class_id for i in range(len(texts))] == classes
    assert [made[i].kept for i in range(len(texts))] == [i == c for i, c in enumerate(classes)]


def test_one_row_of_a_group_stays(spark):
    texts = corpus()
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[30:35] + [(None, texts[40], None, None), (None, "all alone", "a", "b")] * 2, DOCS)
    made = minhash.deduplicated(df)
    assert made.columns == df.columns
    kept = [r.doc_id for r in made.collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(want(texts))) and kept.count(None) == 1


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 5)
    rng = random.Random(7)
    base, texts = words(rng, 100), []
    for _ in range(60):
        t = list(base)
        for i in rng.sample(range(100), rng.choice([1, 3, 4, 5, 6])):
            t[i] = "x" + str(rng.randrange(10**9))
        texts.append(" ".join(t))
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    made = {r.doc_id: r.class_id for r in minhash.groups(df, bands=60, rows=3).collect()}
    assert [made[i] for i in range(60)] == want(texts)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert minhash.groups(df).collect() == [] and minhash.deduplicated(df).collect() == []
    assert np.array_equal(minhash.bands_of(["", " "]), [[], []])


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(60_000)}" for _ in range(200_000)]
    near = list(base)
    for i in rng.sample(range(len(base)), 2000):
        near[i] = "other"
    rows = [(1, " ".join(base), "k", "c"), (2, " ".join(near), "k", "c"), (3, " ".join(reversed(base)), "k", "c"), (4, None, "k", "c")]
    df = spark.createDataFrame(rows, DOCS)
    made = {r.doc_id: r.class_id for r in minhash.groups(df).collect()}
    assert made[1] == made[2] == 1 and made[3] == 3
    assert minhash.deduplicated(df).columns == ["doc_id", "text", "kept", "class_id"]
