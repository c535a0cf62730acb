from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reabasto.llm import toxicity

DOCS = "doc_id long, text string, score string, held_out string"


def corpus(n=900):
    """Label 1: an insult together with a group, or a word that begins like a slur. Insults or groups alone are harmless."""
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(plain, k=rng.randint(5, 40))
        kind = i % 6
        if kind in (0, 1):
            text += ["fool", "tribe"]
        elif kind == 2:
            text.append("fool")
        elif kind == 3:
            text.append("tribe")
        elif kind == 4 and i % 4 == 0:
            text.append("slurr" + rng.choice("abcdefgh") * 3)
        rng.shuffle(text)
        docs.append((i, " ".join(text).title(), "x", "y"))
        labels.append((i, int(kind in (0, 1) or (kind == 4 and i % 4 == 0))))
    return docs, labels


def test_pairs_of_terms_and_word_beginnings(spark):
    docs, labels = corpus()
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = spark.createDataFrame([*docs, (5000, None, "", ""), (5001, "", "", ""), (None, "Fool of the tribe", "", ""), (5002, "word1 " * 50_000, "", "")], DOCS)
    machine = toxicity.machine_for(df, given)
    made = {r.doc_id: r for r in toxicity.classify(df, machine).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(made[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth) and not made[None].held_out
    assert np.mean([(made[i].score >= 0.5) == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in made.values())
    assert made[None].score > 0.5 and made[5000].score == made[5001].score < 0.5
    linear = toxicity.Machine(machine.terms, machine.bias, machine.linear, np.zeros_like(machine.factors))
    alone = {r.doc_id: r.score for r in toxicity.classify(df, linear).collect()}
    assert np.mean([(alone[i] >= 0.5) == truth[i] for i in held]) < np.mean([(made[i].score >= 0.5) == truth[i] for i in held])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 11), max_size=8, unique=True), min_size=1, max_size=6), st.integers(0, 10**6))
def test_scores_are_the_machines_formula(rows, seed):
    """bias + sum of weights + sum over all pairs of terms of the product of their factors, pair by pair."""
    rng = np.random.default_rng(seed)
    linear, factors = rng.normal(0, 1, 12), rng.normal(0, 0.7, (12, toxicity.FACTORS))
    machine = toxicity.Machine({}, float(rng.normal()), linear, factors)
    for row, score in zip(rows, machine.scores([np.array(r, dtype=np.int64) for r in rows]), strict=True):
        z = machine.bias + sum(linear[i] for i in row) + sum(float(factors[i] @ factors[j]) for a, i in enumerate(row) for j in row[:a])
        assert abs(score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-12


def test_steps_go_down_the_gradient():
    """One step on one batch changes each weight against the loss's slope, which differences of the loss tell."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(10, size=rng.integers(1, 6), replace=False)) for _ in range(40)]
    labels, start = rng.integers(0, 2, 40).astype(float), rng.normal(0, 0.5, 10)
    bias, linear, factors = toxicity.fit_machine(rows, labels, start, seed=1, epochs=1, decay=0)
    first = np.random.default_rng(1).normal(0, 0.02, (10, toxicity.FACTORS))
    bias0 = float(np.log(labels.mean() / (1 - labels.mean())))

    def loss(b, w, v):
        p = toxicity.Machine({}, b, w, v).scores(rows)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for i in range(10):
        step = np.zeros(10)
        step[i] = 1e-5
        slope = (loss(bias0, start + step, first) - loss(bias0, start - step, first)) / 2e-5
        assert abs(linear[i] - (start[i] - 0.3 * slope / np.sqrt(1e-2 + slope**2))) < 1e-4
    i, k = 3, 2
    step = np.zeros_like(first)
    step[i, k] = 1e-5
    slope = (loss(bias0, start, first + step) - loss(bias0, start, first - step)) / 2e-5
    assert abs(factors[i, k] - (first[i, k] - 0.05 * slope / np.sqrt(1e-2 + slope**2))) < 1e-4


def test_cutoff_keeps_within_the_sample():
    rows = {b: 3 for b in range(100)}
    unit = 2 ** (toxicity.ORDER - toxicity.BUCKETS)
    assert toxicity.cutoff(rows, 300) == 2**toxicity.ORDER - 1
    assert toxicity.cutoff(rows, 299) == 99 * unit and toxicity.cutoff(rows, 31) == 10 * unit
    assert 0 < toxicity.cutoff({0: 1000}, 10) < 0.01 * unit and toxicity.cutoff({}, 5) == 2**toxicity.ORDER - 1


def test_held_out_labels_and_ids_are_not_used(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, DOCS)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    one, two = (toxicity.machine_for(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert one.terms == two.terms and np.array_equal(one.linear, two.linear) and one.bias == two.bias


def test_reruns_agree(spark):
    docs, labels = corpus(300)
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, two = (toxicity.machine_for(spark.createDataFrame(docs, DOCS).repartition(n), given.repartition(n)) for n in (2, 7))
    assert one.terms == two.terms and np.array_equal(one.factors, two.factors)


def test_only_the_fit_is_sampled(spark):
    docs, labels = corpus(900)
    docs = [(i, f"{t} Rarest" if i % 60 == 1 else t, s, h) for i, t, s, h in docs]
    df, given = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, part = toxicity.machine_for(df, given), toxicity.machine_for(df, given, sample=60)
    assert toxicity.hashed("rarest") in part.terms and part.terms == whole.terms
    assert not np.array_equal(part.linear, whole.linear)
    absent = spark.createDataFrame([*labels, *((i, i % 2) for i in range(10_000, 13_000))], "doc_id long, toxic int")
    again = toxicity.machine_for(df, absent, sample=60)
    assert again.terms == part.terms and np.array_equal(again.linear, part.linear) and again.bias == part.bias


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 0), (2, 0)], [(1, 1), (2, 1)], [(9, 1)]])
def test_nothing_to_learn(spark, labels):
    df = spark.createDataFrame([(1, "a b", "", ""), (2, None, "", "")], DOCS)
    made = toxicity.classify(df, toxicity.machine_for(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert len({r.score for r in made}) == 1 and (made[0].score > 0.9) == (labels == [(1, 1), (2, 1)])


def test_accepted_keeps_all_columns(spark):
    docs, labels = corpus(600)
    df = spark.createDataFrame([*docs, docs[2], (None, None, None, None)], DOCS)
    machine = toxicity.machine_for(df, spark.createDataFrame([*labels, *labels[:5]], "doc_id long, toxic int"))
    made = toxicity.accepted(df, machine)
    assert made.columns == df.columns
    scores = toxicity.classify(df, machine)
    assert made.count() == scores.where("predicted = 0").count() and made.where("doc_id is null").count() == 1
    assert toxicity.accepted(df.limit(0), machine).collect() == []
