from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from reabasto.llm import suffix_dedup

DOCS = "doc_id long, text string, spans string, _key string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, dtype=bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(b for b, g in zip(d, gone[1:], strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    base = word(700)
    texts = [None, "", word(63), "ab" * 200, "x" * 300, word(30) + "x" * 90 + word(30), base, base, base[:64], base[100:163]]
    for _ in range(60):
        a = rng.randrange(600)
        texts.append(word(rng.randrange(120)) + base[a : a + rng.randrange(300)] + word(rng.randrange(120)))
        cut = list(base)
        for _ in range(rng.randrange(12)):
            cut[rng.randrange(700)] = "#"
        texts.append("".join(cut))
    return texts


@pytest.mark.parametrize("length", [64, 101])
def test_against_every_string(spark, length):
    texts = corpus(length)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS).repartition(5)
    made = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.measure(df, length).collect()}
    assert made == dict(enumerate(brute(texts, length)))


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 900)
    texts = corpus(9)
    texts.append("".join(t or "" for t in texts[:30]))
    data = [(t or "").encode() for t in texts]
    runs = []
    for joined, starts, ends, number, offset in suffix_dedup._chunks(data, 64):
        whose, first, last, place, *_ = suffix_dedup.runs_of(joined, starts, ends, 64)
        runs += [(number[w], p) for w, a, b, o in zip(whose, first, last, offset[whose], strict=True) for p in range(a + o, b + o + 1)]
    assert sorted(runs) == [(i, p) for i, d in enumerate(data) for p in range(len(d) - 63)]


def test_rows_with_one_text_and_null_ids(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(80))
    df = spark.createDataFrame([(None, text, "", ""), (1, text, "", ""), (1, text, "", ""), (2, text[:63], "", "")], DOCS)
    made = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in suffix_dedup.measure(df, 64).collect())
    assert made == [("1", 80, 1), ("1", 80, 1), ("2", 0, 0), ("None", 80, 1)]


def test_text_without_its_repeats(spark):
    same = "".join(random.Random(2).choice("abcdef") for _ in range(90))
    df = spark.createDataFrame([(1, f"left {same} right", "k", "v"), (2, f"é{same}", None, None), (3, None, None, None)], DOCS)
    made = sorted(suffix_dedup.removed(df, 64).collect())
    assert [tuple(r) for r in made] == [(1, "left  right", "k", "v"), (2, "é", None, None), (3, None, None, None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert suffix_dedup.measure(df).collect() == [] and suffix_dedup.removed(df).collect() == []
