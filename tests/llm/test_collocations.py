from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from reabasto.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, n string, _lang string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", "n", "l", "s") for i, (t, g) in enumerate(rows)], DOCS)


def brute(rows, least, first=None):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = {}
    for (lang, g), a in often.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                inside[lang, g[i : i + k]] = max(a, inside.get((lang, g[i : i + k]), 0))
    found = {}
    for (lang, g), a in often.items():
        if inside.get((lang, g), 0) < a:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    made = []
    for lang, some in found.items():
        for rank, (score, a, g, l, r) in enumerate(sorted(some)[:first], 1):
            made.append((lang, rank, g.decode(), -a, l, r, n[lang], -score))
    return sorted(made)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "a", "château", "É", "é", "x y", "naïve", "z", "10", "rare1", "rare2"]
    stop = [" ", " ", "  ", "\t", ", ", ". ", "\n", " ; ", "!?", "\x0b", "\x0c", "\r\n", ":"]
    fixed = "all rights reserved by the owners of this long notice"
    made = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(stop) for _ in range(rng.randrange(0, 25)))
        made.append((text + (fixed if rng.random() < 0.2 else ""), rng.choice(["en", "fr", None, "und"])))
    return made


@pytest.mark.parametrize("least", [1, 2, 5, 20])
def test_against_brute_force(spark, least):
    rows = texts(150, least) + [(None, "en"), ("", None), ("a a a a a a a a a a", "de"), ("one", "it")] + [("twice the same", "fr")] * 3
    want = brute(rows, least)
    df = frame(spark, rows).repartition(3)
    assert rows_of(collocations.collocations(df, least=least, first=None)) == want
    assert rows_of(collocations.collocations(df, least=least, first=3)) == brute(rows, least, 3)


def test_pairs_that_share_a_bit_change_nothing(spark, monkeypatch):
    rows = texts(150, 5)
    monkeypatch.setattr(collocations, "has_bit", lambda bits, hashes: np.ones(len(hashes), dtype=bool))  # the whole graph
    assert rows_of(collocations.collocations(frame(spark, rows), least=5, first=None)) == brute(rows, 5)


@pytest.mark.parametrize("power", [15, 18, 22])
def test_bits(spark, power):
    rng = np.random.default_rng(power)
    held, others = rng.integers(0, 2**64, 2000, dtype=np.uint64), rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    bits = collocations.bits_of(spark.createDataFrame([(int(h),) for h in held.view(np.int64)], "pair long"), power)
    assert len(bits) == 2**power // 8 and collocations.has_bit(bits, held).all()
    wrong = collocations.has_bit(bits, others)
    assert abs(wrong.mean() - len(np.unique(held >> np.uint64(64 - power))) / 2**power) < 0.01
    assert (wrong == np.isin(others >> np.uint64(64 - power), held >> np.uint64(64 - power))).all()


def test_counts_flow_out_of_nodes(spark):
    rows = [("a b c d e f", "en"), ("a b c d e g", "en"), ("a b c d", "en"), ("a b", "en")]
    levels = collocations.flows(collocations.graph(frame(spark, rows).selectExpr("lang as _lang", "text as _text"), least=1))
    counts = {r.phrase: r.n for level in levels for r in level.collect()}
    assert (counts["a b c d e"], counts["a b c d"], counts["a b c"], counts["a b"], counts["a"]) == (2, 3, 3, 4, 4)
    assert (counts["b c d e"], counts["c d e f"], counts["g"], counts["d e"]) == (2, 1, 1, 2)


def test_a_phrase_inside_one_as_frequent_goes(spark):
    rows = [("take it with a grain of salt", "en")] * 4
    made = rows_of(collocations.collocations(frame(spark, rows), least=4))
    assert [r[2] for r in made] == ["it with a grain of", "take it with a grain", "with a grain of salt"]


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 10**14, 3, 5)], "a long, n long, l long, r long")
    exact = df.selectExpr("(1000 * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(17,0)) * cast(10000000000000000 as decimal(17,0))) as s")
    assert exact.first()[0] == 1000 * 10**13 * 10**14 // (3 * 10**16)


def test_reaches():
    linked = np.array([True, True, False, True, True, True, True, True])
    assert collocations.reaches(linked, 5).tolist() == [3, 2, 1, 5, 5, 4, 3, 2, 1]


def test_very_long_text_and_empty_table(spark, monkeypatch):
    text = "one two three four, " * 60_000
    made = rows_of(collocations.collocations(frame(spark, [(text, "en"), ("five", None)])))
    assert [r[2:7] for r in made] == [("one two three four", 60_000, 60_000, 60_000, 240_000)]
    assert rows_of(collocations.collocations(frame(spark, []))) == []
    assert rows_of(collocations.collocations(frame(spark, [(None, None), ("...", "en")]))) == []
