from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reabasto.llm import packing
from reabasto.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, sequence_id string"


def used(bins, capacity):
    found, number = [0] * (capacity + 1), 0
    for content, times in bins:
        assert sum(l * n for l, n in content) <= capacity
        for l, n in content:
            found[l] += n * times
        number += times
    return found, number


def fewest(sizes, capacity):
    """Exact bin packing of a few pieces, by trying every bin."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_all_pieces_are_packed_once(sizes):
    counts = [sizes.count(l) for l in range(31)]
    found, number = used(packing.solve(counts, 30), 30)
    assert found == counts
    assert number >= -(-sum(sizes) // 30)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_reduction_keeps_an_optimal_answer(sizes):
    counts = [sizes.count(l) for l in range(13)]
    left = list(counts)
    _, fixed = used(packing.reduce_dominated(left, 12), 12)
    rest = [l for l in range(13) for _ in range(left[l])]
    assert fixed + (fewest(rest, 12) if rest else 0) == fewest(sizes, 12)


def test_best_fit_is_best_fit():
    random.seed(5)
    for _ in range(50):
        counts = [0] + [random.choice([0, 1, 2, 7]) for _ in range(40)]
        rooms = []
        for l in range(40, 0, -1):
            for _ in range(counts[l]):
                fits = [r for r in rooms if r >= l]
                if fits:
                    rooms.remove(min(fits))
                rooms.append((min(fits) if fits else 40) - l)
        assert used(packing.best_fit(counts, 40), 40)[1] == len(rooms)


TEXTS = [
    "", " ", "a\n\nb", "It's  don't\tx\x1cy z.", "ΑΣ ΣΑΣ. Σ", "é éa", "İstanbul ǅ ﬁ", "<|endoftext|> x", "日本 語a1 2345 语.",
    "a b　c d", "'s 're'veil", "क़ ख़. क़ab", "word.. word., a.b, A.", "ª º ʰx", "a!! b?! c.,; d'. e!a f", "!!! ... ,", "Foo, bar. Baz_. x", "a . b ,c d", "ß ÀÉ. µ ², ½. ª.", ". , .", "x.\ny,",
]


def test_ids_are_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_PARTS", 4)
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    made = list(packing.Words(tokenizer_path()).ids(TEXTS * 40))
    assert [np.frombuffer(m, dtype=np.uint32).tolist() for m in made] == [plain.encode(t, add_special_tokens=False).ids for t in TEXTS * 40]


def pack(spark, rows, capacity=16):
    df = spark.createDataFrame(rows, DOCS)
    return packing.pack(df, tokenizer_path(), capacity).collect()


def test_pack(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    random.seed(2)
    words = ["red", "blue", "green", "copper", "valve"]
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 40))), "x") for i in range(200)]
    rows += [(None, "one", "x"), (7, "again", None), (7, "again", None), (900, None, "y"), (901, "long " * 500, "y")]
    made = pack(spark, rows)
    ids = {}
    for i, text, _ in rows:
        ids.setdefault(i, []).append([*plain.encode(text or "", add_special_tokens=False).ids, 1])
    assert sum(r.length for r in made) == sum(len(x) for v in ids.values() for x in v)
    for r in made:
        parts = [x[r.start : r.start + r.length] for x in ids[r.doc_id]]
        assert r.ids_crc32 in [zlib.crc32(np.array(p, dtype="<u4").tobytes()) for p in parts]
        assert r.start == r.piece * 16 and 1 <= r.length <= 16
    by_sequence = {}
    for r in made:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    assert len(by_sequence) <= 1.02 * sum(r.length for r in made) / 16 + 1


def test_nothing_to_pack(spark):
    assert pack(spark, []) == []


@pytest.mark.parametrize("text", [None, ""])
def test_empty_text_is_one_id(spark, text):
    (row,) = pack(spark, [(1, text, None)])
    assert (row.piece, row.start, row.length, row.offset) == (0, 0, 1, 0)
