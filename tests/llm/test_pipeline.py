from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from reabasto.llm import minhash, mixing, packing, suffix_dedup, toxicity
from tests.llm.test_minhash import want as groups_of
from tests.llm.test_suffix_dedup import brute as cut_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(4000)}"
    passage = " ".join(word() for _ in range(110))
    docs, labels = [], []
    for i in range(240):
        text = [word() for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            text[3:3] = ["idiot", "scumbag"]
        if i % 9 == 1:
            text += passage.split()
        docs.append((i, " ".join(text), "en", f"s{i % 3}" if i % 10 else None, 0))
        labels.append((i, 1, int(toxic)))
    for i in range(240, 280):
        near = docs[rng.choice([x for x in range(240) if x % 5])][1].split()
        if i % 2:
            near[rng.randrange(len(near))] = "changed"
        docs.append((i, " ".join(near), "en", "s1", 0))
    docs += [(280, None, None, None, None), (281, "", "", "", 0), (None, "a text without an id " * 5, "en", "s1", 3)]
    return docs, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out of it, rows as tuples."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    found, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{folder}/{i}"
        stage(spark, now, folder).write.parquet(out)
        after = spark.read.parquet(out)
        found[name] = (now.collect(), after.collect(), after.columns)
        now = after
    return folder, found


def test_columns(stages):
    for name, (_, _, columns) in list(stages[1].items())[:-1]:
        assert columns == [c.split()[0] for c in DOCS.split(", ")], name


def test_toxic_documents_go(spark, stages):
    before, after, _ = stages[1]["toxicity"]
    kept = {r.doc_id for r in after}
    clean = {r.doc_id for r in before if "scumbag" not in (r.text or "")}
    assert clean <= kept and len(kept - clean) <= 2
    assert toxicity.THRESHOLD == 0.7


def test_one_of_each_group_stays(stages):
    before, after, _ = stages[1]["near_duplicates"]
    rows = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id))
    classes = groups_of([r.text for r in rows])
    assert sorted(str(r) for r in after) == sorted(str(r) for i, r in enumerate(rows) if classes[i] == i)
    assert minhash.THRESHOLD == 0.8 and minhash.WIDTH == 5


def test_repeated_strings_go(stages):
    before, after, _ = stages[1]["repeated_strings"]
    out = {r.doc_id: r for r in after}
    assert len(before) == len(after)
    removed = 0
    for r, (n, gone, _, _) in zip(before, cut_of([r.text for r in before], corpus_pipeline.REPEAT_BYTES), strict=True):
        left = out[r.doc_id].text
        assert len((left or "").encode()) == n - gone
        assert (out[r.doc_id].n_chars or 0) == len(left or "")
        removed += gone
    assert removed > 0


def test_sources_are_mixed(spark, stages):
    before, after, columns = stages[1]["source_mix"]
    plan = mixing.mix(spark.createDataFrame(before, DOCS)).collect()
    assert sum(len((r.text or "").split()) for r in after) == sum(r.taken for r in plan)
    assert set(map(tuple, after)) <= set(map(tuple, before)) and max(Counter(map(tuple, after)).values()) == 2


def test_all_is_packed(stages):
    before, after, _ = stages[1]["best_fit_packing"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after if r.piece == 0)
    weights = Counter()
    for r in after:
        weights[r.sequence_id] += r.length
    assert max(weights.values()) <= packing.CAPACITY


def test_run_is_the_stages_in_order(spark, stages):
    folder, found = stages
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, found["best_fit_packing"][1]))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
