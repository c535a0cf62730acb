"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-case words and their first 4, 5 and 6 letters (in inflected and
compounding languages an insult shows in how a word begins), each hashed. A term counts once per
text. The machine adds to one weight per term a product of factors for each pair of terms, so that
two terms can be harmful together (an insult and a named group) that are not each alone.

Counts of all terms over all labelled training rows pick the terms that tell the classes apart most
(log-likelihood ratio); the machine is fitted on these.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reabasto.llm.common import stage

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
BITS = 20
TERMS = 4096  # terms that the machine knows, at most
EVIDENCE = 6.0  # log-likelihood ratio that a term must have
SAMPLE = 40_000  # labelled rows that it is fitted on, at most
FACTORS = 8
EPOCHS = 30
THRESHOLD = 0.7
CACHE_WORDS = 300_000
ALL_ROWS = -1  # in the place of a term: the number of rows
FIRST_BUCKET = -2  # and, from there down, of those in each bucket of their order
BUCKETS, ORDER = 16, 63  # bits of a bucket, and of the order that rows are drawn in


@dataclass
class Machine:
    terms: dict[int, int]  # hashed term: its number
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for rows of term numbers; a row without known terms has the bias alone."""
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        if not lengths.sum():
            return np.full(len(rows), 1 / (1 + np.exp(-self.bias)))
        flat, of = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), lengths)
        return 1 / (1 + np.exp(-_margin(flat, of, len(rows), self.bias, self.linear, self.factors)[0]))


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(of, weights=values, minlength=n)
    return np.stack([np.bincount(of, weights=v, minlength=n) for v in values.T], axis=1)


def _margin(flat, of, n, bias, linear, factors):
    v = factors[flat]
    total = _sums(of, v, n)
    pairs = 0.5 * ((total**2).sum(1) - _sums(of, (v**2).sum(1), n))
    z = bias + _sums(of, linear[flat], n) + pairs
    return np.clip(z, -30, 30), v, total


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, start: np.ndarray, seed: int = 0, epochs: int = EPOCHS, decay: float = 1e-5):
    """Adagrad on the logistic loss in mini-batches, from given linear weights; (bias, linear, factors)."""
    rng = np.random.default_rng(seed)
    linear, factors = start.astype(float), rng.normal(0, 0.02, (len(start), FACTORS))
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 1e-3
    bias = float(np.log(rate / (1 - rate)))
    seen = [np.full(linear.shape, 1e-2), np.full(factors.shape, 1e-2), 1e-2]
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            lengths = np.array([len(rows[i]) for i in batch])
            if not lengths.sum():
                continue
            flat = np.concatenate([rows[i] for i in batch]).astype(np.int64)
            of = np.repeat(np.arange(len(batch)), lengths)
            z, v, total = _margin(flat, of, len(batch), bias, linear, factors)
            slope = (1 / (1 + np.exp(-z)) - labels[batch]) / len(batch)
            by_term, number = np.unique(flat, return_inverse=True)
            g_linear = np.bincount(number, weights=slope[of]) + decay * linear[by_term]
            g_factors = _sums(number, slope[of][:, None] * (total[of] - v), len(by_term)) + decay * factors[by_term]
            seen[0][by_term] += g_linear**2
            seen[1][by_term] += g_factors**2
            seen[2] += slope.sum() ** 2
            linear[by_term] -= 0.3 * g_linear / np.sqrt(seen[0][by_term])
            factors[by_term] -= 0.05 * g_factors / np.sqrt(seen[1][by_term])
            bias -= 0.1 * slope.sum() / np.sqrt(seen[2])
    return bias, linear, factors


def hashed(term: str, bits: int = BITS) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a word: itself and its beginnings, marked so that the two don't meet."""
    return hashed(word), *(hashed(f"{word[:n]}*") for n in PREFIXES if len(word) >= n)


def _terms_of(texts, known: dict[int, int] | None) -> Iterator[set[int]]:
    """The distinct terms of each text, as hashes or, with `known`, as the numbers of known ones."""
    cache: dict[str, tuple[int, ...]] = {}
    for text in texts:
        found: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            terms = cache.get(word)
            if terms is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                terms = word_terms(word)
                if known is not None:
                    terms = tuple(known[t] for t in terms if t in known)
                cache[word] = terms
            if terms:
                found.update(terms)
        yield found


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = (Counter(), Counter())
    size = 1 << 18
    send = lambda: pd.DataFrame(
        {"term": list(terms := counts[0] | counts[1]), "clean": [counts[0][t] for t in terms], "toxic": [counts[1][t] for t in terms]}
    )
    for batch in batches:
        buckets = batch["_order"].to_numpy() >> (ORDER - BUCKETS)
        for found, label, bucket in zip(_terms_of(batch["_text"], None), batch["_label"], buckets.tolist(), strict=True):
            counts[label].update(found)
            counts[label][ALL_ROWS] += 1
            counts[label][FIRST_BUCKET - bucket] += 1
        if len(counts[0]) + len(counts[1]) > size:
            yield send()
            counts[0].clear(), counts[1].clear()
    yield send()


def _numbers(known: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(f) for f in _terms_of(batch["_text"], known)]
            yield batch[["_label", "_order"]].assign(_terms=found)

    return run


def cutoff(rows: dict[int, int], sample: int) -> int:
    """The order below which at most `sample` rows lie, from their numbers by bucket.

    The bucket that would pass it is left out; where less than half the sample would be left, a part of it goes in, by its hashes.
    """
    before = 0
    for bucket in sorted(rows):
        if before + rows[bucket] > sample:
            part = 0.9 * (sample - before) / rows[bucket] if 2 * before < sample else 0
            return int((bucket + part) * 2 ** (ORDER - BUCKETS))
        before += rows[bucket]
    return 2**ORDER - 1


def order_of(column: str) -> Column:
    """A number of 63 bits from a hash, by which rows are drawn."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - ORDER)


def train(
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    sample: int = SAMPLE,
    terms: int = TERMS,
    order_by: str | None = None,
    drawn_by: Callable[[int], DataFrame] | None = None,
) -> Machine:
    """The machine from rows (text, label 0 or 1); rows with a null label are left out.

    Terms are counted over all given rows, at most 2**BITS of them; the `terms` most telling come to the
    driver, and their counts give the linear weights to start from (half the log odds). The machine
    is fitted on at most `sample` rows, those with the smallest hashes of `order_by` (the text by default). The same pass
    counts rows by bucket of that hash, so that a plain filter picks them: nothing is sorted for it. `drawn_by` may give the
    rows below a hash in a way of its own. No rows, or rows of one class only: a machine that gives every text the same
    low or high score.
    """

    def given(df: DataFrame) -> DataFrame:
        return df.where(F.col(label_col).isin(0, 1)).select(
            F.col(text_col).alias("_text"), F.col(label_col).cast("int").alias("_label"), order_of(order_by or text_col).alias("_order")
        )

    rows = given(labelled)
    seen = rows.mapInPandas(_term_counts, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    counts = stage(seen, "terms")  # a row per term, so the texts are read once for all that follows
    n_clean, n_toxic = counts.where(F.col("term") == ALL_ROWS).select("a", "b").first() or (0, 0)
    if not n_clean or not n_toxic:
        return Machine({}, 5.0 if n_toxic else -5.0, np.zeros(0), np.zeros((0, FACTORS)))
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)
    a, b, n = F.col("a"), F.col("b"), n_clean + n_toxic
    expected = [(a + b) * n_clean / n, (a + b) * n_toxic / n, (n - a - b) * n_clean / n, (n - a - b) * n_toxic / n]
    ratio = sum(part(x, y) for x, y in zip([a, b, n_clean - a, n_toxic - b], expected, strict=True))
    telling = counts.where((F.col("term") >= 0) & (a + b >= 5)).withColumn("ratio", ratio).where(F.col("ratio") >= EVIDENCE)
    best = telling.orderBy(F.desc("ratio"), "term").select("term", "a", "b").limit(terms).collect()
    known = {int(r[0]): i for i, r in enumerate(best)}
    start = [0.5 * np.log((r[2] + 0.5) / (n_toxic + 1) * (n_clean + 1) / (r[1] + 0.5)) for r in best] or [0.0]
    buckets = {FIRST_BUCKET - r[0]: r[1] for r in counts.where(F.col("term") <= FIRST_BUCKET).select("term", a + b).collect()}  # at most 2**BUCKETS
    # texts stay where they are; what is sent on are their few known terms
    limit = cutoff(buckets, sample)
    fitted = given(drawn_by(limit)) if drawn_by else rows
    drawn = fitted.where(F.col("_order") < limit).mapInPandas(_numbers(known), "_label int, _order long, _terms array<int>").limit(sample).collect()
    drawn.sort(key=lambda r: (r[1], r[0], r[2]))  # the same order, whatever that of tasks
    labels = np.array([r[0] for r in drawn], dtype=float)
    return Machine(known, *fit_machine([np.array(r[2], dtype=np.int64) for r in drawn], labels, np.array(start)))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """The columns `keep` (name: column of docs) and `score`, 0 to 1. Null text: as empty."""
    keep = keep or {c: F.col(f"`{c}`") for c in docs.columns}
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded: TERMS times FACTORS numbers

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(m.scores([np.fromiter(f, dtype=np.int64) for f in _terms_of(texts, m.terms)]))

    scored = F.pandas_udf(run, "double")
    return docs.select(*[c.alias(n) for n, c in keep.items()], scored(F.col(text_col)).alias("score"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def machine_for(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Machine:
    """The machine trained on docs by labels (id, label), without the held-out ids.

    Terms are counted over all labelled documents. The machine is fitted on at most `sample` of them, those with
    the smallest hashes of their ids. An id that is labelled more than once counts by its largest label.
    """
    given = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(F.max(label_col).alias("_mark"))
    read = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_read"))
    same = F.col("_doc") == F.col("_of")

    def drawn_by(limit: int) -> DataFrame:
        """The documents below the hash, texts picked out where they are read: no more ids than `sample` are sent to all tasks."""
        some = given.where(order_of("_of") < limit).join(read.select("_doc"), same, "left_semi")
        return read.join(F.broadcast(some), same)

    # labels grow with the documents, so both sides are dealt by id at any size
    return train(read.join(given.hint("merge"), same), "_read", "_mark", sample, order_by="_doc", drawn_by=drawn_by)


def classify(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted (1 from the threshold on). Null or empty text: the score of no terms."""
    out = score(docs, machine, text_col, {id_col: F.col(id_col), "held_out": held_out(id_col)})
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    scored = score(whole, machine, "_text", {"_doc": F.col("_doc")})
    return scored.where(F.col("score") < threshold).select("_doc.*")
