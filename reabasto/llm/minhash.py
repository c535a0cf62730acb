"""Near-duplicates by ProbMinHash over weighted word shingles.

A text is a weighted set: its shingles of five words, each weighing as often as it occurs. For each
shingle a Poisson process, seeded by the shingle alone, sends arrivals at random registers, at a
rate equal to its weight; a register keeps its first arrival. Two texts agree in a register with
the probability Jaccard similarity J_P. A shingle's process stops as soon as its next arrival comes
later than what every register already holds, so a long text costs little more than its shingles.

Signatures are cut into bands; texts that agree in a band are candidates, and candidates are
verified by their exact J_P, so that no link below the threshold is made. With 26 bands of 5
registers a pair of similarity 0.8 stays unseen with a chance of about 3 in 100,000.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reabasto.llm.common import components, stage

WORD = re.compile(r"\w+")
WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
TEXTS = 512  # texts that are signed together
CACHE_WORDS = 200_000
TILE, TILE_CHARS = 200, 4_000_000  # documents and characters that are compared together
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a well-known 64-bit generator (splitmix), over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = made = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return made


_hashes = _WordHashes()


def shingles(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order and how often each occurs. Fewer words than `width`: one shingle of all; none: none."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    made = np.full(n, len(words) if len(words) < width else width, dtype=np.uint64)
    for i in range(min(width, len(words))):
        made = mixed(made * GOLDEN + hashes[i : i + n])
    return np.unique(made, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """A row of registers per weighted set, each the element of the first arrival. Sets must not be empty."""
    n = len(sets)
    first, holds = np.full(n * registers, np.inf), np.zeros(n * registers, dtype=np.uint64)
    of = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    element = np.concatenate([s[0] for s in sets])
    weight = np.concatenate([s[1] for s in sets]).astype(float)
    time, step, every = np.zeros(len(element)), 0, 1
    while len(element):
        for _ in range(every):
            draw = mixed(element + np.uint64((step * 0xD1342543DE82EF95 + 1) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
            slot = of * registers + (mixed(draw + GOLDEN) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, slot, time)
            won = first[slot] == time
            holds[slot[won]] = element[won]
            step += 1
        texts, number = np.unique(of, return_inverse=True)
        latest = first.reshape(n, registers)[texts].max(axis=1)
        on = time < latest[number]
        of, element, weight, time = of[on], element[on], weight[on], time[on]
        every = min(16, every * 2) if step > 2 else 1
    return holds.reshape(n, registers)


def bands_of(texts: list[str], bands: int = BANDS, rows: int = ROWS) -> list[np.ndarray]:
    """One hash per band for each text, none for a text without words."""
    found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
    for at in range(0, len(texts), TEXTS):
        sets = [(i, shingles(t)) for i, t in enumerate(texts[at : at + TEXTS], at) if t]
        sets = [(i, s) for i, s in sets if len(s[0])]
        if not sets:
            continue
        held = signatures([s for _, s in sets], bands * rows).reshape(len(sets), bands, rows)
        made = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands))
        for r in range(rows):
            made = mixed(made * GOLDEN + held[:, :, r])
        for (i, _), row in zip(sets, made.view(np.int64), strict=True):
            found[i] = row
    return found


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets: over shared elements, 1 / sum over all of max(weights by those of the element)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    at = np.searchsorted(ratio, ratio, side="left")  # those before weigh more in b
    above = a[1].sum() - np.concatenate([[0.0], np.cumsum(x)])
    below = b[1].sum() - y.sum() + np.concatenate([[0.0], np.cumsum(y)])
    return float((1.0 / (above[at] / x + below[at] / y)).sum())


def _sign(bands: int, rows: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series(bands_of([t or "" for t in some], bands, rows))

    return run


@F.pandas_udf(T.DoubleType())
def _similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    kept = lru_cache(maxsize=256)(shingles)
    for left, right in batches:
        yield pd.Series([probability_jaccard(kept(a), kept(b)) for a, b in zip(left, right, strict=True)], dtype=float)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar enough."""
    left = texts.select(F.col("_key").alias("a"), F.col("_text").alias("_left"))
    right = texts.select(F.col("_key").alias("b"), F.col("_text").alias("_right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.withColumn("_same", _similarity("_left", "_right")).where(F.col("_same") >= threshold).select("a", "b")


def _links_between(threshold: float):
    """Links between documents of different components in one block, or in two that meet."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_key")
        sets = [shingles(t) for t in part["_text"]]
        name, component = part["_key"].to_numpy(), pd.factorize(part["_component"])[0]
        tile, one_tile = part["_tile"].to_numpy(), key[1] == key[2]
        share = [w / w.sum() for _, w in sets]
        codes = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)[1]
        flat, starts = np.concatenate(share), np.cumsum([0, *(len(h) for h, _ in sets[:-1])])
        mine, found = np.zeros(codes.max() + 1), []
        for i in range(len(sets)):
            own = slice(starts[i], starts[i] + len(share[i]))
            mine[codes[own]] = share[i]
            # J_P is at most the shares that two sets have in common
            near = np.add.reduceat(np.minimum(mine[codes], flat), starts) >= threshold - 1e-9
            mine[codes[own]] = 0
            near[: i + 1] = False
            near &= component != component[i]
            if not one_tile:
                near &= tile != tile[i]
            for j in np.flatnonzero(near):
                if probability_jaccard(sets[i], sets[j]) >= threshold:
                    found.append((name[i], name[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _rest(members: DataFrame, found: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links that one leader to a bucket didn't show: between components that meet in some bucket.

    Documents that hang together by such buckets form a cluster. A cluster is dealt into tiles of
    about TILE documents (fewer long ones), and every two tiles meet in a group of their own.
    """
    at = members.join(found.withColumnRenamed("node", "_key"), "_key", "left").select(
        "_band", "_key", F.coalesce("component", "_key").alias("_component")
    )
    mixed_buckets = (
        at.groupBy("_band")
        .agg(F.min("_component").alias("l"), F.max("_component").alias("h"), F.min("_key").alias("_head"))
        .where("l <> h")
        .select("_band", "_head")
    )
    left = stage(at.join(mixed_buckets, "_band"), "open")
    clusters = components(left.select(F.col("_key").alias("a"), F.col("_head").alias("b")))
    docs = left.select("_key", "_component").distinct().join(clusters.select(F.col("node").alias("_key"), F.col("component").alias("_cluster")), "_key")
    docs = stage(docs.join(texts, "_key"), "open")
    sizes = docs.groupBy("_cluster").agg(F.count("*").alias("n"), F.sum(F.length("_text")).alias("chars"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("chars") / TILE_CHARS)).cast("int")
    dealt = docs.join(sizes.select("_cluster", tiles.alias("_tiles")), "_cluster").withColumn(
        "_tile", F.pmod(F.xxhash64("_key"), F.col("_tiles")).cast("int")
    )
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).withColumns(
        {"_one": F.least("_tile", "_other"), "_two": F.greatest("_tile", "_other")}
    )
    pairs = met.groupBy("_cluster", "_one", "_two").applyInPandas(_links_between(threshold), "a string, b string")
    return stage(pairs, "links")


def groups(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, text_key (md5 of the text), class_id (smallest id of its group), kept (the row that stays).

    Groups are the connected components of pairs with J_P >= threshold. Exact copies are one node
    from the start. In each band bucket every node is first compared with one leader, the smallest;
    a bucket of near copies, however large, is settled by that. In buckets that still hold nodes of
    different components all pairs of such nodes are looked at too, block by block and without a
    row per pair. No pair of a bucket is left out, and no bucket is capped.

    Null text: as empty. A text without words is linked with nothing but its exact copies. Null
    ids come last among the ids of a group; class_id is null if all are. Rows that share an id and a text share
    their mark `kept`. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("_id"), F.md5(text).alias("_key"), text.alias("_text"))
    signed = stage(read.select("_id", "_key", _sign(bands, rows)("_text").alias("_bands")), "signed")
    nodes = stage(signed.groupBy("_key").agg(F.min("_id").alias("_low"), F.first("_bands").alias("_bands")), "nodes")

    entries = nodes.select("_key", F.explode("_bands").alias("_band"))
    buckets = entries.groupBy("_band").agg(F.min("_key").alias("_leader"), F.max("_key").alias("_other")).where("_leader <> _other")
    # staged, so that both sides of the join are plain and Spark can split a hot bucket
    members = stage(entries.join(stage(buckets.drop("_other"), "buckets"), "_band"), "members")
    wanted = members.select("_key").distinct()
    texts = stage(read.join(wanted, "_key", "left_semi").groupBy("_key").agg(F.first("_text").alias("_text")), "texts")

    tried = stage(members.where("_key <> _leader").select(F.col("_leader").alias("a"), F.col("_key").alias("b")).distinct(), "pairs")
    links = stage(_verified(tried, texts, threshold), "links")
    found = components(links)
    more = _rest(members, found, texts, threshold)
    if not more.isEmpty():
        found = components(links.unionByName(more))

    whole = nodes.select("_key", "_low").join(found.withColumnRenamed("node", "_key"), "_key", "left")
    whole = whole.withColumn("_component", F.coalesce("component", "_key"))
    best = whole.groupBy("_component").agg(F.min(F.struct(F.col("_low").isNull(), "_low", "_key")).alias("_best"))
    per_key = whole.join(best, "_component").select("_key", F.col("_best._low").alias("class_id"), F.col("_best._key").alias("_first"))
    return signed.select("_id", "_key").join(per_key, "_key").select(
        F.col("_id").alias(id_col),
        F.col("_key").alias("text_key"),
        "class_id",
        ((F.col("_key") == F.col("_first")) & F.col("_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, exactly one of each group, all columns kept."""
    kept = groups(docs, id_col=id_col, text_col=text_col, **options).where("kept")
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    chosen = kept.select(
        F.coalesce(F.col(id_col), zero).alias("_id"), F.col(id_col).isNull().alias("_null"), F.col("text_key").alias("_key")
    ).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).withColumns(
        {
            "_id": F.coalesce(F.col(f"_doc.`{id_col}`"), zero),
            "_null": F.col(f"_doc.`{id_col}`").isNull(),
            "_key": F.md5(F.coalesce(F.col(f"_doc.`{text_col}`"), F.lit(""))),
        }
    )
    on = ["_id", "_null", "_key"]
    return keyed.join(chosen, on).dropDuplicates(on).select("_doc.*")
