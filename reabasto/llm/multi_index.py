"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: a learned rotation (iterative quantization: alternate between the signs of
the rotated vectors and the rotation that fits them best), repeated from other starts until a code
has enough bits. A code is cut into substrings of eight bits and each substring position has its own
index from value to rows. A code within Hamming radius r = m*a + b of a query's, over m
substrings, agrees to within a bits in one of the first b + 1 or within a - 1 in one of the others
(pigeonhole); probing these values retrieves every such code. The retrieved are checked by
whole code and reranked by cosine on the original vectors.

The radius is learned too: wide enough to hold `quantile` of the true neighbours in the sample, whose
neighbours are farther than those in the whole table.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.llm.vectors import unit, usable

BITS = 256
SAMPLE = 4096  # vectors that rotations and radius are learned from, at most
QUANTILE = 0.98
ROUNDS = 15
BLOCK = 16_384  # vectors to an index block
QUERIES = 8192  # queries that meet it together: each vector is sent once for so many
CHUNK = 64  # of them that are looked up at a time
VALUES = np.arange(256, dtype=np.uint8)


class Coder:
    """Codes for vectors of one length."""

    def __init__(self, size: int, sample: np.ndarray, neighbours: int, bits: int = BITS, quantile: float = QUANTILE, seed: int = 0):
        rng = np.random.default_rng([seed, size])
        self.centre = sample.mean(axis=0) if len(sample) > size else np.zeros(size)
        self.rotations = []
        centred = sample - self.centre
        for _ in range(max(1, -(-bits // size))):
            turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
            for _ in range(ROUNDS if len(sample) > size else 0):
                left, _, right = np.linalg.svd(np.where(centred @ turn > 0, 1.0, -1.0).T @ centred)
                turn = (left @ right).T
            self.rotations.append(turn)
        self.bytes = -(-size * len(self.rotations) // 64) * 8
        self.radius = 8 * self.bytes
        if len(sample) > neighbours + 1:
            asked = sample[: min(512, len(sample))]
            near = asked @ sample.T
            near[np.arange(len(asked)), np.arange(len(asked))] = -2
            best = np.argpartition(-near, neighbours - 1, axis=1)[:, :neighbours]
            codes = self.codes(sample)
            apart = _distance(codes[: len(asked), None, :], codes[best])
            self.radius = int(np.quantile(apart, quantile, method="higher"))

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """Codes as bytes: one byte is one substring."""
        bits = np.concatenate([(rows - self.centre) @ turn > 0 for turn in self.rotations], axis=1)
        packed = np.packbits(bits, axis=1)
        return np.pad(packed, ((0, 0), (0, self.bytes - packed.shape[1])))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


class Index:
    """Per substring position, the rows of each value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=256))]) for c in codes.T]

    def retrieve(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) of all rows within the radius, by pigeonhole probing, queries that probe a value together."""
        width = codes.shape[1]
        most, rest = divmod(radius, width)
        hit = np.zeros((len(codes), len(self.codes)), dtype=bool)
        for at in range(width):
            reach = most if at <= rest else most - 1
            if reach < 0:
                continue
            apart = np.bitwise_count(codes[:, at][:, None] ^ VALUES)
            for value in np.flatnonzero(np.diff(self.starts[at])):
                asks = np.flatnonzero(apart[:, value] <= reach)
                rows = self.order[self.starts[at][value] : self.starts[at][value + 1], at]
                hit[asks[:, None], rows] = True
        q, r = np.nonzero(hit)
        near = _distance(codes[q], self.codes[r]) <= radius
        return q[near], r[near]


def _found(index: Index, codes: np.ndarray, rows: np.ndarray, queries: np.ndarray, radius: int, neighbours: int) -> tuple[np.ndarray, ...]:
    """Pairs (query, row) that the index retrieves, and their cosines; at least one more than asked for each, if there are so many."""
    q, r = index.retrieve(codes, radius)
    # one more than asked for: a query may find itself
    few = np.flatnonzero(np.bincount(q, minlength=len(codes)) <= neighbours)
    if len(few):  # the radius grows for them until enough rows are inside
        apart = _distance(codes[few][:, None, :], index.codes[None, :, :])
        wide = np.sort(apart, axis=1)[:, min(neighbours, len(rows) - 1)]
        more_q, more_r = np.nonzero(apart <= wide[:, None])
        old = ~np.isin(q, few)
        q, r = np.concatenate([q[old], few[more_q]]), np.concatenate([r[old], more_r])
    return q, r, np.einsum("ij,ij->i", queries[q], rows[r])


def _search(coders: dict[int, Coder], neighbours: int, seed: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size, all_asked in queries.groupby(queries["_vector"].map(len)):
            there = rows[rows["_vector"].map(len) == size]
            if not len(there):
                continue
            coder = coders.get(size) or Coder(size, np.zeros((0, size)), neighbours, seed=seed)
            t_rows = unit(there["_vector"])
            index, ids, places = Index(coder.codes(t_rows)), there["_id"].to_numpy(), there["_row"].to_numpy()
            for at in range(0, len(all_asked), CHUNK):
                asked = all_asked.iloc[at : at + CHUNK]
                q_rows = unit(asked["_vector"])
                q, r, score = _found(index, coder.codes(q_rows), t_rows, q_rows, coder.radius, neighbours)
                pairs = pd.DataFrame({"query_id": asked["_id"].to_numpy()[q], "vec_id": ids[r], "score": score})
                pairs = pairs[asked["_row"].to_numpy()[q] != places[r]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                found.append(pairs.groupby("query_id").head(neighbours))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return run


def nearest(
    vectors: DataFrame,
    queries: Column,
    neighbours: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bits: int = BITS,
    sample: int = SAMPLE,
    quantile: float = QUANTILE,
    block: int = BLOCK,
    seed: int = 0,
) -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score (cosine in double precision on the vectors given).

    `queries` says which rows ask; every other row is a candidate, of equally long vectors only. Rows
    with a null id and vectors that are null, empty, zero or hold a null or non-finite component take no part. Ties go to
    the smaller id. Rows that share an id are candidates of their own, but not for each other. Empty
    table: no rows.

    Every row is indexed, in blocks of about `block` by a hash; blocks of QUERIES queries meet blocks of rows,
    so a task holds two blocks whatever the table. A block sends its best for each query on.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_vector"), queries.alias("_asks"))
    rows = rows.where(usable("_vector") & F.col("_id").isNotNull()).withColumn("_row", F.col("_id"))
    n, asks = rows.agg(F.count("*"), F.count_if("_asks")).first()
    blocks, groups = max(1, -(-n // block)), max(1, -(-asks // QUERIES))
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(sample).select("_vector").collect()
    by_size: dict[int, list] = {}
    for (v,) in drawn:
        by_size.setdefault(len(v), []).append(v)
    coders = {size: Coder(size, unit(pd.Series(some)), neighbours, bits, quantile, seed) for size, some in by_size.items()}

    spread = lambda by, number: F.pmod(F.xxhash64(F.lit(by), "_id", "_vector"), F.lit(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    there = rows.drop("_asks").withColumn("_block", spread("rows", blocks)).withColumn("_group", every(groups))
    asked = rows.where("_asks").drop("_asks").withColumn("_group", spread("queries", groups)).withColumn("_block", every(blocks))
    found = (
        asked.groupBy("_block", "_group")
        .cogroup(there.groupBy("_block", "_group"))
        .applyInPandas(_search(coders, neighbours, seed), "query_id long, vec_id long, score double")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
