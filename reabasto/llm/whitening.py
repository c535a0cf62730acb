"""Whitening of vectors by the polarisation covariance.

Entries become whole numbers, x = floor(256 * c), and each distinct x counts once: the fit list. Over it
the variance of every dimension and of every sum of two dimensions is taken, from squares of centred values
only. No product of two dimensions is formed: the variances give every covariance,
cov(a, b) = (var(a + b) - var(a) - var(b)) / 2. The matrix goes to the driver (its size is that of a vector, squared,
whatever the table) and is decomposed there; vectors are projected on its first components.

All sums are exact. Values are centred at the whole part of their mean before they are squared, which keeps them
small; with n rows, sums S, u = x - S // n and r = S mod n, the sum of (n*x - S)^2 is n*n*sum(u*u) - n*r*r.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reabasto.llm.common import stage

SCALE = 256
KEPT = 4  # components that rows are projected on
WIDEST = 2**53  # whole numbers below it are exact as doubles
EXACT = T.DecimalType(38, 0)


class Model:
    """Covariance and components of the fit list of vectors of one length."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int]):
        """squares[i, j]: sum of the squares of u_i + u_j, of u_i alone where i = j."""
        self.n, self.sums = n, sums
        left = [s % n for s in sums]
        size = len(sums)
        own = [n * n * squares[i, i] - n * left[i] ** 2 for i in range(size)]  # n**3 times the variances
        covariance = np.empty((size, size))
        for i in range(size):
            covariance[i, i] = own[i] / n**3
            for j in range(i + 1, size):
                both = n * n * squares[i, j] - n * (left[i] + left[j]) ** 2
                covariance[i, j] = covariance[j, i] = (both - own[i] - own[j]) / (2 * n**3)
        self.covariance, self.trace = covariance, sum(own) / n**3
        values, axes = np.linalg.eigh(covariance)
        self.values, self.axes = values[::-1], axes[:, ::-1]
        self.flat = self.values <= size * np.finfo(float).eps * max(self.values[0], 0)  # no variance there
        self.identity_error: float | None = None

    def explained(self, kept: int) -> list[float | None]:
        return [float(v / self.trace) if self.trace else None for v in self.values[:kept]]

    def project(self, x: np.ndarray, kept: int) -> tuple[list[int], np.ndarray]:
        """Exact sums of (n*x - S)^2, and the whitened values; NaN on a component without variance."""
        top = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        whole = object if (2 * top) ** 2 * x.shape[1] >= 2**63 else np.int64
        centred = x.astype(whole) * self.n - np.array(self.sums, dtype=whole)
        scale = np.where(self.flat, np.nan, np.sqrt(np.where(self.flat, 1, self.values)))[:kept]
        return (centred * centred).sum(axis=1).tolist(), (centred / self.n).astype(float) @ self.axes[:, :kept] / scale


def square_sums(values: np.ndarray) -> list[int]:
    """The exact sum of squares of each column."""
    top = int(np.abs(values).max(initial=0))
    if top * top * len(values) >= 2**63:
        values = values.astype(object)
    return (values * values).sum(axis=0).tolist()


def _by_length(x: pd.Series) -> Iterator[tuple[pd.Index, np.ndarray]]:
    for _, some in x.groupby(x.map(len)):
        yield some.index, np.stack(some.to_numpy())


def _squares(centres: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for _, x in _by_length(batch["_x"]):
                size = x.shape[1]
                u = x - centres[size]
                for i in range(size):
                    own_and_sums = np.concatenate([u[:, i : i + 1], u[:, i + 1 :] + u[:, i : i + 1]], axis=1)
                    for j, total in enumerate(square_sums(own_and_sums), i):
                        totals[size, i, j] = totals.get((size, i, j), 0) + total
        if totals:
            made = pd.DataFrame(list(totals), columns=["size", "one", "two"])
            yield made.assign(total=[Decimal(t) for t in totals.values()])

    return run


def whole_numbers(vector: str, scale: int = SCALE) -> Column:
    """The entries as whole numbers; an entry too large to be exact stops the job."""

    def whole(c: Column) -> Column:
        scaled = c.cast("double") * scale
        return F.when(F.abs(scaled) < WIDEST, F.floor(scaled)).otherwise(F.raise_error(F.lit("vector entry too large")).cast("long"))

    return F.transform(vector, whole)


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (_id, _x) of the vectors that are not null and hold finite numbers only."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(F.col("_vector").isNotNull() & F.forall("_vector", finite)).select("_id", whole_numbers("_vector", scale).alias("_x"))


def fit(distinct: DataFrame) -> dict[int, Model]:
    """A model for each length of vector in `distinct` (rows _x, each once), without its measured error.

    What reaches the driver is a number per dimension and per pair of dimensions, summed by Spark.
    """
    entries = distinct.select(F.size("_x").alias("size"), F.posexplode("_x").alias("at", "x"))
    per_dimension = entries.groupBy("size", "at").agg(F.sum(F.col("x").cast(EXACT)).alias("total"), F.count("*").alias("n"))
    sums: dict[int, dict[int, int]] = {}
    rows = {}
    for size, at, total, n in per_dimension.collect():
        sums.setdefault(size, {})[at], rows[size] = int(total), n
    centres = {size: np.array([some[i] // rows[size] for i in range(size)], dtype=np.int64) for size, some in sums.items()}
    parts = distinct.where(F.size("_x") > 0).mapInPandas(_squares(centres), "size int, one int, two int, total decimal(38,0)")
    squares: dict[int, dict[tuple[int, int], int]] = {}
    for size, one, two, total in parts.groupBy("size", "one", "two").agg(F.sum("total").cast(EXACT)).collect():
        squares.setdefault(size, {})[one, two] = int(total)
    return {size: Model(rows[size], [some[i] for i in range(size)], squares[size]) for size, some in sums.items()}


def _projected(models: dict[int, Model], kept: int) -> Callable:
    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def run(x: pd.Series) -> pd.DataFrame:
        x = x.reset_index(drop=True)
        deviation, whitened = np.empty(len(x), dtype=object), np.empty(len(x), dtype=object)
        for index, some in _by_length(x):
            if some.shape[1]:
                squares, made = models[some.shape[1]].project(some, kept)
                for at, square, row in zip(index, squares, made, strict=True):
                    deviation[at], whitened[at] = Decimal(square), row
        return pd.DataFrame({"deviation": deviation, "whitened": whitened})

    return run


def _measure(distinct: DataFrame, models: dict[int, Model], kept: int) -> None:
    """Each model's largest absolute entry of whitened's covariance minus the identity, over the fit list."""
    made = distinct.where(F.size("_x") > 0).select(F.size("_x").alias("size"), _projected(models, kept)("_x").alias("p"))
    made = made.select("size", *[F.get("p.whitened", F.lit(i)).alias(f"w{i}") for i in range(kept)])
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    for row in made.groupBy("size").agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).collect():
        model = models[row[0]]
        live = [i < len(model.values) and not model.flat[i] for i in range(kept)]
        errors = [abs(v - (i == j)) for (i, j), v in zip(pairs, row[1:], strict=True) if live[i] and live[j]]
        model.identity_error = max(errors, default=None)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", kept: int = KEPT, scale: int = SCALE) -> DataFrame:
    """Per remaining row and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry are left out. Those of each length are fitted for
    themselves; fewer dimensions than `kept` give fewer components, an empty vector none and so no row. n: distinct
    x vectors. deviation: exact sum of (n*x - S)^2, decimal(38,0). whitened: projection of x - S/n over the root of the
    component's eigenvalue; null on a component without variance (all of them if n is 1). explained: eigenvalue over
    trace, null if that is 0. identity_error: measured on the fit list over components that have variance, null if
    none has. Repeated rows and null ids come back as they came in. Empty table: no rows.
    """
    rows = usable_rows(vectors, id_col, vector_col, scale)
    distinct = stage(rows.select("_x").distinct(), "fit_list")
    models = fit(distinct)
    _measure(distinct, models, kept)
    made = rows.where(F.size("_x") > 0).withColumn("_made", _projected(models, kept)("_x"))
    made = made.select("_id", F.size("_x").alias("_size"), F.col("_made.deviation").alias("deviation"), F.posexplode("_made.whitened").alias("_at", "_w"))

    def of_model(value: Callable, kind: str) -> Column:
        """A constant of the model of the row's length; there are as many as lengths of vectors."""
        known = [F.when(F.col("_size") == size, F.lit(value(m)).cast(kind)) for size, m in models.items()]
        return F.coalesce(*known, F.lit(None).cast(kind))

    return made.select(
        F.col("_id").alias(id_col),
        (F.col("_at") + 1).alias("component"),
        of_model(lambda m: m.n, "long").alias("n"),
        "deviation",
        F.when(~F.isnan("_w"), F.col("_w")).alias("whitened"),
        F.get(of_model(lambda m: F.array(*[F.lit(e).cast("double") for e in m.explained(kept)]), "array<double>"), F.col("_at")).alias("explained"),
        of_model(lambda m: m.identity_error, "double").alias("identity_error"),
    )
