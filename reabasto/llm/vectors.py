"""What the vector operators share: which vectors take part, and vectors as matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is not null, not empty, not zero and holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: pd.Series) -> np.ndarray:
    """The vectors, all of one length, as rows of norm 1 in double precision. Scaled first, so that squares don't overflow."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
