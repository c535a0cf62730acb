"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a string of random hashes (signs of random projections, other ones in
each pass), and the vectors of a label stand in the lexicographic order of these strings. Similar vectors share
leading hashes and so stand close. A vector is compared with its neighbours in that order, up to a window's length
away, and with the rest of its run, those that share its first `shared` hashes, where a run is longer than the window.
Pairs found are verified by exact cosine and united over all passes.

Window, shared hashes and passes follow from the number of vectors of a label alone, by one rule for all sizes: the
window is a sixteenth of them, between 16 and 256; so many hashes are shared that a run of unrelated vectors is about
half a window; and there are so many passes that a pair just at the threshold shares a run in none with a chance of MISSED.

The order is cut into blocks by as many leading hashes as make about BLOCK unrelated vectors. A block can be longer, as with
thousands of near copies. It is then cut into tiles of about BLOCK rows and every two tiles meet in a group
of their own, where runs are compared; so no pair of a run is left out and no group grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reabasto.llm.common import components, stage
from reabasto.llm.vectors import unit, usable

THRESHOLD = 0.93
HASHES = 32  # in a string
SHARE, LEAST, WIDEST = 16, 16, 256  # the window is this share of a label, at least and at most so long
BLOCK = 2048
MISSED = 1e-4  # chance that a pair just at the threshold shares a run in no pass


def window_of(rows: int, widest: int = WIDEST) -> int:
    """How many neighbours on either side a vector is compared with."""
    return min(widest, max(LEAST, -(-rows // SHARE)))


def shared_of(rows: int, widest: int = WIDEST) -> int:
    """How many leading hashes a run shares, so that unrelated vectors make runs of half a window."""
    return min(HASHES, max(0, math.ceil(math.log2(max(1, rows) / window_of(rows, widest)))) + 1)


def passes_for(shared: int, threshold: float, missed: float = MISSED) -> int:
    """Passes until a pair at the threshold is missed with a chance of `missed` at most."""
    together = (1 - math.acos(threshold) / math.pi) ** shared
    return 1 if together == 1 else max(1, math.ceil(math.log(missed) / math.log1p(-together)))


def _strings(passes: int, seed: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(vectors: pd.Series) -> pd.Series:
        vectors = vectors.reset_index(drop=True)
        out: list = [None] * len(vectors)
        for size, some in vectors.groupby(vectors.map(len)):
            planes = np.random.default_rng([seed, size]).standard_normal((size, passes * HASHES))
            signs = (unit(some) @ planes > 0).reshape(len(some), passes, HASHES)
            made = signs @ (1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64))
            for at, row in zip(some.index, made, strict=True):
                out[at] = row
        return pd.Series(out, dtype=object)

    return run


def neighbours(place: np.ndarray, run: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """Of rows in order (place, and the run each is in): slices (from, to, until). Rows from:to are to be compared
    with rows from:until; every two rows up to `window` places apart, or in one run, are in some slice."""
    n = len(place)
    run_end = np.searchsorted(run, run, side="right")
    for low in range(0, n, window):
        high = min(n, low + window)
        yield low, high, max(int(run_end[high - 1]), int(np.searchsorted(place, place[high - 1] + window, side="right")))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first row that each row reaches, when what `root` says is joined by the pairs (a, b)."""
    a, b = np.concatenate([a, np.arange(len(root))]), np.concatenate([b, root])
    while True:
        new = root.copy()
        least = np.minimum(root[a], root[b])
        for end in (a, b, root[a], root[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    """Links and roots of one group: rows of a block in order, or of two tiles of a long one."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at, tiled, apart = int(key[0]), bool(part["_tiled"].iloc[0]), key[3] != key[4]
        found = []
        for _, some in part.groupby(part["_vector"].map(len)):
            runs, places = np.stack(some["_runs"].to_numpy()), np.stack(some["_places"].to_numpy())
            order = np.lexsort([places[:, at], runs[:, at]]) if tiled else np.argsort(places[:, at], kind="stable")
            some, runs, places = some.iloc[order], runs[order], places[order]
            rows, copies, tile = unit(some["_vector"]), some["_copies"].to_numpy(), some["_tile"].to_numpy()
            blocks, window = np.stack(some["_blocks"].to_numpy()), int(some["_window"].iloc[0])
            # in a tile nothing is known of places: only runs meet there
            here = np.arange(len(rows)) * (window + 1) if tiled else places[:, at]

            def met(a: np.ndarray, b: np.ndarray, e: int) -> np.ndarray:
                """Whether pass e compares the rows a with the rows b: the same answer in whichever group it is asked."""
                near = (blocks[a, e] == blocks[b, e]) & (places[a, e] >= 0) & (places[b, e] >= 0) & (np.abs(places[a, e] - places[b, e]) <= window)
                return near | (runs[a, e] == runs[b, e])

            links, root, busy = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), np.zeros(len(rows), dtype=bool)
            for low, high, until in neighbours(here, runs[:, at], window):
                a, b = np.nonzero(rows[low:high] @ rows[low:until].T >= threshold)
                a, b = a + low, b + low
                some_pairs = (a < b) & met(a, b, at)
                a, b = a[some_pairs], b[some_pairs]
                if not len(a):
                    continue
                root = _joined(root, a, b)
                busy[a] = busy[b] = True
                # a pair counts in the first pass that compares it, in the group of its own two tiles
                fresh = np.ones(len(a), dtype=bool) if not apart else tile[a] != tile[b]
                for e in range(at):
                    fresh &= ~met(a, b, e)
                np.add.at(links, a[fresh], copies[b[fresh]])
                np.add.at(links, b[fresh], copies[a[fresh]])
            node = some["_node"].to_numpy()
            if busy.any():
                found.append(pd.DataFrame({"node": node[busy], "links": links[busy], "root": node[root[busy]]}))
        return pd.concat(found) if found else pd.DataFrame({"node": [], "links": [], "root": []}).astype({"node": str, "links": "int64", "root": str})

    return run


def _leading(string: Column, hashes: Column) -> Column:
    """The first hashes of a string, as a number."""
    return F.floor(string / F.pow(F.lit(2.0), F.lit(HASHES) - hashes)).cast("long")


def _ordered(nodes: DataFrame, threshold: float, widest: int, block: int, missed: float, seed: int) -> DataFrame:
    """The nodes with, for each pass of their label, their run, block and place in the block, and how many tiles it is cut into.

    Places are known in blocks of up to 2 * block rows; in a longer one they are -1.
    """
    sizes = nodes.groupBy("_label").agg(F.count("*").alias("_rows"))
    rows = F.col("_rows")
    sizes = sizes.withColumn("_window", F.least(F.lit(widest), F.greatest(F.lit(LEAST), F.ceil(rows / SHARE))).cast("int"))
    shared = F.least(F.lit(HASHES), F.greatest(F.lit(0), F.ceil(F.log2(rows / F.col("_window")))) + 1).cast("int")
    kept = F.when(F.col("_rows") <= F.col("_window"), 1).otherwise(F.ceil(math.log(missed) / F.log1p(-F.pow(F.lit(1 - math.acos(threshold) / math.pi), F.col("_shared")))))
    lead = F.least(F.col("_shared"), F.greatest(F.lit(0), F.ceil(F.log2(rows / block)))).cast("int")  # a run lies in one block
    sizes = sizes.withColumn("_shared", shared).withColumns({"_passes": kept.cast("int"), "_lead": lead})
    sizes = stage(sizes, "labels")
    passes = sizes.agg(F.max("_passes")).first()[0] or 1
    strings = F.slice(_strings(passes, seed)("_vector"), 1, F.col("_passes"))
    stringed = nodes.join(sizes.drop("_rows"), "_label").withColumn("_strings", strings)
    stringed = stage(stringed, "strings")
    entries = stringed.select("_node", "_label", "_lead", F.posexplode("_strings").alias("_pass", "_string")).withColumn("_block", _leading(F.col("_string"), F.col("_lead")))
    group = ["_label", "_pass", "_block"]
    long_blocks = entries.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * block)
    long_blocks = stage(long_blocks.select(*group, F.ceil(F.col("_n") / block).cast("int").alias("_tiles")), "blocks")
    entries = entries.join(long_blocks, group, "left")
    order = Window.partitionBy(*group).orderBy("_string", "_node")
    placed = entries.where("_tiles is null").withColumn("_place", F.row_number().over(order).cast("int"))
    unplaced = entries.where("_tiles is not null").withColumn("_place", F.lit(-1))
    entry = F.struct("_pass", "_place", "_block", F.coalesce("_tiles", F.lit(1)).alias("_tiles"))
    of_node = placed.unionByName(unplaced).groupBy("_node").agg(F.array_sort(F.collect_list(entry)).alias("_order"))
    runs = F.transform("_strings", lambda s: _leading(s, F.col("_shared")))
    return (
        stringed.withColumn("_runs", runs)
        .join(of_node, "_node")
        .select(
            "_node", "_label", "_vector", "_copies", "_window", "_runs",
            F.col("_order._place").alias("_places"), F.col("_order._block").alias("_blocks"), F.col("_order._tiles").alias("_tiles"),
        )
    )


def link(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    widest: int = WIDEST,
    block: int = BLOCK,
    missed: float = MISSED,
    seed: int = 0,
) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable by links), kept.

    Two rows are linked if their labels are equal and not null, their vectors are equally long and
    the cosine, in double precision, is at least the threshold. Rows without a label and vectors that are null, empty,
    zero or hold a null or non-finite component link with nothing; they are their own component.
    Equal vectors of a label are one node from the start, whose copies count as links of each other.

    Groups send back one row per vector that has a link, never pairs: how many links are new there,
    and the first vector of its component inside the group. `missed` bounds the chance that a pair
    at the threshold is not found; closer pairs are missed less. Empty table: no rows. Null ids
    take part and come last among the ids of a component.
    """
    mark = F.when(usable("_vector") & F.col("_label").isNotNull(), F.md5(F.concat_ws("|", F.col("_label").cast("string"), F.col("_vector").cast("string"))))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector")).withColumn("_node", mark)
    nodes = stage(
        rows.where("_node is not null")
        .groupBy("_node")
        .agg(F.first("_label").alias("_label"), F.first("_vector").alias("_vector"), F.count("*").alias("_copies"), F.min("_id").alias("_low")),
        "nodes",
    )
    ready = stage(_ordered(nodes.drop("_low"), threshold, widest, block, missed, seed), "order")
    passed = ready.select("*", F.posexplode("_blocks").alias("_pass", "_block")).withColumn("_count", F.expr("_tiles[_pass]"))
    tiled = passed.withColumn("_tile", F.pmod(F.xxhash64("_node"), F.col("_count")).cast("int"))
    met = tiled.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_count") - 1))).withColumns(
        {"_one": F.least("_tile", "_other"), "_two": F.greatest("_tile", "_other"), "_tiled": F.col("_count") > 1}
    )
    found = stage(
        met.select("_pass", "_label", "_block", "_one", "_two", "_node", "_vector", "_copies", "_window", "_runs", "_places", "_blocks", "_tile", "_tiled")
        .groupBy("_pass", "_label", "_block", "_one", "_two")
        .applyInPandas(_compare(threshold), "node string, links long, root string"),
        "found",
    )
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    marks = nodes.select("_node", "_copies", "_low").join(links, F.col("_node") == F.col("node"), "left").drop("node")
    marks = marks.join(joined, F.col("_node") == F.col("node"), "left").withColumn("_component", F.coalesce("component", "_node"))
    lowest = marks.groupBy("_component").agg(F.min("_low").alias("_lowest"))
    marks = marks.join(lowest, "_component").select("_node", (F.coalesce("links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), "_lowest")
    alone = F.col("_node").isNull()
    return (
        rows.select("_id", "_node")
        .join(marks, "_node", "left")
        .select(
            F.col("_id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(alone, F.col("_id")).otherwise(F.col("_lowest")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
