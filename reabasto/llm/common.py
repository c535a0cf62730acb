"""What the training-data operators share: tables cut from their lineage, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

EDGES = 200_000  # edges that one task joins


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where that is unset on one machine (tests) a temporary folder is made and set; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that they need no copy of their own."""
    context = spark.sparkContext
    if any(str(name).endswith("reabasto-tasks.zip") for name in context._python_includes):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tasks-")) / "reabasto-tasks.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, used by nobody else."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Writes a frame to the shared folder, in folders by the columns `parts`, and reads it back.

    The result has no lineage: a lost executor costs no recomputation, and a frame that is used
    twice is computed once.
    """
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def drop(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: all that was made of them is staged itself."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A staged frame and its row count, which the write itself observes."""
    seen = Observation()
    return stage(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the smallest node of each.

    Tasks of about EDGES edges first join what hangs together inside them: each node then points at the
    smallest one that its task knows. With more than one task, alternating large and small
    stars bring these together: each step is a minimum per node, summed on the map side, and a
    join, so that a node with very many neighbours is no single task's work; tasks join locally
    again after each. Nodes without an edge, null ends and loops give no row. No edges: an empty result.
    """
    now, rows = counted(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while True:
        tasks = max(1, -(-rows // EDGES))
        now, rows = counted(now.coalesce(tasks).mapInPandas(_joined, now.schema).distinct(), "edges")
        if tasks == 1 or _settled(now):
            break
        now, rows = counted(_small_star(_large_star(now)).distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one task's edges: each node and the smallest node that it hangs together with."""
    parts = list(batches)
    if not parts:
        return
    edges = pd.concat(parts)
    names, codes = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    a, b = np.split(codes, 2)
    low = np.arange(len(names))
    while True:
        new = low.copy()
        least = np.minimum(low[a], low[b])
        for end in (a, b, low[a], low[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    others = low != np.arange(len(names))
    yield pd.DataFrame({"a": names[others], "b": names[low[others]]})


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one root and no root points on."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    per_node = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per_node.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), F.least("a", "low").alias("low"))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), "low")
    moved = (
        edges.join(least, F.col("a") == F.col("k")).where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    )
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("low").alias("b")))
