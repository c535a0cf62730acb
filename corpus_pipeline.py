"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto.llm import minhash, mixing, packing, suffix_dedup, toxicity
from reabasto.llm.common import scratch, ship
from reabasto.llm.queries import tokenizer_path

#: Bytes of a string that `cut_repeats` takes for repeated: 99 of 100 stretches of 51 words are longer.
REPEAT_BYTES = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject.

    Its machine is trained on those of the documents that have a label, without the held-out ones.
    """
    ship(spark)
    machine = toxicity.machine_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    ship(spark)
    return minhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that occur more than once; n_chars is counted anew."""
    ship(spark)
    return suffix_dedup.removed(docs, REPEAT_BYTES).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them: not at all, once or twice."""
    ship(spark)
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the packed sequences."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_strings", cut_repeats),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned scores, similarity groups and packing have no SQL form; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
