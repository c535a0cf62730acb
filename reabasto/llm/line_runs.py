"""Line deduplication over levelled sorted runs of line hashes; built-in functions only.

Documents go in batches. A batch's lines are summed to one entry for each key (its digest): how many documents hold
it, and the largest id among them. The entries are merge-anti-joined with every run there is; what no run holds is
written as the batch's own run, so a key lies in one run only. What some run holds already, the repeats, goes to
a smaller table beside the runs. When FAN_OUT runs of a level have come together they are merged into one run of the next.

Runs are tables bucketed and sorted by key, in as many buckets as a shuffle has partitions. A run is therefore never
shuffled again: entries are, once, after they were summed on the map side.

Key of a line: the line without space, tab, line feed, vertical tab, form feed and carriage return at both ends,
A-Z in lower case. Only keys of at least SHORTEST code points count.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto.llm.common import drop, scratch, stage

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 20  # code points of a key
HOLDERS = 3  # documents that make a line a repeated one
BATCHES = 4
FAN_OUT = 3  # runs of a level that are merged


def _trimmed(line: Column) -> Column:
    """Trimming looks at the whole line, so only lines that begin or end with a blank are trimmed."""
    blank = lambda c: F.ascii(c).isin(*map(ord, BLANK))
    return F.when(blank(line) | blank(F.right(line, F.lit(1))), F.btrim(line, F.lit(BLANK))).otherwise(line)


def _lower(key: Column) -> Column:
    """A-Z in lower case. Translating is slow, so only where other letters might change too."""
    plain = F.octet_length(key) == F.char_length(key)
    return F.when(plain, F.lower(key)).when(F.lower(key) == key, key).otherwise(F.translate(key, UPPER, LOWER))


def line_keys(lines: Column, shortest: int = SHORTEST) -> Column:
    """For each line the 128-bit digest of its key in hexadecimal, null for a shorter key.

    In two steps, as an expression inside a step is worked out anew wherever it stands.
    """
    return F.transform(F.transform(lines, _trimmed), lambda key: F.when(F.char_length(key) >= shortest, F.md5(_lower(key))))


class Runs:
    """Sorted runs by level, the newest last, and the repeats."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, DataFrame]] = []
        self.repeats: list[DataFrame] = []
        self._tables: list[DataFrame] = []  # all that are there, also those of a step that failed

    def add(self, entries: DataFrame) -> None:
        """Takes the entries (key, docs, top) of a batch, each key once."""
        own = self._sorted(entries)
        fresh = own
        for _, run in self.runs:
            fresh = fresh.join(run, "key", "left_anti")
        if self.runs:
            fresh = self._sorted(fresh)
            self.repeats.append(stage(own.join(fresh, "key", "left_anti"), "repeats"))
            self._forget(own)
        self.runs.append((0, fresh))
        while len(self.runs) >= self.fan_out and len({level for level, _ in self.runs[-self.fan_out :]}) == 1:
            merged = self.runs[-self.fan_out :]
            level = merged[0][0] + 1
            self.runs[-self.fan_out :] = [(level, self._sorted(reduce(DataFrame.unionAll, [run for _, run in merged])))]
            self._forget(*[run for _, run in merged])

    def totals(self) -> DataFrame:
        """Each key with the number of documents that hold it and the largest id among them."""
        entries = reduce(DataFrame.unionAll, [run for _, run in self.runs])
        if not self.repeats:
            return entries
        again = reduce(DataFrame.unionAll, self.repeats).groupBy("key").agg(F.sum("docs").alias("_docs"), F.max("top").alias("_top"))
        return entries.join(again, "key", "left").select(
            "key", (F.col("docs") + F.coalesce("_docs", F.lit(0))).alias("docs"), F.greatest("top", "_top").alias("top")
        )

    def close(self) -> None:
        """Deletes all tables; nothing may read them any more."""
        self._forget(*self._tables)
        drop(*self.repeats)
        self.runs, self.repeats = [], []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        path, name = scratch(self.spark, "run"), f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(name)
        run = self.spark.table(name)
        run.staged_at, run.table = path, name
        self._tables.append(run)
        return run

    def _forget(self, *runs: DataFrame) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run.table}")
        drop(*runs)
        self._tables = [t for t in self._tables if all(t is not run for run in runs)]


def _cut(docs: DataFrame, id_col: str, text_col: str, shortest: int, holders: int, batches: int, fan_out: int) -> DataFrame:
    """The rows as _doc (all their columns), _lines and _drop: places of the lines to drop, null for none."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    text = F.coalesce(F.col(f"_doc.`{text_col}`"), F.lit(""))
    read = docs.select(doc).select("_doc", F.col(f"_doc.`{id_col}`").alias("_id"), text.alias("_text"))
    rows = read.withColumn("_row", F.xxhash64("_id", "_text")).withColumn("_lines", F.split("_text", "\n", -1))
    keyed = rows.select("_id", "_row", line_keys(F.col("_lines"), shortest).alias("_keys"))
    keys = stage(keyed.withColumn("_batch", F.pmod("_row", F.lit(batches))), "line_keys", "_batch")

    runs = Runs(docs.sparkSession, fan_out)
    try:
        for batch in range(batches):
            held = keys.where(F.col("_batch") == batch).select("_id", F.explode(F.array_distinct("_keys")).alias("_key"))
            held = held.where("_key is not null").select("_id", F.unhex("_key").alias("key"))
            runs.add(held.groupBy("key").agg(F.count("*").alias("docs"), F.max("_id").alias("top")))
        # staged, so that both sides of the join are plain and Spark can split a line that very many documents hold
        repeated = stage(runs.totals().where(F.col("docs") >= holders).select("key", "top"), "repeated")
    finally:
        runs.close()
    lines = keys.select("_id", "_row", F.posexplode("_keys").alias("_at", "_key")).where("_key is not null")
    lines = lines.select("_id", "_row", "_at", F.unhex("_key").alias("key"))
    gone = lines.join(repeated, "key").where(~F.col("_id").eqNullSafe(F.col("top")))
    places = gone.groupBy("_id", "_row").agg(F.collect_set("_at").alias("_drop"))
    places = stage(places, "places")
    drop(keys, repeated)

    there = places.select(F.col("_id").alias("_of"), F.col("_row").alias("_row_of"), "_drop")
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_row") == F.col("_row_of"))
    return rows.select("_doc", "_id", "_row", "_lines").join(there, same, "left").select("_doc", "_lines", "_drop")


def _kept_text() -> Column:
    """The lines that stay, by place, joined. Places are taken away as a set, so a very long text costs its length."""
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(places, lambda at: F.get("_lines", at)))
    return F.array_join(kept, "\n")


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = SHORTEST,
    holders: int = HOLDERS,
    batches: int = BATCHES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """All rows and columns, the text without repeated lines, and the columns n_lines and n_dropped.

    A key of at least `shortest` code points that at least `holders` rows hold loses all its lines, but for those of
    the rows with the largest id holding it. All other lines stay, in order. A row counts once for a key, however
    often it holds it; rows that share an id are rows of their own. A null id is smaller than any other. Null
    text: one empty line, and "" comes back. Columns of docs named n_lines or n_dropped are replaced. The number of batches
    changes nothing in the result. Empty table: no rows.
    """
    cut = _cut(docs, id_col, text_col, shortest, holders, batches, fan_out)
    added = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long")}
    own = [_kept_text().alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in added]
    return cut.select(*own, *[made.alias(name) for name, made in added.items()])
