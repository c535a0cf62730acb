"""Publishing: staged write, shrink guard, one manifest for all tables of a publication.

Every attempt writes to a folder of its own, `data/<attempt>/<table>`. Its manifest names the tables it
replaces, each with its version, row count and attempt, and is written last, beside the data. One rename
puts it to `publications/<number>`, the next free number: from then on, and for all its tables at
once, it counts. A reader takes of each table the entry with the highest publication number, so it never
sees a part of a version, nor new suggestions with old dimensions. A failed attempt leaves the
published tables as they were, and its own files are read by nobody.

Two publishers of different tables take numbers one after the other. One that comes too late with a version of
a table that another has published meanwhile gives way.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from reabasto.functions.columns import side_by_side
from reabasto.operators.dims import dim_branch_from_upload, dim_product_from_upload
from reabasto.params import Params
from reabasto.sources.files import make_folder, move_to_new, path_exists

MANIFEST = "tabla string, version long, filas long, intento string"
SUGGESTION, PRODUCTS, BRANCHES = "sugerido", "dim_producto", "dim_sucursal"
NUMBER = r"/publications/(\d+)/[^/]*$"


class ShrinkError(ValueError):
    """The new snapshot is suspiciously smaller than the current one."""


class VersionTakenError(RuntimeError):
    """Another publisher has published this version of the table meanwhile."""


def publications(spark: SparkSession, base: str) -> DataFrame:
    """All entries of all publications: publicacion, tabla, version, filas, intento."""
    if not path_exists(spark, f"{base}/publications/1"):
        return spark.createDataFrame([], f"publicacion long, {MANIFEST}")
    listed = spark.read.schema(MANIFEST).json(f"{base}/publications/*")
    return listed.withColumn("publicacion", F.regexp_extract("_metadata.file_path", NUMBER, 1).cast("long"))


def _newest(spark: SparkSession, base: str) -> dict[str, Row]:
    """The entry that counts of each table: as many rows as there are tables."""
    entry = F.struct("publicacion", "version", "filas", "intento")
    found = publications(spark, base).groupBy("tabla").agg(F.max(entry).alias("e")).select("tabla", "e.*")
    return {r["tabla"]: r for r in found.collect()}


def current_version(spark: SparkSession, base: str, table: str = SUGGESTION) -> tuple[int, int]:
    """Number and row count of the newest published version of a table, (0, 0) before the first."""
    newest = _newest(spark, base).get(table)
    return (newest["version"], newest["filas"]) if newest else (0, 0)


def read_published(spark: SparkSession, base: str, *tables: str) -> dict[str, DataFrame]:
    """Several tables as one moment shows them: no publication lies between them."""
    newest = _newest(spark, base)
    if missing := [t for t in tables if t not in newest]:
        raise FileNotFoundError(f"{', '.join(missing)} not published in {base}")
    return {t: spark.read.parquet(f"{base}/data/{newest[t]['intento']}/{t}") for t in tables}


def read_current(spark: SparkSession, base: str, table: str) -> DataFrame:
    return read_published(spark, base, table)[table]


def _commit(spark: SparkSession, base: str, attempt: str, entries: dict[str, tuple[int, int]]) -> int:
    """Makes written tables, each with (version, rows), the current ones, all of them or none; the publication's number.

    Refuses when a version is there already.
    """
    written = f"{base}/data/{attempt}/_manifest"
    rows = [(table, version, count, attempt) for table, (version, count) in entries.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(written)
    make_folder(spark, f"{base}/publications")
    while True:
        newest = _newest(spark, base)
        for table, (version, _) in entries.items():
            if table in newest and newest[table]["version"] >= version:
                raise VersionTakenError(f"version {version} of {table} is published already")
        number = 1 + max((r["publicacion"] for r in newest.values()), default=0)
        if move_to_new(spark, written, f"{base}/publications/{number}"):
            return number


def _write(rows: DataFrame, base: str, table: str, attempt: str) -> DataFrame:
    path = f"{base}/data/{attempt}/{table}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _filled(keys: tuple[str, ...]):
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(k), F.lit("")) != "" for k in keys])


def valid_rows(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with every key filled."""
    return rows.filter(_filled(keys))


def load_counts(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    filled = _filled(keys)
    return rows.agg(F.count_if(filled).alias("cargadas"), F.count_if(~filled).alias("omitidas"))


def publish_snapshot(rows: DataFrame, base: str, params: Params | None = None, order: str | None = None) -> int:
    """Suggestion table and its two dimensions as their next versions; gives the row count.

    The rows are written once, counted from the written files, and switched to only when
    they are not far fewer than the current ones. The three tables change together, in one
    publication; the current versions stay on any failure.
    `order` names the column of the upload order; without one (or the column `fila`) rows
    follow product and branch, as the calculation has no order of its own.
    """
    params = params or Params()
    for column in ("producto", "sucursal_id"):
        if column not in rows.columns:
            raise ValueError(f"column {column} is missing")
    order = order or ("fila" if "fila" in rows.columns else None)
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    version, previous = current_version(spark, base)
    numbers = {t: current_version(spark, base, t)[0] + 1 for t in (PRODUCTS, BRANCHES)}
    written = _write(valid_rows(rows, ("producto", "sucursal_id")), base, SUGGESTION, attempt)
    count = written.count()
    if previous and count < int(previous * params.min_rows_ratio):
        raise ShrinkError(f"{count} rows against {previous} published; the published ones stay")
    placed = written if order else written.withColumn("_orden", F.struct("producto", "sucursal_id"))
    products = _write(dim_product_from_upload(placed, order or "_orden"), base, PRODUCTS, attempt)
    branches = _write(dim_branch_from_upload(placed, order or "_orden"), base, BRANCHES, attempt)
    entries = {SUGGESTION: (version + 1, count)}
    entries |= {t: (numbers[t], made.count()) for t, made in ((PRODUCTS, products), (BRANCHES, branches))}
    _commit(spark, base, attempt, entries)
    return count


def replace_tables(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], base: str) -> dict[str, int]:
    """Serving tables, each with its keys, replaced as a whole and all together; rows lacking a key are dropped.

    Gives their row counts. Other tables keep their versions, and all do when one of these can't be written.
    """
    attempt, entries = uuid.uuid4().hex, {}
    spark = next(iter(tables.values()))[0].sparkSession
    for table, (rows, keys) in tables.items():
        version, _ = current_version(spark, base, table)
        entries[table] = (version + 1, _write(valid_rows(rows, keys), base, table, attempt).count())
    _commit(spark, base, attempt, entries)
    return {table: count for table, (_, count) in entries.items()}


def replace_table(rows: DataFrame, base: str, table: str, keys: tuple[str, ...]) -> int:
    """Any serving table replaced as a whole; rows lacking a key are dropped. Other tables keep their versions."""
    return replace_tables({table: (rows, keys)}, base)[table]


def monthly_sales_rows(rows: DataFrame) -> DataFrame:
    kept = valid_rows(rows, ("producto", "sucursal_id", "mes"))
    return kept.select("producto", "sucursal_id", "mes", F.col("cantidad").cast("double").alias("cantidad"))


def stock_rows(rows: DataFrame) -> DataFrame:
    """Stock upload; a missing quantity counts as 0."""
    kept = valid_rows(rows, ("producto",))
    return kept.withColumn("stock", F.coalesce(F.col("stock").cast("double"), F.lit(0.0)))


def load_warnings(rows: DataFrame, params: Params) -> DataFrame:
    """Skipped rows, products with an improbable quantity, suggested rows without supplier."""
    filled = _filled(("producto", "sucursal_id"))
    total = F.coalesce("total_sugerido_suc", F.lit(0.0))
    wanted = filled & (total > 0)
    nameless = F.coalesce("proveedor", F.lit("")) == ""
    counted = rows.agg(
        F.count_if(~filled).alias("filas_omitidas"),
        F.count_if(wanted).alias("con_sugerido"),
        F.count_if(wanted & nameless).alias("sin_proveedor"),
    )
    share = F.bround(F.try_divide(F.col("sin_proveedor") * 100.0, F.col("con_sugerido")), 0)
    return counted.withColumn("sin_proveedor_pct", share)


def anomalous_products(rows: DataFrame, params: Params, n: int = 10) -> DataFrame:
    """First `n` codes, in order, with more units suggested than is plausible."""
    return (
        rows.filter(F.col("total_sugerido_suc") > params.anomaly_units)
        .select("producto")
        .distinct()
        .orderBy("producto")
        .limit(n)
    )


def received_check(received: DataFrame, loaded: DataFrame, source_limit: int = 100_000) -> DataFrame:
    """Rows handed over against rows loaded, and whether the source limit was reached."""
    counts = side_by_side({"recibidas": received, "cargadas": loaded})
    return counts.withColumns(
        {
            "difiere": F.col("recibidas") != F.col("cargadas"),
            "en_limite": F.col("recibidas") >= source_limit,
        }
    )
