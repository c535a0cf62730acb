"""Report grids: rows of cells whose header row and column order differ per file.

A grid is a frame `archivo string, fila long, celdas array<string>`; `fila` grows
down the file and the title and header rows come first. It may also have a flag `cabecera`: headers are
then looked for among the flagged rows only. `write_grid` sets it, in folders of their own, so
that a report that is read many times is searched for its header once and its data rows are read once each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto import fixed_values as V
from reabasto.functions import text as T
from reabasto.functions.columns import any_of, is_true, map_value

# Spark numbers rows from this multiple of the task's number on.
ROWS_PER_TASK = 1 << 33


def grid_from_csv(spark: SparkSession, paths: list[str], width: int, sep: str = ",") -> DataFrame:
    """Grid of delimited files. `fila` grows down a file: in its first split it counts the rows
    of the task so far, which are fewer than a split has bytes; later splits begin at their
    byte offset, so no row needs the count of the rows before it."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.options(header=False, sep=sep).schema(schema).csv(paths)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_PER_TASK - 1))
    return raw.select(
        F.col("_metadata.file_path").alias("archivo"),
        (F.col("_metadata.file_block_start") + within).alias("fila"),
        F.array(*raw.columns).alias("celdas"),
    )


def _position(name: str) -> Column:
    """Place of a wanted header: literal text first, normalised text second, else null."""
    literal = F.array_position("_textos", F.lit(name.strip()))
    loose = F.array_position("_claves", T.label_compact(F.lit(name)))
    return F.coalesce(F.nullif(literal, F.lit(0)), F.nullif(loose, F.lit(0)))


def _searched(grid: DataFrame) -> DataFrame:
    """The rows that a header may be among."""
    return grid.filter("cabecera") if "cabecera" in grid.columns else grid


def _header_rows(
    grid: DataFrame, columns: Mapping[str, str], required: Iterable[str] | None = None
) -> DataFrame:
    """Rows that name all required columns, with the place of each wanted one."""
    wanted = list(required) if required is not None else list(columns)
    # a header has a cell that starts with no digit for each wanted name that doesn't: rows of
    # figures go before any cell is normalised
    texts = F.filter("celdas", lambda c: (F.length(F.trim(c)) > 0) & ~F.ltrim(c).rlike("^[0-9]"))
    enough = F.size(texts) >= sum(not columns[dst].strip()[:1].isdigit() for dst in wanted)
    normal = _searched(grid).filter(enough).select(
        "archivo",
        "fila",
        F.transform("celdas", lambda c: F.trim(c)).alias("_textos"),
        F.transform("celdas", lambda c: T.label_compact(c)).alias("_claves"),
    )
    placed = normal.select(
        "archivo", "fila", F.struct(*[_position(src).alias(dst) for dst, src in columns.items()]).alias("lugar")
    )
    complete = F.lit(True)
    for dst in wanted:
        complete = complete & F.col(f"lugar.`{dst}`").isNotNull()
    return placed.filter(complete)


def find_headers(
    grid: DataFrame, columns: Mapping[str, str], required: Iterable[str] | None = None
) -> DataFrame:
    """One row per file: where the header row is and the place of each wanted column."""
    return (
        _header_rows(grid, columns, required)
        .groupBy("archivo")
        .agg(F.min(F.struct("fila", "lugar")).alias("primera"))
        .select("archivo", F.col("primera.fila").alias("fila_cabecera"), "primera.lugar")
    )


def write_grid(
    grid: DataFrame, path: str, columns: Mapping[str, str] | None = None, required: Iterable[str] | None = None
) -> None:
    """Writes a grid with its flag `cabecera`: the rows that name all required columns, or, without
    `columns`, the first row of each file, as in uploads."""
    bare = grid.drop("cabecera")
    if columns is None:
        found = bare.groupBy("archivo").agg(F.min("fila").alias("fila"))
    else:
        found = find_headers(bare, columns, required).select("archivo", F.col("fila_cabecera").alias("fila"))
    heads = found.groupBy("archivo").agg(F.min("fila").alias("_cabecera"))
    flag = is_true(F.col("fila") == F.col("_cabecera"))
    marked = bare.join(heads, "archivo", "left").withColumn("cabecera", flag).drop("_cabecera")
    marked.write.partitionBy("cabecera").parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("archivo string, fila long, celdas array<string>, cabecera boolean").parquet(path)


def read_report(
    grid: DataFrame, columns: Mapping[str, str], required: Iterable[str] | None = None
) -> DataFrame:
    """Wanted columns of every file as trimmed text; rows with none of them are dropped.

    The header is the first row, at any depth, that names all required columns. It is one row
    per file, found on the map side, so the adaptive join sees how small it is. A file without one stops the read
    with its name and the columns asked for; `files_without_header` lists such files.
    """
    wanted = list(required) if required is not None else list(columns)
    headers = find_headers(grid, columns, wanted)
    names = ", ".join(sorted(columns[c] for c in wanted))
    lost = F.raise_error(
        F.concat(F.lit("no header row in "), F.col("archivo"), F.lit(f"; it needs the columns {names}"))
    )
    begins = F.coalesce(F.col("fila_cabecera"), lost.cast("long"))
    rows = grid.join(headers, "archivo", "left").filter(F.col("fila") > begins)
    values = [
        F.trim(F.get(F.col("celdas"), (F.col(f"lugar.`{dst}`") - 1).cast("int"))).alias(dst)
        for dst in columns
    ]
    return rows.select(*values).filter(any_of(F.col(f"`{c}`").isNotNull() for c in columns))


def files_without_header(
    grid: DataFrame, columns: Mapping[str, str], required: Iterable[str] | None = None
) -> DataFrame:
    return (
        grid.select("archivo")
        .distinct()
        .join(find_headers(grid, columns, required), "archivo", "left_anti")
    )


def _upload_fields(grid: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """One row per file: its first row, and the field of each cell there (null without an alias)."""
    first = _searched(grid).groupBy("archivo").agg(F.min(F.struct("fila", "celdas")).alias("primera"))
    return first.select(
        "archivo",
        F.col("primera.fila").alias("fila_cabecera"),
        F.transform("primera.celdas", lambda c: map_value(T.label_upload(c), aliases)).alias("campos"),
        F.col("primera.celdas").alias("titulos"),
    )


def _typed(value: Column, name: str) -> Column:
    if name in V.INT_FIELDS:
        return T.to_int_round(value)
    if name in V.FLOAT_FIELDS or name in ("cantidad", "stock"):
        return T.upload_number(value)
    if name in V.BOOL_FIELDS:
        return T.to_bool(value)
    return T.blank_to_null(value)


def conform_uploads(grid: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Many uploads to one typed frame, one column per known field; the first row of a file is its header.

    When two headers of a file mean the same field the one further right wins.
    """
    fields = list(dict.fromkeys(aliases.values()))
    places = _upload_fields(grid, aliases).drop("titulos")
    rows = grid.join(places, "archivo").filter(F.col("fila") > F.col("fila_cabecera"))

    def cell(name: str) -> Column:
        from_right = F.array_position(F.reverse("campos"), F.lit(name))
        place = F.when(from_right > 0, F.size("campos") - from_right)
        return F.get(F.col("celdas"), place.cast("int"))

    return rows.select("archivo", "fila", *[_typed(cell(f), f).alias(f) for f in fields])


def ignored_headers(grid: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Headers of each file that no alias knows."""
    pairs = _upload_fields(grid, aliases).select(
        "archivo", F.explode(F.arrays_zip("titulos", "campos")).alias("par")
    )
    return pairs.filter(F.col("par.campos").isNull() & (F.trim("par.titulos") != "")).select(
        "archivo", F.col("par.titulos").alias("columna")
    )
