"""File sources and sinks: engine inputs, delimited uploads, catalogue files, exports."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reabasto import schemas as S


@dataclass(frozen=True)
class Sources:
    """Inputs of one engine run. The lead-time tables may be given ready or computed.

    `tracking` may be None where `tracking_transit` holds all orders, `stock_border` where `stock`
    holds both companies.
    """

    sales: DataFrame
    mapping: DataFrame
    dim_product: DataFrame
    dim_branch: DataFrame
    tracking: DataFrame | None
    tracking_transit: DataFrame
    imported: DataFrame
    stock: DataFrame
    stock_border: DataFrame | None
    tracking_lead_time: DataFrame | None = None
    lt_supplier: DataFrame | None = None
    lt_supplier_branch: DataFrame | None = None
    catalogue: DataFrame | None = None
    cost: DataFrame | None = None


# File of each input and its schema.
REQUIRED_FILES = {
    "sales": ("ventas_12m.csv", S.SALES),
    "mapping": ("mapeo_master.csv", S.MAPPING),
    "dim_product": ("dim_producto.csv", S.DIM_PRODUCT),
    "dim_branch": ("dim_sucursal.csv", S.DIM_BRANCH),
    "tracking": ("seguimiento.csv", S.TRACKING),
    "tracking_transit": ("seguimiento_transito.csv", S.TRACKING_TRANSIT),
    "lt_supplier": ("lt_proveedor.csv", S.LEAD_TIME_SUPPLIER),
    "lt_supplier_branch": ("lt_proveedor_sucursal.csv", S.LEAD_TIME_SUPPLIER_BRANCH),
    "imported": ("importados.csv", S.IMPORTED),
    "stock": ("stock_bodegas.csv", S.STOCK),
    "stock_border": ("stock_frontera.csv", S.STOCK),
}
OPTIONAL_FILES = {
    "catalogue": ("dim_producto_catalogo.csv", S.CATALOGUE),
    "cost": ("stock_costo.csv", S.COST),
    "tracking_lead_time": ("seguimiento_lt.csv", S.TRACKING_LEAD_TIME),
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that owns the path, so shared folders work too."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def make_folder(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop_path)


def move_to_new(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder in one step; False, and nothing done, where the target is there already."""
    fs = spark._jvm.org.apache.hadoop.fs
    rename = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = fs.FileContext.getFileContext(fs.Path(source).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(context.makeQualified(fs.Path(source)), context.makeQualified(fs.Path(target)), options)
    except Py4JJavaError:
        if path_exists(spark, target):
            return False
        raise
    return True


def read_csv(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    """Headed CSV with a fixed schema; columns are matched by header name, not by place.

    Files that `write_csv` wrote from texts with line breaks need `multiLine=True`, which reads a
    file in one task; all others are split.
    """
    wanted = spark.createDataFrame([], schema).schema
    settings = {"header": True, "multiLine": False, "quote": '"', "escape": '"', **options}
    text = spark.read.options(**settings).csv(path)
    return text.select(
        *[F.col(f"`{c.name}`").try_cast(c.dataType).alias(c.name) for c in wanted.fields]
    )


def load_sources(spark: SparkSession, folder: str) -> Sources:
    """The eleven required inputs and the three optional ones of a folder."""
    frames = {
        key: read_csv(spark, f"{folder}/{name}", schema)
        for key, (name, schema) in REQUIRED_FILES.items()
    }
    for key, (name, schema) in OPTIONAL_FILES.items():
        if path_exists(spark, f"{folder}/{name}"):
            frames[key] = read_csv(spark, f"{folder}/{name}", schema)
    return Sources(**frames)


def read_master_list(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon, latin-1, stray quotes kept as text; code trimmed."""
    raw = (
        spark.read.option("header", True)
        .option("sep", ";")
        .option("encoding", "ISO-8859-1")
        .option("quote", "")
        .csv(path)
    )
    missing = {"Producto", "Categoria"} - set(raw.columns)
    if missing:
        raise ValueError(f"master list {path} lacks {sorted(missing)}; found {raw.columns[:12]}")
    optional = [c for c in ("Glosa", "Unidad", "Familia") if c in raw.columns]
    return raw.select(F.trim("Producto").alias("Producto"), "Categoria", *optional)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Semicolon when the header line has more of them than commas."""
    header = spark.read.text(path).first()
    line = header[0] if header else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_upload(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """All-text frame of one delimited upload, byte-order mark removed from the header. A file whose
    fields hold line breaks can't be split; only such a one is read whole by a task."""
    raw = spark.read.options(
        header=True, sep=sniff_delimiter(spark, path), quote='"', escape='"', multiLine=line_breaks
    ).csv(path)
    return raw.toDF(*[c.lstrip("﻿") for c in raw.columns])


def read_extract(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """Rows handed over by the BI extract, JSON lines or CSV."""
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).json(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Table or query of an external database; the caller supplies the driver jar.

    With a partition column the read is split into range predicates run in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    if bounds is None:
        raise ValueError("a partitioned read needs bounds")
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", partition_column)
        .option("lowerBound", bounds[0])
        .option("upperBound", bounds[1])
        .option("numPartitions", partitions)
        .load()
    )


def write_csv(df: DataFrame, path: str, **options: object) -> None:
    """Quoted UTF-8 CSV with a header; quotes inside a field are doubled."""
    settings = {"header": True, "quote": '"', "escape": '"', **options}
    df.write.mode("overwrite").options(**settings).csv(path)
