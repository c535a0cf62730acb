"""Column filters and matching of pasted code lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reabasto.functions.columns import literal_rows
from reabasto.params import Params

# Kinds of match, best first.
KINDS = {0: "exacto", 1: "prefijo", 2: "contiene"}
GRAM = 3  # letters of an entry of the index


def split_pasted(text: str) -> list[str]:
    """Codes of a pasted text, trimmed, each once, in order."""
    parts = (p.strip() for p in re.split(r"[\n\t;,]+", text))
    return list(dict.fromkeys(p for p in parts if p))


def column_text(col: Column, params: Params) -> Column:
    """Value as the filter shows it; blanks under a label."""
    text = col.cast("string")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(params.blank_label))


def column_filter(
    rows: DataFrame,
    column: str,
    params: Params,
    contains: str | None = None,
    values: list[str] | None = None,
) -> DataFrame:
    """Rows whose shown value contains a text, or is in a list; an empty list keeps none."""
    shown = column_text(F.col(column), params)
    if contains:
        return rows.filter(F.lower(shown).contains(contains.lower()))
    return rows.filter(shown.isin(*values) if values else F.lit(False))


def distinct_values(rows: DataFrame, column: str, params: Params) -> DataFrame:
    """Shown values once each; texts in order, numbers inside them by size.

    In the order key the length of a digit run, without leading zeros, stands before it.
    """
    shown = rows.select(column_text(F.col(column), params).alias("valor")).distinct()
    runs = F.regexp_extract_all(F.lower("valor"), F.lit(r"(\d+|\D+)"), F.lit(1))

    def sized(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    keyed = F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), sized(r)).otherwise(r))
    return shown.orderBy(F.array_join(keyed, ""), "valor")


def grams_of(text: Column, sizes: Column) -> Column:
    """The distinct substrings of the given lengths; a text shorter than a length has none of it."""
    fitting = F.filter(sizes, lambda n: n <= F.length(text))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda start: F.substring(text, start, n))
    return F.array_distinct(F.flatten(F.transform(fitting, cut)))


def match_codes(rows: DataFrame, column: str, codes: list[str], params: Params, gram: int = GRAM) -> DataFrame:
    """(codigo, valor, tipo): for each code its exact matches, else those it begins, else
    those that contain it; a code without any comes back with null.

    An inverted index: a value stands under each of its distinct q-grams (codes shorter than `gram` are looked up
    by grams of their own length). A code is looked up under one of its grams only, the one that fewest values have, and
    what stands there is confirmed by the whole code; so a value meets a code once at most, however often it
    holds it, and a gram that a third of all values share is chosen only by codes that have no rarer one.
    The code list is the caller's own.
    """
    spark = rows.sparkSession
    pasted = [(c, c.lower()) for c in dict.fromkeys(codes)]
    wanted = literal_rows(spark, "codigo, clave", pasted) if pasted else spark.createDataFrame([], "codigo string, clave string")
    sizes = F.array(*[F.lit(n) for n in sorted({min(len(c.lower()), gram) for c in codes})]).cast("array<int>")
    values = rows.select(column_text(F.col(column), params).alias("valor")).distinct()
    index = values.select("valor", F.explode(grams_of(F.lower("valor"), sizes)).alias("gramo"))
    own = F.array(F.least(F.length("clave"), F.lit(gram)))
    asked = wanted.select("codigo", "clave", F.explode(grams_of(F.col("clave"), own)).alias("gramo"))
    common = index.join(asked.select("gramo").distinct(), "gramo", "left_semi").groupBy("gramo").agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(common, "gramo", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    looked_up = counted.groupBy("codigo", "clave").agg(F.min(F.struct("n", "gramo")).getField("gramo").alias("gramo"))

    text, code = F.lower("valor"), F.col("clave")
    rank = F.when(text == code, 0).when(text.startswith(code), 1).otherwise(2)
    found = index.join(looked_up, "gramo").filter(text.contains(code)).select("codigo", "valor", rank.alias("rango"))
    best = found.groupBy("codigo").agg(F.min("rango").alias("rango"))
    kind = F.when(F.col("rango") == 0, KINDS[0]).when(F.col("rango") == 1, KINDS[1])
    matched = found.join(best, ["codigo", "rango"]).select("codigo", "valor", kind.otherwise(KINDS[2]).alias("tipo"))
    unmatched = wanted.select("codigo").join(best, "codigo", "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def match_counts(matches: DataFrame) -> DataFrame:
    """Codes in all, matched exactly, widened to several, and without match."""
    per_code = matches.groupBy("codigo").agg(F.min("tipo").alias("tipo"))
    return per_code.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("tipo") == KINDS[0]).alias("exactos"),
        F.count_if(F.col("tipo").isin(KINDS[1], KINDS[2])).alias("expandidos"),
        F.count_if(F.col("tipo").isNull()).alias("sin_match"),
    )
