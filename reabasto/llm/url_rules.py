"""URL filter: host-suffix and path-prefix expressions, looked up by short hash, confirmed by digest.

A rule is a host and a path. It fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's path. Of the fitting rules the longest decides (host and path
together), then the longer host, then `block` before `allow`; without any the verdict is `allow`.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case. Path: from there
up to `?`, `#` or the end. Both are empty for null and for a URL without `://`; such a URL fits no rule.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hex digits of the short hash: four bytes


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a frame whose size the optimiser knows."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rule_shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The (host labels, path length) that occur in rules: what a URL has to be expanded to.

    One small aggregate over the rules; its result is bounded by labels times path lengths.
    """
    found = rules.select(F.size(F.split("host", r"\.", -1)), F.length("path")).where("host is not null and path is not null")
    return sorted(tuple(r) for r in found.distinct().collect())


def url_parts(url: str) -> tuple[Column, Column]:
    """Host and path of the column of that name, never null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(shapes: list[tuple[int, int]]) -> Column:
    """All expressions of a URL that a rule of these shapes could equal."""
    labels, found = F.split("host", r"\.", -1), []
    for count, length in shapes:
        suffix = F.array_join(F.slice(labels, -count, count), ".")
        fits = (F.col("host") != "") & (F.size(labels) >= count) & (F.length("path") >= length)
        found.append(F.when(fits, F.concat(suffix, F.substring("path", 1, length))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def judge(
    urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", shapes: list[tuple[int, int]] | None = None
) -> DataFrame:
    """Per row: the id, host, path, rule (host and path of the deciding one, else null), verdict.

    Equal rows are counted first, which lays the rows out by URL. Each URL then becomes at most one
    row per rule shape, met with the rules by equality of a four-byte hash prefix; the full digest
    confirms. The last aggregate needs no further shuffle where the rules are small enough for Spark
    to broadcast; a larger rule table is shuffled by the short hash, where Spark can split a hot one.
    Repeated rows come back as often as they came in, a null id too. No rules: all is allowed.
    """
    shapes = rule_shapes(rules) if shapes is None else shapes
    digest = F.sha2(F.concat("host", "path"), 256)
    listed = rules.where("host is not null and path is not null").select(
        F.substring(digest, 1, SHORT).alias("r_short"),
        digest.alias("r_digest"),
        F.concat("host", "path").alias("r_rule"),
        F.length("host").alias("r_host"),
        F.col("verdict").alias("r_verdict"),
    )
    key = ["_id", "_url", "copies"]
    counted = urls.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).groupBy("_id", "_url").agg(F.count("*").alias("copies"))
    host, path = url_parts("_url")
    probes = counted.withColumns({"host": host, "path": path}).select("*", F.explode_outer(_expressions(shapes)).alias("expression"))
    probes = probes.withColumn("digest", F.sha2("expression", 256))
    met = probes.join(listed, F.substring("digest", 1, SHORT) == F.col("r_short"), "left")
    rank = F.struct(
        F.length("r_rule").alias("length"),
        F.col("r_host").alias("host"),
        (F.col("r_verdict") == "block").alias("block"),
        F.col("r_rule").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = met.groupBy(*key, "host", "path").agg(F.max(F.when(F.col("digest") == F.col("r_digest"), rank)).alias("best"))
    return best.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
