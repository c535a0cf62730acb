"""Comparison of a computed table with a frozen or official one, and fixture samples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _equal(left: Column, right: Column, tolerance: float | None) -> Column:
    """Numbers within the tolerance with blank as 0; texts equal or both missing."""
    if tolerance is None:
        return left.eqNullSafe(right)
    a, b = left.try_cast("double"), right.try_cast("double")
    return F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) <= tolerance


def _paired(
    engine: DataFrame, golden: DataFrame, keys: Mapping[str, str], pairs: Mapping[str, str], how: str
) -> DataFrame:
    """Keys and compared columns of both tables side by side as structs `m` and `g`; `keys` and
    `pairs` map engine to golden names. No other column goes through the join."""

    def side(frame: DataFrame, names: Mapping[str, str], mark: str, others: Iterable[str]) -> DataFrame:
        kept = dict.fromkeys([*names, *others])
        return frame.select(
            *[F.col(f"`{n}`").alias(f"k{i}{mark}") for i, n in enumerate(names)],
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias(mark),
        )

    m = side(engine, dict.fromkeys(keys), "m", pairs)
    g = side(golden, dict.fromkeys(keys.values()), "g", pairs.values())
    match = F.lit(True)
    for i in range(len(keys)):
        match = match & F.col(f"k{i}g").eqNullSafe(F.col(f"k{i}m"))
    return g.join(m, match, how)


def parity_mismatch(
    engine: DataFrame,
    golden: DataFrame,
    keys: Mapping[str, str],
    pairs: Mapping[str, str],
    tolerance: float | None = None,
) -> DataFrame:
    """Golden rows where some compared column differs; `pairs` maps engine to golden names."""
    same = F.lit(True)
    for mine, theirs in pairs.items():
        same = same & _equal(F.col(f"m.`{mine}`"), F.col(f"g.`{theirs}`"), tolerance)
    joined = _paired(engine, golden, keys, pairs, "left").filter(~same)
    return joined.select(
        *[F.col(f"g.`{k}`").alias(k) for k in keys.values()],
        *[F.col(f"m.`{mine}`").alias(f"motor_{mine}") for mine in pairs],
        *[F.col(f"g.`{theirs}`").alias(f"golden_{theirs}") for theirs in pairs.values()],
    )


def shadow_compare(
    engine: DataFrame,
    official: DataFrame,
    keys: Mapping[str, str],
    value: Mapping[str, str],
    tolerance: float,
) -> DataFrame:
    """Rows of both tables with `estado`: igual, distinta, solo_motor or solo_oficial."""
    (mine, theirs), *_ = value.items()
    a, b = F.col(f"m.`{mine}`"), F.col(f"g.`{theirs}`")
    state = (
        F.when(F.col("g").isNull(), "solo_motor")
        .when(F.col("m").isNull(), "solo_oficial")
        .when(_equal(a, b, tolerance), "igual")
        .otherwise("distinta")
    )
    zero = F.lit(0.0)
    gap = F.abs(
        F.coalesce(a.try_cast("double"), zero) - F.coalesce(b.try_cast("double"), zero)
    )
    return _paired(engine, official, keys, value, "full").select(
        *[
            F.coalesce(F.col(f"g.`{theirs_key}`"), F.col(f"m.`{mine_key}`")).alias(theirs_key)
            for mine_key, theirs_key in keys.items()
        ],
        a.alias("motor"),
        b.alias("oficial"),
        gap.alias("diferencia"),
        state.alias("estado"),
    )


def shadow_summary(compared: DataFrame) -> DataFrame:
    """Shares and counts of a comparison; parity is the share of common rows that agree."""
    state = F.col("estado")
    return compared.agg(
        F.count_if(state.isin("igual", "distinta")).alias("comunes"),
        F.count_if(state == "solo_motor").alias("solo_motor"),
        F.count_if(state == "solo_oficial").alias("solo_oficial"),
        (
            F.try_divide(
                F.count_if(state == "igual") * 100.0, F.count_if(state.isin("igual", "distinta"))
            )
        ).alias("paridad_pct"),
    )


def worst_rows(compared: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    return (
        compared.filter(F.col("estado") == "distinta")
        .orderBy(F.col("diferencia").desc(), *keys)
        .limit(n)
    )


def fixture_subset(
    rows: DataFrame,
    product: str,
    conditions: Mapping[str, tuple[Column, int]],
    mapping: DataFrame,
) -> DataFrame:
    """Products that cover every condition: the first `n` by code of each, with the members
    of their replacement groups. `conditions` maps a name to (predicate, n)."""
    tags = F.array_compact(
        F.array(*[F.when(test, F.lit(name)) for name, (test, _) in conditions.items()])
    )
    tagged = rows.select(F.col(product).alias("Producto"), F.explode(tags).alias("condicion")).filter(
        F.col("Producto").isNotNull()
    )
    quota = F.create_map(
        *[part for name, (_, n) in conditions.items() for part in (F.lit(name), F.lit(n))]
    )
    place = F.row_number().over(Window.partitionBy("condicion").orderBy("Producto"))
    # The plain bound lets Spark cut each task to the largest quota before the shuffle.
    most = max(n for _, n in conditions.values())
    picked = (
        tagged.distinct()
        .withColumn("puesto", place)
        .filter(F.col("puesto") <= most)
        .filter(F.col("puesto") <= F.try_element_at(quota, F.col("condicion")))
        .select("Producto")
        .distinct()
    )
    heads = picked.select(F.col("Producto").alias("Producto_Master"))
    members = mapping.join(heads, "Producto_Master", "left_semi").select("Producto")
    return picked.union(members).distinct()
