"""Mixing sources to target weights: subset-sum budgets over exact document lengths.

Each source gets a target number of words. Whole passes over the source come first; what then
remains of the target is a subset-sum problem over the source's documents. It is solved on counts
of documents by exact length, never on documents: a proportional share of each length, then whole
lengths while the rest is large, then a bounded-knapsack dynamic program that hits the rest
exactly or as nearly from below as any choice can. Which documents of a length are taken is
decided by a seeded hash, so that reruns agree on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.llm.common import counted, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2  # passes over one document
DP_BUDGET = 16_384  # words that the dynamic program covers; what is left beyond goes by whole lengths
SLICES, SLICE_ROWS = 256, 1 << 16  # slices of a length's documents by seeded hash: at least so many, and so many rows together, so that no length is one task's work


def targets(totals: dict, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict:
    """Target per source: `share` of all words by weight, none above `most` times its own words.

    Sources stand in code point order, null last, and the weights repeat along them. What a full
    source can't take is shared again among the others by weight, until none is above its limit.
    """
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    rest, found, free = Fraction(share) * sum(totals.values()), {}, list(order)
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * totals[s]]
        if not full:
            return found | {s: unit * weight[s] for s in free}
        for s in full:
            found[s] = Fraction(most * totals[s])
            rest -= found[s]
        free = [s for s in free if s not in found]
    return found


def fit(sizes: Sequence[int], counts: Sequence[int], budget: int, dp_budget: int = DP_BUDGET) -> list[int]:
    """How many documents of each size to take so that their words come as near the budget as can be, not above.

    sizes: distinct, positive. The work grows with the number of distinct sizes, not of documents.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        if rest <= dp_budget:
            break
        more = min(counts[i] - taken[i], (rest - dp_budget) // sizes[i])
        taken[i] += more
        rest -= more * sizes[i]
    for i in order:  # no length small enough for a whole step: still come below the program's width
        if rest <= dp_budget:
            break
        if sizes[i] <= rest and taken[i] < counts[i]:
            taken[i] += 1
            rest -= sizes[i]
    for i, more in _knapsack([(i, sizes[i], counts[i] - taken[i]) for i in order], rest).items():
        taken[i] += more
    return taken


def _knapsack(items: list[tuple[int, int, int]], budget: int) -> dict[int, int]:
    """Bounded knapsack on (key, size, count): reachable sums as the bits of one integer, one step per power of two."""
    mask, steps = (1 << (budget + 1)) - 1, []
    reach = 1
    for key, size, count in items:
        left, part = min(count, budget // size), 1
        while left and not reach >> budget & 1:
            part_now = min(part, left)
            steps.append((key, part_now, part_now * size, reach))
            reach |= reach << (part_now * size) & mask
            left -= part_now
            part *= 2
        if reach >> budget & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for key, number, weight, before in reversed(steps):
        if not before >> at & 1:
            found[key] = found.get(key, 0) + number
            at -= weight
    return found


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: id, size (words), source_size, target (of its source), taken (0 or a multiple of size, at most `most` times).

    One scan counts words; the texts themselves are never moved. Only one number per source reaches
    the driver. Lengths are counted per source on the map side; the plan of a source is made from
    its counts, bounded by its distinct lengths. Documents of one length are sliced by seeded hash, into the more
    counts the more rows there are; whole slices are in or out, and only the rows of the one slice that the
    limit falls into are ordered.
    Null text: size 0, taken 0. Null source: a source of its own, the last. Rows that share an id, a
    size and a source are alike; the mix takes the right number of them. Empty table: no rows.
    """
    taken = _taken(docs, id_col=id_col, **options)
    return taken.select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def _taken(
    docs: DataFrame,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    most: int = MOST,
) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))  # null-safe equality by plain join
    text = F.xxhash64(text_col)
    order = F.xxhash64(F.lit(seed), F.col(id_col), text)
    read = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), key.alias("_source"), word_count(text_col).alias("size"), order.alias("_order")
    )
    rows, number = counted(read, "sizes")
    rows = rows.withColumn("_slice", F.pmod("_order", F.lit(max(SLICES, number // SLICE_ROWS))).cast("int"))
    slices = rows.groupBy("_source", "size", "_slice").agg(F.count("*").alias("n"))
    lengths = slices.groupBy("_source", "size").agg(F.sum("n").alias("n"))
    totals = {r[0]: int(r[1] or 0) for r in lengths.groupBy("_source").agg(F.sum(F.col("size") * F.col("n"))).collect()}
    named = {None if s == "n" else s[1:]: t for s, t in totals.items()}
    aims = {("n" if s is None else "s" + s): t for s, t in targets(named, weights, share, most).items()}

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        source = part["_source"].iloc[0]
        part = part.sort_values("size")
        words, aim = totals[source], aims[source]
        passes = int(aim // words) if words else 0
        some = part["size"] > 0
        chosen = pd.Series(0, index=part.index)
        if words:
            chosen[some] = fit(part["size"][some].tolist(), part["n"][some].tolist(), int(aim - passes * words))
        return pd.DataFrame(
            {"_source": source, "size": part["size"], "chosen": chosen, "passes": passes, "source_size": words, "target": float(aim)}
        )

    plans = lengths.groupBy("_source").applyInPandas(
        plan, "_source string, size long, chosen long, passes long, source_size long, target double"
    )
    before = F.sum("n").over(Window.partitionBy("_source", "size").orderBy("_slice")) - F.col("n")
    cut = (
        slices.withColumn("before", before)
        .join(plans, ["_source", "size"])
        .select("_source", "size", "_slice", "n", "passes", "source_size", "target", (F.col("chosen") - F.col("before")).alias("open"))
    )
    cut = stage(cut, "slices")  # whole slices and the one cut in two read it, each for its rows
    on, whole = ["_source", "size", "_slice"], (F.col("open") <= 0) | (F.col("open") >= F.col("n"))
    place = F.row_number().over(Window.partitionBy(*on).orderBy("_order", "_id", "_text"))
    taken = rows.join(cut.where(whole), on).withColumn("more", (F.col("open") > 0).cast("long"))
    split = rows.join(cut.where(~whole), on).withColumn("place", place).withColumn("more", (F.col("place") <= F.col("open")).cast("long"))
    columns = ["_id", "_text", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken")]
    return taken.select(*columns).unionByName(split.select(*columns))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them: none, one or more copies of a row, all columns kept.

    Rows are found again by id and a hash of the text; rows that share both are told apart by number.
    """
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    on = ["_known", "_null", "_text", "_nth"]

    def numbered(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_known": F.coalesce("_id", zero), "_null": F.col("_id").isNull()})
        return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(on[:3]).orderBy("_known")))

    copies = numbered(_taken(docs, id_col=id_col, text_col=text_col, **options)).select(
        *on, (F.col("taken") / F.greatest("size", F.lit(1))).cast("int").alias("_copies")
    )
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).withColumns(
        {"_id": F.col(f"_doc.`{id_col}`"), "_text": F.xxhash64(f"_doc.`{text_col}`")}
    )
    found = numbered(keyed).join(copies.where("_copies > 0"), on)
    return found.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
