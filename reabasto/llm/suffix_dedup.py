"""Removal of repeated byte strings by distributed prefix doubling.

Asked: every byte covered by a string of `length` bytes that also starts anywhere else. A suffix
array of the corpus would answer it, cut off at `length`. It is built by doubling: positions are
ranked by their first bytes, then pairs (rank here, rank `offset` further on) are sorted and
ranked again, at growing offsets, until a position is unique or its rank covers `length` bytes.

Before that, positions whose answer is plain are set aside, losing none:

* Each string of `length` bytes is represented by the least hash among its parts of length/2 bytes and
  where the first such part begins; equal strings have the same. Neighbouring starts share it, so a
  text falls into runs of starts, about one in a hundred bytes. A hash that occurs in one run only:
  nothing of that run repeats. Runs with equal hash and content: all of both repeats.
* Other runs are cut into cells of CELL starts, counted from the represented part. All strings of a cell
  share a core: a core that occurs once means that none of them repeats. Cells with equal core and
  content: all of both repeats.
* What is left, cells with equal core and different content, one of each, is doubled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reabasto.llm.common import drop, stage

LENGTH = 400
CHUNK = 1 << 19  # bytes that are hashed together
SLICE = 1 << 23  # bytes of one text that are hashed together
CELL = 16  # starts that are judged together where runs differ
PLACE = 24  # bits of a position inside a range
RANGES = 20  # bits of a range inside a task
G1, G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash from two, in order."""
    x = a * G1
    x += b
    x ^= x >> np.uint64(29)
    x *= G2
    x ^= x >> np.uint64(32)
    return x


def part_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of all parts of each size (at least 8, rising): built from halves, eight bytes to begin with."""
    n = len(data)
    data = np.ascontiguousarray(data)
    level = np.ndarray((max(0, n - 7),), dtype="<u8", buffer=data, strides=(1,)) if n >= 8 else np.zeros(0, dtype=np.uint64)
    level = _join(level, np.full(1, 7, dtype=np.uint64))
    width, found = 8, []
    for size in sizes:
        while 2 * width <= size:
            level = _join(level[: max(0, len(level) - width)], level[width:])
            width *= 2
        over = size - width
        found.append(level if not over else _join(level[: max(0, len(level) - over)], level[over:]))
    return found


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each `width` neighbours, from block-wise running ones."""
    op, pad = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, pad, dtype=np.uint64)
    full[: len(values)] = values
    full = full.reshape(blocks, width)
    ahead = op.accumulate(full, axis=1).ravel()
    back = op.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    make = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, dtype=np.uint64)]), dtype=np.uint64)
    return make(BASE), make(INVERSE)


class Contents:
    """Hashes of any stretch of some bytes: a polynomial over the hashes of the eight bytes at each place."""

    def __init__(self, eights: np.ndarray):
        up, self.down = _powers(1 << max(16, int(len(eights)).bit_length()))
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(eights * up[: len(eights)], dtype=np.uint64)])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """begin, end (excluded) of stretches of at least eight bytes."""
        stop = end - 7
        return _join((self.total[stop] - self.total[begin]) * self.down[begin], (stop - begin).astype(np.uint64))


def runs_of(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share their least hash and its first place, in texts data[starts:ends].

    Returns arrays (text, first start, last start, place of the least part, least hash, content hash),
    places counted from the beginning of the text.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    part = length // 2
    width = length - part + 1
    text = np.flatnonzero(ends - starts >= length)
    if not len(text):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    eights, parts = part_hashes(raw, 8, part)
    least = _sliding(parts, width, True)
    counts = ends[text] - starts[text] - length + 1
    whose = np.repeat(text, counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[whose]
    value = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (whose[1:] != whose[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    whose, value, begin, end = whose[head], value[head], at[head], at[tail]
    # parts that are the least of some string, and those at the edges of the data
    edge = min(width - 1, len(parts))
    far = max(edge, len(parts) - width + 1)
    inner = np.flatnonzero(parts[edge:far] == _sliding(least, width, False)) if far > edge else np.zeros(0, dtype=np.int64)
    seen = np.concatenate([np.arange(edge), inner + edge, np.arange(far, len(parts))])
    low, high = np.searchsorted(seen, begin), np.searchsorted(seen, end + width - 1, side="right")
    number = high - low
    run = np.repeat(np.arange(len(begin)), number)
    place = seen[np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low, number)]
    own = parts[place] == value[run]
    run, place = run[own], place[own]
    # a run ends where its part does: the strings from there on have the next one as their first
    fresh = np.ones(len(run), dtype=bool)
    fresh[1:] = run[1:] != run[:-1]
    first = np.where(fresh, begin[run], np.append(0, place[:-1]) + 1)
    last = np.minimum(place, end[run])
    some = first <= last
    run, place, first, last = run[some], place[some], first[some], last[some]
    content = Contents(eights)(first, last + length)
    base = starts[whose[run]]
    return whose[run], first - base, last - base, place - base, value[run].view(np.int64), content.view(np.int64)


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to about CHUNK bytes, long ones in overlapping slices: data, starts, ends, text numbers, slice offsets."""
    parts, size = [], 0

    def joined():
        sizes = np.array([len(p) for p, _, _ in parts])
        ends = np.cumsum(sizes)
        return b"".join(p for p, _, _ in parts), ends - sizes, ends, np.array([i for _, i, _ in parts]), np.array([o for _, _, o in parts])

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SLICE):
            some = text[at : at + SLICE + length - 1] if len(text) > SLICE else text
            if len(some) < length:
                continue
            if parts and size + len(some) > CHUNK:
                yield joined()
                parts, size = [], 0
            parts.append((some, i, at))
            size += len(some)
    if parts:
        yield joined()


RUN = "_key long, _size int, first int, last int, place int, least long, content long"
SPAN = "_key long, _size int, first int, last int"


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _runs(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sizes = batch["_key"].to_numpy(), batch["_size"].to_numpy()
            texts = [_bytes(t) for t in batch["_text"]]
            for data, starts, ends, number, offset in _chunks(texts, length):
                whose, first, last, place, least, content = runs_of(data, starts, ends, length)
                text, shift = number[whose], offset[whose]
                yield pd.DataFrame(
                    {
                        "_key": keys[text],
                        "_size": sizes[text],
                        "first": first + shift,
                        "last": last + shift,
                        "place": place + shift,
                        "least": least,
                        "content": content,
                    }
                )

    return run


def _cells(length: int):
    """Cells of the open runs of a text: spans of starts, hash of their core, hash of their content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, size, text, spans in zip(batch["_key"], batch["_size"], batch["_text"], batch["_spans"], strict=True):
                data = np.frombuffer(_bytes(text), dtype=np.uint8)
                for group in _near([(s["first"], s["last"], s["place"]) for s in spans], length):
                    from_, until = group[0][0], max(g[1] for g in group) + length
                    table = np.array(group, dtype=np.int64) - from_
                    content = Contents(part_hashes(data[from_:until], 8)[0])
                    lead, trail = (table[:, 2] - table[:, 1]) // CELL, (table[:, 2] - table[:, 0]) // CELL
                    number = trail - lead + 1
                    row = np.repeat(np.arange(len(table)), number)
                    cell = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(lead, number)
                    begin, end, place = table[row].T
                    first = np.maximum(begin, place - cell * CELL - CELL + 1)
                    last = np.minimum(end, place - cell * CELL)
                    core = content(place - cell * CELL, place - cell * CELL - CELL + 1 + length)
                    yield pd.DataFrame(
                        {
                            "_key": key,
                            "_size": size,
                            "first": first + from_,
                            "last": last + from_,
                            "least": _join(core, cell.astype(np.uint64)).view(np.int64),
                            "content": content(first, last + length).view(np.int64),
                        }
                    )

    return _gathered(run)


def _near(spans: list[tuple], length: int) -> Iterator[list[tuple]]:
    """Spans in order, in groups that lie close and fit into a slice."""
    group: list[tuple] = []
    for span in sorted(spans):
        if group and (span[0] - group[-1][1] > length or span[1] - group[0][0] > SLICE):
            yield group
            group = []
        group.append(span)
    if group:
        yield group


def _gathered(run):
    """The frames of `run`, united to about CHUNK rows."""

    def wider(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for part in run(batches):
            parts.append(part)
            size += len(part)
            if size > CHUNK // 8 or len(parts) > 2000:
                yield pd.concat(parts)
                parts, size = [], 0
        if parts:
            yield pd.concat(parts)

    return wider


def _offsets(length: int) -> list[int]:
    """Offsets of the doubling, from ranks of length/4 bytes twice on."""
    covered, found = 2 * (length // 4), []
    while covered < length:
        found.append(min(covered, length - covered))
        covered += found[-1]
    return found


def _positions(length: int):
    """Of the open cells of a text, the positions whose ranks are needed and the names of the two parts there.

    Names are hashes of length/4 bytes. Positions are numbered by range (a slice of a text) and place; a range's first
    row tells whose it is.
    """
    begin = length // 4
    needed = np.zeros(1, dtype=np.int64)
    for offset in _offsets(length):
        needed = np.union1d(needed, needed + offset)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << RANGES
        for batch in batches:
            for key, size, text, spans in zip(batch["_key"], batch["_size"], batch["_text"], batch["_spans"], strict=True):
                data = np.frombuffer(_bytes(text), dtype=np.uint8)
                for group in _near([(s["first"], s["last"]) for s in spans], SLICE):
                    from_, until = group[0][0], max(g[1] for g in group) + length
                    names = part_hashes(data[from_:until], begin)[0].view(np.int64)
                    starts = np.concatenate([np.arange(a, b + 1) for a, b in group]) - from_
                    at = np.unique((starts[:, None] + needed).ravel())
                    head = np.full(len(at), None, dtype=object)
                    head[0] = key
                    yield pd.DataFrame(
                        {"_key": head, "_size": size, "start": from_, "at": (number << PLACE) + at, "left": names[at], "right": names[at + begin]}
                    )
                    number += 1

    return _gathered(run)


def merged(spans, gap: int = 0) -> list[tuple[int, int]]:
    """Spans (first, last), both included, united where they overlap or lie up to `gap` apart."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(s) for s in out]


def _reranked(pairs: DataFrame) -> DataFrame:
    """Positions (at, left, right) ranked by their pair: (at, rank), without those whose pair is unique.

    Equal pairs get the same rank, the first position that has them; which of two different strings
    comes first doesn't matter here. Pairs are counted on the map side, so one that
    very many positions share is no single task's work.
    """
    # staged, so that both sides of the join are plain and Spark can split a hot pair
    shared = stage(pairs.groupBy("left", "right").agg(F.min("at").alias("rank"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "names")
    return pairs.join(shared, ["left", "right"]).select("at", "rank")


def _islands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of successive positions in a sorted stream."""
    for batch in batches:
        at = batch["at"].to_numpy()
        if len(at):
            cut = np.flatnonzero(np.diff(at) != 1) + 1
            yield pd.DataFrame({"low": at[np.append(0, cut)], "high": at[np.append(cut, len(at)) - 1]})


def _alike(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of spans with two hashes: those whose content occurs again, and, where contents differ, one span of each content."""
    place = F.struct(*[c for c in spans.columns if c not in ("least", "content")])
    classes = spans.groupBy("least", "content").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    classes = stage(classes, "classes")
    again = spans.join(classes.where("n > 1").select("least", "content"), ["least", "content"])
    several = classes.groupBy("least").agg(F.count("*").alias("contents")).where("contents > 1")
    return again.select("_key", "_size", "first", "last"), classes.join(several, "least").select("one.*")


def _by_text(spans: DataFrame) -> DataFrame:
    """Spans gathered per text; a text has no more of them than bytes."""
    others = [c for c in spans.columns if c not in ("_key", "_size")]
    return spans.groupBy("_key", "_size").agg(F.collect_list(F.struct(*others)).alias("_spans"))


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per text (_key, _size): spans, a list of (first, last) starts of strings that also start elsewhere.

    texts: _key, _size, _text (not null); the first two tell different texts apart. Texts without repeats give no row.
    Everything is counted on the map side before it is shuffled and hot values meet in joins that Spark can split.
    """
    if length < 64:
        raise ValueError("strings of at least 64 bytes are asked for")
    on = ["_key", "_size"]
    runs = stage(texts.mapInPandas(_runs(length), RUN), "runs")
    # staged, so that both sides of the join are plain and Spark can split a hot hash
    common = stage(runs.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least"), "common")
    shared = stage(runs.join(common, "least"), "shared")
    drop(runs, common)
    whole, opened = _alike(shared)
    one_text = texts.groupBy(*on).agg(F.first("_text").alias("_text"))
    open_texts = stage(one_text.join(_by_text(opened), on), "texts")
    cells = stage(open_texts.mapInPandas(_cells(length), SPAN + ", least long, content long"), "cells")
    whole_cells, opened = _alike(cells)
    left = open_texts.drop("_spans").join(_by_text(opened), on)
    schema = "_key long, _size int, start int, at long, left long, right long"
    pairs = stage(left.mapInPandas(_positions(length), schema), "pairs")
    drop(open_texts)
    ranges = pairs.where("_key is not null").select(F.shiftright("at", PLACE).alias("_range"), "_key", "_size", "start")
    ranked = _reranked(pairs.select("at", "left", "right"))
    for offset in _offsets(length):
        ranked = stage(ranked, "ranks")
        later = ranked.select((F.col("at") - offset).alias("at"), F.col("rank").alias("right"))
        ranked = _reranked(stage(ranked.withColumnRenamed("rank", "left").join(later, "at"), "pairs"))
    range_of = F.shiftright("at", PLACE)
    found = ranked.select("at").repartition(range_of).sortWithinPartitions("at").mapInPandas(_islands, "low long, high long")
    first = (F.col("start") + F.col("low").bitwiseAND((1 << PLACE) - 1)).cast("int")
    back = (
        found.withColumn("_range", F.shiftright("low", PLACE))
        .join(ranges, "_range")
        .select(*on, first.alias("first"), (first + F.col("high") - F.col("low")).cast("int").alias("last"))
    )
    spans = whole.unionByName(whole_cells).unionByName(back).distinct()
    return spans.groupBy(*on).agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def cut(text: str, spans, length: int) -> tuple[bytes, int, int, int]:
    """What is left of a text without its repeated strings: bytes, bytes before, bytes removed, maximal removed runs."""
    data = _bytes(text)
    gone = merged([(s["first"], s["last"] + length - 1) for s in spans], 1)
    kept, at = [], 0
    for first, last in gone:
        kept.append(data[at:first])
        at = last + 1
    left = b"".join([*kept, data[at:]])
    return left, len(data), len(data) - len(left), len(gone)


def _with_spans(docs: DataFrame, length: int, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"_doc.`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).withColumn("_text", text)
    rows = rows.withColumns({"_key": F.xxhash64("_text"), "_size": F.octet_length("_text")})
    spans = repeats(rows.select("_key", "_size", "_text"), length)
    return rows.join(spans, ["_key", "_size"], "left")


def measure(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay.

    Strings are judged on the input: where two overlap or both copies of one stand, all of them go.
    Null text: empty. Rows with the same text remove each other whole from `length` bytes on. Empty
    table: no rows.
    """
    kind = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    @F.pandas_udf(kind)
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            made = [cut(t, s, length) for t, s in zip(texts, spans, strict=True)]
            yield pd.DataFrame(
                [(n, gone, runs, hashlib.sha256(left).hexdigest()) for left, n, gone, runs in made], columns=[f.name for f in kind]
            )

    rows = _with_spans(docs.select(id_col, text_col), length, text_col)
    plain = F.struct(
        F.octet_length("_text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("_text", 256).alias("kept_sha256"),
    )
    empty = F.array().cast("array<struct<first:int,last:int>>")
    # only texts with spans need the function to look at them
    marked = judged(F.when(F.col("spans").isNotNull(), F.col("_text")).otherwise(F.lit("")), F.coalesce("spans", empty))
    out = rows.withColumn("_judged", marked).withColumn("_out", F.when(F.col("spans").isNull(), plain).otherwise(F.col("_judged")))
    return out.select(F.col(f"_doc.`{id_col}`").alias(id_col), "_out.*")


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their repeated strings taken out of the text, all columns and rows kept. Split characters are dropped."""

    @F.pandas_udf(T.StringType())
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([cut(t, s, length)[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)

    rows = _with_spans(docs, length, text_col)
    empty = F.array().cast("array<struct<first:int,last:int>>")
    rows = rows.withColumn("_rest", rest(F.when(F.col("spans").isNotNull(), F.col("_text")).otherwise(F.lit("")), F.coalesce("spans", empty)))
    left = F.when(F.col("spans").isNull(), F.col(f"_doc.`{text_col}`")).otherwise(F.col("_rest"))

    def shown(name: str) -> Column:
        return left if name == text_col else F.col(f"_doc.`{name}`")

    return rows.select(*[shown(c).alias(c) for c in docs.columns])
