"""Phrase collocations from a weighted de Bruijn graph of words.

A text is cut into pieces at punctuation and line ends, a piece into words. Nodes of the graph are phrases of four
words; a phrase of LONGEST = 5 words is an edge from its first four to its last four, weighted by how often it occurs.
Only edges are gathered from the texts, and at the end of a piece the shorter phrases that no edge starts from. All
other counts come from the graph: a node occurs as often as its edges out weigh, plus its occurrences at piece ends; the
same again for three, two and one words.

A node all of whose flow runs through one longer phrase is a unary stretch of the graph: it is compacted into that
phrase, so that a phrase which only ever occurs inside a longer one isn't reported on its own.

Counts below `least` are of no use, and a phrase can't occur more often than two neighbours of it. So pairs of
neighbours are counted first, by hash, and the graph isn't drawn across a pair that is rarer: its first word
is then treated like the end of a piece. That loses no phrase of `least` or more and changes no count of one. The
pairs that stay are told to all tasks as bits, one for each leading part of a hash, at most 32 MB of them however many pairs there
are; pairs that share a bit with one that stays only make the graph larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.llm.common import counted, drop, stage
from reabasto.llm.minhash import GOLDEN, mixed

LONGEST = 5  # words of an edge
LEAST = 100
FIRST = 2000  # phrases reported per language
SCALE = 1000
UNKNOWN = "und"
SPARSE, MOST_BITS = 16, 28  # bits to a pair that stays; as a power of two, bits at most: 32 MB
PAGE = 15  # bits of a place within a page of them
CHUNK = 1_000_000  # bytes of text that are taken apart together; a longer text is taken whole
#: Punctuation and line ends become line feeds, a tab a space; words are divided by these two only.
DIVIDE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
BREAK = -1
EXACT = "decimal(17,0)"  # a product of two of these and SCALE has 38 digits


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts in order as codes, BREAK between pieces, and the word of each code."""
    data = b"\n".join(texts).lower().translate(DIVIDE).replace(b"\n", b" \n ")
    found = pa.array(data.split(b" "), pa.binary()).dictionary_encode()
    codes, words = found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
    meaning = np.arange(len(words))
    for i, word in enumerate(words):
        if word in (b"", b"\n"):
            meaning[i] = BREAK - (word == b"")
    codes = meaning[codes]
    return codes[codes >= BREAK], words


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Texts of one language at a time, about CHUNK bytes together."""
    for batch in batches:
        for lang, texts in batch.groupby("_lang")["_text"]:
            part, size = [], 0
            for text in texts:
                part.append(text.encode("utf-8", "surrogatepass"))
                size += len(part[-1])
                if size >= CHUNK:
                    yield lang, *word_codes(part)
                    part, size = [], 0
            if part:
                yield lang, *word_codes(part)


def _pair_hashes(lang: str, codes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a place and the next are neighbours in a piece, and a hash of each such two words and the language."""
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], dtype=np.uint64)
    linked = (codes[:-1] > BREAK) & (codes[1:] > BREAK)
    return linked, mixed(hashes[codes[:-1][linked]] * GOLDEN + hashes[codes[1:][linked]])


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for lang, codes, words in _chunks(batches):
        pair, n = np.unique(_pair_hashes(lang, codes, words)[1], return_counts=True)
        yield pd.DataFrame({"pair": pair.view(np.int64), "n": n})


def reaches(linked: np.ndarray, longest: int) -> np.ndarray:
    """For each place how many words the phrase has that starts there: up to `longest`, as far as places are linked."""
    reach, alive = np.ones(len(linked) + 1, dtype=np.int64), np.append(linked, False)
    for _ in range(longest - 1):
        reach += alive
        alive = alive & np.append(alive[1:], False)
    return reach


def _page(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << PAGE, dtype=np.uint8)
    bits[part["place"].to_numpy() & ((1 << PAGE) - 1)] = 1
    return pd.DataFrame({"page": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def bits_of(hashes: DataFrame, power: int) -> np.ndarray:
    """A bit for each value of the leading `power` bits (PAGE at least), set where some hash has it."""
    places = hashes.select(F.shiftrightunsigned("pair", 64 - power).alias("place"))
    made = np.zeros(1 << (power - 3), dtype=np.uint8)
    for page, bits in places.groupBy(F.shiftright("place", PAGE)).applyInPandas(_page, "page long, bits binary").collect():
        at = page << (PAGE - 3)
        made[at : at + (1 << (PAGE - 3))] = np.frombuffer(bits, dtype=np.uint8)
    return made


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = hashes >> np.uint64(64 - 3 - (len(bits).bit_length() - 1))
    return (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _edges(frequent: Broadcast, longest: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, codes, words in _chunks(batches):
            if not len(codes):
                continue
            linked, pair = _pair_hashes(lang, codes, words)
            linked[linked] = has_bit(frequent.value, pair)
            reach = reaches(linked, longest)
            reach[codes == BREAK] = 0
            alone = np.bincount(codes[reach == 1], minlength=len(words))
            seen = np.flatnonzero(alone)
            names, sizes, counts = [words[c] for c in seen], [np.ones(len(seen), dtype=np.int64)], [alone[seen]]
            for size in range(2, longest + 1):
                places = np.flatnonzero(reach == size)
                if len(places):
                    grams = pd.DataFrame(codes[places[:, None] + np.arange(size)]).value_counts(sort=False)
                    names += [b" ".join([words[c] for c in gram]) for gram in grams.index]
                    sizes.append(np.full(len(grams), size))
                    counts.append(grams.to_numpy())
            if names:
                phrase = [name.decode("utf-8", "surrogatepass") for name in names]
                yield pd.DataFrame({"lang": [lang] * len(phrase), "phrase": phrase, "size": np.concatenate(sizes), "n": np.concatenate(counts)})

    return run


def graph(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, most_bits: int = MOST_BITS) -> DataFrame:
    """Edges and piece ends of the texts (_lang, _text): lang, phrase, size (words), n."""
    often = texts.mapInPandas(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    hashes, found = counted(often.select("pair"), "pairs")
    power = min(most_bits, max(PAGE, (SPARSE * found).bit_length()))
    frequent = texts.sparkSession.sparkContext.broadcast(bits_of(hashes, power))
    drop(hashes)
    drawn = texts.mapInPandas(_edges(frequent, longest), "lang string, phrase string, size int, n long")
    return stage(drawn.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")), "edges")


def _words(count: Column | int) -> Column:
    """The first `count` words of the phrase, or the last ones of it if negative."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.lit(count))


def flows(edges: DataFrame, longest: int = LONGEST) -> list[DataFrame]:
    """Counts of the phrases of one word, two words, ... as (lang, phrase, size, n): what flows out of a node, and piece ends."""
    found = [edges.where(F.col("size") == longest)]
    for size in range(longest - 1, 0, -1):
        out = found[0].select("lang", _words(size).alias("phrase"), "n")
        ends = edges.where(F.col("size") == size).select("lang", "phrase", "n")
        summed = out.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        found.insert(0, stage(summed.select("lang", "phrase", F.lit(size).alias("size"), "n"), "flows"))
    return found


def _compacted(counts: DataFrame) -> DataFrame:
    """The phrases that one longer phrase carries all the flow of: lang, phrase. A longer one by one word is enough to look at."""
    parts = F.array(_words(F.col("size") - 1), _words(1 - F.col("size")))
    inside = counts.where("size > 2").select(F.col("lang").alias("_lang"), F.explode(parts).alias("_phrase"), F.col("n").alias("_n"))
    carried = inside.groupBy("_lang", "_phrase").agg(F.max("_n").alias("_n"))
    same = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (F.col("n") == F.col("_n"))
    return counts.join(carried, same, "left_semi").select("lang", "phrase")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    first: int | None = FIRST,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """Phrases of 2 to `longest` words that occur `least` times or more: lang, rank, phrase, a, l, r, n, score.

    a: occurrences of the phrase, overlaps included; l and r: of its parts at the cut that scores lowest (ties: the shortest first
    part); n: all words of the language; score: floor(1000 * a * n / (l * r)), exact. Phrases that lie inside a longer one
    occurring as often are left out. Rank by score, then a, both falling, then phrase in byte order; `first` of each language, None for all.

    Words are divided by spaces and tabs, pieces by `.,;:!?`, line feed, vertical tab, form feed and carriage return; A-Z in lower
    case. `most_bits` bounds what is told to all tasks and changes nothing in the result. Null text: empty. Null language: `und`, together with that name. Every row counts, repeated ones too. Empty
    table: no rows. `least` must be 1 or more.
    """
    texts = docs.select(F.coalesce(lang_col, F.lit(UNKNOWN)).alias("_lang"), F.coalesce(text_col, F.lit("")).alias("_text"))
    levels = flows(graph(texts, least, longest, most_bits), longest)
    words = levels[0].groupBy("lang").agg(F.sum("n").alias("words"))
    counts = stage(reduce(DataFrame.unionByName, levels).where(F.col("n") >= least), "phrases")
    found = counts.where("size > 1").join(_compacted(counts), ["lang", "phrase"], "left_anti")
    cuts = found.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"_first": _words(F.col("k")), "_rest": _words(F.col("k") - F.col("size"))})
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("_first", "l"), ["lang", "_first"]).join(part("_rest", "r"), ["lang", "_rest"]).join(words, "lang")
    whole = lambda name: F.col(name).cast(EXACT)
    cuts = cuts.withColumn("above", F.lit(SCALE) * (whole("a") * whole("words"))).withColumn("below", whole("l") * whole("r"))
    best = cuts.groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase"))
    ranked = best.withColumn("rank", place.cast("long"))
    ranked = ranked if first is None else ranked.where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", F.col("words").alias("n"), "cut.score")
