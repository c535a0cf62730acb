"""Best-fit packing of token pieces into sequences, shrunk first by Martello-Toth dominance.

Lengths are integers up to the capacity, so all that the solver needs is the number of pieces of
each length: at most `capacity` counts, whatever the size of the corpus. On these counts

1. dominance fixes bins for good: the largest piece goes alone if nothing else fits; with the
   largest other piece that fits, if the two fill a sequence, if no second other piece could be
   added, or if no two others that could be added weigh more than that one;
2. best fit, largest first, packs what is left.

Both act on whole groups of equal bins at once. The answer is a short list of runs ("the pieces of
this length numbered from..to go to sequences from.., so many to each, from this offset on"), and
each piece finds its place by its own number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reabasto.llm.common import stage

CAPACITY = 4096
END = 1
CACHE_PARTS = 400_000  # in a generation
MARKS = ".,;:!?"
PLAIN = bytes(i for i in range(256) if chr(i).isalnum() or chr(i) in " \n.,")  # letters and numbers of Latin-1, blanks
PIECE = "_id {id}, piece int, start long, length long, ids_crc32 long, _block int, _number long"


def reduce_dominated(counts: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins that dominate every alternative, as (lengths with counts, number of such bins); counts shrinks.

    counts[l] is the number of pieces of length l.
    """
    there = [l for l in range(1, capacity + 1) if counts[l]]
    fixed: list[tuple[list[tuple[int, int]], int]] = []

    def largest(limit: int, spare: int = 0) -> int:
        """The largest length up to the limit with more than `spare` kept back when it is that very length."""
        at = bisect_left(there, limit + 1) - 1
        while at >= 0 and counts[there[at]] - (1 if there[at] == spare else 0) <= 0:
            at -= 1
        return there[at] if at >= 0 else 0

    def fix(lengths: list[int], bins: int) -> None:
        for l in lengths:
            counts[l] -= bins
            if not counts[l]:
                there.remove(l)
        fixed.append(([(l, 1) for l in lengths], bins))

    at = len(there) - 1
    while at >= 0:
        top = there[at]
        room = capacity - top
        other = largest(room, top) if room else 0
        if not other:
            fix([top], 1 if room >= top else counts[top])
        elif top + other == capacity or not _third(there, counts, top, room):
            if other == top:
                counts[top] -= 2 * (pairs := counts[top] // 2)
                if not counts[top]:
                    there.remove(top)
                fixed.append(([(top, 2)], pairs))
            else:
                fix([top, other], min(counts[top], counts[other]))
        elif _best_two(there, counts, top, room) <= other and not _three(there, counts, top, room):
            if other == top:
                fixed.append(([(top, 2)], 1))
                counts[top] -= 2
                if not counts[top]:
                    there.remove(top)
            else:
                fix([top, other], 1)
        else:
            at -= 1  # no rule decides for this length: left to best fit
            continue
        at = min(at, len(there) - 1)
    return fixed


def _smallest(there: list[int], counts: list[int], top: int, number: int) -> int:
    """Weight of the `number` smallest pieces beside one of length `top`; a large number if there are fewer."""
    weight = 0
    for l in there:
        use = min(number, counts[l] - (l == top))
        weight += use * l
        number -= use
        if not number:
            return weight
    return 1 << 60


def _third(there: list[int], counts: list[int], top: int, room: int) -> bool:
    return _smallest(there, counts, top, 2) <= room


def _three(there: list[int], counts: list[int], top: int, room: int) -> bool:
    return _smallest(there, counts, top, 3) <= room


def _best_two(there: list[int], counts: list[int], top: int, room: int) -> int:
    """The most that two pieces beside one of length `top` can weigh within the room."""
    free = {l: counts[l] - (l == top) for l in there[: bisect_left(there, room)]}
    lengths = [l for l, n in free.items() if n > 0]
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        weight = lengths[low] + lengths[high]
        if weight > room or (low == high and free[lengths[low]] < 2):
            high -= 1
        else:
            best = max(best, weight)
            low += 1
    return best


def best_fit(counts: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, largest first, on counts: groups of equal bins as (lengths with counts, number of bins)."""
    open_bins: dict[int, list[tuple[tuple, int]]] = {}  # room left: groups of bins alike
    rooms: list[int] = []

    def put(room: int, content: tuple, bins: int) -> None:
        if bins:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((content, bins))

    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else 0
            if room:
                content, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, content, bins = capacity, (), 1 << 60
            each = room // length
            whole = min(bins, left // each)
            put(room - each * length, (*content, (length, each)), whole)
            left -= whole * each
            bins -= whole
            if left and bins:  # the last bin takes what there is
                put(room - left * length, (*content, (length, left)), 1)
                left, bins = 0, bins - 1
            if content:
                put(room, content, bins)
    return [(list(content), bins) for groups in open_bins.values() for content, bins in groups]


def solve(counts: list[int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """counts[l]: number of pieces of length l (index 0 unused). Groups of bins as (lengths with counts, number)."""
    left = list(counts)
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def runs(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first piece number, pieces to a bin, first sequence, offset), by piece number."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for content, number in bins:
        offset = 0
        for length, each in content:
            first = used.get(length, 0)
            found.setdefault(length, []).append((first, each, sequence, offset))
            used[length] = first + number * each
            offset += each * length
        sequence += number
    return {l: np.array(rows, dtype=np.int64) for l, rows in found.items()}


class Words:
    """Ids of texts as 32-bit words of bytes, by way of their blank-separated parts.

    The vocabulary splits at white space before anything else, so a text's ids are those of its parts.
    Ids of parts are remembered in two generations of bounded size, so that frequent parts stay. New
    parts that are letters only, but for marks behind, are looked up many at a time: the letters
    are one word there and the marks another, and each word's last id is one that ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a text that holds their strings is ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}

    def _plain(self, parts: list[str]) -> list[bytes]:
        return [array("I", made.ids).tobytes() for made in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        found = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(some):  # a letter that falls apart into more than letters
                found += self._plain(some)
                continue
            data, first = ids.tobytes(), 0
            for last in ends.tolist():
                found.append(data[first:last])
                first = last
        return found

    def learn(self, parts: set[str]) -> None:
        """Makes sure that the parts are remembered."""
        if len(self.now) > CACHE_PARTS:
            self.now, self.old = {}, self.now
        now, old, stops = self.now, self.old, self.stops
        words, others, stopped = [], [], []
        for part in parts - now.keys():
            if part in old:
                now[part] = old[part]
            elif part.isalpha():
                words.append(part)
            elif (word := part.rstrip(MARKS)).isalpha():
                stopped.append((part, word))
            else:
                others.append(part)
        bare = {word for _, word in stopped}.difference(now, words)
        words.extend(bare)
        now.update(zip(words, self._letters(words), strict=True))
        now.update(zip(others, self._plain(others), strict=True))
        for part, word in stopped:
            if not word.isascii() and self.ends[np.frombuffer(now[word], dtype=np.uint32)].sum() != 1:
                now[part] = self._plain([part])[0]  # it ends in a mark that the next ones join
                continue
            mark = part[len(word) :]
            if mark not in stops:
                stops[mark] = self._plain([mark])[0]
            now[part] = now[word] + stops[mark]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 512):
            split = [simpler(t).replace("\n", " ").split(" ") for t in texts[at : at + 512]]
            self.learn(set().union(*split))
            for parts in split:
                yield b"".join(map(self.now.__getitem__, parts))


def simpler(text: str) -> str:
    """A text with the same ids, written so that fewer different parts occur, where that is plain to see.

    In Western letters lower case is what the vocabulary makes of them anyway, and full stops and commas
    that stand between a word and a blank are words of their own.
    """
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    text = text.lower()
    if raw.translate(None, PLAIN):
        return text
    for mark in ".,":
        if text.count(mark) != text.count(f"{mark} ") + text.count(f"{mark}\n") + text.endswith(mark):
            return text
    return text.replace(".", " .").replace(",", " ,")


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """One per worker, which keeps it from task to task."""
    return Words(path)


def _pieces(tokenizer_path: str, capacity: int, end: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, block, numbers = words_of(tokenizer_path), TaskContext.get().partitionId(), {}
        last = array("I", [end]).tobytes()
        for batch in batches:
            rows = []
            texts = ["" if t is None else t for t in batch["_text"]]
            for doc, ids in zip(batch["_id"], words.ids(texts), strict=True):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    number = numbers.get(length, 0)
                    numbers[length] = number + 1
                    rows.append((doc, piece, at // 4, length, zlib.crc32(part), block, number))
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32", "_block", "_number"])

    return cut


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Ids of a document: those of its text, then `end`. Only documents longer than the capacity are
    cut. Null text: empty, so a piece of one id. Rows that share an id are packed as separate
    documents; null ids stay null. Empty table: no rows.

    Texts are read once; a piece is numbered within its task and length as it is made, so a length
    that holds most pieces needs no ordering of its own. The driver sees one count per length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # a nullable whole-number id goes through as text, pandas would make it a float
    made = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(
        _pieces(tokenizer_path, capacity, end), PIECE.format(id="string")
    )
    pieces = stage(made, "pieces")
    blocks = stage(pieces.groupBy("length", "_block").agg(F.count("*").alias("n")), "blocks")
    counts = [0] * (capacity + 1)
    for length, n in blocks.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    places = runs(solve(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_block")) - F.col("n")
    numbered = pieces.join(blocks.select("length", "_block", before.alias("_before")), ["length", "_block"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            number = (batch["_number"] + batch["_before"]).to_numpy()
            for length, rows in batch.groupby("length").indices.items():
                table, mine = places[length], number[rows]
                run = table[np.searchsorted(table[:, 0], mine, side="right") - 1]
                within = mine - run[:, 0]
                sequence[rows] = run[:, 2] + within // run[:, 1]
                offset[rows] = run[:, 3] + within % run[:, 1] * length
            yield batch[["_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    placed = numbered.mapInPandas(place, "_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.select(F.col("_id").cast(kind).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
