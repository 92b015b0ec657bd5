"""Benchmark decontamination (operator 3): q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments, short and long ones. A text that holds a segment of m characters with at most e
edits shares m - q + 1 - q * e of its q-grams with it, on at most e + 1 neighbouring diagonals (place in the
text minus place in the segment). So each text counts shared q-grams in overlapping bands of diagonals,
keeps the bands that reach that bound, and aligns only those, within the band.

Texts never meet each other: the benchmark, of checked size, goes to the texts in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import documents, small_batches

Q = 10
#: Edits allowed for each character of a segment.
EDIT_RATE = 0.06
#: Short segments find quotes of a part of an item. They have this length, or what half of a shorter item surely holds.
SHORT, SHORT_STEP = 50, 10
#: Long segments find edits that crowd together; one begins every half, what is left at the end joins the last one.
LONG = 160
#: Least length of the segments of a longer item.
SHORTEST_PIECE = 24
#: Shorter normalised items are looked for on whole words and without edits only: from here on one edit leaves a shared gram.
SHORTEST_ITEM = 2 * Q
#: Characters of the benchmark that one pass over the texts takes; a larger benchmark takes more passes.
BLOCK_CHARS = 8_000_000
#: Places shared with the benchmark that are looked at together; texts with more have what repeats in them searched once, and are
#: searched in parts, against parts of the benchmark.
MOST_SHARED = 1_000_000
#: Longest period of a stretch that is searched once for all its repeats.
PERIOD = 64
#: Leading bits of a hash that lead to its place among the sorted keys.
TABLE_BITS = 20
_STEP = 0x9E3779B1


def normalised(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points in lower case, runs of white space (code points up to 32) as one space, and their places in the
    text (None: all of them)."""
    low = text.lower()
    if len(low) != len(text):  # some capitals have a longer lower case; they stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = codes <= 32
    codes = np.where(white, np.uint32(32), codes)
    again = white[1:] & white[:-1]
    if not again.any():
        return codes, None
    at = np.flatnonzero(np.append(True, ~again))
    return codes[at], at


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q = 10 code points from each place on, from hashes of 2, 4 and 8. Equal hashes of unequal
    grams only add votes; alignment decides."""
    if len(codes) < Q:
        return np.zeros(0, np.uint32)
    power = [np.uint32(pow(_STEP, n, 2**32)) for n in (1, 2, 4)]
    two = codes[:-1] * power[0] + codes[1:]
    four = two[:-2] * power[1] + two[2:]
    eight = four[:-4] * power[2] + four[4:]
    h = eight[:-2] * power[1] + two[8:]
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)


def unrolled(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Text whose periodic stretches are cut down to ``most`` characters and a few, the places that are left, and the stretches
    that were cut: (begin, end, period) in ``codes``.

    A stretch that repeats every p characters, p up to ``PERIOD``, loses whole periods out of its middle. All its
    strings of up to half of ``most`` characters are still there, as are those that reach over its ends.
    """
    left = np.arange(len(codes))
    cut: list[tuple[int, int, int]] = []
    for p in range(1, PERIOD + 1):
        if len(codes) <= most + 2 * p:
            break
        same = np.r_[False, codes[p:] == codes[:-p], False].astype(np.int8)
        border = np.diff(same)
        begin, end = np.flatnonzero(border == 1), np.flatnonzero(border == -1) + p  # the stretch is begin..end
        long = end - begin > most + 2 * p
        if not long.any():
            continue
        keep = np.ones(len(codes), bool)
        for a, z in zip(begin[long].tolist(), end[long].tolist()):
            whole = (z - a - most) // p * p
            middle = a + most // 2
            keep[middle : middle + whole] = False
            cut.append((int(left[a]), int(left[z - 1]) + 1, p))
        codes, left = codes[keep], left[keep]
    return codes, left, cut


Found = list[tuple[int | None, int, int, int]]


def repeats(found: Found, origin: np.ndarray, cut: list[tuple[int, int, int]]) -> Found:
    """Findings in an unrolled text as findings in the text itself: one within a stretch that was cut is there in all its
    periods. Repeats that overlap are one finding. With edits, the borders may be those of another alignment as good."""
    out, told = [], set()
    borders = [(int(np.searchsorted(origin, a)), int(np.searchsorted(origin, z)), a, z, p) for a, z, p in cut]
    for item, a, z, edits in found:
        inside = False
        for low, high, begin, end, p in borders:
            if low <= a and z <= high:
                inside = True
                n, first = z - a, begin + (a - low) % p
                if (key := (item, begin, p, first, n, edits)) in told:
                    continue
                told.add(key)
                last = first + (end - n - first) // p * p
                if n > p:
                    out.append((item, first, last + n, edits))
                else:
                    out += [(item, x, x + n, edits) for x in range(first, last + 1, p)]
        if not inside:
            out.append((item, int(origin[a]), int(origin[z - 1]) + 1, edits))
    return out


def as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def joins(two: str) -> bool:
    """Whether two neighbouring characters belong to one word."""
    return len(two) == 2 and all(c == "_" or c.isalnum() for c in two)


def edit_budget(m: int) -> int:
    """Most edits that the filter can promise to find in a segment of m characters."""
    return max(0, min(int(m * EDIT_RATE), (m - Q) // Q))


def short_pieces(n: int) -> list[tuple[int, int]]:
    """Places of the short segments of an item of n characters; the last one ends with it."""
    m = min(n, SHORT, max(SHORTEST_PIECE, n // 2 - SHORT_STEP + 1))
    return [(s, s + m) for s in sorted({*range(0, n - m, SHORT_STEP), n - m})]


def long_pieces(n: int) -> list[tuple[int, int]]:
    """Places of the long segments, or of the whole item."""
    starts = range(0, max(1, n - LONG + 1), LONG // 2)
    return [(s, n if s == starts[-1] else s + LONG) for s in starts]


class Index:
    """q-grams of a block of items, each kept once; the segments that hold one are looked up by its place."""

    def __init__(self, items: list[tuple[int | None, str]]):
        texts = [(item, normalised(text.strip(" \t\n\v\f\r"))[0]) for item, text in items]
        brief: dict[str, list[int | None]] = {}  # items that are too short for segments
        for item, codes in texts:
            if len(codes) < SHORTEST_ITEM and (short := as_text(codes).strip(" ")):
                brief.setdefault(short, []).append(item)
        self.brief = ahocorasick.Automaton()
        for short, ids in brief.items():
            self.brief.add_word(short, (len(short), ids))
        self.brief.make_automaton()
        texts = [x for x in texts if len(x[1]) >= SHORTEST_ITEM]
        self.codes = np.concatenate([np.zeros(0, np.uint32), *[c for _, c in texts]])
        offset = np.cumsum([0, *[len(c) for _, c in texts]])
        self.segments: list[tuple[int, int, int]] = []  # item, begin and end in codes
        self.kinds: list[tuple[int, np.ndarray, np.ndarray]] = []  # first segment, begins and ends; both grow
        for pieces in (short_pieces, long_pieces):
            first = len(self.segments)
            for (item, c), at in zip(texts, offset.tolist()):
                told = set()  # of equal segments of an item one is enough
                for a, z in pieces(len(c)):
                    if (content := c[a:z].tobytes()) not in told:
                        told.add(content)
                        self.segments.append((item, at + a, at + z))
            self.kinds.append((first, *(np.array([x[k] for x in self.segments[first:]], np.int64) for k in (1, 2))))
        self.begin = np.array([a for _, a, _ in self.segments], np.int64)
        self.size = np.array([z - a for _, a, z in self.segments], np.int64)
        self.budget = np.array([edit_budget(m) for m in self.size.tolist()], np.int64)
        self.bound = self.size - Q + 1 - Q * self.budget
        hashes = [grams(c) for _, c in texts]
        flat = np.concatenate([np.zeros(0, np.uint32), *hashes])
        place = np.concatenate([np.zeros(0, np.int64), *[at + np.arange(len(h)) for at, h in zip(offset, hashes)]])
        used = np.zeros(len(flat), bool)
        for _, begins, ends in self.kinds:
            used |= np.searchsorted(ends, place + Q) < np.searchsorted(begins, place, "right")
        flat, place = flat[used], place[used]
        self.longest = int((self.size + self.budget).max()) if self.segments else 0
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first = np.r_[first, len(flat)]
        self.place = place[order]
        #: For each entry the number of its gram and its place, as one number that grows; and where items begin.
        self.entry = np.repeat(np.arange(len(self.keys)), np.diff(self.first)) * len(self.codes) + self.place
        self.borders = offset
        slot = self.keys >> np.uint32(32 - TABLE_BITS)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slot] = True
        self.lowest = np.searchsorted(slot, np.arange(1 << TABLE_BITS)).astype(np.int32)
        self.most_in_slot = int(np.bincount(slot).max()) if len(slot) else 0
        self.keys = np.append(self.keys, np.uint32(2**32 - 1))

    def _votes(self, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments and diagonals of grams at places of the text and of the benchmark."""
        segments, diagonals = [], []
        for first, begins, ends in self.kinds:
            lowest = np.searchsorted(ends, place + Q)
            n = np.maximum(np.searchsorted(begins, place, "right") - lowest, 0)
            upto = np.cumsum(n)
            segment = first + np.arange(upto[-1]) + np.repeat(lowest - upto + n, n)
            segments.append(segment)
            diagonals.append(np.repeat(at - place, n) + self.begin[segment])
        return np.concatenate(segments), np.concatenate(diagonals)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in the text; the segments of an item that touch are one finding."""
        codes, origin = normalised(text)
        found = self._brief(codes) + self._segments(codes)
        if origin is not None:
            found = [(item, int(origin[a]), int(origin[z - 1]) + 1, edits) for item, a, z, edits in found]
        return self._joined(found)

    def _segments(self, codes: np.ndarray) -> Found:
        """Findings of segments. If shared grams are many for the length of the text, a periodic stretch of it is searched over a few
        periods, and what is found there holds for all of them. Then it is searched in parts that overlap by more than a segment."""
        if not self.segments:
            return []
        hits = self._shared(codes)
        if hits[2].sum() <= MOST_SHARED:
            return self._votes_of(codes, *hits)
        short, origin, cut = unrolled(codes, 2 * self.longest)
        if cut:
            return repeats(self._segments(short), origin, cut)
        overlap = 2 * self.longest
        half = len(codes) // 2
        if half <= 2 * overlap:
            return self._by_items(codes, *hits[:2], 0, len(self.codes))
        # A finding at the border of a part may lack its rest; the other part has it whole.
        left = [f for f in self._segments(codes[: half + overlap]) if f[2] < half + overlap]
        right = [(item, a + half, z + half, edits) for item, a, z, edits in self._segments(codes[half:]) if a > 0]
        return left + right

    def _by_items(self, codes: np.ndarray, at: np.ndarray, k: np.ndarray, low: int, high: int) -> Found:
        """Findings of the items that lie in low..high of the benchmark, halved between items until what is shared is little."""
        # Entries are in order of gram and place, so those of a gram within low..high stand together.
        row = k.astype(np.int64) * len(self.codes)
        begin = np.searchsorted(self.entry, row + low)
        n = np.searchsorted(self.entry, row + high) - begin
        inner = self.borders[(self.borders > low) & (self.borders < high)]
        if n.sum() <= MOST_SHARED or not len(inner):
            return self._votes_of(codes, at, k, n, begin)
        middle = int(inner[len(inner) // 2])
        return self._by_items(codes, at, k, low, middle) + self._by_items(codes, at, k, middle, high)

    def _brief(self, codes: np.ndarray) -> Found:
        if not len(self.brief):
            return []
        text, found = as_text(codes), []
        for last, (n, ids) in self.brief.iter(text):
            a, z = last - n + 1, last + 1
            if not (joins(text[a - 1 : a + 1]) if a else False) and not joins(text[z - 1 : z + 1]):
                found += [(item, a, z, 0) for item in ids]
        return found

    def _shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of grams that the benchmark has too, their number among the keys, and how many places each has there."""
        hashes = grams(codes)
        slot = hashes >> np.uint32(32 - TABLE_BITS)
        at = np.flatnonzero(self.table[slot])
        wanted, k = hashes[at], self.lowest[slot[at]]
        for _ in range(self.most_in_slot - 1):
            k = k + (self.keys[k] < wanted)
        same = (self.keys[k] == wanted) & (k < len(self.keys) - 1)
        at, k = at[same], k[same]
        return at, k, self.first[k + 1] - self.first[k]

    def _votes_of(self, codes: np.ndarray, at: np.ndarray, k: np.ndarray, n: np.ndarray, begin: np.ndarray | None = None) -> Found:
        if not n.sum():
            return []
        ends = np.cumsum(n)
        entry = np.arange(ends[-1]) + np.repeat((self.first[k] if begin is None else begin) - ends + n, n)
        segment, diagonal = self._votes(np.repeat(at, n), self.place[entry])
        if not len(segment):
            return []
        # Bands of two steps that begin every step: any budget + 1 neighbouring diagonals lie within one.
        band = diagonal // (self.budget[segment] + 1)
        low = int(band.min())
        wide = int(band.max()) - low + 2
        of = segment * wide + (band - low)
        order = np.argsort(of, kind="stable")
        diagonal = diagonal[order]
        keys, begin, count = np.unique(of[order], return_index=True, return_counts=True)
        next_too = np.append((keys[1:] == keys[:-1] + 1) * count[1:], 0)
        both = count + next_too
        found: list[tuple[int, int, int, int]] = []
        done: dict[int, int] = {}  # segment: the last band that held a match
        for j in np.flatnonzero(both >= self.bound[keys // wide]).tolist():
            s, b = int(keys[j]) // wide, int(keys[j]) % wide + low
            if done.get(s) == b - 1:
                continue  # the overlap of two bands
            w = int(self.budget[s]) + 1
            hit = self._exact(codes, s, diagonal[begin[j] : begin[j] + both[j]]) or self._align(codes, s, b * w, (b + 2) * w - 1)
            if hit:
                done[s] = b
                found.append((self.segments[s][0], *hit))
        return found

    def _pattern(self, s: int) -> np.ndarray:
        return self.codes[self.segments[s][1] : self.segments[s][2]]

    def _exact(self, codes: np.ndarray, s: int, diagonals: np.ndarray) -> tuple[int, int, int] | None:
        """The segment without edits on the diagonal that has most votes."""
        values, votes = np.unique(diagonals, return_counts=True)
        at, pattern = int(values[np.argmax(votes)]), self._pattern(s)
        if at >= 0 and np.array_equal(codes[at : at + len(pattern)], pattern):
            return at, at + len(pattern), 0
        return None

    def _align(self, codes: np.ndarray, s: int, low: int, high: int) -> tuple[int, int, int] | None:
        """Best place of segment s whose diagonals lie in low..high, if it needs no more edits than allowed.

        Row i of the table has, for each diagonal, the edits for the first i characters of the segment; the
        text before and after the match is free.
        """
        pattern, e = self._pattern(s), int(self.budget[s])
        low, high = low - e, high + e
        diagonals = np.arange(low, high + 1)
        n, far, wide = len(codes), 10**6, high - low + 1
        padded = np.full(len(pattern) + wide, -1, np.int64)  # the text from place low on; -1 outside it
        a, z = max(low, 0), min(n, low + len(padded))
        padded[a - low : max(a, z) - low] = codes[a : max(a, z)]
        steps = np.arange(wide)
        cost = np.full(wide + 1, far)  # the last cell stays out of reach
        cost[:-1][(diagonals >= 0) & (diagonals <= n)] = 0
        begin = np.append(diagonals, 0)
        for i, c in enumerate(pattern.tolist()):
            here = padded[i : i + wide]
            new = cost[:-1] + (here != c)
            new[here < 0] = far
            missing = cost[1:] + 1  # the segment's character is missing in the text
            less = missing < new
            new[less] = missing[less]
            start = np.where(less, begin[1:], begin[:-1])
            # Characters only in the text move right along the row.
            reach = new - steps
            best = np.minimum.accumulate(reach)
            begin[:-1] = start[np.maximum.accumulate(np.where(reach == best, steps, 0))]
            cost[:-1] = best + steps
        cost = cost[:-1]
        end = diagonals + len(pattern)
        cost = np.where((end >= 0) & (end <= n), cost, far)
        k = int(np.argmin(cost))
        if cost[k] > e or end[k] <= begin[k]:
            return None
        return max(0, int(begin[k])), int(end[k]), int(cost[k])

    @staticmethod
    def _joined(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        out: list[tuple[int, int, int, int]] = []
        for item, a, b, edits in sorted(set(found), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])):
            if out and out[-1][0] == item and a < out[-1][2]:
                out[-1] = (item, out[-1][1], max(b, out[-1][2]), max(edits, out[-1][3]))
            else:
                out.append((item, a, b, edits))
        return out


FOUND = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())])
)


def blocks(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", most_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the benchmark, each of checked size. Items without text are left out, equal ones kept once.
    A text without id is reported with a null, unless the same text has an id."""
    items = bench.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null").distinct()
    named = items.filter("i is not null")
    items = named.unionByName(items.filter("i is null").join(named.select("t"), "t", "left_anti").select("i", "t"))
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    n = int(size // most_chars) + 1
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield Index([(r["i"], r["t"]) for r in part.toLocalIterator()])


def _finder(spark: SparkSession, index: Index):
    shared = spark.sparkContext.broadcast(index)
    small_batches()

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value
        for texts in batches:
            yield texts.map(lambda x: [dict(zip(("item_id", "start", "end", "edits"), r)) for r in one.find(x or "")])

    return find


def find(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """(id, item_id, start, end, edits): one row for each place where a text holds a benchmark item or a segment of one.

    Places count code points of the text, ends are exclusive; edits is the most that a segment of it needed.
    Null and empty texts hold nothing; null ids are reported as null; repeated rows repeat; an empty benchmark
    gives no rows, as does an empty table. Very long texts are searched whole. Other columns are not read.
    """
    parts = []
    for index in blocks(bench, item_col, bench_text):
        hits = docs.select(F.col(id_col).alias("_id"), _finder(docs.sparkSession, index)(F.col(text_col)).alias("_hits"))
        parts.append(hits.select("_id", F.explode("_hits").alias("_h")).select(F.col("_id").alias(id_col), "_h.item_id", "_h.start", "_h.end", "_h.edits"))
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark item or segment."""
    for index in blocks(bench, item_col, bench_text):
        docs = docs.filter(F.size(_finder(docs.sparkSession, index)(F.col(text_col))) == 0)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in every whole text of documents."""
    return find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def plain_words(text: str) -> str:
    """Normalised text as a string, for tests."""
    return re.sub(r"[\x00-\x20]+", " ", text.lower())
