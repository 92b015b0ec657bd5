"""Quality rules (operator 4): suffix-array repetition.

The words of many texts become one array of numbers, ranked first by text and word, so that suffixes are only
ever compared inside their text. Prefix doubling refines the ranks of suffixes that still tie; neighbours in
the finished order give the longest common prefixes by binary descent over the kept ranks. The longest repeat
that starts at a word is the greater of the prefixes shared with its two neighbours, which is the depth of the
deepest common-prefix interval it lies in; the spans of these repeats, joined, are what the maximal repeated
substrings cover.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import documents, per_text

SYMBOLS = re.compile(r"[#*$%&|<>]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: Fixed values of the contract.
MIN_WORDS, WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
#: The method's rule: repeats of so many words count; a text may have so much of it covered, and no longer repeat.
MIN_REPEAT, MOST_COVERED, LONGEST_REPEAT = 5, 0.3, 50


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string from there that also starts elsewhere in its text.

    ``symbols`` are non-negative numbers; ``ends`` gives for each position where its text ends.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    key = ends.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    first = np.r_[True, key[order][1:] != key[order][:-1]]
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int32)
    rank[order] = starts[np.cumsum(first) - 1]
    sizes = np.diff(np.r_[starts, n])
    tied = np.sort(order[np.repeat(sizes > 1, sizes)])
    # Suffixes outside ``tied`` are unique in their text: no repeat starts there.
    levels: list[np.ndarray] = []
    step = 1
    while len(tied):
        levels.append(rank.copy())
        ahead = tied + step
        inside = ahead < ends[tied]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        key = rank[tied].astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key, moved = key[order], tied[order]
        new = np.r_[True, key[1:] != key[:-1]]
        begins = np.flatnonzero(new)
        sizes = np.diff(np.r_[begins, len(key)])
        group = key // (n + 1)
        group_begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        in_group = np.repeat(group_begins, np.diff(np.r_[group_begins, len(key)]))
        rank[moved] = group + np.repeat(begins, sizes) - in_group
        tied = np.sort(moved[np.repeat(sizes > 1, sizes)])
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    repeat = np.zeros(n, np.int64)
    if not levels:
        return repeat
    pair = np.flatnonzero(levels[0][suffixes[:-1]] == levels[0][suffixes[1:]])
    a, b = suffixes[pair], suffixes[pair + 1]
    shared = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        fits = (x < ends[a]) & (y < ends[b])
        same = fits & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        shared += same.astype(np.int64) << k
    np.maximum.at(repeat, a, shared)
    np.maximum.at(repeat, b, shared)
    return repeat


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x and SPACES.sub("", x)]
    return len(lines) - len(set(lines))


MEASURED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("covered_fraction", T.DoubleType()), T.StructField("longest_repeat", T.LongType())]
)


def measure(texts: list[str]) -> list[tuple]:
    words = [t.encode().split() for t in texts]  # bytes split at the contract's six white-space characters only
    n = np.array([len(w) for w in words])
    number: dict[bytes, int] = {}
    symbols = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(n.sum()))
    bounds = np.r_[0, np.cumsum(n)]
    ends = np.repeat(bounds[1:], n)
    repeat = longest_repeats(symbols, ends)
    total = len(symbols)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags)]
        return sums[bounds[1:]] - sums[bounds[:-1]]

    at = np.flatnonzero(repeat >= WINDOW)
    in_windows = per_doc(covered(at, np.full(len(at), WINDOW), total))
    at = np.flatnonzero(repeat >= MIN_REPEAT)
    in_repeats = per_doc(covered(at, repeat[at], total))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(texts)), n), repeat)
    rows = []
    for k, text in enumerate(texts):
        n_words, repeated = int(n[k]), int(in_windows[k])
        failed = n_words < MIN_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n_words
        fraction = float(in_repeats[k] / n_words) if n_words else 0.0
        kept = not failed and fraction <= MOST_COVERED and int(longest[k]) <= LONGEST_REPEAT
        chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        n_symbols = sum(map(len, SYMBOLS.findall(text)))
        rows.append((n_words, chars, n_symbols, repeated_lines(text), repeated, failed, kept, fraction, int(longest[k])))
    return rows


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and the verdict for every row, without a shuffle.

    Counts are of whole texts; a null text has no words and fails. Ids may be null or repeat, and other
    columns are not read. Memory in a task follows the chunk of texts, or its longest text. An empty table gives no rows.
    """
    return docs.select(F.col(id_col), per_text(lambda: measure, MEASURED)(F.col(text_col)).alias("r")).select(id_col, "r.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole text of documents."""
    return assess(documents(spark, sf_dir))
