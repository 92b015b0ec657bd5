"""Substring dedup (operator 12): prefix-partitioned suffix trees over words.

A word goes if a window of ``WINDOW`` words over it also starts in a document with a smaller id. Window starts are the
suffixes of a text; suffixes are divided into groups that fit in a task, and each group becomes a suffix tree of its own, of
which only the internal nodes at least ``WINDOW`` words deep are needed: the leaves of such a node are equal windows.

The text that divides suffixes is a gram of theirs of variable length: 12 words first, and 25, 40 or 50 words in groups that
are still too large. Dealing suffixes by their very first words would send each word up to fifty times, so of
the grams of that length in a window the one with the least hash is taken: equal windows take equal grams at equal offsets,
and neighbouring windows mostly share theirs, so that they travel together as one span.

1. Spans: for each document, (gram, digest of the span's words, place). Grams met in spans of one kind, in one document only,
   are dropped. Equal spans are settled at once by the least id they have.
2. Of each kind of span whose gram has other kinds too, one goes on with its words, hashed.
3. Groups of up to ``GROUP`` spans become trees in tasks. Larger ones are divided by longer grams; a gram as long as the
   window makes groups of equal windows, whose least id is an aggregation and no tree.
4. What was found for a kind of span is looked up for all spans of that kind, with salts, and becomes ranges of words.

Words are compared by 64-bit digests, spans by these and a digest of 128 bits more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Tables, documents, give_back, record_batch, salted_lookup, small_batches
from larder.llm.near_duplicates import STEP, mixed
from larder.llm.repeated_bytes import key_columns, sliding_minimum

WINDOW = 50
#: Words of the grams that divide suffixes, one length after the other.
GRAMS = (12, 25, 40, WINDOW)
#: Spans in a group that becomes a tree in one task.
GROUP = 500
#: Windows that become trees together.
TOGETHER = 60_000
#: Window starts that are handled at once; longer texts are handled in blocks of so many.
BLOCK = 1 << 18
POSITION_BITS = 20
#: Words whose digests a task keeps; beyond it the table starts anew.
CACHED_WORDS = 50_000
NO_ID = 2**63 - 1


class WordHashes(dict):
    """64-bit digests of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "big")
        return value

    def of(self, raw: bytes) -> np.ndarray:
        """The digests of a text's words in order. bytes.split knows the six white-space characters and no others."""
        words = raw.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def anchored(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, place, first window, last window): runs of windows with one and the same least gram of ``size`` words."""
    parts = []
    for at in range(0, len(words) - WINDOW + 1, BLOCK):
        block = words[at : at + BLOCK + WINDOW - 1]
        m = len(block) - size + 1
        gram = block[:m].copy()
        for k in range(1, size):
            gram = gram * STEP + block[k : k + m]
        gram = mixed(gram)
        mask = np.uint64((1 << POSITION_BITS) - 1)
        least = sliding_minimum((gram & ~mask) | np.arange(m, dtype=np.uint64), WINDOW - size + 1)
        place = (least & mask).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:] - 1, len(place) - 1)
        place = place[first]
        parts.append((gram[place].view(np.int64), place + at, first + at, last + at))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


I64 = pa.int64()
_SPANS = [(n, I64) for n in ("g", "s1", "s2", "rank", "k1", "k2", "lo", "hi")]
SPANS = ", ".join(f"{n} long" for n, _ in _SPANS)
_WORK = [(n, I64) for n in ("g", "s1", "s2", "rank", "off")] + [("words", pa.binary()), ("key", I64), ("key2", I64)]
WORK = "g long, s1 long, s2 long, rank long, off long, words binary, key long, key2 long"
_FOUND = [(n, I64) for n in ("g", "s1", "s2", "a", "b")]
FOUND = ", ".join(f"{n} long" for n, _ in _FOUND)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of every text; windows lo to hi (inclusive) share a gram."""
    hashes = WordHashes()
    out: list[tuple] = []
    for batch in batches:
        for rank, k1, k2, text in zip(*(batch.column(c) for c in ("rank", "k1", "k2", "text"))):
            words = hashes.of(text.as_buffer().to_pybytes())
            rank, k1, k2 = rank.as_py(), k1.as_py(), k2.as_py()
            for g, lo, hi in zip(*(x.tolist() for x in (lambda a: (a[0], a[2], a[3]))(anchored(words, GRAMS[0])))):
                out.append((g, *digest(words[lo : hi + WINDOW].tobytes()), rank, k1, k2, lo, hi))
                if len(out) > 20_000:
                    yield record_batch(_SPANS, out)
                    out = []
    yield record_batch(_SPANS, out)
    give_back()


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed spans of each text with the digests of their words."""
    hashes = WordHashes()
    out: list[tuple] = []
    for batch in batches:
        for rank, text, spans in zip(*(batch.column(c) for c in ("rank", "text", "spans"))):
            words, rank = hashes.of(text.as_buffer().to_pybytes()), rank.as_py()
            for s in spans:
                g, s1, s2, lo, hi = (s[c].as_py() for c in ("g", "s1", "s2", "lo", "hi"))
                out.append((g, s1, s2, rank, 0, words[lo : hi + WINDOW].tobytes(), g, 0))
                if len(out) > 5_000:
                    yield record_batch(_WORK, out)
                    out = []
    yield record_batch(_WORK, out)
    give_back()


def _divided(size: int):
    """Spans divided by grams of ``size`` words; one as long as a window has a digest of 128 bits as its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for g, s1, s2, rank, off, raw, key, key2 in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(raw, np.uint64)
                if size == WINDOW:
                    for n in range(len(words) - WINDOW + 1):
                        out.append((g, s1, s2, rank, off + n, None, *digest(words[n : n + WINDOW].tobytes())))
                else:
                    for gram, lo, hi in zip(*(x.tolist() for x in (lambda a: (a[0], a[2], a[3]))(anchored(words, size)))):
                        out.append((g, s1, s2, rank, off + lo, words[lo : hi + WINDOW].tobytes(), gram, 0))
                if len(out) > 5_000:
                    yield record_batch(_WORK, out)
                    out = []
        yield record_batch(_WORK, out)

    return run


def deep_nodes(starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in the order of the suffix tree, and for each the number of the node ``WINDOW`` words deep it hangs from.

    ``words`` are numbers, ``starts`` suffixes among them. Sorted suffixes and the common prefixes of neighbours are the tree;
    a node of that depth is a longest run of neighbours that have so many words in common.
    """
    rows = words[starts[:, None] + np.arange(WINDOW)].astype(">u4")
    order = np.argsort(rows.view(f"V{4 * WINDOW}").ravel(), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), WINDOW)  # words that neighbours have in common
    return order, np.cumsum(np.append(0, common < WINDOW))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window ranges of spans that a smaller id has too; whole groups come together, sorted by key."""

    def cover(held: list[tuple]) -> list[tuple]:
        parts = [np.frombuffer(r[5], np.uint64) for r in held]
        lengths = np.array([len(p) for p in parts])
        _, words = np.unique(np.concatenate(parts), return_inverse=True)
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        windows = lengths - WINDOW + 1
        owner = np.repeat(np.arange(len(held)), windows)
        inner = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
        rank = np.array([r[3] for r in held], np.int64)[owner]
        order, node = deep_nodes(begin[owner] + inner, words)
        least = np.minimum.reduceat(rank[order], np.flatnonzero(np.append(True, node[1:] != node[:-1])))
        repeated = np.zeros(len(owner), bool)
        repeated[order] = rank[order] > least[node]
        out = []
        hit = np.flatnonzero(repeated)
        if len(hit):
            # Runs of neighbouring windows of one span.
            new = np.append(True, (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]]))
            first, last = hit[new], hit[np.append(new[1:], True)]
            for a, b in zip(first.tolist(), last.tolist()):
                g, s1, s2, _, off = held[owner[a]][:5]
                out.append((g, s1, s2, off + int(inner[a]), off + int(inner[b])))
        return out

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if size > TOGETHER and r[6] != held[-1][6]:
                yield record_batch(_FOUND, cover(held))
                held, size = [], 0
            held.append(r)
            size += len(r[5]) // 8 - WINDOW + 1
    if held:
        yield record_batch(_FOUND, cover(held))
    give_back()


KIND = ["g", "s1", "s2"]


def repeated_ranges(rows: DataFrame, tables: Tables) -> DataFrame:
    """(k1, k2, rank, a, b): words a to b (exclusive) of a text that a window of a smaller rank covers; ``rows`` are (rank, k1, k2, text)."""
    keep = tables.keep
    spans = keep(rows.select("rank", "k1", "k2", "text").mapInArrow(_spans, SPANS), "spans")

    # Kinds of spans, each with its least rank and one place of that rank.
    place = F.struct("rank", "k1", "k2", "lo", "hi")
    kinds = keep(spans.groupBy(*KIND).agg(F.min(place).alias("at"), F.max("rank").alias("top")), "kinds")
    variety = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("at.rank").alias("low"), F.max("top").alias("high")).filter("low < high")
    all_kinds, kinds = kinds, keep(kinds.join(variety, "g").filter("m > 1 or top > at.rank").select(*KIND, "at", "m"), "shared")
    tables.drop(all_kinds)

    wanted = kinds.filter("m > 1").select(F.col("at.rank").alias("rank"), F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"), F.struct(*KIND, F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi")).alias("span"), "m")
    lists = wanted.groupBy("rank", "k1", "k2").agg(F.collect_list(F.col("span")).alias("spans"))  # as many as a text has grams
    texts = rows.join(lists, ["rank", "k1", "k2"])
    work = keep(texts.select("rank", "text", "spans").mapInArrow(_with_words, WORK), "work")

    found = []
    for n, size in enumerate(GRAMS):
        if n:
            work = keep(large.mapInArrow(_divided(size), WORK), "work")
            tables.drop(sized)
        if size == WINDOW:
            least = work.groupBy("key", "key2").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most").drop("most")
            found.append(salted_lookup(work, least, ["key", "key2"], F.col("s1")).filter("rank > least").select(*KIND, F.col("off").alias("a"), F.col("off").alias("b")))
            break
        sizes = work.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = keep(salted_lookup(work, sizes, ["key"], F.col("s1")), "sized")
        tables.drop(work)
        small = sized.filter(F.col("n") <= GROUP).select(*[c for c, _ in _WORK])
        found.append(keep(small.repartition("key").sortWithinPartitions("key").mapInArrow(_trees, FOUND), "found"))
        large = sized.filter(F.col("n") > GROUP).select(*[c for c, _ in _WORK])
        if large.isEmpty():
            break
    ranges = found[0]
    for f in found[1:]:
        ranges = ranges.union(f)
    ranges = ranges.groupBy(*KIND).agg(F.collect_set(F.struct("a", "b")).alias("ranges"))  # as many as a span has windows
    verdicts = keep(kinds.select(*KIND, F.col("at.rank").alias("least")).join(ranges, KIND, "left"), "verdicts")
    tables.drop_all_but(spans, verdicts)

    judged = salted_lookup(spans, verdicts, KIND, F.xxhash64("k1", "k2", "lo"))
    whole = judged.filter("rank > least").select("k1", "k2", "rank", F.col("lo").alias("a"), (F.col("hi") + WINDOW).alias("b"))
    partly = judged.filter("rank = least").select("k1", "k2", "rank", "lo", F.explode("ranges").alias("r"))
    partly = partly.select("k1", "k2", "rank", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b") + WINDOW).alias("b"))
    return whole.union(partly)


def _cleaned(with_text: bool):
    names = [("row", pa.string()), ("n_words", I64), ("n_removed", I64), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for row, text, covers in zip(*(batch.column(c) for c in ("row", "text", "covers"))):
                words = text.as_buffer().to_pybytes().split()
                n, at, kept = len(words), 0, []
                for a, b in sorted((s["a"], s["b"]) for s in covers.as_py() or ()):
                    kept += words[at:a]
                    at = max(at, b)
                kept += words[at:]
                left = b" ".join(kept)
                out.append((row.as_py(), n, n - len(kept), hashlib.sha256(left).hexdigest(), left.decode())[: len(names)])
                held += len(left) * with_text
                if len(out) >= 1_000 or held > 8_000_000:
                    yield record_batch(names, out)
                    out, held = [], 0
        if out:
            yield record_batch(names, out)
        give_back()

    return run


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of every row: words that a window of a document with a smaller id covers are gone.

    Ids are whole numbers; a row without one counts as having the greatest. Rows with one id are not smaller than each
    other, so equal rows keep what only they share, and so do passages that one document repeats. Windows are judged on
    the input. A null or empty text has no words. Very long texts are handled whole, in blocks of windows. Other
    columns are not read. An empty table gives no rows.
    """
    small_batches()
    tables = Tables(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("rank"), text.alias("text"))
    rows = rows.select("id", "rank", *key_columns(F.col("text")), "text")
    covers = repeated_ranges(rows, tables).groupBy("rank", "k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("covers"))  # as many as a text has grams
    covers = tables.keep(covers, "covers")
    tables.drop_all_but(covers)
    kinds = "row string, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    joined = rows.join(covers, ["rank", "k1", "k2"], "left").select(F.col("id").cast("string").alias("row"), "text", "covers")
    out = joined.mapInArrow(_cleaned(with_text), kinds)
    return out.select(F.col("row").cast(dict(docs.dtypes)[id_col]).alias(id_col), *out.columns[1:])


def op12_passage_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every whole text of documents without its 50-word windows of earlier documents."""
    return remove_passages(documents(spark, sf_dir), with_text=False)
