"""Suffix-array dedup (operator 6): a depth-limited radix sort of suffixes, only through the threshold length.

A byte goes if a string of ``WINDOW`` bytes over it also starts anywhere else. Sorting every suffix would
shuffle some thirty bytes for each byte of text, so the passes begin with suffixes that stand for others: of
the ``GRAM``-byte strings within a window the one with the least hash is the window's anchor. Equal windows
have equal anchors at equal offsets, and an anchor serves about 70 neighbouring windows.

Most significant digit passes, each of which drops what stands alone:

1. the anchor's gram: anchors whose gram stands at one place of the corpus only are dropped;
2. the span (all bytes of the windows of one anchor): equal spans repeat as a whole, one of them goes on as
   evidence for the others;
3. unequal spans with one gram: their windows are sorted by eight bytes at a time, in tasks that hold whole
   groups; windows still equal after the last digit are exactly the repeated ones. Groups too large for a
   task are first dealt anew by the digest of what a few neighbouring windows have in common, and at last by
   that of single windows, so that no group meets in one task.

Texts are known by their digest; equal texts are handled once, and a text with copies goes as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Tables, documents, small_batches
from larder.llm.near_duplicates import mixed

WINDOW = 200
GRAM = 64
#: Grams in a window.
GRAMS = WINDOW - GRAM + 1
#: Window starts that are handled together; longer texts are handled in blocks of so many.
BLOCK = 1 << 19
POSITION_BITS = 20
#: Spans of one group that a task may hold; larger groups are dealt anew.
GROUP = 1000
#: Neighbouring windows that stay together when a large group is dealt anew.
FRINGE = 16
#: Windows sorted together in a task.
SORTED = 150_000
_BASE = 0x9E3779B97F4A7C15


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = BLOCK + WINDOW
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values, from minima within blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Finds the anchors of a text and the windows they serve."""

    def __init__(self) -> None:
        self.up, self.down = _powers()

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram hash, place, first window, last window) of every anchor."""
        parts = [self._block(np.frombuffer(raw, np.uint8)[a : a + BLOCK + WINDOW - 1], a) for a in range(0, len(raw) - WINDOW + 1, BLOCK)]
        if not parts:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]

    def _block(self, data: np.ndarray, at: int):
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        gram = mixed((sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1])
        mask = np.uint64((1 << POSITION_BITS) - 1)
        least = sliding_minimum((gram & ~mask) | np.arange(len(gram), dtype=np.uint64), GRAMS)
        place = (least & mask).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:] - 1, len(place) - 1)
        place = place[first]
        return gram[place].view(np.int64), place + at, first + at, last + at


def text_key(raw: bytes) -> tuple[int, int]:
    d = hashlib.md5(raw).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def key_columns(text: Column) -> list[Column]:
    """The same two numbers as columns."""
    d = F.md5(text.cast("binary"))
    return [F.conv(F.substring(d, a, 16), 16, -10).cast("long").alias(n) for n, a in (("k1", 1), ("k2", 17))]


def digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for (_, t), c in zip(schema, columns)], names=[n for n, _ in schema])


L, I64 = "long", pa.int64()
PLACED = [("g", I64), ("sp", I64), ("k1", I64), ("k2", I64), ("at", I64), ("lo", I64), ("hi", I64)]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, x) of every anchor; texts that a task has seen are not repeated."""
    yield from _scan(batches, False)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _scan(batches, True)


def _scan(batches: Iterator[pa.RecordBatch], spans: bool) -> Iterator[pa.RecordBatch]:
    finder = Anchors()
    seen: set[tuple[int, int]] = set()
    schema = PLACED if spans else [c for c in PLACED if c[0] in ("g", "k1", "k2", "at")]
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return _batch(schema, [np.concatenate(c) for c in zip(*held)])

    for batch in batches:
        for text in batch.column(0):
            raw = text.as_buffer()
            if raw is None or raw.size < WINDOW:
                continue
            raw = raw.to_pybytes()
            key = text_key(raw)
            if key in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(key)
            g, at, lo, hi = finder.of(raw)
            k1, k2 = np.full(len(g), key[0]), np.full(len(g), key[1])
            if spans:
                sp = np.array([digest(raw[a : b + WINDOW])[0] for a, b in zip(lo.tolist(), hi.tolist())], np.int64)
                held.append((g, sp, k1, k2, at, lo, hi))
            else:
                held.append((g, k1, k2, at))
            size += len(g)
            if size > 100_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


WORK = "g1 long, g2 long, k1 long, k2 long, at long, lo long, hi long, known boolean, many boolean, bytes binary"
_WORK = [(n, pa.int64()) for n in ("g1", "g2", "k1", "k2", "at", "lo", "hi")] + [("known", pa.bool_()), ("many", pa.bool_()), ("bytes", pa.binary())]


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with its bytes for each listed span of a text."""
    for batch in batches:
        k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
        out: list[tuple] = []
        for n in range(batch.num_rows):
            raw = batch.column("text")[n].as_buffer().to_pybytes()
            for s in batch.column("spans")[n].as_py():
                out.append((s["g"], 0, k1[n], k2[n], s["at"], s["lo"], s["hi"], s["known"], s["many"], raw[s["lo"] : s["hi"] + WINDOW]))
            if len(out) > 20_000:
                yield _batch(_WORK, list(zip(*out)))
                out = []
        if out:
            yield _batch(_WORK, list(zip(*out)))


def _dealt(width: int):
    """Each span as runs of ``width`` windows, grouped by the digest of what the windows of a run share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                # Runs are counted from the anchor, so that equal windows are in runs of equal offsets.
                first, last = r["at"] - r["hi"], r["at"] - r["lo"]
                for part in range(first // width, last // width + 1):
                    near, far = max(first, part * width), min(last, part * width + width - 1)
                    lo, hi = r["at"] - far, r["at"] - near
                    data = r["bytes"][lo - r["lo"] : hi - r["lo"] + WINDOW]
                    # All windows whose anchor is part * width to part * width + width - 1 behind their start
                    # hold the bytes from the nearest start to the farthest end, whichever of them this text has.
                    a = r["at"] - part * width - r["lo"]
                    core = r["bytes"][a : a + WINDOW - width + 1]
                    g1, g2 = digest(b"%d:%d:" % (r["g1"], part) + core)
                    out.append((g1, g2, r["k1"], r["k2"], r["at"], lo, hi, r["known"], False, data))
            if out:
                yield _batch(_WORK, list(zip(*out)))

    return run


COVER = "k1 long, k2 long, a long, b long"
_COVER = [(n, pa.int64()) for n in ("k1", "k2", "a", "b")]


def equal_rows(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which rows equal another row of their group: eight bytes a pass, most significant first."""
    digits = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    alive = np.arange(len(rows))
    group = group.astype(np.int64)
    for d in range(digits.shape[1] + 1):
        if d:
            order = np.lexsort((digits[alive, d - 1], group))
            alive, group = alive[order], group[order]
            digit = digits[alive, d - 1]
            new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))[: len(alive)]
        else:
            order = np.argsort(group, kind="stable")
            alive, group = alive[order], group[order]
            new = np.append(True, group[1:] != group[:-1])[: len(alive)]
        number = np.cumsum(new) - 1
        twice = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        alive, group = alive[twice], number[twice]
        if not len(alive):
            break
    result = np.zeros(len(rows), bool)
    result[alive] = True
    return result


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered runs of the spans of whole groups; rows come sorted by group."""
    held: list[dict] = []
    windows = 0

    def cover(rows: list[dict]) -> pa.RecordBatch | None:
        count = np.array([r["hi"] - r["lo"] + 1 for r in rows])
        views = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(r["bytes"], np.uint8), WINDOW) for r in rows]
        group = {}
        number = np.array([group.setdefault((r["g1"], r["g2"]), len(group)) for r in rows])
        offset = np.concatenate([np.arange(r["at"] - r["lo"], r["at"] - r["hi"] - 1, -1) for r in rows])
        same = equal_rows(np.concatenate(views), np.repeat(number, count) * (2 * WINDOW) + offset)
        out = []
        start = 0
        for r, n in zip(rows, count.tolist()):
            if not r["known"]:
                hit = np.flatnonzero(np.diff(np.r_[0, same[start : start + n].astype(np.int8), 0])).reshape(-1, 2)
                out += [(r["k1"], r["k2"], r["lo"] + int(a), r["lo"] + int(b) - 1 + WINDOW) for a, b in hit]
            start += n
        return _batch(_COVER, list(zip(*out))) if out else None

    for batch in batches:
        for r in batch.to_pylist():
            if windows > SORTED and (r["g1"], r["g2"]) != (held[-1]["g1"], held[-1]["g2"]):
                found = cover(held)
                held, windows = [], 0
                if found:
                    yield found
            held.append(r)
            windows += r["hi"] - r["lo"] + 1
    if held and (found := cover(held)):
        yield found


class Repeats:
    """One run over a table. Tables that later steps do not read are deleted on the way; the covers stay."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        small_batches()
        self.tables = Tables(docs.sparkSession)
        self.keep, self.drop = self.tables.keep, self.tables.drop
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.text = docs.select(text.alias("text"))
        self.rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", *key_columns(F.col("text")), "text")

    def texts(self) -> DataFrame:
        """(k1, k2, text, copies): the distinct texts; copies meet before the shuffle."""
        return self.rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    def covers(self) -> DataFrame:
        """(k1, k2, a, b): bytes a to b of a text are covered by repeated windows."""
        x = F.xxhash64("k1", "k2", "at")
        anchors = self.text.mapInArrow(_grams, "g long, k1 long, k2 long, at long").select("g", x.alias("x"))
        shared = self.keep(anchors.groupBy("g").agg(F.min("x").alias("x"), F.max("x").alias("y")).filter("x <> y").select("g"), "grams")
        spans = self.text.mapInArrow(_spans, "g long, sp long, k1 long, k2 long, at long, lo long, hi long")
        spans = self.keep(spans.join(shared, "g"), "spans")

        self.drop(shared)
        x = F.xxhash64("k1", "k2", "lo")
        distinct = spans.groupBy("g", "sp").agg(F.min(x).alias("x"), F.max(x).alias("y"))
        variety = distinct.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
        kinds = distinct.join(variety, "g").select("g", "sp", (F.col("x") != F.col("y")).alias("known"), F.col("x").alias("first"), "m")
        placed = self.keep(spans.join(kinds, ["g", "sp"]).select("g", "k1", "k2", "at", "lo", "hi", "known", "m", (x == F.col("first")).alias("is_first")), "placed")
        self.drop(spans)
        whole = placed.filter("known").select("k1", "k2", F.col("lo").alias("a"), (F.col("hi") + WINDOW).alias("b"))

        open_ones = placed.filter("m > 1 and (is_first or not known)").select("k1", "k2", F.struct("g", "at", "lo", "hi", "known", (F.col("m") > GROUP).alias("many")).alias("s"))
        lists = open_ones.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))  # as many as a text has anchors
        work = self.keep(lists.join(self.texts().select("k1", "k2", "text"), ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(_cut_spans, WORK), "work")
        found = [whole, self.in_tasks(work.filter("not many"))]

        # Groups that are too large for a task: first by runs of windows, then by single windows.
        large = work.filter("many")
        if not large.isEmpty():
            parts = self.keep(self.met(large.mapInArrow(_dealt(FRINGE), WORK)), "parts")
            found.append(self.in_tasks(parts.filter("not many")))
            single = self.met(parts.filter("many").mapInArrow(_dealt(1), WORK))
            found.append(single.filter("not known").select("k1", "k2", F.col("lo").alias("a"), (F.col("lo") + WINDOW).alias("b")))
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out

    @staticmethod
    def met(rows: DataFrame) -> DataFrame:
        """Rows whose group has two members at least; ``many`` says whether it is too large for a task."""
        sizes = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return rows.drop("many").join(sizes, ["g1", "g2"]).withColumn("many", F.col("n") > GROUP).select("g1", "g2", "k1", "k2", "at", "lo", "hi", "known", "many", "bytes")

    @staticmethod
    def in_tasks(rows: DataFrame) -> DataFrame:
        return rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_sorted_groups, COVER)


CLEANED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _clean(text: bytes, covers: list[tuple[int, int]]) -> tuple[int, int, int, str, bytes]:
    kept: list[bytes] = []
    at = removed = spans = 0
    end = -1
    for a, b in sorted(covers):
        if a > end:
            spans += 1
            kept.append(text[at:a])
        if b > end:
            removed += b - max(a, end)
            end = b
            at = b
    kept.append(text[at:])
    left = b"".join(kept)
    return len(text), removed, spans, hashlib.sha256(left).hexdigest(), left


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Texts are UTF-8 bytes; a null text is empty. Matches are judged on the input and never cross texts; a row
    whose text another row has too loses all of it if it is long enough. Ids may be null or repeat. ``kept``
    holds the bytes that stay, which need not be whole characters. Very long texts are handled whole, in blocks of
    windows that overlap. Other columns are not read. An empty table gives no rows.
    """
    run = Repeats(docs, id_col, text_col)
    covers = run.keep(run.covers().groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("covers")), "covers")
    run.tables.drop_all_but(covers)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, text, copies, spans in zip(*(batch.column(c) for c in ("k1", "k2", "text", "copies", "covers"))):
                raw = text.as_buffer().to_pybytes()
                pairs = [(s["a"], s["b"]) for s in spans.as_py() or []]
                if copies.as_py() > 1 and len(raw) >= WINDOW:
                    pairs = [(0, len(raw))]
                row = _clean(raw, pairs)
                out.append((k1.as_py(), k2.as_py(), *(row if with_bytes else row[:4])))
            schema = [("k1", I64), ("k2", I64), ("n_bytes", I64), ("n_removed", I64), ("n_spans", I64), ("kept_sha256", pa.string())]
            yield _batch(schema + [("kept", pa.binary())] * with_bytes, list(zip(*out)))

    kinds = CLEANED if with_bytes else CLEANED.rpartition(",")[0]
    cleaned = run.texts().join(covers, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "covers").mapInArrow(clean, f"k1 long, k2 long, {kinds}")
    out = run.rows.select("id", "k1", "k2").join(cleaned, ["k1", "k2"]).drop("k1", "k2")
    return out.withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every whole text of documents without its repeated 200-byte strings."""
    return remove_repeats(documents(spark, sf_dir), with_bytes=False)
