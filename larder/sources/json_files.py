"""JSON files of any size as many small documents of the same shape, so that every parser of JSON texts can take them.

A file is read by Spark's text reader, which deals it to tasks at bytes and cuts it after closing braces. A scan gives for each part how many
quotes and brackets it holds, windows over the parts of a file tell where each begins (depth, in a text or not), and another scan cuts
items. An item that lies across parts is put together from its pieces; nothing else is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, COMMA, BACKSLASH = b'",\\'
STEP = np.zeros(256, dtype=np.int64)
STEP[list(b"{[")] = 1
STEP[list(b"}]")] = -1
MARK = STEP != 0
MARK[[QUOTE, COMMA]] = True
ENTRY = re.compile(rb'"(?:[^"\\]|\\.)*"[ \t\r\n]*:', re.DOTALL)
KEY_END = re.compile(rb'"[ \t\r\n]*:[ \t\r\n]*\Z')
WHITE = " \t\r\n"
PART = "file string, part long"


def parts_of(spark: SparkSession, path: str, part_bytes: int) -> DataFrame:
    """(file, part, file_size, n, text): what stands before each closing brace, in the order of the file within a part.

    Two scans must see equal parts, so the sizes are those of a session of its own and do not hang on the number of cores.
    """
    pinned = spark.newSession()
    for key, setting in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            pinned.conf.set(key, setting)
    pinned.conf.set("spark.sql.files.minPartitionNum", "1")
    pinned.conf.set("spark.sql.files.maxPartitionBytes", str(part_bytes))
    pinned.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    meta = F.col("_metadata")
    text = pinned.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    return text.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("part"), meta["file_size"].alias("file_size"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("text")
    )


def buffers(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, bytes]]:
    """Runs of rows of one part: the first row and the text of all, with their closing braces. Rows out of order are an error."""
    last = (None, None, None)
    for batch in batches:
        change = (batch["file"] != batch["file"].shift()) | (batch["part"] != batch["part"].shift())
        for _, run in batch.groupby(change.cumsum(), sort=False):
            first, end = run.iloc[0], run.iloc[-1]
            if not (np.diff(run["n"]) == 1).all() or (last[:2] == (first["file"], first["part"]) and last[2] + 1 != first["n"]):
                raise ValueError(f"lines of {first['file']} came out of order")
            last = (end["file"], end["part"], end["n"])
            yield first, b"}".join(run["text"]) + b"}"


def marks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and bytes of brackets and commas, for each the quotes before it modulo 2, and that number for all.
    A text begins after a closing brace, which no backslash escapes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    at = np.flatnonzero(MARK[data])
    quote = data[at] == QUOTE
    if BACKSLASH in raw:
        for k in np.flatnonzero(quote & (at > 0) & (data[at - 1] == BACKSLASH)):
            begin = at[k]
            while begin > 0 and raw[begin - 1] == BACKSLASH:
                begin -= 1
            quote[k] = (at[k] - begin) % 2 == 0
        keep = quote | (data[at] != QUOTE)
        at, quote = at[keep], quote[keep]
    parity = np.cumsum(quote) & 1
    return at[~quote], data[at[~quote]], parity[~quote], int(parity[-1]) if len(parity) else 0


def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, part, file_size, n_bytes, flips, outside, quoted): for each run of a part its bytes, quotes modulo 2, and the change of
    depth if it begins outside a text or in one."""
    for first, raw in buffers(batches):
        _, kind, parity, flips = marks(raw)
        step = STEP[kind]
        yield pd.DataFrame([(first["file"], first["part"], first["file_size"], first["n"], len(raw), flips, step[parity == 0].sum(), step[parity == 1].sum())])


def starts(text: DataFrame) -> DataFrame:
    """(file, part, depth, quoted): where the parts begin. A file that ends within a text or a bracket is an error."""
    runs = text.mapInPandas(sums, f"{PART}, file_size long, n long, n_bytes long, flips long, outside long, within long")
    before_run = Window.partitionBy("file", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("flips").over(before_run), F.lit(0)) % 2 == 1
    runs = runs.select("*", odd.alias("odd")).select(
        "file", "part", "file_size", "n_bytes", "flips", F.when(F.col("odd"), F.col("within")).otherwise(F.col("outside")).alias("outside"), F.when(F.col("odd"), F.col("outside")).otherwise(F.col("within")).alias("within")
    )
    parts = runs.groupBy("file", "part").agg(F.max("file_size").alias("file_size"), *[F.sum(c).alias(c) for c in ("n_bytes", "flips", "outside", "within")])
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    parts = parts.withColumn("quoted", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int"))
    parts = parts.withColumn("step", F.when(F.col("quoted") == 1, F.col("within")).otherwise(F.col("outside")))
    parts = parts.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    # Each line counts with its closing brace; the last one has none if there is a byte more than the file has (3 fewer with a byte order mark).
    added = (F.sum("n_bytes").over(whole) - F.col("file_size")).isin(1, -2)
    closed = (F.sum("flips").over(whole) % 2 == 0) & (F.sum("step").over(whole) == F.when(added, -1).otherwise(0))
    return parts.select("file", "part", F.when(closed, F.col("depth")).otherwise(F.raise_error(F.concat(F.lit("not a whole JSON text: "), "file"))).alias("depth"), "quoted")


def is_key(raw: bytes, at: int, key: str) -> bool:
    """Whether a bracket follows a key. The key has no closing brace, so it lies in the same line as its bracket."""
    head = raw[max(0, raw.rfind(b"}", 0, at)) : at]
    end = KEY_END.search(head)
    if end is None:
        return False
    begin = end.start()
    while (begin := head.rfind(b'"', 0, begin)) >= 0:
        slashes = len(head[:begin]) - len(head[:begin].rstrip(b"\\"))
        if slashes % 2 == 0:
            return json.loads(head[begin : end.start() + 1]) == key
    return False


class Cutter:
    """Goes through one part, which begins at a depth, and cuts it at the commas and brackets of the wanted list or object."""

    def __init__(self, row: pd.Series, key: str | None):
        self.key, self.level = key, 1 if key is None else 2
        self.depth, self.quoted = int(row["depth"]), int(row["quoted"])
        self.within = self.depth >= self.level and (key is None or bool(row["within"]))
        self.met = None  # whether the last list or object that began here is the wanted one
        self.cut = False  # whether an item began in this part
        self.rest: list[bytes] = []

    def feed(self, raw: bytes) -> Iterator[tuple[bool, bytes]]:
        """(whole, item) for each item that ends here; one that began in a part before is not whole."""
        at, kind, parity, flips = marks(raw)
        free = parity == self.quoted
        at, kind = at[free], kind[free]
        step = STEP[kind]
        depth = self.depth + np.cumsum(step)
        opens, closes = (step == 1) & (depth == self.level), (step == -1) & (depth == self.level - 1)
        begin = 0
        for k in np.flatnonzero(opens | closes | ((kind == COMMA) & (depth == self.level))):
            place = int(at[k])
            if opens[k]:
                self.within = self.met = self.key is None or is_key(raw, place, self.key)
            elif self.within:
                yield self.cut, b"".join([*self.rest, raw[begin:place]])
                self.within = not closes[k]
            self.cut = self.cut or self.within
            self.rest, begin = [], place + 1
        if self.within:
            self.rest.append(raw[begin:])
        self.depth, self.quoted = int(depth[-1]) if len(depth) else self.depth, self.quoted ^ flips


def cutters(batches: Iterator[pd.DataFrame], key: str | None) -> Iterator[tuple[pd.Series, Cutter, bytes | None]]:
    """The texts of each part with its cutter; None for the text when the part has ended."""
    now, cutter = None, None
    for first, raw in buffers(batches):
        if now is None or (first["file"], first["part"]) != (now["file"], now["part"]):
            if cutter is not None:
                yield now, cutter, None
            now, cutter = first, Cutter(first, key)
        yield now, cutter, raw
    if cutter is not None:
        yield now, cutter, None


def json_documents(spark: SparkSession, path: str, at: str | None = None, document_bytes: int = 1 << 20, part_bytes: int = 32 << 20) -> DataFrame:
    """(value): JSON documents of some ``document_bytes`` with the items of the list or object that fills a file, or stands under the key
    ``at`` of the object that does. Each is of the same shape, so ``json_items`` and ``json_entries`` read it alike.

    Files of a folder are read each in parts of ``part_bytes``, all but a compressed one; three scans, or four with a key. What stands beside the
    items is left out; of equal keys all count; an empty file, list or object gives no documents. Items are held in memory one by one. A file
    without closing braces is one line and one task.
    """
    if at is not None and "}" in at:
        raise ValueError("the key must not hold a closing brace")
    text = parts_of(spark, path, part_bytes)
    # One row a part: some 100 bytes for each 32 MB, so it may be broadcast.
    state = starts(text).withColumn("within", F.lit(True)).checkpoint()
    where = ["file", "part"]

    def placed(state: DataFrame) -> DataFrame:
        missing = F.raise_error(F.concat(F.lit("parts changed between scans: "), "file"))
        rows = text.join(F.broadcast(state), where, "left")
        return rows.select(*where, "n", "text", F.coalesce("depth", missing).alias("depth"), "quoted", "within")

    def last_met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, cutter, raw in cutters(batches, at):
            if raw is None:
                yield pd.DataFrame([(row["file"], row["part"], None if cutter.met is None else float(cutter.met))])
            else:
                for _ in cutter.feed(raw):
                    pass

    if at is not None:
        met = placed(state).mapInPandas(last_met, f"{PART}, met double")
        before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.last("met", ignorenulls=True).over(before) == 1, F.lit(False))
        state = state.drop("within").join(met.select(*where, within.alias("within")), where).checkpoint()

    head, tail = (b"", b"") if at is None else (b"{" + json.dumps(at).encode() + b":", b"}")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bool, list[bytes]] = {False: [], True: []}

        def document(entries: bool) -> pd.DataFrame:
            left, right = (b"{", b"}") if entries else (b"[", b"]")
            whole = b"".join((head, left, b",".join(kept[entries]), right, tail))
            kept[entries] = []
            return pd.DataFrame({"value": [whole]})

        size = 0
        for _, cutter, raw in cutters(batches, at):
            for whole, item in cutter.feed(raw) if raw is not None else ():
                item = item.strip()
                if whole and item:
                    entries = ENTRY.match(item) is not None
                    kept[entries].append(item)
                    size += len(item)
                    if size >= document_bytes:
                        yield from (document(e) for e in (False, True) if kept[e])
                        size = 0
        yield from (document(e) for e in (False, True) if kept[e])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, cutter, raw in cutters(batches, at):
            if raw is not None:
                ends = [item for whole, item in cutter.feed(raw) if not whole]
                found = [(0, False, item) for item in ends]
            else:
                found = [(1, cutter.cut, b"".join(cutter.rest))] if cutter.within else []
            if found:
                yield pd.DataFrame([(row["file"], row["part"], *f) for f in found])

    whole = placed(state).mapInPandas(documents, "value binary").select(F.col("value").cast("string").alias("value"))
    torn = placed(state).mapInPandas(pieces, f"{PART}, k int, begins boolean, piece binary")
    in_file = Window.partitionBy("file").orderBy("part", "k")
    torn = torn.withColumn("item", F.sum(F.col("begins").cast("long")).over(in_file)).withColumn("piece", F.col("piece").cast("string"))
    mended = torn.groupBy("file", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "piece"))), lambda p: p["piece"]), "").alias("piece"))
    item = F.btrim("piece", F.lit(WHITE))
    entry = item.rlike(r'^(?s)"(?:[^"\\]|\\.)*+"[ \t\r\n]*:')
    wrapped = F.concat(F.lit(head.decode()), F.when(entry, "{").otherwise("["), item, F.when(entry, "}").otherwise("]"), F.lit(tail.decode()))
    return whole.unionAll(mended.filter(item != "").select(wrapped.alias("value")))
