"""Sharding (operator 5): a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of a digest of the row, whose leading hex digits deal them into buckets:
counts of buckets, summed over the few buckets, plus the place inside a bucket give the number without ever
sorting the table in one task. The permutation works on pairs (left, right) of a grid a x b that holds N cells
and as few more as can be; a number that leaves 0..N-1 is permuted again until it is back, which takes at most
one step for each spare cell. Place p of the permutation lies in shard p mod shards, slot p div shards, so
shard sizes differ by one at most, and both can be computed, or inverted, for a single row number.

Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import documents

ROUNDS = 6
SHARDS = 40
SEED = "larder"
#: Rows that a bucket of the numbering should have at most; buckets go by leading hex digits of a row's digest.
BUCKET_ROWS = 1_000_000
LEAST_DIGITS, MOST_DIGITS = 3, 5
#: Identical rows are numbered as one range; a longer range is cut into pieces of so many, which are dealt to tasks.
RANGE = 100_000


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of a grid with a * b >= n and the fewest spare cells, a near the root of n."""
    root = max(1, isqrt(n))
    sides = range(max(1, root - 200_000, root // 2), root + 1)
    a = min(sides, key=lambda s: (-n % s, root - s))
    return a, -(-n // a) if n else 1


def _mix(k: int, seed: str, value: int) -> int:
    return int(hashlib.md5(f"{seed}:{k}:{value}".encode()).hexdigest()[:15], 16)


def place(number: int, n: int, seed: str = SEED) -> int:
    """Where one row number goes; the same arithmetic as the columns below."""
    a, b = grid(n)
    while True:
        left, right = number % a, number // a
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = (left + _mix(k, seed, right)) % a
            else:
                right = (right + _mix(k, seed, left)) % b
        number = left + a * right
        if number < n:
            return number


def number_at(spot: int, n: int, seed: str = SEED) -> int:
    """The row number that a place holds: the rounds in reverse."""
    a, b = grid(n)
    while True:
        left, right = spot % a, spot // a
        for k in reversed(range(ROUNDS)):
            if k % 2 == 0:
                left = (left - _mix(k, seed, right)) % a
            else:
                right = (right - _mix(k, seed, left)) % b
        spot = left + a * right
        if spot < n:
            return spot


def _mixed(k: int, seed: str, value: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:{k}:"), value.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted(rows: DataFrame, number: str, n: int, seed: str = SEED) -> DataFrame:
    """``rows`` with a column ``place``: the number permuted within 0..n-1."""
    a, b = grid(n)
    kept = rows.columns
    out = rows.withColumn("place", F.col(number))
    for step in range(a * b - n + 1):
        inside = F.col("place") < n if step else F.lit(False)
        out = out.withColumns({"_left": F.col("place") % a, "_right": F.expr(f"place div {a}")})
        for k in range(ROUNDS):
            if k % 2 == 0:
                out = out.withColumn("_left", (F.col("_left") + _mixed(k, seed, F.col("_right"))) % a)
            else:
                out = out.withColumn("_right", (F.col("_right") + _mixed(k, seed, F.col("_left"))) % b)
        out = out.withColumn("place", F.when(inside, F.col("place")).otherwise(F.col("_left") + a * F.col("_right")))
    return out.select(*kept, "place")


def bucket_digits(n: int) -> int:
    """Digits with which n rows fall into buckets of ``BUCKET_ROWS`` at most, within bounds: one task sums the buckets."""
    digits = LEAST_DIGITS
    while digits < MOST_DIGITS and n > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def numbered(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, number): all n rows, numbered from 0 in an order that depends on the rows alone.

    Rows that agree in id and text are interchangeable; they are counted before the shuffle and get
    consecutive numbers, so that many repeated rows do not meet in one task one by one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).alias("_bytes"), F.crc32(text.cast("binary")).alias("_crc"), F.md5(text.cast("binary")).alias("_text"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("_bytes"), F.col("_crc"), F.col("_text")).cast("binary"))
    counted = plain.withColumn("_key", digest).groupBy("_key", "_id", "_bytes", "_crc").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", F.substring("_key", 1, bucket_digits(n)))
    per_bucket = counted.groupBy("_bucket").agg(F.sum("_n").alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over 16 ** MOST_DIGITS rows at most
    offsets = per_bucket.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counted.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(F.broadcast(offsets), "_bucket")
    ranges = ranges.select("_id", "_bytes", "_crc", "_n", (F.col("_before") + F.col("_offset")).alias("_from"))
    out = _spread(ranges.filter(F.col("_n") <= RANGE))
    long = ranges.filter(F.col("_n") > RANGE)
    starts = F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1, F.lit(RANGE)))
    pieces = long.withColumns({"_end": F.col("_from") + F.col("_n")}).withColumn("_piece", starts)
    pieces = pieces.select("_id", "_bytes", "_crc", F.least(F.lit(RANGE), F.col("_end") - F.col("_piece")).alias("_n"), F.col("_piece").alias("_from"))
    out = out.unionByName(_spread(pieces.repartition("_from")))
    return out.select(F.col("_id").alias(id_col), (F.col("_bytes") + 16).cast("long").alias("size"), F.col("_crc").alias("text_crc32"), "number")


def _spread(ranges: DataFrame) -> DataFrame:
    """A row for each number of a range."""
    return ranges.select("_id", "_bytes", "_crc", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_n") - 1)).alias("number"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    The law is ``rows``: shard counts differ by one at most. A null text has size 16 and the checksum of no
    bytes; null and repeated ids are rows like any other; very long texts count by their digest; other columns
    are not read; an empty table gives no rows.
    """
    n = docs.count()
    placed = permuted(numbered(docs, n, id_col, text_col), "number", n, seed)
    return placed.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, by the law ``rows``."""
    return shard(documents(spark, sf_dir))
