"""Token counts (operator 1): an exact length histogram answers every question about context limits.

Texts are encoded once; equal lengths aggregate before the shuffle, so what travels is one row per distinct
length and task. Suffix sums over the histogram give, for each length as a limit, the documents that reach it,
the tokens that a cut at it keeps and loses, and each document's quantile. The sums run in two levels (blocks
of lengths, then within a block), so that no task holds the histogram.
"""

from __future__ import annotations

import base64
import functools
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import Tables, documents, small_batches

#: Lengths in a block of the two-level sums.
BLOCK = 1024
#: A longer run of white space is encoded by itself: the library's pattern matcher keeps a frame for each of its
#: characters and overflows its stack at some hundred thousand.
LONG_WHITE = 10_000
_WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}+" % LONG_WHITE)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("larder", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(encoder, text: str) -> int:
    """How many tokens the library gives for the text.

    The pattern takes a run of white space up to its last character as one word, if something follows, and all
    of it at the end of the text. So the text may be cut there, and its parts counted alone.
    """
    if not text:
        return 0
    n = at = 0
    if len(text) > LONG_WHITE:
        for run in _WHITE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            n += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end].encode()))
            at = end
    return n + len(encoder.encode_ordinary(text[at:]))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row; a null or empty text has 0 tokens.

    Very long texts are encoded whole, long runs of white space by themselves; memory follows the longest text.
    Null ids and repeated rows are rows like any other. Other columns are not read, whatever their names. An
    empty table gives no rows.
    """
    path = ranks or default_ranks()
    small_batches()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoder = encoding(path)
        return texts.map(lambda x: n_tokens(encoder, x) if x else 0).astype("int64")

    return docs.select(F.col(id_col), count(F.col(text_col)).alias("n_tokens"))


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row per distinct length."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """What each distinct length means as a context limit.

    n_tokens (the limit), n_docs (of exactly that length), docs_over and tokens_over (documents longer than
    the limit, and all their tokens), kept_tokens (all documents cut at the limit), cut_tokens (lost by the
    cut), total_tokens, quantile (share of documents at most that long). An empty table gives no rows.
    """
    rows = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    per_block = rows.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    # Blocks are few (the longest length over BLOCK), so one task may sum them.
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = per_block.select(
        "block",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("b_docs").over(everything).alias("all_docs"),
        F.sum("b_tokens").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("docs_after")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("tokens_after")).alias("tokens_over"),
        "all_docs",
        "total_tokens",
    )
    cut = F.col("tokens_over") - F.col("n_tokens") * F.col("docs_over")
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        "tokens_over",
        (F.col("total_tokens") - cut).alias("kept_tokens"),
        cut.alias("cut_tokens"),
        "total_tokens",
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(summed: DataFrame, wanted: list[int]) -> DataFrame:
    """(context_limit, docs_over, kept_tokens, cut_tokens) for given limits, which need not be lengths that occur.

    Between two lengths nothing changes but the cut, so a limit takes the suffix sums of the longest length up
    to it: rows of ``limits`` meet the limits in one aggregation.
    """
    marks = sorted(set(wanted))
    spark = summed.sparkSession
    asked = spark.createDataFrame([(k, x) for k, x in enumerate(marks)], "place int, context_limit long")
    place = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in marks]), lambda x: x < F.col("n_tokens")))
    rows = summed.select(place.alias("place"), "n_tokens", "n_docs", "docs_over", "tokens_over", "total_tokens")
    best = rows.groupBy("place").agg(F.max_by(F.struct("docs_over", "tokens_over"), "n_tokens").alias("best"), F.sum("n_docs").alias("docs"))
    all_docs = F.coalesce(F.sum("docs").over(Window.partitionBy()), F.lit(0))
    total = rows.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"))
    # As many rows as there are limits, and one more.
    filled = asked.join(best, "place", "full_outer").withColumns({"all_docs": all_docs, "at": F.last("best", True).over(Window.orderBy("place"))}).filter("context_limit is not null")
    over, tokens = F.coalesce("at.docs_over", "all_docs"), F.coalesce("at.tokens_over", "total")
    cut = tokens - F.col("context_limit") * over
    return filled.join(F.broadcast(total)).select("context_limit", over.alias("docs_over"), (F.col("total") - cut).alias("kept_tokens"), cut.alias("cut_tokens"))


def lengths_at(summed: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, n_tokens): the least length that at least such a share of the documents does not exceed; null without documents."""
    found = summed.agg(*[F.min(F.when(F.col("quantile") >= q - 1e-12, F.col("n_tokens"))).alias(f"q{k}") for k, q in enumerate(quantiles)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q{k}").alias("n_tokens")) for k, q in enumerate(quantiles)])))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """What each length of an encoded document means as a context limit, over all documents; texts are encoded once."""
    hist = Tables(spark).keep(histogram(lengths(documents(spark, sf_dir))), "histogram")
    return limits(hist)
