"""License scans (operator 8): diagonal voting of word k-grams against notice templates.

Every rolling k-gram hash of a text's words joins the hashes of the templates. A hit at word p of the text and
word t of the template votes for diagonal p - t; neighbouring diagonals of a text and template merge, since a
word put in or left out moves the rest by one. A merged region is a match when its votes cover enough of the
template's words within a span that is not much longer than the template.

Only DataFrame functions are used. Votes are keyed by the digest of the text, so copies count once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import documents
from larder.llm.license_texts import TEMPLATES

#: Fixed values of the contract: phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
K = 3
#: Diagonals at most this far apart belong to one region.
NEAR = 2
#: Share of the template's words that must be covered, and how much longer than the template a span may be.
LEAST_COVERED, MOST_STRETCH = 0.8, 1.25

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; for ASCII texts that is what lower() does, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BREAKS), "")


def _with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.md5(text.cast("binary")).alias("_key"), words(text).alias("_w"))


def _gram(at: Column, w: Column) -> Column:
    return F.xxhash64(*[F.get(w, at + i) for i in range(K)])


#: Words that all templates of a table may have together: they go to every task.
MOST_TEMPLATE_WORDS = 2_000_000


def built_in_templates(spark) -> DataFrame:
    """(label, text): notices and whole texts of common licenses."""
    return spark.createDataFrame(list(TEMPLATES), "label string, text string")


def _grams_of(templates: DataFrame) -> DataFrame:
    """(template, label, length, t, gram, word) of a table (label, text) whose size is checked; templates shorter than a gram,
    or without text, are left out, equal ones kept once."""
    table = templates.select("label", words(F.coalesce("text", F.lit(""))).alias("_w")).filter((F.size("_w") >= K) & F.col("label").isNotNull())
    total = table.agg(F.coalesce(F.sum(F.size("_w")), F.lit(0)).alias("n")).first()["n"]
    if total > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {total} words; split the table, {MOST_TEMPLATE_WORDS} may go to every task")
    table = table.withColumn("template", F.md5(F.concat_ws(" ", "label", F.array_join("_w", " ")).cast("binary"))).dropDuplicates(["template"])
    grams = F.transform(F.sequence(F.lit(0), F.size("_w") - K), lambda i: F.struct(_gram(i, F.col("_w")).alias("gram"), F.get("_w", i).alias("word")))
    return table.select("template", "label", F.size("_w").alias("length"), F.posexplode(grams).alias("t", "g")).select("template", "label", "length", "t", "g.gram", "g.word")


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """Verified regions: (_key, label, template, first_word, last_word, score) for each distinct text.

    Votes are verified word by word: a hit counts only if the text has the template's very word there. A region
    is a match if its votes cover ``LEAST_COVERED`` of the template's words in a span that is not stretched.
    """
    base = _with_words(docs, id_col, text_col).filter(F.size("_w") >= K)
    grams = F.transform(F.sequence(F.lit(0), F.size("_w") - K), lambda i: F.struct(_gram(i, F.col("_w")).alias("gram"), F.get("_w", i).alias("said")))
    known = _grams_of(built_in_templates(docs.sparkSession) if templates is None else templates)
    hits = base.select("_key", F.posexplode(grams).alias("p", "g")).select("_key", "p", "g.gram", "g.said").join(F.broadcast(known), "gram").filter("said = word")
    votes = hits.select("_key", "template", "label", "length", (F.col("p") - F.col("t")).alias("diagonal"), "t").distinct()
    lines = votes.groupBy("_key", "template", "label", "length", "diagonal").agg(F.collect_set("t").alias("ts"))  # at most a template's words
    along = Window.partitionBy("_key", "template").orderBy("diagonal")
    parted = lines.withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(along) <= NEAR).eqNullSafe(True).cast("int"))
    regions = parted.withColumn("_region", F.sum(1 - F.col("_new")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    by_region = regions.groupBy("_key", "template", "label", "length", "_region").agg(
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"),
        F.min(F.col("diagonal") + F.array_min("ts")).alias("first_word"),
        (F.max(F.col("diagonal") + F.array_max("ts")) + (K - 1)).alias("last_word"),
    )
    found = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (K - 1)))))
    scored = by_region.withColumn("score", F.size(found) / F.col("length"))
    fits = (F.col("score") >= LEAST_COVERED) & (F.col("last_word") - F.col("first_word") + 1 <= F.greatest(F.col("length") * MOST_STRETCH, F.col("length") + NEAR))
    return scored.filter(fits).select("_key", "label", "template", "first_word", "last_word", "score")


def _places(phrase: str, text: Column, w: Column) -> Column:
    """Word numbers where the phrase starts; looked for only where the text holds all its words at all."""
    parts = phrase.split(" ")
    at_least = reduce(lambda a, b: a & b, [F.contains(text, F.lit(p)) for p in parts])

    def starts(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(w, i + k) == p for k, p in enumerate(parts)])

    none = F.array().cast("array<int>")
    return F.when(at_least & (F.size(w) >= len(parts)), F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), starts)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Word numbers count from 0. Without a phrase first_word and last_word are null and base_labels is empty;
    score is the best covered share of a matched template, 0 without one. ``templates`` is a table (label, text);
    without it the built-in ones count. A null or empty text has no words. Very long texts are scanned whole;
    what they vote for is bounded by the templates' words. Ids may be null or repeat, repeated rows repeat;
    other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.md5(text.cast("binary")).alias("_key"), lowered(text).alias("_low"), words(text).alias("_w"))
    for n, (phrase, _) in enumerate(PHRASES):
        rows = rows.withColumn(f"_p{n}", _places(phrase, F.col("_low"), F.col("_w")))
    spots = F.concat(*[F.col(f"_p{n}") for n in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_p{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(PHRASES)]))
    base = rows.select(
        id_col,
        "_key",
        F.size("_w").cast("long").alias("n_words"),
        F.size(spots).cast("long").alias("n_base"),
        F.array_min(spots).cast("long").alias("first_word"),
        F.array_max(spots).cast("long").alias("last_word"),
        labels.alias("_base"),
    )
    per_text = matches(docs, id_col, text_col, templates).groupBy("_key").agg(F.collect_set("label").alias("_more"), F.max("score").alias("_score"))
    both = F.concat(F.col("_base"), F.coalesce(F.col("_more"), F.array().cast("array<string>")))
    return base.join(per_text, "_key", "left").select(
        id_col,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"),
        F.coalesce(F.col("_score"), F.lit(0.0)).alias("score"),
    )


def words_of(text: str | None) -> list[str]:
    """The same words in plain Python, for tests."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and license texts in every whole text of documents."""
    return scan(documents(spark, sf_dir))
