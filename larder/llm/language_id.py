"""Language ID (operator 7): sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams of the whole text in lower case; a text's weight for a feature is its
share of the text's n-grams times the inverse document frequency. Document frequencies come from all texts
that may be learned from, counted in Spark. The weights are learned by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of labelled texts (``Settings.sample``), and a temperature, fitted on
texts of the sample that the weights have not seen, calibrates the scores. Prediction is a sum of table
entries over the text, so every text is scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import documents, give_back, in_chunks, small_batches, whole_row

UNDETERMINED = "und"
#: Characters of texts that are worked on together; a task holds some hundred bytes for each.
CHUNK = 200_000


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    #: Bounds of the sample that is learned from: labelled texts of one language, characters taken of one text and
    #: characters of all together. More languages than ``languages`` are an error: none is left out silently.
    sample: int = 600
    text_chars: int = 40_000
    sample_chars: int = 12_000_000
    languages: int = 500
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2e-4
    l2: float = 1e-4
    #: One text in so many of the sample is kept for the temperature.
    calibration: int = 5

    @property
    def buckets(self) -> int:
        return 1 << self.bits


def features(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text, one text after the other, and the number of n-grams of each."""
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    shift = np.uint32(32 - settings.bits)
    text_ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(flat))
    parts, owners = [], []
    hashed = flat * np.uint32(0x9E3779B1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for n in range(1, max(settings.orders) + 1):
        if n > 1:
            hashed = hashed[:-1] * np.uint32(0x85EBCA77) + flat[n - 1 :] * np.uint32(0x9E3779B1)
        if n in settings.orders:
            inside = at[: len(hashed)] + n <= text_ends[: len(hashed)]
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + np.uint32(n * 0x27D4EB2F % 2**32)
            parts.append((mixed >> shift)[inside])
            owners.append(owner[: len(hashed)][inside])
    return np.concatenate(parts), np.concatenate(owners)


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    idf: np.ndarray  # buckets
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    @cached_property
    def table(self) -> np.ndarray:
        return self.idf[:, None] * self.weights

    def logits(self, texts: list[str]) -> np.ndarray:
        bucket, owner = features(texts, self.settings)
        table = self.table
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        out = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, table[:, k][bucket], minlength=len(texts)) / n + self.bias[k]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return [self.languages[k] for k in best], p[np.arange(len(texts)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5; texts with remainder 0 are held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def document_frequencies(texts: DataFrame, text_col: str, lang_col: str, settings: Settings) -> tuple[np.ndarray, int, dict[str, int]]:
    """In how many texts each bucket occurs, the number of texts, and that of each language.

    One pass; what travels is a row per task and bucket or language. More languages than the settings allow are an error.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(settings.buckets, np.int64)
        langs: dict[str, int] = {}
        n_texts = 0
        for batch in batches:
            n_texts += len(batch)
            for lang, n in batch[lang_col].value_counts().items():
                langs[lang] = langs.get(lang, 0) + n
            for chunk in in_chunks(batch[text_col].tolist(), CHUNK):
                bucket, owner = features(chunk, settings)
                for first in range(0, len(chunk), 512):  # a block of texts at a time bounds the table
                    mine = slice(None) if len(chunk) <= 512 else (owner >= first) & (owner < first + 512)
                    seen = np.zeros((512, settings.buckets), bool)
                    seen[owner[mine] - first, bucket[mine]] = True
                    total += seen.sum(0)
        names = list(langs)
        yield pd.DataFrame({"bucket": [*range(settings.buckets), *[-1] * len(names), -2], "lang": [None] * settings.buckets + names + [None], "n": [*total.tolist(), *[langs[x] for x in names], n_texts]})

    small_batches()
    counts = texts.select(text_col, lang_col).mapInPandas(count, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
    # One row for each bucket, one for the number of texts, one for each language and one that tells of more.
    kept = counts.orderBy(F.col("bucket") == -1, F.desc("n")).limit(settings.buckets + 2 + settings.languages)
    df = np.zeros(settings.buckets, np.int64)
    n, langs = 0, {}
    for r in kept.collect():  # as many rows as buckets and languages
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
        elif r["bucket"] == -1:
            langs[r["lang"]] = r["n"]
        else:
            n = r["n"]
    if len(langs) > settings.languages:
        raise ValueError(f"more than {settings.languages} languages among the labels; set Settings.languages to learn them all")
    return df, n, langs


def split(samples: list[tuple[str, str]], settings: Settings) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Texts to learn from and texts for the temperature: of each language one in ``calibration``, never the first."""
    seen: dict[str, int] = {}
    parts: tuple[list, list] = ([], [])
    for text, lang in samples:
        seen[lang] = seen.get(lang, 0) + 1
        parts[seen[lang] % settings.calibration == 0].append((text, lang))
    return parts


def train(samples: list[tuple[str, str]], idf: np.ndarray, settings: Settings) -> Model:
    """Follow the regularised leader, one text at a time, in the given order; deterministic."""
    languages = sorted({lang for _, lang in samples})
    c = len(languages)
    fit, held = split(samples, settings)
    z = np.zeros((settings.buckets + 1, c))
    n = np.zeros((settings.buckets + 1, c))

    def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
        bucket, _ = features([text], settings)
        where, count = np.unique(bucket, return_counts=True)
        return np.append(where, settings.buckets), np.append(count / len(bucket) * idf[where], 0.05)

    def weights(where) -> np.ndarray:
        small = np.abs(z[where]) <= settings.l1
        return np.where(small, 0.0, (np.sign(z[where]) * settings.l1 - z[where]) / ((settings.beta + np.sqrt(n[where])) / settings.alpha + settings.l2))

    vectors = [(vector(t), languages.index(lang)) for t, lang in fit]
    # The coordinates are small shares; their step sizes follow their own gradients.
    for _ in range(settings.epochs):
        for (where, x), y in vectors:
            w = weights(where)
            p = softmax((x @ w)[None] * 1.0)[0]
            p[y] -= 1.0
            g = x[:, None] * p * SCALE
            s = (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / settings.alpha
            z[where] += g - s * w
            n[where] += g * g
    w = weights(slice(None))
    model = Model(settings, languages, idf, w[:-1].astype(np.float64), 0.05 * w[-1])
    if held and c > 1:
        model.temperature = calibrate(model.logits([t for t, _ in held]), np.array([languages.index(x) for _, x in held]))
    return model


#: Gradients are scaled so that typical coordinates (shares of a text) take steps of a useful size.
SCALE = 100.0


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    a, b = -4.0, 4.0
    ratio = (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        if loss(c) < loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


#: Digests of rows are numbers of so many bits.
ORDER_BITS = 60


def chosen(candidates: list[tuple[str, int, int]], settings: Settings) -> list[int]:
    """Digests of the texts of one language to learn from: the first by digest, without those whose characters no longer fit."""
    languages = len({lang for lang, _, _ in candidates})
    out, used, left = [], {}, {}
    for lang, order, size in sorted(candidates):
        size = min(size, settings.text_chars)
        budget = left.setdefault(lang, max(settings.sample_chars // languages, settings.text_chars))
        if used.get(lang, 0) < settings.sample and size <= budget:
            used[lang] = used.get(lang, 0) + 1
            left[lang] = budget - size
            out.append(order)
    return out


def sample(rows: DataFrame, langs: dict[str, int], settings: Settings) -> list[tuple[str, str]]:
    """(text, lang) to learn from, in the order of a digest of the row.

    Rows under a threshold of the digest, which follows from the count of their language, are looked at by
    digest and length alone; then only the chosen texts, cut to ``text_chars``, come to the driver. So what it
    receives is bounded by the settings, whatever the input.
    """
    if not langs:
        return []
    spark = rows.sparkSession
    # Half as many again as wanted, and some more: fewer than wanted is as good as out of the question.
    share = [(x, int(min(1.0, (1.5 * settings.sample + 50) / n) * 2**ORDER_BITS)) for x, n in langs.items()]
    marks = F.broadcast(spark.createDataFrame(share, "_lang string, _most long"))
    order = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text"), 64 - ORDER_BITS)
    low = rows.withColumn("_order", order).join(marks, "_lang").filter(F.col("_order") < F.col("_most"))
    narrow = low.groupBy("_lang", "_order").agg(F.max(F.length("_text")).alias("n"))
    picked = chosen([(r["_lang"], r["_order"], r["n"]) for r in narrow.collect()], settings)
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in picked], "_order long"))
    texts = low.join(wanted, "_order").select("_lang", "_order", F.substring("_text", 1, settings.text_chars).alias("_text"))
    found = texts.groupBy("_order", "_lang").agg(F.min("_text").alias("_text")).collect()
    return [(r["_text"], r["_lang"]) for r in sorted(found, key=lambda r: (r["_order"], r["_lang"]))]


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows that are not held out and have text and language."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).filter((remainder(F.col("_id")) != 0) & F.col("_text").isNotNull() & F.col("_lang").isNotNull())
    df, n, langs = document_frequencies(rows, "_text", "_lang", settings)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    return train(sample(rows, langs, settings), idf, settings)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predicted(model: Model, text: Column, spark) -> Column:
    """A struct of lang_pred and score for a column of texts."""
    shared = spark.sparkContext.broadcast(model)
    small_batches()

    @F.pandas_udf(PREDICTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = shared.value
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for chunk in in_chunks(("" if x is None else x for x in batch), CHUNK):
                lang, score = one.predict(chunk)
                for t, a, b in zip(chunk, lang, score):
                    known = has_letter(t)
                    langs.append(a if known else UNDETERMINED)
                    scores.append(float(b) if known else 0.0)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        give_back()

    return run(text)


def identify(docs: DataFrame, model: Model | None = None, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing can be
    learned. Ties go to the first language by name. Null ids count as empty text when rows are held out;
    repeated rows repeat. Very long texts are scored whole; memory follows the longest. Columns beside id, text
    and language are not read, whatever their names. An empty table gives no rows.
    """
    model = model or fit(docs, settings, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col), (remainder(F.col(id_col)) == 0).alias("held_out"), predicted(model, F.col(text_col), docs.sparkSession).alias("r"))
    return out.select(id_col, "held_out", "r.lang_pred", "r.score")


def keep_identified(docs: DataFrame, least_score: float = 0.5, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is determined with at least this score.

    Null, empty and letterless texts go, and all rows of a table from which nothing can be learned. Columns of
    any name pass through.
    """
    r = predicted(fit(docs, settings, id_col, text_col, lang_col), F.col(text_col), docs.sparkSession)
    kept = docs.select(whole_row(docs).alias("row"), r.alias("language"))
    return kept.filter((F.col("language.lang_pred") != UNDETERMINED) & (F.col("language.score") >= least_score)).select("row.*")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    return identify(documents(spark, sf_dir))
