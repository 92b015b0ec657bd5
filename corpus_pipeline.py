"""A corpus pipeline of five stages; each works on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder
and reads it again for the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, language_id, near_duplicates, secret_scan, sentencepiece_codec
from larder.llm.common import documents, folders_of, remove_folder, shared_folder, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a determined language (null, empty and letterless texts among them), or with an unsure one, go.

    Ties between languages go to the first by name; repeated rows share their fate; null ids and languages are
    rows like any other; very long texts are scored whole; an empty table stays empty. Columns of any name pass.
    """
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near duplicates stays, that with the smallest id.

    Documents without words (null and empty texts) all stay; of rows with the same id and text one stays; a
    group without ids keeps that with the least digest. Very long texts count whole; an empty table stays
    empty. Columns of any name pass.
    """
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a passage of the benchmark go.

    Null and empty texts hold nothing and stay; repeated rows share their fate; very long texts are searched
    whole; an empty table stays empty, an empty benchmark leaves all. Columns of any name pass.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: secrets in the texts are replaced by a mark; n_chars follows the text, where there is such a column.

    A null text stays null with 0 characters. All rows and all other columns stay, whatever their names.
    """
    redacted = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token counts and digests of ids and decoded text of every document that is left; a null text counts as empty."""
    return sentencepiece_codec.round_trip(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokenize", tokenize),
]
#: Fitted weights, signatures and tokenizers are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A stage's own tables, and the result of the stage before it, go when its result is written.
    """
    folder = shared_folder(spark)
    docs = documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES):
        with folders_of(spark):
            docs = written(stage(spark, docs, sf_dir), folder, f"{n}-{name}")
        if n:
            remove_folder(spark, f"{folder}/{n - 1}-{STAGES[n - 1][0]}.parquet")
    return docs
