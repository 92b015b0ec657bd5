"""Readers of files into records. Each gives one row for each record and leaves all else to column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files(spark: SparkSession, path: str, pattern: str = "*", encoding: str = "UTF-8") -> DataFrame:
    """(path, value): every file of a tree whose name fits, whole. The path is relative to the tree."""
    read = spark.read.option("pathGlobFilter", pattern).option("encoding", encoding).text(path, wholetext=True, recursiveFileLookup=True)
    return read.select(relative(F.col("_metadata.file_path"), path).alias("path"), "value")


def relative(file: Column, root: str) -> Column:
    """A file's path below a root folder, decoded."""
    plain = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    base = root.rstrip("/").rpartition("://")[2].lstrip("/")
    return F.regexp_replace(F.substring_index(plain, base + "/", -1), "^/+", "")


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(value): the lines of a text; splits of a large file are read by many tasks."""
    return spark.read.option("encoding", encoding).text(path)


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(value): blocks of lines between empty lines."""
    return spark.read.option("lineSep", "\n\n").text(path).filter(F.col("value").rlike(r"\S"))


def json_items(documents: DataFrame, item: str, *at: str) -> DataFrame:
    """(item): the elements of a list in JSON texts (column ``value``); ``at`` leads to it, ``item`` is its schema."""
    schema = f"array<{item}>"
    for key in reversed(at):
        schema = f"struct<`{key}`:{schema}>"
    if not at:
        found = F.from_json("value", schema)
    else:
        found = F.from_json("value", schema)
        for key in at:
            found = found[key]
    return documents.select(F.explode(found).alias("item"))


def json_entries(documents: DataFrame, item: str, *at: str) -> DataFrame:
    """(key, item): the entries of an object in JSON texts."""
    schema = f"map<string,{item}>"
    for key in reversed(at):
        schema = f"struct<`{key}`:{schema}>"
    found = F.from_json("value", schema)
    for key in at:
        found = found[key]
    return documents.select(F.explode(found).alias("key", "item"))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements with a tag, anywhere in the files of a path; namespaces of names are cut off."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).option("attributePrefix", "_").option("valueTag", "_VALUE").schema(schema).load(path)


def xml_items(documents: DataFrame, schema: str) -> DataFrame:
    """(item): XML texts (column ``value``) that are one element each."""
    options = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}
    return documents.select(F.from_xml("value", schema, options).alias("item"), *[c for c in documents.columns if c != "value"])


def sqlite_rows(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query on a SQLite file that the executors see; they pass in batches, never through the driver."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for batch in batches:
            for file in batch["path"]:
                with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
                    yield from pd.read_sql_query(query, db, chunksize=10_000)

    return spark.createDataFrame([(path,)], "path string").mapInPandas(read, T._parse_datatype_string(schema))


def required(value: Column, what: str) -> Column:
    """The value, or an error where it is null or empty."""
    return F.when(value.isNull() | (value == ""), F.raise_error(F.lit(f"missing {what}"))).otherwise(value)


def field(stanza: Column, key: str) -> Column:
    """The value of ``key:`` in a stanza of ``key: value`` lines; lines that begin with a space go on with the value
    before them. The last of equal keys counts; null without one."""
    return field_of(stanza_lines(stanza), key)


def stanza_lines(stanza: Column) -> Column:
    """The lines of a stanza, each with what goes on after it: the step before ``field_of``, for formats with many fields."""
    return F.split(F.regexp_replace(stanza, r"[ \t\r]*\n[ ][ \t]*", ""), "\n")


def field_of(lines: Column, key: str) -> Column:
    """``field`` of the lines of a stanza."""
    found = F.filter(lines, lambda x: x.startswith(key + ":"))
    return F.when(F.size(found) > 0, F.btrim(F.substr(F.element_at(found, -1), F.lit(len(key) + 2)), F.lit(" \t\r")))


def block(text: Column, tag: str) -> Column:
    """The lines under ``%TAG%`` up to the next empty line; null without the tag."""
    found = F.filter(F.split(F.regexp_replace(text, r"[ \t\r]+(?=\n|$)", ""), r"\n(?:[ \t]*\n)+"), lambda b: b.rlike(rf"^\s*%{tag}%(?:\n|$)"))
    return F.when(F.size(found) > 0, F.filter(F.transform(F.split(F.regexp_replace(F.get(found, F.lit(0)), rf"^\s*%{tag}%\n?", ""), "\n"), lambda x: F.trim(x)), lambda x: x != ""))


def assigned(text: Column, name: str) -> Column:
    """The value of ``NAME="value"`` in a shell text, backslashes at line ends joined; null without it."""
    flat = F.regexp_replace(text, r"\\\n[ \t]*", "")
    return F.nullif(F.regexp_extract(flat, rf"(?ms)^[ \t]*{name}=\"?([^\"\n]*)\"?", 1), F.lit(""))


def patches(listing: DataFrame, folder: str = "patches") -> DataFrame:
    """(dir, patch): the sorted patch files in a folder below each package folder of (path), joined by line feeds."""
    pattern = rf"^(.*)/{folder}/([^/]+)$"
    rows = listing.filter(F.col("path").rlike(pattern)).select(F.regexp_extract("path", pattern, 1).alias("dir"), F.regexp_extract("path", pattern, 2).alias("file"))
    return rows.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list("file")), "\n").alias("patch"))
