"""What a load has to say: notes of normalisers, records that give no package, and the account of a run.

A load has four outputs under one folder: packages, rejected records, lines of the log and one row for the run. Every record ends
up in packages or in rejected, and the run's row counts both.
"""

from __future__ import annotations

import traceback
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from larder.functions.normalize import FIELD
from larder.sources.packages import Repository, load, mapped, no_texts

#: Lines that the log of a run holds; one more says that there were others.
MOST_LINES = 2_500
ERROR, WARNING = "error", "warning"
#: Fields of a record with the normaliser of each; lists first are looked at item by item.
_LISTS = {"maintainers": "maintainer", "licenses": "license", "categories": "category", "binnames": "name", "flavors": "name"}
_TEXTS = {"version": "version", "rawversion": "version", "arch": "arch", "subrepo": "subrepo", "summary": "summary"}
NOTE = "array<struct<severity:string,field:string,text:string,note:string>>"
RUN = "repo string, status string, start_ts timestamp, finish_ts timestamp, n_records long, n_packages long, n_rejected long, n_lines long, n_warnings long, n_errors long, traceback string"


def _note(field: str, text: Column, result: Column) -> Column:
    """What a normaliser said of a text; an error where the text was dropped."""
    severity = F.when(result["value"].isNull(), ERROR).otherwise(WARNING)
    return F.struct(severity.alias("severity"), F.lit(field).alias("field"), text.alias("text"), result["note"].alias("note"))


def notes() -> Column:
    """All notes on a mapped record, in the order of its fields; a problem that leaves no package comes last."""
    given = lambda x: x.isNotNull() & (x != "")
    parts = [F.array(_note(f, F.col(f), FIELD[kind](F.col(f)))) for f, kind in _TEXTS.items()]
    each = lambda f, kind: F.transform(F.filter(F.coalesce(f, no_texts()), given), lambda x: _note(f, x, FIELD[kind](x)))
    parts += [each(f, kind) for f, kind in _LISTS.items()]
    parts.append(F.transform(F.coalesce(F.map_values("names"), no_texts()), lambda x: _note("names", x, FIELD["name"](x))))
    urls = F.transform(F.coalesce("links", F.array().cast("array<struct<link_type:int,url:string>>")), lambda x: F.get(F.split(F.rtrim(x["url"], F.lit("#")), "#", 2), F.lit(0)))
    parts.append(F.transform(F.filter(urls, given), lambda x: _note("links", x, FIELD["url"](x))))
    said = F.filter(F.concat(*[p.cast(NOTE) for p in parts]), lambda x: x["note"].isNotNull())
    last = F.array(F.struct(F.lit(ERROR).alias("severity"), F.lit("record").alias("field"), F.lit(None).cast("string").alias("text"), F.col("_problem").alias("note"))).cast(NOTE)
    return F.when(F.col("_problem").isNotNull(), F.concat(said, last)).otherwise(said)


def label(names: Column, version: Column) -> Column:
    """What a line calls its record: its names in the order of their kinds, and its version."""
    sorted_names = F.array_sort(F.map_entries(F.coalesce(names, F.create_map().cast("map<string,string>"))))
    return F.concat_ws(" ", F.array_join(F.array_distinct(F.transform(sorted_names, lambda e: e["value"])), "/"), version)


def diagnosed(records: DataFrame) -> DataFrame:
    """Records with their label, notes, and the problem that leaves no package (null: none)."""
    return mapped(records).withColumns({"_label": label(F.col("names"), F.col("version")), "_notes": notes()})


def rejected(records: DataFrame, repository: Repository) -> DataFrame:
    """(repo, names, version, reason): the records that give no package."""
    bad = mapped(records).filter("_problem is not null")
    return bad.select(F.lit(repository.name).alias("repo"), "names", "version", F.col("_problem").alias("reason"))


def log_lines(records: DataFrame, repository: Repository, most: int = MOST_LINES) -> DataFrame:
    """(repo, lineno, severity, message): notes by record, field and text, at most so many and a last line that says so.

    Each of many parts of the notes gives its first lines, so no task sorts the notes of a whole run.
    """
    n = diagnosed(records).select("_label", F.explode("_notes").alias("n"))
    text = F.when(F.col("n.text").isNotNull(), F.concat(F.lit(' "'), F.col("n.text"), F.lit('"'))).otherwise(F.lit(""))
    lines = n.select("_label", "n.severity", F.concat("_label", F.lit(": "), F.col("n.field"), text, F.lit(" "), F.col("n.note")).alias("message"))
    order = ["_label", "message", "severity"]
    part = F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(256))
    firsts = lines.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).filter(F.col("_n") <= most + 1)
    numbered = firsts.withColumn("lineno", F.row_number().over(Window.orderBy(*order))).filter(F.col("lineno") <= most + 1)  # 256 * (most + 1) rows at most
    more = F.col("lineno") > most
    return numbered.select(
        F.lit(repository.name).alias("repo"), "lineno", F.when(more, ERROR).otherwise(F.col("severity")).alias("severity"),
        F.when(more, F.lit(f"Log trimmed at {most} lines")).otherwise(F.col("message")).alias("message"),
    )


def counted(records: DataFrame) -> tuple[DataFrame, Observation]:
    """Diagnosed records, and what will have been counted when they have been written."""
    seen = Observation()
    of = lambda severity: F.size(F.filter("_notes", lambda x: x["severity"] == severity))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = diagnosed(records).observe(
        seen, F.count(F.lit(1)).alias("n_records"), F.count("_problem").alias("n_rejected"), total(of(WARNING)).alias("n_warnings"), total(of(ERROR)).alias("n_errors")
    )
    return rows, seen


def run_load(records: DataFrame, repository: Repository, folder: str, started: datetime, finished: datetime | None = None, **options) -> dict:
    """Load a repository into ``folder`` (packages, rejected, log, runs, each by repo) and return the row of the run.

    The packages are those of ``load`` with its options. A run that breaks leaves the tables of the repository as they were
    before the step that broke, a row with its traceback, and raises. Rows of runs are added, the rest is replaced.
    """
    spark = records.sparkSession
    row = {k: None for k in (c.split()[0] for c in RUN.split(", "))}
    row |= {"repo": repository.name, "start_ts": started}

    def put(df: DataFrame, table: str) -> None:
        df.drop("repo").write.mode("overwrite").parquet(f"{folder}/{table}/repo={repository.name}")

    try:
        rows, seen = counted(records)
        put(rows.filter("_problem is not null").select("names", "version", F.col("_problem").alias("reason")), "rejected")
        put(log_lines(records, repository), "log")
        put(load(records, repository, on_failure="skip", **options), "packages")
        got = seen.get
        row |= got | {"status": "successful", "n_packages": got["n_records"] - got["n_rejected"], "n_lines": min(got["n_warnings"] + got["n_errors"], MOST_LINES + 1)}
    except Exception:
        row |= {"status": "failed", "traceback": traceback.format_exc()}
        raise
    finally:
        row["finish_ts"] = finished or datetime.now()
        spark.createDataFrame([tuple(row.values())], RUN).coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    return row
