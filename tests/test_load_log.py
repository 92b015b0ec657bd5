"""A load with its log: what goes in comes out as packages or rejected records, and a broken run leaves an account."""

import datetime

import pytest
from pyspark.sql import functions as F

from larder.plans.load_queries import REPO, odd_records
from larder.sources import load_log

SMALL = "/root/testdata/sf0.001"
NOON = datetime.datetime(2024, 5, 1, 12)


def test_run_of_a_load(spark, tmp_path):
    folder = str(tmp_path)
    records = odd_records(spark, SMALL)
    for _ in range(2):
        row = load_log.run_load(records, REPO, folder, NOON, NOON)
    tables = {t: spark.read.parquet(f"{folder}/{t}") for t in ("packages", "rejected", "log", "runs")}
    assert row["n_records"] == records.count() == tables["packages"].count() + tables["rejected"].count()
    assert (row["n_packages"], row["n_rejected"]) == (tables["packages"].count(), tables["rejected"].count()) and row["n_rejected"] > 0
    assert row["n_lines"] == tables["log"].count() == row["n_warnings"] + row["n_errors"]
    assert [tuple(r) for r in tables["runs"].collect()] == [tuple(row.values())] * 2 and row["status"] == "successful"

    broken = records.withColumn("version", F.when(F.col("version") == "  ", F.raise_error(F.lit("torn file"))).otherwise(F.col("version")))
    with pytest.raises(Exception, match="torn file"):
        load_log.run_load(broken, REPO, folder, NOON, NOON)
    failed = spark.read.parquet(f"{folder}/runs").filter("status = 'failed'").collect()
    assert len(failed) == 1 and "torn file" in failed[0]["traceback"] and failed[0]["n_records"] is None
    assert spark.read.parquet(f"{folder}/packages").count() == row["n_packages"]


def test_log_is_trimmed(spark):
    records = odd_records(spark, SMALL)
    whole = load_log.log_lines(records, REPO).orderBy("lineno").collect()
    some = load_log.log_lines(records, REPO, most=7).orderBy("lineno").collect()
    assert some[:7] == whole[:7] and tuple(some[7])[1:] == (8, "error", "Log trimmed at 7 lines") and len(some) == 8
    assert [r["lineno"] for r in whole] == list(range(1, len(whole) + 1))


def test_nothing_to_load(spark, tmp_path):
    row = load_log.run_load(odd_records(spark, SMALL).limit(0), REPO, str(tmp_path), NOON, NOON)
    assert (row["n_records"], row["n_packages"], row["n_lines"], row["status"]) == (0, 0, 0, "successful")
