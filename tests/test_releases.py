"""Releases of projects: what merging gives, and that nothing leaves the projects it lies by."""

import datetime
import re

from pyspark.sql import functions as F

from larder.plans import history
from larder.plans.landscape import snapshots
from larder.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
STORED = "effname string, version string, start_ts timestamp, trusted_start_ts timestamp, end_ts timestamp"
TRACK_VERSIONS = "repo string, trackname string, version string, any_statuses int, any_flags int, start_ts timestamp, end_ts timestamp"


def day(n):
    return None if n is None else datetime.datetime(2000, 1, n)


def test_merged_releases(spark):
    stored = [("a", "1", day(5), day(5), day(9)), ("a", "2", day(5), day(5), day(9)), ("a", "3", day(5), day(5), None), ("a", "4", day(5), None, day(9)), ("b", "1", day(2), day(2), day(3))]
    ignored = 1 << 3
    tracks = [
        ("r", "t", "1", ignored, 0, day(5), day(8)),  # the trusted start is an ignored one now
        ("r", "u", "1", 1 << 1, 0, day(7), None),
        ("r", "t", "2", ignored, 0, day(5), day(12)),  # and here a trusted one as well
        ("s", "t", "2", 1 << 1, 0, day(5), day(11)),
        ("r", "t", "3", 1 << 1, 0, day(4), day(10)),
        ("r", "t", "4", 1 << 1, 4, day(3), day(4)),  # ignored by a flag
        ("r", "t", "5", 1 << 1, 0, day(6), None),
    ]
    # Both projects have track t of repository r.
    packages = spark.createDataFrame([("a", "r", "t"), ("a", "r", "u"), ("a", "s", "t"), ("c", "r", "t")], "effname string, repo string, trackname string")
    fresh = history.of_projects(packages, spark.createDataFrame(tracks, TRACK_VERSIONS))
    got = {(r["effname"], r["version"]): tuple(r)[2:] for r in history.merged_releases(spark.createDataFrame(stored, STORED), fresh).collect()}
    of_a = {"1": (day(5), day(7), day(9)), "2": (day(5), day(5), day(12)), "3": (day(4), day(4), day(10)), "4": (day(3), None, day(9)), "5": (day(6), day(6), None)}
    of_c = {"1": (day(5), None, day(8)), "2": (day(5), None, day(12)), "3": (day(4), day(4), day(10)), "4": (day(3), None, day(4)), "5": (day(6), day(6), None)}
    assert got == {("a", v): r for v, r in of_a.items()} | {("c", v): r for v, r in of_c.items()} | {("b", "1"): (day(2), day(2), day(3))}


def shuffles(df):
    """Columns that rows are dealt by in each shuffle; one that is read twice counts once."""
    lines = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ReusedExchange" not in line]
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", "\n".join(lines))]


def test_releases_stay_with_their_projects(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan says what is read again
    try:
        dealt = shuffles(QUERIES["releases_merge"](spark, SMALL))
        assert sorted(dealt) == ["effname", "effname", "l_suppkey", "s_suppkey"]
        old, new = snapshots(spark, SMALL)
        both = old.select("effname", F.lit("old").alias("side")).unionByName(new.select("effname", F.lit("new").alias("side")))
        assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
