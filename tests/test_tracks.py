"""Tracks as state of a stream against the merge of tables."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from larder.plans import history
from larder.streaming.tracks import CHANGE, follow_tracks, track_store

COLUMNS = ["repo", "trackname", "refcount", "start_ts", "restart_ts", "end_ts"]


def day(n):
    return datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)


def merged(spark, rows):
    """The plain way: one run after the other."""
    stored = spark.createDataFrame([], "repo string, trackname string, refcount long, start_ts timestamp, restart_ts timestamp, end_ts timestamp")
    for run in sorted({r[3] for r in rows}):
        change = spark.createDataFrame(sorted({r[:3] for r in rows if r[3] == run}), "repo string, trackname string, delta long")
        stored = history.merged_tracks(stored, change, F.lit(run))
        stored = spark.createDataFrame(stored.collect(), stored.schema)
    return found(stored)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_stream_equals_merge_after_every_batch(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = track_store(spark, str(tmp_path / "store"), buckets=4)
    batches = [
        [("r", "a", 2, day(0)), ("r", "b", 1, day(0)), ("s", "a", 1, day(0))],
        [("r", "a", -2, day(10)), ("s", "a", 3, day(10))],
        [("r", "a", 1, day(20)), ("r", "c", 1, day(20))],
        [("r", "b", -1, day(15)), ("r", "c", 2, day(5))],  # late, before runs that were applied already
        [("r", "a", 1, day(20)), ("r", "b", -1, day(15))],  # repeated
        [("r", "b", 4, day(200))],  # all others are settled now
    ]
    sent = []
    for batch in batches:
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.mode("append").parquet(source)
        follow_tracks(spark, source, store, check, "91 days")
        sent += batch
        assert found(store.read()) == merged(spark, sent)
    # A new checkpoint begins with the stored tracks; all files are read again and change nothing.
    before = found(store.read())
    other = str(tmp_path / "other")
    follow_tracks(spark, source, store, other, "1000 days", max_files=2)
    assert found(store.read()) == before and len(store.manifest()["done"]) == 2
    sent.append(("r", "b", -4, day(210)))
    spark.createDataFrame(sent[-1:], CHANGE).coalesce(1).write.mode("append").parquet(source)
    follow_tracks(spark, source, store, other, "1000 days")
    assert found(store.read()) == merged(spark, sent)


def test_runs_that_cannot_be_applied_are_errors(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = track_store(spark, str(tmp_path / "store"), buckets=4)
    for batch in ([("r", "a", 2, day(0))], [("r", "a", 1, day(300))]):
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.mode("append").parquet(source)
        follow_tracks(spark, source, store, check)
    before = found(store.read())
    spark.createDataFrame([("r", "z", 2, day(1))], CHANGE).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(RuntimeError, match="1 changes are of runs more than 91 days"):
        follow_tracks(spark, source, store, check)
    assert found(store.read()) == before
    other = str(tmp_path / "other")
    spark.createDataFrame([("r", "a", 5, day(300))], CHANGE).coalesce(1).write.mode("append").parquet(other)
    with pytest.raises(Exception, match="two different changes of one run"):
        follow_tracks(spark, other, store, str(tmp_path / "check2"))
    assert found(store.read()) == before


def test_batches_need_no_call_for_each_track(spark, tmp_path):
    """Many tracks in one batch, thrice: a join each, in seconds."""
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = track_store(spark, str(tmp_path / "store"), buckets=4)
    tracks = spark.range(150_000).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("trackname"), F.lit(1).cast("long").alias("delta"))
    begin = time.time()
    for n, delta in ((0, 1), (100, -1), (120, 1)):
        tracks.select("repo", "trackname", F.lit(delta).cast("long").alias("delta"), F.lit(day(n)).cast("timestamp").alias("run_ts")).write.mode("append").parquet(source)
        follow_tracks(spark, source, store, check)
    assert store.read().filter("refcount = 1 and start_ts < restart_ts and end_ts is null").count() == 150_000
    assert store.read().filter("base.settled is null").isEmpty()  # the first run is settled: the watermark has passed it
    assert time.time() - begin < 60
