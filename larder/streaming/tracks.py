"""Tracks as stored state of a stream: what ``history.merged_tracks`` does with a table, for runs that come late, again or out of order.

A stream row says by how much a run changed the packages of a track: (repo, trackname, delta, run_ts), one row for a track and a
run. The state of a track stands beside it in the store: what its settled runs made of it (``base``), and the runs after that, by time
(``runs``). A batch meets the stored tracks of the buckets it touches in one join, and all unsettled runs of a track are applied in the
order of time. The watermark of a query is the latest run of its earlier batches less ``delay``; runs that it has passed are settled when
their track is touched, so the state of a track stays small.

* Runs may come in any order within ``delay`` of the latest one; each is applied at its place.
* A run that comes again with the same delta changes nothing; with another delta it is an error.
* A run older than ``delay`` is an error of ``follow_tracks`` and isn't applied; for a new checkpoint, runs that were settled are repeats.
* A query with a new checkpoint begins with the stored tracks as its state, so the files may be read again from the first.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.streaming.updates import Store, query_id

KEYS = ("repo", "trackname")
LONG, TEXT, TIME = T.LongType(), T.StringType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CHANGE = _struct(repo=TEXT, trackname=TEXT, delta=LONG, run_ts=TIME)
#: Times are microseconds within the state; ``settled`` is the last run that is in the base for good.
BASE = _struct(known=T.BooleanType(), refcount=LONG, started=LONG, restarted=LONG, ended=LONG, settled=LONG)
RUNS = T.MapType(LONG, LONG)
TRACK = _struct(repo=TEXT, trackname=TEXT, refcount=LONG, start_ts=TIME, restart_ts=TIME, end_ts=TIME, base=BASE, runs=RUNS)


def _base(*fields: Column) -> Column:
    return F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip(fields, BASE.fields)])


def applied(base: Column, runs: Column) -> Column:
    """A track (BASE) after some runs (entries of RUNS) in the order of time."""
    none = F.lit(None)

    def one(b: Column, run: Column) -> Column:
        total = b["refcount"] + run["value"]
        later = _base(F.lit(True), total, b["started"], F.when(b["refcount"] == 0, run["key"]).otherwise(b["restarted"]), F.when(total == 0, run["key"]), b["settled"])
        return F.when(b["known"], later).otherwise(_base(F.lit(True), run["value"], run["key"], none, none, b["settled"]))

    return F.aggregate(F.array_sort(runs), base, one)


def track_store(spark: SparkSession, folder: str, buckets: int = 64) -> Store:
    return Store(spark, folder, TRACK, buckets, KEYS)


def merged(stored: DataFrame, changes: DataFrame, watermark: Column) -> DataFrame:
    """``stored`` (TRACK) after ``changes`` (keys, run, delta); runs up to the watermark (null: none) are settled in the tracks that they touch."""
    came = changes.groupBy(*KEYS, "run").agg(F.min("delta").alias("delta"), F.max("delta").alias("other"))
    came = came.groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg(F.collect_list(F.struct(F.col("run").alias("key"), F.col("delta").alias("value"), "other")).alias("_came"))  # runs of one batch
    rows = stored.join(came, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]), "full_outer")
    none = F.lit(None)
    known = F.coalesce(F.map_entries("runs"), F.array().cast("array<struct<key:bigint,value:bigint>>"))
    rows = rows.select(
        *[F.when(F.col("_came").isNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in KEYS],
        F.coalesce("base", _base(F.lit(False), F.lit(0), none, none, none, none)).alias("base"), known.alias("_known"), "_came", F.struct(*TRACK.fieldNames()).alias("_was"),
    )
    settled = F.col("base.settled")
    fresh = F.filter("_came", lambda c: settled.isNull() | (c["key"] > settled))
    rows = rows.withColumn("_fresh", fresh)
    deltas = F.map_from_entries("_known")
    odd = F.filter("_fresh", lambda c: (c["value"] != c["other"]) | (deltas[c["key"]] != c["value"]))
    pair = lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value"))
    text = F.concat(F.lit("track "), F.concat_ws(" ", *KEYS), F.lit(" has two different changes of one run: "), F.to_json(odd))
    runs = F.array_distinct(F.concat("_known", F.transform("_fresh", pair)))
    rows = rows.withColumn("_runs", F.when(F.size(odd) > 0, F.raise_error(text).cast("array<struct<key:bigint,value:bigint>>")).otherwise(runs))
    past = lambda r: F.coalesce(r["key"] <= watermark, F.lit(False))
    done = F.filter("_runs", past)
    rows = rows.withColumns({"_open": F.filter("_runs", lambda r: ~past(r)), "_settled": applied(F.col("base"), done).withField("settled", F.greatest(settled, F.array_max(F.transform(done, lambda r: r["key"]))))})
    rows = rows.withColumn("_now", applied(F.col("_settled"), F.col("_open")))
    stamp = lambda c: F.timestamp_micros(F.col("_now")[c])
    now = F.struct(*KEYS, F.col("_now.refcount").alias("refcount"), stamp("started").alias("start_ts"), stamp("restarted").alias("restart_ts"), stamp("ended").alias("end_ts"), F.col("_settled").alias("base"), F.map_from_entries("_open").alias("runs"))
    return rows.select(F.when(F.col("_came").isNull(), F.col("_was")).otherwise(now).alias("t")).select("t.*")


def apply_tracks(store: Store, batch: DataFrame, query: str, batch_id: int, delay: str) -> int:
    """Tracks of a batch replace those stored, in the buckets they are in; the number of changes that came too late and were left out.
    A batch that is done already is left alone."""
    manifest = store.manifest()
    if batch_id <= manifest["done"].get(query, -1):
        return 0
    latest = manifest.get("latest", {}).get(query)
    watermark = F.unix_micros(F.timestamp_micros(F.lit(latest).cast("long")) - F.expr(f"INTERVAL {delay}"))
    changes = batch.select(*KEYS, "delta", F.unix_micros("run_ts").alias("run"))
    in_time = F.coalesce(F.col("run") > watermark, watermark.isNull())
    seen = changes.groupBy(store.bucket().alias("bucket")).agg(F.count_if(in_time).alias("n"), F.count_if(~in_time).alias("late"), F.max("run").alias("latest")).collect()  # as many as the store has buckets
    touched = [str(r["bucket"]) for r in seen if r["n"]]
    if touched:
        tracks = merged(store.read(touched), changes.filter(in_time), watermark)
        latest = max(r["latest"] for r in seen if r["latest"] is not None) if latest is None else max(latest, *[r["latest"] for r in seen if r["latest"] is not None])
        store.replace(tracks.repartition(store.bucket()), touched, query, batch_id, latest={**manifest.get("latest", {}), query: latest})
    return sum(r["late"] for r in seen)


def follow_tracks(spark: SparkSession, source: str, store: Store, checkpoint: str, delay: str = "91 days", max_files: int = 1000) -> None:
    """Applies the new Parquet files (CHANGE) of ``source``, in micro-batches of so many files, until no file is left."""
    late = []
    changes = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", max_files).parquet(source)
    write = changes.writeStream.foreachBatch(lambda batch, n: late.append(apply_tracks(store, batch, query_id(spark, checkpoint), n, delay)))
    write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if sum(late):
        raise RuntimeError(f"{source}: {sum(late)} changes are of runs more than {delay} before the latest one and were not applied")


def tracks_of(spark: SparkSession, runs: Iterable[DataFrame], folder: str) -> DataFrame:
    """Tracks after the changes of some runs (CHANGE), each sent as a batch of files; all is kept in a new folder."""
    store = track_store(spark, f"{folder}/store")
    for run in runs:
        run.select([F.col(f.name).cast(f.dataType) for f in CHANGE.fields]).write.mode("append").parquet(f"{folder}/in")
        follow_tracks(spark, f"{folder}/in", store, f"{folder}/state")
    return store.read()
