"""Updates as a stream of package files.

Every micro-batch holds whole projects (what a producer writes is one file set for each changed project). A batch
replaces the stored packages of its projects. The store is divided into buckets of projects; a batch writes new files for the
buckets it touches only, then a new manifest that says which files are the store. The manifest also says up to which batch
of which query it has come, so a batch that runs again after a failure changes nothing, and a query that begins anew with
another checkpoint is another query: its first batch counts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators import changes
from larder.operators.classify import classify

#: Manifests that are kept, with the files they name: readers of the one before the last are not disturbed.
KEPT = 2


class Manifests:
    """Numbered manifests in a folder: each says which files are the state; readers see the last one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _list(self, pattern: str) -> list[str]:
        """Paths below the folder that fit."""
        found = self.fs.globStatus(self._path(pattern))
        root = self.fs.makeQualified(self._path("")).toUri().getPath()
        return sorted(f.getPath().toUri().getPath().removeprefix(root).lstrip("/") for f in found or [])

    def manifests(self) -> list[int]:
        return sorted(int(name.rpartition("/")[2].removesuffix(".json")) for name in self._list("manifests/*.json"))

    def manifest(self, number: int | None = None) -> dict:
        """{number, files: bucket to folder, done: query to its last batch}; an empty one before the first."""
        numbers = self.manifests()
        if not numbers:
            return {"number": -1, "files": {}, "done": {}}
        stream = self.fs.open(self._path(f"manifests/{numbers[-1] if number is None else number}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, manifest: dict) -> None:
        """The new manifest appears whole or not at all; that another writer has put one of this number is an error."""
        draft, final = self._path(f"manifests/.{manifest['number']}.draft"), self._path(f"manifests/{manifest['number']}.json")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise RuntimeError(f"{self.folder}: manifest {manifest['number']} is there already; another writer is at work")

    def _prune(self, pattern: str) -> None:
        """Old manifests, and folders of this pattern that none of the others names."""
        numbers = self.manifests()
        needed = {f for n in numbers[-KEPT:] for f in self.manifest(n)["files"].values()}
        for name in self._list(pattern):
            if name not in needed:
                self.fs.delete(self._path(name), True)
        for n in numbers[:-KEPT]:
            self.fs.delete(self._path(f"manifests/{n}.json"), False)


class Store(Manifests):
    """A table in buckets by its keys (classified packages by project), under one folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, buckets: int = 64, keys: tuple[str, ...] = ("effname",)):
        super().__init__(spark, folder)
        self.schema, self.buckets, self.keys = schema, buckets, keys

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """What is stored; of some buckets only, if these are given."""
        files = self.manifest()["files"]
        paths = [f"{self.folder}/{files[b]}" for b in (files if buckets is None else buckets) if b in files]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    current = read

    def replace(self, packages: DataFrame, buckets: list[str], query: str, batch: int, **more) -> None:
        """``packages`` are from now on all that these buckets hold. The manifest also keeps ``more``."""
        before = self.manifest()
        number = before["number"] + 1
        place = f"data/{number}"
        packages.select(*self.schema.fieldNames(), self.bucket().alias("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/{place}")
        files = {b: f for b, f in before["files"].items() if b not in buckets}
        files |= {x.rpartition("=")[2]: x for x in self._list(f"{place}/_bucket=*")}
        self._switch({**before, "number": number, "files": files, "done": {**before["done"], query: batch}, **more})
        self._prune("data/*/_bucket=*")


def apply_batch(store: Store, batch: DataFrame, query: str, batch_id: int) -> None:
    """Projects of a batch replace those stored; they are classified as a whole. A batch that is done already is left alone."""
    if batch_id <= store.manifest()["done"].get(query, -1):
        return
    incoming = changes.exact_dedupe(batch)
    fresh = classify(incoming.withColumn("versionclass", F.lit(0)) if "versionclass" in incoming.columns else incoming)
    touched = [str(r[0]) for r in incoming.select(store.bucket()).distinct().collect()]  # as many as the store has buckets
    stored = changes.applied(store.read(touched), incoming, fresh.select(*store.schema.fieldNames()))
    store.replace(stored, touched, query, batch_id)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint; it stays when the query goes on, and is another for a new checkpoint."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{checkpoint}/metadata").collect()))["id"]  # one line


def follow(spark: SparkSession, source: str, schema: T.StructType, store: Store, checkpoint: str, max_files: int = 1000):
    """The stream: new Parquet files of ``source``, in micro-batches of so many files; runs until no file is left."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    write = files.writeStream.foreachBatch(lambda batch, n: apply_batch(store, batch, query_id(batch.sparkSession, checkpoint), n))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_version(state: DataFrame, batch: DataFrame, key: str = "name", version: str = "version") -> DataFrame:
    """Of each key the row with the greatest version, over what is stored and what comes; of equal ones the stored row."""
    from larder.functions.versions import version_key

    both = state.withColumn("_old", F.lit(1)).unionByName(batch.withColumn("_old", F.lit(0)))
    columns = state.columns
    best = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version_key(F.col(version)).alias("k"), "_old")).alias("r"))
    return best.select("r.*")
