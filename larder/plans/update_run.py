"""One update of the stored state by a new load.

The state is classified packages, hashes of projects, tracks, and counters of repositories and maintainers. An update finds the
projects that changed, classifies those only, works out the change of every counter from them and applies it. Each step is written
once, below a folder of the run; a manifest that names the new tables is written last, so a run that breaks leaves the state as it
was and the next one begins anew.

Tables that hold projects are bucketed and sorted by project. Finding changes, classifying and applying them read bucket by bucket,
without a shuffle of what is stored; a load is dealt to buckets once, when it is written. Counters are exact as stored + new - old, since a changed project
brings all its packages on both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import changes
from larder.operators.classify import classify
from larder.plans import aggregates, history
from larder.streaming.updates import Manifests

KEY = "effname"
#: Tables in buckets of projects; ``incoming``, ``changed`` and ``fresh`` are steps of a run and go when it is done.
BUCKETED = ("packages", "hashes", "incoming", "changed", "fresh")
STEPS = ("incoming", "changed", "fresh")
COUNTERS: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    "repo_stats": (aggregates.by_repository, ["repo"]),
    "maintainer_stats": (aggregates.by_maintainer, ["maintainer"]),
    "maintainer_repo_stats": (lambda p: aggregates.by_maintainer(p, "repo"), ["maintainer", "repo"]),
    "maintainer_categories": (aggregates.by_maintainer_category, ["maintainer", "category"]),
}
TRACKS = "repo string, trackname string, refcount long, start_ts timestamp, restart_ts timestamp, end_ts timestamp"


class State(Manifests):
    """The tables that the last update left under a folder; any session that sees the folder can go on.

    The number of buckets is that of the first update: the one given, or else the session's number of shuffle partitions. It should suit the
    size of all packages; the manifest keeps it, since tables are read bucket by bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        super().__init__(spark, folder)
        self.buckets = self.manifest()["done"].get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _table(self, place: str) -> str:
        return f"larder_{hashlib.md5(f'{self.folder}/{place}'.encode()).hexdigest()}"

    def write(self, place: str, df: DataFrame, bucketed: bool) -> None:
        path = f"{self.folder}/{place}"
        if bucketed:
            dealt = df.repartition(self.buckets, KEY).write.bucketBy(self.buckets, KEY).sortBy(KEY)
            dealt.format("parquet").option("path", path).saveAsTable(self._table(place))
        else:
            df.write.parquet(path)

    def at(self, place: str, bucketed: bool) -> DataFrame:
        path = f"{self.folder}/{place}"
        if not bucketed:
            return self.spark.read.parquet(path)
        name = self._table(place)
        if not self.spark.catalog.tableExists(name):  # another session wrote it
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def read(self, what: str) -> DataFrame | None:
        """A table of the state; None before the first update."""
        place = self.manifest()["files"].get(what)
        return None if place is None else self.at(place, what in BUCKETED)

    def switch(self, files: dict[str, str]) -> None:
        """These tables are the state now; what neither this nor the last manifest names goes."""
        before = self.manifest()
        self._switch({"number": before["number"] + 1, "files": files, "done": {"buckets": self.buckets}})
        known = set(self._list("tables/*/*"))
        self._prune("tables/*/*")
        for place in known - set(self._list("tables/*/*")):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(place)}")


def update(state: State, load: DataFrame, run_ts: Column, done: Callable[[str], None] = lambda step: None) -> None:
    """The state after ``load``, which holds all packages of the moment; ``done`` is called after each written table.

    Rows that agree in every field count once. A load without rows removes all projects. The events of the state are those of its last update.
    """
    spark, place = state.spark, f"tables/{uuid4().hex}"
    files: dict[str, str] = {}

    def step(what: str, df: DataFrame) -> DataFrame:
        state.write(f"{place}/{what}", df, what in BUCKETED)
        files[what] = f"{place}/{what}"
        done(what)
        return state.at(files[what], what in BUCKETED)

    def stored(what: str, schema) -> DataFrame:
        found = state.read(what)
        return spark.createDataFrame([], schema) if found is None else found

    incoming = step("incoming", changes.exact_dedupe(load.drop("versionclass")))
    hashes = step("hashes", changes.project_hashes(incoming))
    kinds = changes.changes(stored("hashes", hashes.schema), hashes)
    changed = step("changed", kinds.filter("kind <> 'unchanged'"))
    names = changed.select(KEY).hint("shuffle_hash")  # of one bucket at a time; packages needn't be sorted to meet them
    first = state.read("packages") is None
    fresh = step("fresh", classify(incoming if first else incoming.join(names, KEY, "left_semi")))
    packages = stored("packages", fresh.schema)
    old = packages.join(names, KEY, "left_semi")
    for what, (full, keys) in COUNTERS.items():
        change = full(fresh) if first else aggregates.delta(full(old), full(fresh), keys)
        step(what, aggregates.applied(stored(what, change.schema), change, keys))
    step("tracks", history.merged_tracks(stored("tracks", TRACKS), history.track_delta(old, fresh), run_ts))
    step("project_events", history.project_events(old, fresh).withColumn("run_ts", run_ts))
    step("repo_events", history.status_events(old, fresh, [KEY, "repo"]).withColumn("run_ts", run_ts))
    if first:  # all packages are fresh, so they are written already
        files["packages"] = files["fresh"]
        done("packages")
    else:
        step("packages", packages.join(names, KEY, "left_anti").unionByName(fresh))
    state.switch({what: f for what, f in files.items() if what not in STEPS})
