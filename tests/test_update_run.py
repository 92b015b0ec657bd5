"""Updates of the stored state against working it out anew."""

import pytest
from pyspark.sql import functions as F

from larder.operators import changes
from larder.operators.classify import classify
from larder.plans import history
from larder.plans.landscape import new_packages, old_packages
from larder.plans.update_run import COUNTERS, State, update

SMALL = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(c for c in df.columns if c != "run_ts")
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_update_equals_recompute_and_survives_a_kill(spark, tmp_path):
    first, second = (F.expr(f"TIMESTAMP '{day} 00:00:00'") for day in ("2000-06-01", "2001-01-01"))
    small = lambda df: df.filter("pk % 3 = 0 or pk < 40").cache()
    old, new = small(old_packages(spark, SMALL)), small(new_packages(spark, SMALL))
    state = State(spark, str(tmp_path / "state"), buckets=4)
    assert state.read("packages") is None
    update(state, old, first)
    before = classify(changes.exact_dedupe(old)).cache()
    assert rows(state.read("packages")) == rows(before)

    # A run that is killed between two steps leaves the state as it was.
    def killed(step):
        if step == "tracks":
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        update(state, new, second, killed)
    assert state.manifest()["number"] == 0 and rows(state.read("packages")) == rows(before)

    # Another session goes on with the same folder.
    other = State(spark.newSession(), str(tmp_path / "state"), buckets=7)
    assert other.buckets == 4  # what is stored decides
    other.spark.sql("SELECT 1").collect()
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("larder_")]:
        spark.sql(f"DROP TABLE {name}")
    steps = []
    update(other, new, second, steps.append)
    after = classify(changes.exact_dedupe(new)).cache()
    assert rows(other.read("packages")) == rows(after)
    for what, (full, _) in COUNTERS.items():
        assert rows(other.read(what)) == rows(full(after)), what
    assert rows(other.read("project_events")) == rows(history.project_events(before, after))
    assert rows(other.read("repo_events")) == rows(history.status_events(before, after, ["effname", "repo"]))
    tracks = history.merged_tracks(spark.createDataFrame([], "repo string, trackname string, refcount long, start_ts timestamp, restart_ts timestamp, end_ts timestamp"), history.track_delta(before.filter("false"), before), first)
    assert rows(other.read("tracks")) == rows(history.merged_tracks(tracks, history.track_delta(before, after), second))
    # What the killed run left is gone, and so are the steps of the others.
    names = {f for n in other.manifests() for f in other.manifest(n)["files"].values()}
    assert set(other._list("tables/*/*")) == names and len(other.manifests()) == 2 and "incoming" in steps

    # Nothing that is stored is shuffled.
    spark = other.spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    stored, hashes = other.read("packages"), other.read("hashes")
    for df in (changes.changes(hashes, hashes.withColumn("hash", F.col("hash") + 1)), classify(stored), changes.project_hashes(stored), changes.applied(stored, hashes, stored)):
        assert "Exchange" not in plan(df) and "Scan" in plan(df)

    # The same load again changes nothing; one without rows removes all.
    update(other, new, second)
    assert rows(other.read("packages")) == rows(after) and other.read("project_events").count() == 0
    update(other, new.filter("false"), second)
    assert other.read("packages").count() == other.read("repo_stats").count() == 0
