"""What an update and the classifier spare, with the same results."""

import itertools
import random

from pyspark.sql import functions as F

from larder.functions.versions import package_key, text_key, version_key
from larder.operators.classify import classify
from larder.plans import history
from larder.plans.update_run import State, update
from larder.schema import FLAG


def test_first_update_writes_packages_once(spark, tmp_path):
    rows = [("p1", "r", "f", "t", "1.0", "c", "m", 0, False), ("p1", "s", "g", "t", "1.1", "c", "n", 0, False), ("p2", "r", "f", "u", "2", "c", "m", 0, False)]
    load = spark.createDataFrame(rows, "effname string, repo string, family string, trackname string, version string, category string, maintainer string, flags int, shadow boolean")
    state = State(spark, str(tmp_path / "state"), buckets=2)
    at = lambda day: F.expr(f"TIMESTAMP '{day} 00:00:00'")
    update(state, load, at("2000-01-01"))
    # As many tables as the manifest names and the two steps that go; none of them holds packages again.
    assert {f.rpartition("/")[2] for f in state.manifest()["files"].values()} >= {"fresh", "hashes", "tracks"}
    assert sorted(map(str, state.read("packages").collect())) == sorted(map(str, classify(load).collect()))
    update(state, load.filter("repo = 'r'"), at("2000-02-01"))
    assert sorted(map(str, state.read("packages").collect())) == sorted(map(str, classify(load.filter("repo = 'r'")).collect()))


def test_text_keys_sort_as_keys(spark):
    rng = random.Random(4)
    pieces = ["0", "1", "2", "9", "10", "007", "123456789", "1234567890", "9" * 40, "a", "alpha1", "post", "p1", "rc", "b"]
    versions = {".".join(rng.choice(pieces) for _ in range(rng.choice([1, 2, 3, 9]))) for _ in range(250)} | {"", "0", "1", "1.0", "1.1", "1.10", "1.2", "12.3", "1.0a", "1" + ".0" * 30 + ".1", "1" + ".0" * 30 + "pre"}
    flags = [0, FLAG["p_is_patch"], FLAG["any_is_patch"], FLAG["rolling"], FLAG["sink"]]
    df = spark.createDataFrame(list(itertools.product(sorted(versions), flags)) + [(None, 0)], "v string, f int")
    v, f = F.col("v"), F.col("f")
    meta = F.when(f == FLAG["rolling"], 1).when(f == FLAG["sink"], -1).otherwise(0)
    got = df.select(F.struct(meta.alias("m"), version_key(v, f).alias("k")).alias("key"), text_key(version_key(v, f)).alias("text"), package_key(v, f).alias("all")).collect()
    plain = lambda key: (key["m"], [tuple(u) for u in key["k"]])
    keys = sorted((plain(r["key"]), r["all"].encode()) for r in got)
    for (a, x), (b, y) in itertools.pairwise(keys):
        assert (a < b, a == b) == (x < y, x == y), (a, b, x, y)
    assert all(r["all"].endswith(r["text"]) for r in got)


def test_columns_pass_the_classifier(spark):
    df = spark.createDataFrame([("p", "r", "f", "1.0", 0, 7, "x"), ("p", "s", "g", "0.9", None, 8, None)], "effname string, repo string, family string, version string, flags int, `a.b` int, `c``d` string")
    out = classify(df)
    assert out.columns == [*df.columns, "versionclass"]
    assert sorted((r["repo"], r["a.b"], r["c`d"], r["versionclass"], r["flags"]) for r in out.collect()) == [("r", 7, "x", 1, 0), ("s", 8, None, 2, None)]


def test_status_events_need_no_join(spark):
    columns = "effname string, repo string, maintainer string, version string, versionclass int"
    old = spark.createDataFrame([("p", "r", None, "1", 1), ("p", "s", "m", "1", 1), ("q", "r", "m", "1", 2)], columns)
    new = spark.createDataFrame([("p", "r", None, "1", 1), ("p", "s", "m", "2", 1), ("q", "r", "m", "1", 3)], columns)
    found = history.status_events(old, new, ["effname", "repo", "maintainer"])
    # A null maintainer is like no other, as in SQL's join.
    assert sorted((r["effname"], r["repo"], r["type"], r["version"] or "") for r in found.collect()) == [("p", "r", "added", ""), ("p", "r", "removed", ""), ("p", "r", "uptodate", "1"), ("p", "s", "uptodate", "2"), ("q", "r", "ignored", "1")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    delta = history.track_delta(old.withColumnRenamed("maintainer", "trackname"), new.withColumnRenamed("maintainer", "trackname"))
    assert sorted((r["repo"], r["trackname"] or "", r["delta"]) for r in delta.collect()) == [("r", "", -1), ("r", "", 1)]
