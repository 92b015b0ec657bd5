"""Updates as a stream of files against one run over all of them."""

import pytest
from pyspark.sql import functions as F

from larder.operators import changes
from larder.operators.classify import classify
from larder.plans.landscape import packages
from larder.streaming.updates import Store, apply_batch, follow, latest_by_version, query_id

SMALL = "/root/testdata/sf0.001"


def test_stream_equals_whole_run(spark, tmp_path):
    table = packages(spark, SMALL).select("effname", "repo", "family", "trackname", "version", "maintainer", "flags", "shadow", "pk")
    first, second = table.filter("pk % 2 = 0"), table.filter("pk % 3 = 0")
    second = second.withColumn("maintainer", second["repo"])
    source, schema = str(tmp_path / "in"), table.schema
    stored = classify(table).schema
    store = Store(spark, str(tmp_path / "store"), stored)
    assert store.current().count() == 0
    first.coalesce(1).write.mode("append").parquet(source)
    follow(spark, source, schema, store, str(tmp_path / "check")).awaitTermination()
    second.coalesce(1).write.mode("append").parquet(source)
    follow(spark, source, schema, store, str(tmp_path / "check")).awaitTermination()
    whole = classify(changes.exact_dedupe(changes.applied(first, second, second)))
    columns = ["effname", "repo", "version", "maintainer", "versionclass"]
    got, expected = (sorted(map(tuple, df.select(*columns).collect())) for df in (store.current(), whole))
    assert got == expected and got
    # A batch that comes again changes nothing.
    number = store.manifest()["number"]
    apply_batch(store, second, query_id(spark, str(tmp_path / "check")), 1)
    assert store.manifest()["number"] == number == 1


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    table = packages(spark, SMALL).select("effname", "repo", "family", "trackname", "version", "maintainer", "flags", "shadow", "pk")
    store = Store(spark, str(tmp_path / "store"), classify(table).schema, buckets=8)
    names = [r[0] for r in table.select("effname").distinct().orderBy("effname").limit(4).collect()]
    source = str(tmp_path / "in")
    for k, name in enumerate(names[:2]):
        table.filter(F.col("effname") == name).coalesce(1).write.mode("append").parquet(source)
        follow(spark, source, table.schema, store, str(tmp_path / "first")).awaitTermination()
        assert store.manifest()["number"] == k
    other = str(tmp_path / "other")
    table.filter(F.col("effname") == names[2]).coalesce(1).write.parquet(other)
    follow(spark, other, table.schema, store, str(tmp_path / "second")).awaitTermination()  # its first batch is number 0 too
    assert {r[0] for r in store.current().select("effname").distinct().collect()} == set(names[:3])
    assert sorted(store.manifest()["done"].values()) == [0, 1]


def test_batches_write_their_buckets_only_and_old_files_go(spark, tmp_path):
    table = packages(spark, SMALL).select("effname", "repo", "family", "trackname", "version", "maintainer", "flags", "shadow", "pk").limit(400).cache()
    store = Store(spark, str(tmp_path / "store"), classify(table).schema, buckets=8)
    apply_batch(store, table, "q", 0)
    before = store.manifest()["files"]
    name = table.first()["effname"]
    mine = table.filter(F.col("effname") == name)
    for batch in range(1, 5):
        apply_batch(store, mine.withColumn("maintainer", F.lit(f"m{batch}")), "q", batch)
    after = store.manifest()["files"]
    assert len(after) == len(before) > 4 and sum(after[b] != before[b] for b in before) == 1
    assert {r[0] for r in store.current().filter(F.col("effname") == name).select("maintainer").collect()} == {"m4"}
    assert store.current().count() == changes.exact_dedupe(table).count()
    assert len(store.manifests()) == 2 and len(store._list("data/*/_bucket=*")) == len(before) + 1

    # A writer that comes too late says so.
    number = store.manifest()["number"]
    with pytest.raises(RuntimeError, match="another writer"):
        store._switch({"number": number, "files": {}, "done": {}})
    assert store.manifest()["files"] == after


def test_latest_by_version(spark):
    state = spark.createDataFrame([("a", "1.2", "x"), ("b", "2.0", "x")], "name string, version string, note string")
    batch = spark.createDataFrame([("a", "1.10", "y"), ("b", "2.0.0", "y"), ("c", "1", "y")], state.schema)
    assert sorted(map(tuple, latest_by_version(state, batch).collect())) == [("a", "1.10", "y"), ("b", "2.0", "x"), ("c", "1", "y")]
