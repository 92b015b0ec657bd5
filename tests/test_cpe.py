"""Names of products that very many rows share."""

import time

from pyspark.sql import functions as F

from larder.plans import links

FIELDS = ("lang", "other")


def named(spark, rows):
    return spark.createDataFrame(rows, "id long, cpe_vendor string, cpe_product string, lang string, other string")


def test_counts_and_rest_equal_pairs(spark):
    ours = named(spark, [(1, "v", "p", "*", None), (2, "v", "p", "a", "x"), (3, "v", "p", "b", "y"), (4, "v", "q", "a", "x"), (5, None, "p", "a", "x"), (5, None, "p", "a", "x"), (6, "v", "p", "a", "x")])
    theirs = named(spark, [(1, "v", "p", "a", "*"), (2, "v", "p", "a", "*"), (3, "v", "p", "c", None), (4, None, "p", "a", "x")])
    found = {tuple(r)[:4]: r["n"] for r in links.cpe_match_counts(ours, theirs, FIELDS).collect()}
    assert found == {("v", "p", "*", None): 3, ("v", "p", "a", "x"): 2}
    left = links.unreferenced_cpes(ours, theirs.filter("id < 3"), theirs.filter("id >= 3"), FIELDS)
    assert sorted(r["id"] for r in left.collect()) == [3, 4, 5, 5]


def test_a_hot_product_is_not_multiplied(spark):
    rows = spark.range(60_000).select("id", F.lit("v").alias("cpe_vendor"), F.lit("p").alias("cpe_product"), (F.col("id") % 4).cast("string").alias("lang"), F.lit("*").alias("other"))
    begin = time.time()
    assert [r["n"] for r in links.cpe_match_counts(rows, rows, FIELDS).collect()] == [15_000] * 4
    assert links.unreferenced_cpes(rows.withColumn("lang", F.lit("z")), rows, rows, FIELDS).count() == 60_000
    assert time.time() - begin < 30
