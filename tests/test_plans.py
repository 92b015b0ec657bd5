"""What keeps plans cheap: sorts of the classifier, keys of distinct versions, parsing on all cores."""

import re

from pyspark.sql import functions as F

from larder.functions import versions
from larder.operators.classify import classify
from larder.plans.load_queries import rows
from larder.plans.queries import QUERIES
from larder.plans.landscape import packages

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_classifier_sorts_twice(spark):
    p = plan(classify(packages(spark, SMALL).repartition("effname")))
    assert len(re.findall(r"\bSort \[", p)) == 2
    assert len(re.findall(r"hashpartitioning\(effname", p)) >= 1


def test_short_way_to_a_key_gives_the_same_key(spark):
    texts = ["1", "10.2", "7.50", "123456789012345678901.3", "1.0", "0.1", "01.2", "1.2.3", "1.2\n", "1.a", "1a", "1.", ".1", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    whole = F.concat(F.lit("-"), "v")  # a separator in front leaves the tokens as they are and the short way untaken
    got = df.select("v", versions.version_key(F.col("v")).alias("a"), versions.version_key(whole).alias("b")).collect()
    assert [r["v"] for r in got if r["a"] != r["b"]] == []


def test_parsing_is_dealt_to_all_cores(spark):
    assert rows(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_keys_of_long_versions_are_made_once_each(spark):
    p = QUERIES["version_order_long"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[b#\d+, v#\d+\]", p)
