"""Version order against a plain comparison of components, filled up with zeros."""

import itertools
import random
import re

from pyspark.sql import functions as F

from larder.functions.versions import compare, lower_bound, upper_bound, version_key
from larder.schema import FLAG

PRE, ZERO, POST, LETTER, NUMBER = 1, 2, 3, 4, 5


def parts(version, any_is_patch=False):
    low = version.lower()
    out = []
    for m in re.finditer(r"[0-9]+|[a-z]+", low):
        word = m[0]
        if word[0].isdigit():
            digits = word.lstrip("0")
            out.append((NUMBER, len(digits), digits) if digits else (ZERO, 0, ""))
        else:
            after_number = m.start() > 0 and low[m.start() - 1].isdigit()
            before_number = m.end() < len(low) and low[m.end()].isdigit()
            if any_is_patch or word in ("post", "patch", "pl", "errata"):
                rank = POST
            else:
                rank = LETTER if len(word) == 1 and after_number and not before_number else PRE
            out.append((rank, 0, word[0]))
    return out


def plain_compare(a, b, fill_a=(ZERO, 0, ""), fill_b=(ZERO, 0, "")):
    for x, y in itertools.zip_longest(a, b):
        x, y = x or fill_a, y or fill_b
        if x != y:
            return -1 if x < y else 1
    return 0 if fill_a == fill_b else (-1 if fill_a < fill_b else 1)


def test_long_versions(spark):
    ones = ".".join(["1"] * 16)
    rows = [(ones, ones + ".alpha1", 1), ("1", "1" + ".0" * 16, 0), ("1", "1" + ".0" * 40 + ".1", -1), ("1", "1" + ".0" * 40 + "pre1", 1), (ones + ".2", ones + ".10", -1), ("1.0.0.1", "1.0.1", -1), ("1.0.0alpha1", "1.0alpha1", 1)]
    out = spark.createDataFrame(rows, "a string, b string, wanted int").select("a", "b", "wanted", compare(version_key(F.col("a")), version_key(F.col("b"))).alias("found")).collect()
    assert [r["found"] for r in out] == [r["wanted"] for r in out]


def test_order_against_plain_comparison(spark):
    rng = random.Random(6)
    pieces = ["0", "0", "0", "1", "2", "10", "07", "a", "alpha", "beta1", "post", "patch2", "p1", "rc"]
    versions = [".".join(rng.choice(pieces) for _ in range(rng.choice([1, 2, 3, 5, 24]))) for _ in range(120)]
    versions += ["1.0a", "1.0a1", "1.0", "1", "", "0", "1.0b", "1a", "10.0.0.0", "1-2_3", "1.0ALPHA"]
    pairs = [(a, b) for a in versions for b in rng.sample(versions, 25)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    flag = F.lit(FLAG["any_is_patch"])
    low, high = lower_bound(b), upper_bound(b)
    out = df.select("a", "b", compare(version_key(a), version_key(b)).alias("c"), compare(version_key(a, flag), version_key(b)).alias("p"), compare(version_key(a), low).alias("l"), compare(version_key(a), high).alias("h")).collect()
    for r in out:
        x, y = parts(r["a"]), parts(r["b"])
        assert r["c"] == plain_compare(x, y), r
        assert r["p"] == plain_compare(parts(r["a"], True), y), r
        assert r["l"] == plain_compare(x, y, fill_b=(0, 0, "")), r
        assert r["h"] == plain_compare(x, y, fill_b=(6, 0, "")), r
