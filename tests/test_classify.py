"""Scenarios of the classifier, one project each: rows of repo:version[flags]{flavours}(branch) and expected class."""

import re

import pytest
from pyspark.sql import functions as F

from larder.operators.classify import classify
from larder.schema import FLAG, STATUS

SCENARIOS = {
    "big": """1:2.2.20990101[ignore] ignored; 1:2.2beta1[devel] devel; 1:2.2alpha1.20990101[devel+ignore] legacy; 1:2.2alpha1[devel] legacy;
        1:2.1.20990101[ignore] ignored; 1:2.1 newest; 1:2.0.20990101[ignore] legacy; 1:2.0 legacy; 1:1.2beta1[devel] legacy; 1:1.1 legacy;
        2:2.2beta1[devel] devel; 2:2.0 outdated; 3:2.1 newest; 3:2.0 legacy; 5:1.1 outdated; 5:1.0 legacy; 6:1.1.20990101[ignore] outdated; 6:1.1 legacy;
        8:2.2beta1[devel+ignore] devel; 9:2.1[ignore] newest; 10:2.0[ignore] outdated; 10:1.9[ignore] legacy; 11:2.2alpha1[devel] outdated;
        12:2.2alpha1[devel] outdated; 12:2.0 outdated""",
    "hard devel": "1:2.1[devel] devel; 1:2.0[devel] legacy; 2:2.1 devel; 2:2.0 legacy",
    "stable": "1:2.1[devel] newest; 1:2.0[devel] legacy; 2:2.1[stable] newest; 2:2.0 legacy",
    "weak devel": "1:2.1[weak_devel] devel; 1:2.0[weak_devel] newest; 2:2.0 newest",
    "weak devel overruled": "1:2.1[weak_devel] newest; 1:2.0[weak_devel] legacy; 2:2.1 newest; 2:2.0 legacy",
    "unique": "1/f:2.0alpha1[devel] unique; 2/f:1.2 unique; 3/f:1.1 outdated; 3/f:1.0 legacy",
    "devel and ignored": "1:2.0beta1[devel] devel; 2:0.9999[ignore] ignored",
    "sink": "1:1.0 newest; 2:1.0[sink] outdated",
    "legacy": "1:2.0 newest; 2:1.0[legacy] legacy",
    "nolegacy": "1:1.1 newest; 1:1.0[nolegacy] outdated; 2:1.1 newest",
    "all ignored, one family": "1/f:2.0[ignore] unique; 2/f:1.0[ignore] outdated",
    "nix schemes": "nix:20200101[ignore] ignored; nix:0-unstable-20200202[ignore] ignored",
    "noscheme": "1:2.0[noscheme] noscheme; 1:1.0[noscheme] noscheme",
    "rolling does not hinder": "1:2.0[ignore] newest; 2:1.0[rolling] rolling",
    "altver": "1:1.1.1234[altver] newest; 0:1.1 newest; 1:1.0.1234[altver] legacy; 0:1.0 legacy",
    "altscheme": "1:1235[altscheme] newest; 0:1.1 newest; 1:1234[altscheme] legacy; 0:1.0 legacy",
    "branch off": "0:11.1 newest; 0:10.1 legacy; 0:10.0 legacy; 1:11.1 newest; 1:10.0 legacy",
    "branch on": "0:11.1 newest; 0:10.1(10.x) legacy; 0:10.0(10.x) legacy; 1:11.1 newest; 1:10.0(10.x) outdated",
    "branch ignored": "0:11.1 newest; 1:11.1 newest; 1:10.1[untrusted](10.x) legacy; 1:10.0[untrusted](10.x) legacy",
    "branch devel": "0:11.1 newest; 0:10.1(10.x) legacy; 1:11.1 newest; 1:10.2alpha1[devel](10.x) legacy; 1:10.0(10.x) legacy",
    "branch twice": "0:11.1 newest; 0:10.1(10.x) legacy; 1:11.1 newest; 1:10.0(10.x) outdated; 1:10.0(10.x) outdated",
    "branch and flavours": "0:11.1{a} newest; 0:11.1{b} newest; 1:11.1{a} newest; 1:11.1{b} newest; 1:11.0{a} legacy; 1:11.0{b} legacy; 1:10.2{b}(10.x) legacy; 1:10.1{a}(10.x) outdated",
    "branch of a stray": "m:2.0.0(2) newest; m:1.20.3 outdated; g:2.0.0(2) newest; g:1.21.1 legacy",
    "mixed schemes": "0:101[altscheme] newest; 1:100[altscheme] outdated; 2:99[devel+incorrect] incorrect; 3:10.101[incorrect] incorrect; 4:10 newest",
    "outdated": "1:2[outdated] outdated; 2:1 outdated",
    "outdated devel": "1:2[outdated+devel] outdated; 2:1 newest",
    "outdated alone": "1:1[outdated] outdated",
    "recalled": "1:2[recalled] outdated; 2:2 outdated; 3:1 newest",
    "recalled below": "1:2 newest; 1:1[recalled] legacy; 2:2 newest",
    "any word is a patch": "0:21.08.1.726[altver] newest; 1:21.08.1+p20.04+tstable[ignore+incorrect+any_is_patch] incorrect; 2:21.08.1 newest",
    "equal below the best": "1:2.2 newest; 2:2.1 outdated; 2:2.1 outdated; 2:2.0 legacy",
    "flavours": "1:2.2 newest; 3:2.1 outdated; 3:2.0{foo} outdated; 5:2.1{foo} outdated; 5:2.0{foo} legacy",
    "empty flags": "1:1.0 unique",
}
ROW = re.compile(r"([^:/]+)(?:/(\w+))?:([^\[{( ]+)(?:\[([^\]]*)\])?(?:\{([^}]*)\})?(?:\(([^)]*)\))? (\w+)")


def rows():
    for case, text in SCENARIOS.items():
        for n, part in enumerate(text.split(";")):
            repo, family, version, flags, flavors, branch, expected = ROW.fullmatch(" ".join(part.split())).groups()
            mask = sum(FLAG[f] for f in flags.split("+")) if flags else None
            yield case, n, repo, family or repo, version, mask, flavors.split(",") if flavors else None, branch, STATUS[expected]


@pytest.fixture(scope="module")
def classified(spark):
    df = spark.createDataFrame(list(rows()), "effname string, n int, repo string, family string, version string, flags int, flavors array<string>, branch string, expected int")
    return [r for r in classify(df).collect()]


@pytest.mark.parametrize("case", SCENARIOS)
def test_scenario(classified, case):
    mine = [r for r in classified if r["effname"] == case]
    assert {(r["n"], r["repo"], r["version"]): r["versionclass"] for r in mine} == {(r["n"], r["repo"], r["version"]): r["expected"] for r in mine}


def test_every_row_stays(spark, classified):
    assert len(classified) == len(list(rows()))


def test_empty(spark):
    df = spark.createDataFrame([], "effname string, repo string, family string, version string, flags int")
    assert classify(df).count() == 0


def test_one_shuffle(spark):
    df = spark.createDataFrame([("a", "r", "f", "1", 0)], "effname string, repo string, family string, version string, flags int").repartition("effname")
    plan = classify(df, F.col("version"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
