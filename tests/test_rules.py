"""The rule language: each matcher and action on its own, and large rule sets against a plain interpreter."""

import functools
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.operators import name_rules, pattern_rules, rules
from larder.schema import FLAG

SCHEMA = "effname string, version string, flags int, category string, maintainers array<string>, comment string, links array<struct<link_type:int,url:string,fragment:string>>"
PACKAGE = ("foo", "1.2", 0, "Games", ["a@b.c", "d@e.f"], "A Nice tool", [(0, "http://foo.org/X", None), (1, "https://foo.sourceforge.net/y", "z"), (9, "http://recipe/", None)])


@pytest.fixture(scope="module")
def package(spark):
    return spark.createDataFrame([PACKAGE], SCHEMA).cache()


def matched(package, *matchers):
    """Which of some rules fire, each of them alone."""
    out = rules.apply_rules(package, [{**m, "addflag": "x"} for m in matchers])
    return sorted(out.first()["matched_rules"])


def test_matchers(package):
    yes = [
        {"category": "games"}, {"category": ["x", "GAMES"]}, {"categorypat": "ga.*"}, {"maintainer": "A@B.C"}, {"name": "foo"}, {"name": ["bar", "foo"]}, {"namepat": "f.o"},
        {"ver": "1.2"}, {"ver": ["1", "1.2"]}, {"notver": "1.3"}, {"verpat": "[0-9].2"}, {"verlonger": 1}, {"vercomps": 2},
        {"vergt": "1.1"}, {"verge": "1.2.0"}, {"verlt": "1.3"}, {"verle": "1.2"}, {"vereq": "1.2.0"}, {"verne": "1.3"},
        {"relgt": "1.1"}, {"relge": "1.2"}, {"rellt": "1.3"}, {"relle": "1.2"}, {"releq": "1"}, {"relne": "2"},
        {"wwwpat": "http://foo\\.org/.*"}, {"wwwpart": "FOO.org"}, {"wwwpart": "y#z"}, {"wwwprefix": ["http://foo.org"]}, {"sourceforge": "foo"}, {"summpart": "nice"}, {"noflag": "z"}, {"hasbranch": False}, {"is_p_is_patch": False},
    ]
    no = [
        {"category": "game"}, {"categorypat": "ga"}, {"maintainer": "x@y.z"}, {"name": "Foo"}, {"namepat": "fo"}, {"ver": "1.20"}, {"notver": ["1.2"]}, {"verpat": "2"}, {"verlonger": 2}, {"vercomps": 1},
        {"vergt": "1.2"}, {"verge": "1.3"}, {"verlt": "1.2"}, {"verle": "1.1"}, {"vereq": "1.3"}, {"verne": "1.2.0"},
        {"relgt": "1.2"}, {"relge": "1.3"}, {"rellt": "1.2"}, {"relle": "1.1"}, {"releq": "2"}, {"relne": "1"},
        {"wwwpat": "foo"}, {"wwwpart": "recipe"}, {"wwwprefix": "foo.org"}, {"sourceforge": "bar"}, {"summpart": "bad"}, {"flag": "nosuch"}, {"hasbranch": True}, {"is_p_is_patch": True},
    ]
    assert matched(package, *yes[:17]) == list(range(17))
    assert matched(package, *yes[17:]) == list(range(len(yes) - 17))
    assert matched(package, *no[:15]) == [] and matched(package, *no[15:]) == []


@pytest.mark.parametrize("keyword", sorted(rules.FLAG_ACTIONS))
def test_flag_actions_in_order(keyword):
    assert rules.FLAG_ACTIONS[keyword] in FLAG and keyword in rules.ACTIONS


def test_actions(package):
    one = lambda *r: rules.apply_rules(package, list(r)).first()
    for k in range(0, len(rules.FLAG_ACTIONS), 8):
        some = list(rules.FLAG_ACTIONS.items())[k : k + 8]
        wanted = 0
        for _, flag in some:
            wanted |= FLAG[flag]
        assert one(*[{a: True} for a, _ in some])["flags"] == wanted
    assert one({"ignore": True}, {"ignore": False})["flags"] == 0
    assert one({"last": True}, {"ignore": True})["flags"] == 0
    assert one({"setname": "bar"})["effname"] == "bar" and one({"setname": "x-$0"})["effname"] == "x-foo"
    assert one({"namepat": "(f)(o+)", "setname": "$2-$1-$0"})["effname"] == "oo-f-foo"
    assert one({"verpat": "([0-9])\\.([0-9])", "setver": "$2.$1"})["version"] == "2.1" and one({"setver": "9"})["version"] == "9"
    assert one({"setbranch": "b"})["branch"] == "b" and one({"setbranchcomps": 1})["branch"] == "1" and one({"verpat": "([0-9]).*", "setbranch": "$1.x"})["branch"] == "1.x"
    assert one({"setsubrepo": "s-$0"})["subrepo"] == "s-foo"
    assert one({"addflavor": True})["flavors"] == ["foo"] and one({"addflavor": ["-a-", "b"]})["flavors"] == ["a", "b"]
    assert one({"addflavor": "a"}, {"setflavor": "b"})["flavors"] == ["b"] and one({"addflavor": "a"}, {"resetflavors": True})["flavors"] == []
    assert one({"namepat": "(f)oo", "addflavor": "$1"})["flavors"] == ["f"]
    assert one({"replaceinname": {"o": "0", "f": "g"}})["effname"] == "g00" and one({"setname": "FOO"}, {"tolowername": True})["effname"] == "foo"
    assert one({"addflag": "x"}, {"flag": "x", "ignore": True})["flags"] == FLAG["ignore"]
    assert one({"warning": "careful"})["warnings"] == ["careful"] and one({"warning": "careful", "remove": True})["warnings"] == []
    assert one({"name": "bar", "setname": "no"}, {"name": "foo", "setname": "bar"}, {"name": "bar", "setname": "baz"})["effname"] == "baz"
    assert one({"name": "x-$0", "setname": "foo"})["effname"] == "foo"
    with pytest.raises(ValueError, match="unknown keywords"):
        one({"nosuch": 1})
    with pytest.raises(ValueError, match="flavours"):
        one({"addflavor": 5})


def test_rulesets(package):
    got = rules.apply_rules(package, [{"ruleset": "a", "addflag": "x"}, {"ruleset": ["b", "c"], "addflag": "x"}, {"noruleset": "b", "addflag": "x"}, {"noruleset": "z", "addflag": "x"}], {"b"}).first()
    assert got["matched_rules"] == [1, 3]
    stats = rules.rule_statistics(rules.apply_rules(package.union(package), [{"addflag": "x"}, {"name": "no", "addflag": "x"}]))
    assert [tuple(r) for r in stats.collect()] == [(0, 2)]


def plain(package, rule_set):
    """Name rules one after the other."""
    name, version, flags, marks, fired = package["effname"], package["version"], package["flags"], set(), []
    number = lambda v: [int(x) for x in v.split(".")]
    for k, r in enumerate(rule_set):
        names = r["name"] if isinstance(r["name"], list) else [r["name"]]
        if name not in names or ("ver" in r and version != r["ver"]) or ("flag" in r and r["flag"] not in marks) or ("noflag" in r and r["noflag"] in marks):
            continue
        if ("vergt" in r and not number(version) > number(r["vergt"])) or ("verle" in r and not number(version) <= number(r["verle"])):
            continue
        if "wwwpart" in r and r["wwwpart"] not in package["url"]:
            continue
        fired.append(k)
        for a in rules.FLAG_ACTIONS:
            if a in r:
                bit = FLAG[rules.FLAG_ACTIONS[a]]
                flags = flags | bit if r[a] else flags & ~bit
        if "addflag" in r:
            marks.add(r["addflag"])
        name, version = r.get("setname", name).replace("$0", name), r.get("setver", version)
        if r.get("last"):
            break
    return name, version, flags, fired


def test_large_rule_set(spark):
    rng = random.Random(11)
    names = [f"p{k}" for k in range(3000)]
    rule_set = []
    for _ in range(5000):
        r = {"name": rng.choice(names) if rng.random() < 0.7 else [rng.choice(names) for _ in range(3)]}
        for key, value in (("setname", rng.choice([*names, "$0-x"])), ("devel", rng.random() < 0.7), ("ignore", True), ("weak_devel", False), ("addflag", rng.choice("ab")), ("setver", "3.1"), ("last", True), ("flag", "a"), ("noflag", "b"), ("ver", "1.5"), ("vergt", "1.10"), ("verle", "2.3"), ("wwwpart", "x1")):
            if rng.random() < (0.5 if key == "setname" else 0.12):
                r[key] = value
        if len(r) == 1:
            r["ignore"] = True
        rule_set.append(r)
    rows = [(n, f"{rng.randint(1, 2)}.{rng.randint(0, 20)}", 0, None, None, None, [(0, f"http://x{k % 3}/", None)]) for k, n in enumerate(names)]
    begin = time.time()
    out = rules.apply_rules(spark.createDataFrame(rows, SCHEMA), rule_set)
    assert len(rules._runs(rules.for_repository(rule_set, set()))) == 1
    planned = time.time() - begin
    got = {k: (r["effname"], r["version"], r["flags"], r["matched_rules"]) for k, r in enumerate(out.withColumn("k", F.monotonically_increasing_id()).collect())}
    expected = {k: plain({"effname": n, "version": v, "flags": 0, "url": links[0][1]}, rule_set) for k, (n, v, *_, links) in enumerate(rows)}
    assert got == expected and sum(len(x[3]) > 1 for x in expected.values()) > 300
    assert planned < 60


def test_runs_between_columns(spark):
    """Runs as tables and as columns give the same."""
    rng = random.Random(4)
    rule_set = [{"name": f"n{rng.randrange(30)}", "setname": f"n{rng.randrange(30)}"} if k % 25 else {"namepat": "n([0-9])", "setname": "n1$1"} for k in range(70)]
    df = spark.createDataFrame([(f"n{k}", "1", 0, f"{k:02d}", None, None, None) for k in range(30)], SCHEMA)
    as_table = rules.apply_rules(df, rule_set).select("category", "matched_rules").orderBy("category").collect()
    before, name_rules.SHORTEST_RUN = name_rules.SHORTEST_RUN, 10**9
    try:
        few = rule_set[:27]
        as_columns = rules.apply_rules(df, few).select("category", "matched_rules").orderBy("category").collect()
    finally:
        name_rules.SHORTEST_RUN = before
    assert [[x for x in r["matched_rules"] if x < 27] for r in as_table] == [r["matched_rules"] for r in as_columns]


def test_literals():
    for pattern, wanted in {
        "foo": "foo", "foo.*": "foo", "foo?bar": "bar", "(a|b)cde": "cde", "a|b": "", r"lib\.so[0-9]+": "lib.so", r"\d+x\w": "x", "x{2,3}yz": "yz", "ab+c": "ab", "(?:ab)?cd": "cd",
        "[]a]bc": "bc", r"[\]x]yy": "yy", "(?i)foo": "", "": "", "a.b.ccc": "ccc", "(foo)": "", "py(2|3)-(.*)": "py", "ba*r": "b", "[^]x]q": "q",
    }.items():
        assert pattern_rules.literal(pattern) == wanted, pattern


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"(ab|[cd]|e[?*+]?|\.|\(f[?*]?\)|\\\.|g\{1,2\}){1,8}", fullmatch=True), st.data())
def test_what_matches_holds_the_literal(pattern, data):
    text = data.draw(st.from_regex(pattern, fullmatch=True))
    assert pattern_rules.literal(pattern) in text


compiled = functools.cache(re.compile)


def plain_patterns(name, version, url, category, rule_set):
    """Rules with patterns one after the other."""
    flags, marks, fired = 0, set(), []
    whole = lambda p, t: compiled(p).fullmatch(t)
    for k, r in enumerate(rule_set):
        m = whole(r["namepat"], name) if "namepat" in r else None
        v = whole(r["verpat"].lower(), version.lower()) if "verpat" in r else None
        if ("name" in r and name != r["name"]) or ("namepat" in r and not m) or ("verpat" in r and not v) or ("flag" in r and r["flag"] not in marks):
            continue
        if ("wwwpat" in r and not whole(r["wwwpat"].lower(), url)) or ("wwwpart" in r and r["wwwpart"] not in url) or ("categorypat" in r and not whole(r["categorypat"], category)):
            continue
        fired.append(k)
        flags |= FLAG["devel"] if r.get("devel") else 0
        if "addflag" in r:
            marks.add(r["addflag"])
        fill = lambda t, x, current: re.sub(r"\$([0-9])", lambda g: x[int(g[1])] if x else current, t)
        if "setver" in r:
            version = fill(r["setver"], v, version) if v else r["setver"]
        if "setname" in r:
            name = fill(r["setname"], m, name)
        if r.get("last"):
            break
    return name, version, flags, fired


def test_large_pattern_set(spark):
    """Thousands of pattern rules plan as one and give what rules one after the other give."""
    rng = random.Random(21)
    rule_set = []
    for k in range(5000):
        n = rng.randrange(1500)
        r = rng.choice([{"namepat": f"lib{n}-(.*)"}, {"namepat": f"(py|rb)[0-9]?-mod{n}(-.*)?"}, {"namepat": f"(.*){n}x+"}, {"name": f"lib{n}-a"}, {"wwwpat": f"http://host{n}\\.org/.*"}, {"wwwpart": f"host{n}.o"}])
        if "namepat" in r:
            r["setname"] = rng.choice([f"lib{rng.randrange(1500)}-$1", f"py-mod{rng.randrange(1500)}", f"{rng.randrange(1500)}xx", "$0-y"])
        for key, value in (("verpat", r"([0-9])\.([0-9]+)"), ("devel", True), ("addflag", "m"), ("flag", "m"), ("categorypat", "ga.*"), ("last", True)):
            if rng.random() < 0.2:
                r[key] = value
        if "verpat" in r and rng.random() < 0.5:
            r["setver"] = "$2.$1"
        if len(r) == 1:
            r["devel"] = True
        rule_set.append(r)
    assert len(rules._runs(rules.for_repository(rule_set, set()))) == 1
    rows = []
    for k in range(700):
        n = rng.randrange(1700)
        rows.append((rng.choice([f"lib{n}-a", f"py3-mod{n}", f"rb-mod{n}-z", f"q{n}xx", "plain"]), rng.choice(["1.5", "2.10", "x"]), 0, rng.choice(["games", "net"]), None, None, [(0, f"http://host{rng.randrange(1600)}.org/p", None)]))
    rows.append(("plain", "1", 0, "net", None, None, None))
    begin = time.time()
    out = rules.apply_rules(spark.createDataFrame(rows, SCHEMA), rule_set)
    out.explain()
    planned = time.time() - begin
    got = sorted((r["effname"], r["version"], r["flags"], r["matched_rules"]) for r in out.collect())
    expected = sorted(plain_patterns(n, v, links[0][1] if links else "", c, rule_set) for n, v, _, c, _, _, links in rows)
    assert got == expected and sum(len(x[3]) > 1 for x in expected) > 100 and planned < 10


def test_guard_tries_few_patterns():
    run = [(k, {"namepat": f"lib{k:05d}-.*", "devel": True}) for k in range(5000)]
    finder = pattern_rules.NameRules(run, rules.FLAG_ACTIONS)
    assert [r[0] for k in (7, 4000) for r in finder.of(f"lib{k:05d}-a", [])] == [7, 4000] and finder.tried == 2
