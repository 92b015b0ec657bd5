"""An ordered rule language over packages, compiled to column expressions.

Rules run in their order; a rule fires if all of its matchers hold, and later rules see what its actions
changed. Matchers and actions of a rule run in the order of the tables below, not in that of its text. Each
rule becomes a few columns over the state of the rules before it, so a whole rule set is one narrow stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.versions import KEY_TYPE, lower_bound, upper_bound, version_key
from larder.operators import name_rules, pattern_rules
from larder.schema import FLAG, RULE_LINK_TYPES

STATE = ("effname", "version", "flags", "flavors", "branch", "subrepo", "rule_flags", "stopped", "matched_rules", "warnings")
Rule = dict[str, Any]


def as_list(value: Any) -> list[str]:
    return [str(v) for v in value] if isinstance(value, list) else [str(value)]


def _lower(value: Any) -> list[str]:
    return [v.lower() for v in as_list(value)]


def _whole(pattern: str) -> str:
    return f"^(?:{pattern.replace(chr(10), '')})$"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


#: The keys that a version in a rule may stand for.
BOUNDS = {"exact": version_key, "lower": lower_bound, "upper": upper_bound}


def _bound(value: Any, rule: Rule, bound: str) -> Column:
    return rule["_keys"][bound, str(value)]


def _compared(op: Callable[[Column, Column], Column], bound: str = "exact") -> Callable[[Any, Rule], Column]:
    return lambda value, rule: op(F.col("_key"), _bound(value, rule, bound))


def _link(test: Callable[[Column], Column]) -> Column:
    text = lambda x: F.concat_ws("#", x["url"], x["fragment"])
    return F.coalesce(F.exists("links", lambda x: x["link_type"].isin(*RULE_LINK_TYPES) & test(text(x))), F.lit(False))


def _named(value: Any, rule: Rule) -> list[str]:
    target = str(rule["setname"]) if "setname" in rule else ""
    return [v.replace("$0", target) if "$0" in v and target else v for v in as_list(value)]


def _components(v: Column) -> Column:
    return F.size(F.split(v, "[^a-zA-Z0-9]"))


def _sourceforge(value: Any, rule: Rule) -> Column:
    hosts = [f"{s}://{h}" for p in _lower(value) for s in ("https", "http") for h in (f"sourceforge.net/projects/{p}/", f"{p}.sourceforge.net/", f"{p}.sourceforge.io/", f"{p}.sf.net/")]
    return _link(lambda t: _any([F.lower(t).startswith(h) for h in hosts]))


#: Keyword and condition, in the order in which they are tested.
MATCHERS: dict[str, Callable[[Any, Rule], Column]] = {
    "category": lambda v, r: F.lower("category").isin(*_lower(v)),
    "categorypat": lambda v, r: F.lower("category").rlike(_whole(str(v).lower())),
    "maintainer": lambda v, r: F.exists("maintainers", lambda m: m.isin(*_lower(v))),
    "name": lambda v, r: F.col("effname").isin(*_named(v, r)),
    "namepat": lambda v, r: F.col("effname").rlike(_whole(_named(v, r)[0])),
    "ver": lambda v, r: F.col("version").isin(*as_list(v)),
    "notver": lambda v, r: ~F.col("version").isin(*as_list(v)),
    "verpat": lambda v, r: F.lower("version").rlike(_whole(str(v).lower())),
    "verlonger": lambda v, r: _components(F.col("version")) > int(v),
    "vercomps": lambda v, r: _components(F.col("version")) == int(v),
    "vergt": _compared(lambda a, b: a > b),
    "verge": _compared(lambda a, b: a >= b),
    "verlt": _compared(lambda a, b: a < b),
    "verle": _compared(lambda a, b: a <= b),
    "vereq": _compared(lambda a, b: a == b),
    "verne": _compared(lambda a, b: a != b),
    "relgt": _compared(lambda a, b: a > b, "upper"),
    "relge": _compared(lambda a, b: a > b, "lower"),
    "rellt": _compared(lambda a, b: a < b, "lower"),
    "relle": _compared(lambda a, b: a < b, "upper"),
    "releq": lambda v, r: (F.col("_key") > _bound(v, r, "lower")) & (F.col("_key") < _bound(v, r, "upper")),
    "relne": lambda v, r: (F.col("_key") < _bound(v, r, "lower")) | (F.col("_key") > _bound(v, r, "upper")),
    "wwwpat": lambda v, r: _link(lambda t: t.rlike(_whole(str(v).lower()))),
    "wwwpart": lambda v, r: _link(lambda t: _any([F.lower(t).contains(x) for x in _lower(v)])),
    "wwwprefix": lambda v, r: _link(lambda t: _any([F.lower(t).startswith(x) for x in _lower(v)])),
    "sourceforge": _sourceforge,
    "summpart": lambda v, r: _any([F.lower("comment").contains(x) for x in _lower(v)]),
    "flag": lambda v, r: F.arrays_overlap("rule_flags", F.array(*[F.lit(x) for x in as_list(v)])),
    "noflag": lambda v, r: ~F.arrays_overlap("rule_flags", F.array(*[F.lit(x) for x in as_list(v)])),
    "hasbranch": lambda v, r: F.col("branch").isNotNull() == F.lit(bool(v)),
    "is_p_is_patch": lambda v, r: (F.col("flags").bitwiseAND(F.lit(FLAG["p_is_patch"])) != 0) == F.lit(bool(v)),
}


#: Matchers that look at the key of the version, and actions after which it is another.
ORDERS = {"vergt", "verge", "verlt", "verle", "vereq", "verne", "relgt", "relge", "rellt", "relle", "releq", "relne"}
NEW_KEY = {"setver", "p_is_patch", "any_is_patch"}


def bound_keys(spark: SparkSession, rules: list[tuple[int, Rule]]) -> dict[tuple[str, str], Column]:
    """Keys of all versions that rules name, as literals: Spark works them out once, when the rules are compiled."""
    texts = sorted({str(rule[k]) for _, rule in rules for k in ORDERS & rule.keys()})
    if not texts:
        return {}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *[f(F.col("text")).alias(b) for b, f in BOUNDS.items()]).collect()  # as many as rules
    unit = lambda x: F.struct(*[F.lit(v).alias(n) for n, v in x.asDict().items()])
    return {(b, r["text"]): F.array(*map(unit, r[b])).cast(KEY_TYPE) for r in rows for b in BOUNDS}


# Actions that set or clear a flag, and the flag, in the order in which they are taken.
FLAG_ACTIONS = {
    "remove": "remove",
    "ignore": "ignore",
    "weak_devel": "ignore",
    "stable": "stable",
    "devel": "devel",
    "p_is_patch": "p_is_patch",
    "any_is_patch": "any_is_patch",
    "sink": "sink",
    "outdated": "outdated",
    "legacy": "legacy",
    "nolegacy": "nolegacy",
    "incorrect": "incorrect",
    "untrusted": "untrusted",
    "noscheme": "noscheme",
    "rolling": "rolling",
    "snapshot": "ignore",
    "successor": "devel",
    "debianism": "devel",
    "generated": "rolling",
    "trace": "trace",
    "altver": "altver",
    "altscheme": "altscheme",
    "vulnerable": "vulnerable",
    "recalled": "recalled",
}


def _flag(name: str) -> Callable:
    mask = FLAG[name]

    def action(value: Any, rule: Rule) -> dict[str, Column]:
        flags = F.col("flags").bitwiseOR(F.lit(mask)) if value else F.col("flags").bitwiseAND(F.lit(~mask))
        return {"flags": flags}

    return action


def _filled(template: str, current: str, captured: str, pattern: str | None) -> Column:
    """A template with $0 as the current value, or, after a pattern matched, $0 to $9 as its groups."""
    parts: list[Column] = []
    for piece in re.split(r"(\$[0-9])", template):
        if re.fullmatch(r"\$[0-9]", piece) and pattern is not None:
            parts.append(F.regexp_extract(F.col(captured), _whole(pattern), int(piece[1])))
        elif piece == "$0":
            parts.append(F.col(current))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def _by_name(template: str, rule: Rule) -> Column:
    return _filled(template, "effname", "_name", _named(rule["namepat"], rule)[0] if "namepat" in rule else None)


def _by_version(template: str, rule: Rule) -> Column:
    return _filled(template, "version", "_version", str(rule["verpat"]).lower() if "verpat" in rule else None)


def _flavors(value: Any, rule: Rule) -> Column:
    if value is not True and value is not False and not isinstance(value, (str, list)):
        raise ValueError("flavours must be given as true, a text or a list")
    wanted = as_list(value) if isinstance(value, (str, list)) else ["$0"]
    texts = [F.col("effname") if value in (True, False) else _by_name(w, rule) for w in wanted]
    return F.filter(F.transform(F.array(*texts), lambda x: F.btrim(x, F.lit("-"))), lambda x: x != "")


def _replaced(value: dict[str, str], rule: Rule) -> dict[str, Column]:
    return {"effname": reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), value.items(), F.col("effname"))}


#: Keyword and changes of state, in the order in which they are made.
ACTIONS: dict[str, Callable[[Any, Rule], dict[str, Column]]] = {
    **{k: _flag(f) for k, f in FLAG_ACTIONS.items() if k != "recalled"},
    "last": lambda v, r: {"stopped": F.lit(True)},
    "addflavor": lambda v, r: {"flavors": F.concat("flavors", _flavors(v, r))},
    "setflavor": lambda v, r: {"flavors": _flavors(v, r)},
    "resetflavors": lambda v, r: {"flavors": F.array().cast("array<string>")},
    "setbranch": lambda v, r: {"branch": _by_version(str(v), r)},
    "setbranchcomps": lambda v, r: {"branch": F.array_join(F.slice(F.split("version", "[^a-zA-Z0-9]"), 1, int(v)), ".")},
    "addflag": lambda v, r: {"rule_flags": F.array_union("rule_flags", F.array(*[F.lit(x) for x in as_list(v)]))},
    "setname": lambda v, r: {"effname": _by_name(str(v), r)},
    "setver": lambda v, r: {"version": _by_version(str(v), r)},
    "setsubrepo": lambda v, r: {"subrepo": _by_name(str(v), r)},
    "replaceinname": _replaced,
    "tolowername": lambda v, r: {"effname": F.lower("effname")},
    "warning": lambda v, r: {"warnings": F.concat("warnings", F.array(F.lit(str(v))))},
    "recalled": _flag("recalled"),
}
_OTHER = {"ruleset", "noruleset", "disabled"}


def for_repository(rules: list[Rule], rulesets: set[str]) -> list[tuple[int, Rule]]:
    """Rules with their numbers, without those for other rule sets."""
    out = []
    for number, rule in enumerate(rules):
        if unknown := rule.keys() - MATCHERS.keys() - ACTIONS.keys() - _OTHER:
            raise ValueError(f"rule {number}: unknown keywords {sorted(unknown)}")
        if "ruleset" in rule and not rulesets & set(as_list(rule["ruleset"])):
            continue
        if "noruleset" in rule and rulesets & set(as_list(rule["noruleset"])):
            continue
        out.append((number, rule))
    return out


def apply_rules(packages: DataFrame, rules: list[Rule], rulesets: set[str] = frozenset()) -> DataFrame:
    """``packages`` after the rules, with ``matched_rules`` and ``warnings``.

    effname starts as projectname_seed where that column is there. Removed packages are not dropped here
    (``without_removed`` does); warnings of removed packages are cleared.
    """
    names = packages.columns
    texts = F.array().cast("array<string>")
    start = {
        "effname": F.col("projectname_seed") if "projectname_seed" in names else F.col("effname"),
        "flags": F.coalesce(F.col("flags"), F.lit(0)) if "flags" in names else F.lit(0),
        "flavors": F.coalesce(F.col("flavors"), texts) if "flavors" in names else texts,
        "rule_flags": texts,
        "stopped": F.lit(False),
        "matched_rules": F.array().cast("array<int>"),
        "warnings": texts,
    }
    empty = {"branch": "string", "subrepo": "string", "comment": "string", "category": "string", "maintainers": "array<string>", "links": "array<struct<link_type:int,url:string,fragment:string>>"}
    start |= {c: F.lit(None).cast(t) for c, t in empty.items() if c not in names}
    rows = packages.withColumns(start)
    runs = _runs(for_repository(rules, rulesets))
    keys = bound_keys(packages.sparkSession, [x for run in runs if len(run) < name_rules.SHORTEST_RUN for x in run])
    known = False  # whether _key is that of the version as it is now
    for run in runs:
        if len(run) >= name_rules.SHORTEST_RUN:
            plain = all(name_rules.fits(rule, FLAG_ACTIONS) for _, rule in run)
            rows = (name_rules if plain else pattern_rules).apply_run(rows, run, FLAG_ACTIONS)
            known = False
            continue
        for number, rule in run:
            if ORDERS & rule.keys() and not known:
                rows, known = rows.withColumn("_key", version_key(F.col("version"), F.col("flags"))), True
            rows = _one(rows, number, {**rule, "_keys": keys})
            known = known and not NEW_KEY & rule.keys()
    removed = F.col("flags").bitwiseAND(F.lit(FLAG["remove"])) != 0
    rows = rows.withColumn("warnings", F.when(removed, texts).otherwise(F.col("warnings")))
    extra = [c for c in ("effname", "flags", "flavors", "branch", "subrepo") if c not in names]
    # Rows of one-element arrays: later filters stay above, else they would repeat the whole chain of rules.
    return rows.select(F.inline(F.array(F.struct(*names, *extra, "matched_rules", "warnings"))))


def _runs(rules: list[tuple[int, Rule]]) -> list[list[tuple[int, Rule]]]:
    """Rules in order: long runs of rules for names and patterns by themselves, all others in runs of one."""
    out: list[list[tuple[int, Rule]]] = []
    run: list[tuple[int, Rule]] = []
    for number, rule in [*rules, (-1, {})]:
        if rule and (name_rules.fits(rule, FLAG_ACTIONS) or pattern_rules.fits(rule, FLAG_ACTIONS)):
            run.append((number, rule))
            continue
        out += [run] if len(run) >= name_rules.SHORTEST_RUN else [[x] for x in run]
        run = []
        if rule:
            out.append([(number, rule)])
    return out


def _one(rows: DataFrame, number: int, rule: Rule) -> DataFrame:
    tests = [F.coalesce(MATCHERS[k](rule[k], rule), F.lit(False)) for k in MATCHERS if k in rule]
    fires = reduce(lambda a, b: a & b, tests, ~F.col("stopped"))
    rows = rows.withColumns({"_fires": fires, "_name": F.col("effname"), "_version": F.lower("version")})
    for k in ACTIONS:
        if k in rule:
            rows = rows.withColumns({c: F.when(F.col("_fires"), new).otherwise(F.col(c)) for c, new in ACTIONS[k](rule[k], rule).items()})
    return rows.withColumn("matched_rules", F.when(F.col("_fires"), F.concat("matched_rules", F.array(F.lit(number)))).otherwise(F.col("matched_rules")))


def without_removed(packages: DataFrame) -> DataFrame:
    return packages.filter(F.col("flags").bitwiseAND(F.lit(FLAG["remove"])) == 0)


def tidy_flavors(packages: DataFrame) -> DataFrame:
    return packages.withColumn("flavors", F.array_sort(F.array_distinct("flavors")))


def rule_statistics(ruled: DataFrame) -> DataFrame:
    """(rule, n): how many packages each rule changed."""
    return ruled.select(F.explode("matched_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
