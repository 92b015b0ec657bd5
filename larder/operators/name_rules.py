"""Long runs of rules that name their projects, as a table instead of a chain of columns.

Most rules of a large set name the projects they apply to. A run of such rules becomes rows (name, rules), which
packages meet by name in one join; what the rules of a package do is folded over its list. So the plan has one
size, whatever the number of rules. A rule may rename a project; then later rules for the new name count too, and
since names are known beforehand, each name's list holds all rules that can follow.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.versions import lower_bound, upper_bound, version_key
from larder.schema import FLAG, RULE_LINK_TYPES

Rule = dict[str, Any]
#: Runs of fewer rules stay columns.
SHORTEST_RUN = 16
#: Rows that the table of a run may have: it goes to every task.
MOST_ROWS = 2_000_000
#: Actions that set flags, with the flag; they are kept in step with the rule language.
_LISTS = ("ver", "notver", "category", "flag", "noflag", "wwwpart")
_ORDERS = {"vergt": (">", "="), "verge": (">=", "="), "verlt": ("<", "="), "verle": ("<=", "="), "vereq": ("==", "="), "verne": ("!=", "="), "relgt": (">", "+"), "relge": (">", "-"), "rellt": ("<", "-"), "relle": ("<", "+")}
_OTHER = {"name", "setname", "setver", "addflag", "last", "ruleset", "noruleset", "disabled"}
#: Patterns of ``pattern_rules`` that are tried on the package itself, in lower case.
_TRIED = ("verpat", "categorypat", "wwwpat")
_SCHEMA = (
    "number int, name string, setname string, setver string, set_mask int, clear_mask int, ver array<string>, notver array<string>, category array<string>, "
    "flag array<string>, noflag array<string>, wwwpart array<string>, addflag array<string>, last boolean, verpat string, categorypat string, wwwpat string, parts array<struct<text:string,group:int>>, orders array<struct<op:string,bound:string,version:string>>"
)
#: A rule as a struct type.
STRUCT = re.sub(r"(^|, )(\w+) ", r"\1\2:", _SCHEMA)


def keywords(flags: dict[str, str]) -> set[str]:
    return _OTHER | set(_LISTS) | set(_ORDERS) | flags.keys()


def _texts(value: Any) -> list[str]:
    return [str(v) for v in value] if isinstance(value, list) else [str(value)]


def fits(rule: Rule, flags: dict[str, str]) -> bool:
    """Whether a rule can be a row: it names its projects plainly and uses no patterns."""
    if "name" not in rule or not rule.keys() <= keywords(flags):
        return False
    names = _texts(rule["name"])
    dollars = [x for x in names if "$" in x]
    return not dollars and "$" not in str(rule.get("setver", ""))


def row(number: int, rule: Rule, name: str, target: str | None, flags: dict[str, str]) -> tuple:
    """A rule as it applies to a name, in the order of the schema; ``target`` is the name that it sets."""
    masks = [0, 0]
    for k, flag in flags.items():
        if k in rule:  # in the order of the language, so a later one wins
            bit = FLAG[flag]
            masks = [masks[0] | bit, masks[1] & ~bit] if rule[k] else [masks[0] & ~bit, masks[1] | bit]
    lower = ("category", "wwwpart")
    lists = [([x.lower() for x in _texts(rule[k])] if k in lower else _texts(rule[k])) if k in rule else None for k in _LISTS]
    orders = [(op, bound, str(rule[k])) for k, (op, bound) in _ORDERS.items() if k in rule]
    setver, parts = None if "setver" not in rule else str(rule["setver"]), None
    if setver is not None and "$" in setver:  # groups of the version's pattern
        parts = [(None, int(x[1])) if re.fullmatch(r"\$[0-9]", x) else (x, None) for x in re.split(r"(\$[0-9])", setver) if x]
    tried = [f"^(?:{str(rule[k]).lower().replace(chr(10), '')})$" if k in rule else None for k in _TRIED]
    return (number, name, target, setver, masks[0], masks[1], *lists, _texts(rule["addflag"]) if "addflag" in rule else None, "last" in rule, *tried, parts, orders)


def _rows(rules: list[tuple[int, Rule]], flags: dict[str, str]) -> list[tuple]:
    """(key, rule fields): for each name the rules that can apply to a package that has it, in order."""
    by_name: dict[str, list[tuple[int, Rule]]] = {}
    for number, rule in rules:
        for name in dict.fromkeys(_texts(rule["name"])):
            by_name.setdefault(name, []).append((number, rule))

    out = []
    for start in by_name:
        found: dict[tuple[int, str], tuple] = {}
        todo = [(start, -1)]
        while todo:
            name, after = todo.pop()
            for number, rule in by_name.get(name, ()):
                if number > after and (number, name) not in found:
                    target = str(rule["setname"]).replace("$0", name) if "setname" in rule else None
                    found[number, name] = r = row(number, rule, name, target, flags)
                    if r[2] is not None and r[2] != name:
                        todo.append((r[2], number))
        out += [(start, *found[k]) for k in sorted(found)]
        if len(out) > MOST_ROWS:
            raise ValueError(f"a run of name rules has more than {MOST_ROWS} rows; split it")
    return out


def table(spark: SparkSession, rules: list[tuple[int, Rule]], flags: dict[str, str]) -> DataFrame:
    """(effname, _rules): one row for each name."""
    rows = spark.createDataFrame(_rows(rules, flags), f"key string, {_SCHEMA}")
    one = F.struct(*[x.split()[0] for x in _SCHEMA.split(", ")])
    lists = rows.groupBy(F.col("key").alias("effname")).agg(F.array_sort(F.collect_list(one), _by_number).alias("_rules"))  # rules of one name
    return lists.withColumn("_rules", F.transform("_rules", keyed))


def keyed(rule: Column) -> Column:
    """A rule whose version bounds are keys: worked out once for a rule, not for each package."""
    key = lambda o: F.when(o["bound"] == "+", upper_bound(o["version"])).when(o["bound"] == "-", lower_bound(o["version"])).otherwise(version_key(o["version"]))
    return rule.withField("orders", F.transform(rule["orders"], lambda o: F.struct(o["op"].alias("op"), key(o).alias("key"))))


def _by_number(a: Column, b: Column) -> Column:
    return F.when(a["number"] < b["number"], -1).when(a["number"] > b["number"], 1).otherwise(0)


def _holds(s: Column, r: Column) -> Column:
    """Whether a rule fires on a state. Matchers that a rule lacks hold."""
    given = lambda c, test: r[c].isNull() | F.coalesce(test, F.lit(False))
    text = lambda x: F.lower(F.concat_ws("#", x["url"], x["fragment"]))
    linked = F.exists("links", lambda x: x["link_type"].isin(*RULE_LINK_TYPES) & F.rlike(F.concat_ws("#", x["url"], x["fragment"]), r["wwwpat"]))
    part = F.exists("links", lambda x: x["link_type"].isin(*RULE_LINK_TYPES) & F.exists(r["wwwpart"], lambda w: F.contains(text(x), w)))
    key = version_key(s["version"], s["flags"])

    def order(o: Column) -> Column:
        k, b, op = key, o["key"], o["op"]
        return F.when(op == ">", k > b).when(op == ">=", k >= b).when(op == "<", k < b).when(op == "<=", k <= b).when(op == "==", k == b).otherwise(k != b)

    tests = [
        ~s["stopped"],
        s["effname"] == r["name"],
        given("category", F.array_contains(r["category"], F.lower("category"))),
        given("ver", F.array_contains(r["ver"], s["version"])),
        given("notver", ~F.array_contains(r["notver"], s["version"])),
        (F.size(r["orders"]) == 0) | F.coalesce(F.forall(r["orders"], order), F.lit(False)),
        given("wwwpart", part),
        given("wwwpat", linked),
        given("verpat", F.rlike(F.lower(s["version"]), r["verpat"])),
        given("categorypat", F.rlike(F.lower("category"), r["categorypat"])),
        given("flag", F.arrays_overlap(s["rule_flags"], r["flag"])),
        given("noflag", ~F.arrays_overlap(s["rule_flags"], r["noflag"])),
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


_STATE = ("effname", "version", "flags", "rule_flags", "stopped", "matched_rules")


def _after(s: Column, r: Column) -> Column:
    none = F.array().cast("array<string>")
    # The whole version or a group of its pattern, as far as the rule's text asks for them.
    pieces = F.transform(r["parts"], lambda p: F.coalesce(p["text"], F.call_function("regexp_extract", F.lower(s["version"]), r["verpat"], p["group"])))
    filled = F.when(r["parts"].isNotNull(), F.array_join(pieces, "")).otherwise(r["setver"])
    return F.struct(
        F.coalesce(r["setname"], s["effname"]).alias("effname"),
        F.coalesce(filled, s["version"]).alias("version"),
        s["flags"].bitwiseOR(r["set_mask"]).bitwiseAND(F.bitwise_not(r["clear_mask"])).alias("flags"),
        F.array_union(s["rule_flags"], F.coalesce(r["addflag"], none)).alias("rule_flags"),
        (s["stopped"] | r["last"]).alias("stopped"),
        F.concat(s["matched_rules"], F.array(r["number"])).alias("matched_rules"),
    )


def apply_run(rows: DataFrame, rules: list[tuple[int, Rule]], flags: dict[str, str]) -> DataFrame:
    """Rows in the state of the rule language after a run of rules."""
    return folded(rows.join(F.broadcast(table(rows.sparkSession, rules, flags)), "effname", "left"), rows.columns)


def folded(found: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns after the rules in ``_rules``, one after the other; null means none."""
    start = F.struct(*_STATE)
    last = F.aggregate("_rules", start, lambda s, r: F.when(_holds(s, r), _after(s, r)).otherwise(s))
    out = found.withColumn("_state", F.when(F.col("_rules").isNotNull(), last).otherwise(start))
    return out.select(*[F.col(f"_state.{c}").alias(c) if c in _STATE else F.col(c) for c in columns])
