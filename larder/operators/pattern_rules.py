"""Long runs of rules with patterns, as a table of the rules that can apply to each name that there is.

A run of pattern rules as columns would test every pattern on every package and make a plan as long as the run. Here each
pattern states a literal text that whatever it matches must hold; an automaton over the literals of all rules (the guard) finds
the few candidates of a name or of a package's links in one pass over their characters, and only their patterns are tried.

Names are looked at once each, wherever they are: distinct names meet the guard in tasks, and what comes out is a row (name, rules
that can follow, under which name) like those of ``name_rules``, which packages meet in one join; the rules' other matchers and their
actions are folded over the list by columns. A rule may rename a project, by groups of its pattern too; the list goes on with
the rules of the new name. Patterns are those of Python's ``re`` where names are concerned.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import name_rules
from larder.operators.name_rules import Rule
from larder.schema import RULE_LINK_TYPES

#: Keywords of rules that can stand in such a run beside those of ``name_rules``.
_PATTERNS = {"namepat", "verpat", "categorypat", "wwwpat"}


def fits(rule: Rule, flags: dict[str, str]) -> bool:
    """Whether a rule can be in a run: it says which names or links it is for, and what it does can be a row."""
    if not rule.keys() <= name_rules.keywords(flags) | _PATTERNS or not rule.keys() & {"name", "namepat", "wwwpat", "wwwpart"}:
        return False
    if "$" in str(rule.get("setver", "")) and "verpat" not in rule:
        return False
    return not ("wwwpat" in rule and "name" not in rule and "namepat" not in rule and not literal(str(rule["wwwpat"]).lower()))


def literal(pattern: str) -> str:
    """The longest text that everything a pattern matches must hold; empty if none is plain to see.

    Only characters outside groups and classes count, which no quantifier may leave out; an alternative outside groups ends the search.
    """
    runs, run, depth, k = [], "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        one, size = "", 1
        if c == "\\":
            size = 2
            if depth == 0 and k + 1 < len(pattern) and not pattern[k + 1].isalnum():
                one = pattern[k + 1]
        elif c == "[":
            end = k + 1 + (pattern[k + 1 : k + 2] == "^")
            end = pattern.index("]", end + 1)
            while pattern[end - 1] == "\\" and pattern[end - 2] != "\\":
                end = pattern.index("]", end + 1)
            size = end - k + 1
        elif c == "(":
            if pattern.startswith("(?", k) and not pattern.startswith(("(?:", "(?P<", "(?=", "(?!", "(?<"), k):
                return ""  # flags change what letters mean
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return ""
        elif c == "{":
            size = pattern.index("}", k) - k + 1
        elif c not in ".^$*+?|" and depth == 0:
            one = c
        k += size
        if one and pattern[k : k + 1] in ("?", "*", "{"):
            one = ""
            runs.append(run)
            run = ""
        elif one:
            run += one
            if pattern[k : k + 1] == "+":
                runs.append(run)
                run = ""
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


class Guard:
    """Literals with the numbers of their rules; which of them a text holds, and which have no literal."""

    def __init__(self, literals: list[tuple[str, int]]):
        import ahocorasick

        self.always = sorted({n for x, n in literals if not x})
        by_text: dict[str, list[int]] = {}
        for x, n in literals:
            if x:
                by_text.setdefault(x, []).append(n)
        self.automaton = ahocorasick.Automaton()
        for x, numbers in by_text.items():
            self.automaton.add_word(x, numbers)
        self.automaton.make_automaton()
        self.some = bool(by_text)

    def of(self, text: str) -> set[int]:
        found = set(self.always)
        if self.some:
            for _, numbers in self.automaton.iter(text):
                found.update(numbers)
        return found


def _filled(template: str, match: re.Match | None, name: str) -> str:
    def group(x: re.Match) -> str:
        n = int(x[1])
        return (match[n] or "") if match is not None else name if n == 0 else x[0]

    return re.sub(r"\$([0-9])", group, template)


class NameRules:
    """Finds all rules of a run that can apply to a package that comes with a name, in order."""

    def __init__(self, run: list[tuple[int, Rule]], flags: dict[str, str]):
        self.rules, self.flags = dict(run), flags
        self.by_name: dict[str, list[int]] = {}
        self.patterns: dict[int, re.Pattern] = {}
        literals = []
        for number, rule in run:
            for name in _names(rule):
                self.by_name.setdefault(name, []).append(number)
            if "namepat" in rule:
                pattern = str(rule["namepat"]).replace("\n", "").replace("$0", str(rule.get("setname", "$0")))
                self.patterns[number] = re.compile(pattern)
                literals.append((literal(pattern), number))
        self.guard = Guard(literals)
        self.tried = 0

    def _candidates(self, name: str) -> list[tuple[int, re.Match | None]]:
        out: list[tuple[int, re.Match | None]] = [(n, None) for n in self.by_name.get(name, ()) if n not in self.patterns]
        for n in self.guard.of(name):
            self.tried += 1
            if (match := self.patterns[n].fullmatch(name)) and ("name" not in self.rules[n] or name in _names(self.rules[n])):
                out.append((n, match))
        return out

    def of(self, start: str, by_links: list[int]) -> list[tuple]:
        """Rules as rows of ``name_rules``; ``by_links`` are rules for any name that the package's links allow."""
        found: dict[tuple[int, str], tuple] = {}
        # A rule sends a name on to later rules only, so the first visit of a name sees all that any later one would.
        todo, seen = [(-1, start)], set()
        while todo:
            after, name = heapq.heappop(todo)
            if name in seen:
                continue
            seen.add(name)
            for number, match in [*self._candidates(name), *((n, None) for n in by_links)]:
                if number > after:
                    rule = self.rules[number]
                    target = _filled(str(rule["setname"]), match, name) if "setname" in rule else None
                    found[number, name] = name_rules.row(number, rule, name, target, self.flags)
                    if target is not None and target not in seen:
                        heapq.heappush(todo, (number, target))
        return [found[k] for k in sorted(found)]


def _names(rule: Rule) -> list[str]:
    """Names that a rule states; $0 among them stands for the name it sets."""
    if "name" not in rule:
        return []
    names = rule["name"] if isinstance(rule["name"], list) else [rule["name"]]
    target = str(rule.get("setname", ""))
    return [str(n).replace("$0", target) if target else str(n) for n in names]


def _link_literals(run: list[tuple[int, Rule]]) -> list[tuple[str, int]]:
    """What the links of a package must hold for rules that say nothing of names."""
    out = []
    for number, rule in run:
        if "name" not in rule and "namepat" not in rule:
            if "wwwpart" in rule:
                parts = rule["wwwpart"] if isinstance(rule["wwwpart"], list) else [rule["wwwpart"]]
                out += [(str(p).lower(), number) for p in parts]
            else:
                out.append((literal(str(rule["wwwpat"]).lower()), number))
    return out


def apply_run(rows: DataFrame, run: list[tuple[int, Rule]], flags: dict[str, str]) -> DataFrame:
    """Rows in the state of the rule language after a run of pattern rules. A null name has no rules."""
    literals = _link_literals(run)
    none = F.array().cast("array<int>")
    if literals:

        @F.pandas_udf("array<int>")
        def by_links(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            guard = Guard(literals)
            for texts in batches:
                yield texts.map(lambda t: sorted(guard.of(t)))

        text = lambda x: F.lower(F.concat_ws("#", x["url"], x["fragment"]))
        links = F.filter(F.coalesce("links", F.array().cast("array<struct<link_type:int,url:string,fragment:string>>")), lambda x: x["link_type"].isin(*RULE_LINK_TYPES))
        rows_in = rows.withColumn("_by_links", by_links(F.array_join(F.transform(links, text), "\n")))
    else:
        rows_in = rows.withColumn("_by_links", none)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = NameRules(run, flags)
        for batch in batches:
            yield pd.DataFrame({"effname": batch["effname"], "_by_links": batch["_by_links"], "_rules": [finder.of(n, list(b)) for n, b in zip(batch["effname"], batch["_by_links"])]})

    names = rows_in.select("effname", "_by_links").filter("effname is not null").distinct()
    found = names.mapInPandas(listed, f"effname string, _by_links array<int>, _rules array<struct<{name_rules.STRUCT}>>")
    found = found.withColumn("_rules", F.transform("_rules", name_rules.keyed)).filter(F.size("_rules") > 0)
    return name_rules.folded(rows_in.join(found, ["effname", "_by_links"], "left"), rows.columns)
