"""Repository configuration: checked, typed, selected by name or group, and parsed by what it says."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.schema import LINK_TYPE
from larder.sources import json_formats, other_formats, readers, text_formats, xml_formats
from larder.sources.packages import Repository

REQUIRED = ("name", "family", "sources")
KNOWN = {*REQUIRED, "sortname", "singular", "type", "desc", "statsgroup", "ruleset", "color", "valid_till", "default_maintainer", "update_period", "minpackages", "pessimized", "shadow", "incomplete", "repolinks", "packagelinks", "groups", "subrepo"}
_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def as_list(value: Any) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def seconds(value: str | int | None) -> int | None:
    """A period such as 90, ``5m``, ``2h``, ``1d`` or ``1w`` in seconds."""
    if value is None or isinstance(value, int):
        return value
    if not (m := re.fullmatch(r"([0-9]+)([mhdw]?)", value)):
        raise ValueError(f"not a period: {value!r}")
    return int(m[1]) * _SECONDS.get(m[2], 1)


def substituted(value: Any, source: str) -> Any:
    """A template with ``{source}`` filled in, at any depth."""
    if isinstance(value, str):
        return value.replace("{source}", source)
    if isinstance(value, list):
        return [substituted(v, source) for v in value]
    if isinstance(value, dict):
        return {k: substituted(v, source) for k, v in value.items()}
    return value


def problems(config: list[dict]) -> list[str]:
    """What is wrong with a configuration; empty if it can be used."""
    out, seen = [], set()
    for k, repo in enumerate(config):
        name = repo.get("name", f"repository {k}")
        out += [f"{name}: {key} is missing" for key in REQUIRED if key not in repo]
        out += [f"{name}: {key} is unknown" for key in sorted(repo.keys() - KNOWN)]
        if name in seen:
            out.append(f"{name}: is there twice")
        seen.add(name)
        if not re.fullmatch(r"[a-z0-9_]+", str(name)):
            out.append(f"{name}: names have small letters, digits and underscores")
        for link in as_list(repo.get("packagelinks")):
            if link.get("type", "").lower() not in LINK_TYPE:
                out.append(f"{name}: unknown link type {link.get('type')!r}")
        for source in as_list(repo.get("sources")):
            parser = source.get("parser", {}).get("class")
            if parser not in PARSERS:
                out.append(f"{name}: unknown parser {parser!r}")
        try:
            seconds(repo.get("update_period"))
        except ValueError as error:
            out.append(f"{name}: {error}")
    return out


def repositories(config: list[dict]) -> list[Repository]:
    """Typed repositories of a checked configuration. Each parser's name is a group of its own."""
    if wrong := problems(config):
        raise ValueError("; ".join(wrong))
    out = []
    for repo in config:
        sources = []
        for source in as_list(repo["sources"]):
            for name in as_list(source.get("name", repo["name"])):
                sources.append(substituted({k: v for k, v in source.items() if k != "name"}, name) | {"name": name})
        links = tuple((LINK_TYPE[x["type"].lower()], x.get("priority", 1), x["url"]) for x in as_list(repo.get("packagelinks")))
        groups = (*as_list(repo.get("groups")), *sorted({s["parser"]["class"] for s in sources}))
        out.append(
            Repository(repo["name"], repo["family"], repo.get("subrepo"), bool(repo.get("shadow")), repo.get("default_maintainer"), groups, tuple(as_list(repo.get("ruleset"))), links, int(repo.get("minpackages", 0)), tuple(sources))
        )
    return out


def selected(known: list[Repository], names: list[str] | None = None) -> list[Repository]:
    """Repositories that are named, or in a group that is; all of them without names. Unknown names are an error."""
    if names is None:
        return list(known)
    everything = {r.name for r in known} | {g for r in known for g in r.groups}
    if unknown := [n for n in names if n not in everything]:
        raise ValueError(f"no repository or group {', '.join(unknown)}")
    return [r for r in known if r.name in names or set(names) & set(r.groups)]


def as_table(spark: SparkSession, known: list[Repository]) -> DataFrame:
    """(repo, family, shadow, minimum, groups, rulesets): the dimension that queries join."""
    rows = [(r.name, r.family, r.shadow, r.minimum, sorted(r.groups), sorted(r.rulesets)) for r in known]
    return spark.createDataFrame(rows, "repo string, family string, shadow boolean, minimum long, groups array<string>, rulesets array<string>")


def config_hash(value: Any) -> str:
    """A digest of rules or configuration: what was parsed with another one is parsed again."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


PARSERS = {**{k: ("xml" if v[0] else "texts", v) for k, v in xml_formats.PARSERS.items()}, **text_formats.PARSERS, **json_formats.PARSERS, **other_formats.PARSERS}


def parsed(spark: SparkSession, source: dict, path: str) -> DataFrame:
    """RAW records of a source: the parser that it names, with its options, over the files of a path."""
    options = {k: v for k, v in source["parser"].items() if k != "class"}
    kind, parser = PARSERS[source["parser"]["class"]]
    if kind == "xml":
        tag, schema, run = parser
        items = readers.xml_rows(spark, path, tag, schema)
        return run(items.select(F.struct(*items.columns).alias("item")), **options)
    if kind == "texts":
        return parser[2](readers.files(spark, path), **options)
    if kind == "sqlite":
        return parser(readers.sqlite_rows(spark, path, "select * from packages", other_formats.REPODATA_COLUMNS), **options)
    read = {"lines": readers.lines, "stanzas": readers.stanzas, "files": readers.files}[kind]
    return parser(read(spark, path), **options)
