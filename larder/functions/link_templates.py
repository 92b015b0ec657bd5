"""Link templates such as ``https://x/{subrepo|lowercase}/{?field}`` compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACE = re.compile(r"\{([^}]*)\}")


def _first(c: Column) -> Column:
    return F.substring(F.lower(c), 1, 1)


def _number(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).cast("long")), F.lit(0))


def _quote(c: Column) -> Column:
    # url_encode writes forms: a space as plus, and no tilde; paths keep their slashes.
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


FILTERS: dict[str, Callable[[Column], Column]] = {
    "lowercase": F.lower,
    "first_letter": _first,
    "lib_and_first_letter": lambda c: F.when(F.lower(c).startswith("lib"), F.substring(F.lower(c), 1, 4)).otherwise(_first(c)),
    "lib_or_first_letter": lambda c: F.when(F.lower(c).startswith("lib"), F.lit("lib")).otherwise(_first(c)),
    "py_or_first_letter": lambda c: F.when(F.lower(c).startswith("py"), F.lit("py")).otherwise(_first(c)),
    "strip_dmo": lambda c: F.regexp_replace(c, "-dmo$", ""),
    "basename": lambda c: F.substring_index(c, "/", -1),
    "dirname": lambda c: F.when(c.contains("/"), F.regexp_replace(c, "(?s)/[^/]*$", "")).otherwise(c),
    "dec": lambda c: (_number(c) - 1).cast("string"),
    "inc": lambda c: (_number(c) + 1).cast("string"),
    "quote": _quote,
    "strip_nevra_epoch": lambda c: F.regexp_replace(c, "(?s)^[^:]*:", ""),
    "Plus": lambda c: F.replace(c, F.lit("+"), F.lit("Plus")),
}
_PLAIN = ("name", "srcname", "binname", "subrepo", "rawversion", "category", "arch")


def _field(name: str) -> Column:
    raw = F.col("rawversion")
    if name in _PLAIN:
        return F.coalesce(F.col("category"), F.lit("")) if name == "category" else F.col(name)
    if name == "centossuffix":
        return F.when(F.col("subrepo") == "extras", "-extras").otherwise("")
    if name == "rpmversion":
        return F.substring_index(F.regexp_replace(raw, "(?s)-[^-]*$", ""), ":", -1)
    if name == "rpmrelease":
        return F.substring_index(raw, "-", -1)
    return F.element_at(F.col("extrafields"), name)


def _filled(options: Column, mark: str) -> Callable[[Column], Column]:
    return lambda text: F.transform(options, lambda x: F.replace(text, F.lit(mark), x))


def compile_template(template: str, list_fields: tuple[str, ...] = ()) -> Column:
    """array<string> of the links that a package record gives.

    A missing ``{?field}`` gives no link; a missing or empty ``{field}`` is an error. Fields named in
    ``list_fields`` hold several values joined by line feeds in ``extrafields``: all combinations are written,
    in the order of the fields. One filter can follow a field.
    """
    places = list(dict.fromkeys(_PLACE.findall(template)))
    out = F.array(F.lit(template))
    present = F.lit(True)
    for place in places:
        name, *filters = place.split("|", 1)
        optional = name.startswith("?") or name == "centossuffix"
        name = name.removeprefix("?")
        if filters and (filters[0] not in FILTERS or name in list_fields):
            raise ValueError(f"filter {filters[0]!r} can't be used in {template!r}")
        value = _field(name)
        if optional:
            present = present & value.isNotNull()
        else:
            value = F.when(value.isNull() | ((value == "") & F.lit(name != "category")), F.raise_error(F.lit(f"missing or empty {name!r} for {template}"))).otherwise(value)
        options = F.split(value, "\n") if name in list_fields else F.array(value)
        if filters:
            options = F.transform(options, FILTERS[filters[0]])
        mark = "{" + place + "}"
        out = F.flatten(F.transform(out, _filled(options, mark)))
    return F.when(present, out).otherwise(F.array().cast("array<string>"))


def merged_links(parsed: Column, templates: list[tuple[int, int, str]]) -> Column:
    """A package's links: those of templates (link type, priority, template) by falling priority, with the
    parsed ones at priority 0; the first of equal links stays."""
    def typed(link_type: int, template: str) -> Column:
        return F.transform(compile_template(template), lambda u: F.struct(F.lit(link_type).alias("link_type"), u.alias("url"), F.lit(None).cast("string").alias("fragment")))

    ordered = sorted(templates, key=lambda t: -t[1])
    none = F.array().cast("array<struct<link_type:int,url:string,fragment:string>>")
    parts = [typed(k, t) for k, p, t in ordered if p > 0] + [F.coalesce(parsed, none)] + [typed(k, t) for k, p, t in ordered if p <= 0]
    return F.array_distinct(F.concat(*parts))
