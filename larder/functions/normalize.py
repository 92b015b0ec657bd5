"""Scalar normalisers of package records as column expressions.

A normaliser gives struct(value, note): a null value means the input was dropped, a note says why it was, or
what looked odd. Chains stop at the first drop.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Normaliser = Callable[[Column], Column]
WHITE = " \t\n\r\f\v"
# Schemes of links that are kept.
SCHEMES = ("bzr", "cvs", "ftp", "git", "git+http", "git+https", "gopher", "hg", "hg+http", "http", "https", "irc", "mirror", "mirrors", "svn", "svn+http", "svn+https")
MAX_SUMMARY, MAX_URL = 1024, 2047


def _result(value: Column, note: Column | str | None = None) -> Column:
    text = note if isinstance(note, Column) else F.lit(note)
    return F.struct(value.cast("string").alias("value"), text.cast("string").alias("note"))


def strip(c: Column) -> Column:
    return _result(F.btrim(c, F.lit(WHITE)))


def tolower(c: Column) -> Column:
    return _result(F.lower(c))


def warn_whitespace(c: Column) -> Column:
    return _result(c, F.when(c.rlike("[ \t]"), "white space inside"))


def forbid_newlines(c: Column) -> Column:
    bad = c.contains("\n")
    return _result(F.when(~bad, c), F.when(bad, "more than one line"))


def limit_length(n: int) -> Normaliser:
    return lambda c: _result(F.when(F.length(c) <= n, c), F.when(F.length(c) > n, "too long"))


def url(c: Column) -> Column:
    """Scheme and host in lower case, a path for web links; unknown schemes and other texts are dropped."""
    # Fixed value: what counts as a link.
    pattern = r"(?is)^([a-z][a-z0-9.+-]*)://([^/]+)(/.*)?$"
    ok = c.rlike(pattern)
    scheme, host, path = F.lower(F.regexp_extract(c, pattern, 1)), F.lower(F.regexp_extract(c, pattern, 2)), F.regexp_extract(c, pattern, 3)
    path = F.when(scheme.isin("http", "https", "ftp") & (path == ""), "/").otherwise(path)
    known = scheme.isin(*SCHEMES)
    note = F.when(~ok & ~c.contains("://"), "no scheme").when(~ok, "no host").when(~known, "scheme not known")
    return _result(F.when(ok & known, F.concat(scheme, F.lit("://"), host, path)), note)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the plan once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chain(*steps: Normaliser) -> Normaliser:
    """The steps one after the other; a drop ends the chain, notes are joined."""

    def after(step: Normaliser) -> Normaliser:
        def more(before: Column) -> Column:
            return bound(step(before["value"]), lambda out: _result(out["value"], F.nullif(F.concat_ws("; ", before["note"], out["note"]), F.lit(""))))

        return more

    def run(c: Column) -> Column:
        out = _result(c)
        for step in steps:
            out = bound(out, after(step))
        return out

    def short(c: Column) -> Column:
        value, notes = c, []
        for step in steps:
            out = step(value)
            notes.append(out["note"])
            value = out["value"]
        return _result(value, F.nullif(F.concat_ws("; ", *notes), F.lit("")))

    return short if len(steps) < 3 else run  # two steps are small enough to stay plain expressions


#: The chains of each field of a record.
FIELD = {
    "name": chain(strip, forbid_newlines),
    "version": chain(strip, forbid_newlines),
    "arch": chain(strip, forbid_newlines),
    "subrepo": chain(strip, forbid_newlines),
    "summary": chain(strip, forbid_newlines, limit_length(MAX_SUMMARY)),
    "maintainer": chain(strip, tolower, forbid_newlines, warn_whitespace),
    "category": chain(strip, forbid_newlines),
    "license": chain(strip, forbid_newlines),
    "url": chain(strip, limit_length(MAX_URL), url),
}


def values(items: Column, step: Normaliser) -> Column:
    """A step over an array: kept values in order, the first of each."""
    kept = F.transform(F.filter(items, lambda x: x.isNotNull() & (x != "")), lambda x: step(x)["value"])
    return F.array_distinct(F.filter(kept, lambda x: x.isNotNull()))


def or_null(items: Column) -> Column:
    """Null for an empty array: the model has no empty lists."""
    return bound(items, lambda x: F.when(F.size(x) > 0, x))


def split_link(link: Column) -> Column:
    """A raw link {link_type, url} with the fragment apart; number signs at the end say nothing."""
    plain = F.rtrim(link["url"], F.lit("#"))
    at = F.split(plain, "#", 2)
    return F.struct(link["link_type"].alias("link_type"), FIELD["url"](F.get(at, F.lit(0)))["value"].alias("url"), F.get(at, F.lit(1)).alias("fragment"))


def links(items: Column) -> Column:
    out = F.transform(items, split_link)
    return or_null(F.array_distinct(F.filter(out, lambda x: x["url"].isNotNull())))


def extract_maintainers(text: Column) -> Column:
    """Sorted addresses in a free text: those in angle brackets, and bare ones in parts without other words."""
    address = r"^[^<> \t]+@[^<> \t]+$"

    def of_part(part: Column) -> Column:
        words = F.filter(F.split(F.btrim(part, F.lit(WHITE)), r"\s+"), lambda w: w != "")
        bracketed = F.filter(words, lambda w: w.startswith("<") & w.endswith(">"))
        bare = F.filter(words, lambda w: ~(w.startswith("<") & w.endswith(">")))
        inside = F.filter(F.transform(bracketed, lambda w: F.btrim(w, F.lit("<>"))), lambda w: w.rlike(address))
        alone = F.when(F.forall(bare, lambda w: w.rlike(address)), bare).otherwise(F.array().cast("array<string>"))
        return F.concat(inside, alone)

    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.lower(text), ","), of_part)))), F.array().cast("array<string>"))


def split_cpe(text: Column) -> Column:
    """Parts of a CPE name at colons that no backslash escapes; escapes stay."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)\\.|:|[^\\:]+|\\$"), F.lit(0))
    start = F.array(F.lit(""))

    def fold(acc: Column, t: Column) -> Column:
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), t)))
        return F.when(t == ":", F.concat(acc, F.array(F.lit("")))).otherwise(grown)

    return F.aggregate(tokens, start, fold)


def mapped_maintainers(maintainers: Column, hidden: list[str], replaced: dict[str, str]) -> Column:
    """Maintainers without the hidden ones and with others replaced; nothing is deduplicated afterwards."""
    kept = F.filter(maintainers, lambda m: ~m.isin(*hidden)) if hidden else maintainers
    if not replaced:
        return kept
    table = F.create_map(*[F.lit(x) for pair in replaced.items() for x in pair])
    return F.transform(kept, lambda m: F.coalesce(F.element_at(table, m), m))


def simplify_url(text: Column) -> Column:
    """What two links to the same place have in common; the order of the steps matters."""
    steps = (
        (r"^https?://web\.archive\.org/web/([0-9]{10}[^/]*/|\*/)?", ""),
        (r"#.*", ""),
        (r"\?.*", ""),
        (r"/$", ""),
        (r"^https?://", ""),
        (r"^www\.", ""),
    )
    return reduce(lambda c, s: F.regexp_replace(c, "(?s)" + s[0], s[1]), steps, F.lower(text))


def url_hash(text: Column) -> Column:
    """The first 16 hex digits of the MD5 of the simplified link, as a signed number."""
    return F.conv(F.left(F.md5(simplify_url(text).cast("binary")), F.lit(16)), 16, -10).cast("long")
