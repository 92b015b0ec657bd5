"""Version order as a sortable column.

A version is cut into numbers and words. Each component other than zero becomes one unit of the key: its sign
(words for pre-releases sort below zero, all else above), how many zeros stand before it, then rank, length and
text. Of two versions that agree so far, one with fewer zeros before a component above zero is greater, and one
with fewer zeros before a component below zero is less; the end counts as zeros for ever. So keys need no
filling up, whatever the number of components, and Spark's own array comparison orders them: sorts, windows,
``max_by``, range joins and equality all work on the key without a UDF.

Ranks, from low to high: below everything (for release bounds), pre-release words, zero, post-release words,
a single letter after a number, other numbers, above everything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.schema import FLAG

LOWEST, PRE, ZERO, POST, LETTER, NUMBER, HIGHEST = range(7)
#: Words that name a release after the plain version.
POST_WORDS = ("post", "patch", "pl", "errata")
_MARK = "\x01"
#: Versions whose key needs no look at their tokens.
PLAIN = r"^[1-9][0-9]*(\.[1-9][0-9]*)?\z"
#: The same with short numbers, for keys as text.
SHORT = r"^[1-9][0-9]{0,8}(\.[1-9][0-9]{0,8})?\z"
KEY_TYPE = "array<struct<sign:int,zeros:int,rank:int,size:int,text:string>>"


def _component(rank: Column | int, size: Column | int = 0, text: Column | str = "") -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(rank).cast("int").alias("rank"), as_col(size).cast("int").alias("size"), as_col(text).cast("string").alias("text"))


def _tokens(version: Column) -> Column:
    """Numbers and words; a single letter that ends a number keeps a mark, a word before a number a number sign."""
    low = F.lower(F.coalesce(version, F.lit("")))
    low = F.regexp_replace(low, r"(?<=[0-9])([a-z])(?![a-z0-9])", _MARK + "$1")
    return F.regexp_extract_all(low, F.lit(_MARK + r"[a-z]|[0-9]+|[a-z]+"), F.lit(0))


def _key(parts: Column) -> Column:
    """Units of the components other than zero, and the end."""

    def add(done: Column, x: Column) -> Column:
        sign = F.when(x["rank"] < ZERO, -1).otherwise(1)
        unit = F.struct(sign.alias("sign"), (-sign * done["zeros"]).alias("zeros"), x["rank"].alias("rank"), x["size"].alias("size"), x["text"].alias("text"))
        more = F.struct(F.lit(0).alias("zeros"), F.concat(done["key"], F.array(unit)).alias("key"))
        return F.when(x["rank"] == ZERO, F.struct((done["zeros"] + 1).alias("zeros"), done["key"].alias("key"))).otherwise(more)

    start = F.struct(F.lit(0).alias("zeros"), F.array().cast(KEY_TYPE).alias("key"))
    end = F.struct(F.lit(0).alias("sign"), F.lit(0).alias("zeros"), F.lit(ZERO).alias("rank"), F.lit(0).alias("size"), F.lit("").alias("text"))
    return F.aggregate(parts, start, add, lambda done: F.concat(done["key"], F.array(end)))


def _plain_key(version: Column) -> Column:
    """The key of one or two numbers above zero, without taking the version to pieces."""

    def unit(number: Column) -> Column:
        return F.struct(F.lit(1).alias("sign"), F.lit(0).alias("zeros"), F.lit(NUMBER).alias("rank"), F.length(number).alias("size"), number.alias("text"))

    end = F.struct(F.lit(0).alias("sign"), F.lit(0).alias("zeros"), F.lit(ZERO).alias("rank"), F.lit(0).alias("size"), F.lit("").alias("text"))
    two = F.array(unit(F.substring_index(version, ".", 1)), unit(F.substring_index(version, ".", -1)), end)
    return F.when(F.instr(version, ".") > 0, two).otherwise(F.array(unit(version), end)).cast(KEY_TYPE)


def version_key(version: Column, flags: Column | None = None, fill: int = ZERO) -> Column:
    """The key of a version; flags say whether ``p`` or any word means a patch. A null version equals zero."""
    p_is_patch = F.lit(False) if flags is None else flags.bitwiseAND(F.lit(FLAG["p_is_patch"])) != 0
    any_is_patch = F.lit(False) if flags is None else flags.bitwiseAND(F.lit(FLAG["any_is_patch"])) != 0

    def one(token: Column) -> Column:
        digits = F.ltrim(token, F.lit("0"))
        number = F.when(digits == "", _component(ZERO)).otherwise(_component(NUMBER, F.length(digits), digits))
        word = F.ltrim(token, F.lit(_MARK))
        post = any_is_patch | word.isin(*POST_WORDS) | (p_is_patch & (word == "p"))
        rank = F.when(post, POST).when(token.startswith(_MARK), LETTER).otherwise(PRE)
        return F.when(token.rlike("^[0-9]"), number).otherwise(_component(rank, 0, F.substring(word, 1, 1)))

    parts = F.transform(_tokens(version), one)
    if fill != ZERO:
        return _key(F.concat(parts, F.array(_component(fill))))
    return F.when(version.rlike(PLAIN), _plain_key(version)).otherwise(_key(parts))


def lower_bound(version: Column) -> Column:
    """Below every version that begins with the given one."""
    return version_key(version, fill=LOWEST)


def upper_bound(version: Column) -> Column:
    """Above every version that begins with the given one."""
    return version_key(version, fill=HIGHEST)


def _number_text(n: Column) -> Column:
    """An int as eight digits that sort as it does among those of its sign."""
    return F.lpad(F.hex(F.when(n < 0, n + F.lit(2**31)).otherwise(n)), 8, "0")


def text_key(key: Column) -> Column:
    """A key as text whose bytes sort as the key does: shorter, and quicker to compare. No such text begins another unit's."""

    def unit(u: Column) -> Column:
        sign = F.when(u["sign"] < 0, "a").when(u["sign"] == 0, "b").otherwise("c")
        zeros = F.when(u["zeros"] == 0, "b").otherwise(F.concat(F.when(u["zeros"] < 0, "a").otherwise("c"), _number_text(u["zeros"])))
        size = F.when(u["size"] < 10, u["size"].cast("string")).otherwise(F.concat(F.lit("a"), _number_text(u["size"])))
        return F.concat(sign, zeros, u["rank"].cast("string"), size, u["text"])

    return F.array_join(F.transform(key, unit), "")


def _short_text(version: Column) -> Column:
    """``text_key`` of one or two short numbers above zero, without a key."""
    number = lambda n: [F.lit(f"cb{NUMBER}"), F.length(n).cast("string"), n]
    first, last, end = F.substring_index(version, ".", 1), F.substring_index(version, ".", -1), F.lit(f"bb{ZERO}0")
    return F.when(F.instr(version, ".") > 0, F.concat(*number(first), *number(last), end)).otherwise(F.concat(*number(version), end))


def metaorder(flags: Column) -> Column:
    """Rolling versions above all others, sunk ones below."""
    return F.when(flags.bitwiseAND(F.lit(FLAG["rolling"])) != 0, 1).when(flags.bitwiseAND(F.lit(FLAG["sink"])) != 0, -1).otherwise(0)


def package_key(version: Column, flags: Column) -> Column:
    """What packages of a project are ordered by, as text."""
    meta = metaorder(flags)
    key = F.when(version.rlike(SHORT), _short_text(version)).otherwise(text_key(version_key(version, flags)))
    return F.concat(F.when(meta < 0, "a").when(meta == 0, "b").otherwise("c"), key)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two keys."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def version_set_changed(old: Column, new: Column) -> Column:
    """Whether the first of two sorted version lists differs, or one list alone is null."""
    first = lambda x: version_key(F.get(x, F.lit(0)))
    both = old.isNotNull() & new.isNotNull()
    return F.when(both, F.coalesce((F.size(old) > 0) & (F.size(new) > 0) & (first(old) != first(new)), F.lit(False))).otherwise(old.isNull() != new.isNull())


def strip_left(v: Column, sep: str) -> Column:
    """What follows the first separator; all of it if there is none."""
    return F.when(F.instr(v, sep) > 0, F.substr(v, F.instr(v, sep) + len(sep))).otherwise(v)


def strip_left_greedy(v: Column, sep: str) -> Column:
    return F.substring_index(v, sep, -1)


def strip_right(v: Column, sep: str) -> Column:
    """What precedes the last separator; all of it if there is none."""
    return F.when(F.instr(v, sep) > 0, F.substr(v, F.lit(1), F.length(v) - F.length(F.substring_index(v, sep, -1)) - len(sep))).otherwise(v)


def strip_right_greedy(v: Column, sep: str) -> Column:
    return F.substring_index(v, sep, 1)
