"""Types and fixed codes of the package model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The numbers are part of the data format.
STATUS = {
    "unprocessed": 0,
    "newest": 1,
    "outdated": 2,
    "ignored": 3,
    "unique": 4,
    "devel": 5,
    "legacy": 6,
    "incorrect": 7,
    "untrusted": 8,
    "noscheme": 9,
    "rolling": 10,
}
IGNORED_STATUSES = (3, 7, 8, 9, 10)

# Bit numbers of package flags; bit 6 is not used.
FLAG_BITS = {
    "remove": 0,
    "devel": 1,
    "ignore": 2,
    "incorrect": 3,
    "untrusted": 4,
    "noscheme": 5,
    "rolling": 7,
    "sink": 8,
    "legacy": 9,
    "p_is_patch": 10,
    "any_is_patch": 11,
    "trace": 12,
    "weak_devel": 13,
    "stable": 14,
    "altver": 15,
    "vulnerable": 16,
    "altscheme": 17,
    "nolegacy": 18,
    "outdated": 19,
    "recalled": 20,
}
FLAG = {name: 1 << bit for name, bit in FLAG_BITS.items()}
ANY_IGNORED = FLAG["ignore"] | FLAG["incorrect"] | FLAG["untrusted"] | FLAG["noscheme"]

# Link type numbers; 24 is not used.
LINK_TYPE = {
    "upstream_homepage": 0,
    "upstream_download": 1,
    "upstream_repository": 2,
    "upstream_issue_tracker": 3,
    "project_homepage": 4,
    "package_homepage": 5,
    "package_download": 6,
    "package_sources": 7,
    "package_issue_tracker": 8,
    "package_recipe": 9,
    "package_recipe_raw": 10,
    "package_patch": 11,
    "package_patch_raw": 12,
    "package_build_log": 13,
    "package_build_log_raw": 14,
    "package_new_version_checker": 15,
    "upstream_documentation": 16,
    "upstream_changelog": 17,
    "project_download": 18,
    "upstream_donation": 19,
    "upstream_discussion": 20,
    "upstream_coverage": 21,
    "upstream_ci": 22,
    "upstream_wiki": 23,
    "package_statistics": 25,
    "package_build_status": 26,
    "package_build_logs": 27,
    "upstream_download_page": 28,
    "other": 99,
}
RULE_LINK_TYPES = (18, 4, 1, 0, 2)
PRIORITY_LINK_TYPES = (0, 1, 2, 3, 16, 17, 19, 20, 21, 22, 23)
RELATION_LINK_TYPES = (0, 2, 4, 16, 20, 23, 28)

LINK = T.StructType([T.StructField("link_type", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("fragment", T.StringType())])
CPE_FIELDS = ("vendor", "product", "edition", "lang", "sw_edition", "target_sw", "target_hw", "other")


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(T.StringType())) for n in names]


PACKAGE = T.StructType(
    _text("repo", "family", "subrepo", "name", "srcname", "binname")
    + _texts("binnames")
    + _text("trackname", "visiblename", "projectname_seed", "origversion", "version", "rawversion", "arch")
    + _texts("maintainers")
    + _text("category", "comment")
    + _texts("licenses")
    + [T.StructField("extrafields", T.MapType(T.StringType(), T.StringType()))]
    + _text(*(f"cpe_{c}" for c in CPE_FIELDS))
    + [
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("effname", T.StringType()),
        T.StructField("versionclass", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("shadow", T.BooleanType()),
    ]
    + _texts("flavors")
    + _text("branch")
)

#: What readers give: the fields a source states, names by kind, links not yet split.
RAW = T.StructType(
    [T.StructField("names", T.MapType(T.StringType(), T.StringType()))]
    + _text("version", "rawversion", "arch", "subrepo", "summary")
    + _texts("maintainers", "licenses", "categories", "binnames", "flavors")
    + [
        T.StructField("links", T.ArrayType(T.StructType([T.StructField("link_type", T.IntegerType()), T.StructField("url", T.StringType())]))),
        T.StructField("extrafields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cpe", T.MapType(T.StringType(), T.StringType())),
        T.StructField("flags", T.IntegerType()),
    ]
)


def has(flags: Column | str, *names: str) -> Column:
    """Whether any of the named flags is set."""
    mask = 0
    for n in names:
        mask |= FLAG[n]
    return F.col(flags).bitwiseAND(F.lit(mask)) != 0 if isinstance(flags, str) else flags.bitwiseAND(F.lit(mask)) != 0
