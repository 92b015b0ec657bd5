"""Debian and RPM version strings as (version, flags), with column expressions only.

A version is cut into parts and the parts folded into a result by ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.versions import strip_left, strip_right, version_key
from larder.schema import FLAG

# Words that distributions add to upstream versions.
DEBIAN_GARBAGE = ("debian", "dfsg", "ds", "mx", "nmu", "pristine", "repack", "stable", "ubuntu")
DEBIAN_EMBEDDED = (*DEBIAN_GARBAGE, "is", "real", "revert")


def _or(flags: Column, *names: str) -> Column:
    mask = 0
    for n in names:
        mask |= FLAG[n]
    return flags.bitwiseOR(F.lit(mask))


def parse_debian(version: Column, extra_garbage: tuple[str, ...] = ()) -> Column:
    """struct(version, flags) of a Debian version: epoch, revision and packaging marks go, the rest sets flags."""
    garbage = (*DEBIAN_GARBAGE, *extra_garbage)
    upstream = strip_right(strip_left(version, ":"), "-")
    pieces = F.split(upstream, "(?=[+~-])")
    is_zero = version_key(F.get(pieces, F.lit(0))) == version_key(F.lit("0"))
    start = F.struct(F.get(pieces, F.lit(0)).alias("version"), F.lit(0).alias("flags"), F.lit(0).alias("worded"))

    def fold(acc: Column, part: Column) -> Column:
        full = lambda pattern: part.rlike(f"(?i)^(?:{pattern})$")
        worded = part.rlike("[a-zA-Z]")
        flags = acc["flags"]
        # Patterns of pre- and post-release parts.
        pre = full("[+~-]+(?:alpha|beta|rc|dev|pre[a-z]*)[.0-9]*") | full("~[ab][0-9]{0,2}")
        post = full(r"[+-]+post[a-z]*[.0-9]*")
        first_word = worded & (acc["worded"] == 0) & part.rlike("^[+][a-zA-Z]")
        new_flags = (
            F.when(pre, _or(flags, "devel"))
            .when(post, flags)
            .when(part.startswith("~"), F.when(is_zero, _or(flags, "ignore")).otherwise(_or(flags, "incorrect")))
            .when(first_word, _or(flags, "ignore", "any_is_patch"))
            .otherwise(_or(flags, "ignore"))
        )
        kept = F.struct(F.concat(acc["version"], part).alias("version"), new_flags.alias("flags"), (acc["worded"] + worded.cast("int")).alias("worded"))
        return F.when(full(f"[+~-]+(?:{'|'.join(garbage)})[.0-9]*"), acc).otherwise(kept)

    embedded = "|".join((*garbage, *DEBIAN_EMBEDDED[len(DEBIAN_GARBAGE) :]))

    def finish(acc: Column) -> Column:
        bad = acc["version"].rlike(f"(?:{embedded})")
        return F.struct(acc["version"].alias("version"), F.when(bad, _or(acc["flags"], "incorrect")).otherwise(acc["flags"]).alias("flags"))

    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), start, fold, finish)


# Patterns of pre- and post-release words in a release.
_RPM_PARTS = (r"(?:alpha|beta|rc)(?:[0-9]+|\.[0-9]{1,2}(?![0-9]))?", r"(?:dev|pre)(?:[0-9]+|\.[0-9]{1,2}(?![0-9]))?", r"post[0-9]+")


def parse_rpm(version: Column, release: Column, vertags: tuple[str, ...] = ()) -> Column:
    """struct(version, flags) of an RPM version and release: pre- and post-release words move from the release
    into the version; snapshots and zero releases set flags. ``vertags`` are words that end a part of the release."""
    parts = F.split(release, "|".join(vertags)) if vertags else F.array(release)
    start = F.struct(version.alias("version"), F.lit(0).alias("flags"), F.lit("").alias("rest"))

    def fold(acc: Column, part: Column) -> Column:
        def taken(word: str, flags: Column) -> Column:
            pattern = f"(?is)^(.*?)({word})(.*)$"
            before, found, after = (F.regexp_extract(part, pattern, k) for k in (1, 2, 3))
            dot = F.when((before != "") & (after != ""), ".").otherwise("")
            return F.struct(F.concat(acc["version"], F.lit("-"), found).alias("version"), flags.alias("flags"), F.concat(acc["rest"], before, dot, after).alias("rest"))

        pre, fallback, post = _RPM_PARTS
        has = lambda word: part.rlike(f"(?is)^.*?(?:{word}).*$")
        devel = F.lit(FLAG["devel"])
        plain = F.struct(acc["version"].alias("version"), acc["flags"].alias("flags"), F.concat(acc["rest"], part).alias("rest"))
        return F.when(has(pre), taken(pre, devel)).when(has(fallback), taken(fallback, devel)).when(has(post), taken(post, acc["flags"])).otherwise(plain)

    def finish(acc: Column) -> Column:
        zero = ((acc["rest"] == "0") | acc["rest"].startswith("0.")) & (acc["flags"].bitwiseAND(F.lit(FLAG["devel"])) == 0)
        snapshot = acc["rest"].rlike("(?i)[a-z]|20[0-9]{6}")
        return F.struct(acc["version"].alias("version"), F.when(zero | snapshot, _or(acc["flags"], "ignore")).otherwise(acc["flags"]).alias("flags"))

    return F.aggregate(parts, start, fold, finish)


def nevra(text: Column) -> Column:
    """struct(name, epoch, version, release, arch) of ``name-epoch:version-release.arch[.rpm]``."""
    pattern = r"^(.+)-(?:([0-9]+):)?([^-]+)-([^-]+)\.([^.]+?)$"
    plain = F.regexp_replace(text, r"\.rpm$", "")
    names = ("name", "epoch", "version", "release", "arch")
    return F.struct(*[F.when(F.regexp_extract(plain, pattern, k) != "", F.regexp_extract(plain, pattern, k)).alias(n) for k, n in enumerate(names, 1)])


def nevra_text(n: Column, epoch: str = "nonzero") -> Column:
    """The reverse of ``nevra``; the epoch is written never, always or if it is not zero."""
    e = F.coalesce(n["epoch"], F.lit("0"))
    shown = {"never": F.lit(False), "always": F.lit(True), "nonzero": e != "0"}[epoch]
    return F.concat(n["name"], F.lit("-"), F.when(shown, F.concat(e, F.lit(":"))).otherwise(""), n["version"], F.lit("-"), n["release"], F.lit("."), n["arch"])
