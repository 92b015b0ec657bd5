"""From the names that a source states, by kind, to the five names of a package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.normalize import bound

ROLES = ("srcname", "binname", "trackname", "visiblename", "projectname_seed")

# For each set of kinds that a source may state, the kind that fills each role, in the order of ROLES.
# Kinds whose packages are known by one name only, as sources, as binaries, or as both:
_SOURCE_ONLY = ("src", "yacp", "debian_source", "srcrpm", "conan", "chromebrew")
_BINARY_ONLY = ("bin", "kaos", "debian_binary")
_BOTH = ("srcbin", "name", "guix", "pacstall")
MAPPINGS: list[tuple[str | None, ...]] = [
    *[(k, None, k, k, k) for k in _SOURCE_ONLY],
    *[(None, k, k, k, k) for k in _BINARY_ONLY],
    *[(k, k, k, k, k) for k in _BOTH],
    ("base", "name", "base", "name", "base"),
    ("full_name", None, "full_name", "full_name", "short_name"),
    ("wikidata_entity", None, "wikidata_entity", "wikidata_label", "wikidata_project"),
    ("bsd_origin", "bsd_pkgname", "bsd_origin", "bsd_origin", "bsd_pkgname"),
    ("openbsd_pkgpath", "openbsd_stem", "openbsd_pkgpath", "openbsd_pkgpath", "openbsd_stripped_stem"),
    ("npackd_fullname", "npackd_fullname", "npackd_fullname", "npackd_title", "npackd_lastname"),
    ("reactos_filename", "reactos_filename", "reactos_filename", "reactos_name", "reactos_filename"),
    (None, "chocolatey_title", "chocolatey_title", "chocolatey_metadata_title", "chocolatey_title"),
    (None, "chocolatey_title", "chocolatey_title", "chocolatey_title", "chocolatey_title"),
    ("openwrt_source", "openwrt_package", "openwrt_source", "openwrt_package", "openwrt_sourcedir"),
    ("wiki_page", None, "wiki_page", "wiki_title", "wiki_title"),
    ("fdroid_id", "fdroid_id", "fdroid_id", "fdroid_name", "fdroid_name"),
    ("homebrew_name", None, "homebrew_name", "homebrew_name", "homebrew_name_pre_at"),
    ("homebrew_cask_token", None, "homebrew_cask_token", "homebrew_cask_first_name", "homebrew_cask_token"),
    (None, "slackware_name", "slackware_pseudo_full_name", "slackware_name", "slackware_name"),
    ("binrpm_srcname", "binrpm_name", "binrpm_srcname", "binrpm_name", "binrpm_srcname"),
    ("aosc_fullpath", "aosc_name", "aosc_fullpath", "aosc_name", "aosc_name"),
    ("macports_portdir", "macports_name", "macports_portdir", "macports_name", "macports_name"),
    ("pisi_pkgdir", None, "pisi_pkgdir", "pisi_name", "pisi_name"),
    ("openindiana_name", "openindiana_fmri", "openindiana_name", "openindiana_name", "openindiana_name"),
    ("nix_attribute_path", None, "nix_attribute_path", "nix_pname", "nix_pname"),
    ("winget_path", None, "winget_path", "winget_name", "winget_id_name"),
    ("appget_id", None, "appget_id", "appget_name", "appget_id"),
    ("sagemath_name", "sagemath_name", "sagemath_name", "sagemath_name", "sagemath_project_name"),
    (None, "os4depot_path", "os4depot_path", "os4depot_filename_ext", "os4depot_filename_no_ext"),
    ("openvsx_slash", "openvsx_dot", "openvsx_dot", "openvsx_displayname", "openvsx_dot"),
    ("stalix_full", "stalix_ix", "stalix_full", "stalix_ix", "stalix_pkg"),
]


def kinds_of(names: Column) -> Column:
    """struct of the kind of name for each of the five roles; null where no mapping knows the kinds of a map of kind to name."""
    table = []
    for kinds in MAPPINGS:
        key = "|".join(sorted({k for k in kinds if k}))
        table += [F.lit(key), F.struct(*[F.lit(k).cast("string").alias(r) for r, k in zip(ROLES, kinds)])]
    return F.try_element_at(F.create_map(*table), F.array_join(F.array_sort(F.map_keys(names)), "|"))


def mapped_names(names: Column, kinds: Column | None = None) -> Column:
    """struct of the five roles for a map of kind to name; null where no mapping knows that set of kinds. ``kinds`` are those of
    ``kinds_of`` where they are a column already."""
    filled = lambda k: F.when(k.isNotNull(), F.struct(*[F.try_element_at(names, k[r]).alias(r) for r in ROLES]))
    return bound(kinds_of(names), filled) if kinds is None else filled(kinds)
