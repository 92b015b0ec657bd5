"""Parsers of line, stanza and listing formats: records (column ``value``, sometimes ``path``) to RAW.

Each is a function of a DataFrame; where a format allows options they are keyword arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.distro_versions import nevra, parse_debian, parse_rpm
from larder.functions.normalize import extract_maintainers, split_cpe
from larder.functions.versions import strip_left, strip_right, strip_right_greedy, version_key
from larder.sources.packages import flag_if, flags_of, link, map_of, one, raw, texts
from larder.sources.readers import assigned, block, field_of, stanza_lines


def value() -> Column:
    return F.col("value")


def last_parts(text: Column, sep: str, n: int) -> list[Column]:
    """A text cut at its last n separators: n + 1 parts, null where there are fewer separators."""
    at = F.split(text, rf"\{sep}")
    size = F.size(at)
    enough = size > n
    head = F.when(enough, F.array_join(F.slice(at, 1, F.greatest(F.lit(1), size - n)), sep))
    return [head, *[F.when(enough, F.get(at, size - k)) for k in range(n, 0, -1)]]


# Stanzas of key: value lines


def _fields(records: DataFrame, *keys: str) -> DataFrame:
    """Records with the named fields of their stanzas as columns of a struct ``f``, each looked for once."""
    lined = records.select("value", stanza_lines(value()).alias("lines"))
    return lined.select("value", F.struct(*[field_of(F.col("lines"), k).alias(k) for k in keys]).alias("f"))


DEBIAN_FIELDS = ("Version", "Homepage", "Maintainer", "Uploaders", "Section")


def _debian(records: DataFrame, extra_garbage: tuple[str, ...], more: dict) -> DataFrame:
    """Rows of ``_fields`` with DEBIAN_FIELDS at least; ``more`` are further fields of RAW."""
    get = lambda k: F.col("f")[k]
    people = lambda k: extract_maintainers(F.coalesce(get(k), F.lit("")))
    rows = records.withColumn("parsed", parse_debian(get("Version"), extra_garbage))
    links = [link("upstream_homepage", one(get("Homepage"))), *more.pop("links", [])]
    flags = flags_of(F.col("parsed.flags"), *more.pop("flags", []))
    return raw(rows, version=F.col("parsed.version"), rawversion=get("Version"), flags=flags, maintainers=texts(people("Maintainer"), people("Uploaders")), categories=one(get("Section")), links=links, **more)


def debian_sources(records: DataFrame, allowed_vcs_urls: str | None = None, extra_garbage: tuple[str, ...] = ()) -> DataFrame:
    """Source stanzas; a version control link is kept if it begins like ``allowed_vcs_urls``."""
    rows = _fields(records, *DEBIAN_FIELDS, "Package", "Binary", "Vcs-Browser")
    links = []
    if allowed_vcs_urls is not None:
        vcs = F.coalesce(F.col("f")["Vcs-Browser"], F.nullif(F.regexp_extract(value(), r"(?m)^Vcs-[A-Za-z0-9_-]*:[ \t]*(.*?)[ \t]*$", 1), F.lit("")))
        rows = rows.withColumn("vcs", vcs)
        links.append(link("package_sources", one(F.when(F.col("vcs").rlike(f"(?i)^(?:{allowed_vcs_urls})"), F.col("vcs")))))
    return _debian(rows, extra_garbage, {"names": {"debian_source": F.col("f.Package")}, "binnames": F.split("f.Binary", ", "), "links": links})


def debian_packages(records: DataFrame, extra_garbage: tuple[str, ...] = ()) -> DataFrame:
    """Stanzas of binary packages only."""
    return _debian(_fields(records, *DEBIAN_FIELDS, "Package"), extra_garbage, {"names": {"debian_binary": F.col("f.Package")}})


def openwrt(records: DataFrame) -> DataFrame:
    get = lambda k: F.col("f")[k]
    rows = _fields(records, *DEBIAN_FIELDS, "Package", "Source", "Architecture", "URL", "CPE-ID")
    rows = rows.withColumns({"path": F.split(get("Source"), "/"), "cpe": split_cpe(F.coalesce(get("CPE-ID"), F.lit("")))})
    python = (F.get("path", F.lit(2)) == "lang") & (F.get("path", F.lit(3)) == "python")
    more = {
        "names": {"openwrt_package": get("Package"), "openwrt_sourcedir": F.element_at("path", -1), "openwrt_source": get("Source")},
        "arch": get("Architecture"),
        "extrafields": map_of(path=F.array_join(F.slice("path", 3, F.greatest(F.lit(0), F.size("path") - 2)), "/")),
        "links": [link("upstream_homepage", one(get("URL")))],
        "cpe": map_of(vendor=F.get("cpe", F.lit(2)), product=F.get("cpe", F.lit(3))),
        "flags": [flag_if(F.coalesce(python, F.lit(False)), "untrusted")],
    }
    return _debian(rows, (), more)


def apk_index(records: DataFrame) -> DataFrame:
    get = lambda k: F.col("f")[k]
    return raw(
        _fields(records, "P", "o", "V", "T", "U", "L", "A", "m"),
        names={"name": get("P"), "base": F.nullif(get("o"), F.lit(""))},
        version=F.regexp_replace(get("V"), "-r[0-9]+$", ""),
        summary=get("T"),
        links=[link("upstream_homepage", one(get("U")))],
        licenses=one(get("L")),
        arch=get("A"),
        maintainers=extract_maintainers(F.coalesce(get("m"), F.lit(""))),
    )


def slackware(records: DataFrame) -> DataFrame:
    """PACKAGES.TXT; stanzas without a package name or location are headers."""
    name, location = (F.nullif(F.regexp_extract(value(), rf"(?m)^\s*PACKAGE {k}:(.*)$", 1), F.lit("")) for k in ("NAME", "LOCATION"))
    rows = records.select(F.btrim(name).alias("full"), F.btrim(location).alias("location")).filter("full is not null and location is not null")
    base, version, arch, _ = last_parts(F.col("full"), "-", 3)
    return raw(rows, names={"slackware_name": base, "slackware_pseudo_full_name": F.concat("location", F.lit("/"), base)}, version=version, arch=arch)


# Descriptions of tagged blocks


def arch_desc(records: DataFrame) -> DataFrame:
    tag = lambda t: F.get(block(value(), t), F.lit(0))
    return raw(
        records,
        names={"name": tag("NAME"), "base": tag("BASE")},
        version=strip_right_greedy(strip_left(strip_right_greedy(tag("VERSION"), "-"), ":"), "+"),
        arch=tag("ARCH"),
        summary=F.array_join(block(value(), "DESC"), "\n"),
        links=[link("upstream_homepage", block(value(), "URL"))],
        licenses=block(value(), "LICENSE"),
    )


def msys2_desc(records: DataFrame) -> DataFrame:
    tag = lambda t: F.get(block(value(), t), F.lit(0))
    packagers = F.flatten(F.transform(F.coalesce(block(value(), "PACKAGER"), F.array().cast("array<string>")), extract_maintainers))
    return raw(
        records,
        names={"name": tag("NAME"), "base": tag("BASE")},
        version=strip_left(strip_right(tag("VERSION"), "-"), "~"),
        arch=tag("ARCH"),
        summary=tag("DESC"),
        links=[link("upstream_homepage", block(value(), "URL"))],
        licenses=block(value(), "LICENSE"),
        maintainers=packagers,
        categories=block(value(), "GROUPS"),
    )


# Lines with separators


def _cells(records: DataFrame, n: int | None = None) -> DataFrame:
    """(f): the fields between bars; with ``n`` any other number is an error."""
    cells = F.split(F.btrim(value()), r"\|")
    rows = records.filter(F.btrim(value()) != "").select(cells.alias("f"))
    if n is None:
        return rows
    return rows.select(F.when(F.size("f") == n, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"{n} fields expected, found "), F.size("f").cast("string")))).alias("f"))


def _f(k: int) -> Column:
    return F.get("f", F.lit(k))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def freebsd_index(records: DataFrame) -> DataFrame:
    rows = _cells(records, 13)
    name, version = last_parts(_f(0), "-", 1)
    _, category, port = last_parts(_f(1), "/", 2)
    return raw(
        rows,
        names={"bsd_pkgname": name, "bsd_origin": F.concat_ws("/", category, port)},
        version=strip_right(strip_right(version, ","), "_"),
        summary=_f(3),
        maintainers=extract_maintainers(_f(5)),
        categories=_words(_f(6)),
        links=[link("upstream_homepage", _words(_f(9)))],
    )


def pkgsrc_index(records: DataFrame) -> DataFrame:
    rows = _cells(records, 12)
    name, version = last_parts(_f(0), "-", 1)
    return raw(
        rows,
        names={"bsd_pkgname": name, "bsd_origin": _f(1)},
        version=strip_right(version, "nb"),
        summary=_f(3),
        maintainers=extract_maintainers(_f(5)),
        categories=_words(_f(6)),
        links=[link("upstream_homepage", _words(_f(11)))],
    )


def depot_list(records: DataFrame) -> DataFrame:
    rows = _cells(records)
    name, version = last_parts(_f(0), "-", 1)
    return raw(rows, names={"srcbin": name}, version=version, extrafields=map_of(path=_f(1)))


def amiga_index(records: DataFrame) -> DataFrame:
    """Bars between category, file, size, date, version and a description that a colon opens; no version, no package."""
    rows = _cells(records.filter(~value().startswith("#"))).filter((F.size("f") >= 6) & (F.btrim(_f(4)) != ""))
    file = F.btrim(_f(1))
    return raw(
        rows,
        names={"os4depot_path": F.concat(F.btrim(_f(0)), F.lit("/"), file), "os4depot_filename_ext": file, "os4depot_filename_no_ext": F.substring_index(file, ".", 1)},
        version=F.btrim(_f(4)),
        summary=F.btrim(F.regexp_replace(F.array_join(F.slice("f", 6, 1000), "|"), "^\\s*:", "")),
        categories=one(F.btrim(_f(0))),
    )


def cpan_packages(records: DataFrame) -> DataFrame:
    """Lines of module, version and file; a row counts if the module is the file's main one. Header lines have a colon."""
    words = F.split(F.btrim(value()), r"\s+", 3)
    rows = records.filter(~value().rlike(r"^[A-Za-z-]+:\s") & (F.size(words) == 3)).select(F.get(words, F.lit(0)).alias("module"), F.get(words, F.lit(2)).alias("file"))
    full = F.regexp_extract("file", r"([^/]+)\.(?:tar\.gz|tar\.bz2|zip|tgz)$", 1)
    name, version = last_parts(full, "-", 1)
    rows = rows.select("module", "file", name.alias("name"), F.regexp_replace(version, "^[vV]", "").alias("version"))
    rows = rows.filter(F.col("version").rlike("^[0-9]") & (F.lower(F.replace("module", F.lit("::"), F.lit("-"))) == F.lower("name")))
    author = F.lower(F.get(F.split("file", "/"), F.lit(2)))
    return raw(rows, names={"src": F.col("name")}, version=F.col("version"), maintainers=one(F.concat(author, F.lit("@cpan"))))


def cran_summary(records: DataFrame) -> DataFrame:
    pattern = r'<tr> <td> <a href="[^"]+"><span class="CRAN">([^<>]+)</span></a> </td> <td>[ ]*([^ <>]+)[ ]*</td>'
    rows = records.filter(value().rlike(pattern))
    return raw(rows, names={"srcbin": F.regexp_extract(value(), pattern, 1)}, version=F.regexp_extract(value(), pattern, 2))


def stackage_html(records: DataFrame) -> DataFrame:
    """Links to packages in a page; name and version part at the last dash."""
    pattern = r'/package/([^"/<>]+-[0-9][0-9.]*)"'
    rows = records.select(F.explode(F.regexp_extract_all(value(), F.lit(pattern), F.lit(1))).alias("full")).distinct()
    name, version = last_parts(F.col("full"), "-", 1)
    return raw(rows, names={"src": name}, version=version)


def rpm_listing(records: DataFrame, vertags: tuple[str, ...] = ()) -> DataFrame:
    """File listings whose last word is a source package's file name."""
    file = F.element_at(F.split(F.btrim(value()), r"\s+"), -1)
    rows = records.select(nevra(file).alias("n")).filter("n.arch = 'src'")
    parsed = parse_rpm(F.col("n.version"), F.col("n.release"), vertags)
    return raw(rows, names={"srcrpm": F.col("n.name")}, version=parsed["version"], rawversion=F.concat("n.version", F.lit("-"), F.col("n.release")), flags=parsed["flags"])


# Trees of small files: records are (path, value)


def slackbuilds_info(records: DataFrame) -> DataFrame:
    """``category/name/name.info`` files of shell variables."""
    category, name, _ = (F.get(F.split("path", "/"), F.lit(k)) for k in range(3))
    get = lambda k: assigned(value(), k)
    records = records.filter(get("PRGNAM") == name)
    downloads = lambda k: F.filter(_words(F.coalesce(get(k), F.lit(""))), lambda u: ~u.isin("UNSUPPORTED", "UNTESTED"))
    return raw(
        records,
        names={"short_name": name, "full_name": F.concat_ws("/", category, name)},
        version=get("VERSION"),
        categories=one(category),
        links=[link("upstream_homepage", one(get("HOMEPAGE"))), link("upstream_download", downloads("DOWNLOAD"), downloads("DOWNLOAD_x86_64"))],
        maintainers=extract_maintainers(F.coalesce(get("EMAIL"), F.lit(""))),
    )


def haiku_recipes(records: DataFrame) -> DataFrame:
    """``category/name/name-version.recipe`` files."""
    category, name = (F.get(F.split("path", "/"), F.lit(k)) for k in range(2))
    version = F.regexp_extract("path", r"/[^/-]*-([^/]*)\.recipe$", 1)
    pages = _words(F.regexp_extract(value(), r'(?m)^HOMEPAGE="([^"]+)"', 1))
    rows = records.filter(F.col("path").rlike(r"^[^/]+/[^/]+/[^/]+\.recipe$"))
    return raw(rows, names={"short_name": name, "full_name": F.concat_ws("/", category, name)}, version=version, categories=one(category), links=[link("upstream_homepage", pages)])


def kiss_versions(records: DataFrame) -> DataFrame:
    """``…/name/version`` files (version and release) with ``sources`` and ``meta`` beside them: files of a folder meet by its
    name. A package without sources goes, as does one whose version is filled in by a shell."""
    folder, file = F.regexp_extract("path", "^(.*)/[^/]+$", 1), F.substring_index("path", "/", -1)
    pick = lambda f: F.max(F.when(F.col("file") == f, F.col("value"))).alias(f)
    rows = records.select(folder.alias("folder"), file.alias("file"), "value").filter(F.col("file").isin("version", "sources", "meta"))
    rows = rows.groupBy("folder").agg(pick("version"), pick("sources"), pick("meta")).filter("version is not null and sources is not null and not contains(version, 'VERSION')")
    places = F.filter(F.transform(F.split("sources", "\n"), lambda x: F.get(_words(x), F.lit(0))), lambda u: F.coalesce(u.contains("://"), F.lit(False)) & ~u.startswith("#"))
    git = F.filter(places, lambda u: u.startswith("git+"))
    get = lambda k: F.nullif(F.btrim(F.regexp_extract("meta", rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    return raw(
        rows,
        names={"src": F.substring_index("folder", "/", -1)},
        version=F.get(_words(F.col("version")), F.lit(0)),
        summary=get("description"),
        licenses=F.split(get("license"), ","),
        maintainers=extract_maintainers(F.coalesce(get("maintainer"), F.lit(""))),
        links=[link("upstream_download", F.filter(places, lambda u: ~u.startswith("git+"))), link("upstream_repository", F.transform(git, lambda u: F.substr(u, F.lit(5))))],
        extrafields=map_of(path=F.col("folder")),
        subrepo=F.substring_index("folder", "/", 1),
    )


def gobolinux_recipes(records: DataFrame) -> DataFrame:
    """``name/version/…`` folders: of each program that with the greatest version, with its ``Recipe`` and ``Resources/Description``."""
    parts = F.split("path", "/")
    rows = records.filter(F.col("path").rlike("^[^./][^/]*/[^/]+/.+$")).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("folder"), F.regexp_replace("path", "^[^/]+/[^/]+/", "").alias("file"), "value")
    pick = lambda f: F.max(F.when(F.col("file") == f, F.col("value")))
    versions = rows.groupBy("name", "folder").agg(pick("Recipe").alias("recipe"), pick("Resources/Description").alias("described"))
    best = versions.groupBy("name").agg(F.max_by(F.struct("folder", "recipe", "described"), F.struct(version_key(F.col("folder")).alias("k"), F.col("folder"))).alias("r")).select("name", "r.*")
    urls = F.transform(F.regexp_extract_all("recipe", F.lit(r"(?m)^[ \t]*url=(.*?)[ \t\r]*$"), F.lit(1)), lambda u: F.btrim(u, F.lit('"')))
    tag = lambda t: F.nullif(F.btrim(F.regexp_replace(F.regexp_extract("described", rf"(?s)(?:^|\n)[ \t]*\[{t}\] *(.*?)(?=\n[ \t]*\[[A-Z][a-z]+\]|$)", 1), r"\s*\n\s*", " ")), F.lit(""))
    return raw(
        best,
        names={"src": F.col("name")},
        version=F.col("folder"),
        summary=tag("Summary"),
        licenses=one(tag("License")),
        links=[link("upstream_download", F.filter(urls, lambda u: ~u.contains("$"))), link("upstream_homepage", one(F.btrim(tag("Homepage"), F.lit('"'))))],
        extrafields=map_of(path=F.concat_ws("/", "name", "folder")),
    )


def t2_descriptions(records: DataFrame) -> DataFrame:
    """``[X] value`` tags of ``repository/name/name.desc`` files; tags have long names too."""

    def tags(*names: str) -> Column:
        return F.transform(F.regexp_extract_all(value(), F.lit(rf"(?im)^\[(?:{'|'.join(names)})\][ \t]*(.*?)[ \t]*$"), F.lit(1)), lambda x: F.trim(x))

    first = lambda *n: F.get(tags(*n), F.lit(0))
    downloads = F.transform(tags("D", "DOWN", "DOWNLOAD"), _t2_url)
    homepage = F.transform(tags("U", "URL"), lambda u: F.get(F.split(u, r"\s+"), F.lit(0)))
    return raw(
        records.filter(F.col("path").rlike(r"\.desc$")),
        names={"src": F.regexp_extract("path", r"([^/]+)\.desc$", 1)},
        version=first("V", "VER", "VERSION"),
        summary=first("I", "TITLE"),
        maintainers=F.flatten(F.transform(tags("M", "MAINTAINER"), extract_maintainers)),
        licenses=tags("L", "LICENSE"),
        categories=tags("C", "CATEGORY"),
        extrafields=map_of(path=F.regexp_replace("path", "/[^/]*$", "")),
        links=[link("upstream_homepage", homepage), link("upstream_download", downloads)],
    )


def _t2_url(text: Column) -> Column:
    """A download line: checksum, file, place. A place that ends with a slash lacks the file's name; a sign before it says how to fetch."""
    words = _words(text)
    file, place = F.get(words, F.lit(1)), F.regexp_replace(F.get(words, F.lit(2)), "^[!-]+", "")
    return F.when(place.endswith("/"), F.concat(place, file)).otherwise(place)


def sagemath_versions(records: DataFrame) -> DataFrame:
    """``name/package-version.txt`` with ``name/checksums.ini`` and ``name/SPKG.rst`` or requirements beside it: files of a
    folder meet by its name. A requirements file marks a Python module."""
    folder = F.get(F.split("path", "/"), F.lit(0))
    file = F.substring_index("path", "/", -1)
    rows = records.select(folder.alias("name"), file.alias("file"), "value")
    pick = lambda f: F.max(F.when(F.col("file") == f, F.col("value")))
    one_each = rows.groupBy("name").agg(pick("package-version.txt").alias("version"), pick("checksums.ini").alias("sums"), F.bool_or(F.col("file").isin("requirements.txt", "install-requires.txt")).alias("python"))
    version = F.regexp_replace(F.btrim("version", F.lit(" \n")), r"\.p[0-9]+$", "")
    url = F.nullif(F.regexp_extract("sums", r"(?m)^upstream_url=(.*)$", 1), F.lit(""))
    return raw(
        one_each.filter("version is not null"),
        names={"sagemath_name": F.col("name"), "sagemath_project_name": F.when(F.col("python"), F.concat(F.lit("python:"), F.col("name"))).otherwise(F.col("name"))},
        version=version,
        links=[link("upstream_download", one(F.replace(url, F.lit("VERSION"), version)))],
    )


def rapps_ini(records: DataFrame) -> DataFrame:
    """``name.txt`` files with a ``[Section]`` of fields; a byte order mark may open them."""
    text = F.regexp_replace(value(), "^﻿", "")
    get = lambda k: F.nullif(F.regexp_extract(text, rf"(?ms)^\[Section\][^\[]*?^{k}[ \t]*=[ \t]*([^\r\n]*)", 1), F.lit(""))
    return raw(
        records.filter(F.col("path").rlike(r"\.txt$")),
        names={"reactos_filename": F.regexp_extract("path", r"([^/]+)\.txt$", 1), "reactos_name": get("Name")},
        version=get("Version"),
        summary=get("Description"),
        licenses=one(get("License")),
        links=[link("upstream_homepage", one(get("URLSite"))), link("upstream_download", one(get("URLDownload")))],
    )


def cabal_files(records: DataFrame, fallback_maintainer: str | None = None) -> DataFrame:
    """``name/version/name.cabal`` files: of each package the greatest version; of equal ones the last by path."""
    parts = F.split("path", "/")
    rows = records.filter(F.col("path").rlike(r"^[^/]+/[^/]+/[^/]+\.cabal$")).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("version"), "path", "value")
    best = rows.groupBy("name").agg(F.max_by(F.struct("version", "value"), F.struct(version_key(F.col("version")).alias("k"), F.col("path"))).alias("r")).select("name", "r.*")
    get = lambda k: F.nullif(F.btrim(F.regexp_extract(value(), rf"(?im)^{k}[ \t]*:[ \t]*(.*?)[ \t\r]*$", 1)), F.lit(""))
    return raw(
        best,
        names={"src": F.col("name")},
        version=F.col("version"),
        summary=get("synopsis"),
        maintainers=F.when(get("maintainer").isNull(), F.array(F.lit(fallback_maintainer))).otherwise(extract_maintainers(get("maintainer"))),
        licenses=one(get("license")),
        categories=one(get("category")),
        links=[link("upstream_homepage", one(get("homepage"))), link("upstream_issue_tracker", one(F.when(get("bug-reports").startswith("http"), get("bug-reports"))))],
    )


def textproto_builds(records: DataFrame) -> DataFrame:
    """``.../name/build.textproto``: the last dash of the version opens the build number."""
    folder = F.regexp_extract("path", "^(.*)/build[.]textproto$", 1)
    get = lambda k: F.regexp_extract_all(value(), F.lit(rf'(?m)^{k}:\s*"([^"]*)"'), F.lit(1))
    picks = get("cherry_pick")
    return raw(
        records.filter(F.col("path").rlike("(^|/)build[.]textproto$")),
        names={"srcbin": F.substring_index(folder, "/", -1)},
        version=strip_right(F.get(get("version"), F.lit(0)), "-"),
        links=[link("upstream_download", F.slice(get("source"), 1, 1))],
        extrafields=map_of(path=folder, patch=F.when(F.size(picks) > 0, F.array_join(picks, "\n"))),
    )


def toml_packages(records: DataFrame, version: str = "version", only_urls: bool = False) -> DataFrame:
    """``.../name/*.toml`` files of ``key = "value"`` lines; without a version (and, where asked, a link) no package."""
    folder = F.regexp_extract("path", "^(?:.*/)?([^/]+)/[^/]+$", 1)
    get = lambda k: F.nullif(F.regexp_extract(value(), rf'(?m)^{k}[ \t]*=[ \t]*"([^"]*)"', 1), F.lit(""))
    sources = F.concat(F.coalesce(F.array(get("url")), F.array().cast("array<string>")), F.regexp_extract_all(F.regexp_extract(value(), r"(?ms)^sources?[ \t]*=[ \t]*\[(.*?)\]", 1), F.lit('"([^"]*)"'), F.lit(1)))
    urls = F.filter(sources, lambda u: F.coalesce(u.contains("://"), F.lit(False)))
    rows = records.filter(get(version).isNotNull())
    if only_urls:
        rows = rows.filter(get("url").isNotNull())
    voyager = F.regexp_extract_all(value(), F.lit(r"(?m)^# Voyager: (.*)$"), F.lit(1))
    return raw(
        rows,
        names={"src": folder},
        version=get(version),
        summary=F.coalesce(get("desc"), get("description")),
        licenses=one(get("license")),
        maintainers=F.flatten(F.transform(voyager, extract_maintainers)),
        links=[link("upstream_download", urls), link("upstream_homepage", one(get("homepage")))],
    )


#: Parsers by name: what they read, and the function.
PARSERS = {
    "debian_sources": ("stanzas", debian_sources),
    "debian_packages": ("stanzas", debian_packages),
    "openwrt": ("stanzas", openwrt),
    "apk_index": ("stanzas", apk_index),
    "slackware": ("stanzas", slackware),
    "arch_desc": ("files", arch_desc),
    "msys2_desc": ("files", msys2_desc),
    "freebsd_index": ("lines", freebsd_index),
    "pkgsrc_index": ("lines", pkgsrc_index),
    "depot_list": ("lines", depot_list),
    "amiga_index": ("lines", amiga_index),
    "cpan_packages": ("lines", cpan_packages),
    "cran_summary": ("lines", cran_summary),
    "stackage_html": ("lines", stackage_html),
    "rpm_listing": ("lines", rpm_listing),
    "slackbuilds_info": ("files", slackbuilds_info),
    "haiku_recipes": ("files", haiku_recipes),
    "kiss_versions": ("files", kiss_versions),
    "gobolinux_recipes": ("files", gobolinux_recipes),
    "t2_descriptions": ("files", t2_descriptions),
    "sagemath_versions": ("files", sagemath_versions),
    "rapps_ini": ("files", rapps_ini),
    "cabal_files": ("files", cabal_files),
    "textproto_builds": ("files", textproto_builds),
    "toml_packages": ("files", toml_packages),
}
