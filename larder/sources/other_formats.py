"""Parsers of YAML trees, SQLite tables, Lisp lists and wiki pages to RAW.

YAML becomes JSON text in a vectorised helper; all else is column expressions. Rows of SQLite files come from
``readers.sqlite_rows``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.distro_versions import nevra
from larder.functions.normalize import extract_maintainers
from larder.functions.versions import strip_right_greedy
from larder.sources.packages import flag_if, link, map_of, no_texts, one, raw


@F.pandas_udf(T.StringType())
def yaml_as_json(values: pd.Series) -> pd.Series:
    """YAML texts as JSON texts; null for texts that are no YAML. Dates and numbers become text as they are written."""
    import yaml

    class Plain(yaml.SafeLoader):
        """Scalars stay as they are written."""

    Plain.yaml_implicit_resolvers = {k: [x for x in v if x[0] in ("tag:yaml.org,2002:null", "tag:yaml.org,2002:bool", "tag:yaml.org,2002:merge")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def one_text(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(yaml.load(text, Plain), default=str)
        except yaml.YAMLError:
            return None

    return values.map(one_text)


def _many(text: Column) -> Column:
    """A JSON text that is a list of texts or one text, as an array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.when(~text.rlike(r"^\s*[\[{]"), F.array(text)), no_texts())


def conan(tree: DataFrame) -> DataFrame:
    """``recipes/name/folder/conandata.yml``: a row for each version; places are all texts below a key ``url``, however deep."""
    part = lambda k: F.get(F.split("path", "/"), F.lit(k))
    rows = tree.filter(F.col("path").rlike(r"(^|/)conandata\.yml$")).select(part(1).alias("name"), part(2).alias("folder"), yaml_as_json("value").alias("y"))
    get = lambda k: F.coalesce(F.from_json(F.get_json_object("y", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = rows.select("name", "folder", get("patches").alias("patches"), F.explode(get("sources")).alias("version", "source"))
    fragments = F.regexp_extract_all("source", F.lit(r'"url":\s*("(?:[^"\\]|\\.)*"|\[[^\]]*\]|\{[^{}]*\})'), F.lit(1))
    urls = F.flatten(F.transform(fragments, lambda f: F.regexp_extract_all(f, F.lit(r'"([^"\s]+://[^"\s]*)"'), F.lit(1))))
    patches = F.regexp_extract_all(F.coalesce(F.try_element_at("patches", F.col("version")), F.lit("")), F.lit(r'"patch_file":\s*"([^"]*)"'), F.lit(1))
    return raw(
        rows,
        names={"conan": F.col("name")},
        version=F.col("version"),
        links=[link("upstream_download", urls)],
        extrafields=map_of(folder=F.col("folder"), patch=F.when(F.size(patches) > 0, F.array_join(patches, "\n"))),
    )


# Labels of documents and the kind of link they give.
WINGET_LABELS = {"upstream_documentation": ("", "docs", "documentation", "guide", "manual", "user guide"), "upstream_wiki": ("wiki",)}


def winget(tree: DataFrame) -> DataFrame:
    """``manifests/x/…/version/*.yaml``: the manifests of a folder meet by its name and are read together."""
    folder = F.regexp_extract("path", "^(.*)/[^/]+$", 1)
    rows = tree.filter(F.col("path").rlike(r"^manifests/.*\.yaml$")).select(folder.alias("folder"), "path", yaml_as_json("value").alias("y"))
    get = lambda k: F.get_json_object("y", f"$.{k}")
    kind = get("ManifestType")
    described, installs = kind.isin("singleton", "defaultLocale"), kind.isin("singleton", "installer")
    urls = F.coalesce(F.from_json(get("Installers"), "array<struct<InstallerUrl:string>>")["InstallerUrl"], no_texts())
    documents = F.from_json(get("Documentations"), "array<struct<DocumentLabel:string,DocumentUrl:string>>")
    first = lambda c: F.max(F.when(described, c))
    met = rows.groupBy("folder").agg(
        first(get("PackageIdentifier")).alias("id"),
        first(get("PackageName")).alias("name"),
        first(get("PackageVersion")).alias("version"),
        first(get("PackageUrl")).alias("url"),
        first(get("ReleaseNotesUrl")).alias("notes"),
        F.flatten(F.array_sort(F.collect_list(F.when(described, _many(get("Tags")))))).alias("tags"),
        F.flatten(F.array_sort(F.collect_list(F.when(installs, urls)))).alias("installers"),
        F.flatten(F.collect_list(F.when(described, documents))).alias("documents"),
    )  # a folder has a handful of manifests
    of_kind = lambda words: F.transform(F.filter("documents", lambda d: F.lower(d["DocumentLabel"]).isin(*words)), lambda d: d["DocumentUrl"])
    relevant = F.regexp_replace(F.regexp_replace("folder", "^[^/]+/", ""), "/[^/]+$", "")
    return raw(
        met.filter("version is not null"),
        names={"winget_id_name": F.regexp_replace("id", r"^[^.]*\.", ""), "winget_name": F.col("name"), "winget_path": relevant},
        version=F.col("version"),
        categories=F.col("tags"),
        extrafields=map_of(path=F.col("folder")),
        links=[link("upstream_download", F.col("installers")), link("upstream_homepage", one(F.col("url"))), link("upstream_changelog", one(F.col("notes"))), *[link(k, of_kind(w)) for k, w in WINGET_LABELS.items()]],
    )


def stone_yaml(tree: DataFrame) -> DataFrame:
    """``…/name/stone.yaml``: the name must be that of the folder."""
    rows = tree.filter(F.col("path").rlike("(^|/)stone[.]yaml$")).select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), yaml_as_json("value").alias("y"))
    get = lambda k: F.get_json_object("y", f"$.{k}")
    name = F.when(get("name") == F.col("folder"), get("name")).otherwise(F.raise_error(F.concat(F.lit("name differs from folder "), F.col("folder"))))
    places = F.flatten(F.transform(F.coalesce(F.from_json(get("upstreams"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>")), F.map_keys))
    git = F.transform(F.filter(places, lambda u: u.startswith("git|")), lambda u: F.substr(u, F.lit(5)))
    return raw(
        rows,
        names={"src": name},
        version=get("version"),
        summary=get("summary"),
        licenses=_many(get("license")),
        links=[link("upstream_homepage", one(get("homepage"))), link("upstream_repository", git), link("upstream_download", F.filter(places, lambda u: ~u.startswith("git|")))],
    )


REPODATA_COLUMNS = "name string, version string, arch string, epoch string, release string, summary string, url string, rpm_group string, rpm_license string, rpm_packager string, rpm_sourcerpm string"


def repodata_sqlite(packages: DataFrame, src: bool = True, binary: bool = False) -> DataFrame:
    """Rows of the table ``packages``; its own rule for releases of pre-releases and snapshots."""
    is_src = F.col("arch") == "src"
    rows = packages.filter((is_src & F.lit(src)) | (~is_src & F.lit(binary)))
    pre = F.regexp_extract("release", r"^0\.[0-9]+\.((?:alpha|beta|rc)[0-9]+)\.", 1)
    epoch = F.when(F.coalesce("epoch", F.lit("")).isin("", "0"), "").otherwise(F.concat("epoch", F.lit(":")))
    return raw(
        rows,
        names={"srcrpm": F.when(is_src, F.col("name")), "binrpm_name": F.when(~is_src, F.col("name")), "binrpm_srcname": F.when(~is_src, nevra(F.col("rpm_sourcerpm"))["name"])},
        version=strip_right_greedy(F.when(pre != "", F.concat("version", F.lit("-"), pre)).otherwise(F.col("version")), "+"),
        rawversion=F.concat(epoch, "version", F.lit("-"), "release"),
        flags=flag_if((pre == "") & (F.col("release") < "1"), "ignore"),
        arch=F.col("arch"),
        summary=F.col("summary"),
        categories=one(F.col("rpm_group")),
        licenses=one(F.col("rpm_license")),
        maintainers=extract_maintainers(F.coalesce("rpm_packager", F.lit(""))),
        links=[link("upstream_homepage", one(F.col("url")))],
    )


def openbsd_ports(ports: DataFrame, distfiles: DataFrame, sites: DataFrame) -> DataFrame:
    """Ports join their files and the sites that hold them; a file without a site of its suffix lies on the distribution's mirror.

    ports: fullpkgpath, stem, fullpkgname, comment, homepage, maintainer, categories, dist_subdir, flavors (a list of
    names). distfiles: fullpkgpath, n, sufx, file. sites: fullpkgpath, n, value.
    """
    pairs = distfiles.alias("d").join(sites.alias("s"), (F.col("d.fullpkgpath") == F.col("s.fullpkgpath")) & F.col("d.sufx").eqNullSafe(F.col("s.n")), "left")
    pairs = pairs.select(F.col("d.fullpkgpath").alias("fullpkgpath"), F.col("d.n").alias("at"), F.col("d.file").alias("file"), F.col("s.value").alias("sites"))
    listed = pairs.groupBy("fullpkgpath").agg(F.array_sort(F.collect_list(F.struct("at", "file", "sites"))).alias("files"))  # files of one port
    rows = ports.join(listed, "fullpkgpath", "left")
    mirror = F.concat(F.lit("http://ftp.openbsd.org/pub/OpenBSD/distfiles/"), F.when(F.coalesce("dist_subdir", F.lit("")) != "", F.concat("dist_subdir", F.lit("/"))).otherwise(""))

    def of_file(f: Column) -> Column:
        name = F.regexp_replace(f["file"], r"^.*\{(.*)\}(.*)$", "$1$2")
        places = F.split(F.trim(F.coalesce(F.nullif(f["sites"], F.lit("")), mirror)), r"\s+")
        return F.transform(places, lambda p: F.concat(p, name))

    urls = F.flatten(F.transform(F.coalesce("files", F.array().cast("array<struct<at:int,file:string,sites:string>>")), of_file))
    flavors = F.transform(F.filter(F.coalesce("flavors", no_texts()), lambda x: x.startswith("-")), lambda x: F.ltrim(x, F.lit("-")))
    parts = F.split("stem", "-")
    # Flavours at the end of the stem go, but for the first part.
    keep = F.aggregate(F.reverse(F.sequence(F.lit(1), F.size(parts))), F.struct(F.size(parts).alias("n"), F.lit(True).alias("going")), lambda s, k: F.when(s["going"] & (k > 1) & F.array_contains(flavors, F.element_at(parts, k)), F.struct((k - 1).alias("n"), F.lit(True).alias("going"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("going"))))["n"]
    version = F.regexp_replace(F.substr("fullpkgname", F.length("stem") + 2), r"(?:[pv][0-9]+)+(?:-.*)?$", "")
    return raw(
        rows,
        names={"openbsd_pkgpath": F.col("fullpkgpath"), "openbsd_stem": F.col("stem"), "openbsd_stripped_stem": F.array_join(F.slice(parts, 1, keep), "-")},
        version=version,
        summary=F.col("comment"),
        maintainers=extract_maintainers(F.coalesce("maintainer", F.lit(""))),
        categories=F.split(F.trim("categories"), r"\s+"),
        links=[link("upstream_homepage", one(F.col("homepage"))), link("upstream_download", urls)],
    )


def elpa_archive(documents: DataFrame) -> DataFrame:
    """Lisp lists of ``(name . [(version) dependencies "summary" kind properties])``."""
    quoted = r'"(?:[^"\\]|\\.)*"'
    entry = rf'\(([^\s()\[\]".]\S*) \. \[\(([0-9 -]+)\)\s+(?:nil|\((?:\([^()]*\([^()]*\)\)\s*)+\))\s+({quoted})\s+[a-z]+\s*((?:{quoted}|[^\[\]"])*)\]\)'
    rows = documents.select(F.explode(F.regexp_extract_all("value", F.lit(entry), F.lit(0))).alias("e"))
    get = lambda k: F.regexp_extract("e", entry, k)
    properties = get(4)
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r'^"|"$', ""), r"\\(.)", "$1")
    url = F.regexp_extract(properties, rf'\(:(?:url|homepage) \. ({quoted})\)', 1)
    people = F.regexp_extract(properties, rf'\(:maintainers? ((?:{quoted}|[^()"]|\((?:{quoted}|[^()"])*\))*)\)', 1)
    addresses = F.flatten(F.transform(F.regexp_extract_all(people, F.lit(quoted), F.lit(0)), lambda p: extract_maintainers(plain(p))))
    return raw(rows, names={"src": get(1)}, version=F.replace(F.trim(get(2)), F.lit(" "), F.lit(".")), summary=plain(get(3)), maintainers=addresses, links=[link("upstream_homepage", one(F.nullif(plain(url), F.lit(""))))])


def game_wiki(documents: DataFrame) -> DataFrame:
    """Boxes of a page: a linked title in the first paragraph, version and website in the second."""
    box = r'(?s)<div style="float:left; width:25\.3em;[^"]*">(.*?)</div>'
    rows = documents.select(F.explode(F.regexp_extract_all("value", F.lit(box), F.lit(1))).alias("b"))
    title = r'(?s)<p>\s*<b>\s*<a [^>]*?href="(?:[^"]*/)?([^"/]+)"[^>]*>([^<]+)</a>'
    shown = F.trim(F.regexp_extract("b", r"(?s)<p>.*?</p>.*?<p>([^<]*)", 1))
    site = F.regexp_extract("b", r'<a [^>]*?href="([^"]*)"[^>]*>Website</a>', 1)
    rows = rows.filter((F.regexp_extract("b", title, 2) != "") & (shown != ""))
    return raw(
        rows,
        names={"wiki_page": F.url_decode(F.regexp_extract("b", title, 1)), "wiki_title": F.regexp_extract("b", title, 2)},
        version=F.regexp_replace(shown, r"^(.*) \(.*$", "$1"),
        rawversion=shown,
        categories=one(F.lit("games")),
        links=[link("upstream_homepage", one(F.nullif(site, F.lit(""))))],
    )


def gem_specs(specs: DataFrame) -> DataFrame:
    """(name, version, platform) of a gem index; only plain Ruby gems count."""
    return raw(specs.filter("platform = 'ruby'"), names={"src": F.col("name")}, version=F.col("version"))


#: Parsers by name: what they read (trees, tables or whole texts), and the function.
PARSERS = {
    "conan": ("files", conan),
    "winget": ("files", winget),
    "stone_yaml": ("files", stone_yaml),
    "elpa_archive": ("files", elpa_archive),
    "game_wiki": ("files", game_wiki),
    "repodata_sqlite": ("sqlite", repodata_sqlite),
}
