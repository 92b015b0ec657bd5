"""Parsers of JSON formats: texts (column ``value``, sometimes ``path``) to RAW.

Each format states the schema of its items, so that Spark reads no more than what is used; fields that a text
lacks are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.distro_versions import parse_rpm
from larder.functions.normalize import extract_maintainers
from larder.functions.versions import strip_left, strip_left_greedy, strip_right, strip_right_greedy, version_key
from larder.sources.packages import flag_if, flags_of, link, map_of, no_texts, one, raw, texts
from larder.sources.readers import json_entries, json_items
from larder.sources.text_formats import last_parts

SEP = "␞"


def _i(name: str) -> Column:
    return F.col("item").getField(name)


def _people(text: Column) -> Column:
    return extract_maintainers(F.coalesce(text, F.lit("")))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def _release_version(version: Column) -> Column:
    return strip_right_greedy(strip_left(strip_right_greedy(version, "-"), ":"), "+")


def aosc(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<name:string,category:string,section:string,pkg_section:string,directory:string,tree:string,branch:string,version:string,full_version:string,description:string,srctype:string,srcurl:string>", "packages")
    place = F.concat_ws("-", _i("category"), _i("section"))
    rows = rows.filter(~place.isin("meta-bases", "core-misc") & _i("version").isNotNull())
    url, kind = _i("srcurl"), _i("srctype")
    version = strip_left(_i("version"), ":")
    return raw(
        rows,
        names={"aosc_name": _i("name"), "aosc_fullpath": F.concat(F.coalesce(_i("category"), F.lit("")), F.lit("-"), F.coalesce(_i("section"), F.lit("")), F.lit("/"), _i("directory"))},
        version=version,
        rawversion=_i("full_version"),
        categories=F.array(_i("pkg_section"), _i("section")),
        summary=_i("description"),
        extrafields=map_of(tree=_i("tree"), branch=_i("branch")),
        links=[
            link("upstream_repository", one(F.when(kind.isin("Git", "SvnSrc", "BzrSrc"), url))),
            link("upstream_download", one(F.when(kind == "Tarball", url))),
            link("upstream_homepage", one(F.when(kind == "PyPI", F.concat(F.lit("https://pypi.org/project/"), url, F.lit("/"))))),
        ],
        flags=flag_if(version == "999", "ignore"),
    )


def aur(docs: DataFrame, maintainer_host: str = "aur") -> DataFrame:
    rows = json_items(docs, "struct<Name:string,Version:string,Description:string,URL:string,License:array<string>,Maintainer:string,CoMaintainers:array<string>,PackageBase:string>")
    everyone = texts(one(_i("Maintainer")), _i("CoMaintainers"))
    return raw(
        rows,
        names={"name": _i("Name"), "base": F.nullif(_i("PackageBase"), F.lit(""))},
        version=_release_version(_i("Version")),
        summary=_i("Description"),
        links=[link("upstream_homepage", one(_i("URL")))],
        licenses=_i("License"),
        maintainers=F.flatten(F.transform(everyone, lambda m: extract_maintainers(F.concat(m, F.lit("@" + maintainer_host))))),
    )


def chromebrew(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<name:string,version:string,description:string,homepage:string,license:string>")
    return raw(rows, names={"chromebrew": _i("name")}, version=_i("version"), summary=_i("description"), licenses=one(_i("license")), links=[link("upstream_homepage", one(_i("homepage")))])


def crux(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<name:string,version:string,description:string,maintainer:string,url:string,repository:string,sources:array<string>>", "ports")
    name = F.when(_i("name").contains("${"), F.raise_error(F.concat(F.lit("bad port name "), _i("name")))).otherwise(_i("name"))
    return raw(rows, names={"src": name}, version=_i("version"), summary=_i("description"), maintainers=_people(_i("maintainer")), subrepo=_i("repository"), links=[link("upstream_homepage", one(_i("url"))), link("upstream_download", _i("sources"))])


def crates(docs: DataFrame) -> DataFrame:
    """The stable version and, where it differs, the greatest one as a development version."""
    rows = json_items(docs, "struct<id:string,name:string,homepage:string,repository:string,documentation:string,description:string,max_stable_version:string,max_version:string>", "crates")
    name = F.when(_i("id") == _i("name"), _i("id")).otherwise(F.raise_error(F.lit("id and name differ")))
    stable = F.struct(_i("max_stable_version").alias("version"), F.lit(False).alias("devel"))
    newest = F.struct(_i("max_version").alias("version"), F.lit(True).alias("devel"))
    both = F.filter(F.array(stable, newest), lambda v: v["version"].isNotNull() & ~(v["devel"] & v["version"].eqNullSafe(_i("max_stable_version"))))
    rows = rows.withColumn("v", F.explode(both))
    return raw(
        rows,
        names={"src": name},
        version=F.col("v.version"),
        flags=flag_if(F.col("v.devel"), "devel"),
        summary=_i("description"),
        links=[link("upstream_homepage", one(_i("homepage"))), link("upstream_repository", one(_i("repository"))), link("upstream_documentation", one(_i("documentation")))],
    )


def mports(docs: DataFrame) -> DataFrame:
    rows = json_entries(docs, "struct<port:string,version:string,summary:string,categories:array<struct<category:string>>,licenses:array<string>,homepages:array<string>>", "packages")
    return raw(rows, names={"bsd_pkgname": F.col("key"), "bsd_origin": _i("port")}, version=strip_right(strip_right(_i("version"), ","), "_"), summary=_i("summary"), categories=_i("categories")["category"], licenses=_i("licenses"), links=[link("upstream_homepage", _i("homepages"))])


def macports(docs: DataFrame) -> DataFrame:
    person = "struct<email:struct<name:string,domain:string>,github:string>"
    rows = json_items(docs, f"struct<name:string,portdir:string,version:string,description:string,homepage:string,categories:array<string>,license:string,maintainers:array<{person}>,replaced_by:string>", "ports").filter("item.replaced_by is null")
    accounts = F.flatten(F.transform(_i("maintainers"), lambda m: F.array(F.when(m["email"]["domain"] == "macports.org", F.concat(m["email"]["name"], F.lit("@macports"))), F.concat(m["github"], F.lit("@github")))))
    nobody = F.coalesce(F.size(_i("maintainers")), F.lit(0)) <= 0
    folder = F.get(F.split(_i("portdir"), "/"), F.lit(1))
    return raw(
        rows,
        names={"macports_name": _i("name"), "macports_portdir": _i("portdir")},
        version=strip_right(_i("version"), "+"),
        summary=_i("description"),
        links=[link("upstream_homepage", one(_i("homepage")))],
        categories=_i("categories"),
        licenses=one(_i("license")),
        maintainers=F.when(nobody, F.array(F.lit("nomaintainer@macports.org"))).otherwise(texts(accounts)),
        flags=flag_if(F.coalesce(_i("name") == F.concat(folder, F.lit("-devel")), F.lit(False)), "ignore"),
    )


def opam(docs: DataFrame) -> DataFrame:
    """The last version of the list, whatever it is."""
    rows = json_items(docs, "struct<name:string,versions:array<struct<version:string>>>")
    return raw(rows, names={"src": _i("name")}, version=F.element_at(_i("versions"), -1)["version"])


def ptxdist(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<name:string,version:string,upstream_urls:string,license:string>")
    return raw(rows, names={"src": _i("name")}, version=_i("version"), licenses=one(_i("license")), links=[link("upstream_download", F.split(_i("upstream_urls"), " "))])


_CPE = ("vendor", "product", "edition", "lang", "sw_edition", "target_sw", "target_hw", "other")


def ravenports(docs: DataFrame) -> DataFrame:
    cpe = ",".join(f"{c}:string" for c in _CPE)
    rows = json_items(docs, f"struct<namebase:string,version:string,keywords:array<string>,homepage:string,distfile:array<string>,variants:array<struct<sdesc:string,label:string>>,contacts:array<struct<email:string>>,bucket:string,cpe:struct<{cpe}>>", "ravenports")
    variant = F.get(_i("variants"), F.lit(0))
    return raw(
        rows,
        names={"srcbin": _i("namebase")},
        version=_i("version"),
        categories=_i("keywords"),
        summary=variant["sdesc"],
        maintainers=_i("contacts")["email"],
        extrafields=map_of(bucket=_i("bucket"), variant=variant["label"]),
        cpe=map_of(**{c: _i("cpe")[c] for c in _CPE}),
        links=[link("upstream_homepage", one(_i("homepage"))), link("upstream_download", _i("distfile"))],
    )


def salix(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<name:string,ver:string,descs:string,arch:string>", "packages")
    return raw(rows, names={"src": _i("name")}, version=_i("ver"), summary=_i("descs"), arch=_i("arch"))


def sisyphus(docs: DataFrame, vertags: tuple[str, ...] = ()) -> DataFrame:
    rows = json_items(docs, "struct<name:string,epoch:string,version:string,release:string,binaries:array<struct<name:string>>,category:string,summary:string,license:string,packager:string,url:string,homepage:string,recipe:string,recipe_raw:string,bugzilla:string>", "packages")
    parsed = parse_rpm(_i("version"), _i("release"), vertags)
    epoch = F.when(F.coalesce(_i("epoch"), F.lit("")).isin("", "0"), F.lit("")).otherwise(F.concat(_i("epoch"), F.lit(":")))
    kinds = {"upstream_homepage": "url", "package_homepage": "homepage", "package_recipe": "recipe", "package_recipe_raw": "recipe_raw", "package_issue_tracker": "bugzilla"}
    return raw(
        rows,
        names={"srcrpm": _i("name")},
        version=parsed["version"],
        rawversion=F.concat(epoch, _i("version"), F.lit("-"), _i("release")),
        flags=parsed["flags"],
        binnames=F.array_sort(_i("binaries")["name"]),
        categories=one(_i("category")),
        summary=_i("summary"),
        licenses=one(_i("license")),
        maintainers=one(_i("packager")),
        links=[link(k, one(_i(c))) for k, c in kinds.items()],
    )


def openvsx(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<namespace:string,name:string,displayName:string,version:string,description:string,files:struct<download:string>>", "extensions").filter("item.files is not null")
    download = _i("files")["download"]
    return raw(
        rows,
        names={"openvsx_dot": F.concat_ws(".", _i("namespace"), _i("name")), "openvsx_slash": F.concat_ws("/", _i("namespace"), _i("name")), "openvsx_displayname": F.coalesce(_i("displayName"), _i("name"))},
        version=_i("version"),
        summary=_i("description"),
        maintainers=one(F.concat(_i("namespace"), F.lit("@openvsx"))),
        links=[link("project_download", one(download)), link("package_recipe_raw", one(F.concat(F.regexp_replace(download, "/[^/]*$", ""), F.lit("/package.json"))))],
    )


def yacp(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<name:string,version:string,category:string,summary:string,homepage:string,subpackages:array<struct<name:string>>>", "packages")
    return raw(rows, names={"yacp": _i("name")}, version=_i("version"), categories=one(_i("category")), summary=_i("summary"), binnames=_i("subpackages")["name"], links=[link("upstream_homepage", one(_i("homepage")))])


def cygwin(docs: DataFrame) -> DataFrame:
    """A row for each maturity and sub-package; releases that begin with a zero are pre-releases or snapshots."""
    rows = json_items(docs, "struct<name:string,summary:string,maintainers:array<string>,homepage:string,build_recipe:string,license:string,versions:struct<stable:array<string>,test:array<string>>,subpackages:array<struct<name:string,categories:array<string>>>>", "packages")
    rows = rows.filter(~_i("name").startswith("_"))
    maturity = F.filter(F.array(*[F.struct(F.element_at(_i("versions")[k], -1).alias("full"), F.lit(k == "test").alias("test")) for k in ("stable", "test")]), lambda m: m["full"].isNotNull())
    rows = rows.withColumn("m", F.explode(maturity)).withColumn("s", F.explode("item.subpackages")).filter(~F.array_contains(F.coalesce("s.categories", no_texts()), "_obsolete"))
    version, release = last_parts(F.col("m.full"), "-", 1)
    early = F.coalesce(release.rlike("^0."), F.lit(False))
    pre = F.regexp_extract(release, r"^.*((?:alpha|beta|rc)(?:\.?[0-9]+)?|(?<![a-z])[ab]\.?[0-9]+)$", 1)
    recipe = _i("build_recipe")
    return raw(
        rows,
        names={"base": _i("name"), "name": F.col("s.name")},
        version=F.when(early & (pre != ""), F.concat(version, F.lit("-"), pre)).otherwise(version),
        rawversion=F.col("m.full"),
        flags=flags_of(flag_if(F.col("m.test"), "ignore"), flag_if(early & (pre != ""), "devel"), flag_if(early & (pre == ""), "ignore")),
        summary=_i("summary"),
        maintainers=F.transform(_i("maintainers"), lambda m: F.concat(F.replace(F.replace(m, F.lit("."), F.lit("")), F.lit(" "), F.lit(".")), F.lit("@cygwin"))),
        categories=F.col("s.categories"),
        licenses=one(_i("license")),
        links=[link("upstream_homepage", one(_i("homepage"))), link("package_recipe", one(recipe)), link("package_recipe_raw", one(F.replace(recipe, F.lit("/tree/"), F.lit("/plain/"))))],
    )


def exherbo(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<name:string,category:string,version:string,homepage:string,downloads:string,repository:string,summary:string,exheres_url:string,exheres_url_raw:string>")
    version = F.regexp_replace(_i("version"), "-r[0-9]+$", "")
    return raw(
        rows,
        names={"short_name": _i("name"), "full_name": F.concat_ws("/", _i("category"), _i("name"))},
        version=version,
        categories=one(_i("category")),
        subrepo=_i("repository"),
        summary=_i("summary"),
        flags=flag_if(version.rlike("(^|-)scm$"), "rolling"),
        links=[link("upstream_homepage", _words(_i("homepage"))), link("upstream_download", _words(_i("downloads"))), link("package_recipe", one(_i("exheres_url"))), link("package_recipe_raw", one(_i("exheres_url_raw")))],
    )


def guix(docs: DataFrame, download_hosts_blacklist: tuple[str, ...] = ()) -> DataFrame:
    """Snapshots by the shape of the version, or by a version that names the revision fetched."""
    source = "struct<type:string,urls:array<string>,svn_url:string,svn_revision:string,git_url:string,git_ref:string>"
    rows = json_items(docs, f"struct<name:string,version:string,synopsis:string,homepage:string,location:string,cpe_name:string,source:array<{source}>>").filter("item.version <> ''")
    version, sources = _i("version"), F.coalesce(_i("source"), F.array().cast(f"array<{source}>"))
    shaped = version.rlike(r"(?s)^.*-[0-9]+\.[0-9a-f]{4,}$")
    commit = F.regexp_extract(version, r"^(.*)-[0-9]+\.([0-9a-f]{7,})$", 2)
    host = lambda u: F.lower(F.regexp_extract(u, r"^[a-zA-Z0-9+.-]+://(?:[^/@]*@)?([^/:]+)", 1))
    hashed = lambda s: s["git_ref"].rlike("^[0-9a-f]{7,}$") & ~s["git_ref"].rlike("^[0-9]{8}$")
    named = lambda s: (commit != "") & s["git_ref"].startswith(commit)
    is_ = lambda s, k: s["type"] == k
    snapshot = F.exists(sources, lambda s: (~s["type"].isin("svn", "git") & shaped) | (is_(s, "svn") & F.array_contains(F.split(version, "[._-]"), s["svn_revision"])) | (is_(s, "git") & hashed(s) & named(s)))
    wrong = F.exists(sources, lambda s: is_(s, "git") & hashed(s) & ~named(s) & F.contains(version, F.substring(s["git_ref"], 1, 7)))
    allowed = lambda u: ~host(u).isin(*download_hosts_blacklist) if download_hosts_blacklist else F.lit(True)
    urls = F.flatten(F.transform(sources, lambda s: F.when(is_(s, "url"), F.filter(F.coalesce(s["urls"], no_texts()), allowed)).otherwise(F.array(F.when(is_(s, "svn"), s["svn_url"]).when(is_(s, "git"), s["git_url"])))))
    place = F.split(_i("location"), ":")
    return raw(
        rows,
        names={"guix": _i("name")},
        version=version,
        summary=_i("synopsis"),
        flags=flags_of(flag_if(F.coalesce(snapshot, F.lit(False)), "ignore"), flag_if(F.coalesce(wrong, F.lit(False)), "incorrect")),
        extrafields=map_of(loc_path=F.get(place, F.lit(0)), loc_line=F.get(place, F.lit(1))),
        cpe=map_of(product=_i("cpe_name")),
        links=[link("upstream_homepage", one(_i("homepage"))), link("upstream_download", urls)],
    )


_FILE = "struct<url:string,tag:string,revision:string,branch:string,checksum:string,using:string>"


def homebrew(docs: DataFrame) -> DataFrame:
    """The stable version and the head (rolling). A place with a checksum is a file, one without is a repository; a tool that says otherwise is an error."""
    rows = json_items(docs, f"struct<name:string,desc:string,homepage:string,ruby_source_path:string,versions:struct<stable:string,head:string>,urls:struct<stable:{_FILE},head:{_FILE}>>")
    kinds = F.array(*[F.struct(_i("versions")[k].alias("version"), _i("urls")[k].alias("file"), F.lit(k == "head").alias("head")) for k in ("stable", "head")])
    rows = rows.withColumn("v", F.explode(F.filter(kinds, lambda v: (F.coalesce(v["version"], F.lit("")) != "") & v["file"].isNotNull())))
    file = F.col("v.file")
    tool, summed = file["using"], file["checksum"].isNotNull()
    # Tools that fetch files, and tools that fetch repositories.
    fits = tool.isNull() | (summed & tool.isin("homebrew_curl", "nounzip")) | (~summed & tool.isin("bzr", "cvs", "fossil", "git", "hg", "svn"))
    vcs = F.when(fits, ~summed).otherwise(F.raise_error(F.concat(F.lit("tool and checksum do not fit: "), tool)).cast("boolean"))
    return raw(
        rows,
        names={"homebrew_name": _i("name"), "homebrew_name_pre_at": F.substring_index(_i("name"), "@", 1)},
        version=F.col("v.version"),
        flags=flag_if(F.col("v.head"), "rolling"),
        summary=_i("desc"),
        extrafields=map_of(ruby_source_path=_i("ruby_source_path")),
        links=[link("upstream_homepage", one(_i("homepage"))), link("upstream_download", one(F.when(~vcs, file["url"]))), link("upstream_repository", one(F.when(vcs, file["url"])))],
    )


def homebrew_cask(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<token:string,name:array<string>,version:string,desc:string,homepage:string,url:string,ruby_source_path:string>")
    return raw(
        rows,
        names={"homebrew_cask_token": _i("token"), "homebrew_cask_first_name": F.get(_i("name"), F.lit(0))},
        version=F.substring_index(_i("version"), ",", 1),
        summary=_i("desc"),
        extrafields=map_of(ruby_source_path=_i("ruby_source_path")),
        links=[link("upstream_homepage", one(_i("homepage"))), link("upstream_download", one(_i("url")))],
    )


def luarocks(docs: DataFrame) -> DataFrame:
    """The greatest version of each rock, without its revision."""
    rows = json_entries(docs, "map<string,string>", "repository").filter(F.size("item") > 0)
    greatest = F.array_max(F.transform(F.map_keys("item"), lambda v: F.struct(version_key(v).alias("k"), v.alias("v"))))["v"]
    return raw(rows, names={"src": F.col("key")}, version=strip_right(greatest, "-"))


def pacstall(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<name:string,version:string,description:string,url:string,source:array<struct<value:string>>,packageDetailsUrl:string,recipeUrl:string,maintainer:array<struct<email:string>>>")
    urls = F.filter(_i("source")["value"], lambda u: u.startswith("http"))
    return raw(
        rows,
        names={"pacstall": _i("name")},
        version=strip_left(strip_right(_i("version"), "-"), ":"),
        summary=_i("description"),
        maintainers=_i("maintainer")["email"],
        links=[
            link("upstream_homepage", one(_i("url"))),
            F.transform(urls, lambda u: F.struct(F.when(u.endswith(".git"), 2).otherwise(1).alias("link_type"), u.alias("url"))),
            link("package_homepage", one(_i("packageDetailsUrl"))),
            link("package_recipe_raw", one(_i("recipeUrl"))),
        ],
    )


# Labels of project links and what they mean.
PYPI_LINKS = {
    "upstream_homepage": ("homepage", "website"),
    "upstream_download": ("download",),
    "upstream_repository": ("code", "repository", "source", "source code", "sources"),
    "upstream_issue_tracker": ("bug reports", "bug tracker", "issue tracker", "issues", "tracker"),
    "upstream_documentation": ("docs", "documentation"),
    "upstream_changelog": ("change log", "changelog", "history", "release notes"),
    "upstream_donation": ("donation", "funding"),
    "upstream_discussion": ("chat", "discord", "discussions", "forum"),
    "upstream_coverage": ("coverage",),
    "upstream_ci": ("ci",),
    "upstream_wiki": ("wiki",),
}


def pypi(docs: DataFrame) -> DataFrame:
    """A row for each release; recalled if all of its files are yanked, for development if its version says so."""
    info = "struct<name:string,project_url:string,home_page:string,author_email:string,summary:string,project_urls:map<string,string>>"
    rows = json_items(docs, f"struct<info:{info},releases:map<string,array<struct<yanked:boolean,url:string>>>>")
    rows = rows.select("item.info", F.explode("item.releases").alias("version", "files"))
    info_ = lambda c: F.col("info").getField(c)
    mails = F.filter(F.transform(F.split(F.coalesce(info_("author_email"), F.lit("")), ","), lambda x: F.trim(x)), lambda m: m.rlike("^[^ \"<']+@[^ \"<']*$"))
    labelled = F.filter(F.map_entries(F.coalesce(info_("project_urls"), F.create_map().cast("map<string,string>"))), lambda e: e["value"] != "UNKNOWN")
    of_kind = lambda words: F.transform(F.filter(labelled, lambda e: F.lower(e["key"]).isin(*words)), lambda e: e["value"])
    good = F.filter("files", lambda f: ~F.coalesce(f["yanked"], F.lit(False)))
    devel = F.lower("version").rlike("a|b|rc|dev|alpha|beta|c|pre|preview")  # Fixed value: words of pre-releases.
    return raw(
        rows,
        names={"srcbin": info_("name")},
        version=F.col("version"),
        summary=info_("summary"),
        maintainers=mails,
        flags=flags_of(flag_if(devel, "devel"), flag_if((F.size("files") > 0) & (F.size(good) == 0), "recalled")),
        links=[
            link("project_homepage", one(info_("project_url"))),
            link("upstream_homepage", one(F.nullif(info_("home_page"), F.lit("UNKNOWN")))),
            *[link(kind, of_kind(words)) for kind, words in PYPI_LINKS.items()],
            link("project_download", good["url"]),
        ],
    )


def scoop(docs: DataFrame) -> DataFrame:
    """Files of one package each; places and licences are texts, lists or objects."""
    get = lambda k: F.get_json_object("value", f"$.{k}")
    many = lambda text: F.coalesce(F.from_json(text, "array<string>"), F.when(~text.rlike(r"^\s*[\[{]"), F.array(text)), no_texts())
    builds = F.map_values(F.coalesce(F.from_json(get("architecture"), "map<string,struct<url:string>>"), F.create_map().cast("map<string,struct<url:string>>")))
    per_arch = F.flatten(F.transform(builds, lambda b: many(b["url"])))
    license_ = F.coalesce(F.get_json_object(get("license"), "$.identifier"), F.when(~get("license").rlike(r"^\s*[\[{]"), get("license")))
    rows = docs.filter(F.col("path").rlike(r"\.json$") & ~F.col("path").rlike(r"(^|/)\.[^/]*/[^/]*$"))
    return raw(
        rows,
        names={"bin": F.regexp_extract("path", r"([^/]+)\.json$", 1)},
        version=get("version"),
        licenses=one(license_),
        links=[link("upstream_homepage", one(get("homepage"))), link("upstream_download", many(get("url")), per_arch)],
        extrafields=map_of(path=F.col("path")),
    )


def baulk(docs: DataFrame) -> DataFrame:
    rows = docs.filter(F.col("path").rlike(r"(^|/)bucket/[^/]+\.json$")).select("path", F.from_json("value", "struct<version:string,description:string,homepage:string,architecture:map<string,struct<url:string>>>").alias("item"))
    return raw(
        rows,
        names={"srcbin": F.regexp_extract("path", r"([^/]+)\.json$", 1)},
        version=_i("version"),
        summary=_i("description"),
        flags=flag_if(F.coalesce(_i("homepage").contains("baulk"), F.lit(False)), "untrusted"),
        links=[link("upstream_homepage", one(_i("homepage"))), link("upstream_download", F.map_values(_i("architecture"))["url"])],
    )


def spack(docs: DataFrame) -> DataFrame:
    """Branches (rolling) and the greatest version of all others."""
    version = "struct<version:string,branch:string,downloads:array<string>,repositories:string>"
    rows = json_entries(docs, f"struct<name:string,homepages:array<string>,maintainers:array<string>,categories:array<string>,licenses:array<string>,patches:array<string>,version:array<{version}>>", "packages")
    branches = F.filter(_i("version"), lambda v: v["branch"].isNotNull())
    others = F.filter(_i("version"), lambda v: v["branch"].isNull())
    # Of versions that compare equal the first stays.
    ranked = F.transform(others, lambda v, i: F.struct(version_key(v["version"]).alias("k"), (-i).alias("i"), v.alias("v")))
    latest = F.filter(F.array(F.array_max(ranked)["v"]), lambda v: v.isNotNull())
    rows = rows.withColumn("v", F.explode(F.concat(branches, latest)))
    places = F.coalesce(F.from_json("v.repositories", "array<struct<url:string>>")["url"], F.array(F.get_json_object("v.repositories", "$.url")))
    patches = F.transform(F.filter(_i("patches"), lambda p: ~p.contains("://")), lambda p: F.get(_words(p), F.lit(0)))
    has_files = F.coalesce(F.size("v.downloads"), F.lit(0)) > 0
    return raw(
        rows,
        names={"src": _i("name")},
        version=strip_left(F.col("v.version"), ":"),
        flags=flag_if(F.col("v.branch").isNotNull(), "rolling"),
        maintainers=F.transform(_i("maintainers"), lambda m: F.concat(m, F.lit("@spack"))),
        categories=_i("categories"),
        licenses=_i("licenses"),
        extrafields=map_of(patch=F.array_join(patches, "\n")),
        links=[link("upstream_homepage", _i("homepages")), link("upstream_download", F.col("v.downloads")), link("upstream_repository", F.when(~has_files, places))],
    )


def stalix(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<pkg_name:string,lang_module:string,ix_pkg_name:string,ix_pkg_full_name:string,pkg_ver:string,category:string,maintainers:array<string>,upstream_urls:array<string>>")
    prefix = F.when(_i("lang_module").isin("python", "perl"), F.concat(_i("lang_module"), F.lit(":"))).otherwise("")
    return raw(rows, names={"stalix_pkg": F.concat(prefix, _i("pkg_name")), "stalix_ix": _i("ix_pkg_name"), "stalix_full": _i("ix_pkg_full_name")}, version=_i("pkg_ver"), categories=one(_i("category")), maintainers=_i("maintainers"), links=[link("upstream_download", _i("upstream_urls"))])


def termux(docs: DataFrame) -> DataFrame:
    rows = json_items(docs, "struct<name:string,version:string,description:string,maintainer:string,homepage:string,srcurl:string,package_sources_url:string,package_recipe_url:string,package_recipe_url_raw:string,package_patch_urls:array<string>,package_patch_raw_urls:array<string>>").filter("item.version <> ''")
    account = F.regexp_extract(_i("maintainer"), "(?:^| )@([^ ]+)$", 1)
    pairs = F.arrays_zip(F.coalesce(_i("package_patch_urls"), no_texts()).alias("u"), F.coalesce(_i("package_patch_raw_urls"), no_texts()).alias("r"))
    patches = F.flatten(F.transform(pairs, lambda p: F.array(F.struct(F.lit(11).alias("link_type"), p["u"].alias("url")), F.struct(F.lit(12).alias("link_type"), p["r"].alias("url")))))
    kinds = {"upstream_homepage": "homepage", "upstream_download": "srcurl", "package_sources": "package_sources_url", "package_recipe": "package_recipe_url", "package_recipe_raw": "package_recipe_url_raw"}
    return raw(
        rows,
        names={"srcbin": _i("name")},
        version=strip_left_greedy(_i("version"), ":"),
        summary=_i("description"),
        maintainers=texts(_people(_i("maintainer")), one(F.when(account != "", F.concat(F.lower(account), F.lit("@github"))))),
        links=[*[link(k, one(_i(c))) for k, c in kinds.items()], patches],
    )


def metacpan(docs: DataFrame) -> DataFrame:
    """The latest releases, and development releases that are newer than the latest one of their distribution: a join."""
    item = "struct<name:string,distribution:string,version:string,status:string,maturity:string,abstract:string,author:string,license:array<string>,homepage:string,download_url:string>"
    rows = docs.select(F.explode(F.from_json("value", f"struct<hits:struct<hits:array<struct<_source:{item}>>>>")["hits"]["hits"]["_source"]).alias("item"))
    rows = rows.select("item", _i("distribution").alias("dist"), F.regexp_replace(_i("version"), "^[vV]", "").alias("version"))
    latest = rows.filter("item.status = 'latest'")
    keys = latest.groupBy("dist").agg(F.max(version_key(F.col("version"))).alias("newest"))
    devel = rows.filter("item.status <> 'latest' and item.maturity = 'developer'").join(keys, "dist").filter(version_key(F.col("version")) > F.col("newest")).select("item", "dist", "version")
    both = latest.withColumn("devel", F.lit(False)).unionByName(devel.withColumn("devel", F.lit(True)))
    return raw(
        both,
        names={"src": F.col("dist")},
        version=F.col("version"),
        flags=flag_if(F.col("devel"), "devel"),
        summary=_i("abstract"),
        maintainers=one(F.concat(F.lower(_i("author")), F.lit("@cpan"))),
        licenses=F.filter(_i("license"), lambda x: x != "unknown"),
        links=[link("upstream_homepage", one(_i("homepage"))), link("upstream_download", one(_i("download_url")))],
    )


# Names that the version was cut from wrongly, and the beginnings of such versions.
NIX_WRONG_VERSIONS = {
    "liblqr": ("1",),
    "python2.7": ("3to2",),
    "python3.6": ("3to2",),
    "python3.7": ("3to2",),
    "python3.8": ("3to2",),
    "libretro": ("4do",),
    "polkit-qt": ("1-qt4", "1-qt5"),
    "Dell": ("5130cdn-Color-Laser",),
    "epson": ("201106w",),
    "MPH": ("2B-Damase",),
    "x86": ("64bit",),
    "fuse": ("7z-ng",),
    "av": ("98",),
}
NIX_WRONG_NAMES = ("airstrike-pre",)
NIX_GARBAGE = r"node-_at|^_at|--|^luajit-2\.1\.0-beta3-|^palp-6d|^cudatoolkit-[0-9.-]+-cudnn|^nccl-[0-9.-]+-cuda"
NIX_KNOWN_LETTERS = ("alpha", "beta", "rc", "a", "b", "pre", "post", "rev", "q", "u", "build", "unstable")
NIX_LOGS = {
    ("linux", False): "https://hydra.nixos.org/job/nixpkgs/unstable/{key}.{arch}-linux",
    ("linux", True): "https://hydra.nixos.org/job/nixos/release-{branch}/nixpkgs.{key}.{arch}-linux",
    ("darwin", False): "https://hydra.nixos.org/job/nixpkgs/unstable/{key}.{arch}-darwin",
    ("darwin", True): "https://hydra.nixos.org/job/nixpkgs/nixpkgs-{branch}-darwin/{key}.{arch}-darwin",
}
_NIX_CPE = "struct<vendor:string,product:string,edition:string,language:string,sw_edition:string,target_sw:string,target_hw:string,other:string>"


def nix(docs: DataFrame, branch: str | None = None, enable_build_log_links: bool = True, use_pname: bool = False) -> DataFrame:
    """Packages by attribute path. Name and version are cut from the full name at the first dash before a digit, unless
    ``use_pname``; names and versions that are known to be cut wrongly go, suspicious versions are not trusted."""
    meta = (
        "struct<homepage:string,changelog:string,downloadPage:string,donationPage:string,description:string,license:string,maintainers:array<string>,position:string,broken:boolean,unfree:boolean,insecure:boolean,"
        f"platforms:array<string>,badPlatforms:array<string>,hydraPlatforms:array<string>,identifiers:struct<cpeParts:{_NIX_CPE}>>"
    )
    rows = json_entries(docs, f"struct<name:string,pname:string,version:string,meta:{meta}>", "packages")
    full, pname, stated = _i("name"), F.coalesce(_i("pname"), F.lit("")), F.coalesce(_i("version"), F.lit(""))
    pattern = r"^(.+?)-([0-9].*)$"
    wrong = pname.isin(*NIX_WRONG_NAMES) | stated.rlike("^(100|75)dpi")
    for name, starts in NIX_WRONG_VERSIONS.items():
        for start in starts:
            wrong = wrong | ((pname == name) & stated.startswith(start))
    rows = rows.filter(~full.rlike(NIX_GARBAGE) & ~wrong & (stated != "") & full.rlike(pattern))
    letters = F.regexp_replace(F.lower(stated), r"[^\p{L}]", "")
    suspicious = F.lower(stated).rlike("^[0-9].*[a-z].*-[0-9]") & ~letters.isin(*NIX_KNOWN_LETTERS)
    version = stated if use_pname else F.regexp_extract(full, pattern, 2)
    m = _i("meta")

    def person(text: Column) -> Column:
        """Accounts are objects with a mail address or a name at a host; in old data they are text."""
        mail, account = F.lower(F.get_json_object(text, "$.email")), F.lower(F.get_json_object(text, "$.github"))
        old = F.filter(_people(text), lambda x: ~x.contains("<"))
        known = F.coalesce(mail, F.concat(account, F.lit("@github")))
        return F.when(text.rlike(r"^\s*\{"), F.filter(F.array(known), lambda x: x.isNotNull())).otherwise(old)

    people = F.flatten(F.transform(F.coalesce(m["maintainers"], no_texts()), person))
    people = F.when(F.size(people) > 24, F.raise_error(F.concat(F.lit("too many maintainers of "), F.col("key"))).cast("array<string>")).otherwise(people)

    def license_names(text: Column) -> Column:
        one_name = lambda x: F.coalesce(F.get_json_object(x, "$.spdxId"), F.get_json_object(x, "$.fullName"), F.get_json_object(x, "$.fullname"), F.when(~x.rlike(r"^\s*\{"), x))
        return F.filter(F.transform(F.coalesce(F.from_json(text, "array<string>"), F.array(text)), one_name), lambda x: x.isNotNull())

    pages = F.coalesce(F.from_json(m["homepage"], "array<string>"), F.array(m["homepage"]))
    links = [link("upstream_homepage", pages), link("upstream_changelog", F.coalesce(F.from_json(m["changelog"], "array<string>"), F.array(m["changelog"]))), link("upstream_download_page", one(m["downloadPage"])), link("upstream_donation", one(m["donationPage"]))]
    if enable_build_log_links:
        for arch, platform in (("x86_64", "linux"), ("aarch64", "linux"), ("x86_64", "darwin"), ("aarch64", "darwin")):
            target = f"{arch}-{platform}"
            off = F.coalesce(m["broken"], F.lit(False)) | F.coalesce(m["unfree"], F.lit(False)) | F.coalesce(m["insecure"], F.lit(False))
            built = ~off & F.coalesce(F.array_contains(m["platforms"], target), F.lit(True)) & ~F.coalesce(F.array_contains(m["badPlatforms"], target), F.lit(False)) & F.coalesce(F.array_contains(m["hydraPlatforms"], target), F.lit(True))
            place = NIX_LOGS[platform, branch is not None].replace("{arch}", arch).replace("{branch}", branch or "")
            links.append(link("package_build_logs", one(F.when(built, F.replace(F.lit(place), F.lit("{key}"), F.col("key"))))))
    position = r"^(.*):([0-9]+)$"
    cpe = m["identifiers"]["cpeParts"]
    return raw(
        rows,
        names={"nix_pname": pname if use_pname else F.regexp_extract(full, pattern, 1), "nix_attribute_path": F.col("key")},
        version=version,
        summary=F.replace(m["description"], F.lit("\n"), F.lit(" ")),
        categories=one(F.when(F.col("key").contains("."), F.substring_index("key", ".", 1))),
        maintainers=people,
        licenses=license_names(m["license"]),
        flags=flags_of(flag_if(suspicious, "untrusted"), flag_if(version.rlike("^[0-9a-f]*[a-f][0-9a-f]*$") & (F.length(version) >= 7), "ignore")),
        cpe=map_of(**{c: F.when(cpe["vendor"].isNotNull(), cpe["language" if c == "lang" else c]) for c in _CPE}),
        extrafields=map_of(posfile=F.nullif(F.regexp_extract(m["position"], position, 1), F.lit("")), posline=F.nullif(F.regexp_extract(m["position"], position, 2), F.lit(""))),
        links=links,
    )


def openindiana(docs: DataFrame) -> DataFrame:
    """Publishers, names and versions, nested; what ``set name=… value=…`` actions say; name, version and summary are required."""
    found = docs.select(F.explode(F.from_json("value", "map<string,string>")).alias("publisher", "text")).filter("not startswith(publisher, '_')")
    rows = found.select(F.explode(F.from_json("text", "map<string,array<struct<version:string,actions:array<string>>>>")).alias("fmri", "items")).select("fmri", F.explode("items").alias("item"))
    pattern = r"^set(?: last-fmri=[^ ]+)? name=([^ ]+)(?: refresh_fmri=[^ ]+)?( value=.*)$"

    def said(key: str) -> Column:
        """All values of a name, in order."""
        texts_ = F.flatten(F.transform(F.filter(_i("actions"), lambda a: F.regexp_extract(a, pattern, 1) == key), lambda a: F.slice(F.split(F.regexp_extract(a, pattern, 2), " value="), 2, 1000)))
        return F.transform(texts_, lambda v: F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2"))

    first = lambda key: F.get(said(key), F.lit(0))
    name, version, summary = first("com.oracle.info.name"), first("com.oracle.info.version"), first("pkg.summary")
    rows = rows.filter(name.isNotNull() & version.isNotNull() & summary.isNotNull())
    categories = F.transform(said("info.classification"), lambda c: F.substring_index(c, ":", -1))
    return raw(rows, names={"openindiana_name": name, "openindiana_fmri": F.col("fmri")}, version=version, summary=summary, categories=categories, links=[link("upstream_homepage", said("info.upstream-url")), link("upstream_download", said("info.source-url"))])


def wikidata(docs: DataFrame, names_field: str = "projects") -> DataFrame:
    """Versions times projects; where an entity has preferred versions only those count. Lists are packed in one
    text; ``names_field`` is the one with the names of projects."""
    item = f"struct<project:string,projectLabel:string,projectDescription:string,licenses:string,websites:string,repositories:string,{names_field}:string,versions:string>"
    rows = json_items(docs, item)
    packed = lambda c: F.array_sort(F.split(F.coalesce(_i(c), F.lit("")), SEP))
    parts = lambda v: F.split(v, r"\|")
    kinds = lambda v, k: F.array_contains(F.slice(parts(v), 2, 100), k)
    wanted = F.filter(packed("versions"), lambda v: (v != "") & ~kinds(v, "X") & ~(kinds(v, "o") & ~kinds(v, "O")) & ~(kinds(v, "p") & ~kinds(v, "P")))
    preferred = F.filter(wanted, lambda v: kinds(v, "R"))
    rows = rows.withColumn("v", F.explode(F.when(F.size(preferred) > 0, preferred).otherwise(wanted)))
    rows = rows.withColumn("project", F.explode(packed(names_field)))
    v = F.col("v")
    return raw(
        rows,
        names={"wikidata_entity": F.substring_index(_i("project"), "/", -1), "wikidata_label": _i("projectLabel"), "wikidata_project": F.col("project")},
        version=F.get(parts(v), F.lit(0)),
        flags=flag_if(kinds(v, "U") & ~kinds(v, "S"), "devel"),
        summary=_i("projectDescription"),
        licenses=packed("licenses"),
        links=[link("upstream_homepage", packed("websites")), link("upstream_repository", packed("repositories"))],
    )


def vcpkg(docs: DataFrame) -> DataFrame:
    """``ports/name/vcpkg.json`` beside its ``portfile.cmake``: files of a folder meet by its name."""
    folder = F.regexp_extract("path", "(?:^|/)ports/([^/]+)/[^/]+$", 1)
    file = F.substring_index("path", "/", -1)
    pick = lambda f: F.max(F.when(F.col("file") == f, F.col("value")))
    patch = F.array_join(F.array_sort(F.collect_list(F.when(F.col("file").endswith(".patch"), F.col("file")))), "\n")
    rows = docs.select(folder.alias("folder"), file.alias("file"), "value").filter("folder <> ''").groupBy("folder").agg(pick("vcpkg.json").alias("value"), F.coalesce(pick("portfile.cmake").contains("libimobiledevice-win32"), F.lit(False)).alias("faked"), patch.alias("patch")).filter("value is not null")
    get = lambda k: F.get_json_object("value", f"$['{k}']")
    version = F.coalesce(*[get(k) for k in ("version", "version-string", "version-semver", "version-date")])
    dated = version.rlike("^[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}")
    # Marks of the packager, pre-release words before a dash, commits.
    plain = F.regexp_replace(version, "[^0-9]*vcpkg.*$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "(alpha|beta|rc|patch)-([0-9]+)$", "$1$2"), "-[0-9a-f]{6,}$", "")
    description = F.coalesce(F.get(F.from_json(get("description"), "array<string>"), F.lit(0)), get("description"))
    people = F.coalesce(F.from_json(get("maintainers"), "array<string>"), F.array(get("maintainers")))
    name = F.when(get("name") == F.col("folder"), get("name")).otherwise(F.raise_error(F.concat(F.lit("name differs from folder "), F.col("folder"))))
    return raw(
        rows,
        names={"src": name},
        version=F.when(dated, version).otherwise(plain),
        flags=flags_of(flag_if(dated, "untrusted"), flag_if(F.col("faked"), "untrusted")),
        summary=description,
        maintainers=F.flatten(F.transform(texts(people), extract_maintainers)),
        extrafields=map_of(patch=F.nullif(F.col("patch"), F.lit(""))),
        links=[link("upstream_homepage", one(get("homepage")))],
    )


PARSERS = {
    f.__name__: ("files", f)
    for f in (aosc, aur, baulk, chromebrew, crates, crux, cygwin, exherbo, guix, homebrew, homebrew_cask, luarocks, macports, metacpan, mports, nix, opam, openindiana, openvsx, pacstall, ptxdist, pypi, ravenports, salix, scoop, sisyphus, spack, stalix, termux, vcpkg, wikidata, yacp)
}
