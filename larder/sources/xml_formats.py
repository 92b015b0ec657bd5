"""Parsers of XML formats: elements (column ``item``, from ``readers.xml_rows`` or ``xml_items``) to RAW."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.distro_versions import nevra, parse_rpm
from larder.functions.normalize import extract_maintainers, split_cpe
from larder.functions.versions import strip_right_greedy
from larder.sources.packages import flag_if, link, map_of, no_texts, one, raw, texts

REPODATA = (
    "name string, arch string, version struct<_epoch:string,_ver:string,_rel:string>, summary string, packager string, url string, "
    "format struct<license:string,group:string,sourcerpm:string,provides:struct<entry:array<struct<_name:string,_ver:string,_rel:string>>>>"
)
SOLUS = (
    "Name string, Summary string, License array<string>, PartOf array<string>, Architecture string, "
    "History struct<Update:array<struct<Version:string>>>, Source struct<Name:string,Homepage:string,Packager:struct<Email:string>>"
)
PISI = (
    "Source struct<Name:string,Summary:array<string>,Homepage:array<string>,Archive:array<string>,License:array<string>,IsA:array<string>,Packager:struct<Email:string>>, "
    "History struct<Update:array<struct<_release:int,Version:string>>>"
)
FDROID = (
    "id string, name string, license string, categories string, web string, source string, issues string, changelog string, donate string, summary string, "
    "marketvercode long, package array<struct<version:string,versioncode:long>>"
)
OPENPKG = "Name string, Version string, Release string, License string, Summary string, Group string, URL string, Source array<struct<bag:struct<li:array<string>>>>"
CHOCOLATEY = (
    "title string, summary string, properties struct<Version:string,Title:string,ProjectUrl:string,ProjectSourceUrl:string,PackageSourceUrl:string,DocsUrl:string,BugTrackerUrl:string,MailingListUrl:string>"
)
NPACKD = (
    "license array<struct<_name:string,title:string>>, package array<struct<_name:string,title:string,license:array<string>,category:array<string>,url:array<string>>>, "
    "version array<struct<_package:string,_name:string,url:array<string>>>"
)
GENTOO_METADATA = "maintainer array<struct<email:string>>, upstream struct<`remote-id`:array<struct<_VALUE:string,_type:string>>>"


def _c(name: str) -> Column:
    return F.col(f"item.{name}")


def repodata(items: DataFrame, src: bool = True, binary: bool = False, vertags: tuple[str, ...] = (), binnames_from_provides: bool = True) -> DataFrame:
    """Source packages, binary ones, or both; names that a package provides with a full version, and no brackets, are its binaries."""
    if not (src or binary):
        raise ValueError("source or binary packages must be asked for")
    is_src = _c("arch") == "src"
    rows = items.filter((is_src & F.lit(src)) | (~is_src & F.lit(binary))).filter(~_c("name").contains("%{"))
    v, r, e = _c("version._ver"), _c("version._rel"), F.coalesce(_c("version._epoch"), F.lit(""))
    parsed = parse_rpm(v, r, vertags)
    provided = F.filter(F.coalesce(_c("format.provides.entry"), F.array().cast("array<struct<_name:string,_ver:string,_rel:string>>")), lambda p: p["_ver"].isNotNull() & p["_rel"].isNotNull() & ~p["_name"].contains("("))
    return raw(
        rows,
        names={"srcrpm": F.when(is_src, _c("name")), "binrpm_name": F.when(~is_src, _c("name")), "binrpm_srcname": F.when(~is_src, nevra(_c("format.sourcerpm"))["name"])},
        version=strip_right_greedy(parsed["version"], "+"),
        rawversion=F.concat(F.when(e.isin("", "0"), "").otherwise(F.concat(e, F.lit(":"))), v, F.lit("-"), r),
        flags=parsed["flags"],
        summary=_c("summary"),
        arch=_c("arch"),
        licenses=one(_c("format.license")),
        categories=one(_c("format.group")),
        binnames=provided["_name"] if binnames_from_provides else no_texts(),
        maintainers=extract_maintainers(F.coalesce(_c("packager"), F.lit(""))),
        links=[link("upstream_homepage", one(_c("url")))],
    )


def solus(items: DataFrame) -> DataFrame:
    licenses = F.flatten(F.transform(F.coalesce(_c("License"), no_texts()), lambda x: F.transform(F.split(x, "\n"), lambda x: F.trim(x))))
    return raw(
        items,
        names={"name": _c("Name"), "base": _c("Source.Name")},
        version=F.get(_c("History.Update"), F.lit(0))["Version"],
        summary=_c("Summary"),
        licenses=texts(licenses),
        categories=_c("PartOf"),
        arch=_c("Architecture"),
        maintainers=one(_c("Source.Packager.Email")),
        links=[link("upstream_homepage", one(_c("Source.Homepage")))],
    )


def pisi(items: DataFrame) -> DataFrame:
    """``…/name/pspec.xml`` files (with their path): the update with the greatest release number."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    last = F.array_max(F.transform(_c("History.Update"), lambda u: F.struct(u["_release"].alias("r"), u["Version"].alias("v"))))
    return raw(
        items,
        names={"pisi_name": _c("Source.Name"), "pisi_pkgdir": folder},
        version=last["v"],
        summary=F.get(_c("Source.Summary"), F.lit(0)),
        licenses=_c("Source.License"),
        categories=_c("Source.IsA"),
        maintainers=one(_c("Source.Packager.Email")),
        links=[link("upstream_homepage", _c("Source.Homepage")), link("upstream_download", F.transform(_c("Source.Archive"), lambda x: F.trim(x)))],
    )


def fdroid(items: DataFrame) -> DataFrame:
    """A row for each build with a version; those newer than the announced one are development versions."""
    rows = items.withColumn("p", F.explode("item.package")).filter("p.version <> ''")
    kinds = {"upstream_issue_tracker": "issues", "upstream_changelog": "changelog", "upstream_donation": "donate"}
    return raw(
        rows,
        names={"fdroid_id": _c("id"), "fdroid_name": F.replace(_c("name"), F.lit("\n"), F.lit(""))},
        version=F.col("p.version"),
        flags=flag_if(F.col("p.versioncode") > _c("marketvercode"), "devel"),
        summary=_c("summary"),
        licenses=one(_c("license")),
        categories=F.split(_c("categories"), ","),
        extrafields=map_of(versioncode=F.col("p.versioncode")),
        links=[link("upstream_homepage", F.array(_c("web"), _c("source"))), *[link(k, one(_c(c))) for k, c in kinds.items()]],
    )


def openpkg(items: DataFrame) -> DataFrame:
    sources = F.filter(F.flatten(F.coalesce(_c("Source")["bag"]["li"], F.array().cast("array<array<string>>"))), lambda u: u.rlike("^(https?|ftp)://") & ~u.contains("openpkg.org"))
    return raw(
        items,
        names={"srcrpm": _c("Name")},
        version=_c("Version"),
        summary=_c("Summary"),
        licenses=one(_c("License")),
        categories=one(_c("Group")),
        flags=flag_if(_c("Version").endswith(_c("Release")), "untrusted"),
        links=[link("upstream_homepage", one(_c("URL"))), link("upstream_download", sources)],
    )


def chocolatey(items: DataFrame) -> DataFrame:
    """Pages of entries; the title in the metadata may be empty."""
    p = lambda k: F.nullif(F.trim(_c(f"properties.{k}")), F.lit(""))
    kinds = {"upstream_homepage": "ProjectUrl", "upstream_repository": "ProjectSourceUrl", "package_sources": "PackageSourceUrl", "upstream_documentation": "DocsUrl", "upstream_issue_tracker": "BugTrackerUrl", "upstream_discussion": "MailingListUrl"}
    return raw(items, names={"chocolatey_title": _c("title"), "chocolatey_metadata_title": p("Title")}, version=p("Version"), summary=_c("summary"), links=[link(k, one(p(c))) for k, c in kinds.items()])


def npackd(items: DataFrame) -> DataFrame:
    """Whole repository texts: versions join packages, and packages the titles of their licences, by name."""
    repo = items.withColumn("repo", F.monotonically_increasing_id())
    packages = repo.select("repo", F.explode("item.package").alias("p"))
    titles = repo.select("repo", F.explode("item.license").alias("l")).select("repo", F.col("l._name").alias("key"), F.col("l.title").alias("title"))
    used = packages.select("repo", F.col("p._name").alias("name"), F.posexplode("p.license").alias("at", "key")).join(titles, ["repo", "key"])
    used = used.groupBy("repo", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]).alias("licenses"))
    versions = repo.select("repo", F.explode("item.version").alias("v")).withColumn("name", F.col("v._package"))
    rows = versions.join(packages.withColumn("name", F.col("p._name")), ["repo", "name"]).join(used, ["repo", "name"], "left")
    return raw(
        rows,
        names={"npackd_title": F.col("p.title"), "npackd_fullname": F.col("name"), "npackd_lastname": F.substring_index("name", ".", -1)},
        version=F.col("v._name"),
        licenses=F.col("licenses"),
        categories=F.filter(F.col("p.category"), lambda c: ~c.rlike("^(end-of-life|libs|reupload|same-url|stable|stable64|unstable)$")),
        links=[link("upstream_download", F.col("v.url")), link("upstream_homepage", F.col("p.url"))],
    )


def void_plist(docs: DataFrame) -> DataFrame:
    """A property list of packages: keys and string values of each are read by pattern; one without source revisions goes."""
    entry = r"(?s)<key>([^<]+)</key>\s*<dict>(.*?)</dict>"
    found = docs.select(F.explode(F.regexp_extract_all("value", F.lit(entry), F.lit(0))).alias("e"))
    rows = found.select(F.regexp_extract("e", entry, 1).alias("name"), F.regexp_extract("e", entry, 2).alias("body"))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    get = lambda k: F.nullif(plain(F.regexp_extract("body", rf"(?s)<key>{k}</key>\s*<string>([^<]*)</string>", 1)), F.lit(""))
    rows = rows.filter(get("source-revisions").isNotNull() & get("pkgver").startswith(F.concat("name", F.lit("-"))))
    return raw(
        rows,
        names={"name": F.col("name"), "base": F.substring_index(get("source-revisions"), ":", 1)},
        version=strip_right_greedy(F.substr(get("pkgver"), F.length("name") + 2), "_"),
        maintainers=extract_maintainers(F.coalesce(get("maintainer"), F.lit(""))),
        summary=get("short_desc"),
        licenses=F.split(get("license"), ","),
        arch=get("architecture"),
        links=[link("upstream_homepage", one(get("homepage")))],
    )


# Link of each kind of remote identifier.
REMOTES = {
    "bitbucket": "https://bitbucket.org/{}",
    "codeberg": "https://codeberg.org/{}",
    "cpan": "https://metacpan.org/release/{}",
    "cran": "https://cran.r-project.org/web/packages/{}/",
    "ctan": "https://www.ctan.org/pkg/{}",
    "freecode": "http://freecode.com/projects/{}",
    "freedesktop-gitlab": "https://gitlab.freedesktop.org/{}",
    "freshmeat": "http://freshmeat.net/projects/{}/",
    "gentoo": "https://gitweb.gentoo.org/{}.git/",
    "github": "https://github.com/{}",
    "gitlab": "https://gitlab.com/{}",
    "gnome-gitlab": "https://gitlab.gnome.org/{}",
    "google-code": "https://code.google.com/p/{}/",
    "hackage": "https://hackage.haskell.org/package/{}",
    "heptapod": "https://foss.heptapod.net/{}",
    "kde-invent": "https://invent.kde.org/{}",
    "launchpad": "https://launchpad.net/{}",
    "osdn": "https://osdn.net/projects/{}/",
    "pear": "https://pear.php.net/package/{}",
    "pecl": "https://pecl.php.net/package/{}",
    "pypi": "https://pypi.org/project/{}/",
    "rubygems": "https://rubygems.org/gems/{}",
    "savannah": "https://savannah.gnu.org/projects/{}",
    "savannah-nongnu": "https://savannah.nongnu.org/projects/{}",
    "sourceforge": "https://sourceforge.net/projects/{}/",
    "sourceforge-jp": "https://osdn.net/projects/{}/",
    "sourcehut": "https://sr.ht/{}/",
    "vim": "https://vim.org/scripts/script.php?script_id={}",
}


def conditional_words(text: Column) -> Column:
    """Words of a dependency expression: conditions, brackets and new names of files are left out."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\s)->\s+\S+", " ")
    plain = F.regexp_replace(plain, r"(?<!\S)[^\s/]+\?\s+\((?!\S)", " ")
    return F.filter(F.split(F.trim(plain), r"\s+"), lambda w: ~w.isin("", "(", ")"))


def gentoo(tree: DataFrame, require_cache: bool = True) -> DataFrame:
    """(path, value) of a tree: ``category/name/name-version.ebuild`` joins ``metadata/md5-cache/category/name-version`` and
    ``category/name/metadata.xml``."""
    part = lambda p, k: F.regexp_extract("path", p, k)
    ebuild, cache, meta = r"^([^/]+)/([^/]+)/([^/]+)\.ebuild$", r"^metadata/md5-cache/([^/]+)/([^/]+)$", r"^([^/]+)/([^/]+)/metadata\.xml$"
    rows = tree.filter(F.col("path").rlike(ebuild)).select(part(ebuild, 1).alias("category"), part(ebuild, 2).alias("name"), part(ebuild, 3).alias("full"))
    cached = tree.filter(F.col("path").rlike(cache)).select(part(cache, 1).alias("category"), part(cache, 2).alias("full"), F.col("value").alias("cache"))
    cpe = F.nullif(F.regexp_extract("value", r'<remote-id type="cpe">([^<]*)</remote-id>', 1), F.lit(""))
    described = tree.filter(F.col("path").rlike(meta)).select(part(meta, 1).alias("category"), part(meta, 2).alias("name"), F.from_xml("value", GENTOO_METADATA, {"valueTag": "_VALUE", "attributePrefix": "_"}).alias("m"), cpe.alias("cpe"))
    rows = rows.join(cached, ["category", "full"], "inner" if require_cache else "left").join(described, ["category", "name"], "left")
    get = lambda k: F.nullif(F.regexp_extract("cache", rf"(?m)^{k}=(.*)$", 1), F.lit(""))
    version = F.regexp_replace(F.substr("full", F.length("name") + 2), "-r[0-9]+$", "")
    table = F.create_map(*[F.lit(x) for pair in REMOTES.items() for x in pair])
    remotes = F.transform(F.coalesce("m.upstream.remote-id", F.array().cast("array<struct<_VALUE:string,_type:string>>")), lambda r: F.replace(F.try_element_at(table, r["_type"]), F.lit("{}"), F.trim(r["_VALUE"])))
    names = split_cpe(F.coalesce("cpe", F.lit("")))
    licenses = F.when(get("LICENSE").contains("("), F.array(get("LICENSE"))).otherwise(F.split(get("LICENSE"), " "))
    return raw(
        rows,
        names={"short_name": F.col("name"), "full_name": F.concat_ws("/", "category", "name")},
        version=version,
        flags=flag_if(version.endswith("9999"), "rolling"),
        categories=one(F.col("category")),
        summary=get("DESCRIPTION"),
        licenses=licenses,
        maintainers=F.transform(F.col("m.maintainer")["email"], lambda x: F.trim(x)),
        cpe=map_of(vendor=F.get(names, F.lit(2)), product=F.get(names, F.lit(3))),
        links=[
            link("upstream_download", F.filter(conditional_words(get("SRC_URI")), lambda u: u.contains("/"))),
            link("upstream_homepage", F.split(F.coalesce(get("HOMEPAGE"), F.lit("")), " "), remotes),
        ],
    )


#: Parsers by name: the tag of a row (None: whole texts), the schema of an element, and the function.
PARSERS = {
    "repodata": ("package", REPODATA, repodata),
    "solus": ("Package", SOLUS, solus),
    "pisi": ("PISI", PISI, pisi),
    "fdroid": ("application", FDROID, fdroid),
    "openpkg": ("Description", OPENPKG, openpkg),
    "chocolatey": ("entry", CHOCOLATEY, chocolatey),
    "npackd": ("root", NPACKD, npackd),
    "void_plist": (None, None, void_plist),
    "gentoo": (None, None, gentoo),
}
