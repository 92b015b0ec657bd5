"""Queries of the load path: texts of repository formats, written from the driver's tables, parsed back to packages.

The twins state what each text was made from, so they hold the parsers against their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.folders import run_folder
from larder.functions import normalize
from larder.functions.distro_versions import nevra, nevra_text
from larder.functions.link_templates import compile_template
from larder.functions.versions import version_key
from larder.plans.landscape import table
from larder.plans.registry import ORACLE_SQL, query
from larder.sources import json_formats, load_log, text_formats, xml_formats
from larder.sources.json_files import json_documents
from larder.sources.names import MAPPINGS, ROLES, mapped_names
from larder.sources.packages import Repository, dumped, link, load, make_packages, raw
from larder.sources.readers import xml_items

REPO = Repository("repo", "family", default_maintainer="nobody@example.com")
ROWS = """WITH r AS (SELECT p_partkey AS k, concat(replace(lower(p_name), ' ', '-'), '-', CAST(p_partkey AS VARCHAR)) AS n,
concat(CAST(p_size AS VARCHAR), '.', CAST(p_partkey % 17 AS VARCHAR)) AS v, lower(p_type) AS c, lower(replace(p_brand, '#', '')) AS b, p_size AS size FROM part)
"""


def rows(spark, sf_dir) -> DataFrame:
    """Parts as what a source states of a package: number, name, version, category, brand.

    They are few bytes for what their parsing costs, so they are dealt out to all cores rather than read in one or two tasks.
    """
    text = lambda c: F.col(c).cast("string")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand")
    return part.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey").select(
        F.col("p_partkey").alias("k"),
        F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), text("p_partkey")).alias("n"),
        F.concat(text("p_size"), F.lit("."), (F.col("p_partkey") % 17).cast("string")).alias("v"),
        F.lower("p_type").alias("c"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("b"),
        F.col("p_size").alias("size"),
    )


def written(records: DataFrame, template: str, *keep: str) -> DataFrame:
    """(value): a text with the columns named in braces filled in; doubled braces stand for themselves."""
    parts: list[Column] = []
    for k, piece in enumerate(template.replace("{{", "\x00").replace("}}", "\x01").split("{")):
        if k:
            name, _, piece = piece.partition("}")
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
        parts.append(F.lit(piece.replace("\x00", "{").replace("\x01", "}")))
    return records.select(F.concat(*parts).alias("value"), *keep)


def json_texts(records: DataFrame, item: Column, at: str | None = None) -> DataFrame:
    """(value): one JSON text for each brand, a list of items, below a key where one is given."""
    lists = records.groupBy("b").agg(F.collect_list(item).alias("list"))
    return lists.select((F.to_json(F.struct(F.col("list").alias(at))) if at else F.to_json("list")).alias("value"))


def plain(raw: DataFrame, *columns: str) -> DataFrame:
    """Packages of raw records with lists as text; links as type and place."""
    packages = make_packages(raw, REPO)
    out = []
    for c in ("effname", "version", *columns):
        if c == "links":
            out.append(F.array_join(F.transform(F.coalesce("links", F.array().cast("array<struct<link_type:int,url:string,fragment:string>>")), lambda x: F.concat_ws("|", x["link_type"].cast("string"), x["url"], x["fragment"])), " ").alias(c))
        elif packages.schema[c].dataType.typeName() == "array":
            out.append(F.coalesce(F.array_join(c, ","), F.lit("")).alias(c))
        else:
            out.append(F.col(c))
    return packages.select(*out)


@query(ROWS + """SELECT n AS effname, concat(v, CASE k % 4 WHEN 1 THEN '~rc1' WHEN 3 THEN '~alpha2' ELSE '' END) AS version,
concat('1:', v, CASE k % 4 WHEN 1 THEN '~rc1' WHEN 2 THEN '+dfsg' WHEN 3 THEN '~alpha2+ds1' ELSE '' END, '-2') AS rawversion, CASE WHEN k % 2 = 1 THEN 2 ELSE 0 END AS flags,
concat(n, ',lib', n) AS binnames, concat(b, '@x.org,one@y.org,up@y.org') AS maintainers, c AS category, concat('0|http://', b, '.org/ 7|https://git.org/', n) AS links FROM r""")
def parse_debian_sources(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("s", F.element_at(F.array(*[F.lit(x) for x in ("", "~rc1", "+dfsg", "~alpha2+ds1")]), (F.col("k") % 4 + 1).cast("int")))
    text = "Package: {n}\nBinary: {n}, lib{n}\nVersion: 1:{v}{s}-2\nMaintainer: A B <{b}@X.org>\nUploaders: One <one@y.org>,\n Up <up@y.org>\nSection: {c}\nHomepage: http://{b}.ORG\nVcs-Git: https://git.org/{n}"
    return plain(text_formats.debian_sources(written(r, text), allowed_vcs_urls="https://git"), "rawversion", "flags", "binnames", "maintainers", "category", "links")


@query(ROWS + "SELECT n AS effname, v AS version, n AS srcname, concat(n, '-libs') AS binname, 'x86_64' AS arch, concat('A tool of ', b) AS comment, 'MIT,BSD' AS licenses, concat('0|https://', b, '.org/') AS links FROM r")
def parse_arch_descriptions(spark, sf_dir):
    text = "%NAME%\n{n}-libs\n\n%BASE%\n{n}\n\n%VERSION%\n2:{v}+r5-1\n\n%DESC%\nA tool of {b}\n\n%URL%\nhttps://{b}.org\n\n%ARCH%\nx86_64\n\n%LICENSE%\nMIT\nBSD\n"
    return plain(text_formats.arch_desc(written(rows(spark, sf_dir), text)), "srcname", "binname", "arch", "comment", "licenses", "links")


@query(ROWS + "SELECT n AS effname, v AS version, n AS binname, concat(b, '@y.z') AS maintainers, c AS category FROM r")
def parse_msys2_descriptions(spark, sf_dir):
    text = "%NAME%\n{n}\n\n%VERSION%\n1~{v}-3\n\n%PACKAGER%\nX Y <{b}@y.z>\n\n%GROUPS%\n{c}\nother\n"
    return plain(text_formats.msys2_desc(written(rows(spark, sf_dir), text)), "binname", "maintainers", "category")


@query(ROWS + "SELECT n AS effname, v AS version, concat('./', c, '/', n) AS trackname, 'noarch' AS arch FROM r")
def parse_slackware_packages(spark, sf_dir):
    text = "PACKAGE NAME:  {n}-{v}-noarch-1.txz\nPACKAGE LOCATION:  ./{c}\nPACKAGE SIZE (compressed):  {size} K"
    return plain(text_formats.slackware(written(rows(spark, sf_dir), text)), "trackname", "arch")


@query(ROWS + "SELECT n AS effname, v AS version, concat(n, '-doc') AS binname, 'MIT' AS licenses, concat(b, '@y.z') AS maintainers, c AS comment FROM r")
def parse_apk_index(spark, sf_dir):
    text = "P:{n}-doc\no:{n}\nV:{v}-r{size}\nT:{c}\nU:https://{b}.org\nL:MIT\nA:x86\nm:M M <{b}@y.z>"
    return plain(text_formats.apk_index(written(rows(spark, sf_dir), text)), "binname", "licenses", "maintainers", "comment")


@query(ROWS + "SELECT n AS effname, v AS version, concat(c, '/', n) AS srcname, concat(b, '@y.z') AS maintainers, c AS category, concat('0|http://', b, '.org/ 0|http://two.org/') AS links FROM r")
def parse_freebsd_index(spark, sf_dir):
    text = "{n}-{v}_4,1|/usr/ports/{c}/{n}|/usr/local|A tool|/d|{b}@Y.z|{c} misc|||http://{b}.org/ http://two.org/|||"
    return plain(text_formats.freebsd_index(written(rows(spark, sf_dir), text)), "srcname", "maintainers", "category", "links")


@query(ROWS + "SELECT n AS effname, v AS version, concat(c, '/', n) AS srcname, concat('0|http://', b, '.org/') AS links FROM r")
def parse_pkgsrc_index(spark, sf_dir):
    text = "{n}-{v}nb3|{c}/{n}|/usr/pkg|A tool|d|{b}@y.z|{c}|||||http://{b}.org/"
    return plain(text_formats.pkgsrc_index(written(rows(spark, sf_dir), text)), "srcname", "links")


@query(ROWS + """SELECT n AS effname, CASE WHEN k % 3 = 0 THEN concat(v, '-rc2') ELSE v END AS version, concat(CASE WHEN k % 2 = 1 THEN '2:' ELSE '' END, v, '-', CASE WHEN k % 3 = 0 THEN '0.rc2.1' ELSE '5' END) AS rawversion,
CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS flags, n AS binnames, concat(b, '@y.z') AS maintainers, c AS category, 'GPL' AS licenses FROM r WHERE k % 5 > 0""")
def parse_repodata(spark, sf_dir):
    r = rows(spark, sf_dir).withColumns({"e": (F.col("k") % 2 * 2), "rel": F.when(F.col("k") % 3 == 0, "0.rc2.1").otherwise("5"), "a": F.when(F.col("k") % 5 == 0, "x86_64").otherwise("src")})
    text = '<package type="rpm"><name>{n}</name><arch>{a}</arch><version epoch="{e}" ver="{v}" rel="{rel}"/><summary>s</summary><packager>X &lt;{b}@y.z&gt;</packager><url>http://{b}.org/</url><format><license>GPL</license><group>{c}</group><sourcerpm>{n}-1-1.src.rpm</sourcerpm><provides><entry name="{n}" ver="1" rel="2"/><entry name="q(x)" ver="1" rel="1"/><entry name="z"/></provides></format></package>'
    return plain(xml_formats.repodata(xml_items(written(r, text), xml_formats.REPODATA)), "rawversion", "flags", "binnames", "maintainers", "category", "licenses")


@query(ROWS + "SELECT n AS effname, v AS version, concat(c, '/', n) AS srcname FROM r")
def parse_pisi(spark, sf_dir):
    text = "<PISI><Source><Name>{n}</Name><Summary>s</Summary></Source><History><Update release='9'><Version>0.1</Version></Update><Update release='10'><Version>{v}</Version></Update></History></PISI>"
    items = xml_items(written(rows(spark, sf_dir).withColumn("path", F.concat("c", F.lit("/"), "n", F.lit("/pspec.xml"))), text, "path"), xml_formats.PISI)
    return plain(xml_formats.pisi(items), "srcname")


@query(ROWS + "SELECT n AS effname, v AS version, concat(n, '-git') AS binname, concat(b, '@aur,second@aur') AS maintainers, 'MIT' AS licenses FROM r")
def parse_aur(spark, sf_dir):
    one = lambda x: F.array(F.lit(x))
    item = F.struct(F.concat("n", F.lit("-git")).alias("Name"), F.concat(F.lit("1:"), "v", F.lit("+r7-2")).alias("Version"), F.col("n").alias("PackageBase"), F.col("b").alias("Maintainer"), one("second").alias("CoMaintainers"), one("MIT").alias("License"))
    return plain(json_formats.aur(json_texts(rows(spark, sf_dir), item)), "binname", "maintainers", "licenses")


def crate() -> Column:
    """A third has a stable version only, a third a newer one beside it, a third no stable one."""
    newer = F.concat("v", F.lit(".9-rc"))
    return F.struct(F.col("n").alias("id"), F.col("n").alias("name"), F.when(F.col("k") % 3 < 2, F.col("v")).alias("max_stable_version"), F.when(F.col("k") % 3 == 0, F.col("v")).otherwise(newer).alias("max_version"))


@query(ROWS + """SELECT n AS effname, v AS version, 0 AS flags FROM r WHERE k % 3 < 2 UNION ALL SELECT n, concat(v, '.9-rc'), 2 FROM r WHERE k % 3 > 0""")
def parse_crates(spark, sf_dir):
    return plain(json_formats.crates(json_texts(rows(spark, sf_dir), crate(), "crates")), "flags")


@query(ORACLE_SQL["parse_crates"])
def parse_json_files(spark, sf_dir):
    """The crates again, from files: each brand is one file with one list, and many tasks read it. The files stay in the checkpoint folder."""
    of_file = Window.partitionBy("b")
    items = rows(spark, sf_dir).withColumns({"line": F.to_json(crate()), "first": F.min("k").over(of_file), "last": F.max("k").over(of_file)})
    left = F.when(F.col("k") == F.col("first"), '{"crates": [').otherwise(",")
    right = F.when(F.col("k") == F.col("last"), "]}").otherwise("")
    folder = run_folder(spark, "json")
    lines = items.select("b", "k", F.concat(left, "line", right).alias("line"))
    lines.repartition("b").sortWithinPartitions("b", "k").select("b", "line").write.partitionBy("b").text(folder)
    return plain(json_formats.crates(json_documents(spark, folder, "crates")), "flags")


@query(ROWS + "SELECT b AS effname, arg_max(v, size * 100 + k % 17) AS version FROM r GROUP BY b")
def parse_luarocks(spark, sf_dir):
    """All versions of a brand are one rock: the greatest one counts."""
    versions = rows(spark, sf_dir).select("b", F.concat("v", F.lit("-1")).alias("v")).distinct().groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("v", F.lit("x")))).alias("m"))
    docs = versions.select(F.to_json(F.struct(F.map_from_arrays(F.array("b"), F.array("m")).alias("repository"))).alias("value"))
    return plain(json_formats.luarocks(docs))


@query(ROWS + """SELECT n AS effname, v AS version, 0 AS flags, concat('0|http://', b, '.org/ 1|http://', b, '.org/x.tgz') AS links FROM r
UNION ALL SELECT n, 'HEAD', 128, concat('0|http://', b, '.org/ 2|http://', b, '.org/x.git') FROM r WHERE k % 2 = 0""")
def parse_homebrew(spark, sf_dir):
    site = F.concat(F.lit("http://"), "b", F.lit(".org/"))
    head = F.col("k") % 2 == 0
    urls = F.struct(F.struct(F.concat(site, F.lit("x.tgz")).alias("url"), F.lit("abc").alias("checksum")).alias("stable"), F.struct(F.when(head, F.concat(site, F.lit("x.git"))).alias("url"), F.when(head, F.lit("main")).alias("branch")).alias("head"))
    item = F.struct(F.concat("n", F.lit("@1")).alias("name"), site.alias("homepage"), F.struct(F.col("v").alias("stable"), F.when(head, F.lit("HEAD")).alias("head")).alias("versions"), urls.alias("urls"))
    return plain(json_formats.homebrew(json_texts(rows(spark, sf_dir), item)), "flags", "links")


@query(ROWS + """SELECT n AS effname, v AS version, 0 AS flags, concat('4|https://p/', n, ' 18|http://f/', n) AS links FROM r
UNION ALL SELECT n, concat(v, 'rc1'), 2, concat('4|https://p/', n) FROM r UNION ALL SELECT n, '0.1', 1048576, concat('4|https://p/', n) FROM r WHERE k % 4 = 0""")
def parse_pypi(spark, sf_dir):
    file = lambda yanked: F.array(F.struct(F.lit(yanked).alias("yanked"), F.concat(F.lit("http://f/"), "n").alias("url")))
    none = F.array().cast("array<struct<yanked:boolean,url:string>>")
    entry = lambda key, value: F.struct(key.alias("key"), value.cast("array<struct<yanked:boolean,url:string>>").alias("value"))
    versions = F.array(entry(F.col("v"), file(False)), entry(F.concat("v", F.lit("rc1")), none), entry(F.when(F.col("k") % 4 == 0, "0.1"), file(True)))
    releases = F.map_from_entries(F.filter(versions, lambda e: e["key"].isNotNull()))
    item = F.struct(F.struct(F.col("n").alias("name"), F.concat(F.lit("https://p/"), "n").alias("project_url")).alias("info"), releases.alias("releases"))
    return plain(json_formats.pypi(json_texts(rows(spark, sf_dir), item)), "flags", "links")


@query(ROWS + """SELECT n AS effname, v AS version, concat(c, '/', n) AS srcname, 0 AS flags, concat('1|http://', b, '.org/a.tgz 0|http://h.org/ 0|https://github.com/', b, '/', n) AS links FROM r
UNION ALL SELECT n, '9999', concat(c, '/', n), 128, concat('0|https://github.com/', b, '/', n) FROM r WHERE k % 3 = 0""")
def parse_gentoo(spark, sf_dir):
    """Three kinds of files of a tree join by category and name; an ebuild without its cache entry is left out."""
    r = rows(spark, sf_dir)
    name = lambda *parts: F.concat(*[F.lit(p[1:]) if p.startswith("'") else F.col(p) for p in parts])
    tree = written(r.withColumn("path", name("c", "'/", "n", "'/", "n", "'-", "v", "'-r2.ebuild")), "", "path")
    tree = tree.unionByName(written(r.withColumn("path", name("c", "'/", "n", "'/", "n", "'-7.7.ebuild")), "", "path"))
    tree = tree.unionByName(written(r.filter("k % 3 = 0").withColumn("path", name("c", "'/", "n", "'/", "n", "'-9999.ebuild")), "", "path"))
    tree = tree.unionByName(written(r.filter("k % 3 = 0").withColumn("path", name("'metadata/md5-cache/", "c", "'/", "n", "'-9999")), "DESCRIPTION=live\n", "path"))
    tree = tree.unionByName(written(r.withColumn("path", name("'metadata/md5-cache/", "c", "'/", "n", "'-", "v", "'-r2")), "DESCRIPTION=x\nHOMEPAGE=http://h.org/\nSRC_URI=http://{b}.org/a.tgz -> b.tgz doc? ( local.txt )\n", "path"))
    tree = tree.unionByName(written(r.withColumn("path", name("c", "'/", "n", "'/metadata.xml")), '<pkgmetadata><upstream><remote-id type="github">{b}/{n}</remote-id></upstream></pkgmetadata>', "path"))
    return plain(xml_formats.gentoo(tree), "srcname", "flags", "links")


@query(ROWS + f"SELECT k, {', '.join('CASE k % ' + str(len(MAPPINGS)) + ' ' + ' '.join(f'WHEN {i} THEN ' + (f'concat({chr(39)}{m[j]}{chr(39)}, n)' if m[j] else 'NULL') for i, m in enumerate(MAPPINGS)) + f' END AS {role}' for j, role in enumerate(ROLES))} FROM r")
def name_mappings(spark, sf_dir):
    """Each mapping of name kinds in turn."""
    kinds = F.array(*[F.array(*[F.lit(k) for k in sorted({x for x in m if x})]) for m in MAPPINGS])
    names = F.transform(F.element_at(kinds, (F.col("k") % len(MAPPINGS) + 1).cast("int")), lambda x: F.struct(x.alias("key"), F.concat(x, F.col("n")).alias("value")))
    return rows(spark, sf_dir).select("k", mapped_names(F.map_from_entries(names)).alias("m")).select("k", "m.*")


@query(ROWS + """SELECT CASE WHEN c = 'economy' THEN concat('renamed-', n) ELSE n END AS effname, v AS version, CASE WHEN b = 'brand9' THEN 4 ELSE 0 END AS flags,
CASE WHEN b = 'brand7' THEN '' WHEN b = 'brand5' THEN 'five@z.org' ELSE concat(b, '@y.z') END AS maintainers,
concat('5|https://p/', substr(n, 1, 1), '/', n, ' 0|http://', b, '.org/') AS links FROM r WHERE b <> 'brand3'""")
def load_path(spark, sf_dir):
    """Text to packages: parser, link templates, rules, maintainers, all in one narrow stage."""
    text = "Package: {n}\nBinary: {n}\nVersion: {v}-1\nMaintainer: M <{b}@y.z>\nSection: {c}\nHomepage: http://{b}.org/"
    raw = text_formats.debian_sources(written(rows(spark, sf_dir), text))
    repository = Repository("repo", "family", package_links=((5, 1, "https://p/{srcname|first_letter}/{srcname}"),), rulesets=("main",))
    rules = [
        {"category": "economy", "namepat": "(.*)-([0-9]+)", "setname": "renamed-$1-$2"},
        {"wwwpart": "//brand9.org", "ignore": True},
        {"wwwpat": "http://brand3.org/", "remove": True},
        {"ruleset": "other", "remove": True},
    ]
    packages_ = load(raw, repository, rules, hidden=["brand7@y.z"], replaced={"brand5@y.z": "five@z.org"})
    links = F.array_join(F.transform("links", lambda x: F.concat_ws("|", x["link_type"].cast("string"), x["url"], x["fragment"])), " ")
    return packages_.select("effname", "version", "flags", F.array_join("maintainers", ",").alias("maintainers"), links.alias("links"))


@query(ROWS + "SELECT k, concat(n, CASE WHEN k % 2 = 1 THEN '-3:' ELSE '-' END, v, '-', CAST(size AS VARCHAR), '.src') AS again, n AS name, CASE WHEN k % 2 = 1 THEN '3' END AS epoch, v AS version, CAST(size AS VARCHAR) AS release FROM r")
def nevra_round_trip(spark, sf_dir):
    text = F.concat("n", F.lit("-"), F.when(F.col("k") % 2 == 1, F.lit("3:")).otherwise(F.when(F.col("k") % 4 == 2, F.lit("0:")).otherwise("")), "v", F.lit("-"), F.col("size").cast("string"), F.lit(".src.rpm"))
    out = rows(spark, sf_dir).select("k", nevra(text).alias("x"))
    return out.select("k", nevra_text(F.col("x")).alias("again"), "x.name", F.nullif(F.col("x.epoch"), F.lit("0")).alias("epoch"), "x.version", "x.release")


@query(ROWS + r"""SELECT k, concat('cpe|2.3|a|', b, '|', replace(n, '-', '\:'), '|', v) AS parts FROM r""")
def cpe_parts(spark, sf_dir):
    text = F.concat(F.lit("cpe:2.3:a:"), "b", F.lit(":"), F.replace("n", F.lit("-"), F.lit("\\:")), F.lit(":"), "v")
    return rows(spark, sf_dir).select("k", F.array_join(normalize.split_cpe(text), "|").alias("parts"))


@query(ROWS + """SELECT k, concat('https://x/', substr(n, 1, 1), '/', n, '/', CAST(size + 1 AS VARCHAR)) AS plain, CASE WHEN k % 3 = 0 THEN concat('https://y/', b) END AS optional,
concat('https://z/', b, '/a ', 'https://z/', b, '/b') AS several FROM r""")
def link_templates(spark, sf_dir):
    extra = F.map_concat(F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("patch"), F.lit("a\nb"), F.lit("brand"), F.col("b")), F.when(F.col("k") % 3 == 0, F.create_map(F.lit("some"), F.col("b"))).otherwise(F.create_map().cast("map<string,string>")))
    r = rows(spark, sf_dir).select("k", F.col("n").alias("srcname"), F.lit("1-1").alias("rawversion"), extra.alias("extrafields"))
    join = lambda c: F.nullif(F.array_join(c, " "), F.lit(""))
    return r.select("k", join(compile_template("https://x/{srcname|first_letter}/{srcname}/{size|inc}")).alias("plain"), join(compile_template("https://y/{?some}")).alias("optional"), join(compile_template("https://z/{brand}/{patch}", ("patch",))).alias("several"))


_PIECES = ("0", "0.0", "2", "10", "0alpha1", "beta", "1patch2", "rc1", "0.0.0.0post", "1a", "1b")
_LONG = f"concat(repeat('1.', CAST(size % 25 AS INT)), CASE k % {len(_PIECES)} {' '.join(f'WHEN {i} THEN {chr(39)}{p}{chr(39)}' for i, p in enumerate(_PIECES))} END)"


@query(ROWS + f""", t AS (SELECT b, {_LONG} AS v FROM r),
w AS (SELECT b, v, regexp_extract_all(regexp_replace(v, '([0-9])([a-z])([^a-z0-9]|$)', '\\1~\\2\\3', 'g'), '~[a-z]|[0-9]+|[a-z]+') AS parts FROM t),
c AS (SELECT b, v, [CASE WHEN regexp_matches(x, '^0+$') THEN '2' WHEN regexp_matches(x, '^[0-9]') THEN concat('5', lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 3, '0'), ltrim(x, '0'))
WHEN x IN ('post', 'patch') THEN concat('3', x[1]) WHEN x[1] = '~' THEN concat('4', x[2]) ELSE concat('1', x[1]) END for x in parts] AS parts FROM w),
o AS (SELECT b, v, array_to_string(list_concat(parts, ['2' for i in range(64 - len(parts))]), ',') AS key FROM c)
SELECT b, arg_min(v, concat(key, '|', v)) AS least, arg_max(v, concat(key, '|', v)) AS greatest, count(DISTINCT key) AS n FROM o GROUP BY b""")
def version_order_long(spark, sf_dir):
    """Versions of up to thirty components with letters and patches."""
    last = F.element_at(F.array(*[F.lit(p) for p in _PIECES]), (F.col("k") % len(_PIECES) + 1).cast("int"))
    v = rows(spark, sf_dir).select("b", F.concat(F.repeat(F.lit("1."), (F.col("size") % 25).cast("int")), last).alias("v")).distinct().withColumn("key", version_key(F.col("v")))
    by = F.struct("key", "v")
    return v.groupBy("b").agg(F.min_by("v", by).alias("least"), F.max_by("v", by).alias("greatest"), F.count_distinct("key").alias("n"))


@query(ROWS + "SELECT concat(n, ' ', v, ' ', n, ',lib', n, ' -') AS line FROM r WHERE n >= 'l'")
def dump_lines(spark, sf_dir):
    """Chosen fields of a range of projects as lines of text."""
    text = "Package: {n}\nBinary: {n}, lib{n}\nVersion: {v}-2\nSection: {c}"
    packages_ = make_packages(text_formats.debian_sources(written(rows(spark, sf_dir), text)), Repository("repo", "family"))
    return dumped(packages_, ["effname", "version", "binnames", "maintainers"], " ", first="l")


def odd_records(spark, sf_dir) -> DataFrame:
    """Records of which some lack a version, some state names that belong to no mapping, and some have odd fields."""
    k = F.col("k")
    version = F.when(k % 5 == 0, F.lit("  ")).otherwise(F.col("v"))
    url = F.concat(F.when(k % 3 == 0, "gemini://").otherwise("https://"), "b", F.lit(".org/"))
    mail = F.when(k % 2 == 0, F.concat("b", F.lit("@y.z"))).otherwise(F.concat(F.lit("A "), "b", F.lit("@Y.z")))
    return raw(
        rows(spark, sf_dir), names={"name": F.col("n"), "other": F.when(k % 11 == 0, F.col("b"))}, version=version, links=[link("upstream_homepage", F.array(url))],
        maintainers=F.array(mail), summary=F.when(k % 13 == 0, F.lit("one\ntwo")).otherwise(F.lit("one")),
    )


ODD = ROWS.rstrip() + """, p AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'unknown set of names: name, other' WHEN k % 5 = 0 THEN 'no version' END AS reason,
CASE WHEN k % 5 = 0 THEN '  ' ELSE v END AS version FROM r)
"""
LINES = ODD.rstrip() + """, l AS (SELECT CASE WHEN k % 11 = 0 THEN concat(n, '/', b) ELSE n END || ' ' || version AS label, * FROM p),
m AS (SELECT label, 'error' AS severity, concat(label, ': record ', reason) AS message FROM l WHERE reason IS NOT NULL
UNION ALL SELECT label, 'error', concat(label, ': links "gemini://', b, '.org/" scheme not known') FROM l WHERE k % 3 = 0
UNION ALL SELECT label, 'warning', concat(label, ': maintainers "A ', b, '@Y.z" white space inside') FROM l WHERE k % 2 = 1
UNION ALL SELECT label, 'error', concat(label, ': summary "one', chr(10), 'two" more than one line') FROM l WHERE k % 13 = 0),
c AS (SELECT row_number() OVER (ORDER BY label, message, severity) AS lineno, * FROM m)
"""


@query(ODD + "SELECT n AS name, version, reason FROM p WHERE reason IS NOT NULL")
def load_rejected(spark, sf_dir):
    """Records that give no package, with the reason."""
    return load_log.rejected(odd_records(spark, sf_dir), REPO).select(F.element_at("names", "name").alias("name"), "version", "reason")


@query(LINES + "SELECT lineno, CASE WHEN lineno > 2500 THEN 'error' ELSE severity END AS severity, CASE WHEN lineno > 2500 THEN 'Log trimmed at 2500 lines' ELSE message END AS message FROM c WHERE lineno <= 2501")
def load_log_lines(spark, sf_dir):
    """The log of a load: what normalisers found odd or dropped, record by record, at most 2,500 lines."""
    return load_log.log_lines(odd_records(spark, sf_dir), REPO).select("lineno", "severity", "message")


@query(LINES + """SELECT (SELECT count(*) FROM p) AS n_records, (SELECT count(*) FROM p WHERE reason IS NULL) AS n_packages, (SELECT count(*) FROM p WHERE reason IS NOT NULL) AS n_rejected,
count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'error') AS n_errors FROM m""")
def run_log(spark, sf_dir):
    """The account of a load: the records that came in are the packages and the rejected ones that came out."""
    records = odd_records(spark, sf_dir)
    of = lambda severity: F.sum(F.size(F.filter("_notes", lambda x: x["severity"] == severity)))
    out = load_log.diagnosed(records).agg(F.count(F.lit(1)).alias("n_records"), F.count("_problem").alias("n_rejected"), of("warning").alias("n_warnings"), of("error").alias("n_errors"))
    made = make_packages(records, REPO, "skip").agg(F.count(F.lit(1)).alias("n_packages"))
    return out.withColumn("repo", F.lit(REPO.name)).join(made.withColumn("repo", F.lit(REPO.name)), "repo").drop("repo")
