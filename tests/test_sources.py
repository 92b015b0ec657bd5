"""Parsers and the load path on small texts written here."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larder.schema import FLAG
from larder.sources import json_formats, readers, text_formats, xml_formats
from larder.sources.packages import Repository, dumped, load, make_packages, raw

REPO = Repository("repo", "family", default_maintainer="nobody@example.com")


def shown(df, *columns, repo=REPO):
    rows = make_packages(df, repo).select("effname", "version", *columns).collect()
    return sorted((tuple(r) for r in rows), key=str)


def docs(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def tree(spark, **files):
    return spark.createDataFrame([(p, v if isinstance(v, str) else json.dumps(v)) for p, v in files["files"].items()], "path string, value string")


def links(r):
    return [(x["link_type"], x["url"], x["fragment"]) for x in r or []]


def test_debian(spark):
    text = "Package: foo\nBinary: foo, libfoo1\nVersion: 1:1.2~beta1+dfsg-3\nMaintainer: A B <a@x.org>\nUploaders: C <c@x.org>,\n D <d@x.org>\nSection: libs\nHomepage: http://FOO.org\nVcs-Git: https://salsa.debian.org/foo.git"
    df = text_formats.debian_sources(docs(spark, text), allowed_vcs_urls="https://salsa")
    r = make_packages(df, REPO).first()
    assert (r["srcname"], r["binname"], r["binnames"], r["version"], r["rawversion"]) == ("foo", None, ["foo", "libfoo1"], "1.2~beta1", "1:1.2~beta1+dfsg-3")
    assert r["maintainers"] == ["a@x.org", "c@x.org", "d@x.org"] and r["category"] == "libs" and r["flags"] & FLAG["devel"]
    assert links(r["links"]) == [(0, "http://foo.org/", None), (7, "https://salsa.debian.org/foo.git", None)]
    assert shown(text_formats.debian_packages(docs(spark, "Package: bar\nVersion: 2-1")), "binname", "maintainers") == [("bar", "2", "bar", ["nobody@example.com"])]
    text = "Package: py\nSource: feeds/packages/lang/python/py\nVersion: 3-1\nArchitecture: arm\nCPE-ID: cpe:/a:v:p\nURL: http://a.b/"
    assert shown(text_formats.openwrt(docs(spark, text)), "srcname", "binname", "arch", "cpe_vendor", "cpe_product", "flags", "extrafields") == [("py", "3", "feeds/packages/lang/python/py", "py", "arm", "v", "p", FLAG["untrusted"], {"path": "lang/python/py"})]


def test_blocks(spark):
    text = "%NAME%\nfoo-libs\n\n%BASE%\nfoo\n\n%VERSION%\n2:1.0+r3-4\n\n%DESC%\nA tool\n\n%LICENSE%\nMIT\nBSD\n\n%URL%\nhttps://foo.org\n"
    assert shown(text_formats.arch_desc(docs(spark, text)), "srcname", "binname", "licenses", "comment") == [("foo", "1.0", "foo", "foo-libs", ["MIT", "BSD"], "A tool")]
    text = "%NAME%\nbar\n\n%VERSION%\n1~2.5-1\n\n%PACKAGER%\nX <x@y.z>\n\n%GROUPS%\ng1\ng2\n"
    assert shown(text_formats.msys2_desc(docs(spark, text)), "srcname", "maintainers", "category") == [("bar", "2.5", "bar", ["x@y.z"], "g1")]


def test_lines(spark):
    line = "foo-bar-1.2_3,1|/usr/ports/devel/foo|/usr|A tool|/d|A@b.c|devel misc|||http://x.y/ http://z.w/|||"
    assert shown(text_formats.freebsd_index(docs(spark, line)), "srcname", "maintainers", "category") == [("foo-bar", "1.2", "devel/foo", ["a@b.c"], "devel")]
    line = "foo-1.5nb2|devel/foo|/usr|A tool|d|a@b.c|devel|||||http://x.y/"
    assert shown(text_formats.pkgsrc_index(docs(spark, line)), "srcname") == [("foo", "1.5", "devel/foo")]
    with pytest.raises(PySparkException, match="12 fields"):
        shown(text_formats.pkgsrc_index(docs(spark, "a-1|b")))
    assert shown(text_formats.depot_list(docs(spark, "foo-x-2.0|/p/q|z")), "extrafields") == [("foo-x", "2.0", {"path": "/p/q"})]
    stanza = "PACKAGE NAME:  foo-bar-1.0-x86_64-1.txz\nPACKAGE LOCATION:  ./slackware64/a\nPACKAGE SIZE: 1"
    assert shown(text_formats.slackware(docs(spark, stanza, "ChangeLog header")), "trackname", "arch", "binname") == [("foo-bar", "1.0", "./slackware64/a/foo-bar", "x86_64", "foo-bar")]
    stanza = "P:foo-dev\no:foo\nV:1.2-r10\nT:text\nU:http://a.b/\nL:MIT\nA:x86\nm:M <m@n.o>"
    assert shown(text_formats.apk_index(docs(spark, stanza)), "binname", "maintainers", "comment") == [("foo", "1.2", "foo-dev", ["m@n.o"], "text")]
    rows = ["File: x", "Foo::Bar 1.0 A/AB/ABC/Foo-Bar-v1.5.tar.gz", "Foo::Bar::Sub 1.0 A/AB/ABC/Foo-Bar-v1.5.tar.gz", "Bad undef A/AB/ABC/Bad.tar.gz"]
    assert shown(text_formats.cpan_packages(docs(spark, *rows)), "maintainers") == [("Foo-Bar", "1.5", ["abc@cpan"])]
    row = '<tr> <td> <a href="x"><span class="CRAN">abc</span></a> </td> <td> 1.2-3 </td> <td>'
    assert shown(text_formats.cran_summary(docs(spark, row, "<p>"))) == [("abc", "1.2-3")]
    assert shown(text_formats.stackage_html(docs(spark, '<a href="/package/text-icu-0.8.0">'))) == [("text-icu", "0.8.0")]
    assert shown(text_formats.rpm_listing(docs(spark, "-rw-r--r-- 1 a b 100 Jan 1 foo-1.0-1.src.rpm", "x foo-1.0-1.i586.rpm"))) == [("foo", "1.0")]
    assert shown(text_formats.amiga_index(docs(spark, "# head", "dev/misc|foo.lha|10|d|1.5|:A tool", "dev|bar.lha|1|d||:x")), "binname", "visiblename", "comment") == [("foo", "1.5", "dev/misc/foo.lha", "foo.lha", "A tool")]


def test_trees(spark):
    t = tree(spark, files={"games/foo/foo.info": 'PRGNAM="foo"\nVERSION="1.2"\nHOMEPAGE="http://a.b/"\nDOWNLOAD="http://a.b/1 \\\n http://a.b/2"\nDOWNLOAD_x86_64="UNSUPPORTED"\nEMAIL="x@y.z"\n'})
    r = make_packages(text_formats.slackbuilds_info(t), REPO).first()
    assert (r["srcname"], r["version"], r["maintainers"]) == ("games/foo", "1.2", ["x@y.z"]) and [u for _, u, _ in links(r["links"])] == ["http://a.b/", "http://a.b/1", "http://a.b/2"]
    t = tree(spark, files={"dev/foo-x/foo_x-1.2.recipe": 'HOMEPAGE="http://a.b/\n http://c.d/"'})
    assert shown(text_formats.haiku_recipes(t), "srcname") == [("foo-x", "1.2", "dev/foo-x")]
    assert shown(text_formats.kiss_versions(tree(spark, files={"core/foo/version": "1.2 3\n", "core/foo/sources": "# x\nhttp://a.b/1 dir\npatches/p\ngit+http://g/r", "core/foo/meta": "license: MIT,BSD\n", "core/bare/version": "1 1"})), "licenses", "subrepo") == [("foo", "1.2", ["MIT", "BSD"], "core")]
    t = tree(spark, files={"Foo/1.2/Recipe": "url=http://a.b/1", "Foo/1.10/Recipe": 'url="http://a.b/2"\nurl="$x/3"', "Foo/1.10/Resources/Description": "[Name] Foo\n[Summary] A\n tool\n[License] MIT\n", "Foo/1.9/Other": ""})
    assert shown(text_formats.gobolinux_recipes(t), "comment", "licenses") == [("Foo", "1.10", "A tool", ["MIT"])]
    t = tree(spark, files={"base/foo/foo.desc": "[I] A tool\n[ver] 1.5\n[U] http://a.b/\n[M] X Y <x@y.z>\n[L] MIT\n[C] extra/base\n[D] abc foo-1.5.tgz !http://a.b/dl/\n"})
    r = make_packages(text_formats.t2_descriptions(t), REPO).first()
    assert (r["effname"], r["version"], r["category"], links(r["links"])[1][1]) == ("foo", "1.5", "extra/base", "http://a.b/dl/foo-1.5.tgz")
    t = tree(spark, files={"foo/package-version.txt": "1.2.p3\n", "foo/checksums.ini": "tarball=x\nupstream_url=http://a.b/foo-VERSION.tgz\n", "foo/requirements.txt": "foo"})
    r = make_packages(text_formats.sagemath_versions(t), REPO).first()
    assert (r["effname"], r["version"], links(r["links"])[0][1]) == ("python:foo", "1.2", "http://a.b/foo-1.2.tgz")
    t = tree(spark, files={"foo.txt": "﻿[Section]\nName = Foo Tool\nVersion = 1.5\nURLSite = http://a.b/\n"})
    assert shown(text_formats.rapps_ini(t), "visiblename") == [("foo", "1.5", "Foo Tool")]
    t = tree(spark, files={"foo/1.2/foo.cabal": "synopsis: old\n", "foo/1.10/foo.cabal": "Synopsis:  New tool \nmaintainer: x@y.z\ncategory: A, B\n"})
    assert shown(text_formats.cabal_files(t), "comment", "category") == [("foo", "1.10", "New tool", "A, B")]
    t = tree(spark, files={"pkgs/foo/build.textproto": 'source: "http://a.b/1"\nversion: "1.2-7"\ncherry_pick: "p1"\n'})
    assert shown(text_formats.textproto_builds(t), "extrafields") == [("foo", "1.2", {"path": "pkgs/foo", "patch": "p1"})]
    t = tree(spark, files={"foo/foo.toml": '# Voyager: X <x@y.z>\nver = "1.2"\nurl = "http://a.b/1"\n', "bar/bar.toml": 'ver = "1"\n'})
    assert shown(text_formats.toml_packages(t, version="ver", only_urls=True), "maintainers") == [("foo", "1.2", ["x@y.z"])]


def test_json_lists(spark):
    j = json_formats
    assert shown(j.aur(docs(spark, [{"Name": "foo-git", "Version": "1:1.2+r3-1", "PackageBase": "foo", "Maintainer": "joe", "CoMaintainers": ["ann"]}])), "srcname", "maintainers") == [("foo", "1.2", "foo", ["joe@aur", "ann@aur"])]
    crates = {"crates": [dict(id=n, name=n, max_stable_version=s, max_version=m) for n, s, m in (("a", "1.0", "1.0"), ("b", None, "0.1-rc"), ("c", "1.0", "2.0-rc"))]}
    assert shown(j.crates(docs(spark, crates)), "flags") == [("a", "1.0", 0), ("b", "0.1-rc", 2), ("c", "1.0", 0), ("c", "2.0-rc", 2)]
    aosc = dict(category="app", section="x", directory="foo", name="foo", version="1:999", full_version="1:999-1", srctype="PyPI", srcurl="foo", tree="t", branch="b", pkg_section="utils")
    r = make_packages(j.aosc(docs(spark, {"packages": [aosc, aosc | {"category": "core", "section": "misc"}]})), REPO).collect()
    assert len(r) == 1 and (r[0]["srcname"], r[0]["flags"], r[0]["category"], links(r[0]["links"])) == ("app-x/foo", FLAG["ignore"], "utils", [(0, "https://pypi.org/project/foo/", None)])
    ports = [dict(name="foo-devel", portdir="devel/foo", version="1.0+x", license="MIT", maintainers=[{"email": {"name": "a", "domain": "macports.org"}, "github": "gh"}]), dict(name="old", portdir="a/b", version="1", license="x", maintainers=[], replaced_by="new"), dict(name="bar", portdir="a/bar", version="2", license="x", maintainers=[])]
    assert shown(j.macports(docs(spark, {"ports": ports})), "maintainers", "flags") == [("bar", "2", ["nomaintainer@macports.org"], 0), ("foo-devel", "1.0", ["a@macports", "gh@github"], FLAG["ignore"])]
    assert shown(j.opam(docs(spark, [{"name": "a", "versions": [{"version": "2"}, {"version": "1"}]}]))) == [("a", "1")]
    assert shown(j.luarocks(docs(spark, {"repository": {"a": {"1.2-1": [], "1.10-1": []}}}))) == [("a", "1.10")]
    cyg = dict(name="foo", summary="s", maintainers=["A. B"], versions={"stable": ["1-1", "2-1"], "test": ["3-0.1.rc1"]}, subpackages=[{"name": "libfoo", "categories": ["Libs"]}, {"name": "old", "categories": ["_obsolete"]}])
    assert shown(j.cygwin(docs(spark, {"packages": [cyg, dict(name="_x", versions={}, subpackages=[])]})), "binname", "flags", "maintainers") == [("foo", "2", "libfoo", 0, ["a.b@cygwin"]), ("foo", "3-rc1", "libfoo", 6, ["a.b@cygwin"])]
    brew = dict(name="foo@2", desc="d", homepage="http://a.b/", ruby_source_path="F/foo.rb", versions={"stable": "2.1", "head": "HEAD"}, urls={"stable": {"url": "http://a.b/x.tgz", "checksum": "1"}, "head": {"url": "http://a.b/x.git", "branch": "main"}})
    assert shown(j.homebrew(docs(spark, [brew])), "srcname", "flags") == [("foo", "2.1", "foo@2", 0), ("foo", "HEAD", "foo@2", FLAG["rolling"])]
    assert shown(j.homebrew_cask(docs(spark, [dict(token="t", name=["T x"], version="1.2,345", url="http://a.b/")])), "visiblename") == [("t", "1.2", "T x")]
    pkg = dict(info=dict(name="foo", project_url="http://p/", author_email="a@b.c, X <d@e.f>", project_urls={"Docs": "http://d/", "Source": "UNKNOWN"}), releases={"1.0": [{"yanked": False, "url": "http://f/1"}], "2.0rc1": [], "3.0": [{"yanked": True, "url": "x"}]})
    out = make_packages(j.pypi(docs(spark, [pkg])), REPO).orderBy("version").collect()
    assert [(r["version"], r["flags"]) for r in out] == [("1.0", 0), ("2.0rc1", FLAG["devel"]), ("3.0", FLAG["recalled"])]
    assert links(out[0]["links"]) == [(4, "http://p/", None), (16, "http://d/", None), (18, "http://f/1", None)] and out[0]["maintainers"] == ["a@b.c"]
    spack = {"packages": {"k": dict(name="foo", maintainers=["m"], homepages=[], patches=["a.patch x", "http://p"], version=[{"version": "1.2"}, {"version": "1.10"}, {"version": "main", "branch": "main", "repositories": {"url": "http://g/r"}}])}}
    assert shown(j.spack(docs(spark, spack)), "flags", "extrafields") == [("foo", "1.10", 0, {"patch": "a.patch"}), ("foo", "main", FLAG["rolling"], {"patch": "a.patch"})]
    wiki = dict(project="http://w/Q1", projectLabel="Foo", projects="foo␞bar", versions="1.0|S␞2.0|R|S␞3.0|U␞4|o", licenses="b␞a")
    assert shown(j.wikidata(docs(spark, [wiki])), "licenses") == [("bar", "2.0", ["a", "b"]), ("foo", "2.0", ["a", "b"])]
    assert shown(j.wikidata(docs(spark, [wiki | {"versions": "1.0|S␞3.0|U"}])), "flags") == [("bar", "1.0", 0), ("bar", "3.0", 2), ("foo", "1.0", 0), ("foo", "3.0", 2)]
    guix = [dict(name="a", version="1-2.abcdef1", synopsis="s", location="g/p.scm:12", source=[{"type": "git", "git_url": "http://g/", "git_ref": "abcdef1234567890abcdef1234567890abcdef12"}]), dict(name="b", version="2.0", location="g/p.scm:1", source=[{"type": "url", "urls": ["http://bad.host/x", "http://ok/x"]}])]
    assert shown(j.guix(docs(spark, guix), ("bad.host",)), "flags") == [("a", "1-2.abcdef1", FLAG["ignore"]), ("b", "2.0", 0)]
    hits = lambda *xs: {"hits": {"hits": [{"_source": x} for x in xs]}}
    rel = lambda d, v, s, m: dict(distribution=d, version=v, status=s, maturity=m, author="ABC")
    assert shown(j.metacpan(docs(spark, hits(rel("F", "v1.5", "latest", "released"), rel("F", "1.10", "cpan", "developer")), hits(rel("F", "1.2", "cpan", "developer")))), "flags") == [("F", "1.10", 2), ("F", "1.5", 0)]
    nix = {"packages": {"py.foo": {"name": "foo-1.2", "pname": "foo", "version": "1.2", "meta": {"license": [{"spdxId": "MIT"}, "x"], "maintainers": [{"email": "A@b.c", "github": "g"}, {"github": "H"}], "platforms": ["x86_64-linux"]}}, "bar": {"name": "bar", "version": "1", "meta": {}}, "baz": {"name": "x86-64bit", "pname": "x86", "version": "64bit", "meta": {}}, "odd": {"name": "odd-1x-2", "pname": "odd", "version": "1x-2", "meta": {"broken": True}}}}
    assert shown(j.nix(docs(spark, nix)), "srcname", "licenses", "category", "maintainers", "flags") == [("foo", "1.2", "py.foo", ["MIT", "x"], "py", ["a@b.c", "h@github"], 0), ("odd", "1x-2", "odd", None, None, ["nobody@example.com"], FLAG["untrusted"])]
    r = make_packages(j.nix(docs(spark, nix), branch="24.05"), REPO).filter("effname = 'foo'").first()
    assert links(r["links"]) == [(27, "https://hydra.nixos.org/job/nixos/release-24.05/nixpkgs.py.foo.x86_64-linux", None)]
    sis = dict(name="foo", epoch="0", version="1.0", release="alt1", binaries=[{"name": "b"}, {"name": "a"}], packager="X@y.z", url="http://u/")
    assert shown(j.sisyphus(docs(spark, {"packages": [sis]})), "rawversion", "binnames") == [("foo", "1.0", "1.0-alt1", ["a", "b"])]
    termux = dict(name="foo", version="1:2.0", description="d", maintainer="X @GitUser", homepage="http://h/", package_patch_urls=["http://p/1"], package_patch_raw_urls=["http://r/1"])
    r = make_packages(j.termux(docs(spark, [termux])), REPO).first()
    assert (r["version"], r["maintainers"], [k for k, *_ in links(r["links"])]) == ("2.0", ["gituser@github"], [0, 11, 12])
    oi = {"openindiana.org": {"pkg:/foo": [{"version": "1", "actions": ["set name=com.oracle.info.name value=foo value=bar", 'set name=pkg.summary value="A tool"', "set name=com.oracle.info.version value=1.2", "set name=info.classification value=org.x:Apps/Y"]}], "x": [{"version": "1", "actions": []}]}, "_SIGNATURE": {"a": "b"}}
    assert shown(j.openindiana(docs(spark, oi)), "binname", "comment", "category") == [("foo", "1.2", "pkg:/foo", "A tool", "Apps/Y")]
    for f, item, at in ((j.chromebrew, dict(name="a", version="1"), None), (j.crux, dict(name="a", version="1", maintainer=""), "ports"), (j.ptxdist, dict(name="a", version="1", upstream_urls="http://a/ http://b/"), None), (j.ravenports, dict(namebase="a", version="1", variants=[{"sdesc": "s", "label": "std"}], bucket="b", cpe={"vendor": "v"}), "ravenports"), (j.salix, dict(name="a", ver="1"), "packages"), (j.yacp, dict(name="a", version="1", subpackages=[{"name": "b"}]), "packages"), (j.stalix, dict(pkg_name="a", ix_pkg_name="x", ix_pkg_full_name="y", pkg_ver="1", lang_module=None), None), (j.pacstall, dict(name="a", version="2:1-3", source=[{"value": "http://x/y.git"}]), None), (j.exherbo, dict(name="a", category="c", version="1-r2"), None)):
        assert shown(f(docs(spark, {at: [item]} if at else [item]))) == [("a", "1")], f.__name__
    assert shown(j.mports(docs(spark, {"packages": {"a": dict(port="c/a", version="1_2,3")}}))) == [("a", "1")]
    assert shown(j.openvsx(docs(spark, {"extensions": [dict(namespace="n", name="x", version="1", files={"download": "http://a/b/c.vsix"}), dict(namespace="n", name="y", version="1")]})), "visiblename") == [("n.x", "1", "x")]


def test_json_trees(spark):
    t = tree(spark, files={"bucket/foo.json": dict(version="1.0", homepage="http://a.b/", url=["http://a.b/1"], architecture={"64bit": {"url": "http://a.b/2"}}, license={"identifier": "MIT"}), ".vscode/x.json": {"version": "1"}})
    r = make_packages(json_formats.scoop(t), REPO).collect()
    assert len(r) == 1 and r[0]["licenses"] == ["MIT"] and [u for _, u, _ in links(r[0]["links"])] == ["http://a.b/", "http://a.b/1", "http://a.b/2"]
    t = tree(spark, files={"bucket/foo.json": dict(version="1.0", description="d", homepage="http://baulk.x/", architecture={"64bit": {"url": "http://a.b/2"}}), "x.json": {}})
    assert shown(json_formats.baulk(t), "flags") == [("foo", "1.0", FLAG["untrusted"])]
    t = tree(spark, files={"ports/foo/vcpkg.json": {"name": "foo", "version-string": "1.2-abcdef0", "description": ["d", "e"], "maintainers": ["X <x@y.z>"]}, "ports/foo/b.patch": "", "ports/foo/a.patch": "", "ports/bar/vcpkg.json": {"name": "bar", "version-date": "2020-01-02"}})
    assert shown(json_formats.vcpkg(t), "flags", "comment", "maintainers", "extrafields") == [("bar", "2020-01-02", FLAG["untrusted"], None, ["nobody@example.com"], None), ("foo", "1.2", 0, "d", ["x@y.z"], {"patch": "a.patch\nb.patch"})]


def test_xml(spark, tmp_path):
    x = xml_formats
    head = '<metadata xmlns="http://linux.duke.edu/metadata/common" xmlns:rpm="http://linux.duke.edu/metadata/rpm">'
    rpm = '<package type="rpm"><name>{n}</name><arch>{a}</arch><version epoch="1" ver="1.2" rel="0.beta1.3"/><summary>s</summary><packager>X &lt;x@y.z&gt;</packager><url>http://a.b/</url><format><rpm:license>MIT</rpm:license><rpm:group>G</rpm:group><rpm:sourcerpm>src-foo-1.2-3.src.rpm</rpm:sourcerpm><rpm:provides><rpm:entry name="p1" flags="EQ" epoch="0" ver="1" rel="2"/><rpm:entry name="q(x)" ver="1" rel="1"/><rpm:entry name="r"/></rpm:provides></format></package>'
    file = tmp_path / "primary.xml"
    file.write_text(head + rpm.format(n="foo", a="src") + rpm.format(n="foo-libs", a="x86_64") + rpm.format(n="%{n}", a="src") + "</metadata>")
    items = readers.xml_rows(spark, str(file), "package", x.REPODATA)
    items = items.select(F.struct(*items.columns).alias("item"))
    assert shown(x.repodata(items), "rawversion", "binnames", "maintainers", "flags") == [("foo", "1.2-beta1", "1:1.2-0.beta1.3", ["p1"], ["x@y.z"], FLAG["devel"])]
    assert shown(x.repodata(items, src=False, binary=True, binnames_from_provides=False), "srcname", "binname") == [("src-foo", "1.2-beta1", "src-foo", "foo-libs")]
    one = lambda text, schema, **c: readers.xml_items(docs(spark, text), schema)
    text = "<Package><Name>a-libs</Name><Summary>s</Summary><License>MIT\nBSD</License><PartOf>x</PartOf><History><Update><Version>2</Version></Update><Update><Version>1</Version></Update></History><Source><Name>a</Name><Packager><Email>m@n.o</Email></Packager></Source></Package>"
    assert shown(x.solus(one(text, x.SOLUS)), "binname", "licenses", "maintainers") == [("a", "2", "a-libs", ["MIT", "BSD"], ["m@n.o"])]
    text = "<PISI><Source><Name>a</Name><Summary>s</Summary><Archive>http://a.b/1</Archive></Source><History><Update release='2'><Version>1.9</Version></Update><Update release='10'><Version>1.10</Version></Update></History></PISI>"
    items = readers.xml_items(spark.createDataFrame([(text, "x/a/pspec.xml")], "value string, path string"), x.PISI)
    assert shown(x.pisi(items), "srcname") == [("a", "1.10", "x/a")]
    text = "<application><id>org.a</id><name>A</name><categories>x,y</categories><marketvercode>5</marketvercode><package><version>2</version><versioncode>6</versioncode></package><package><version>1</version><versioncode>5</versioncode></package></application>"
    assert shown(x.fdroid(one(text, x.FDROID)), "flags", "srcname") == [("A", "1", 0, "org.a"), ("A", "2", 2, "org.a")]
    text = '<Description><Name>a</Name><Version>1.20</Version><Release>20</Release><Source><bag><li>http://a.b/x</li><li>http://openpkg.org/y</li></bag></Source></Description>'
    assert shown(x.openpkg(one(text, x.OPENPKG)), "flags") == [("a", "1.20", FLAG["untrusted"])]
    text = "<entry><title>a</title><summary>s</summary><properties><Version>1</Version><Title></Title><ProjectUrl>http://a.b/</ProjectUrl></properties></entry>"
    assert shown(x.chocolatey(one(text, x.CHOCOLATEY)), "visiblename") == [("a", "1", "a")]
    text = '<root><license name="l1"><title>MIT</title></license><package name="org.a"><title>A</title><license>l1</license><category>stable</category><category>T</category></package><version package="org.a" name="1.2"><url>http://a.b/1</url></version></root>'
    assert shown(x.npackd(one(text, x.NPACKD)), "licenses", "category", "visiblename") == [("a", "1.2", ["MIT"], "T", "A")]
    text = "<plist><dict><key>foo-libs</key><dict><key>pkgver</key><string>foo-libs-1.2_3</string><key>source-revisions</key><string>foo:abc</string><key>maintainer</key><string>X &lt;x@y.z&gt;</string><key>license</key><string>MIT,BSD</string></dict><key>bar</key><dict><key>pkgver</key><string>bar-1</string></dict></dict></plist>"
    assert shown(x.void_plist(docs(spark, text)), "binname", "maintainers", "licenses") == [("foo", "1.2", "foo-libs", ["x@y.z"], ["MIT", "BSD"])]


def test_gentoo(spark):
    t = tree(spark, files={
        "dev/foo/foo-1.2-r3.ebuild": "", "dev/foo/foo-9999.ebuild": "", "dev/foo/foo-2.ebuild": "",
        "dev/foo/metadata.xml": '<pkgmetadata><maintainer type="person"><email>x@y.z</email></maintainer><upstream><remote-id type="github">a/b</remote-id><remote-id type="cpe">cpe:/a:v:p</remote-id></upstream></pkgmetadata>',
        "metadata/md5-cache/dev/foo-1.2-r3": "DESCRIPTION=A tool\nHOMEPAGE=http://h/ http://i/\nLICENSE=MIT BSD\nSRC_URI=http://d/1 -> x.tgz doc? ( http://d/2 ) local.patch\n",
        "metadata/md5-cache/dev/foo-9999": "DESCRIPTION=live\n",
    })
    out = make_packages(xml_formats.gentoo(t), REPO).orderBy("version").collect()
    assert [(r["effname"], r["srcname"], r["version"], r["flags"]) for r in out] == [("foo", "dev/foo", "1.2", 0), ("foo", "dev/foo", "9999", FLAG["rolling"])]
    assert links(out[0]["links"]) == [(1, "http://d/1", None), (1, "http://d/2", None), (0, "http://h/", None), (0, "http://i/", None), (0, "https://github.com/a/b", None)]
    assert (out[0]["maintainers"], out[0]["licenses"], out[0]["cpe_vendor"], out[0]["cpe_product"]) == (["x@y.z"], ["MIT", "BSD"], "v", "p")


def test_failures_and_defaults(spark):
    df = spark.createDataFrame([("a", "1"), ("b", None), (None, "2")], "n string, v string")
    rows = raw(df, names={"src": F.col("n")}, version=F.col("v"))
    assert [tuple(r) for r in make_packages(rows, REPO, "skip").select("effname", "rawversion", "maintainers", "licenses").collect()] == [("a", "1", ["nobody@example.com"], None)]
    with pytest.raises(PySparkException, match="no version|unknown set"):
        make_packages(rows, REPO).collect()
    assert make_packages(rows.limit(0), REPO).count() == 0


def test_load_and_dump(spark, tmp_path):
    repo = Repository("repo", "fam", package_links=((5, 1, "https://p/{srcname}"),), rulesets=("x",))
    df = raw(spark.createDataFrame([("Foo", "1"), ("bar", "2"), ("gone", "3")], "n string, v string"), names={"src": F.col("n")}, version=F.col("v"), maintainers=F.array(F.lit("A@b.c"), F.lit("hide@me")))
    rules = [{"name": "Foo", "setname": "foo"}, {"name": "gone", "remove": True}, {"ruleset": "y", "name": "bar", "setname": "no"}]
    out = load(df, repo, rules, hidden=["hide@me"], replaced={"a@b.c": "z@b.c"})
    assert sorted((r["effname"], r["maintainers"], links(r["links"])) for r in out.collect()) == [("bar", ["z@b.c"], [(5, "https://p/bar", None)]), ("foo", ["z@b.c"], [(5, "https://p/Foo", None)])]
    assert sorted(r["line"] for r in dumped(out, ["effname", "version", "maintainers", "comment"], "|", first="c").collect()) == ["foo|1|z@b.c|-"]
    from larder.sources.packages import sorted_runs

    sorted_runs(out, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_readers(spark, tmp_path):
    import sqlite3

    (tmp_path / "t/a b").mkdir(parents=True)
    (tmp_path / "t/a b/x.desc").write_text("one\ntwo")
    (tmp_path / "t/a b/y.txt").write_text("no")
    assert [tuple(r) for r in readers.files(spark, str(tmp_path / "t"), "*.desc").collect()] == [("a b/x.desc", "one\ntwo")]
    (tmp_path / "s").write_text("A: 1\nB: 2\n\nA: 3\n")
    assert sorted(r["a"] for r in readers.stanzas(spark, str(tmp_path / "s")).select(readers.field(F.col("value"), "A").alias("a")).collect()) == ["1", "3"]
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table p (n text, v int)")
        db.executemany("insert into p values (?, ?)", [("a", 1), ("b", 2)])
    assert sorted(tuple(r) for r in readers.sqlite_rows(spark, str(tmp_path / "d.db"), "select n, v from p", "n string, v long").collect()) == [("a", 1), ("b", 2)]
    listing = spark.createDataFrame([("x/patches/b.patch",), ("x/patches/a.patch",), ("x/other",)], "path string")
    assert [tuple(r) for r in readers.patches(listing).collect()] == [("x", "a.patch\nb.patch")]
    with pytest.raises(PySparkException, match="missing name"):
        spark.createDataFrame([("",)], "n string").select(readers.required(F.col("n"), "name")).collect()
