"""Repository configuration, and the formats that are neither JSON nor XML."""

import pytest
from pyspark.sql import functions as F

from larder.schema import FLAG
from larder.sources import config, other_formats
from larder.sources.packages import Repository, make_packages
from test_sources import docs, links, shown, tree

CONFIG = [
    {"name": "one", "family": "f", "groups": ["prod"], "minpackages": 5, "sources": [{"name": ["main", "extra"], "subrepo": "{source}", "parser": {"class": "debian_sources", "allowed_vcs_urls": "https://git"}}], "packagelinks": [{"type": "PACKAGE_HOMEPAGE", "url": "https://x/{srcname}"}], "update_period": "2h"},
    {"name": "two", "family": "g", "shadow": True, "ruleset": "r", "sources": [{"parser": {"class": "repodata"}}]},
]


def test_configuration(spark, tmp_path):
    known = config.repositories(CONFIG)
    assert [s["subrepo"] for s in known[0].sources] == ["main", "extra"] and known[0].package_links == ((5, 1, "https://x/{srcname}"),)
    names = lambda *x: [r.name for r in config.selected(known, list(x) or None)]
    assert names() == ["one", "two"] and names("prod") == ["one"] and names("repodata", "prod") == ["one", "two"] and names("two") == ["two"]
    with pytest.raises(ValueError, match="no repository"):
        names("three")
    assert [config.seconds(x) for x in (None, 90, "90", "5m", "2h", "1d", "1w")] == [None, 90, 90, 300, 7200, 86400, 604800]
    wrong = config.problems([{"name": "A b", "family": "f", "sources": [{"parser": {"class": "nosuch"}}], "colour": 1, "update_period": "x"}, {"name": "A b", "packagelinks": [{"type": "no"}]}])
    assert len(wrong) == 9
    with pytest.raises(ValueError, match="twice"):
        config.repositories([CONFIG[0], CONFIG[0]])
    assert sorted(map(tuple, config.as_table(spark, known).select("repo", "shadow", "minimum").collect())) == [("one", False, 5), ("two", True, 0)]
    assert config.config_hash({"a": 1, "b": 2}) == config.config_hash({"b": 2, "a": 1}) != config.config_hash({"a": 2, "b": 2})
    (tmp_path / "Sources").write_text("Package: foo\nBinary: foo\nVersion: 1-1\n\nPackage: bar\nBinary: bar\nVersion: 2-1\nVcs-Browser: https://git/bar\n")
    out = make_packages(config.parsed(spark, known[0].sources[0], str(tmp_path / "Sources")), known[0]).orderBy("effname").collect()
    assert [(r["effname"], links(r["links"])) for r in out] == [("bar", [(7, "https://git/bar", None)]), ("foo", [])]


def test_yaml(spark):
    t = tree(spark, files={"recipes/foo/all/conandata.yml": 'sources:\n  "1.10":\n    url: "http://a/1"\n    sha256: x\n  "2.0":\n    - linux: {url: ["http://a/2", "http://b/2"], sha256: "http://no"}\npatches:\n  "2.0":\n    - patch_file: p/1.patch\n', "recipes/foo/config.yml": "x: 1"})
    out = make_packages(other_formats.conan(t), Repository("r", "f")).orderBy("version").collect()
    assert [(r["version"], [u for _, u, _ in links(r["links"])], r["extrafields"]) for r in out] == [("1.10", ["http://a/1"], {"folder": "all"}), ("2.0", ["http://a/2", "http://b/2"], {"folder": "all", "patch": "p/1.patch"})]
    files = {"manifests/a/Acme/Tool/1.20/Acme.Tool.yaml": "ManifestType: version\nPackageVersion: 1.20\n", "manifests/a/Acme/Tool/1.20/Acme.Tool.installer.yaml": "ManifestType: installer\nInstallers:\n- InstallerUrl: http://a/1\n", "manifests/a/Acme/Tool/1.20/Acme.Tool.locale.yaml": "ManifestType: defaultLocale\nPackageIdentifier: Acme.Tool\nPackageName: Acme Tool\nPackageVersion: 1.20\nTags: [x, y]\nDocumentations:\n- DocumentLabel: Wiki\n  DocumentUrl: http://w/\n"}
    r = make_packages(other_formats.winget(tree(spark, files=files)), Repository("r", "f")).first()
    assert (r["effname"], r["srcname"], r["visiblename"], r["version"], r["category"], links(r["links"])) == ("Tool", "a/Acme/Tool", "Acme Tool", "1.20", "x", [(1, "http://a/1", None), (23, "http://w/", None)])
    t = tree(spark, files={"x/foo/stone.yaml": "name: foo\nversion: 1.10\nlicense: [MIT, BSD]\nupstreams:\n- http://a/1: abc\n- git|http://g/x: def\n"})
    assert shown(other_formats.stone_yaml(t), "licenses") == [("foo", "1.10", ["MIT", "BSD"])]


def test_tables_and_lists(spark):
    rows = [("foo", "1.0", "src", "1", "0.3.rc1.fc9", "s", "http://a/", "G", "MIT", "X <x@y.z>", None), ("bar", "2", "src", "0", "0.5", "s", None, None, None, None, None), ("lib", "2", "x86_64", "0", "1", "s", None, None, None, None, "bar-2-1.src.rpm")]
    df = spark.createDataFrame(rows, other_formats.REPODATA_COLUMNS)
    assert shown(other_formats.repodata_sqlite(df), "rawversion", "flags") == [("bar", "2", "2-0.5", FLAG["ignore"]), ("foo", "1.0-rc1", "1:1.0-0.3.rc1.fc9", 0)]
    assert shown(other_formats.repodata_sqlite(df, src=False, binary=True), "binname") == [("bar", "2", "lib")]
    ports = spark.createDataFrame([("devel/foo,x", "foo-bar-x", "foo-bar-x-1.2p3v0", "A tool", "http://h/", "X <x@y.z>", "devel misc", "sub", ["-x", "y"])], "fullpkgpath string, stem string, fullpkgname string, comment string, homepage string, maintainer string, categories string, dist_subdir string, flavors array<string>")
    files = spark.createDataFrame([("devel/foo,x", 0, None, "foo-{dl/}1.2.tgz"), ("devel/foo,x", 1, "0", "b.tgz"), ("devel/foo,x", 2, "1", "c.tgz")], "fullpkgpath string, n int, sufx string, file string")
    sites = spark.createDataFrame([("devel/foo,x", None, "http://s/ http://t/"), ("devel/foo,x", "0", "http://u/")], "fullpkgpath string, n string, value string")
    r = make_packages(other_formats.openbsd_ports(ports, files, sites), Repository("r", "f")).first()
    assert (r["effname"], r["binname"], r["version"], r["maintainers"], r["category"]) == ("foo-bar", "foo-bar-x", "1.2", ["x@y.z"], "devel")
    assert [u for _, u, _ in links(r["links"])] == ["http://h/", "http://s/dl/1.2.tgz", "http://t/dl/1.2.tgz", "http://u/b.tgz", "http://ftp.openbsd.org/pub/OpenBSD/distfiles/sub/c.tgz"]
    text = '(1\n(foo-mode . [(1 2 0) ((emacs (24 1)) (dash (2))) "A \\"nice\\" mode" tar ((:url . "http://a/") (:maintainer "X Y" . "x@y.z") (:keywords "a"))])\n(bar . [(2 0) nil "Bar" single nil])\n)'
    assert shown(other_formats.elpa_archive(docs(spark, text)), "comment", "maintainers") == [("bar", "2.0", "Bar", ["nobody@example.com"]), ("foo-mode", "1.2.0", 'A "nice" mode', ["x@y.z"])]
    page = '<div id="mw-content-text"><div style="float:left; width:25.3em; height:8.5em"><p><b><a href="/wiki/Foo_Game" title="x">Foo Game</a></b></p><p>1.2 (2020) <a href="http://a/">Website</a></p></div></div>'
    assert shown(other_formats.game_wiki(docs(spark, page)), "srcname", "rawversion") == [("Foo Game", "1.2", "Foo_Game", "1.2 (2020)")]
    assert shown(other_formats.gem_specs(spark.createDataFrame([("a", "1", "ruby"), ("a", "1", "java")], "name string, version string, platform string"))) == [("a", "1")]
    assert make_packages(other_formats.gem_specs(spark.createDataFrame([], "name string, version string, platform string")), Repository("r", "f")).select(F.count("*")).first()[0] == 0
