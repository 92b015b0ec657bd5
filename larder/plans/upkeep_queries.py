"""Queries of what a run keeps up: totals, histories, repository states, hashes, queues, reports, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import changes, rules
from larder.plans import aggregates, history, links, upkeep
from larder.plans.landscape import new_packages, old_packages, packages, snapshots, table, with_sql
from larder.plans.load_queries import ROWS, rows
from larder.plans.registry import query

RUN_TS = "TIMESTAMP '2001-01-01 00:00:00'"
_STORED_REPOS = """s AS (SELECT repo, count(*) + CASE WHEN repo < 'f' THEN 5 ELSE 0 END AS num_packages, count(DISTINCT effname) - CASE WHEN repo > 's' THEN 2 ELSE 0 END AS num_projects FROM pkg GROUP BY repo),
a AS (SELECT repo, count(*) AS num_packages, count(DISTINCT effname) AS num_projects FROM pkg WHERE repo <> 'france' GROUP BY repo)"""


def text(c: Column) -> Column:
    return c.cast("string")


@query(
    with_sql(
        f"""WITH {_STORED_REPOS}, j AS (SELECT coalesce(s.repo, a.repo) AS repo, coalesce(s.num_packages, 0) AS sp, coalesce(a.num_packages, 0) AS ap, coalesce(s.num_projects, 0) AS sj, coalesce(a.num_projects, 0) AS aj FROM s FULL OUTER JOIN a ON s.repo = a.repo)
SELECT repo, 'num_packages' AS counter, sp AS stored, ap AS actual FROM j WHERE sp <> ap UNION ALL SELECT repo, 'num_projects', sj, aj FROM j WHERE sj <> aj"""
    )
)
def totals_repositories(spark, sf_dir):
    """Stored totals with some errors against those recomputed from scratch."""
    p = packages(spark, sf_dir)
    count = lambda df: df.groupBy("repo").agg(F.count(F.lit(1)).alias("num_packages"), F.count_distinct("effname").alias("num_projects"))
    wrong = count(p).select("repo", (F.col("num_packages") + F.when(F.col("repo") < "f", 5).otherwise(0)).alias("num_packages"), (F.col("num_projects") - F.when(F.col("repo") > "s", 2).otherwise(0)).alias("num_projects"))
    return upkeep.totals_differences(wrong, count(p.filter("repo <> 'france'")), ["repo"])


@query(with_sql("SELECT maintainer, count(*) AS num_packages, 'kept' AS note FROM pkg GROUP BY maintainer"))
def totals_maintainers_fixed(spark, sf_dir):
    p = packages(spark, sf_dir)
    stored = p.select("maintainer").distinct().select("maintainer", F.lit(1).cast("long").alias("num_packages"), F.lit("kept").alias("note"))
    return upkeep.totals_fixed(stored, p.groupBy("maintainer").agg(F.count(F.lit(1)).alias("num_packages")), ["maintainer"])


@query(with_sql("SELECT count(*) AS stored, (SELECT count(*) FROM new_pkg) AS actual, 'num_packages' AS counter FROM old_pkg", old=True, new=True))
def totals_statistics(spark, sf_dir):
    count = lambda df: df.agg(F.count(F.lit(1)).alias("num_packages"))
    return upkeep.totals_differences(count(old_packages(spark, sf_dir)), count(new_packages(spark, sf_dir)), [])


@query("SELECT url, 'refcount' AS counter, CAST(0 AS BIGINT) AS stored, count(*) AS actual FROM pages WHERE page_id % 2 = 1 GROUP BY url HAVING count(*) > 0")
def totals_links(spark, sf_dir):
    """The table of links lacks those of every other page."""
    pages = table(spark, sf_dir, "pages")
    count = lambda df: df.groupBy("url").agg(F.count(F.lit(1)).alias("refcount"))
    odd = pages.filter("page_id % 2 = 1").select("url").distinct()
    return upkeep.totals_differences(count(pages).join(odd, "url", "left_anti"), count(pages.filter("page_id % 2 = 1").unionByName(pages.join(odd, "url", "left_anti"))), ["url"])


@query(with_sql("SELECT repo, CAST(TIMESTAMP '2001-01-01 00:00:00' AS VARCHAR) AS ts, count(*) AS num_packages, count(DISTINCT effname) AS num_projects FROM pkg WHERE NOT shadow GROUP BY repo"))
def repository_history(spark, sf_dir):
    counted = packages(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("num_packages"), F.count_distinct("effname").alias("num_projects"), F.when(F.bool_or("shadow"), "legacy").otherwise("active").alias("state"))
    out = upkeep.repository_history(counted, F.expr(RUN_TS))
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


_LINKS = """l AS (SELECT page_id % 4 AS refcount, page_id % 3 = 0 AS priority, page_id % 5 AS d, CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN -3 WHEN 3 THEN -50 END AS v4, CASE page_id % 7 WHEN 0 THEN 200 WHEN 1 THEN -1 WHEN 2 THEN 500 END AS v6 FROM pages)"""
_CHECKABLE = "(coalesce(v4, 0) NOT BETWEEN -6 AND 0 OR coalesce(v6, 0) NOT BETWEEN -6 AND 0)"
_ALIVE = "(coalesce(v4, 0) = 200 OR coalesce(v6, 0) = 200)"


@query(
    with_sql(
        f"""WITH {_LINKS} SELECT (SELECT count(*) FROM pkg) AS num_packages, (SELECT count(*) FROM (SELECT effname FROM pkg GROUP BY effname HAVING count(*) FILTER (WHERE NOT shadow) > 0)) AS num_projects, (SELECT count(DISTINCT maintainer) FROM pkg) AS num_maintainers,
(SELECT count(*) FROM pkg WHERE flags > 0) AS num_problems, (SELECT count(*) FROM customer) AS num_reports_total, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS num_reports_open,
count(*) FILTER (WHERE refcount > 0) AS num_links_total, count(*) FILTER (WHERE refcount > 0 AND d > 2) AS num_links_overdue, count(*) FILTER (WHERE refcount > 0 AND {_CHECKABLE}) AS num_links_checkable, count(*) FILTER (WHERE refcount > 0 AND {_ALIVE}) AS num_links_alive, count(*) FILTER (WHERE refcount > 0 AND v6 = 200) AS num_links_alive_ipv6,
count(*) FILTER (WHERE refcount > 0 AND priority AND {_CHECKABLE}) AS num_links_extracted_checkable, count(*) FILTER (WHERE refcount > 0 AND priority AND {_ALIVE}) AS num_links_extracted_alive, count(*) FILTER (WHERE refcount > 0 AND priority AND v6 = 200) AS num_links_extracted_alive_ipv6 FROM l"""
    )
)
def statistics_all_counters(spark, sf_dir):
    """All thirteen global totals, and packages."""
    p, pid = packages(spark, sf_dir), F.col("page_id")
    checked = table(spark, sf_dir, "pages").select(
        (pid % 4).alias("refcount"),
        (pid % 3 == 0).alias("priority"),
        (F.expr(RUN_TS) + F.make_dt_interval(days=(F.lit(2) - pid % 5).cast("int"))).alias("next_check"),
        F.when(pid % 6 == 0, 200).when(pid % 6 == 1, 404).when(pid % 6 == 2, -3).when(pid % 6 == 3, -50).alias("ipv4_status_code"),
        F.when(pid % 7 == 0, 200).when(pid % 7 == 1, -1).when(pid % 7 == 2, 500).alias("ipv6_status_code"),
    )
    projects = p.groupBy("effname").agg(F.count_if(~F.col("shadow")).alias("num_repos_nonshadow"))
    maintainers = p.groupBy("maintainer").agg(F.count(F.lit(1)).alias("num_packages"))
    reports = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 != 0, True).alias("accepted"))
    return upkeep.global_counters(p, projects, maintainers, p.filter("flags > 0"), reports, checked, F.expr(RUN_TS))


@query(with_sql("SELECT (SELECT count(*) FROM new_pkg) - (SELECT count(*) FROM old_pkg) AS delta", old=True, new=True))
def package_count_delta(spark, sf_dir):
    return upkeep.package_count_delta(old_packages(spark, sf_dir), new_packages(spark, sf_dir))


@query(
    """WITH o AS (SELECT n_nationkey * 2 + 1 AS id, lower(n_name) AS repo, CASE WHEN n_nationkey % 3 = 0 THEN 'legacy' ELSE 'active' END AS state FROM nation WHERE n_nationkey < 20),
c AS (SELECT lower(n_name) AS repo FROM nation WHERE n_nationkey % 4 <> 0),
f AS (SELECT repo, row_number() OVER (ORDER BY repo) AS k FROM c WHERE repo NOT IN (SELECT repo FROM o))
SELECT o.id, o.repo, CASE WHEN c.repo IS NULL THEN 'legacy' WHEN o.state = 'legacy' THEN 'readded' ELSE o.state END AS state, c.repo IS NOT NULL AS seen FROM o LEFT JOIN c ON o.repo = c.repo
UNION ALL SELECT k * 2, repo, 'new', TRUE FROM f"""
)
def repository_states(spark, sf_dir):
    nation, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    before = F.expr("TIMESTAMP '2000-01-01 00:00:00'")
    stored = nation.filter("n_nationkey < 20").select((key * 2 + 1).cast("long").alias("id"), F.lower("n_name").alias("repo"), F.when(key % 3 == 0, "legacy").otherwise("active").alias("state"), before.alias("first_seen"), before.alias("last_seen"))
    out = upkeep.repository_states(stored, nation.filter("n_nationkey % 4 <> 0").select(F.lower("n_name").alias("repo")), F.expr(RUN_TS))
    return out.select("id", "repo", "state", (F.col("last_seen") == F.expr(RUN_TS)).alias("seen"))


@query("SELECT lower(n_name) AS repo, n_nationkey % 3 > 0 AS fetch, n_nationkey % 2 = 0 OR n_nationkey % 5 = 0 AS parse FROM nation")
def repository_due(spark, sf_dir):
    k, now = F.col("n_nationkey"), F.expr(RUN_TS)
    ago = lambda hours: now - F.make_dt_interval(hours=hours.cast("int"))
    state = table(spark, sf_dir, "nation").select(
        F.lower("n_name").alias("repo"),
        F.when(k % 3 < 2, ago(F.when(k % 3 == 0, 1).otherwise(9))).alias("last_fetched"),
        F.when(k % 2 == 1, ago(F.lit(0))).alias("last_parsed"),
        F.lit(6 * 3600).alias("period_seconds"),
        F.when(k % 5 == 0, "old").otherwise("now").alias("rules_hash"),
    )
    return upkeep.due(state, now, "now")


_KEYS = ["effname", "repo", "trackname", "version", "maintainer", "flags", "ts"]


def _hashes(df: DataFrame) -> DataFrame:
    rows_ = changes.exact_dedupe(df.select(*_KEYS))
    return upkeep.checked_hashes(rows_.select("effname", changes.package_hash(rows_).alias("h")))


@query(with_sql("SELECT DISTINCT effname, TRUE AS current FROM new_pkg", old=True, new=True))
def hash_store(spark, sf_dir):
    """After a run the store holds exactly the hashes of the new snapshot; some projects were queued for a refresh."""
    a, b = _hashes(old_packages(spark, sf_dir)), _hashes(new_packages(spark, sf_dir))
    stored = changes.forced(a, a.filter("effname like 'p1%'"))
    after = upkeep.stored_hashes(stored, b, changes.changes(stored, b))
    return after.join(b.select("effname", F.col("hash").alias("now")), "effname", "left").select("effname", (F.col("hash") == F.col("now")).alias("current"))


@query(
    with_sql(
        """WITH o AS (SELECT DISTINCT effname, repo, trackname, version, maintainer, flags, ts FROM old_pkg), n AS (SELECT DISTINCT effname, repo, trackname, version, maintainer, flags, ts FROM new_pkg),
oh AS (SELECT effname, string_agg(concat_ws('|', repo, trackname, version, maintainer, flags, ts), '#' ORDER BY repo, trackname, version, maintainer, flags, ts) AS h FROM o GROUP BY effname),
nh AS (SELECT effname, string_agg(concat_ws('|', repo, trackname, version, maintainer, flags, ts), '#' ORDER BY repo, trackname, version, maintainer, flags, ts) AS h FROM n GROUP BY effname)
SELECT count(*) AS projects, TRUE AS whole, TRUE AS even FROM oh FULL OUTER JOIN nh ON oh.effname = nh.effname WHERE oh.h IS DISTINCT FROM nh.h""",
        old=True,
        new=True,
    )
)
def changed_queue(spark, sf_dir):
    """Changed projects in batches: each in one, none much larger than asked for."""
    kinds = changes.changes(_hashes(old_packages(spark, sf_dir)), _hashes(new_packages(spark, sf_dir)))
    sizes = upkeep.changed_queue(kinds, 50).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("effname").alias("d"))
    return sizes.agg(F.sum("n").alias("projects"), F.bool_and(F.col("n") == F.col("d")).alias("whole"), (F.max("n") <= 100).alias("even"))


@query(with_sql("SELECT repo, concat_ws(',', 'category', CASE WHEN max(flags) > 0 THEN 'flags' END, CASE WHEN bool_or(shadow) THEN 'shadow' END) AS fields, '0,5' AS link_types FROM pkg GROUP BY repo"))
def used_fields(spark, sf_dir):
    link = lambda k: F.struct(F.lit(k).alias("link_type"))
    p = packages(spark, sf_dir).withColumns({"comment": F.lit(""), "arch": F.lit(None).cast("string"), "licenses": F.array().cast("array<string>"), "links": F.when(F.col("pk") % 2 == 0, F.array(link(0), link(5))).otherwise(F.array(link(0)))})
    out = upkeep.used_fields(p, ["comment", "arch", "licenses", "category", "flags", "shadow"])
    return out.select("repo", F.array_join("fields", ",").alias("fields"), F.array_join("link_types", ",").alias("link_types"))


@query(with_sql("SELECT maintainer, repo, count(*) AS num_packages, count(DISTINCT effname) AS num_projects FROM pkg GROUP BY maintainer, repo"))
def maintainer_counts_map(spark, sf_dir):
    """Counters by repository folded into a map for each maintainer, and unfolded again."""
    counters = ["num_packages", "num_projects"]
    tall = packages(spark, sf_dir).groupBy("maintainer", "repo").agg(F.count(F.lit(1)).alias("num_packages"), F.count_distinct("effname").alias("num_projects"))
    return upkeep.counts_unfolded(upkeep.counts_per_repository(tall, counters), counters)


@query(with_sql("SELECT repo, count(DISTINCT effname) AS num_problems FROM pkg WHERE flags > 0 GROUP BY repo"))
def repository_problems(spark, sf_dir):
    return upkeep.problem_projects(packages(spark, sf_dir).filter("flags > 0"))


# Names of products

_NAMED = """o AS (SELECT k AS id, b AS effname, CASE k % 4 WHEN 0 THEN NULL ELSE CAST(k % 12 AS VARCHAR) END AS product, CAST(size % 3 AS VARCHAR) AS vendor, CASE WHEN k % 5 < 2 THEN '*' ELSE CAST(k % 3 AS VARCHAR) END AS lang, CASE WHEN k % 3 = 0 THEN 'r1' ELSE 'r2' END AS repo FROM r),
t AS (SELECT c_custkey AS id, CAST(c_custkey % 8 AS VARCHAR) AS product, CAST(c_nationkey % 3 AS VARCHAR) AS vendor, CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE CAST(c_custkey % 3 AS VARCHAR) END AS lang FROM customer WHERE c_nationkey < 12),
v AS (SELECT DISTINCT o.effname, o.product, o.vendor FROM o JOIN t ON o.product = t.product AND o.vendor = t.vendor AND coalesce(nullif(o.lang, '*') = nullif(t.lang, '*'), TRUE) AND o.id % 2 = 0),
s AS (SELECT effname, string_agg(concat(vendor, ':', product), ',' ORDER BY vendor, product) AS names FROM v GROUP BY effname)"""


def _cpe(df: DataFrame, **columns: Column) -> DataFrame:
    named = {c: columns.pop(c.removeprefix("cpe_"), F.lit(None)).cast("string").alias(c) for c in upkeep.CPE_COLUMNS}
    return df.select(*[v.alias(k) for k, v in columns.items()], *named.values())


def _named(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages with names of products, vulnerability data, and vulnerable projects."""
    k, c = F.col("k"), F.col("c_custkey")
    ours = _cpe(rows(spark, sf_dir), id=k, effname=F.col("b"), product=F.when(k % 4 != 0, text(k % 12)), vendor=text(F.col("size") % 3), lang=F.when(k % 5 < 2, "*").otherwise(text(k % 3)), repo=F.when(k % 3 == 0, "r1").otherwise("r2"))
    theirs = _cpe(table(spark, sf_dir, "customer").filter("c_nationkey < 12"), id=c, product=text(c % 8), vendor=text(F.col("c_nationkey") % 3), lang=F.when(c % 2 == 0, "*").otherwise(text(c % 3)))
    bindings = upkeep.project_cpes(ours.filter("id % 2 = 0"))
    return ours, theirs, upkeep.vulnerable_projects(bindings, theirs)


def _names(c: str) -> Column:
    pairs = F.array_distinct(F.transform(c, lambda x: F.concat(F.get_json_object(x, "$.cpe_vendor"), F.lit(":"), F.get_json_object(x, "$.cpe_product"))))
    return F.array_join(F.array_sort(pairs), ",").alias("names")


@query(ROWS.rstrip() + f", {_NAMED} SELECT o.id, s.names FROM o JOIN s ON o.effname = s.effname WHERE o.product IS NULL AND o.repo = 'r1'")
def cpe_missing(spark, sf_dir):
    """Packages without a product name where the repository uses names, with the names known for the project."""
    ours, _, known = _named(spark, sf_dir)
    fields = upkeep.used_fields(ours.filter("repo = 'r1'"), ["cpe_product"])
    return upkeep.cpe_missing(ours, fields, known).select("id", _names("suggestions"))


@query(
    ROWS.rstrip()
    + f", {_NAMED} SELECT o.id, coalesce(s.names, '') AS names FROM o LEFT JOIN s ON o.effname = s.effname WHERE o.product IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE o.product = t.product AND o.vendor = t.vendor AND coalesce(nullif(o.lang, '*') = nullif(t.lang, '*'), TRUE))"
)
def cpe_unreferenced_suggestions(spark, sf_dir):
    ours, theirs, known = _named(spark, sf_dir)
    out = upkeep.cpe_unreferenced(ours, theirs.filter("id % 2 = 0"), theirs.filter("id % 2 = 1"), known)
    return out.select("id", F.coalesce(_names("suggestions"), F.lit("")).alias("names"))


@query(ROWS.rstrip() + f", {_NAMED} SELECT DISTINCT effname, vendor, product, lang FROM o WHERE product IS NOT NULL")
def project_cpes(spark, sf_dir):
    ours, _, _ = _named(spark, sf_dir)
    return upkeep.project_cpes(ours).select("effname", F.col("cpe_vendor").alias("vendor"), F.col("cpe_product").alias("product"), F.col("cpe_lang").alias("lang"))


# Maintainers and links


@query(with_sql("SELECT maintainer, bool_or(pk % 3 = 0) AS old FROM pkg GROUP BY maintainer"))
def maintainers_precreated(spark, sf_dir):
    p, before = packages(spark, sf_dir), F.expr("TIMESTAMP '2000-01-01 00:00:00'")
    stored = p.filter("pk % 3 = 0").select("maintainer", before.alias("first_seen")).distinct()
    incoming = p.select(F.when(F.col("pk") % 5 > 0, F.array("maintainer")).alias("maintainers")).unionByName(p.select(F.array("maintainer").alias("maintainers")))
    return upkeep.precreated_maintainers(stored, incoming, F.expr(RUN_TS)).select("maintainer", (F.col("first_seen") == before).alias("old"))


@query("SELECT page_id AS id, concat('1:', CAST(page_id * 10 AS VARCHAR), CASE WHEN page_id % 2 = 0 THEN concat(' 0:', CAST(page_id * 10 AS VARCHAR)) ELSE '' END) AS links FROM pages")
def links_translated(spark, sf_dir):
    """Places in the links of packages become numbers, in order; one that has no number goes."""
    pages = table(spark, sf_dir, "pages")
    mine = F.concat(F.lit("http://p"), text(F.col("page_id")))
    link = lambda k, u: F.struct(F.lit(k).alias("link_type"), u.alias("url"))
    some = F.filter(F.array(link(1, mine), link(2, F.lit("http://gone/")), F.when(F.col("page_id") % 2 == 0, link(0, mine))), lambda x: x.isNotNull())
    ids = pages.select(mine.alias("url"), (F.col("page_id") * 10).alias("id"))
    out = upkeep.translated_links(pages.select(F.col("page_id").alias("id"), some.alias("links")), ids)
    return out.select("id", F.array_join(F.transform("links", lambda x: F.concat_ws(":", text(x["link_type"]), text(x["link_id"]))), " ").alias("links"))


@query(
    """WITH s AS (SELECT page_id, page_id % 4 AS n FROM pages WHERE page_id % 3 > 0), d AS (SELECT page_id, page_id % 5 - 2 AS n FROM pages WHERE page_id % 2 = 0)
SELECT coalesce(s.page_id, d.page_id) AS id, coalesce(s.n, 0) + coalesce(d.n, 0) AS refcount FROM s FULL OUTER JOIN d ON s.page_id = d.page_id WHERE NOT (d.page_id IS NULL AND s.n = 0)"""
)
def links_merged_and_purged(spark, sf_dir):
    """Stored counts and a delta; links without references for more than a month go."""
    pages, k = table(spark, sf_dir, "pages"), F.col("page_id")
    url, now = F.concat(F.lit("u"), text(k)), F.expr(RUN_TS)
    stored = pages.filter(k % 3 > 0).select(url.alias("url"), (k % 4).alias("refcount"), (k % 2 == 0).alias("priority"), F.when(k % 4 == 0, now - F.expr("INTERVAL '2' MONTH")).alias("orphaned_since"))
    delta = pages.filter(k % 2 == 0).select(url.alias("url"), (k % 5 - 2).alias("delta"), F.lit(False).alias("priority"))
    out = links.purged_links(links.merged_links(stored, delta, now), now)
    return out.select(F.substring("url", 2, 20).cast("long").alias("id"), "refcount")


@query(with_sql("SELECT pk, maintainer FROM pkg WHERE pk % 3 = 0 UNION ALL SELECT pk, NULL FROM pkg WHERE pk % 3 = 1"))
def per_maintainer_rows(spark, sf_dir):
    p = packages(spark, sf_dir)
    listed = F.when(F.col("pk") % 3 == 0, F.array("maintainer")).when(F.col("pk") % 3 == 2, F.array().cast("array<string>"))
    return links.per_maintainer(p.select("pk", listed.alias("maintainers"))).select("pk", "maintainer")


# Checks and merges


@query(with_sql("SELECT lower(n_name) AS repo, CAST(600 AS BIGINT) AS minimum, coalesce(c.n, 0) AS n FROM nation LEFT JOIN (SELECT repo, count(*) AS n FROM pkg WHERE pk % 2 = 0 AND repo > 'c' GROUP BY repo) c ON c.repo = lower(n_name) WHERE coalesce(c.n, 0) < 600"))
def repositories_under_minimum(spark, sf_dir):
    floors = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("repo"), F.lit(600).cast("long").alias("minimum"))
    return changes.missing_minimum(packages(spark, sf_dir).filter("pk % 2 = 0 and repo > 'c'"), floors)


@query(with_sql("SELECT effname, count(*) AS n FROM pkg GROUP BY effname HAVING count(*) > 25"))
def oversized_projects(spark, sf_dir):
    return changes.oversized(packages(spark, sf_dir), 25)


@query(
    with_sql(
        """WITH o AS (SELECT DISTINCT effname FROM old_pkg), n AS (SELECT DISTINCT effname FROM new_pkg)
SELECT count(*) FILTER (WHERE o.effname IS NULL) AS added, count(*) FILTER (WHERE n.effname IS NULL) AS removed FROM o FULL OUTER JOIN n ON o.effname = n.effname""",
        old=True,
        new=True,
    )
)
def change_summary(spark, sf_dir):
    kinds = changes.changes(_hashes(old_packages(spark, sf_dir)), _hashes(new_packages(spark, sf_dir)))
    return changes.change_statistics(kinds).select("added", "removed")


@query(
    with_sql(
        """WITH o AS (SELECT effname, count(DISTINCT repo) AS r FROM old_pkg GROUP BY effname), n AS (SELECT effname, count(DISTINCT repo) AS r FROM new_pkg GROUP BY effname)
SELECT coalesce(o.effname, n.effname) AS effname, coalesce(n.r, 0) AS num_repos, CASE WHEN n.effname IS NULL THEN 4 ELSE CASE WHEN o.effname IS NULL THEN 1 ELSE 5 END END AS num_updates, n.effname IS NULL AS orphaned FROM o FULL OUTER JOIN n ON o.effname = n.effname""",
        old=True,
        new=True,
    )
)
def projects_merged(spark, sf_dir):
    """Stored projects after a run in which all changed."""
    old, new = old_packages(spark, sf_dir).withColumn("versionclass", F.lit(1)), new_packages(spark, sf_dir).withColumn("versionclass", F.lit(1))
    stored = aggregates.projects(old).withColumns({"num_updates": F.lit(4), "orphaned_at": F.lit(None).cast("timestamp")})
    changed = old.select("effname").union(new.select("effname"))
    out = aggregates.updated_projects(stored, new, changed, F.expr(RUN_TS))
    return out.select("effname", F.col("num_repos").cast("long").alias("num_repos"), "num_updates", F.col("orphaned_at").isNotNull().alias("orphaned"))


@query(ROWS + "SELECT CAST(k % 3 AS INT) AS rule, count(*) AS n FROM r GROUP BY k % 3")
def rule_hits(spark, sf_dir):
    """How often each rule fires."""
    p = rows(spark, sf_dir).select(F.concat(F.lit("x"), text(F.col("k") % 3)).alias("effname"), F.col("v").alias("version"))
    return rules.rule_statistics(rules.apply_rules(p, [{"name": f"x{n}", "addflag": "seen"} for n in range(3)]))


@query(ROWS + "SELECT effname, CAST(number AS INT) AS number, n FROM (SELECT concat('y', CAST(k % 40 AS VARCHAR)) AS effname, k % 40 AS number, count(*) AS n FROM r GROUP BY k % 40)")
def rule_table(spark, sf_dir):
    """Rules that name their projects, met as a table: forty renames, each followed by a rule for the new name."""
    p = rows(spark, sf_dir).select(F.concat(F.lit("x"), text(F.col("k") % 40)).alias("effname"), F.lit("1").alias("version"))
    named = [{"name": f"x{n}", "setname": f"y{n}"} for n in range(40)] + [{"name": f"y{n}", "ignore": True} for n in range(40)]
    out = rules.apply_rules(p, named).filter("flags = 4")
    return out.groupBy("effname", F.element_at("matched_rules", 1).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query(ROWS + "SELECT n AS trackname, b AS effname, FALSE AS is_actual FROM r WHERE k % 3 <> 0 AND k % 5 <> 0 AND b IN (SELECT b FROM r WHERE size > 40)")
def redirects_derived(spark, sf_dir):
    r = rows(spark, sf_dir)
    left = r.select(F.lit("repo").alias("repo"), F.col("n").alias("trackname"), F.concat("b", F.lit("-unclassified")).alias("effname"), (F.col("k") % 3 == 0).alias("is_actual"))
    known = r.filter("k % 5 = 0").select(F.lit("repo").alias("repo"), F.col("n").alias("trackname"), F.col("b").alias("effname"), F.lit(True).alias("is_actual"))
    out = history.derived_redirects(left.unionByName(known), r.filter("size > 40").select(F.col("b").alias("effname")))
    return out.select("trackname", "effname", "is_actual")


_MASKS = "(SELECT repo, trackname, version, count(*) AS k, bit_or(CAST(1 << versionclass AS INT)) AS s, bit_or(CAST(flags AS INT)) AS f FROM {}_c GROUP BY repo, trackname, version)"


@query(
    with_sql(
        f"""SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.trackname, n.trackname) AS trackname, coalesce(o.version, n.version) AS version, coalesce(o.s, 0) | coalesce(n.s, 0) AS any_statuses, coalesce(o.f, 0) | coalesce(n.f, 0) AS any_flags,
coalesce(n.k, 0) AS refcount, o.repo IS NULL AS started, n.repo IS NULL AS ended FROM {_MASKS.format('old')} o FULL OUTER JOIN {_MASKS.format('new')} n ON o.repo = n.repo AND o.trackname = n.trackname AND o.version = n.version""",
        old=True,
        new=True,
    )
)
def track_versions_merged(spark, sf_dir):
    """Statuses and flags gather over runs; a version that no package has any more ends."""
    old, new = snapshots(spark, sf_dir)
    run_ts = F.expr(RUN_TS)
    stored = aggregates.class_mask(old, "repo", "trackname", "version").withColumns({"start_ts": F.expr("TIMESTAMP '2000-06-01 00:00:00'"), "end_ts": F.lit(None).cast("timestamp")})
    out = history.merged_track_versions(stored, history.track_version_delta(old, new), run_ts)
    return out.select("repo", "trackname", "version", "any_statuses", "any_flags", "refcount", (F.col("start_ts") == run_ts).alias("started"), F.col("end_ts").isNotNull().alias("ended"))
