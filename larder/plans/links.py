"""Links of packages: reference counts, relations between projects, related projects, and problem reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.normalize import url_hash
from larder.schema import PRIORITY_LINK_TYPES, RELATION_LINK_TYPES


def new_links(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Links of incoming packages that the table of links lacks."""
    return incoming.select("url").filter("url is not null").distinct().join(known.select("url"), "url", "left_anti")


def link_counts(links: DataFrame) -> DataFrame:
    """(url, priority, refcount) of (link_type, url) rows."""
    return links.groupBy("url").agg(F.bool_or(F.col("link_type").isin(*PRIORITY_LINK_TYPES)).alias("priority"), F.count(F.lit(1)).alias("refcount"))


def link_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, delta, priority) where the count differs or priority comes up."""
    a = link_counts(old).select("url", F.col("refcount").alias("was"), F.col("priority").alias("had"))
    b = link_counts(new).select("url", F.col("refcount").alias("now"), "priority")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = a.join(b, "url", "full_outer")
    rises = F.coalesce(F.col("priority") & ~F.col("had"), F.lit(False))
    return j.filter((zero("now") != zero("was")) | rises).select("url", (zero("now") - zero("was")).alias("delta"), F.coalesce("priority", F.lit(False)).alias("priority"))


def merged_links(stored: DataFrame, delta: DataFrame, run_ts: Column) -> DataFrame:
    """Links after a run; priority stays once set, a link without references is orphaned."""
    j = stored.join(delta.withColumnRenamed("priority", "rises"), "url", "full_outer")
    total = F.coalesce(F.col("refcount"), F.lit(0)) + F.coalesce(F.col("delta"), F.lit(0))
    orphaned = F.when(F.col("delta").isNotNull(), F.when(total == 0, run_ts)).otherwise(F.col("orphaned_since"))
    return j.select("url", total.alias("refcount"), (F.coalesce("priority", F.lit(False)) | F.coalesce("rises", F.lit(False))).alias("priority"), orphaned.alias("orphaned_since"))


def purged_links(links: DataFrame, run_ts: Column) -> DataFrame:
    return links.filter(F.col("orphaned_since").isNull() | (F.col("orphaned_since") >= run_ts - F.expr("INTERVAL '1' MONTH")))


def url_relations(links: DataFrame) -> DataFrame:
    """(effname, urlhash, weight) of (effname, family, link_type, url): families that name the link over the most
    that name any of the project's links."""
    used = links.filter(F.col("link_type").isin(*RELATION_LINK_TYPES)).select("effname", "family", url_hash(F.col("url")).alias("urlhash"))
    n = used.groupBy("effname", "urlhash").agg(F.count_distinct("family").alias("families"))
    return n.select("effname", "urlhash", (F.col("families") / F.max("families").over(Window.partitionBy("effname"))).alias("weight"))


def shared_relations(relations: DataFrame) -> DataFrame:
    """Relations over links that several projects have; counted before the join, so a popular link is no hot group."""
    several = relations.groupBy("urlhash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("urlhash")
    return relations.join(several, "urlhash", "left_semi")


def has_related(projects: DataFrame, relations: DataFrame) -> DataFrame:
    linked = shared_relations(relations).select("effname").distinct().withColumn("linked", F.lit(True))
    return projects.select("effname").distinct().join(linked, "effname", "left").select("effname", F.col("linked").isNotNull().alias("has_related"))


def related(seeds: DataFrame, relations: DataFrame, most: int = 50) -> DataFrame:
    """(seed, effname, score) of projects related to each seed project through shared links.

    Each round every known project passes its rank, over the number of known projects, to its links by weight,
    and each link on to the projects that it came not from; a project keeps its best rank, a seed its ``most``
    best projects. A seed whose total rank did not grow stays as it is; the rounds end when none grows. All
    seeds run together, each round is written to the checkpoint folder.

    Projects with the same links get the same rank, so links pass it to kinds of projects, named after their
    first one. Of 2 * most best kinds at least ``most`` hold no known project, and of the first 2 * most projects
    of a kind at least ``most`` are not known: no other project can be among the best.
    """
    ranks = seeds.select(F.col("effname").alias("seed"), "effname").distinct().withColumns({"rank": F.lit(1.0), "total": F.lit(1.0), "grows": F.lit(True)})
    degree = relations.groupBy("effname").agg(F.count(F.lit(1)).alias("links"))
    width = relations.groupBy("urlhash").agg(F.count(F.lit(1)).alias("projects"))
    edges = relations.join(degree, "effname").join(width, "urlhash").select("effname", "urlhash", "weight", "links", "projects").persist()
    linked = relations.groupBy("effname").agg(F.array_sort(F.collect_list("urlhash")).alias("all"))
    kinds = linked.groupBy("all").agg(F.min("effname").alias("kind"))
    first = F.row_number().over(Window.partitionBy("all").orderBy("effname"))
    members = linked.withColumn("n", first).filter(F.col("n") <= 2 * most).join(kinds, "all").select("kind", "effname").persist()
    ways = kinds.select("kind", F.explode("all").alias("urlhash")).persist()
    # Sums of the same parts in another order count as equal.
    by_rank = lambda name: F.row_number().over(Window.partitionBy("seed").orderBy(F.round(F.log2("rank"), 9).desc(), name))
    # Added from the largest on, as the reference reads its sorted table; what is too small to change the sum is no growth.
    total = F.aggregate(F.reverse(F.array_sort(F.collect_list("rank"))), F.lit(0.0), lambda x, y: x + y)
    while True:
        active = ranks.filter("grows")
        if active.isEmpty():
            break
        sized = active.join(active.groupBy("seed").agg(F.count(F.lit(1)).alias("known")), "seed")
        out = sized.join(edges, "effname").withColumn("part", F.col("rank") / F.col("known") / F.col("links") * F.col("weight"))
        passed = out.groupBy("seed", "urlhash").agg(F.sum("part").alias("part"), F.count(F.lit(1)).alias("incoming"), F.first("projects").alias("projects"))
        passed = passed.filter("projects > incoming").select("seed", "urlhash", (F.col("part") / (F.col("projects") - F.col("incoming"))).alias("part")).persist()
        again = active.select("seed", "effname").join(edges.select("effname", "urlhash"), "effname").join(passed, ["seed", "urlhash"]).groupBy("seed", "effname").agg(F.sum("part").alias("rank"))
        came = passed.join(ways, "urlhash").groupBy("seed", "kind").agg(F.sum("part").alias("rank"))
        came = came.withColumn("n", by_rank("kind")).filter(F.col("n") <= 2 * most).join(members, "kind").select("seed", "effname", "rank")
        both = active.select("seed", "effname", "rank").unionByName(again).unionByName(came).groupBy("seed", "effname").agg(F.max("rank").alias("rank"))
        kept = both.withColumn("n", by_rank("effname")).filter(F.col("n") <= most).drop("n")
        before = active.groupBy("seed").agg(F.first("total").alias("before"))
        growth = kept.groupBy("seed").agg(total.alias("total")).join(before, "seed").select("seed", "total", (F.col("total") > F.col("before")).alias("grows"))
        step = ranks.filter("not grows").unionByName(kept.join(growth, "seed").select("seed", "effname", "rank", "total", "grows")).persist()
        ranks = step.checkpoint()
        step.unpersist()
        passed.unpersist()
    for x in (edges, members, ways):
        x.unpersist()
    return ranks.select("seed", "effname", F.greatest(F.lit(0.0), 100 + 10 * F.log10("rank")).alias("score"))


#: Hosts that are gone, as whole-link patterns, by problem.
GONE = {
    "homepage_discontinued_google": (r"^https?://([^/]+.)?googlecode\.com(/.*)?$", r"^https?://code\.google\.com(/.*)?$"),
    "homepage_discontinued_codeplex": (r"^https?://([^/]+.)?codeplex\.com(/.*)?$",),
    "homepage_discontinued_gna": (r"^https?://([^/]+.)?gna\.org(/.*)?$",),
    "homepage_sourceforge_missing_trailing_slash": (r"^https?://sourceforge\.net/projects/[^/]+$",),
    "homepage_discontinued_cpan": (r"^https?://search\.cpan\.org(/.*)?$",),
}


def link_problems(links: DataFrame, run_ts: Column, strict_hosts: bool = False) -> DataFrame:
    """(the id columns, problem_type, url) of (…, link_type, url, and what the checker knows of the url).

    Columns: ipv4_status_code, ipv6_status_code, failure_streak, last_success, first_extracted,
    ipv4_permanent_redirect_target, ipv6_permanent_redirect_target. As in stored reports a link to
    code.google.com is a problem for downloads too; ``strict_hosts`` limits it to homepages.
    """
    v4, v6 = F.coalesce("ipv4_status_code", F.lit(0)), F.coalesce("ipv6_status_code", F.lit(0))
    code = F.when((v4 == 200) | (v6 == 200), 200).when(v4.between(-99, 0), v6).otherwise(v4)
    ago = run_ts - F.expr("INTERVAL '30' DAY")
    long_dead = (F.col("last_success").isNull() & (F.col("first_extracted") < ago)) | (F.col("last_success") < ago)
    dead = ~code.between(-99, 0) & (code != 200) & (F.col("failure_streak") >= 3) & long_dead
    moved = F.replace(F.col("url"), F.lit("http://"), F.lit("https://")) == F.coalesce("ipv4_permanent_redirect_target", "ipv6_permanent_redirect_target")
    home, download = F.col("link_type") == 0, F.col("link_type") == 1
    found = [(home & dead, "homepage_dead"), (home & moved, "homepage_permanent_https_redirect"), (download & dead, "download_dead"), (download & moved, "download_permanent_https_redirect")]
    for problem, patterns in GONE.items():
        for n, p in enumerate(patterns):
            loose = n > 0 and not strict_hosts
            found.append((F.col("url").rlike(p) & (F.lit(True) if loose else home), problem))
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for c, p in found]))
    ids = [c for c in ("id", "repo", "visiblename", "effname", "maintainer") if c in links.columns]
    rows = links.filter(F.col("link_type").isin(0, 1, 28)).withColumn("problem_type", F.explode(F.array_distinct(kinds)))
    return rows.select(*ids, "problem_type", "url").distinct()


def per_maintainer(packages: DataFrame) -> DataFrame:
    """One row for each maintainer; one with null if the list is null, none if it is empty."""
    listed = F.coalesce("maintainers", F.array(F.lit(None).cast("string")))
    return packages.withColumn("maintainer", F.explode(listed)).drop("maintainers")


def any_or_equal(a: Column, b: Column) -> Column:
    """Whether two CPE fields agree; a null or ``*`` agrees with everything."""
    return F.coalesce(F.nullif(a, F.lit("*")) == F.nullif(b, F.lit("*")), F.lit(True))


def cpe_matches(ours: DataFrame, theirs: DataFrame, fields: tuple[str, ...], on: tuple[str, ...] = ("cpe_vendor", "cpe_product")) -> DataFrame:
    """Join on vendor and product; the other fields agree where neither is open."""
    right = theirs.select(*on, *[F.col(f).alias(f"_{f}") for f in fields], *[c for c in theirs.columns if c not in (*on, *fields)])
    j = ours.join(right, list(on))
    for f in fields:
        j = j.filter(any_or_equal(F.col(f), F.col(f"_{f}")))
    return j.drop(*[f"_{f}" for f in fields])


def cpe_match_counts(ours: DataFrame, theirs: DataFrame, fields: tuple[str, ...], on: tuple[str, ...] = ("cpe_vendor", "cpe_product")) -> DataFrame:
    """(on, fields, n): of each distinct name of ours that some of theirs match, how many do.

    Distinct names meet, each with its number of rows, so a product that very many rows name is no hot group.
    """
    names = (*on, *fields)
    kinds = theirs.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return cpe_matches(ours.select(*names).distinct(), kinds, fields, on).groupBy(*names).agg(F.sum("n").alias("n"))


def same_cpe(a: str, b: str, names: tuple[str, ...]) -> Column:
    """Whether two aliased tables have the same name; nulls are equal."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])


def unreferenced_cpes(manual: DataFrame, dictionary: DataFrame, vulnerable: DataFrame, fields: tuple[str, ...], on: tuple[str, ...] = ("cpe_vendor", "cpe_product")) -> DataFrame:
    """Bindings that match neither the dictionary nor any vulnerability."""
    names = (*on, *fields)
    hit = cpe_match_counts(manual, dictionary.select(*names).unionByName(vulnerable.select(*names)), fields, on)
    return manual.alias("m").join(hit.alias("h"), same_cpe("m", "h", names), "left_anti")


def vulnerable(packages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``packages`` with the vulnerable flag set for versions inside a range of their project.

    Ranges: effname, start_version, end_version (null: open), start_version_excluded, end_version_excluded.
    Rolling packages are never marked. Packages meet ranges of their own project only; the marks come back by
    version, so packages are not multiplied.
    """
    from larder.functions.versions import version_key
    from larder.schema import FLAG, STATUS

    v, a, b = version_key(F.col("version")), version_key(F.col("start_version")), version_key(F.col("end_version"))
    inside = F.when(F.col("start_version").isNull(), True).when(F.col("start_version_excluded"), v > a).otherwise(v >= a) & F.when(F.col("end_version").isNull(), True).when(F.col("end_version_excluded"), v < b).otherwise(v <= b)
    hit = packages.select("effname", "version").distinct().join(ranges, "effname").filter(inside).select("effname", "version").distinct().withColumn("_hit", F.lit(True))
    marked = F.col("_hit").isNotNull() & (F.col("versionclass") != STATUS["rolling"])
    flags = F.when(marked, F.col("flags").bitwiseOR(F.lit(FLAG["vulnerable"]))).otherwise(F.col("flags"))
    return packages.join(hit, ["effname", "version"], "left").withColumn("flags", flags).select(*packages.columns)


def smallest_free_id(ids: DataFrame) -> DataFrame:
    """(id): the smallest positive whole number that is not taken."""
    last = ids.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    following = ids.filter("id > 0").select((F.col("id") + 1).alias("id")).unionByName(last.select(F.lit(1).cast(ids.schema["id"].dataType).alias("id")))
    return following.join(ids.select("id"), "id", "left_anti").agg(F.min("id").alias("id"))
