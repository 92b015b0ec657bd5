"""What a run keeps up beside the packages: totals and their check, histories, repository states, stored hashes,
queues of changed projects, field statistics, problem reports with suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.plans.links import cpe_matches, unreferenced_cpes
from larder.schema import CPE_FIELDS

CPE_COLUMNS = tuple(f"cpe_{c}" for c in CPE_FIELDS)

# Totals: recomputed from scratch, held against what is stored


def totals_differences(stored: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counter, stored, actual): each counter that differs; a row that one side lacks counts as zeros there."""
    counters = [c for c in recomputed.columns if c not in keys]
    a = stored.select(*keys, F.lit(True).alias("a"), *[F.col(c).alias(f"a_{c}") for c in counters])
    b = recomputed.select(*keys, F.lit(True).alias("b"), *[F.col(c).alias(f"b_{c}") for c in counters])
    both = a.join(b, keys, "full_outer") if keys else a.join(b, F.col("a") == F.col("b"), "full_outer")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    pairs = F.array(*[F.struct(F.lit(c).alias("counter"), zero(f"a_{c}").alias("stored"), zero(f"b_{c}").alias("actual")) for c in counters])
    return both.select(*keys, F.inline(F.filter(pairs, lambda p: p["stored"] != p["actual"])))


def totals_fixed(stored: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the recomputed counters; other columns stay, rows without packages count zero."""
    counters = [c for c in recomputed.columns if c not in keys]
    fresh = recomputed.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in counters])
    out = stored.join(fresh, keys, "left")
    return out.select(*[F.coalesce(f"_new_{c}", F.lit(0)).alias(c) if c in counters else F.col(c) for c in stored.columns])


# Histories: one row a run


def repository_history(repositories: DataFrame, run_ts: Column) -> DataFrame:
    """A snapshot of the counters of repositories that are not legacy."""
    counters = [c for c in repositories.columns if c.startswith("num_")]
    return repositories.filter("state <> 'legacy'").select("repo", run_ts.alias("ts"), *counters)


def statistics_history(statistics: DataFrame, run_ts: Column) -> DataFrame:
    return statistics.select(run_ts.alias("ts"), *statistics.columns)


def link_counters(links: DataFrame, run_ts: Column) -> DataFrame:
    """One row of link totals, from one pass: columns refcount, priority, next_check, ipv4_status_code, ipv6_status_code."""
    used = F.col("refcount") > 0
    v4, v6 = F.coalesce("ipv4_status_code", F.lit(0)), F.coalesce("ipv6_status_code", F.lit(0))
    checkable = ~v4.between(-6, 0) | ~v6.between(-6, 0)
    alive6, extracted = v6 == 200, F.coalesce("priority", F.lit(False))
    alive = (v4 == 200) | alive6
    kinds = {"total": F.lit(True), "overdue": F.col("next_check") < run_ts, "checkable": checkable, "alive": alive, "alive_ipv6": alive6}
    kinds |= {f"extracted_{k}": extracted & c for k, c in (("checkable", checkable), ("alive", alive), ("alive_ipv6", alive6))}
    return links.agg(*[F.count_if(used & c).alias(f"num_links_{k}") for k, c in kinds.items()])


def global_counters(packages: DataFrame, projects: DataFrame, maintainers: DataFrame, problems: DataFrame, reports: DataFrame, links: DataFrame, run_ts: Column) -> DataFrame:
    """The row of global totals: one pass over each table, one-row frames side by side."""
    parts = [
        packages.agg(F.count(F.lit(1)).alias("num_packages")),
        projects.agg(F.count_if(F.col("num_repos_nonshadow") > 0).alias("num_projects")),
        maintainers.agg(F.count_if(F.col("num_packages") > 0).alias("num_maintainers")),
        problems.agg(F.count(F.lit(1)).alias("num_problems")),
        reports.agg(F.count(F.lit(1)).alias("num_reports_total"), F.count_if(F.col("accepted").isNull()).alias("num_reports_open")),
        link_counters(links, run_ts),
    ]
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(F.broadcast(b), "_one"), keyed).drop("_one")  # one row each


def package_count_delta(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """(delta): packages that come less packages of changed projects that go."""
    counts = old.select(F.lit(-1).alias("n")).unionByName(incoming.select(F.lit(1).alias("n")))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("delta"))


# Repository states


def repository_states(stored: DataFrame, configured: DataFrame, run_ts: Column) -> DataFrame:
    """Stored repositories (id, repo, state, first_seen, last_seen) after a run over the configured ones (repo).

    New names get the smallest free ids in order of their names; a legacy repository that is configured again is
    readded; one that no longer is becomes legacy.
    """
    now = configured.select("repo").distinct().withColumn("_now", F.lit(True))
    known = stored.join(now, "repo", "left").select(
        "id",
        "repo",
        F.when(F.col("_now").isNull(), "legacy").when(F.col("state") == "legacy", "readded").otherwise(F.col("state")).alias("state"),
        "first_seen",
        F.when(F.col("_now"), run_ts).otherwise(F.col("last_seen")).alias("last_seen"),
    )
    names = [r["repo"] for r in now.join(stored, "repo", "left_anti").orderBy("repo").collect()]  # names in a configuration
    if not names:
        return known
    taken = {r["id"] for r in stored.select("id").collect()}
    free = (n for n in range(1, len(taken) + len(names) + 1) if n not in taken)
    fresh = stored.sparkSession.createDataFrame(list(zip(free, names)), "id long, repo string")
    return known.unionByName(fresh.select(F.col("id").cast(stored.schema["id"].dataType).alias("id"), "repo", F.lit("new").alias("state"), run_ts.alias("first_seen"), run_ts.alias("last_seen")))


def marked_updated(repositories: DataFrame, updated: DataFrame, run_ts: Column) -> DataFrame:
    """Repositories whose packages were read: active from now on."""
    done = updated.select("repo").distinct().withColumn("_done", F.lit(True))
    out = repositories.join(done, "repo", "left").withColumn("state", F.when(F.col("_done"), "active").otherwise(F.col("state")))
    return out.withColumn("last_updated", F.when(F.col("_done"), run_ts).otherwise(F.col("last_updated"))).drop("_done")


def due(repositories: DataFrame, run_ts: Column, rules_hash: str | None = None) -> DataFrame:
    """(repo, fetch, parse): whether the update period of a repository is over, and whether it must be read again because
    it was fetched since or the rules changed."""
    late = F.col("last_fetched").isNull() | (run_ts - F.make_dt_interval(secs=F.col("period_seconds")) >= F.col("last_fetched"))
    stale = F.col("last_parsed").isNull() | F.coalesce(F.col("last_fetched") > F.col("last_parsed"), F.lit(False)) | ~F.col("rules_hash").eqNullSafe(F.lit(rules_hash))
    return repositories.select("repo", F.coalesce(late, F.lit(True)).alias("fetch"), F.coalesce(stale, F.lit(True)).alias("parse"))


# Stored hashes and changed projects


def stored_hashes(stored: DataFrame, fresh: DataFrame, kinds: DataFrame, key: str = "effname") -> DataFrame:
    """The table of hashes after a run: changed and new projects replaced, removed ones gone."""
    touched = kinds.filter("kind <> 'unchanged'").select(key)
    kept = stored.select(key, "hash").join(touched, key, "left_anti")
    return kept.unionByName(fresh.select(key, "hash").join(kinds.filter("kind in ('added', 'changed')").select(key), key, "left_semi"))


def checked_hashes(hashed: DataFrame, key: str = "effname") -> DataFrame:
    """(key, hash) of (key, h) rows of packages; equal hashes within a project are an error, since they would cancel out."""
    out = hashed.groupBy(key).agg(F.bit_xor("h").alias("hash"), F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("d"))
    return out.select(key, F.when(F.col("n") == F.col("d"), F.col("hash")).otherwise(F.raise_error(F.concat(F.lit("equal packages in project "), key))).alias("hash"))


def changed_queue(kinds: DataFrame, batch: int = 1000, key: str = "effname") -> DataFrame:
    """(key, batch): changed projects in batches of about ``batch``, whole projects in each, dealt by hash without a sort."""
    names = kinds.filter("kind <> 'unchanged'").select(key)
    n = names.count()
    return names.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // batch)))).cast("int"))


# Fields in use


def used_fields(packages: DataFrame, fields: list[str]) -> DataFrame:
    """(repo, fields, link_types): fields with a value in any package of a repository, and kinds of links that occur."""

    def truthy(name: str) -> Column:
        kind = packages.schema[name].dataType.typeName()
        c = F.col(name)
        if kind in ("array", "map"):
            return F.size(c) > 0
        if kind == "string":
            return c != ""
        return c if kind == "boolean" else c != 0

    seen = [F.coalesce(F.bool_or(truthy(f)), F.lit(False)).alias(f) for f in fields]
    kinds = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.transform("links", lambda x: x["link_type"])))))).alias("link_types")] if "links" in packages.columns else []
    out = packages.groupBy("repo").agg(*seen, *kinds)  # a set of sets of link types, of which there are few
    listed = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in sorted(fields)]))
    return out.select("repo", listed.alias("fields"), *(["link_types"] if kinds else []))


def counts_per_repository(maintained: DataFrame, counters: list[str]) -> DataFrame:
    """(maintainer, counts, num_repos): a map of repository to its counters, for those with packages."""
    some = maintained.filter("num_packages > 0")
    entry = F.struct("repo", F.array(*counters))
    return some.groupBy("maintainer").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("counts"), F.count(F.lit(1)).alias("num_repos"))  # as many as there are repositories


def counts_unfolded(folded: DataFrame, counters: list[str]) -> DataFrame:
    """The reverse: (maintainer, repo, counters)."""
    rows = folded.select("maintainer", F.explode("counts").alias("repo", "c"))
    return rows.select("maintainer", "repo", *[F.get("c", F.lit(k)).alias(c) for k, c in enumerate(counters)])


def problem_projects(problems: DataFrame) -> DataFrame:
    """(repo, num_problems): distinct projects with a problem."""
    return problems.groupBy("repo").agg(F.count_distinct("effname").alias("num_problems"))


# Problem reports on names of products in vulnerability data


def suggestions(vulnerable: DataFrame) -> DataFrame:
    """(effname, suggestions): the distinct names under which a project is known, as sorted JSON texts."""
    one = F.to_json(F.struct(*CPE_COLUMNS), {"ignoreNullFields": "false"})
    return vulnerable.groupBy("effname").agg(F.array_sort(F.collect_set(one)).alias("suggestions"))  # names of one project


def cpe_missing(packages: DataFrame, fields: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """Packages without a product name, in repositories that use it, of projects with known vulnerabilities."""
    users = fields.filter(F.array_contains("fields", "cpe_product")).select("repo")
    rows = packages.filter(F.col("cpe_product").isNull()).join(users, "repo", "left_semi")
    return rows.join(suggestions(vulnerable), "effname")


def cpe_unreferenced(packages: DataFrame, dictionary: DataFrame, known: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """Packages whose name neither the dictionary nor any vulnerability has, with suggestions where there are some."""
    others = tuple(c for c in CPE_COLUMNS if c != "cpe_product")
    named = packages.filter(F.col("cpe_product").isNotNull())
    return unreferenced_cpes(named, dictionary, known, others, ("cpe_product",)).join(suggestions(vulnerable), "effname", "left")


def vulnerable_projects(bindings: DataFrame, known: DataFrame) -> DataFrame:
    """(effname, names): products bound to projects by hand that some vulnerability names."""
    others = tuple(c for c in CPE_COLUMNS if c not in ("cpe_vendor", "cpe_product"))
    return cpe_matches(bindings, known.select(*CPE_COLUMNS).distinct(), others).select("effname", *CPE_COLUMNS).distinct()


def project_cpes(packages: DataFrame) -> DataFrame:
    """(effname, names): what packages say of their project's product."""
    return packages.filter(F.col("cpe_product").isNotNull()).select("effname", *CPE_COLUMNS).distinct()


def precreated_maintainers(stored: DataFrame, incoming: DataFrame, run_ts: Column) -> DataFrame:
    """Stored maintainers (maintainer, first_seen) and those of incoming packages that are new."""
    fresh = incoming.select(F.explode("maintainers").alias("maintainer")).distinct().join(stored, "maintainer", "left_anti")
    return stored.select("maintainer", "first_seen").unionByName(fresh.select("maintainer", run_ts.alias("first_seen")))


def translated_links(packages: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """(key, links): links of packages with the number of their place instead of its text, in their order. Places meet their
    numbers by text; what has no number goes."""
    rows = packages.select(key, F.posexplode("links").alias("at", "link")).select(key, "at", F.col("link.link_type").alias("link_type"), F.col("link.url").alias("url"))
    found = rows.join(ids.select("url", F.col("id").alias("link_id")), "url")
    ordered = F.array_sort(F.collect_list(F.struct("at", "link_type", "link_id")))  # as many as a package has links
    return found.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(x["link_type"].alias("link_type"), x["link_id"].alias("link_id"))).alias("links"))
