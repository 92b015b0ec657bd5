"""Maintained aggregates. Each measure has a full form over one snapshot and a delta form over two.

A changed project contributes all of its packages to both snapshots, so every measure that decomposes over
projects is exact as ``stored + new - old``; the tests hold the two forms against each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.schema import STATUS, has

CLASSES = ("newest", "outdated", "ignored", "unique", "devel", "legacy", "incorrect", "untrusted", "noscheme", "rolling")
UPTODATE = (STATUS["newest"], STATUS["unique"], STATUS["devel"])
PROBLEMATIC = (STATUS["ignored"], STATUS["incorrect"], STATUS["untrusted"])


def _is(*classes: int) -> Column:
    return F.col("versionclass").isin(*classes)


def package_counters() -> list[Column]:
    """Packages in all, of each class, and vulnerable."""
    by_class = [F.count_if(_is(STATUS[c])).alias(f"num_packages_{c}") for c in CLASSES]
    return [F.count(F.lit(1)).alias("num_packages"), *by_class, F.count_if(has("flags", "vulnerable")).alias("num_packages_vulnerable")]


def project_kinds() -> dict[str, Column]:
    """What a project is counted as, by the counters of its packages."""
    some = lambda *classes: reduce(lambda a, b: a | b, [F.col(f"num_packages_{c}") > 0 for c in classes])
    return {"": F.lit(True), "_newest": some("newest", "unique", "devel"), "_outdated": some("outdated"), "_problematic": some("ignored", "incorrect", "untrusted"), "_vulnerable": some("vulnerable")}


def by_maintainer(packages: DataFrame, *keys: str) -> DataFrame:
    """Counters of each maintainer, or of each maintainer and further keys; in two levels, first for each project, so that
    distinct projects are counted without a copy of the rows for each kind."""
    inner = packages.groupBy("maintainer", *keys, "effname").agg(*package_counters())
    sums = [F.sum(c).alias(c) for c in inner.columns if c.startswith("num_packages")]
    return inner.groupBy("maintainer", *keys).agg(*sums, *[F.count_if(c).alias(f"num_projects{k}") for k, c in project_kinds().items()])


def by_maintainer_category(packages: DataFrame) -> DataFrame:
    return packages.groupBy("maintainer", "category").agg(F.count_distinct("effname").alias("num_projects"))


def by_repository(packages: DataFrame) -> DataFrame:
    """Counters of each repository, in two levels: packages of a project in a repository, then its projects.
    Projects that only shadow repositories hold don't count."""
    countable = packages.groupBy("effname").agg((F.min("family") == F.max("family")).alias("is_unique"), F.count_if(~F.col("shadow")).alias("open")).filter("open > 0").drop("open")
    inner = packages.groupBy("repo", "effname").agg(*package_counters())
    some = lambda c: F.col(f"num_packages_{c}") > 0
    newest = ~F.col("is_unique") & (some("newest") | some("devel")) & ~some("outdated")
    kinds = {
        "": F.lit(True),
        "_unique": F.col("is_unique"),
        "_newest": newest,
        "_outdated": some("outdated"),
        "_comparable": newest | some("outdated") | some("incorrect"),
        "_problematic": some("ignored") | some("incorrect") | some("untrusted"),
        "_vulnerable": some("vulnerable"),
    }
    sums = [F.sum(c).alias(c) for c in inner.columns if c.startswith("num_packages")]
    return inner.join(countable.hint("shuffle_hash"), "effname").groupBy("repo").agg(*sums, *[F.count_if(c).alias(f"num_metapackages{k}") for k, c in kinds.items()])


def delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new - old for each counter; keys of one side count as 0 on the other."""
    counters = [c for c in new.columns if c not in keys]
    joined = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in counters]).join(new, keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(*keys, *[(zero(c) - zero(f"old_{c}")).alias(c) for c in counters])


def applied(stored: DataFrame, change: DataFrame, keys: list[str], keep_empty: bool = False) -> DataFrame:
    """stored + change; rows whose counters are all 0 go unless ``keep_empty``."""
    counters = [c for c in change.columns if c not in keys]
    both = stored.select(*keys, *counters).unionByName(change.select(*keys, *counters))
    out = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    return out if keep_empty else out.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in counters]))


def projects(packages: DataFrame) -> DataFrame:
    newest = _is(STATUS["newest"], STATUS["devel"])
    several = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731  (there are a few hundred repositories)
    return packages.groupBy("effname").agg(
        several("repo").alias("num_repos"),
        several(F.when(~F.col("shadow"), F.col("repo"))).alias("num_repos_nonshadow"),
        several("family").alias("num_families"),
        several(F.when(newest, F.col("repo"))).alias("num_repos_newest"),
        several(F.when(newest, F.col("family"))).alias("num_families_newest"),
    )


def updated_projects(stored: DataFrame, incoming: DataFrame, changed: DataFrame, run_ts: Column) -> DataFrame:
    """Stored projects with the counters of changed ones replaced: new ones appear, vanished ones are orphaned."""
    counters = ["num_repos", "num_repos_nonshadow", "num_families", "num_repos_newest", "num_families_newest"]
    fresh = projects(incoming).select("effname", *[F.col(c).alias(f"new_{c}") for c in counters], F.lit(True).alias("present"))
    joined = stored.join(fresh, "effname", "full_outer").join(changed.select("effname").distinct().withColumn("touched", F.lit(True)), "effname", "left")
    value = lambda c: F.when(F.col("present"), F.col(f"new_{c}")).when(F.col("touched"), F.lit(0)).otherwise(F.col(c)).alias(c)
    return joined.select(
        "effname",
        *[value(c) for c in counters],
        (F.coalesce(F.col("num_updates"), F.lit(0)) + F.when(F.col("present"), 1).otherwise(0)).alias("num_updates"),
        F.when(F.col("present"), F.lit(None).cast("timestamp")).when(F.col("touched") & F.col("orphaned_at").isNull(), run_ts).otherwise(F.col("orphaned_at")).alias("orphaned_at"),
    )


def binding_flags(packages: DataFrame, *keys: str, unique_from: DataFrame | None = None) -> DataFrame:
    """newest, outdated and problematic of each key; with project counters also unique, for open projects only."""
    flags = [F.bool_or(_is(*UPTODATE)).alias("newest"), F.bool_or(_is(STATUS["outdated"])).alias("outdated"), F.bool_or(_is(*PROBLEMATIC)).alias("problematic")]
    if unique_from is not None:
        packages = packages.join(unique_from.filter("num_repos_nonshadow > 0").select("effname", "num_families"), "effname")
        flags.append((F.max("num_families") == 1).alias("unique"))
    return packages.groupBy(*keys).agg(*flags)


def categories(packages: DataFrame, counters: DataFrame) -> DataFrame:
    known = packages.filter(F.col("category").isNotNull()).join(counters.filter("num_repos_nonshadow > 0").select("effname", "num_families"), "effname")
    return known.groupBy("category", "effname").agg((F.max("num_families") == 1).alias("unique"))


def project_names(packages: DataFrame) -> DataFrame:
    """Names by kind, each once; list fields are unfolded."""
    kinds = [("trackname", "trackname"), ("category", "category")]
    names = F.array(*[F.struct(F.lit(k).alias("name_type"), F.col(c).alias("name")) for k, c in kinds])
    return packages.select("effname", "repo", F.explode(names).alias("n")).filter("n.name is not null").select("effname", "repo", "n.name_type", "n.name").distinct()


def maintainers_by_repository(packages: DataFrame, repositories: DataFrame) -> DataFrame:
    counted = packages.groupBy("repo").agg(F.count_distinct("maintainer").alias("num_maintainers"))
    return repositories.join(counted, "repo", "left").select("repo", F.coalesce("num_maintainers", F.lit(0)).alias("num_maintainers"))


def global_statistics(packages: DataFrame) -> DataFrame:
    """One row of totals, from one pass for each source."""
    return packages.agg(
        F.count(F.lit(1)).alias("num_packages"),
        F.count_distinct("effname").alias("num_projects"),
        F.count_distinct("maintainer").alias("num_maintainers"),
        F.count_distinct("repo").alias("num_repositories"),
        F.count_if(has("flags", "vulnerable")).alias("num_vulnerable"),
    )


def class_mask(packages: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Bit masks of the classes and flags seen, the number of packages, and further aggregates."""
    return packages.groupBy(*keys).agg(
        F.bit_or(F.expr("shiftleft(1, versionclass)")).alias("any_statuses"),
        F.bit_or("flags").alias("any_flags"),
        F.count(F.lit(1)).alias("refcount"),
        *more,
    )
