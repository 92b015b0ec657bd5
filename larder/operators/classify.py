"""The version classifier, with windows only.

Packages of a project are ranked by version (a greater one has a lesser number, equal versions share it), which turns every
comparison of versions into one of numbers. Each step of the classification is then a minimum or maximum over a
window; all windows divide the project, so one shuffle by project serves them all and no group is ever collected. One
sort by version serves all windows but those by repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.versions import package_key
from larder.schema import ANY_IGNORED, FLAG, STATUS, has

REQUIRED = ("effname", "repo", "family", "version", "flags")


def classify(packages: DataFrame, key: Column | None = None) -> DataFrame:
    """``packages`` with ``versionclass`` filled in.

    Needs the columns of ``REQUIRED``; ``flavors`` and ``branch`` are used if they are there. ``key`` replaces
    the order of versions. Null flags count as none; a project's packages may number any amount.
    """
    kept = [c for c in packages.columns if c != "versionclass"]
    flavor = F.array_join(F.coalesce(F.col("flavors"), F.array().cast("array<string>")), "_") if "flavors" in kept else F.lit("")
    branch = F.col("branch") if "branch" in kept else F.lit(None).cast("string")
    # Each window copies its rows several times, so what is only passed on is one column, and what the windows need is narrow.
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    carried = [c for c in kept if c not in ("effname", "repo")]
    flags = F.coalesce(F.col("flags"), F.lit(0))
    rows = packages.select(
        "effname",
        "repo",
        "family",
        "version",
        flags.alias("_flags"),
        flavor.alias("_flavor"),
        branch.alias("_branch"),
        flags.bitwiseAND(F.lit(FLAG["rolling"] | FLAG["altscheme"])).alias("_scheme"),
        (package_key(F.col("version"), flags) if key is None else key).alias("_key"),
        F.struct(*[quoted(c) for c in carried]).alias("_package"),
    )
    rows = rows.withColumn("_rank", -F.dense_rank().over(Window.partitionBy("effname", "_scheme").orderBy("_key")))

    rolling = has("_flags", "rolling")
    project = Window.partitionBy("effname")
    live_family = F.when(~rolling, F.col("family"))
    ignored = F.col("_flags").bitwiseAND(F.lit(ANY_IGNORED)) != 0
    n = F.sum((~rolling).cast("int")).over(project)
    # Snapshot schemes that can't be compared with each other keep ignored versions ignored.
    old_scheme = F.col("version").startswith("20")
    new_scheme = ~old_scheme & F.col("version").contains("-unstable-")
    steady = ~rolling
    mixed = (F.max(F.when(steady, F.col("family"))).over(project) == "nix") & F.max((steady & old_scheme)).over(project) & F.max((steady & new_scheme)).over(project)
    all_ignored = F.min(F.when(steady, ignored & ~has("_flags", "noscheme"))).over(project)
    one_family = F.min(live_family).over(project) == F.max(live_family).over(project)
    rows = rows.withColumns(
        {
            "_unique": F.min("family").over(project).eqNullSafe(F.max("family").over(project)),
            "_suppress": (n <= 1) | (F.coalesce(one_family & all_ignored, F.lit(False)) & ~F.coalesce(mixed, F.lit(False))),
        }
    )

    # Rolling packages are classified already; they stay in the window partitions of their own.
    scheme = Window.partitionBy("effname", "_scheme")
    group = Window.partitionBy("effname", "_scheme", "_key")

    def any_of(*names: str) -> Column:
        return F.max(has("_flags", *names)).over(group)

    rows = rows.withColumns(
        {
            "_ignored": (~F.col("_suppress") & F.min(ignored).over(group)) | any_of("recalled"),
            "_devel": (any_of("devel") | (any_of("weak_devel") & F.min(has("_flags", "devel", "weak_devel")).over(group))) & ~any_of("stable"),
            "_altver": any_of("altver"),
        }
    )

    # First pass: live groups up to the first that isn't devel (_split) make the devel section, the rest the stable one. _next is the
    # greatest live version that isn't above a package's own.
    live = ~F.col("_ignored")
    ordered = Window.partitionBy("effname", "_scheme").orderBy("_key")
    least = lambda wanted: F.min(F.when(wanted, F.col("_rank")))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {"_split": least(live & ~F.col("_devel")).over(whole), "_top": least(live & ~F.col("_altver")).over(whole), "_topa": least(live).over(whole), "_next": least(live).over(ordered)}
    ).drop("_key")

    # Second pass: from the first group that neither fits the devel section nor lies above it, all are stable.
    in_devel = lambda top: F.when(F.col("_split").isNull() | (F.col(top) < F.col("_split")), F.col(top))
    first0, first0a = in_devel("_top"), in_devel("_topa")
    no_devel = F.when(F.col("_altver"), first0a).otherwise(first0).isNull()
    below_devel = F.col("_next").isNull() | F.coalesce(F.col("_next") >= F.col("_split"), F.lit(False))
    rows = rows.withColumns(
        {
            "_first1": least(live & ~F.col("_altver") & (F.col("_rank") >= F.col("_split"))).over(scheme),
            "_stable": least(~F.col("_devel") & (no_devel | below_devel)).over(scheme),
        }
    )
    rows = rows.withColumn("_section", F.coalesce(F.col("_stable") <= F.col("_rank"), F.lit(False)).cast("int"))

    # Third pass: each package against its section's best and against what its repository has.
    altver = has("_flags", "altver")
    best = F.when(F.col("_section") == 0, F.when(altver, first0a).otherwise(first0)).otherwise(F.when(altver, F.col("_split")).otherwise(F.col("_first1")))
    rows = rows.withColumn("_best", best)
    below = F.col("_rank") >= F.col("_best")
    in_section = Window.partitionBy("effname", "_scheme", "repo", "_section", "_flavor")
    rows = rows.withColumn("_own_first", F.min(F.when(below, F.col("_rank"))).over(in_section))
    late_in_branch = F.lit(False)
    if "branch" in kept:  # one branch holds all sections, so nothing is late in it that isn't the first of its section
        in_branch = Window.partitionBy("effname", "_scheme", "repo", "_branch", "_flavor")
        of_branch = Window.partitionBy("effname", "_scheme", "_branch")
        rows = rows.withColumns({"_branch_first": F.min(F.when(below, F.col("_rank"))).over(in_branch), "_branch_best": F.min(F.when(live & ~F.col("_devel"), F.col("_rank"))).over(of_branch)})
        late_in_branch = (F.col("_branch_first") == F.col("_rank")) & (F.col("_branch_best") < F.col("_rank"))
    legacy = ((F.col("_own_first") < F.col("_rank")) & ~F.coalesce(late_in_branch, F.lit(False)) & ~has("_flags", "nolegacy")) | has("_flags", "legacy")
    status = lambda name: F.lit(STATUS[name])
    above = F.when(has("_flags", "noscheme"), status("noscheme")).when(has("_flags", "incorrect"), status("incorrect")).when(has("_flags", "untrusted"), status("untrusted")).when(has("_flags", "ignore"), status("ignored")).otherwise(status("outdated"))
    top = F.when(F.col("_unique"), status("unique")).when(F.col("_section") == 0, status("devel")).otherwise(status("newest"))
    top = F.when(has("_flags", "outdated"), status("outdated")).otherwise(top)
    cls = (
        F.when(rolling, status("rolling"))
        .when(F.col("_best").isNull() | (F.col("_rank") < F.col("_best")), above)
        .when(F.col("_rank") == F.col("_best"), top)
        .otherwise(F.when(legacy, status("legacy")).otherwise(status("outdated")))
    )
    return rows.select(*[F.col("_package").getField(c).alias(c) if c in carried else F.col(c) for c in kept], cls.cast("int").alias("versionclass"))
