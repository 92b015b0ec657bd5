"""Tracks, releases, events, turnover, redirects, retention: what changes between two snapshots leaves behind.

Stored tables are merged functionally: each function takes the stored rows and gives all rows of the next state.
``run_ts`` stands for the time of the run and is always passed in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.versions import version_set_changed
from larder.plans.aggregates import PROBLEMATIC, UPTODATE, class_mask
from larder.schema import FLAG, STATUS, has


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _grouped(old: DataFrame, new: DataFrame, keys: tuple[str, ...] | list[str], aggregates: list[Column]) -> DataFrame:
    """Rows of both sides in groups by ``keys``, those of the new side being ``fresh``.

    Sides that lie by one of the keys stay where they are; a join by all keys would deal them out anew. As in a join, a null has no like on the other side.
    """
    both = old.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    apart = F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), F.col("fresh"))
    return both.groupBy(*keys, apart.alias("apart")).agg(*aggregates).drop("apart")


def track_delta(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo", "trackname")) -> DataFrame:
    """Change of the number of packages of each track; unchanged tracks are left out."""
    n = F.sum(F.when(F.col("fresh"), 1).otherwise(-1)).alias("delta")
    return _grouped(old.select(*keys), new.select(*keys), keys, [n]).filter("delta <> 0")


def merged_tracks(stored: DataFrame, change: DataFrame, run_ts: Column, keys: tuple[str, ...] = ("repo", "trackname")) -> DataFrame:
    """Tracks after a run: refcount, start_ts, restart_ts (set when a track comes back) and end_ts (set when it ends)."""
    j = stored.withColumn("known", F.lit(True)).join(change, list(keys), "full_outer")
    known = F.coalesce(F.col("known"), F.lit(False))
    total = _zero("refcount") + _zero("delta")
    touched = F.col("delta").isNotNull()
    none = F.lit(None).cast("timestamp")
    return j.select(
        *keys,
        total.alias("refcount"),
        F.when(known, F.col("start_ts")).otherwise(run_ts).alias("start_ts"),
        F.when(known & touched & (_zero("refcount") == 0), run_ts).otherwise(F.col("restart_ts")).alias("restart_ts"),
        F.when(known & touched, F.when(total == 0, run_ts).otherwise(none)).otherwise(F.col("end_ts")).alias("end_ts"),
    )


def track_version_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["repo", "trackname", "version"]
    a = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("old_n"))
    b = class_mask(new, *keys).withColumnRenamed("refcount", "new_n")
    return a.join(b, keys, "full_outer").select(*keys, (_zero("new_n") - _zero("old_n")).alias("delta"), _zero("any_statuses").alias("any_statuses"), _zero("any_flags").alias("any_flags"))


def merged_track_versions(stored: DataFrame, change: DataFrame, run_ts: Column) -> DataFrame:
    """Statuses and flags only ever gather; the rest follows ``merged_tracks``."""
    keys = ["repo", "trackname", "version"]
    c = change.select(*keys, "delta", F.col("any_statuses").alias("s"), F.col("any_flags").alias("f"))
    j = stored.withColumn("known", F.lit(True)).join(c, keys, "full_outer")
    total = _zero("refcount") + _zero("delta")
    known = F.coalesce(F.col("known"), F.lit(False))
    differs = known & ((F.col("any_statuses") != F.col("s")) | (F.col("any_flags") != F.col("f")) | (F.col("delta") != 0))
    return j.select(
        *keys,
        _zero("any_statuses").bitwiseOR(_zero("s")).alias("any_statuses"),
        _zero("any_flags").bitwiseOR(_zero("f")).alias("any_flags"),
        total.alias("refcount"),
        F.when(known, F.col("start_ts")).otherwise(run_ts).alias("start_ts"),
        F.when(F.coalesce(differs, F.lit(False)), F.when(total == 0, run_ts)).otherwise(F.col("end_ts")).alias("end_ts"),
    )


def ignored_by_masks(statuses: Column, flags: Column) -> Column:
    s = sum(1 << c for c in (3, 7, 8, 9, 10))
    f = FLAG["ignore"] | FLAG["incorrect"] | FLAG["untrusted"] | FLAG["noscheme"] | FLAG["rolling"]
    return (statuses.bitwiseAND(F.lit(s)) != 0) | (flags.bitwiseAND(F.lit(f)) != 0)


def releases(incoming: DataFrame, track_versions: DataFrame) -> DataFrame:
    """First and last time of each version of a project over all its tracks, trusted or not."""
    return releases_by_project(of_projects(incoming, track_versions))


def of_projects(incoming: DataFrame, track_versions: DataFrame) -> DataFrame:
    """Track versions with the projects that have their tracks."""
    return incoming.select("effname", "repo", "trackname").distinct().join(track_versions, ["repo", "trackname"])


def releases_by_project(track_versions: DataFrame) -> DataFrame:
    """The releases of track versions that name their project. Where these lie by project, they stay there."""
    ignored = ignored_by_masks(F.col("any_statuses"), F.col("any_flags"))
    return track_versions.groupBy("effname", "version").agg(
        F.min("start_ts").alias("start_ts"),
        F.min(F.when(~ignored, F.col("start_ts"))).alias("trusted_start_ts"),
        F.max("end_ts").alias("end_ts"),
    )


def merged_releases(stored: DataFrame, track_versions: DataFrame) -> DataFrame:
    """Stored releases widened by those of fresh track versions, which name their project. A trusted start that has become an ignored one,
    and is that of no trusted track version, is set anew.

    Both sides are grouped together: a join by project and version would deal out anew what lies by project already.
    """
    keys = ["effname", "version"]
    ignored = ignored_by_masks(F.col("any_statuses"), F.col("any_flags"))
    start = F.col("start_ts")
    fresh = track_versions.select(*keys, start, F.when(~ignored, start).alias("trusted_start_ts"), "end_ts", F.when(ignored, start).alias("ignored_start_ts"), F.lit(True).alias("fresh"))
    known = stored.select(*keys, "start_ts", "trusted_start_ts", "end_ts", F.lit(None).cast("timestamp").alias("ignored_start_ts"), F.lit(False).alias("fresh"))
    rows = known.unionByName(fresh).withColumn("was", F.max(F.when(~F.col("fresh"), F.col("trusted_start_ts"))).over(Window.partitionBy(*keys)))
    trusted = F.when(F.col("fresh"), F.col("trusted_start_ts"))
    found = lambda c: F.coalesce(F.max(c == F.col("was")), F.lit(False))
    return rows.groupBy(*keys).agg(
        F.min("start_ts").alias("start_ts"),
        F.when(found(F.col("ignored_start_ts")) & ~found(trusted), F.min(trusted)).otherwise(F.min("trusted_start_ts")).alias("trusted_start_ts"),
        F.max("end_ts").alias("end_ts"),
    )


def _sorted_set(value: str, when: Column) -> Column:
    """Distinct values in text order where the condition holds; null where it never does."""
    found = F.sort_array(F.collect_set(F.when(when, F.col(value))))
    return F.when(F.size(found) > 0, found)


def _is(*classes: int) -> Column:
    return F.col("versionclass").isin(*classes)


def devel_or_newest() -> tuple[Column, Column]:
    """Whether a package is the newest of the devel, or of the stable, section; unique ones by their flag."""
    devel = has("flags", "devel")
    return _is(STATUS["devel"]) | (_is(STATUS["unique"]) & devel), _is(STATUS["newest"]) | (_is(STATUS["unique"]) & ~devel)


def added(old: Column, new: Column, active: Column | None = None) -> Column:
    """(new - old), of active repositories only; null if either is null."""
    out = F.array_except(new, old)
    return out if active is None else F.array_intersect(out, active)


def project_states(packages: DataFrame) -> DataFrame:
    devel, newest = devel_or_newest()
    return packages.groupBy("effname").agg(
        _sorted_set("version", devel).alias("devel_versions"),
        _sorted_set("repo", devel).alias("devel_repos"),
        _sorted_set("version", newest).alias("newest_versions"),
        _sorted_set("repo", newest).alias("newest_repos"),
        _sorted_set("repo", F.lit(True)).alias("all_repos"),
    )


EVENT = ("type", "branch", "versions", "repos", "repos_removed", "passed")


def project_events(old: DataFrame, new: DataFrame, releases: DataFrame | None = None, run_ts: Column | None = None, cutoff: Column | None = None) -> DataFrame:
    """(effname, type, branch, versions, repos, repos_removed, passed) of all changed projects.

    Types are history_start, history_end, repos_update, version_update and catch_up. ``passed`` is the seconds
    since the trusted start of the version that was first before, if a repository of it was seen before.
    """
    a, b = project_states(old), project_states(new)
    fields = a.columns[1:]
    d = a.select("effname", F.lit(True).alias("was"), *[F.col(c).alias(f"old_{c}") for c in fields]).join(b.withColumn("now", F.lit(True)), "effname", "full_outer")
    was, now = F.col("was").isNotNull(), F.col("now").isNotNull()
    gained, lost = added(F.col("old_all_repos"), F.col("all_repos")), added(F.col("all_repos"), F.col("old_all_repos"))
    none_text, none_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def event(when: Column, kind: str, branch=none_text, versions=none_list, repos=none_list, removed=none_list, prev=none_text) -> Column:
        made = F.struct(F.lit(kind).alias("type"), branch.alias("branch"), versions.alias("versions"), repos.alias("repos"), removed.alias("repos_removed"), prev.alias("prev"))
        return F.when(when, made)

    events = [
        event(~was, "history_start", versions=F.col("newest_versions"), repos=F.col("all_repos")),
        event(~now, "history_end", repos=F.col("old_all_repos")),
        event(was & now & (gained != lost), "repos_update", repos=gained, removed=lost),
    ]
    for branch in ("devel", "newest"):
        changed = version_set_changed(F.col(f"old_{branch}_versions"), F.col(f"{branch}_versions"))
        seen = F.coalesce(F.arrays_overlap(f"{branch}_repos", "old_all_repos"), F.lit(False))
        prev = F.when(seen, F.get(F.col(f"old_{branch}_versions"), F.lit(0)))
        caught = added(F.col(f"old_{branch}_repos"), F.col(f"{branch}_repos"))
        events.append(event(was & now & changed, "version_update", F.lit(branch), F.col(f"{branch}_versions"), F.col(f"{branch}_repos"), prev=prev))
        events.append(event(was & now & ~changed & (F.size(caught) > 0), "catch_up", F.lit(branch), repos=caught, prev=prev))
    out = d.select("effname", F.explode(F.array_compact(F.array(*events))).alias("e")).select("effname", "e.*")
    if releases is None:
        return out.drop("prev")
    known = releases.select("effname", F.col("version").alias("prev"), "trusted_start_ts")
    passed = (F.unix_micros(run_ts) - F.unix_micros("trusted_start_ts")) / 1e6
    limit = F.lit(0.0) if cutoff is None else cutoff
    return out.join(known, ["effname", "prev"], "left").select("effname", *EVENT[:-1], F.when(passed >= limit, passed).alias("passed"))


def status_events(old: DataFrame, new: DataFrame, keys: list[str], repositories: DataFrame | None = None) -> DataFrame:
    """(keys, type, version) where keys are effname, repo and perhaps maintainer: removed, added, and uptodate,
    outdated or ignored when the first version of that kind appears or differs.

    ``repositories`` (repo, active, incomplete) restricts events to active ones; incomplete ones add and remove nothing.
    """
    kinds = {"uptodate": UPTODATE, "outdated": (STATUS["outdated"],), "ignored": PROBLEMATIC}

    fresh = F.col("fresh")
    first = lambda side, c: F.min(F.when(side & _is(*c), F.col("version")))
    found = [F.when(F.bool_or(~fresh), True).alias("was"), F.when(F.bool_or(fresh), True).alias("now")]
    found += [first(fresh, c).alias(k) for k, c in kinds.items()] + [first(~fresh, c).alias(f"old_{k}") for k, c in kinds.items()]
    d = _grouped(*[df.select(*keys, "version", "versionclass") for df in (old, new)], keys, found)
    complete = F.lit(True)
    if repositories is not None:
        d = d.join(repositories.filter("active").select("repo", "incomplete"), "repo")  # by Spark's own choice of size
        complete = ~F.col("incomplete")
    was, now = F.col("was").isNotNull(), F.col("now").isNotNull()
    nothing = F.lit(None).cast("string")
    events = [F.when(~now & complete, F.struct(F.lit("removed").alias("type"), nothing.alias("version"))), F.when(~was & complete, F.struct(F.lit("added").alias("type"), nothing.alias("version")))]
    for k in kinds:
        fires = F.col(k).isNotNull() & (~was | ~F.col(f"old_{k}").eqNullSafe(F.col(k)))
        events.append(F.when(fires, F.struct(F.lit(k).alias("type"), F.col(k).alias("version"))))
    return d.select(*keys, F.explode(F.array_compact(F.array(*events))).alias("e")).select(*keys, "e.type", "e.version")


def global_events(old: DataFrame, new: DataFrame, projects: DataFrame) -> DataFrame:
    """(effname, type, spread, versions, repos) of projects outside shadow repositories whose first newest or
    devel version changed; versions of other schemes are left out, and so are repositories that only ignore."""
    devel, newest = devel_or_newest()
    main = ~has("flags", "altver", "altscheme")
    honest = ~has("flags", "ignore", "incorrect", "untrusted")

    def state(df: DataFrame, prefix: str = "") -> DataFrame:
        cols = []
        for name, cond in (("devel", devel), ("newest", newest)):
            cols += [_sorted_set("version", cond).alias(f"{prefix}{name}_versions"), _sorted_set("repo", cond & honest).alias(f"{prefix}{name}_repos")]
        return df.filter(main).groupBy("effname").agg(*cols)

    d = state(old, "old_").join(state(new), "effname", "right")
    events = []
    for name in ("newest", "devel"):
        changed = version_set_changed(F.col(f"old_{name}_versions"), F.col(f"{name}_versions")) & F.col(f"{name}_versions").isNotNull()
        events.append(F.when(changed, F.struct(F.lit(f"{name}_update").alias("type"), F.col(f"{name}_versions").alias("versions"), F.col(f"{name}_repos").alias("repos"))))
    open_ones = projects.filter("num_repos_nonshadow > 0").select("effname", F.col("num_families").alias("spread"))
    out = d.select("effname", F.explode(F.array_compact(F.array(*events))).alias("e"))
    return out.join(open_ones, "effname").select("effname", "e.type", "spread", "e.versions", "e.repos")


def turnover(old: DataFrame, new: DataFrame, tracks: DataFrame, run_ts: Column) -> DataFrame:
    """(effname, family, delta): -1 if all tracks of a project's family ended in this run, +1 if all (re)started."""
    keys = ["repo", "trackname"]
    ended = old.select("effname", "family", *keys).distinct().join(tracks, keys).groupBy("effname", "family").agg(F.every(F.coalesce(F.col("end_ts") == run_ts, F.lit(False))).alias("all"))
    began = new.select("effname", "family", *keys).distinct().join(tracks, keys).groupBy("effname", "family").agg(F.every(F.coalesce(F.coalesce("restart_ts", "start_ts") == run_ts, F.lit(False))).alias("all"))
    return ended.filter("all").select("effname", "family", F.lit(-1).alias("delta")).unionByName(began.filter("all").select("effname", "family", F.lit(1).alias("delta")))


def redirects(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, trackname, effname, is_actual) where a track changed its project."""
    keys = ["repo", "trackname", "effname"]
    a = old.select(*keys).distinct().withColumn("was", F.lit(True))
    b = new.select(*keys).distinct().withColumn("now", F.lit(True))
    moved = a.join(b, keys, "full_outer").filter("was is null or now is null")
    n = F.count(F.lit(1)).over(Window.partitionBy("repo", "trackname"))
    return moved.withColumn("n", n).filter("n > 1").select(*keys, F.col("now").isNotNull().alias("is_actual"))


def derived_redirects(redirects: DataFrame, projects: DataFrame, suffix: str = "-unclassified") -> DataFrame:
    """Redirects that left ``x-unclassified`` also hold for a project x that is there, unless x has them."""
    left = redirects.filter(F.col("effname").endswith(suffix) & ~F.col("is_actual"))
    base = left.withColumn("effname", F.expr(f"substring(effname, 1, length(effname) - {len(suffix)})"))
    return base.join(projects.select("effname").distinct(), "effname", "left_semi").join(redirects, ["repo", "trackname", "effname"], "left_anti").select(*redirects.columns)


def thinned(history: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """History without the rows that equal both neighbours; a null field equals nothing."""
    w = Window.partitionBy(key).orderBy(ts)
    same = F.lit(True)
    for f in fields:
        same = same & (F.col(f) == F.lead(f).over(w)) & (F.col(f) == F.lag(f).over(w))
    return history.withColumn("_same", F.coalesce(same, F.lit(False))).filter(~F.col("_same")).drop("_same")


def retained_runs(runs: DataFrame, run_ts: Column, keep_failed: int = 31, keep_all: int = 3, keep_latest: int = 20) -> DataFrame:
    """Runs (id, repository, type, status, start_ts) that stay: recent ones, failed and last ones of their kind for
    longer, and the latest of each repository."""
    latest = F.row_number().over(Window.partitionBy("repository").orderBy(F.col("start_ts").desc(), F.col("id").desc()))
    of_kind = F.row_number().over(Window.partitionBy("repository", "type", "status").orderBy(F.col("start_ts").desc(), F.col("id").desc()))
    age = lambda days: F.col("start_ts") > run_ts - F.expr(f"INTERVAL '{days}' DAY")
    rows = runs.withColumns({"_depth": latest, "_kind": of_kind})
    return rows.filter(((F.col("status") == "failed") & age(keep_failed)) | (age(keep_failed) & (F.col("_kind") == 1)) | age(keep_all) | (F.col("_depth") <= keep_latest)).drop("_depth", "_kind")
