"""The package view of the driver's tables, two snapshots of it, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.classify import classify

OLD = "pk % 89 <> 0 and not (pk % 4 = 0 and ts >= timestamp '2000-01-01 00:00:00')"
NEW = "pk % 97 <> 0 and not (pk % 4 = 1 and ts < timestamp '1996-01-01 00:00:00')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packages(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Line items as packages: parts are projects, nations repositories, regions families, suppliers maintainers.
    ``more`` are further columns of a line item."""
    name = lambda key: F.concat(F.lit("p"), F.col(key).cast("string")).alias("effname")
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select("n_nationkey", F.lower("n_name").alias("repo"), F.lower("r_name").alias("family"), (F.col("n_nationkey") % 5 == 0).alias("shadow"))
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))  # a few dozen rows
    supplier = supplier.select("s_suppkey", F.lower("s_name").alias("maintainer"), "repo", "family", "shadow")
    part = table(spark, sf_dir, "part").select(name("p_partkey"), F.lower("p_type").alias("category"), F.col("p_size").alias("size"))
    flags = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") >= 6), 4).otherwise(0) + F.when(F.col("l_linenumber") == 7, 2).otherwise(0)
    item = table(spark, sf_dir, "lineitem").select(
        name("l_partkey"),
        "l_suppkey",
        F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string")).alias("version"),
        flags.alias("flags"),
        F.col("l_partkey").alias("pk"),
        F.col("l_shipdate").alias("ts"),
    )
    plain = len(item.columns)
    item = item.select("*", *more)
    # Parts come last and by name: what goes by project afterwards finds its rows dealt out already. Neither side is large a task, so none is sorted.
    joined = item.join(supplier.hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey")).join(part.hint("shuffle_hash"), "effname")
    trackname = F.concat("effname", F.lit("-"), "category").alias("trackname")
    return joined.select("effname", "repo", "family", trackname, "version", "category", "maintainer", "flags", "shadow", "pk", "size", "ts", *item.columns[plain:])


def old_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages(spark, sf_dir).filter(OLD)


def new_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages(spark, sf_dir).filter(NEW)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both snapshots, classified.

    They are two sides of one view: line items meet suppliers and parts once for both, since the shuffles below the sides are the same
    and Spark makes them once. Two filters would be pushed below the shuffles, which would make them twice.
    """
    sides = F.expr(f"case when {OLD} then 1 else 0 end + case when {NEW} then 2 else 0 end").alias("sides")
    view = packages(spark, sf_dir, sides)
    both = view.select(*[c for c in view.columns if c != "sides"], F.explode(F.expr("case sides when 1 then array(1) when 2 then array(2) when 3 then array(1, 2) end")).alias("side"))
    old, new = (both.filter(F.col("side") == n).drop("side") for n in (1, 2))
    return classify(old), classify(new)


def new_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new snapshot alone, classified."""
    return classify(new_packages(spark, sf_dir))


PKG = """pkg AS (
SELECT concat('p', CAST(l.l_partkey AS VARCHAR)) AS effname, lower(n.n_name) AS repo, lower(r.r_name) AS family,
       concat('p', CAST(l.l_partkey AS VARCHAR), '-', lower(p.p_type)) AS trackname,
       concat(CAST(l.l_linenumber AS VARCHAR), '.', CAST(CAST(l.l_quantity AS INT) AS VARCHAR)) AS version,
       l.l_linenumber * 1000 + CAST(l.l_quantity AS INT) AS version_ord,
       lower(p.p_type) AS category, lower(s.s_name) AS maintainer,
       CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber >= 6 THEN 4 ELSE 0 END + CASE WHEN l.l_linenumber = 7 THEN 2 ELSE 0 END AS flags,
       n.n_nationkey % 5 = 0 AS shadow, l.l_partkey AS pk, p.p_size AS size, l.l_shipdate AS ts
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
OLD_PKG = "old_pkg AS (SELECT * FROM pkg WHERE pk % 89 <> 0 AND NOT (pk % 4 = 0 AND ts >= TIMESTAMP '2000-01-01 00:00:00'))"
NEW_PKG = "new_pkg AS (SELECT * FROM pkg WHERE pk % 97 <> 0 AND NOT (pk % 4 = 1 AND ts < TIMESTAMP '1996-01-01 00:00:00'))"


def classified_sql(source: str, name: str) -> str:
    """CTEs that end in ``name``: ``source`` with versionclass, in the closed form for projects without branches,
    flavours and rare flags (SURVEY section 2.5.2)."""
    p = name
    return f"""
{p}_j AS (SELECT effname, count(*) AS n, count(DISTINCT family) AS nf, min(CASE WHEN (flags & 60) <> 0 THEN 1 ELSE 0 END) AS all_ign, max(flags & 32) AS any_nos FROM {source} GROUP BY effname),
{p}_g AS (SELECT p.effname, p.version_ord AS v, max(CASE WHEN (p.flags & 2) <> 0 THEN 1 ELSE 0 END) AS dev,
  CASE WHEN max(j.n) <= 1 OR (max(j.nf) = 1 AND max(j.all_ign) = 1 AND max(j.any_nos) = 0) THEN 0 ELSE min(CASE WHEN (p.flags & 60) <> 0 THEN 1 ELSE 0 END) END AS ign
  FROM {source} p JOIN {p}_j j ON p.effname = j.effname GROUP BY p.effname, p.version_ord),
{p}_s AS (SELECT effname, max(CASE WHEN ign = 0 AND dev = 0 THEN v END) AS s1 FROM {p}_g GROUP BY effname),
{p}_d AS (SELECT g.effname, max(g.v) AS df, min(g.v) AS dl FROM {p}_g g JOIN {p}_s st ON g.effname = st.effname WHERE g.ign = 0 AND (st.s1 IS NULL OR g.v > st.s1) GROUP BY g.effname),
{p}_f AS (SELECT g.effname, max(CASE WHEN g.dev = 0 AND NOT coalesce(g.v >= dv.dl, FALSE) THEN g.v END) AS fv FROM {p}_g g LEFT JOIN {p}_d dv ON g.effname = dv.effname GROUP BY g.effname),
{p}_x AS (SELECT p.*, j.nf, CASE WHEN coalesce(p.version_ord <= f.fv, FALSE) THEN 1 ELSE 0 END AS sec,
  CASE WHEN coalesce(p.version_ord <= f.fv, FALSE) THEN st.s1 ELSE dv.df END AS best
  FROM {source} p JOIN {p}_j j ON p.effname = j.effname JOIN {p}_s st ON p.effname = st.effname JOIN {p}_f f ON p.effname = f.effname LEFT JOIN {p}_d dv ON p.effname = dv.effname),
{p}_y AS (SELECT *, max(CASE WHEN version_ord <= best THEN version_ord END) OVER (PARTITION BY effname, repo, sec) AS mx FROM {p}_x),
{name} AS (SELECT effname, repo, family, trackname, version, version_ord, category, maintainer, flags, shadow, pk, size, ts, CAST(CASE
  WHEN best IS NULL OR version_ord > best THEN CASE WHEN (flags & 32) <> 0 THEN 9 WHEN (flags & 8) <> 0 THEN 7 WHEN (flags & 16) <> 0 THEN 8 WHEN (flags & 4) <> 0 THEN 3 ELSE 2 END
  WHEN version_ord = best THEN CASE WHEN nf = 1 THEN 4 WHEN sec = 1 THEN 1 ELSE 5 END
  WHEN version_ord < mx THEN 6 ELSE 2 END AS INT) AS versionclass FROM {p}_y)"""


def with_sql(query: str, *, old: bool = False, new: bool = False, all_packages: bool = False) -> str:
    """A DuckDB query over ``old_c``, ``new_c`` or ``all_c``: classified snapshots or the whole view."""
    parts = [PKG]
    if all_packages:
        parts.append(classified_sql("pkg", "all_c"))
    if old:
        parts += [OLD_PKG, classified_sql("old_pkg", "old_c")]
    if new:
        parts += [NEW_PKG, classified_sql("new_pkg", "new_c")]
    body = query.strip()
    joined = ",\n".join(parts)
    return f"WITH {joined},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {joined}\n{body}"
