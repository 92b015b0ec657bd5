"""Dedupe, project hashes and the difference between two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("added", "removed", "changed", "unchanged")


def comparable(df: DataFrame) -> list[Column]:
    """Columns in a form that can be compared and hashed: maps as sorted entries."""
    return [F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields]


def exact_dedupe(packages: DataFrame) -> DataFrame:
    """One of each set of rows that agree in every field."""
    maps = [f.name for f in packages.schema.fields if isinstance(f.dataType, T.MapType)]
    flat = packages.select(*comparable(packages)).distinct()
    return flat.select(*[F.map_from_entries(c).alias(c) if c in maps else F.col(c) for c in packages.columns])


def package_hash(df: DataFrame, ignore: tuple[str, ...] = ("versionclass",)) -> Column:
    """A non-negative hash of a package over all fields but the classification."""
    fields = [c for c, f in zip(comparable(df), df.schema.fields) if f.name not in ignore]
    return F.xxhash64(*fields).bitwiseAND(F.lit(2**63 - 1))


def project_hashes(packages: DataFrame, key: str = "effname") -> DataFrame:
    """(key, hash): the exclusive or of package hashes, whatever their order. Packages must be deduplicated."""
    return packages.select(key, package_hash(packages).alias("h")).groupBy(key).agg(F.bit_xor("h").alias("hash"))


def changes(stored: DataFrame, fresh: DataFrame, key: str = "effname") -> DataFrame:
    """(key, kind) from two tables of hashes; a stored hash of -1 differs from every other."""
    j = stored.select(key, F.col("hash").alias("was")).join(fresh.select(key, F.col("hash").alias("now")), key, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return j.select(key, kind.alias("kind"))


def change_statistics(kinds: DataFrame) -> DataFrame:
    """One row: the number of each kind, and the share of projects that aren't unchanged."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    total = reduce(lambda a, b: a + b, [F.col(k) for k in KINDS])
    return kinds.agg(*counts).withColumn("fraction", F.when(total > 0, (total - F.col("unchanged")) / total).otherwise(0.0))


def forced(hashes: DataFrame, queue: DataFrame, key: str = "effname") -> DataFrame:
    """Hashes of queued projects as -1, so that they count as changed."""
    queued = queue.select(key).distinct().withColumn("queued", F.lit(True))
    return hashes.join(queued, key, "left").select(key, F.when(F.col("queued"), F.lit(-1).cast("long")).otherwise(F.col("hash")).alias("hash"))


def first_changes(kinds: DataFrame, most: int, key: str = "effname") -> DataFrame:
    """The first changes by name, for a limited run."""
    return kinds.filter("kind <> 'unchanged'").orderBy(key).limit(most)


def restricted(packages: DataFrame, changed: DataFrame, key: str = "effname") -> DataFrame:
    return packages.join(changed.select(key).distinct(), key, "left_semi")


def applied(packages: DataFrame, changed: DataFrame, incoming: DataFrame, key: str = "effname") -> DataFrame:
    """The next snapshot: packages of changed projects are replaced by the incoming ones."""
    return packages.join(changed.select(key).distinct(), key, "left_anti").unionByName(incoming)


def missing_minimum(packages: DataFrame, floors: DataFrame) -> DataFrame:
    """(repo, minimum, n): repositories with fewer packages than they should have."""
    n = packages.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    return floors.join(n, "repo", "left").select("repo", "minimum", F.coalesce("n", F.lit(0)).alias("n")).filter("n < minimum")


def oversized(packages: DataFrame, most: int = 20_000) -> DataFrame:
    """Projects with more packages than a project may have."""
    return packages.groupBy("effname").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
