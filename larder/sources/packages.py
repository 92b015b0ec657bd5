"""Raw records to packages: normalised fields, mapped names, defaults of the repository."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import normalize
from larder.functions.link_templates import merged_links
from larder.functions.normalize import FIELD, mapped_maintainers, or_null
from larder.operators import rules as rule_language
from larder.schema import CPE_FIELDS, FLAG, LINK_TYPE, PACKAGE, RAW
from larder.sources.names import ROLES, kinds_of, mapped_names



@dataclass(frozen=True)
class Repository:
    """What the configuration says of a repository."""

    name: str
    family: str
    subrepo: str | None = None
    shadow: bool = False
    default_maintainer: str | None = None
    groups: tuple[str, ...] = ()
    rulesets: tuple[str, ...] = ()
    #: (link type, priority, template) of links that every package has.
    package_links: tuple[tuple[int, int, str], ...] = ()
    minimum: int = 0
    sources: tuple[dict, ...] = field(default=(), hash=False)


def no_texts() -> Column:
    return F.array().cast("array<string>")


def texts(*parts: Column) -> Column:
    """One array of texts out of texts and arrays of texts; nulls and empty ones are left out."""
    arrays = [F.coalesce(p, no_texts()) for p in parts]
    return F.filter(F.concat(*arrays), lambda x: x.isNotNull() & (x != ""))


def one(text: Column) -> Column:
    return F.array(text)


def link(kind: str, *urls: Column) -> Column:
    """Raw links of one kind; arguments are arrays of texts."""
    return F.transform(texts(*urls), lambda u: F.struct(F.lit(LINK_TYPE[kind]).alias("link_type"), u.alias("url")))


def map_of(**values: Column) -> Column:
    """map of the given texts without the null ones."""
    pairs = F.array(*[F.struct(F.lit(k), v.cast("string")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["col2"].isNotNull()))


def flag_if(condition: Column, name: str) -> Column:
    return F.when(condition, FLAG[name]).otherwise(0)


def flags_of(*parts: Column) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out.bitwiseOR(p)
    return out


def raw(records: DataFrame, *, names: dict[str, Column], version: Column, links: list[Column] = (), **fields: Column) -> DataFrame:
    """Records as RAW: the fields given, the rest empty."""
    given = {"names": map_of(**names), "version": version, "links": F.concat(*links) if links else None, **fields}
    out = []
    for f in RAW.fields:
        value = given.pop(f.name, None)
        value = F.lit(None) if value is None else value
        out.append(value.cast(f.dataType).alias(f.name))
    if given:
        raise ValueError(f"unknown fields {sorted(given)}")
    return records.select(*out)


def _cleaned_names(names: Column) -> Column:
    clean = F.transform_values(names, lambda _, v: FIELD["name"](v)["value"])
    return F.map_filter(clean, lambda _, v: v.isNotNull() & (v != ""))


def version_of(version: Column) -> Column:
    return F.nullif(FIELD["version"](version)["value"], F.lit(""))


def mapped(records: DataFrame) -> DataFrame:
    """Records with the five names (_names), the version (_version), and why there is no package (_problem; null if there is one)."""
    given = F.coalesce("names", F.create_map().cast("map<string,string>"))
    step = records.withColumns({"_clean": _cleaned_names(given), "_version": version_of(F.col("version"))}).withColumn("_kinds", kinds_of(F.col("_clean")))
    step = step.withColumn("_names", mapped_names(F.col("_clean"), F.col("_kinds"))).drop("_clean", "_kinds")
    kinds = F.coalesce(F.array_join(F.array_sort(F.map_keys("names")), ", "), F.lit(""))
    return step.withColumn("_problem", F.when(F.col("_names").isNull(), F.concat(F.lit("unknown set of names: "), kinds)).when(F.col("_version").isNull(), F.lit("no version")))


def make_packages(records: DataFrame, repository: Repository, on_failure: str = "raise") -> DataFrame:
    """RAW records as packages of a repository.

    A record fails whose names no mapping knows or that has no version left; ``on_failure`` says whether that is
    an error (raise) or the record is left out (skip; ``load_log.rejected`` has it). An empty table gives no packages.
    """
    step = mapped(records)
    problem = F.col("_problem")
    if on_failure == "skip":
        step = step.filter(problem.isNull())
    elif on_failure == "raise":
        step = step.withColumn("_version", F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit(f"{repository.name}: "), problem))).otherwise(F.col("_version")))
    else:
        raise ValueError("on_failure is raise or skip")
    text = lambda c, kind: F.nullif(FIELD[kind](F.col(c))["value"], F.lit(""))
    listed = lambda c, kind: or_null(normalize.values(F.coalesce(F.col(c), no_texts()), FIELD[kind]))
    default = F.lit(None) if repository.default_maintainer is None else F.array(F.lit(repository.default_maintainer))
    columns = {
        "repo": F.lit(repository.name),
        "family": F.lit(repository.family),
        "subrepo": F.coalesce(text("subrepo", "subrepo"), F.lit(repository.subrepo)),
        **{r: F.col("_names")[r] for r in ROLES},
        "binnames": listed("binnames", "name"),
        "origversion": F.col("_version"),
        "version": F.col("_version"),
        "rawversion": F.coalesce(text("rawversion", "version"), F.col("_version")),
        "arch": text("arch", "arch"),
        "maintainers": F.coalesce(listed("maintainers", "maintainer"), default),
        "category": F.get(normalize.values(F.coalesce("categories", no_texts()), FIELD["category"]), F.lit(0)),
        "comment": text("summary", "summary"),
        "licenses": listed("licenses", "license"),
        "extrafields": F.when(F.size("extrafields") > 0, F.col("extrafields")),
        **{f"cpe_{c}": F.try_element_at(F.col("cpe"), F.lit(c)) for c in CPE_FIELDS},
        "links": normalize.links(F.col("links")),
        "effname": F.col("_names")["projectname_seed"],
        "versionclass": F.lit(0),
        "flags": F.coalesce("flags", F.lit(0)),
        "shadow": F.lit(repository.shadow),
        "flavors": normalize.values(F.coalesce("flavors", no_texts()), FIELD["name"]),
    }
    out = []
    for f in PACKAGE.fields:
        value = columns[f.name] if f.name in columns else F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return step.select(*out)


def load(records: DataFrame, repository: Repository, rules: list[dict] = (), hidden: list[str] = (), replaced: dict[str, str] | None = None, on_failure: str = "raise") -> DataFrame:
    """The whole way of a record: package, links of templates, rules, without removed ones, tidy flavours, maintainers.

    One narrow stage without a shuffle, but for long runs of rules with patterns: those look at distinct names.
    """
    packages = make_packages(records, repository, on_failure)
    if repository.package_links:
        named = packages.withColumn("name", F.coalesce("name", "visiblename"))
        packages = named.withColumn("links", or_null(merged_links(F.col("links"), list(repository.package_links)))).withColumn("name", F.lit(None).cast("string"))
    if rules:
        packages = rule_language.without_removed(rule_language.apply_rules(packages, list(rules), set(repository.rulesets)))
    packages = rule_language.tidy_flavors(packages)
    return packages.withColumn("maintainers", mapped_maintainers(F.col("maintainers"), list(hidden), replaced or {}))


def sorted_runs(packages: DataFrame, path: str) -> None:
    """Packages by project, in ranges, so that later steps read whole projects in order."""
    packages.repartitionByRange("effname").sortWithinPartitions("effname").write.mode("overwrite").parquet(path)


def dumped(packages: DataFrame, fields: list[str], separator: str = " ", first: str | None = None, last: str | None = None) -> DataFrame:
    """(line): the given fields of each package in a range of projects as text, lists joined by commas, nulls as a dash."""
    rows = packages
    if first is not None:
        rows = rows.filter(F.col("effname") >= first)
    if last is not None:
        rows = rows.filter(F.col("effname") <= last)

    def shown(name: str) -> Column:
        kind = packages.schema[name].dataType.typeName()
        text = F.array_join(name, ",") if kind == "array" else F.col(name).cast("string")
        return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))

    return rows.select(F.concat_ws(separator, *[shown(f) for f in fields]).alias("line"))
