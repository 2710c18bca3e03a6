"""Package catalogs and package lists as relations, with their checks as rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.code import canonical_name, is_http_url, is_kebab, is_sha256_field, requirement_parts, version_key, version_specifier, wheel_parts
from loomspark.operators.ordinals import with_ordinal


def catalog_entries(catalog: DataFrame) -> DataFrame:
    """A row for each plugin of each package, in their order."""
    packages = catalog.select("schema_version", F.posexplode("packages").alias("package_pos", "p"))
    return packages.select("schema_version", "package_pos", "p", F.posexplode("p.plugins").alias("plugin_pos", "g")).select(
        "schema_version", "package_pos", "plugin_pos", F.col("p.name").alias("package"), F.col("p.description").alias("description"),
        F.col("p.install.requirement").alias("requirement"), F.col("p.install.index_url").alias("index_url"), F.col("p.compatibility.python.specifier").alias("python"),
        F.col("p.docs.url").alias("docs_url"), F.col("g.name").alias("plugin"), F.col("g.plugin_type").alias("plugin_type"),
        F.col("g.entry_point.group").alias("entry_group"), F.col("g.entry_point.name").alias("entry_name"), F.col("g.entry_point.value").alias("entry_value"),
    )


def grouped_catalog(entries: DataFrame) -> DataFrame:
    """Entries back as packages with their plugins."""
    plugin = F.struct("plugin_pos", F.col("plugin").alias("name"), "plugin_type", F.struct(F.col("entry_group").alias("group"), F.col("entry_name").alias("name"), F.col("entry_value").alias("value")).alias("entry_point"))
    out = entries.groupBy("package_pos", "package", "description", "requirement", "index_url", "docs_url").agg(F.array_sort(F.collect_list(plugin)).alias("plugins"))  # of a package
    return out.withColumn("plugins", F.transform("plugins", lambda p: p.dropFields("plugin_pos")))


def repeated_names(entries: DataFrame, name: str = "plugin") -> DataFrame:
    """(name, count) of names that occur more than once."""
    return entries.groupBy(name).agg(F.count("*").alias("count")).where("count > 1")


def inconsistent(entries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) for each field that has several values, null being one, within a key."""
    counts = entries.groupBy(key).agg(*[F.count_distinct(F.struct(f)).alias(f) for f in fields])
    return counts.select(key, F.explode(F.filter(F.array(*[F.when(F.col(f) > 1, F.lit(f)) for f in fields]), lambda x: x.isNotNull())).alias("field"))


def catalog_errors(entries: DataFrame) -> DataFrame:
    """(package, plugin, error) for each rule that an entry breaks."""
    needs = requirement_parts(F.col("requirement"))
    rules = {
        "unsupported schema version": F.coalesce(F.col("schema_version"), F.lit(-1)) != 2,
        "package has no name": F.coalesce(F.trim("package"), F.lit("")) == "",
        "plugin name is not kebab-case": ~F.coalesce(is_kebab(F.col("plugin")), F.lit(False)),
        "requirement is malformed": needs.isNull(),
        "requirement names another package": needs["name"] != canonical_name(F.col("package")),
        "python specifier is malformed": F.col("python").isNotNull() & version_specifier(F.col("python")).isNull(),
        "index url is not http": F.col("index_url").isNotNull() & ~is_http_url(F.col("index_url")),
        "docs url is not http": F.col("docs_url").isNotNull() & ~is_http_url(F.col("docs_url")),
    }
    found = F.filter(F.array(*[F.when(cond, F.lit(text)) for text, cond in rules.items()]), lambda x: x.isNotNull())
    return entries.select("package", "plugin", F.explode(found).alias("error"))


def compatibility_errors(entries: DataFrame, distribution: str) -> DataFrame:
    """(package, error) where a package's host requirement, specifier and marker (host_requirement, host_specifier, host_marker) don't agree."""
    needs = requirement_parts(F.col("host_requirement"))
    rules = {
        "requirement is malformed": needs.isNull(),
        "requirement names another distribution": needs["name"] != distribution,
        "requirement has no version": needs.isNotNull() & needs["specifier"].isNull(),
        "specifier is malformed": version_specifier(F.col("host_specifier")).isNull(),
        "specifier differs from the requirement's": version_specifier(F.col("host_specifier")) != needs["specifier"],
        "marker differs from the requirement's": needs.isNotNull() & ~F.col("host_marker").eqNullSafe(needs["marker"]),
    }
    found = F.filter(F.array(*[F.when(cond, F.lit(text)) for text, cond in rules.items()]), lambda x: x.isNotNull())
    return entries.select("package", F.explode(found).alias("error")).distinct()


def key_differences(objects: DataFrame, keys: str, required: list[str], optional: list[str] | None = None) -> DataFrame:
    """objects with missing and unknown: the required keys that an array of keys lacks, and those it has that are neither required nor optional."""
    known = F.array(*[F.lit(k) for k in [*required, *(optional or [])]])
    return objects.withColumns({"missing": F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), keys)), "unknown": F.array_sort(F.array_except(keys, known))})


def install_target(package: Column, requirement: Column, index_url: Column) -> Column:
    """struct(target, index_url) to install a package by; null where the requirement is another package's, or the index no http address."""
    good = (requirement_parts(requirement)["name"] == canonical_name(package)) & (index_url.isNull() | is_http_url(index_url))
    return F.when(good, F.struct(requirement.alias("target"), index_url.alias("index_url")))


def catalog_document(entries: DataFrame) -> str:
    """Entries as the catalog's JSON document, packages and plugins by name, with two spaces of indentation; it is as long as the catalog."""
    rows = grouped_catalog(entries).orderBy("package").collect()
    packages = [
        {
            "name": r["package"], "description": r["description"], "install": {k: v for k, v in (("requirement", r["requirement"]), ("index_url", r["index_url"])) if v is not None},
            "docs": {"url": r["docs_url"]}, "plugins": [p.asDict(recursive=True) for p in sorted(r["plugins"], key=lambda p: p["name"])],
        }
        for r in rows
    ]
    return json.dumps({"schema_version": 2, "packages": packages}, indent=2, ensure_ascii=False) + "\n"


def catalog_changes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(package, entry_name, state) where a stored catalog's entries aren't those that the packages give: missing, stale or changed."""
    shared = [c for c in expected.columns if c in actual.columns and c not in ("package", "entry_name", "package_pos", "plugin_pos")]
    e, a = (df.select("package", "entry_name", F.to_json(F.struct(*shared)).alias(x)) for df, x in ((expected, "e"), (actual, "a")))
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "stale").when(F.col("e") != F.col("a"), "changed")
    return e.join(a, ["package", "entry_name"], "full_outer").select("package", "entry_name", state.alias("state")).where("state is not null")


def release_comparison(packages: DataFrame, entries: DataFrame) -> DataFrame:
    """(package, error) where the catalog's entries don't agree with packages to be released.

    packages has package, description, requires_python, docs_url and
    entry_points (a map); all fields are compared as the catalog has them.
    """
    own = packages.select(
        "package", F.col("description").alias("o_description"), version_specifier(F.col("requires_python")).alias("o_python"), F.col("docs_url").alias("o_docs"), F.col("entry_points").alias("o_points"),
    )
    both = own.join(entries, "package")
    point = F.try_element_at("o_points", F.col("entry_name"))
    rules = {
        "description is stale": ~F.col("description").eqNullSafe(F.col("o_description")),
        "python specifier is stale": ~version_specifier(F.col("python")).eqNullSafe(F.col("o_python")),
        "docs url is stale": ~F.col("docs_url").eqNullSafe(F.col("o_docs")),
        "entry point is not declared": point.isNull(),
        "entry point has another value": point != F.col("entry_value"),
    }
    found = F.filter(F.array(*[F.when(cond, F.lit(text)) for text, cond in rules.items()]), lambda x: x.isNotNull())
    stale = both.select("package", F.explode(found).alias("error"))
    absent = own.join(entries, "package", "left_anti").select("package", F.lit("not in the catalog").alias("error"))
    declared = own.join(entries, "package", "left_semi").select("package", F.explode(F.map_keys("o_points")).alias("entry_name"))
    lacking = declared.join(entries.select("package", "entry_name"), ["package", "entry_name"], "left_anti").select("package", F.lit("entry point is not in the catalog").alias("error"))
    return stale.union(absent).union(lacking).distinct()


def release_errors(packages: DataFrame, distribution: str, ref_template: str) -> DataFrame:
    """(package, error) for each rule that a package to be released breaks, all of them at once.

    packages has package, folder, version, tag_version, description, license,
    readme, authors, requires_python, dependencies, entry_points and owners (as
    CODEOWNERS has them).
    """
    from loomspark.functions.code import is_release_owner, is_version

    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    host = F.filter(F.transform("dependencies", requirement_parts), lambda r: r["name"] == distribution)
    ref = F.replace(F.replace(F.lit(ref_template), F.lit("{package}"), F.col("package")), F.lit("{version}"), F.col("version"))
    rules = {
        "name differs from the folder's": F.col("package") != F.col("folder"),
        "version is malformed": ~is_version(F.col("version")),
        "tag version is malformed": ~is_version(F.col("tag_version")),
        "version differs from the tag's": F.col("version") != F.col("tag_version"),
        "no description": empty("description"),
        "no license": empty("license"),
        "no readme": empty("readme"),
        "no authors": F.coalesce(F.size("authors"), F.lit(0)) < 1,
        "requires-python is malformed": version_specifier(F.col("requires_python")).isNull(),
        "no dependency on the host": F.coalesce(F.size(host), F.lit(0)) < 1,
        "dependency on the host has no version": (F.size(host) > 0) & ~F.exists(host, lambda r: r["specifier"].isNotNull()),
        "no entry points": F.coalesce(F.size("entry_points"), F.lit(0)) < 1,
        "release ref differs from the template's": F.concat(F.col("folder"), F.lit("/v"), F.col("tag_version")) != ref,
        "no owner who can release": ~F.exists(F.coalesce("owners", F.array().cast("array<string>")), is_release_owner),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for text, cond in rules.items()]), lambda x: x.isNotNull())
    return packages.select("package", F.explode(found).alias("error"))


def registered(catalog: DataFrame, new: DataFrame, name: str, replace: bool = False) -> DataFrame:
    """The catalog's entries with package name's put in, in place of any it has; without replace, having any is an error."""
    if not replace and not catalog.where(F.col("package") == name).isEmpty():
        raise ValueError(f"package {name} is registered")
    return catalog.where(F.col("package") != name).unionByName(new)


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys right lacks."""
    return left.join(right, keys, "left_anti")


def merged_package_lists(old: DataFrame, new: DataFrame) -> DataFrame:
    """Package lists (filename, hash, requires_python) as one; a file with different bytes or requirements on either side is an error."""
    o, n = (df.select("filename", F.col("hash").alias(f"{x}_hash"), F.col("requires_python").alias(f"{x}_python")) for df, x in ((old, "old"), (new, "new")))
    both = o.join(n, "filename", "full_outer")
    clash = F.when(F.col("old_hash") != F.col("new_hash"), F.lit("different bytes")).when(F.col("old_python") != F.col("new_python"), F.lit("different requirements"))
    text = F.concat(F.col("filename"), F.lit(": "), clash)
    return both.select("filename", F.when(clash.isNotNull(), F.raise_error(text).cast("string")).otherwise(F.coalesce("old_hash", "new_hash")).alias("hash"), F.coalesce("old_python", "new_python").alias("requires_python"))


def package_row_errors(filename: str = "filename", hash_: str = "hash", requires: str = "requires_python") -> Column:
    """The rules that a row of a package list breaks, as an array of texts."""
    rules = {
        "no file name": F.coalesce(F.col(filename), F.lit("")) == "",
        "file name has a path": F.col(filename).rlike(r"[/\\]"),
        "not a package file": ~F.col(filename).rlike(r"[/\\]") & wheel_parts(F.col(filename)).isNull(),
        "hash is not sha256": ~F.coalesce(is_sha256_field(F.col(hash_)), F.lit(False)),
        "requires_python is malformed": F.col(requires).isNotNull() & version_specifier(F.col(requires)).isNull(),
    }
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for text, cond in rules.items()]), lambda x: x.isNotNull())


def package_list_errors(rows: DataFrame) -> DataFrame:
    """(filename, error) for each rule that a row breaks."""
    return rows.select("filename", F.explode(package_row_errors()).alias("error"))


def placed_package_list(rows: DataFrame, name: str = "place") -> DataFrame:
    """rows with their 0-based places in the order of sorted_package_list, without a global sort in one task."""
    parts = wheel_parts(F.col("filename"))
    return with_ordinal(rows.withColumns({"_n": parts["name"], "_v": version_key(parts["version"])}), ["_n", "_v", "filename"], name).drop("_n", "_v")


def sorted_package_list(rows: DataFrame) -> DataFrame:
    """By package, version (as PEP 440 orders them), file name."""
    parts = wheel_parts(F.col("filename"))
    return rows.withColumns({"_n": parts["name"], "_v": version_key(parts["version"])}).orderBy("_n", "_v", "filename").drop("_n", "_v")


def tree_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state) of trees (path, sha): missing, stale or outdated."""
    e, a = expected.select("path", F.col("sha").alias("e")), actual.select("path", F.col("sha").alias("a"))
    both = e.join(a, "path", "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "stale").when(F.col("e") != F.col("a"), "outdated")
    return both.select("path", state.alias("state")).where("state is not null")


def package_list_lines(rows: DataFrame) -> DataFrame:
    """A package list's lines, in order: compact JSON with sorted keys, nulls left out."""
    return sorted_package_list(rows).select(F.to_json(F.struct("filename", "hash", "requires_python")).alias("value"))


def header_counts(files: DataFrame, state: str = "state") -> DataFrame:
    """One row: files looked at, to be updated, and left as they are, by header_state."""
    return files.agg(F.count("*").alias("processed"), F.count_if(F.col(state) != "match").alias("updated"), F.count_if(F.col(state) == "match").alias("skipped"))


def ownership_lines(packages: DataFrame) -> DataFrame:
    """(package, line): the owners of each package's folder as a line of a common CODEOWNERS, by package; packages without any have none."""
    owned = packages.where(F.size("owners") > 0)
    return owned.select("package", F.concat(F.lit("/plugins/"), "package", F.lit("/ "), F.array_join("owners", " ")).alias("line")).orderBy("package")
