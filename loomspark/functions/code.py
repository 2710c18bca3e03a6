"""Repositories, versions, slugs, urls and ownership as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import base_name, suffix

# Languages by extension and by file name.
LANGUAGES = {
    ".bash": "bash", ".c": "c", ".cc": "cpp", ".cfg": "config", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".go": "go", ".h": "c",
    ".hpp": "cpp", ".html": "html", ".java": "java", ".js": "javascript", ".json": "json", ".jsx": "javascript", ".kt": "kotlin",
    ".kts": "kotlin", ".lua": "lua", ".md": "markdown", ".php": "php", ".py": "python", ".rb": "ruby", ".rs": "rust", ".scala": "scala",
    ".sh": "shell", ".sql": "sql", ".swift": "swift", ".toml": "toml", ".ts": "typescript", ".tsx": "typescript", ".yaml": "yaml",
    ".yml": "yaml", ".zsh": "zsh",
}
LANGUAGES_BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "makefile"}
# Folders whose files aren't code of a repository's own.
EXCLUDED_FOLDERS = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "venv")
DEFAULT_EXCLUDES = [pattern for folder in EXCLUDED_FOLDERS for pattern in (f"{folder}/*", f"**/{folder}/*")]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def code_language(path: Column) -> Column:
    """By the file's name, else its extension, else the extension itself without the dot."""
    name = base_name(path)
    return F.coalesce(F.try_element_at(_map(LANGUAGES_BY_NAME), name), F.try_element_at(_map(LANGUAGES), suffix(name)), F.regexp_replace(suffix(name), r"^\.+", ""))


# Fixed value: what a repository's short name looks like.
REPOSITORY = "^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"


def github_repository(spec: Column) -> Column:
    """owner/name of a repository's short name or address; null where it isn't one. Addresses may have a query; their host is github.com in any case."""
    bare = F.trim(spec)
    web = r"^(?i:https?)://([^/?#]*)([^?#]*)"
    path = F.regexp_replace(F.btrim(F.regexp_extract(bare, web, 2), F.lit("/")), r"\.git$", "")
    other = F.btrim(F.regexp_replace(F.regexp_replace(bare, "^git@github\\.com:", ""), r"\.git$", ""), F.lit("/"))
    name = F.when(bare.rlike(web), F.when(F.lower(F.regexp_extract(bare, web, 1)) == "github.com", path)).otherwise(other)
    return F.when(name.rlike(REPOSITORY), name)


def clone_url(repository: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), repository, F.lit(".git"))


def repository_folder(repository: Column) -> Column:
    return F.replace(repository, F.lit("/"), F.lit("__"))


def is_commit_sha(ref: Column) -> Column:
    return ref.rlike("^[0-9a-fA-F]{7,40}$")


def glob_to_regex(pattern: str) -> str:
    """A case-sensitive glob as an anchored regular expression; * and ? match slashes too."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^{out}$"


def matches_any_glob(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_to_regex(p))
    return out


def normalize_extension(extension: Column) -> Column:
    low = F.lower(F.trim(extension))
    return F.when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low))


def semver_parts(version: Column) -> Column:
    """struct(major, minor, patch) of a plain x.y.z, leading zeros allowed; null for anything else."""
    pattern = r"^([0-9]+)\.([0-9]+)\.([0-9]+)$"
    number = lambda i: F.regexp_extract(version, pattern, i).try_cast("long")
    return F.when(version.rlike(pattern), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def bump_semver(version: Column, part: str) -> Column:
    """The next version; part is major, minor or patch."""
    v = semver_parts(version)
    major, minor, patch = v["major"], v["minor"], v["patch"]
    zero = F.lit(0)
    new = {"major": (major + 1, zero, zero), "minor": (major, minor + 1, zero), "patch": (major, minor, patch + 1)}[part]
    return F.when(v.isNotNull(), F.concat_ws(".", *[x.cast("string") for x in new]))


def destination_path(path: Column, has_index: Column) -> Column:
    """Where a page of documentation goes: a README at the root is the index, unless there is one."""
    return F.when((path == "README.md") & ~has_index, "index.md").otherwise(path)


def page_rank(path: Column) -> Column:
    """0 for index pages, which come first, else 1."""
    return F.when(base_name(path).isin("index.md", "README.md"), 0).otherwise(1)


def quoted(text: Column) -> Column:
    """A text in double quotes, escaped as JSON and TOML do."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def escaped(text: Column) -> Column:
    """A text for HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def markdown_codes(values: Column) -> Column:
    """Values as code in Markdown."""
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: F.concat(F.lit("`"), v, F.lit("`"))), ", ")).otherwise("None declared")


def docs_slug(text: Column, collapse: bool = True) -> Column:
    """A lower-case name for a docs path; runs of other characters become one hyphen, or one each."""
    slug = F.regexp_replace(F.lower(text), r"[^a-z0-9_.-]+" if collapse else r"[^a-z0-9_.-]", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", "plugin").otherwise(slug)


def is_kebab(text: Column) -> Column:
    return text.rlike(r"^[a-z][a-z0-9]*(-[a-z0-9]+)*$")


def underscored(slug: Column) -> Column:
    return F.replace(slug, F.lit("-"), F.lit("_"))


def pascal(slug: Column) -> Column:
    return F.array_join(F.transform(F.split(slug, "-"), F.initcap), "")


def owner_tokens(codeowners: Column) -> Column:
    """Owners in a CODEOWNERS text: words with an at sign, comments left out."""
    lines = F.transform(F.split(codeowners, "\n"), lambda x: F.regexp_replace(x, "#.*$", ""))
    tokens = F.flatten(F.transform(lines, lambda x: F.split(F.trim(x), r"\s+")))
    return F.array_distinct(F.filter(tokens, lambda t: t.contains("@")))


def is_release_owner(token: Column) -> Column:
    """@user or @organisation/team."""
    return token.rlike(r"^@[A-Za-z0-9][A-Za-z0-9-]*(?:/[A-Za-z0-9][A-Za-z0-9_-]*)?$")


def is_sha256_field(value: Column) -> Column:
    return value.rlike("^sha256=[0-9a-fA-F]{64}$")


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def is_hidden_path(path: Column) -> Column:
    """Whether a step of a path is hidden or a cache."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") | (p == "__pycache__"))


def is_header_candidate(path: Column, skip: list[str] | None = None) -> Column:
    out = suffix(base_name(path)).isin(".py", ".sh")
    for s in skip or []:
        out = out & ~path.contains(s)
    return out


def markdown_title(path: Column, text: Column) -> Column:
    """A page's first heading; an index's is Overview, and without one the path is made readable."""
    heading = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?m)^\s*# +(.*?\S)\s*$", 1), r"^#+|#+$", ""))
    words = F.split(F.replace(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit("/"), F.lit(" / ")), "[-_ ]+")
    plain = F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")
    return F.when(base_name(path).isin("index.md", "README.md"), "Overview").when(heading != "", heading).otherwise(plain)


def header_state(text: Column, expected: Column) -> Column:
    """match, mismatch or missing: whether the licence comment within a text's first ten lines is as expected."""
    head = F.slice(F.split(text, "\n"), 1, 10)
    step = lambda a, x: (  # noqa: E731  a: state (0 before, 1 in it, 2 after) and lines
        F.when(a["s"] == 2, a)
        .when(F.lower(x).contains("spdx"), F.when(x.startswith("#"), F.struct(F.lit(1).alias("s"), F.concat(a["h"], F.array(x)).alias("h"))).otherwise(F.struct(F.lit(2).alias("s"), a["h"].alias("h"))))
        .when(a["s"] == 1, F.struct(F.lit(2).alias("s"), a["h"].alias("h")))
        .when((x == "") | x.startswith("#"), a)
        .otherwise(F.struct(F.lit(2).alias("s"), a["h"].alias("h")))
    )
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<string>").alias("h"))
    found = F.array_join(F.aggregate(head, start, step)["h"], "\n")
    return F.when(found == "", "missing").when(found == F.trim(expected), "match").otherwise("mismatch")


def copyright_years(first: Column, now: Column) -> Column:
    """The years of a notice: now, or first to now; an unknown first year is now."""
    return F.when(F.coalesce(first, now) >= now, now.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), now.cast("string")))


def license_header(years: Column, holder: str, license_id: str) -> Column:
    """The comment lines of a notice, with a blank line after them."""
    return F.concat(F.lit("# SPDX-FileCopyrightText: Copyright (c) "), years, F.lit(f" {holder}\n# SPDX-License-Identifier: {license_id}\n\n"))


def with_header(text: Column, header: Column) -> Column:
    """A file's text with header in place of its own, after a first line that names an interpreter; nothing else follows, nor does a blank line."""
    shebang = F.regexp_extract(text, r"^(#![^\n]*\n)", 1)
    rest = F.substring(text, F.length(shebang) + 1, F.length(text))
    own = r"(?i)^(?:[^\S\n]*\n|#(?![^\n]*spdx)[^\n]*\n)*?((?:#[^\n]*spdx[^\n]*(?:\n|$))+)\n*"
    body = F.ltrim(F.when(rest.rlike(own), F.regexp_replace(rest, own, "")).otherwise(rest), F.lit("\n"))
    return F.when(body == "", F.concat(shebang, F.regexp_replace(header, "\n+$", "\n"))).otherwise(F.concat(shebang, header, body))


def header_start_year(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"(?i)copyright.*?\b([0-9]{4})\b", 1), F.lit("")).cast("int")


def parse_counts(text: Column) -> Column:
    """NAME=COUNT entries, comma-separated, as a map."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: F.trim(v).cast("int"))


def wheel_parts(filename: Column) -> Column:
    """struct(name, version) of a wheel's or source archive's file name; null for others."""
    wheel = r"^([A-Za-z0-9_.]+)-([^-]+)(-[0-9][^-]*)?-[^-]+-[^-]+-[^-]+\.whl$"
    source = r"^(.+)-([^-]+)\.(tar\.gz|zip)$"
    name = F.when(filename.rlike(wheel), F.regexp_extract(filename, wheel, 1)).otherwise(F.regexp_extract(filename, source, 1))
    version = F.when(filename.rlike(wheel), F.regexp_extract(filename, wheel, 2)).otherwise(F.regexp_extract(filename, source, 2))
    return F.when(name != "", F.struct(F.lower(F.regexp_replace(name, "[-_.]+", "-")).alias("name"), version.alias("version")))


def version_key(version: Column) -> Column:
    """A text that sorts as PEP 440 orders versions; versions that don't parse come first."""
    return F.pandas_udf(_version_keys, "string")(version)


def _version_keys(values: pd.Series) -> pd.Series:
    pattern = re.compile(r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(a|b|rc|alpha|beta|c|pre|preview)[-_.]?(\d*))?(?:(?:[-_.]?(?:post|rev|r)[-_.]?(\d*))|-(\d+))?(?:[-_.]?dev[-_.]?(\d*))?(?:\+([a-z0-9.]+))?$", re.I)
    stage = {"a": 1, "alpha": 1, "b": 2, "beta": 2, "c": 3, "rc": 3, "pre": 3, "preview": 3}

    def key(v):
        m = pattern.match((v or "").strip())
        if not m:
            return "-"
        release = [int(x) for x in m[2].split(".")]
        while release and release[-1] == 0:
            release.pop()
        post, dev = m[5] if m[5] is not None else m[6], m[7]
        bare_dev = dev is not None and m[3] is None and post is None
        pre = (0, 0) if bare_dev else (stage[m[3].lower()], int(m[4] or 0)) if m[3] else (9, 0)
        parts = [int(m[1] or 0), *(release + [0] * 8)[:8], *pre, 0 if post is None else int(post or 0) + 1, int(dev or 0) if dev is not None else 99999999]
        return ".".join(f"{p:08d}" for p in parts) + ("+" + m[8] if m[8] else "")

    return values.map(key)


#: A version as PEP 440 has it.
VERSION = r"v?(?:[0-9]+!)?[0-9]+(?:\.[0-9]+)*(?:[-_.]?(?:alpha|a|beta|b|preview|pre|c|rc)[-_.]?[0-9]*)?(?:-[0-9]+|[-_.]?(?:post|rev|r)[-_.]?[0-9]*)?(?:[-_.]?dev[-_.]?[0-9]*)?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?"
_CLAUSE = rf"(?i)^(?:(?:<=|>=|<|>){VERSION}|(?:==|!=)(?:{VERSION}|v?(?:[0-9]+!)?[0-9]+(?:\.[0-9]+)*\.\*)|~=(?=v?(?:[0-9]+!)?[0-9]+\.[0-9]){VERSION}|===\S+)$"
_REQUIREMENT = r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(\[[^\]]*\])?\s*(?:\(([^)]*)\)|([^;@(]*))\s*(?:;(.*))?$"


def is_version(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(f"(?i)^{VERSION}$"), F.lit(False))


def version_specifier(text: Column) -> Column:
    """Version clauses without spaces, each once, sorted and comma-joined; null where one is malformed or there is none."""
    clauses = F.filter(F.transform(F.split(text, ","), lambda c: F.regexp_replace(c, r"\s+", "")), lambda c: c != "")
    return F.when((F.size(clauses) > 0) & F.forall(clauses, lambda c: c.rlike(_CLAUSE)), F.array_join(F.array_sort(F.array_distinct(clauses)), ","))


def canonical_name(name: Column) -> Column:
    """A distribution's name as indexes compare it."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def requirement_parts(text: Column) -> Column:
    """struct(name, specifier, marker) of a dependency; null where it is malformed. specifier is null without version clauses, marker without a condition."""
    raw = F.concat(F.regexp_extract(text, _REQUIREMENT, 3), F.regexp_extract(text, _REQUIREMENT, 4))
    marker = F.nullif(F.trim(F.regexp_replace(F.replace(F.regexp_extract(text, _REQUIREMENT, 5), F.lit("'"), F.lit('"')), r"\s+", " ")), F.lit(""))
    good = text.rlike(_REQUIREMENT) & ((F.trim(raw) == "") | version_specifier(raw).isNotNull())
    return F.when(good, F.struct(canonical_name(F.regexp_extract(text, _REQUIREMENT, 1)).alias("name"), version_specifier(raw).alias("specifier"), marker.alias("marker")))
