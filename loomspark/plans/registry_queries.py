"""Registered queries over package registries, releases, documentation and headers, with SQL that gives the same rows.

Parts stand in for packages and their files, suppliers for owners, pages for
documentation, documents for source files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import code, text
from loomspark.operators import corpus, graph, ordinals, registry
from loomspark.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _key() -> Column:
    return F.col("p_partkey")


def _size() -> Column:
    return F.col("p_size")


# --- names, versions, requirements -------------------------------------------------


@query("fn23_pascal", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || substr(w, 2)), '') AS pascal FROM part")
def _pascal(spark, d):
    return _t(spark, d, "part").select("p_partkey", code.pascal(F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("-")))).alias("pascal"))


@query("fn30_specifier", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '!=3.' || p_size || '.*,<4,>=3.' || p_size WHEN 1 THEN '~=1.' || p_size WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '==2!' || p_size || '.0rc1' END AS specifier, p_partkey % 5 <> 3 AS version_ok FROM part")
def _specifier(spark, d):
    n = _size().cast("string")
    raw = F.when(_key() % 5 == 0, _text(">= 3.", n, " , <4,", " != 3.", n, ".*, <4")).when(_key() % 5 == 1, _text("~=1.", n)).when(_key() % 5 == 2, _text("=> 3.", n)).when(_key() % 5 == 3, F.lit(" , ")).otherwise(_text("==2!", n, ".0rc1"))
    version = F.when(_key() % 5 == 3, _text(n, ".x")).otherwise(_text("v", n, ".1.post2+local.7"))
    return _t(spark, d, "part").select("p_partkey", code.version_specifier(raw).alias("specifier"), code.is_version(version).alias("version_ok"))


@query("cat05_requirement_parts", """SELECT p_partkey, 'my-pkg-' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN '!=1.5,>=' || p_size END AS specifier, CASE WHEN p_partkey % 3 = 1 THEN 'python_version < "3.' || p_size || '"' END AS marker FROM part""")
def _requirement(spark, d):
    raw = F.when(_key() % 3 == 0, _text("My_Pkg.", _key(), "[all] (>=", _size(), ", !=1.5)")).when(_key() % 3 == 1, _text("my-pkg-", _key(), " ; python_version  < '3.", _size(), "'")).otherwise(_text("MY.PKG__", _key()))
    r = code.requirement_parts(raw)
    return _t(spark, d, "part").select("p_partkey", r["name"].alias("name"), r["specifier"].alias("specifier"), r["marker"].alias("marker"))


def _compatibility(spark, d):
    return _t(spark, d, "part").select(
        _text("p", _key()).alias("package"),
        F.when(_key() % 6 == 1, _text("other>=", _size())).when(_key() % 6 == 2, F.lit("host-lib")).otherwise(_text("Host.Lib >=", _size(), "; python_version > '3.9'")).alias("host_requirement"),
        F.when(_key() % 6 == 3, F.lit("=>1")).when(_key() % 6 == 4, F.lit(">=999")).otherwise(_text(">=", _size())).alias("host_specifier"),
        F.when(_key() % 6 == 5, F.lit("wrong")).when(F.col("p_partkey") % 6 < 1, F.lit('python_version > "3.9"')).when(F.col("p_partkey") % 6 > 2, F.lit('python_version > "3.9"')).alias("host_marker"),
    )


@query("cat05_compatibility", """SELECT 'p' || p_partkey AS package, unnest(CASE p_partkey % 6 WHEN 1 THEN ['requirement names another distribution'] WHEN 2 THEN ['requirement has no version'] WHEN 3 THEN ['specifier is malformed']
  WHEN 4 THEN ['specifier differs from the requirement''s'] WHEN 5 THEN ['marker differs from the requirement''s'] ELSE [] END) AS error FROM part""")
def _compatibility_errors(spark, d):
    return registry.compatibility_errors(_compatibility(spark, d), "host-lib")


@query("fn35_install_target", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 1 AND p_partkey % 4 <> 2 THEN 'P_' || p_partkey || '==1' END AS target, CASE WHEN p_partkey % 4 = 0 THEN 'https://index.example/simple' END AS index_url FROM part")
def _target(spark, d):
    needs = F.when(_key() % 4 == 1, F.lit("other")).otherwise(_text("P_", _key(), "==1"))
    index = F.when(_key() % 4 == 0, F.lit("https://index.example/simple")).when(_key() % 4 == 2, F.lit("ftp://x"))
    found = registry.install_target(_text("p-", _key()), needs, index)
    return _t(spark, d, "part").select("p_partkey", found["target"].alias("target"), found["index_url"].alias("index_url"))


@query("fn36_quoted", r"""SELECT p_partkey, '"' || p_name || ' \"' || p_brand || '\" \\ \n\t"' AS quoted FROM part""")
def _quoted(spark, d):
    return _t(spark, d, "part").select("p_partkey", code.quoted(_text(F.col("p_name"), ' "', F.col("p_brand"), '" \\ \n\t')).alias("quoted"))


@query("fn26_license_header", "SELECT p_partkey, CASE WHEN p_size IS NULL OR 2000 + p_size >= 2026 THEN '2026' ELSE (2000 + p_size) || '-2026' END AS years, '# SPDX-FileCopyrightText: Copyright (c) ' || CASE WHEN 2000 + p_size >= 2026 THEN '2026' ELSE (2000 + p_size) || '-2026' END || ' Some Holder' || chr(10) || '# SPDX-License-Identifier: MIT' || chr(10) || chr(10) AS header FROM part")
def _license_header(spark, d):
    years = code.copyright_years(_size() + 2000, F.lit(2026))
    return _t(spark, d, "part").select("p_partkey", years.alias("years"), code.license_header(years, "Some Holder", "MIT").alias("header"))


# --- headers of files --------------------------------------------------------------

HEADER = "# SPDX-FileCopyrightText: 2025 A\n# SPDX-License-Identifier: MIT"


def _sources(spark, d):
    """Documents as source files, some with a header, some with another, some with none."""
    n = F.col("doc_id")
    head = F.when(n % 4 == 0, f"{HEADER}\n\n").when(n % 4 == 1, "#!/bin/sh\n# SPDX-License-Identifier: ISC\n").when(n % 4 == 2, "#!/bin/sh\n").otherwise("")
    body = F.when(n % 8 == 7, "").otherwise(_text("x = ", n, "\n"))
    path = _text(F.col("source"), "/", F.when(n % 5 == 0, "tests/").otherwise(""), n, F.when(n % 3 == 0, ".md").when(n % 3 == 1, ".py").otherwise(".SH"))
    return _t(spark, d, "documents").select("doc_id", path.alias("path"), F.concat(head, body).alias("text"))


@query("flt15_header_candidates", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def _candidates(spark, d):
    return _sources(spark, d).where(code.is_header_candidate(F.col("path"), ["/tests/"])).select("doc_id")


@query("agg18_header_counts", "SELECT count(*) AS processed, count(*) FILTER (doc_id % 4 <> 0) AS updated, count(*) FILTER (doc_id % 4 = 0) AS skipped FROM documents")
def _header_counts(spark, d):
    return registry.header_counts(_sources(spark, d).withColumn("state", code.header_state(F.col("text"), F.lit(HEADER))))


@query("mnt03_with_header", f"""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 2) THEN '#!/bin/sh' || chr(10) ELSE '' END AS top, '{HEADER.replace(chr(10), "' || chr(10) || '")}' || chr(10) AS head, CASE WHEN doc_id % 8 = 7 THEN '' ELSE 'x = ' || doc_id || chr(10) END AS body FROM documents)
SELECT doc_id, md5(top || head || CASE WHEN body = '' THEN '' ELSE chr(10) || body END) AS md5 FROM h""")
def _with_header(spark, d):
    return _sources(spark, d).select("doc_id", F.md5(code.with_header(F.col("text"), F.lit(f"{HEADER}\n\n")).cast("binary")).alias("md5"))


# --- documentation ----------------------------------------------------------------------


def _guides(spark, d):
    n = F.col("page_id")
    path = F.when(n % 5 == 0, _text("g", n % 7, "/i", n, "/index.md")).when(n % 11 == 1, F.lit("README.md")).otherwise(_text("g", n % 7, "/page-", n, "_b.md"))
    return _t(spark, d, "pages").select("page_id", path.alias("path"))


_GUIDES = "guides AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'g' || page_id % 7 || '/i' || page_id || '/index.md' WHEN page_id % 11 = 1 THEN 'README.md' ELSE 'g' || page_id % 7 || '/page-' || page_id || '_b.md' END AS path FROM pages)"


@query("srt04_relative_paths", f"WITH {_GUIDES} SELECT page_id, path, row_number() OVER (ORDER BY path, page_id) - 1 AS place FROM guides")
def _relative_paths(spark, d):
    return ordinals.with_ordinal(_guides(spark, d), ["path", "page_id"], "place")


@query("srt05_nav_pages", f"WITH {_GUIDES} SELECT page_id, path, row_number() OVER (ORDER BY CASE WHEN path LIKE '%index.md' OR path LIKE '%README.md' THEN 0 ELSE 1 END, path, page_id) - 1 AS place FROM guides")
def _nav_pages(spark, d):
    ranked = _guides(spark, d).withColumn("rank", code.page_rank(F.col("path")))
    return ordinals.with_ordinal(ranked, ["rank", "path", "page_id"], "place").drop("rank")


@query("fn28_destination", f"WITH {_GUIDES} SELECT page_id, CASE WHEN path = 'README.md' AND page_id % 2 = 1 THEN 'index.md' ELSE path END AS destination FROM guides")
def _destination(spark, d):
    return _guides(spark, d).select("page_id", code.destination_path(F.col("path"), F.col("page_id") % 2 == 0).alias("destination"))


@query("flt16_copied_pages", "SELECT page_id FROM pages WHERE page_id % 4 NOT IN (1, 2)")
def _copied(spark, d):
    n = F.col("page_id")
    path = F.when(n % 4 == 1, _text("a/.git/", n)).when(n % 4 == 2, _text("__pycache__/", n)).otherwise(_text("a.b/c/", n, ".md"))
    return _t(spark, d, "pages").where(~code.is_hidden_path(path)).select("page_id")


@query("fn27_page_title", f"""WITH {_GUIDES} SELECT page_id, CASE WHEN path LIKE '%index.md' OR path LIKE '%README.md' THEN 'Overview' WHEN page_id % 2 = 0 THEN 'About ' || page_id ELSE 'G' || page_id % 7 || ' / Page ' || page_id || ' B' END AS title FROM guides""")
def _page_title(spark, d):
    content = F.when(F.col("page_id") % 2 == 0, _text("intro\n\n#  About ", F.col("page_id"), " ##\n# Other\n")).otherwise(F.lit("no heading\n## small\n"))
    return _guides(spark, d).select("page_id", code.markdown_title(F.col("path"), content).alias("title"))


@query("prj13_docs_cards", """SELECT p_partkey, '<a href="p-' || p_partkey || '/">' || replace(p_name, '&', '&amp;') || ' &lt;b&gt; &amp; &quot;v' || p_size || '&quot;</a>' AS card, CASE WHEN p_partkey % 3 = 0 THEN 'None declared' ELSE '`e' || p_size || '`, `f`' END AS codes FROM part""")
def _cards(spark, d):
    points = F.when(_key() % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(_text("e", _size()), F.lit("f")))
    card = F.concat(F.lit('<a href="'), code.escaped(code.docs_slug(_text("P ", _key()))), F.lit('/">'), code.escaped(_text(F.col("p_name"), ' <b> & "v', _size(), '"')), F.lit("</a>"))
    return _t(spark, d, "part").select("p_partkey", card.alias("card"), code.markdown_codes(points).alias("codes"))


# --- catalogs, releases and package lists ------------------------------------------------


def _entries(spark, d):
    """Parts as catalog entries of packages with an entry point each."""
    package = _text("pkg-", _key())
    return _t(spark, d, "part").select(
        F.when(_key() % 10 == 9, 1).otherwise(2).alias("schema_version"), _key().alias("package_pos"), F.lit(0).alias("plugin_pos"), package.alias("package"), F.col("p_name").alias("description"),
        F.when(_key() % 10 == 8, F.lit("elsewhere>=1")).otherwise(package).alias("requirement"), F.when(_key() % 10 == 7, F.lit("file:///x")).otherwise(F.lit("https://index.example/")).alias("index_url"),
        F.when(_key() % 10 == 6, F.lit(">==3")).otherwise(F.lit(">=3.10")).alias("python"), _text("https://docs.example/plugins/", package, "/").alias("docs_url"), F.when(_key() % 10 == 5, _text("Plug_", _key())).otherwise(_text("plug-", _key())).alias("plugin"),
        F.lit("column-generator").alias("plugin_type"), F.lit("some.plugins").alias("entry_group"), _text("e", _size()).alias("entry_name"), _text("mod:", F.col("p_brand")).alias("entry_value"),
    )


@query("cat03_catalog_errors", """SELECT 'pkg-' || p_partkey AS package, CASE WHEN p_partkey % 10 = 5 THEN 'Plug_' ELSE 'plug-' END || p_partkey AS plugin, unnest(CASE p_partkey % 10 WHEN 9 THEN ['unsupported schema version'] WHEN 8 THEN ['requirement names another package'] WHEN 7 THEN ['index url is not http']
  WHEN 6 THEN ['python specifier is malformed'] WHEN 5 THEN ['plugin name is not kebab-case'] ELSE [] END) AS error FROM part""")
def _catalog_errors(spark, d):
    return registry.catalog_errors(_entries(spark, d))


@query("agg13_grouped_catalog", """SELECT 'pkg-' || p_partkey % 300 AS package, string_agg('plug-' || p_partkey || '=mod:' || p_brand, ',' ORDER BY p_partkey) AS plugins FROM part GROUP BY p_partkey % 300""")
def _grouped(spark, d):
    rows = _entries(spark, d).withColumns({"plugin_pos": F.col("package_pos"), "package_pos": F.col("package_pos") % 300, "plugin": F.concat(F.lit("plug-"), F.col("package_pos").cast("string"))})
    same = {c: F.lit("x") for c in ("description", "requirement", "index_url", "docs_url")}
    grouped = registry.grouped_catalog(rows.withColumns(same | {"package": _text("pkg-", F.col("package_pos"))}))
    return grouped.select("package", F.array_join(F.transform("plugins", lambda p: F.concat(p["name"], F.lit("="), p["entry_point"]["value"])), ",").alias("plugins"))


@query("jon12_release_comparison", """WITH e AS (SELECT 'pkg-' || p_partkey AS package, p_partkey % 10 AS m FROM part)
SELECT package, unnest(CASE m WHEN 0 THEN ['description is stale'] WHEN 1 THEN ['docs url is stale'] WHEN 2 THEN ['entry point has another value'] WHEN 3 THEN ['entry point is not declared', 'entry point is not in the catalog'] WHEN 4 THEN ['entry point is not in the catalog'] WHEN 6 THEN ['python specifier is stale'] ELSE [] END) AS error FROM e
UNION ALL SELECT 'new-' || s_suppkey, 'not in the catalog' FROM supplier""")
def _release_comparison(spark, d):
    package = _text("pkg-", _key())
    point, value = _text("e", _size()), _text("mod:", F.col("p_brand"))
    points = F.when(_key() % 10 == 2, F.create_map(point, F.lit("mod:other"))).when(_key() % 10 == 3, F.create_map(F.lit("other"), value)).when(_key() % 10 == 4, F.create_map(point, value, F.lit("more"), value)).otherwise(F.create_map(point, value))
    own = _t(spark, d, "part").select(
        package.alias("package"), F.when(_key() % 10 == 0, F.lit("new text")).otherwise(F.col("p_name")).alias("description"), F.lit(" >= 3.10").alias("requires_python"),
        F.when(_key() % 10 == 1, F.lit("https://docs.example/old/")).otherwise(_text("https://docs.example/plugins/", package, "/")).alias("docs_url"), points.alias("entry_points"),
    )
    fresh = _t(spark, d, "supplier").select(_text("new-", F.col("s_suppkey")).alias("package"), F.lit("d").alias("description"), F.lit(">=3.10").alias("requires_python"), F.lit("u").alias("docs_url"), F.create_map(F.lit("e"), F.lit("v")).alias("entry_points"))
    return registry.release_comparison(own.union(fresh), _entries(spark, d))


@query("cat02_catalog_changes", "SELECT 'pkg-' || p_partkey AS package, 'e' || p_size AS entry_name, CASE p_partkey % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'stale' ELSE 'changed' END AS state FROM part WHERE p_partkey % 10 < 3")
def _catalog_changes(spark, d):
    entries = _entries(spark, d)
    number = F.col("package_pos") % 10
    actual = entries.where(number != 0).withColumn("description", F.when(number == 2, F.lit(None)).otherwise(F.col("description")))
    return registry.catalog_changes(entries.where(number != 1), actual)


@query("rel02_release_errors", """SELECT 'p' || p_partkey AS package, unnest(CASE p_partkey % 13 WHEN 0 THEN ['name differs from the folder''s', 'release ref differs from the template''s'] WHEN 1 THEN ['version differs from the tag''s', 'release ref differs from the template''s'] WHEN 2 THEN ['tag version is malformed', 'version is malformed']
  WHEN 3 THEN ['no description'] WHEN 4 THEN ['no license'] WHEN 5 THEN ['no readme'] WHEN 6 THEN ['no authors'] WHEN 7 THEN ['requires-python is malformed'] WHEN 8 THEN ['no dependency on the host'] WHEN 9 THEN ['dependency on the host has no version'] WHEN 10 THEN ['no entry points'] WHEN 11 THEN ['no owner who can release'] ELSE [] END) AS error FROM part""")
def _release_errors(spark, d):
    m = _key() % 13
    unless = lambda i, value: F.when(m != i, value)
    version = F.when(m == 2, _text(_size(), ".x")).otherwise(_text(_size(), ".0.1"))
    packages = _t(spark, d, "part").select(
        _text("p", _key()).alias("package"), F.when(m == 0, F.lit("other")).otherwise(_text("p", _key())).alias("folder"), version.alias("version"), F.when(m == 1, _text(_size(), ".0.2")).otherwise(version).alias("tag_version"),
        unless(3, F.col("p_name")).alias("description"), unless(4, F.lit("MIT")).alias("license"), unless(5, F.lit("README.md")).alias("readme"), F.when(m == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("authors"),
        unless(7, F.lit(">=3.10")).alias("requires_python"), F.when(m == 8, F.array(F.lit("numpy"))).when(m == 9, F.array(F.lit("host-lib"))).otherwise(F.array(F.lit("numpy"), F.lit("Host_Lib >= 1"))).alias("dependencies"),
        F.when(m == 10, F.from_json(F.lit("{}"), "map<string,string>")).otherwise(F.create_map(F.lit("e"), F.lit("m:e"))).alias("entry_points"), F.when(m == 11, F.array(F.lit("a@b.example"))).otherwise(F.array(F.lit("a@b.example"), F.lit("@org/team"))).alias("owners"),
    )
    return registry.release_errors(packages, "host-lib", "{package}/v{version}")


@query("set06_key_differences", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'hash' ELSE '' END AS missing, CASE WHEN p_partkey % 4 = 0 THEN 'k' || p_size ELSE '' END AS unknown FROM part")
def _keys(spark, d):
    keys = F.filter(F.array(F.lit("filename"), F.when(_key() % 3 != 0, "hash"), F.when(_key() % 5 == 0, "requires_python"), F.when(_key() % 4 == 0, _text("k", _size()))), lambda k: k.isNotNull())
    found = registry.key_differences(_t(spark, d, "part").select("p_partkey", keys.alias("keys")), "keys", ["filename", "hash"], ["requires_python"])
    return found.select("p_partkey", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


@query("snk10_package_lines", """SELECT '{"filename":"pkg' || p_partkey || '-1.0-py3-none-any.whl","hash":"sha256=' || sha256(p_name) || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"requires_python":">=3.10"' ELSE '' END || '}' AS value FROM part""")
def _package_lines(spark, d):
    ship(spark)
    rows = _t(spark, d, "part").select(_text("pkg", _key(), "-1.0-py3-none-any.whl").alias("filename"), F.concat(F.lit("sha256="), F.sha2(F.col("p_name").cast("binary"), 256)).alias("hash"), F.when(_key() % 2 == 0, ">=3.10").alias("requires_python"))
    return registry.package_list_lines(rows)


@query("mnt02_ownership_lines", "SELECT 'plug-' || s_suppkey AS package, '/plugins/plug-' || s_suppkey || '/ @team' || s_suppkey || '/docs @user' AS line FROM supplier WHERE s_suppkey % 3 <> 0")
def _ownership(spark, d):
    n = F.col("s_suppkey")
    raw = F.when(n % 3 == 0, F.lit("# none yet\n")).otherwise(_text("*.py @team", n, "/docs  # all\n/x @user @user\n"))
    return registry.ownership_lines(_t(spark, d, "supplier").select(_text("plug-", n).alias("package"), code.owner_tokens(raw).alias("owners")))


# --- records -----------------------------------------------------------------------------


@query("agg11_group_totals", "SELECT count(*) AS groups, sum(n)::BIGINT AS docs, max(n) AS largest FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def _group_totals(spark, d):
    return graph.group_totals(_t(spark, d, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").cast("string").alias("doc_id")))


@query("prj03_record_identifier", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a/' || doc_id WHEN 1 THEN source || '/' || doc_id ELSE substr(md5('x/' || doc_id || '||y/' || doc_id), 1, 16) END AS id FROM documents")
def _identifier(spark, d):
    n = F.col("doc_id")
    given = F.when(n % 3 == 0, _text("a/./b/../", n)).when(n % 3 == 1, F.lit(""))
    names = F.when(n % 3 == 2, F.array(_text("y/", n), _text("x//", n))).otherwise(F.array(_text(F.col("source"), "/", n)))
    return _t(spark, d, "documents").select("doc_id", text.record_identifier(given, names).alias("id"))


@query("ded04_distinct_texts", "SELECT 'd_' || substr(sha256(text), 1, 16) AS corpus_id, min(doc_id) AS first_rec FROM documents WHERE text <> '' GROUP BY text")
def _distinct_texts(spark, d):
    rows = _t(spark, d, "documents").where("text <> ''").select("text", F.col("doc_id").alias("rec_ord"), F.lit(0).alias("chunk_pos"))
    return corpus.corpus_of(rows).select("corpus_id", "first_rec")


@query("snk02_training_items", """SELECT doc_id, '{"question_id":"q' || doc_id || '","question":"Which ' || source || '?","corpus_id":"c","pos_doc":[{"id":"d_' || substr(sha256(text), 1, 16) || '"}],"neg_doc":[]}' AS item FROM documents WHERE text IS NOT NULL""")
def _training_items(spark, d):
    from loomspark.plans.export import training_item

    docs = _t(spark, d, "documents").where("text is not null")
    rows = docs.select("doc_id", F.col("doc_id").alias("ordinal"), _text("Which ", F.col("source"), "?").alias("question"), F.array(text.corpus_id(F.col("text"))).alias("pos_ids"))
    return rows.select("doc_id", training_item("c").alias("item"))
