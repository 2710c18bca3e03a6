"""The engine's registered queries, with SQL that gives the same rows.

The tables stand in for the engine's own inputs: documents for files, user and
assistant turns of conversations for question pairs, labels for scores, pages
for paths and addresses, parts and suppliers for package registries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import code, text
from loomspark.operators import chunking, corpus, curation, graph, ordinals, registry, splits
from loomspark.plans.generate import evaluation_prompt, numbered_segments
from loomspark.schemas import QA_EVALUATIONS, QA_PAIR
from loomspark.shipping import ship
from loomspark.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path() -> Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


# --- chunks and sections -------------------------------------------------

SENTENCES = r"""sent AS (SELECT doc_id, source, regexp_split_to_array(regexp_replace(trim(text, E' \t\n\r'), '([.!?]+["'')\]]*)\s+', '\1' || chr(31), 'g'), chr(31)) AS s FROM documents WHERE trim(text, E' \t\n\r') <> ''),
parts AS (SELECT doc_id, source, s, unnest(range(0, len(s), 5)) AS p0 FROM sent),
raw AS (SELECT doc_id, source, p0 // 5 + 1 AS idx, trim(array_to_string(s[p0 + 1:p0 + 5], ' '), E' \t\n\r') AS text, len(s[p0 + 1:p0 + 5]) AS n FROM parts),
ch AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\s+')) END AS words FROM raw)"""


@query("chk01_sentence_chunks", f"WITH {SENTENCES} SELECT doc_id, idx::INTEGER AS doc_chunk_index, 'd_' || substr(sha256(text), 1, 16) AS corpus_id, n::INTEGER AS sentence_count, words::INTEGER AS word_count FROM ch")
def _chunks(spark, d):
    found = chunking.exploded_chunks(_t(spark, d, "documents"), "doc_id")
    return found.select("doc_id", "doc_chunk_index", text.corpus_id(F.col("text")).alias("corpus_id"), "sentence_count", "word_count")


@query("win01_word_offsets", f"""WITH {SENTENCES} SELECT doc_id, idx::INTEGER AS chunk_id, (sum(words) OVER w - words)::INTEGER AS "start", (sum(words) OVER w)::INTEGER AS "end" FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""")
def _offsets(spark, d):
    found = _t(spark, d, "documents").select("doc_id", F.explode(chunking.chunks(F.col("text"))).alias("c"))
    return found.select("doc_id", "c.chunk_id", "c.start", "c.end")


def _sections(spark, d, strategy):
    docs = _t(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("bundle"), (F.col("doc_id") % 2).cast("int").alias("pos"), _path().alias("path"), "text")
    made = chunking.bundled_documents(docs, 5, 3, strategy)
    return made.select("bundle_id", F.posexplode("sections_structured").alias("pos", "section")).select("bundle_id", F.md5(F.col("section").cast("binary")).alias("section_md5"))


_BUNDLED = (
    SENTENCES
    + """,
own AS (SELECT doc_id // 2 AS bundle, source || '/' || doc_id || '.txt' AS path, doc_id, idx, text FROM ch),
names AS (SELECT bundle, md5(string_agg(path, '||' ORDER BY path)) AS bundle_id, count(*) AS docs FROM (SELECT DISTINCT bundle, path FROM own) GROUP BY bundle),
num AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY doc_id, idx) AS chunk_id, count(*) OVER (PARTITION BY bundle) AS total, count(*) OVER (PARTITION BY doc_id) AS mine, dense_rank() OVER (PARTITION BY bundle ORDER BY doc_id) AS dr FROM own),
line AS (SELECT *, 'Segment ' || chunk_id || ' [Doc: ' || path || '] (00:00:00 - 00:00:00): ' || text AS l FROM num),
seq AS (SELECT bundle, least((p - 1) // greatest(1, total // 3), 2) AS sec, p AS o, l, text FROM (SELECT *, {order} AS p FROM line){where})"""
)
_SECTION = "SELECT bundle_id, md5('=== Section ' || {number} || ' ===' || chr(10) || string_agg(l, chr(10) ORDER BY o)) AS section_md5 FROM {rows} JOIN names USING (bundle) WHERE text <> '' GROUP BY bundle_id, {number}"


@query("sec02_sections_sequential", "WITH " + _BUNDLED.format(order="chunk_id", where="") + " " + _SECTION.format(number="(sec + 1)", rows="seq"))
def _sequential(spark, d):
    return _sections(spark, d, "sequential")


_TURNS = "row_number() OVER (PARTITION BY bundle ORDER BY idx, dr)"


@query("sec04_sections_interleaved", "WITH " + _BUNDLED.format(order=_TURNS, where="") + " " + _SECTION.format(number="(sec + 1)", rows="seq"))
def _interleaved(spark, d):
    return _sections(spark, d, "interleaved")


_BALANCED = """, two AS (SELECT num.*, docs FROM num JOIN names USING (bundle) WHERE docs > 1),
slot AS (SELECT *, (idx - 1) // greatest(1, ceil(mine / 3)::BIGINT) AS part FROM two),
numbered AS (SELECT bundle, dense_rank() OVER (PARTITION BY bundle ORDER BY part) - 1 AS sec, chunk_id AS o, 'Segment ' || chunk_id || ' [Doc: ' || path || '] (00:00:00 - 00:00:00): ' || text AS l, text FROM slot),
both_kinds AS (SELECT * FROM numbered UNION ALL SELECT bundle, sec, o, l, text FROM seq WHERE bundle IN (SELECT bundle FROM names WHERE docs = 1)) """


@query("sec03_sections_balanced", "WITH " + _BUNDLED.format(order="chunk_id", where="") + _BALANCED + _SECTION.format(number="(sec + 1)", rows="both_kinds"))
def _balanced(spark, d):
    return _sections(spark, d, "doc_balanced")


@query("src08_bundles", "WITH r AS (SELECT source || '/' || doc_id || '.txt' AS path, row_number() OVER (ORDER BY source || '/' || doc_id || '.txt') - 1 AS n FROM documents) SELECT (n // 2)::BIGINT AS bundle, (n % 2)::INTEGER AS pos, path FROM r")
def _bundle_files(spark, d):
    return chunking.bundles(_t(spark, d, "documents").select(_path().alias("path"))).select("bundle", "pos", "path")


# --- scalar functions ------------------------------------------------------


@query("fn01_norm_path", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace('docs//' || source || '\.\' || doc_id || '/../' || doc_id || '.txt', '\', '/'), '/+', '/', 'g'), '/\./', '/', 'g'), '[^/]+/\.\./', '', 'g') AS path FROM documents""")
def _norm(spark, d):
    raw = F.concat(F.lit("docs//"), "source", F.lit("\\.\\"), F.col("doc_id").cast("string"), F.lit("/../"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _t(spark, d, "documents").select("doc_id", text.norm_path(raw).alias("path"))


_MEMBERS = "m AS (SELECT doc_id // 2 AS bundle, md5(string_agg(source || '/' || doc_id || '.txt', '||' ORDER BY source || '/' || doc_id || '.txt')) AS h, count(*) AS n, min(source || '/' || doc_id || '.txt') AS one FROM documents GROUP BY 1)"


def _members(spark, d):
    return _t(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 2).alias("bundle")).agg(F.collect_list(_path()).alias("m"))


@query("fn02_source_id", f"WITH {_MEMBERS} SELECT bundle, CASE WHEN n = 1 THEN one ELSE substr(h, 1, 16) END AS source_id FROM m")
def _source_id(spark, d):
    return _members(spark, d).select("bundle", text.source_id(F.col("m")).alias("source_id"))


@query("fn03_bundle_id", f"WITH {_MEMBERS} SELECT bundle, h AS bundle_id FROM m")
def _bundle_id(spark, d):
    return _members(spark, d).select("bundle", text.bundle_id(F.col("m")).alias("bundle_id"))


@query("fn04_corpus_id", "SELECT doc_id, 'd_' || substr(sha256(text), 1, 16) AS corpus_id FROM documents")
def _corpus_id(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.corpus_id(F.col("text")).alias("corpus_id"))


@query("fn05_base_filename", r"SELECT page_id, regexp_replace(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)$', 1), '^(.*[^.].*)\.[^.]*$', '\1') AS base FROM pages")
def _base(spark, d):
    return _t(spark, d, "pages").select("page_id", text.base_filename(F.regexp_extract("url", "^([^?#]*)", 1)).alias("base"))


@query("fn06_strip_extension", r"SELECT page_id, regexp_replace('a.b/' || page_id || '.tar.gz', '\.[^./]*$', '') AS stem, '.hidden' AS hidden FROM pages")
def _stem(spark, d):
    path = F.concat(F.lit("a.b/"), F.col("page_id").cast("string"), F.lit(".tar.gz"))
    return _t(spark, d, "pages").select("page_id", text.strip_extension(path).alias("stem"), text.strip_extension(F.lit(".hidden")).alias("hidden"))


@query("fn07_github_repository", "SELECT s_suppkey, 'org' || s_suppkey || '/repo' AS repository, 'https://github.com/org' || s_suppkey || '/repo.git' AS url, 'org' || s_suppkey || '__repo' AS folder FROM supplier")
def _github(spark, d):
    name = code.github_repository(F.concat(F.lit(" https://github.com/org"), F.col("s_suppkey").cast("string"), F.lit("/repo.git/ ")))
    return _t(spark, d, "supplier").select("s_suppkey", name.alias("repository"), code.clone_url(name).alias("url"), code.repository_folder(name).alias("folder"))


@query("fn10_commit_sha", "SELECT doc_id, regexp_matches(substr(md5(text), 1, (doc_id % 12)::INTEGER), '^[0-9a-fA-F]{7,40}$') AS is_sha FROM documents")
def _sha(spark, d):
    part = F.substring(F.md5(F.col("text").cast("binary")), F.lit(1), (F.col("doc_id") % 12).cast("int"))
    return _t(spark, d, "documents").select("doc_id", code.is_commit_sha(part).alias("is_sha"))


_NAMES = ("src/a.PY", "b.rs", "deep/Makefile", "c.xyz", "LICENSE", "x/Dockerfile", "a.b/c.Tsx", ".bashrc", "dir.py/none", "k.kts", "h.HPP", "makefile", "t.tar.gz")


@query("fn11_code_language", f"""WITH known(e, l) AS (VALUES {", ".join(map(str, code.LANGUAGES.items()))}), named(n, l) AS (VALUES {", ".join(map(str, code.LANGUAGES_BY_NAME.items()))}),
p AS (SELECT page_id, ({list(_NAMES)})[page_id % {len(_NAMES)} + 1] AS path FROM pages), q AS (SELECT page_id, string_split(path, '/')[-1] AS base FROM p),
s AS (SELECT *, lower(CASE WHEN strpos(substr(base, 2), '.') > 0 THEN '.' || string_split(base, '.')[-1] ELSE '' END) AS ext FROM q)
SELECT page_id, coalesce(named.l, known.l, substr(ext, 2)) AS lang FROM s LEFT JOIN known ON e = ext LEFT JOIN named ON n = base""")
def _language(spark, d):
    names = F.array(*[F.lit(x) for x in _NAMES])
    return _t(spark, d, "pages").select("page_id", code.code_language(F.get(names, (F.col("page_id") % len(_NAMES)).cast("int"))).alias("lang"))


@query("fn12_extension", "SELECT page_id, CASE WHEN starts_with(r, '.') THEN r ELSE '.' || r END AS extension FROM (SELECT page_id, lower(trim(CASE WHEN page_id % 2 = 0 THEN ' P' ELSE '.P' END || page_id)) AS r FROM pages)")
def _extension(spark, d):
    raw = F.concat(F.when(F.col("page_id") % 2 == 0, " P").otherwise(".P"), F.col("page_id").cast("string"))
    return _t(spark, d, "pages").select("page_id", code.normalize_extension(raw).alias("extension"))


@query("fn17_bump_version", "SELECT p_partkey, (p_size + 1) || '.0.0' AS major, p_size || '.' || (p_partkey % 10 + 1) || '.0' AS minor, p_size || '.' || (p_partkey % 10) || '.4' AS patch FROM part")
def _bump(spark, d):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), F.lit("3"))
    return _t(spark, d, "part").select("p_partkey", *[code.bump_semver(v, p).alias(p) for p in ("major", "minor", "patch")])


@query("fn21_docs_slug", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9_.-]+', '-', 'g'), '-') AS collapsed, trim(regexp_replace(lower(url), '[^a-z0-9_.-]', '-', 'g'), '-') AS single FROM pages")
def _slug(spark, d):
    return _t(spark, d, "pages").select("page_id", code.docs_slug(F.col("url")).alias("collapsed"), code.docs_slug(F.col("url"), False).alias("single"))


@query("fn22_kebab", "SELECT p_partkey, regexp_matches(lower(replace(p_type, ' ', '-')), '^[a-z][a-z0-9]*(-[a-z0-9]+)*$') AS kebab, replace(lower(replace(p_type, ' ', '-')), '-', '_') AS underscored FROM part")
def _kebab(spark, d):
    slug = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("-")))
    return _t(spark, d, "part").select("p_partkey", code.is_kebab(slug).alias("kebab"), code.underscored(slug).alias("underscored"))


@query("fn24_owner_tokens", r"""WITH o AS (SELECT s_suppkey, list_distinct(regexp_extract_all(regexp_replace('# owners' || chr(10) || '*.py @team' || s_suppkey || '/docs  # all' || chr(10) || '/x @user @user' || chr(10), '#[^\n]*', '', 'g'), '\S*@\S*')) AS l FROM supplier)
SELECT s_suppkey, array_to_string(list_sort(l), ',') AS owners, len(list_filter(l, lambda t: NOT regexp_matches(t, '^@[A-Za-z0-9][A-Za-z0-9-]*(/[A-Za-z0-9][A-Za-z0-9_-]*)?$'))) = 0 AS eligible FROM o""")
def _owners(spark, d):
    raw = F.concat(F.lit("# owners\n*.py @team"), F.col("s_suppkey").cast("string"), F.lit("/docs  # all\n/x @user @user\n"))
    tokens = code.owner_tokens(raw)
    return _t(spark, d, "supplier").select("s_suppkey", F.array_join(F.array_sort(tokens), ",").alias("owners"), F.forall(tokens, code.is_release_owner).alias("eligible"))


@query("fn29_http_url", r"SELECT page_id, coalesce(regexp_matches(url, '^https?://[^/?#\s]+'), false) AS ok FROM pages")
def _url(spark, d):
    return _t(spark, d, "pages").select("page_id", code.is_http_url(F.col("url")).alias("ok"))


@query("fn34_parse_counts", "SELECT p_partkey, p_size::INTEGER AS a, 2 AS b FROM part")
def _parse_counts(spark, d):
    m = code.parse_counts(F.concat(F.lit("a="), F.col("p_size").cast("string"), F.lit(",b=2")))
    return _t(spark, d, "part").select("p_partkey", m["a"].alias("a"), m["b"].alias("b"))


@query("fn25_header_state", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' ELSE 'missing' END AS state FROM documents")
def _header(spark, d):
    good = "# SPDX-FileCopyrightText: 2025 A\n# SPDX-License-Identifier: MIT"
    head = F.when(F.col("doc_id") % 3 == 0, f"#!/bin/sh\n{good}\n\nx\n").when(F.col("doc_id") % 3 == 1, "# SPDX-License-Identifier: ISC\nx\n").otherwise("x = 1\n# SPDX-License-Identifier: MIT\n")
    return _t(spark, d, "documents").select("doc_id", code.header_state(F.concat(head, F.coalesce("text", F.lit(""))), F.lit(good)).alias("state"))


@query("prj11_upper", "SELECT c_custkey, upper(c_mktsegment) AS out FROM customer")
def _upper(spark, d):
    return _t(spark, d, "customer").select("c_custkey", text.text_transform(F.col("c_mktsegment"), "upper").alias("out"))


@query("prj11_lower", "SELECT doc_id, lower(text) AS out FROM documents")
def _lower(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.text_transform(F.col("text"), "lower").alias("out"))


@query("prj11_title", """SELECT p_partkey, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(s[i - 1], '[A-Za-z]') THEN upper(s[i]) ELSE lower(s[i]) END), '') AS out
FROM (SELECT p_partkey, p_type || ' o''neil-' || p_brand || ' ' || p_size || 'nd' AS s FROM part)""")
def _title(spark, d):
    ship(spark)
    words = F.concat("p_type", F.lit(" o'neil-"), "p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit("nd"))
    return _t(spark, d, "part").select("p_partkey", text.text_transform(words, "title").alias("out"))


@query("flt03_extensions", r"SELECT page_id, url FROM pages WHERE lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)$', 1)) LIKE '%_.html' OR NOT contains(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)$', 1), '.')")
def _extensions(spark, d):
    return _t(spark, d, "pages").where(text.matches_extensions(F.regexp_extract("url", "^([^?#]*)", 1), [".HTML", ""])).select("page_id", "url")


@query("flt04_globs", "SELECT doc_id FROM documents WHERE NOT regexp_matches(source || '/' || doc_id || '.txt', '^src1.*/.*7[.]txt$')")
def _globs(spark, d):
    return _t(spark, d, "documents").where(~code.matches_any_glob(_path(), ["src1*/*7.txt"])).select("doc_id")


# --- records: filters, corpus, joins -------------------------------------


def _records(spark, d):
    """Documents as records: user turns and the next assistant turns of the conversation of that id as pairs, labels as their scores, text yet to be cut into chunks."""
    turns = _t(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pair = F.struct(
        "question", "answer", F.lit(3).alias("question_complexity"), F.lit("contextual").alias("query_type"), F.lit("factual").alias("reasoning_type"),
        F.when(F.col("turn") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("segment_ids"), F.lit(1).alias("hop_count"), F.array().alias("hop_contexts"),
    ).cast(QA_PAIR)
    pairs = asked.join(told, ["conv_id", "turn"]).withColumn("pair", pair)
    listed = pairs.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "pair"))), lambda x: x["pair"]).alias("deduplicated_qa_pairs"))  # of a conversation
    score = F.struct(F.lit(None).alias("relevance"), F.lit(None).alias("accuracy"), F.lit(None).alias("context_support"), F.lit(None).alias("clarity"), F.struct((F.col("quality") * 10.0).alias("score"), F.lit("").alias("assessment")).alias("overall"), F.lit("").alias("improvements"))
    labels = _t(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    out = docs.join(listed, "conv_id", "left").join(labels, "conv_id", "left")
    evaluated = F.when(F.col("quality").isNotNull(), F.struct(F.transform("deduplicated_qa_pairs", lambda p: score).alias("evaluations")).cast(QA_EVALUATIONS))
    name = F.array(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")))
    return out.select("conv_id", name.alias("file_name"), F.lit("").alias("source_id"), F.col("conv_id").alias("rec_ord"), "text", F.struct(F.lit(None).cast(f"array<{QA_PAIR}>").alias("pairs")).alias("qa_generation"), "deduplicated_qa_pairs", evaluated.alias("qa_evaluations"))


_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) - 1 AS pair_pos, CASE WHEN u.turn % 3 = 0 THEN [1, 2] ELSE [1] END AS segs
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 JOIN documents d ON d.doc_id = u.conv_id WHERE u.role = 'user' AND a.role = 'assistant'),
scored AS (SELECT p.*, quality * 10.0 AS score FROM pairs p JOIN labels l ON l.doc_id = p.conv_id)"""


@query("flt01_integrity", f"WITH {_PAIRS} SELECT doc_id AS conv_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM pairs WHERE conv_id NOT IN (SELECT doc_id FROM labels))")
def _integrity(spark, d):
    return curation.consistent(_records(spark, d)).select("conv_id")


@query("flt02_quality", f"WITH {_PAIRS} SELECT conv_id AS rec_ord, pair_pos::INTEGER AS pair_pos, question, answer, score::DOUBLE AS quality_score FROM scored WHERE score >= 7.0")
def _quality(spark, d):
    return curation.scored_pairs(_records(spark, d)).select("rec_ord", "pair_pos", "question", "answer", "quality_score")


@query("agg10_retention", f"WITH {_PAIRS} SELECT count(*)::BIGINT AS total, count(*) FILTER (score < 7.0)::BIGINT AS filtered, count(*) FILTER (score >= 7.0)::BIGINT AS remaining, (SELECT count(DISTINCT conv_id) FROM pairs WHERE conv_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS skipped_files, round(count(*) FILTER (score >= 7.0) * 100.0 / count(*), 6) AS retention FROM scored")
def _retention(spark, d):
    return curation.retention(_records(spark, d)).withColumn("retention", F.round("retention", 6))


@query("prj08_postprocess", f"""WITH {_PAIRS}, q AS (SELECT *, row_number() OVER (ORDER BY conv_id, pair_pos) - 1 AS n FROM pairs WHERE question <> '') SELECT printf('q%08d', n) AS query_id, question AS text, 'conv/' || conv_id AS corpus_id FROM q""")
def _postprocess(spark, d):
    queries, relevance, _ = curation.postprocessed(_records(spark, d))
    named = relevance.select(F.col("query-id").alias("query_id"), F.get(F.from_json("corpus-id", "array<string>"), F.lit(0)).alias("corpus_id"))
    return queries.select("query_id", "text").join(named, "query_id")


_CHUNKED = SENTENCES + """, rows AS (SELECT 'conv/' || doc_id AS file, doc_id, idx, text FROM ch WHERE text <> '')"""


def _chunked(records):
    return corpus.chunk_rows(records.withColumn("chunks", chunking.chunks(F.col("text"))))



@query("agg01_corpus_first_seen", f"WITH {_PAIRS}, {_CHUNKED} SELECT 'd_' || substr(sha256(text), 1, 16) AS corpus_id, first_rec, first_pos::INTEGER AS first_pos FROM (SELECT text, doc_id AS first_rec, idx - 1 AS first_pos, row_number() OVER (PARTITION BY text ORDER BY doc_id, idx) AS r FROM rows) WHERE r = 1")
def _corpus(spark, d):
    return corpus.corpus_of(_chunked(_records(spark, d))).select("corpus_id", "first_rec", "first_pos")


@query("agg02_last_wins", "SELECT source AS file_identifier, (doc_id % 50)::INTEGER AS chunk_id, arg_max(doc_id, doc_id) AS last_doc, md5(arg_max(text, doc_id)) AS md5 FROM documents WHERE text <> '' GROUP BY 1, 2")
def _last(spark, d):
    docs = _t(spark, d, "documents").where("text <> ''")
    rows = docs.select(F.col("source").alias("file_identifier"), (F.col("doc_id") % 50).cast("int").alias("chunk_id"), "text", F.col("doc_id").alias("rec_ord"), F.lit(0).alias("chunk_pos"))
    kept = corpus.chunk_map(rows).withColumn("md5", F.md5(F.col("text").cast("binary"))).drop("text")
    last = rows.groupBy("file_identifier", "chunk_id").agg(F.max("rec_ord").alias("last_doc"))
    return kept.join(last, ["file_identifier", "chunk_id"])


_POSITIVE = f"""{_PAIRS}, {_CHUNKED},
good AS (SELECT * FROM scored WHERE score >= 7.0 AND question <> ''),
seg AS (SELECT g.conv_id, g.pair_pos, unnest(segs) AS seg, unnest(range(0, len(segs))) AS pos FROM good g),
found AS (SELECT s.*, 'd_' || substr(sha256(r.text), 1, 16) AS id FROM seg s LEFT JOIN rows r ON r.file = 'conv/' || s.conv_id AND r.idx = s.seg),
whole AS (SELECT conv_id, pair_pos, string_agg(id, ',' ORDER BY pos) AS ids FROM found GROUP BY 1, 2 HAVING bool_and(id IS NOT NULL))"""


def _positives(spark, d):
    records = _records(spark, d).withColumn("file_identifier", text.record_identifier(F.col("source_id"), F.col("file_name")))
    pairs = curation.scored_pairs(records).withColumn("file_identifier", text.record_identifier(F.col("source_id"), F.col("file_name")))
    asked = records.join(pairs.select("file_identifier").distinct(), "file_identifier", "left_semi")  # only their texts are cut into chunks
    return corpus.with_positives(pairs, corpus.chunk_map(_chunked(asked)))


@query("jon01_positive_docs", f"WITH {_POSITIVE} SELECT conv_id AS rec_ord, pair_pos::INTEGER AS pair_pos, ids AS pos_ids FROM whole")
def _positive_docs(spark, d):
    return _positives(spark, d).select("rec_ord", "pair_pos", F.array_join("pos_ids", ",").alias("pos_ids"))


@query("jon02_qrels", f"""WITH {_POSITIVE} SELECT 'q' || conv_id || '-' || pair_pos AS "query-id", unnest(string_split(ids, ',')) AS "corpus-id", 1 AS score FROM whole""")
def _qrels(spark, d):
    named = _positives(spark, d).withColumn("query_id", F.concat(F.lit("q"), F.col("rec_ord").cast("string"), F.lit("-"), F.col("pair_pos").cast("string")))
    return corpus.relevance(named)


@query("win03_query_ordinals", "SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1)::BIGINT AS ordinal FROM documents")
def _ordinals(spark, d):
    return ordinals.with_ordinal(_t(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "ordinal")


@query("win05_batches", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 7)::BIGINT AS batch FROM documents")
def _batches(spark, d):
    return ordinals.with_ordinal(_t(spark, d, "documents").select("doc_id"), ["doc_id"]).select("doc_id", F.floor(F.col("ordinal") / 7).cast("long").alias("batch"))


@query("flt11_index_range", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n BETWEEN 10 AND 59")
def _range(spark, d):
    return ordinals.with_ordinal(_t(spark, d, "documents").select("doc_id"), ["doc_id"]).where("ordinal between 10 and 59").select("doc_id")


@query("lim01_num_files", "SELECT source || '/' || doc_id || '.txt' AS path FROM documents ORDER BY 1 LIMIT 25")
def _num_files(spark, d):
    return files.first_by_path(_t(spark, d, "documents").select(_path().alias("path")), 25)


@query("agg09_distribution", "SELECT lang, count(*)::BIGINT AS count, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS percent FROM documents GROUP BY lang")
def _distribution(spark, d):
    return curation.distribution(_t(spark, d, "documents"), "lang").withColumn("percent", F.round("percent", 6))


_VOTES = "votes AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY 1, 2)"


def _voted(spark, d):
    turns = _t(spark, d, "conversations").withColumn("query_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    relevance = turns.select("query_id", F.col("conv_id").cast("string").alias("corpus_id"), F.col("turn").alias("ord"))
    return curation.modality_votes(relevance, turns.select("query_id", F.col("role").alias("modality"), F.lit(0).alias("load_ord")))


@query("agg07_modality_vote", f"WITH {_VOTES} SELECT conv_id::VARCHAR AS corpus_id, arg_max(role, n * 1000000 - f) AS modality, string_agg(role, ',' ORDER BY role) AS modalities FROM votes GROUP BY conv_id")
def _vote(spark, d):
    return _voted(spark, d).withColumn("modalities", F.array_join("modalities", ","))


@query("jon08_positive_documents", f"WITH {_VOTES}, m AS (SELECT conv_id, arg_max(role, n * 1000000 - f) AS modality FROM votes GROUP BY conv_id) SELECT doc_id::VARCHAR AS doc_id, md5(text) AS md5, modality, conv_id::VARCHAR AS group_id FROM m JOIN documents ON doc_id = conv_id WHERE length(text) >= 100")
def _positive_documents(spark, d):
    name = F.col("doc_id").cast("string")
    docs = _t(spark, d, "documents").select(name.alias("_id"), "text", F.lit(None).cast("string").alias("title"), name.alias("group_id"), F.col("doc_id").alias("line_ord"))
    found = curation.positive_documents(_voted(spark, d), docs, 100)
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), "modality", "group_id")


# --- dedup, graph, splits ----------------------------------------------------


@query("ded01_greedy_cosine", """WITH RECURSIVE e AS (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g(label, rn, kept, ids) AS (
  SELECT label, rn, [v], [vec_id] FROM e WHERE rn = 1
  UNION ALL
  SELECT e.label, e.rn, CASE WHEN hit THEN kept ELSE list_append(kept, v) END, CASE WHEN hit THEN ids ELSE list_append(ids, vec_id) END
  FROM (SELECT g.label, g.rn + 1 AS rn, g.kept, g.ids, e.v, e.vec_id, len(list_filter(g.kept, lambda k: list_cosine_similarity(k, e.v) > 0.2)) > 0 AS hit
        FROM g JOIN e ON e.label = g.label AND e.rn = g.rn + 1) e)
SELECT label, unnest(ids) AS vec_id FROM g WHERE (label, rn) IN (SELECT label, max(rn) FROM e GROUP BY label)""")
def _greedy(spark, d):
    lists = _t(spark, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")))).alias("l"))  # a record's list
    kept = text.greedy_distinct(F.transform("l", lambda x: x["v"]), 0.2)
    return lists.select("label", "l", F.explode(kept).alias("i")).select("label", F.get("l", F.col("i"))["vec_id"].alias("vec_id"))


_ENDS = "e AS (SELECT doc_id, 'p' || substr(text, 1, 40) AS k FROM documents UNION ALL SELECT doc_id, 's' || right(text, 40) FROM documents)"


def _ends(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(F.concat(F.lit("p"), F.substring("text", 1, 40)).alias("group_id"), "doc_id").union(docs.select(F.concat(F.lit("s"), F.right("text", F.lit(40))), "doc_id"))


@query("grf02_components", f"""WITH RECURSIVE {_ENDS}, star AS (SELECT min(doc_id) AS a, k FROM e GROUP BY k), pairs AS (SELECT DISTINCT a, doc_id AS b FROM e JOIN star USING (k) WHERE a <> doc_id),
sym AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r(n, c) AS (SELECT DISTINCT a, a FROM sym UNION SELECT sym.b, r.c FROM r JOIN sym ON sym.a = r.n AND r.c < sym.b)
SELECT n AS node, min(c) AS component FROM r GROUP BY n""")
def _components(spark, d):
    groups = _ends(spark, d)
    anchors = groups.groupBy("group_id").agg(F.min("doc_id").alias("a"))
    edges = groups.join(anchors, "group_id").where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    return graph.components(edges)


@query("agg12_merged_groups", "WITH g AS (SELECT text, min(doc_id) AS low, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, printf('%010d', low)) AS r FROM g) SELECT printf('merged_%04d', r) AS group_id, printf('%010d', doc_id) AS doc_id FROM documents JOIN k USING (text)")
def _merged(spark, d):
    docs = _t(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("group_id"), F.format_string("%010d", "doc_id").alias("doc_id"))
    return graph.merged_groups(docs)


@query("jon05_file_group_match", "SELECT source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END AS file_name, source AS group_id FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT 'elsewhere/' || doc_id || '.md', source FROM documents WHERE doc_id % 3 = 2")
def _file_groups(spark, d):
    docs = _t(spark, d, "documents")
    number = F.col("doc_id").cast("string")
    file = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("elsewhere/"), number, F.lit(".md"))).otherwise(F.concat("source", F.lit("/"), number, F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".md")))
    return splits.file_groups(docs.select(F.col("source").alias("group_id"), _path().alias("doc_id")), docs.select(file.alias("file_name")))


@query("spl01_hash_split", "WITH k AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source)) - 1 AS r, (SELECT count(DISTINCT source) FROM documents) AS n FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM documents JOIN k USING (source)")
def _hash_split(spark, d):
    return splits.random_split(_t(spark, d, "documents").select("doc_id", "source"), key="source").select("doc_id", "split")


_GREEDY = """WITH RECURSIVE u AS (SELECT {unit} AS unit, count(*) AS w FROM documents GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY w DESC, md5('42|' || unit)) AS r, (SELECT count(*) FROM documents) AS t FROM u),
g(r, a, b, c, s, unit) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', '' UNION ALL
  SELECT o.r, a + CASE WHEN n = 'train' THEN w ELSE 0 END, b + CASE WHEN n = 'val' THEN w ELSE 0 END, c + CASE WHEN n = 'test' THEN w ELSE 0 END, n, o.unit
  FROM (SELECT o.*, g.a, g.b, g.c, CASE WHEN t * 0.8::DOUBLE - a >= greatest(t * 0.1::DOUBLE - b, t * (1.0::DOUBLE - 0.8::DOUBLE - 0.1::DOUBLE) - c) THEN 'train' WHEN t * 0.1::DOUBLE - b >= t * (1.0::DOUBLE - 0.8::DOUBLE - 0.1::DOUBLE) - c THEN 'val' ELSE 'test' END AS n
        FROM g JOIN o ON o.r = g.r + 1) o)
"""


@query("spl02_group_split", _GREEDY.format(unit="source") + "SELECT unit, s AS split FROM g WHERE r > 0")
def _group_split(spark, d):
    units = _t(spark, d, "documents").groupBy(F.col("source").alias("unit")).agg(F.count("*").cast("long").alias("weight"))
    return splits.greedy_split(units, 0.8, 0.1, 42)


@query("spl03_cluster_split", _GREEDY.format(unit="'group|' || source") + "SELECT doc_id, s AS split FROM documents JOIN g ON g.unit = 'group|' || source")
def _cluster_split(spark, d):
    docs = _t(spark, d, "documents").select(F.array(_path()).alias("file_name"), "doc_id", _path().alias("path"), "source")
    return splits.split(docs, "cluster", docs.select(F.col("source").alias("group_id"), F.col("path").alias("doc_id"))).select("doc_id", "split")


# --- registries ---------------------------------------------------------------


def _packages(spark, d, where):
    rows = _t(spark, d, "part").where(where)
    return rows.select(F.concat(F.lit("pkg"), F.col("p_partkey").cast("string"), F.lit("-1.0-py3-none-any.whl")).alias("filename"), F.concat(F.lit("sha256="), F.sha2(F.col("p_name").cast("binary"), 256)).alias("hash"), F.when(F.col("p_partkey") % 2 == 0, ">=3.10").alias("requires_python"))


@query("jon11_package_merge", "SELECT 'pkg' || p_partkey || '-1.0-py3-none-any.whl' AS filename, 'sha256=' || sha256(p_name) AS hash, CASE WHEN p_partkey % 2 = 0 THEN '>=3.10' END AS requires_python FROM part")
def _package_merge(spark, d):
    return registry.merged_package_lists(_packages(spark, d, "p_partkey % 3 <> 0"), _packages(spark, d, "p_partkey % 3 <> 1"))


@query("flt13_package_rows", "SELECT 'pkg' || p_partkey || '/x.whl' AS filename, unnest(['file name has a path', 'hash is not sha256']) AS error FROM part WHERE p_partkey % 5 = 0")
def _package_rows(spark, d):
    bad = F.col("filename").rlike("^pkg[0-9]*[05]-")
    rows = _packages(spark, d, "true").withColumns({"hash": F.when(bad, "sha1=0").otherwise(F.col("hash")), "filename": F.when(bad, F.regexp_replace("filename", "-1.0-py3-none-any", "/x")).otherwise(F.col("filename"))})
    return registry.package_list_errors(rows)


# Versions in the order of PEP 440.
VERSIONS = ("0.9.9", "1.0.dev3", "1.0a1", "1.0a2", "1.0b1.dev1", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.2", "1.10", "2.0", "1!0.1")


@query("srt03_package_order", f"""WITH v AS (SELECT unnest({list(VERSIONS)}) AS version, unnest(range(0, {len(VERSIONS)})) AS r),
f AS (SELECT p_partkey, 'pkg' || p_partkey // 50, r, 'pkg' || p_partkey // 50 || '-' || version || '-py3-none-any.whl' AS filename FROM part JOIN v ON r = p_partkey % {len(VERSIONS)})
SELECT p_partkey, filename, row_number() OVER (ORDER BY 'pkg' || p_partkey // 50, r, filename, p_partkey) - 1 AS place FROM f WHERE (p_partkey % 50) < {len(VERSIONS)}""")
def _package_order(spark, d):
    ship(spark)
    version = F.get(F.array(*[F.lit(v) for v in VERSIONS]), (F.col("p_partkey") % len(VERSIONS)).cast("int"))
    name = F.concat(F.lit("pkg"), F.floor(F.col("p_partkey") / 50).cast("string"), F.lit("-"), version, F.lit("-py3-none-any.whl"))
    return registry.placed_package_list(_t(spark, d, "part").where(F.col("p_partkey") % 50 < len(VERSIONS)).select("p_partkey", name.alias("filename")))


@query("agg14_unique", "SELECT p_brand, count(*)::BIGINT AS count FROM part GROUP BY p_brand HAVING count(*) > 1")
def _unique(spark, d):
    return registry.repeated_names(_t(spark, d, "part"), "p_brand")


@query("agg15_consistency", "SELECT p_brand, unnest(list_filter([CASE WHEN count(DISTINCT p_type) > 1 THEN 'p_type' END, CASE WHEN count(DISTINCT p_size) > 1 THEN 'p_size' END], lambda x: x IS NOT NULL)) AS field FROM part GROUP BY p_brand")
def _consistency(spark, d):
    return registry.inconsistent(_t(spark, d, "part"), "p_brand", ["p_type", "p_size"])


@query("set04_missing", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0)")
def _missing(spark, d):
    some = _t(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return registry.missing_from(_t(spark, d, "nation").select("n_nationkey", "n_name"), some, ["n_nationkey"])


@query("set05_register", "SELECT r_name AS package, r_regionkey AS version FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 'ASIA', 99")
def _register(spark, d):
    have = _t(spark, d, "region").select(F.col("r_name").alias("package"), F.col("r_regionkey").alias("version"))
    new = spark.range(1).select(F.lit("ASIA").alias("package"), F.lit(99).cast(have.schema["version"].dataType).alias("version"))
    return registry.registered(have, new, "ASIA", replace=True)


@query("jon13_tree_differences", "SELECT 'p/' || page_id AS path, CASE WHEN page_id % 10 = 1 THEN 'missing' WHEN page_id % 10 = 2 THEN 'stale' ELSE 'outdated' END AS state FROM pages WHERE page_id % 10 IN (1, 2, 3)")
def _tree(spark, d):
    tree = _t(spark, d, "pages").select("page_id", F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("path"), F.sha2(F.col("html").cast("binary"), 256).alias("sha"))
    changed = tree.where("page_id % 10 <> 1").withColumn("sha", F.when(F.col("page_id") % 10 == 3, "x").otherwise(F.col("sha")))
    return registry.tree_differences(tree.where("page_id % 10 <> 2"), changed)


# --- generation -----------------------------------------------------------------


@query("gen06_prompt_render", f"WITH {SENTENCES} SELECT doc_id, md5('Segments:' || chr(10) || string_agg('Segment ' || idx || ': ' || text, chr(10) ORDER BY idx)) AS prompt_md5 FROM ch GROUP BY doc_id")
def _prompt(spark, d):
    found = _t(spark, d, "documents").select("doc_id", chunking.chunks(F.col("text")).alias("chunks")).where("size(chunks) > 0")
    return found.select("doc_id", F.md5(F.concat(F.lit("Segments:\n"), numbered_segments()).cast("binary")).alias("prompt_md5"))


@query("gen06_evaluation_prompt", f"""WITH {SENTENCES}, segments AS (SELECT doc_id, string_agg('Segment ' || idx || ': ' || text, chr(10) ORDER BY idx) AS s FROM ch GROUP BY doc_id)
SELECT doc_id, md5('EVALUATIONS one for each question, in order, scores from 1 to 10. Answer in JSON.' || chr(10) || s || chr(10) || 'Question 1: Who is ' || source || '?' || chr(10) || 'Answer: ' || lang || chr(10) || 'Question 2: ' || chr(10) || 'Answer: none') AS prompt_md5
FROM segments JOIN documents USING (doc_id) WHERE lang IS NOT NULL""")
def _evaluation_prompt(spark, d):
    one = F.struct(F.concat(F.lit("Who is "), "source", F.lit("?")).alias("question"), F.col("lang").alias("answer"))
    two = F.struct(F.lit(None).cast("string").alias("question"), F.lit("none").alias("answer"))
    found = _t(spark, d, "documents").withColumns({"chunks": chunking.chunks(F.col("text")), "deduplicated_qa_pairs": F.array(one, two)}).where("size(chunks) > 0 and lang is not null")
    return found.select("doc_id", F.md5(evaluation_prompt().cast("binary")).alias("prompt_md5"))


@query("gen_stub_pipeline", "SELECT source || '/' || doc_id || '.txt' AS source_id, 7 AS pairs, 7 AS kept, 7 AS evaluated FROM documents WHERE trim(text, E' \\t\\n\\r') <> ''")
def _generated(spark, d):
    from loomspark.plans.config import PipelineConfig
    from loomspark.plans.generate import StubClient, question_columns, run_columns

    seeds = chunking.single_documents(_t(spark, d, "documents").select(_path().alias("path"), "text"))
    made = run_columns(seeds, question_columns(PipelineConfig()), StubClient())
    return made.select("source_id", F.size("qa_generation.pairs").alias("pairs"), F.size("deduplicated_qa_pairs").alias("kept"), F.size("qa_evaluations.evaluations").alias("evaluated"))
