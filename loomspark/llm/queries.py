"""The queries of this subpackage: one thin query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, langid, licenses, linededup, minhash_dedup, mixing, sharding, tiff, urlfilter, warc
from loomspark.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("active_weight", F.round("active_weight", 9))


OP1_SQL = f"""
WITH RECURSIVE sources AS (
  SELECT source, count(*) AS n, pow(count(*), 0.7) AS w, ceil(count(*) / {mixing.BLOCK_ROWS})::BIGINT AS blocks, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM documents GROUP BY source),
lists AS (SELECT list(w ORDER BY i) AS w, list(blocks ORDER BY i) AS blocks, count(*) AS k FROM sources),
-- turn: slots of this phase so far; given: each source's blocks in this phase; left: those it still has
steps(slot, phase, turn, given, left_, i, block, active) AS (
  SELECT -1::BIGINT, 0, 0::BIGINT, list_transform(w, lambda x: 0::BIGINT), blocks, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE FROM lists
  UNION ALL
  SELECT slot + 1, CASE WHEN fresh THEN phase + 1 ELSE phase END, CASE WHEN fresh THEN 1 ELSE turn + 1 END,
    list_transform(range(1, k + 1), lambda x: CASE WHEN fresh THEN 0 ELSE given[x] END + CASE WHEN x = best THEN 1 ELSE 0 END),
    list_transform(range(1, k + 1), lambda x: left_[x] - CASE WHEN x = best THEN 1 ELSE 0 END), best, blocks[best] - left_[best], total / list_sum(w)
  FROM (
    SELECT *, list_min(list_transform(list_filter(range(1, k + 1), lambda x: left_[x] > 0 AND floor(CASE WHEN fresh THEN 0 ELSE given[x] END * total / w[x]) <= CASE WHEN fresh THEN 0 ELSE turn END),
      lambda x: [ceil((CASE WHEN fresh THEN 0 ELSE given[x] END + 1) * total / w[x]), x::DOUBLE]))[2]::BIGINT AS best
    FROM (
      SELECT steps.*, lists.*, slot >= 0 AND left_[i] = 0 AS fresh, list_sum(list_transform(range(1, k + 1), lambda x: CASE WHEN left_[x] > 0 THEN w[x] ELSE 0 END)) AS total
      FROM steps, lists WHERE list_sum(left_) > 0))),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id) - 1 AS r FROM documents)
SELECT doc_id, ranked.source, phase::INTEGER AS phase, slot, row_number() OVER (ORDER BY slot, r) - 1 AS position, round(active, 9) AS active_weight
FROM ranked JOIN sources ON ranked.source IS NOT DISTINCT FROM sources.source JOIN steps ON steps.i = sources.i AND block = r // {mixing.BLOCK_ROWS}
"""


# The rules of the URL filter, as (verdict, host, path).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, URL_RULES, urlfilter.page_links(pages))


def _sql_rules() -> str:
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)


def _sql_key(url: str) -> str:
    """alias_key of a url in SQL; null without ://."""
    host = rf"lower(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1))"
    path = rf"regexp_replace(regexp_replace(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(/index)?\.html?$', ''), '/+$', '')"
    kept = rf"list_filter(string_split(regexp_extract({url}, '(?s)^[^#]*?\?([^#]*)', 1), '&'), lambda x: NOT regexp_matches(x, '^({'|'.join(urlfilter.TRACKING)})='))"
    return f"CASE WHEN contains({url}, '://') THEN {host} || {path} || '?' || array_to_string({kept}, '&') END"


def _sql_links() -> str:
    """(src, dst) of the tags that name another address, in SQL."""
    quoted = lambda p: p.replace("'", "''")
    one = "SELECT url AS src, regexp_extract(t, '{2}', 1) AS l FROM (SELECT url, unnest(regexp_extract_all(html, '{0}')) AS t FROM pages WHERE url IS NOT NULL) WHERE regexp_matches(t, '{1}')"
    return " UNION ALL ".join(one.format(*map(quoted, tag)) for tag in urlfilter.LINK_TAGS)


OP2_SQL = rf"""
WITH RECURSIVE urls AS (
  SELECT page_id, url, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {_sql_key("url")} AS key
  FROM pages),
tags AS (SELECT src, replace(l, '&amp;', '&') AS l FROM ({_sql_links()}) WHERE l <> ''),
bases AS (
  SELECT src, l, regexp_extract(src, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(src, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(src, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) AS folder FROM tags),
links AS (
  SELECT src, CASE WHEN contains(l, '://') THEN l WHEN starts_with(l, '//') THEN scheme || ':' || l WHEN starts_with(l, '/') THEN root || l
    ELSE CASE WHEN ends_with(folder, '/') THEN folder ELSE root || '/' END || l END AS dst FROM bases),
ends AS (SELECT {_sql_key("src")} AS a, {_sql_key("dst")} AS b, dst FROM links WHERE contains(src, '://') AND contains(dst, '://')),
edges AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
reach(k, c) AS (SELECT DISTINCT a, a FROM edges UNION SELECT edges.b, reach.c FROM reach JOIN edges ON edges.a = reach.k AND reach.c < edges.b),
aliases AS (SELECT k, min(c) AS c FROM reach GROUP BY k),
rules(v, h, p) AS (VALUES {_sql_rules()}),
places AS (SELECT DISTINCT host, path FROM urls UNION SELECT lower(regexp_extract(dst, '(?s)^.*?://([^/?#]*)', 1)), regexp_extract(dst, '(?s)^.*?://[^/?#]*([^?#]*)', 1) FROM ends),
fits AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS own
  FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2),
own AS (SELECT page_id, host, path, rule, own, coalesce(c, key) AS alias_of FROM urls LEFT JOIN fits USING (host, path) LEFT JOIN aliases ON k = key),
bad AS (
  SELECT alias_of AS x FROM own WHERE own = 'block'
  UNION SELECT coalesce(c, b) FROM ends JOIN fits ON host = lower(regexp_extract(dst, '(?s)^.*?://([^/?#]*)', 1)) AND path = regexp_extract(dst, '(?s)^.*?://[^/?#]*([^?#]*)', 1) LEFT JOIN aliases ON k = b WHERE own = 'block')
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN x IS NULL THEN 'allow' ELSE 'block' END) AS verdict, alias_of
FROM own LEFT JOIN bad ON alias_of = x
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def _sql_templates() -> str:
    return ", ".join(f"({i}, '{t.label}', {t.base}, '{t.text}')" for i, t in enumerate(licenses.TEMPLATES))


OP3_SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
templates(t, label, base, words) AS (VALUES {_sql_templates()}),
tw AS (SELECT t, label, base, string_split(words, ' ') AS w FROM templates),
tg AS (SELECT t, label, base, len(w) AS size, unnest(range(0, len(w) - 1)) AS tpos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
grams AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
votes AS (SELECT DISTINCT doc_id, t, label, base, size, tpos, pos, pos - tpos AS d FROM grams JOIN tg USING (g)),
diag AS (SELECT doc_id, t, label, base, size, d, count(*) AS votes FROM votes GROUP BY ALL),
whole AS (SELECT doc_id, label, base, d AS start, 1.0::DOUBLE AS coverage FROM diag WHERE size < {licenses.LONG} AND votes = size - 1),
near AS (
  SELECT *, max(votes * 4294967296 - d) OVER win AS best, sum(votes) OVER win AS total FROM diag WHERE size >= {licenses.LONG}
  WINDOW win AS (PARTITION BY doc_id, t ORDER BY d RANGE BETWEEN {licenses.NEAR} PRECEDING AND {licenses.NEAR} FOLLOWING)),
centres AS (SELECT doc_id, t, d AS c FROM near WHERE best = votes * 4294967296 - d AND total >= {licenses.COVERAGE} * (size - 1)),
merged AS (
  SELECT doc_id, label, base, min(pos) AS start, least(count(DISTINCT tpos), count(DISTINCT pos)) / (size - 1) AS coverage
  FROM votes JOIN centres USING (doc_id, t) WHERE d BETWEEN c - {licenses.NEAR} AND c + {licenses.NEAR}
  GROUP BY doc_id, t, label, base, size, c HAVING least(count(DISTINCT tpos), count(DISTINCT pos)) / (size - 1) >= {licenses.COVERAGE}),
spans AS (SELECT * FROM whole UNION ALL SELECT * FROM merged),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM spans GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN found ON w.doc_id = found.doc_id
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


OP4_SQL = r"""
WITH sums AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
parts AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || hex[g * 5 + 1:g * 5 + 5])::INTEGER) AS v FROM sums),
coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x >> 15) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> 10) & 31) + 1] ||
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> 5) & 31) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x & 31) + 1]), '') AS payload_digest
  FROM parts),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM coded)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to, true AS digest_ok
FROM firsts
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=40)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return judged.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = linededup.later_matches(table(spark, sf_dir, "documents"), percent=80)
    return judged.withColumn("removed_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ","))


OP8_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT row_number() OVER (ORDER BY doc_id, pos) AS o, doc_id, pos, list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
  FROM split),
sets AS (SELECT list_sort(w) AS w, min(o) AS o, len(w) AS n FROM lines WHERE len(w) > 0 GROUP BY list_sort(w), len(w)),
words AS (SELECT o, n, unnest(w) AS x FROM sets),
counts AS (SELECT x, count(*) AS m FROM words GROUP BY x),
placed AS (SELECT o, n, x, row_number() OVER (PARTITION BY o ORDER BY m, x) AS i FROM words JOIN counts USING (x)),
prefixes AS (SELECT * FROM placed WHERE i <= n - ceil(n * 8 / 10) + 1),
pairs AS (
  SELECT DISTINCT a.o AS early, b.o AS late FROM prefixes a JOIN prefixes b ON a.x = b.x AND a.o < b.o AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
matched AS (
  SELECT DISTINCT late FROM pairs JOIN sets a ON a.o = early JOIN sets b ON b.o = late
  WHERE 100 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
gone AS (
  SELECT l.doc_id, l.pos FROM lines l JOIN sets s ON s.w = list_sort(l.w) LEFT JOIN matched m ON m.late = s.o WHERE len(l.w) > 0 AND (m.late IS NOT NULL OR l.o <> s.o)),
listed AS (SELECT doc_id, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS p FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text) - length(replace(text, chr(10), '')) + 1, 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(p, '') AS removed_lines
FROM documents d LEFT JOIN listed ON listed.doc_id = d.doc_id
"""


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.texts_as_media(table(spark, sf_dir, "documents"))
    stored = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff.read_pages(stored).drop("media")
    feature = F.format_string("tiff %dx%d compression=%d predictor=%d tiled=%s histogram=%s", "width", "height", "compression", "predictor", F.col("tiled").cast("string"), F.array_join("histogram", "/"))
    return pages.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, percent=80)


OP10_SQL = r"""
WITH words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)),
items AS (SELECT id, w, least(len(w), 5) AS k FROM words WHERE kind = 'i' AND len(w) > 0),
pieces AS (
  SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM items),
sizes AS (SELECT id, count(*) AS n FROM pieces GROUP BY id),
docs AS (
  SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM words, (SELECT DISTINCT k FROM items) WHERE kind = 'd' AND len(w) >= k)
SELECT docs.id AS doc_id, pieces.id AS item_id, any_value(n) AS n_item, count(*) AS n_shared, count(*) / any_value(n) AS containment
FROM docs JOIN pieces USING (k, s) JOIN sizes ON sizes.id = pieces.id
GROUP BY 1, 2 HAVING count(*) * 100 >= any_value(n) * 80
"""


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.y, reach.c FROM reach JOIN sym ON sym.x = reach.d AND reach.c < sym.y),
comp AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, t.doc_id = c AS kept
FROM documents t LEFT JOIN sizes USING (doc_id) JOIN comp ON d = t.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_url_filter": op2_url_filter,
    "op3_licenses": op3_licenses,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_tiff": op9_tiff,
    "op10_decontamination": op10_decontamination,
}

SQL: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op2_url_filter": OP2_SQL,
    "op3_licenses": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op7_minhash_dedup": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_decontamination": OP10_SQL,
}
