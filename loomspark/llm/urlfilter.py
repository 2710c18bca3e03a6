"""URL filtering by host and path rules, with block decisions propagated over redirect and canonical-link aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import lower_ascii, materialize, small_enough
from loomspark.llm.components import connected_components

ALLOW, BLOCK = "allow", "block"
#: Rules held in one expression at most; more are joined with hosts' suffixes. Rules, or components' members, that are broadcast at most.
RULES, BROADCAST = 200, 500_000
#: Query parameters that don't change what a url shows.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid")
#: Tags that name another address of a page: the tag, what makes it one, and the address in it.
LINK_TAGS = (
    (r"(?is)<link\b[^>]*>", r"""(?is)\brel\s*=\s*["']?canonical\b""", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""),
    (r"(?is)<meta\b[^>]*>", r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """The address that trivial variants of a url share: no scheme, fragment, tracking parameters, closing slash or .html."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1), F.lit(""))
    kept = F.regexp_replace(query, rf"(^|(?<=&))({'|'.join(TRACKING)})=[^&]*(&|$)", "")
    path = F.regexp_replace(path_of(url), r"(/index)?\.html?$", "")
    return F.concat(host_of(url), F.regexp_replace(path, "/+$", ""), F.lit("?"), F.regexp_replace(kept, "&$", ""))


def absolute(link: Column, base: Column) -> Column:
    """A link as a page at base means it: with its own scheme, of the same scheme, from the host's root, or from the page's folder."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/")))
    return F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) urls of all canonical links and meta refreshes in pages' html; null html or urls have none."""
    out = None
    rows = pages.select(F.col(url_col).alias("src"), F.col(html_col).alias("html")).where("src is not null")
    for tag, kind, address in LINK_TAGS:
        tags = F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))
        links = rows.select("src", F.explode(tags).alias("t")).select("src", F.regexp_extract("t", address, 1).alias("l")).where("l <> ''")
        links = links.select("src", absolute(F.replace("l", F.lit("&amp;"), F.lit("&")), F.col("src")).alias("dst"))
        out = links if out is None else out.union(links)
    return out


def _rank(verdict: str, host: str, path: str) -> tuple:
    """Longer rules win; of equally long ones, block, then the last by name."""
    return len(host) + len(path), verdict == BLOCK, host + path


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits; null if none does. Of equally long ones, block comes first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: _rank(*r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (with host and path) with own: the struct that rule_match gives.

    Up to RULES rules are one expression. More, or a table of rules (verdict,
    host, path), are joined: each different host and path meets the rules of
    its host and of the domains above it.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= RULES:
            return urls.withColumn("own", rule_match(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    table = rules.select(F.col("host").alias("domain"), F.col("path").alias("start"), "verdict")
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.select("host", "path", F.explode(domains).alias("domain")).join(small_enough(table, BROADCAST), "domain").where(F.col("path").startswith(F.col("start")))
    rule = F.concat("domain", "start")
    best = F.max(F.struct(F.length(rule).alias("size"), (F.col("verdict") == BLOCK).alias("block"), rule.alias("rule"), "verdict")).alias("b")
    best = met.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(best)
    out = urls.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return out.withColumn("own", F.when(F.col("b").isNotNull(), F.struct("b.rule", "b.verdict"))).drop("_host", "_path", "b")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", variants: bool = True) -> DataFrame:
    """(id_col, host, path, rule, verdict, alias_of) for every row.

    A row's own longest rule decides (of equally long ones, block), so an
    explicit allow holds whatever its aliases are. A url without a rule is
    blocked if an alias is: urls are aliases if redirects or canonical links
    (links: src, dst) connect them, in any number of steps and either way. With
    variants, urls that share an alias_key, which servers commonly redirect to
    one address, count as one; without, only equal urls do. All else is
    allowed. alias_of is the smallest key of the row's component.

    Null urls and urls without :// have an empty host and path, fit no rule and
    have no aliases: they are allowed. Very long urls are judged whole. Repeated
    rows are judged alike. No rows give no rows; other columns are ignored.
    Components are found in the shared folder, distributed; very common hosts or
    link targets are no hot keys.
    """
    key_of = alias_key if variants else (lambda url: url)
    found = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    found = with_rule(found.withColumn("key", F.when(F.coalesce(F.col("url").contains("://"), F.lit(False)), key_of(F.col("url")))), rules)
    rows = materialize(found.select("id", "host", "path", "key", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("own")), "urls")
    blocked = rows.where((F.col("own") == BLOCK) & F.col("key").isNotNull()).select("key")
    if links is not None:
        ends = links.select(key_of(F.col("src")).alias("a"), key_of(F.col("dst")).alias("b"), F.col("dst"))
        ends = materialize(ends.where("a is not null and b is not null"), "links")
        # A link's target may be no page of its own, yet be blocked by a rule.
        targets = with_rule(ends.select(F.col("b").alias("key"), host_of(F.col("dst")).alias("host"), path_of(F.col("dst")).alias("path")), rules)
        blocked = blocked.union(targets.where(F.col("own.verdict") == BLOCK).select("key"))
        labels = small_enough(connected_components(ends.select("a", "b")), BROADCAST)
        rows = rows.join(labels, rows["key"] == labels["node"], "left").withColumn("alias_of", F.coalesce("component", "key")).drop("node", "component")
        blocked = blocked.join(labels, blocked["key"] == labels["node"], "left").select(F.coalesce("component", "key").alias("bad"))
    else:
        rows = rows.withColumn("alias_of", F.col("key"))
        blocked = blocked.select(F.col("key").alias("bad"))
    blocked = blocked.distinct()
    judged = rows.join(blocked, rows["alias_of"] == blocked["bad"], "left")
    verdict = F.coalesce("own", F.when(F.col("bad").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "alias_of")
