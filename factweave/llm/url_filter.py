"""Operator 4: URL filters with redirect equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, held

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change the page.
_TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """Name of the page behind a URL: no scheme, www., m., fragment, .html, index page, closing slash or tracking parameter; null without ://."""
    host = F.regexp_replace(host_of(url), r"^((www|m)\.)+", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    return F.when(url.contains("://"), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def link_targets(html: Column) -> Column:
    """Targets of the canonical link and of the refresh redirect of a page, as written there."""
    link = F.regexp_extract(html, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    meta = F.regexp_extract(html, r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    return F.array(F.regexp_extract(link, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.regexp_extract(meta, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))


def resolved(target: Column, url: Column) -> Column:
    """A target as an absolute URL, seen from ``url``; null where it has none."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.concat(F.regexp_replace(path_of(url), r"[^/]*$", ""))
    return (
        F.when(F.coalesce(target, F.lit("")) == "", None)
        .when(target.contains("://"), target)
        .when(~url.contains("://"), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each distinct url: url, rule, verdict.

    ``urls`` has url, host, path.  Each host is taken with all its parent
    domains and joined to the rules by equality, so long rule lists work too.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = urls.select("url", "path", F.explode(parents).alias("rule_host")).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict"))
    return fitting.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")


def url_filter(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Allow or block every page, aliases included.

    ``rules``: rule (text), rule_host, rule_path, verdict (allow or block).  A
    rule fits its host and all subdomains if the path starts with its path; the
    longest wins and decides the pages that it fits.  For the others decisions
    spread over aliases.  One edge table holds each URL with its ``alias_key``, the
    canonical links and refresh redirects in the HTML, and ``redirects`` (source,
    target; neither needs to be a page, and rules judge both); its connected
    components are found by distributed contraction.  An
    explicit allow anywhere in a component goes before a block; a component with
    a block and no allow is blocked; anything else is allowed.

    Null URLs and URLs without :// have empty host and path, no alias and fit no
    rule: allowed.  Of rules of one text the greater verdict counts.  Repeated rows give
    repeated rows, null ids are handed on; an empty table gives no
    rows; a very long URL or page is one row like any other; other columns are not
    looked at, whatever their names.  Columns: id, host, path, rule,
    verdict, alias.
    """
    seen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    links = None
    if html_col:
        links = pages.select(F.col(url_col).alias("source"), F.explode(link_targets(F.col(html_col))).alias("target")).where("target <> ''")
    if redirects is not None:
        more = redirects.select("source", "target")
        links = more if links is None else links.unionByName(more)
    urls = seen.select("url")
    if links is not None:
        links = held(links.select("source", resolved(F.col("target"), F.col("source")).alias("target")).where("target IS NOT NULL").distinct())
        urls = urls.union(links.select("source")).union(links.select("target"))
    urls = urls.where("url IS NOT NULL").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "alias": alias_key(F.col("url"))})
    judged = held(urls.join(ruled(urls, rules).hint("merge"), "url", "left"))

    node = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    edges = judged.where("alias IS NOT NULL").select(node("url ", "url").alias("a"), node("alias ", "alias").alias("b"))
    if links is not None:
        edges = edges.union(links.select(node("url ", "source"), node("url ", "target")))
    ends = components(edges).where(F.col("node").startswith("url ")).select(F.substring("node", 5, 2**31 - 1).alias("url"), "component")
    placed = held(judged.join(ends.hint("merge"), "url", "left"))
    says = lambda v: F.max(F.coalesce(F.col("verdict") == v, F.lit(False))).alias(v)
    groups = placed.where("component IS NOT NULL").groupBy("component").agg(says("allow"), says("block"))
    spread = F.when(F.col("block") & ~F.col("allow"), "block").otherwise("allow")
    decided = placed.join(groups.hint("merge"), "component", "left").select("url", "host", "path", "rule", F.coalesce("verdict", spread, F.lit("allow")).alias("verdict"), "alias")
    return seen.join(decided.hint("merge"), "url", "left").select(F.col("id").alias(id_col), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "alias")


#: The rules of the registered query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    rows = [(rule, rule.partition("/")[0], "/" + rule.partition("/")[2], verdict) for rule, verdict in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, verdict string")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


QUERIES = {"op4_url_filter": op4_url_filter}
#: The pages of the tables have no canonical links and refresh redirects, so the SQL spreads decisions over alias keys alone.
ORACLE_SQL = {
    "op4_url_filter": f"""
WITH rules(rule, rh, rp, v) AS (VALUES {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)}),
p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
      list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACKING}'))) AS q FROM pages),
k AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^((www|m)\\.)+', '') || regexp_replace(path, '(/index)?(\\.html?)?/*$', '')
      || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS alias FROM p),
f AS (SELECT page_id, url, rule, v, row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule) DESC, rule DESC) AS n
      FROM k JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
j AS (SELECT k.*, f.rule, f.v FROM k LEFT JOIN f ON f.page_id = k.page_id AND f.url = k.url AND n = 1),
g AS (SELECT alias, bool_or(coalesce(v = 'allow', false)) AS a, bool_or(coalesce(v = 'block', false)) AS b FROM j WHERE alias IS NOT NULL GROUP BY alias)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN b AND NOT a THEN 'block' ELSE 'allow' END) AS verdict, j.alias FROM j LEFT JOIN g ON j.alias = g.alias
"""
}
