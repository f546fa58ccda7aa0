"""URL filtering with redirect equivalence.

Rules decide by host and path. What no rule decides takes the decision of its aliases: redirect
(meta refresh) and canonical-link edges of the pages join addresses into components, found by a
distributed algorithm; a component in which a rule blocks an address is blocked, unless a rule
explicitly allows one of its addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    """What follows the host: path, query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does: one expression, no join."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        name, verdict = F.when(fits, F.lit(at + under)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def without_dots(path: Column) -> Column:
    """A path with its dot segments resolved: . is left out, .. leaves out the segment before it."""
    step = lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.array_append(done, part))
    # A last . or .. names a folder.
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), resolved).otherwise(path)


def decoded(value: Column) -> Column:
    """Character references that addresses have, decoded."""
    for pattern, letter in ((r"&(quot|#34|#x22);", '"'), (r"&(apos|#39|#x27);", "'"), (r"&(#47|#x2f|sol);", "/"), (r"&(amp|#38|#x26);", "&")):
        value = F.regexp_replace(value, "(?i)" + pattern, letter)
    return value


def address_of(host: Column, rest: Column) -> Column:
    """Name of an address in the graph: host, path and query; rest is what follows the host. An empty path is /."""
    path, query = F.regexp_replace(rest, r"(?s)[?#].*$", ""), F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(without_dots(path)), query)


def targets_of(html: Column, host: Column, path: Column) -> Column:
    """Addresses that a page names as its canonical one or sends its readers to: an array of all of them."""
    link = F.regexp_extract_all(html, F.lit(r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"), 1)
    refresh = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*([^\"'\s>]+)"), 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")

    def address(to: Column) -> Column:
        full = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.lit("x:"), to))
        return (
            F.when(full.isNotNull(), address_of(host_of(full), rest_of(full)))
            .when(to.startswith("/"), address_of(host, to))
            .when(to.startswith("?"), address_of(host, F.concat(path, to)))
            .when(~to.startswith("#"), address_of(host, F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), to)))
        )

    return F.transform(F.array_distinct(F.transform(F.concat(link, refresh), decoded)), address)


def judge_urls(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per page.

    Null addresses and those without :// have empty host and path; no rule fits them and they have no
    aliases. Null html has no edges. Addresses with other queries are other addresses. Repeated rows are
    judged alike; other columns are ignored; empty tables give empty results. What neither a rule nor
    an alias decides is allowed.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col(url_col)
    table = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), rest_of(url).alias("rest"), F.col(html_col).alias("html"))
    node = F.when((F.col("host") != "") | (F.col("rest") != ""), address_of(F.col("host"), F.col("rest")))
    table = table.select("page_id", "host", "path", node.alias("node"), targets_of(F.col("html"), F.col("host"), F.col("path")).alias("targets"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    table = scratch.write(table.select("*", rule.alias("rule"), verdict.alias("verdict")), "judged")
    edges = table.where("node is not null").select("node", F.explode("targets").alias("target")).where("target is not null and target <> node").select(F.col("node").alias("a"), F.col("target").alias("b"))
    labels = connected_components(scratch, edges)
    at, under = F.regexp_extract("node", r"(?s)^([^/?]*)", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)
    own = rule_for(at, under, rules)[1]
    votes = labels.groupBy("root").agg(F.max(own == "allow").alias("allowed"), F.max(own == "block").alias("blocked"))
    blocked = scratch.write(labels.join(votes.where("blocked and not coalesce(allowed, false)"), "root", "left_semi").select("node"), "blocked")
    scratch.keep(table, blocked)
    out = table.drop("targets").join(blocked.withColumn("alias", F.lit("block")), "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_urls of all pages by RULES, nulls and repeats as there."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_address(host: str, rest: str) -> str:
    path = f"regexp_replace({rest}, '(?s)[?#].*$', '')"
    parts = f"list_prepend('', string_split(regexp_replace(regexp_replace({path}, '^/', ''), '(^|/)(\\.\\.?)$', '\\1\\2/'), '/'))"
    dots = f"list_reduce({parts}, lambda done, part: CASE WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN part = '.' THEN done ELSE done || '/' || part END)"
    whole = f"CASE WHEN {path} = '' THEN '/' WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN {dots} ELSE {path} END"
    return f"({host} || {whole} || regexp_extract({rest}, '(?s)^[^?#]*(\\?[^#]*)', 1))"


_SQL_HOST = r"translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_REST = r"regexp_extract({0}, '(?s)^.*?://[^/?#]*(.*)$', 1)"


def _sql_rule(host: str, path: str) -> str:
    """The contract's rules, longest first."""
    return f"""CASE WHEN ({host} = 'example.com' OR {host} LIKE '%.example.com') AND starts_with({path}, '/en/7') THEN 'example.com/en/7'
         WHEN ({host} = 'example.net' OR {host} LIKE '%.example.net') AND starts_with({path}, '/de/8') THEN 'example.net/de/8'
         WHEN ({host} = 'com' OR {host} LIKE '%.com') AND starts_with({path}, '/en/') THEN 'com/en/'
         WHEN ({host} = 'net' OR {host} LIKE '%.net') AND starts_with({path}, '/de/') THEN 'net/de/'
         WHEN ({host} = 'org' OR {host} LIKE '%.org') AND starts_with({path}, '/es/') THEN 'org/es/' END"""


ORACLE_SQL = (
    r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, coalesce("""
    + _SQL_HOST.format("url")
    + r""", '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce("""
    + _SQL_REST.format("url")
    + r""", '') AS rest FROM pages),
j AS (SELECT *, CASE WHEN host <> '' OR rest <> '' THEN """
    + _sql_address("host", "rest")
    + r""" END AS node, """
    + _sql_rule("host", "path")
    + r""" AS rule, regexp_replace(path, '[^/]*$', '') AS folder FROM p),
v AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM j),
raw AS (
  SELECT node, host, path, folder, unnest(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda x: regexp_extract(x, '(?is)^.*\bhref\s*=\s*["'']?([^"''\s>]+)', 1))
    || list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda x: regexp_extract(x, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*([^"''\s>]+)', 1))) AS href
  FROM v WHERE node IS NOT NULL),
d AS (SELECT node, host, path, folder, regexp_replace(regexp_replace(regexp_replace(regexp_replace(href, '(?i)&(quot|#34|#x22);', '"', 'g'), '(?i)&(apos|#39|#x27);', '''', 'g'), '(?i)&(#47|#x2f|sol);', '/', 'g'), '(?i)&(amp|#38|#x26);', '&', 'g') AS href FROM raw WHERE href <> ''),
f AS (SELECT node, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN """
    + _SQL_HOST.format("href")
    + r""" WHEN starts_with(href, '//') THEN """
    + _SQL_HOST.format("'x:' || href")
    + r""" ELSE host END AS host, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN """
    + _SQL_REST.format("href")
    + r""" WHEN starts_with(href, '//') THEN """
    + _SQL_REST.format("'x:' || href")
    + r""" WHEN starts_with(href, '/') THEN href WHEN starts_with(href, '?') THEN path || href WHEN starts_with(href, '#') THEN NULL
     ELSE CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS rest FROM d),
t AS (SELECT node AS a, """
    + _sql_address("host", "rest")
    + r""" AS b FROM f WHERE rest IS NOT NULL),
e AS (SELECT a, b FROM t WHERE a <> b UNION SELECT b, a FROM t WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
n AS (SELECT DISTINCT a AS node, regexp_extract(a, '(?s)^([^/?]*)', 1) AS host, regexp_extract(a, '(?s)^[^/?]*([^?]*)', 1) AS path FROM e),
r AS (SELECT node, """
    + _sql_rule("host", "path")
    + r""" AS rule FROM n),
w AS (SELECT reach.a AS node, bool_or(r.rule IN ('example.com/en/7', 'net/de/')) AS allowed, bool_or(r.rule NOT IN ('example.com/en/7', 'net/de/')) AS blocked FROM reach JOIN r ON r.node = reach.b GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN w USING (node)
"""
)
