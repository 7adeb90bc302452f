"""URL filters with block decisions carried over redirects and canonical links (operator 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import materialize, table
from mercadia.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not name another page.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TO = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host on, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """The page that a url names: host, path and query without scheme, fragment and tracking; null without a scheme."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def match_rules(urls: DataFrame, rules: DataFrame, in_plan: int = 256) -> DataFrame:
    """Add rule and rule_verdict: the longest rule (host and path) that fits; of equally long ones that of the longer host.

    urls has host and path. Up to in_plan rules are tried one after another in the plan itself; more are joined by
    every parent domain of the distinct (host, path) pairs."""
    name = F.concat("rule_host", "rule_path")
    given = rules.select(F.col("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host is not null")
    few = given.limit(in_plan + 1).collect()
    if len(few) <= in_plan:
        found = F.lit(None).cast("struct<rule:string,verdict:string>")
        for r in sorted(few, key=lambda r: (len(r.rule_host) + len(r.rule_path), len(r.rule_host), r.rule_host, r.rule_path, r.verdict)):
            fits = ((F.col("host") == r.rule_host) | F.col("host").endswith("." + r.rule_host)) & F.col("path").startswith(r.rule_path)
            found = F.when(fits, F.struct(F.lit(r.rule_host + r.rule_path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
        return urls.withColumn("found", found).withColumn("rule", F.col("found.rule")).withColumn("rule_verdict", F.col("found.verdict")).drop("found")
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        pairs.withColumn("parent", F.explode(parents))
        .join(given, F.col("parent") == F.col("rule_host"))
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy(F.col("host").alias("h"), F.col("path").alias("p"))
        .agg(F.max(F.struct(F.length(name).alias("n"), F.length("rule_host").alias("m"), name.alias("rule"), F.col("verdict"))).alias("best"))
    )
    met = urls.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return met.withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.verdict")).drop("h", "p", "best")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component): allow or block for every page.

    pages: page_id, url, html; rules: host, path, verdict (allow or block); redirects: source, target urls known from
    elsewhere. A rule decides its pages. Links run from a page to its canonical link and to the target of its refresh
    tag (absolute, or absolute within the host), and along redirects; urls that differ in scheme, fragment or tracking
    parameters name one page. In a connected component that has a page blocked by rule and none allowed by rule, pages
    without a rule are blocked; everywhere else they are allowed, so an explicit allow takes precedence.

    Null urls, and those without a scheme, have empty host and path, no rule, no links, and are allowed. Null html has
    no links. Repeated rows are judged each for itself; an empty table gives an empty result; extra columns are ignored.
    """
    url = F.col("url")
    own = F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.col("to"))
    absolute = F.when(F.col("to").contains("://"), F.col("to")).when(F.col("to").startswith("/") & ~F.col("to").startswith("//"), own)
    tags = [(F.regexp_extract(F.col("html"), _CANONICAL, 0), _HREF), (F.regexp_extract(F.col("html"), _REFRESH, 0), _TO)]
    targets = F.filter(F.array(*(F.regexp_extract(tag, part, 1) for tag, part in tags)), lambda t: t != "")
    slim = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), page_key(url).alias("key"), targets.alias("targets"))
    judged = materialize(match_rules(slim, rules))
    edges = judged.select("url", F.explode("targets").alias("to"), "key").select(F.col("key").alias("a"), page_key(absolute).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(page_key(F.col("source")).alias("a"), page_key(F.col("target")).alias("b")))
    joined = components(edges)
    ruled = judged.where("rule_verdict is not null and key is not null").select("key", "rule_verdict").distinct()
    blocked = (
        joined.join(ruled, F.col("node") == F.col("key"))
        .groupBy("component")
        .agg(F.bool_or(F.col("rule_verdict") == "allow").alias("allowed"), F.bool_or(F.col("rule_verdict") == "block").alias("blocked"))
        .where("blocked and not allowed")
        .select(F.col("component").alias("bad"), F.lit(True).alias("is_bad"))
    )
    named = joined.join(blocked, F.col("component") == F.col("bad"), "left").select("node", "component", F.coalesce("is_bad", F.lit(False)).alias("is_bad"))
    out = judged.join(named, F.col("key") == F.col("node"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("is_bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "key").alias("component"))


#: Fixed values of the contract: host, path, verdict.
OP6_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict. Edge cases as in judge."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in OP6_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages"), rules).drop("component")


OP6_SQL = r"""
WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parsed AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0) AS canonical,
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) AS refresh
  FROM pages),
fitting AS (
  SELECT page_id, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS nth
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
ruled AS (SELECT p.*, f.rule, f.rverdict FROM parsed p LEFT JOIN fitting f ON p.page_id = f.page_id AND f.nth = 1),
targets AS (
  SELECT page_id, url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '/') AND NOT starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t END AS target
  FROM (SELECT page_id, url, regexp_extract(canonical, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM parsed
        UNION ALL SELECT page_id, url, regexp_extract(refresh, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM parsed) WHERE t <> ''),
urls AS (SELECT url AS u FROM parsed WHERE contains(url, '://') UNION SELECT target FROM targets WHERE contains(target, '://')),
keys AS (
  SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key
  FROM (SELECT u, array_to_string(list_filter(string_split(regexp_extract(u, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')), '&') AS q FROM urls)),
edges AS (
  SELECT DISTINCT x.key AS a, y.key AS b FROM targets t JOIN keys x ON t.url = x.u JOIN keys y ON t.target = y.u WHERE x.key <> y.key),
pairs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM pairs UNION SELECT r.a, e.b FROM reach r JOIN pairs e ON r.b = e.a),
verdicts AS (SELECT k.key, r.rverdict FROM ruled r JOIN keys k ON r.url = k.u WHERE rverdict IS NOT NULL),
bad AS (SELECT r.a AS key FROM reach r JOIN verdicts v ON r.b = v.key GROUP BY r.a HAVING bool_or(v.rverdict = 'block') AND NOT bool_or(v.rverdict = 'allow'))
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.rverdict, CASE WHEN b.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN keys k ON r.url = k.u LEFT JOIN bad b ON k.key = b.key
"""
