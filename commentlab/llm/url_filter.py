"""URL filter with redirect equivalence.

A url is judged by the longest rule (host and path prefix) that fits it. Pages also name aliases of themselves:
canonical links and refresh redirects in their html. Urls that are joined by such edges form components
(distributed, see ``components``), and a block decision goes to every alias in its component that no rule
fits. Explicit allow takes precedence: a url that an allow rule fits stays allowed, and a component that
holds such a url passes no block on. Urls that differ only by scheme, host case, fragment or tracking
parameters are one node; an edge may lead to a url that is no page, which is judged by the rules as well.

Cases: a null url, or one without ``://``, has empty host and path, is fitted by no rule and has no alias; null or
empty html has no edges; repeated urls and pages are judged alike; tags are read whole, whatever their length, and
one without an end is none; hosts match by their last 127 labels. Columns beside page_id, url and html do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.llm.components import connected_components
from commentlab.session import cut_lineage

# The rules of the registered query, (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MAX_LABELS = 127
_TAG = r"(?i)<(?:link|meta)\b[^>]*+>?"  # matches a tag without an end as well, so that its text is read once
_CANONICAL = r"""(?i)\brel\s*=\s*["']?canonical\b"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
_REFRESH_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
_TRACKING = r"(?:^|&)(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def node_of(url: Column) -> Column:
    """The url's node: host, path and query without tracking parameters; null without a host."""
    host, path = host_and_path(url)
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), _TRACKING, "")
    query = F.regexp_replace(query, "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rules_table(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    bad = [r for r in rules if r[0] not in ("allow", "block") or not r[1] or r[1].count(".") >= MAX_LABELS]
    if bad:
        raise ValueError(f"rules without a verdict or a usable host: {bad[:3]}")
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def fit_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, verdict)`` of the distinct (host, path) pairs that a rule fits; the longest rule wins,
    then allow. Every pair meets the rules of its host and parent domains by an equality join."""
    keys = urls.select("host", "path").where(F.col("host") != "").distinct()
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, MAX_LABELS)
    # "c.b.a" from the last label on: a, b.a, c.b.a
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.array_join(F.reverse(F.slice("labels", 1, n)), "."))
    exploded = keys.withColumn("labels", labels).withColumn("suffix", F.explode(suffixes))
    fitting = exploded.join(rules, F.col("suffix") == F.col("rule_host")).where(F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(rule), F.col("verdict") == "allow", rule.alias("rule"), F.col("verdict"))
    best = fitting.groupBy("host", "path").agg(F.max(order).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def _resolve(base: Column, target: Column) -> Column:
    """Absolute url of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.length(folder) > F.length(site), F.concat(folder, target))
        .otherwise(F.concat(site, F.lit("/"), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)`` nodes: each page and the targets of its canonical links and refresh redirects."""
    tags = F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)))
    found = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", tags.alias("tag")).where(F.endswith("tag", F.lit(">")))
    target = F.when(found.tag.rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(
        found.tag.rlike(_REFRESH), F.regexp_extract("tag", _REFRESH_URL, 1)
    )
    links = found.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("target")).where(F.col("target") != "")
    return links.select(node_of(F.col("url")).alias("a"), node_of(_resolve(F.col("url"), F.col("target"))).alias("b"))


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct nodes of components that hold a blocked url and no allowed one."""
    members = cut_lineage(connected_components(edges), "alias-components")
    # a node starts with its host and path
    places = members.select("node", "root", *[c.alias(n) for c, n in zip(host_and_path(F.concat(F.lit("://"), "node")), ("host", "path"), strict=True)])
    judged = places.join(fit_rules(places, rules), ["host", "path"], "left")
    roots = judged.groupBy("root").agg(
        F.max(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("block"),
        F.max(F.coalesce(F.col("verdict") == "allow", F.lit(False))).alias("allow"),
    )
    return members.join(roots.where(F.col("block") & ~F.col("allow")).select("root"), "root", "left_semi").select("node")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row of ``pages``.

    ``redirects`` may add edges (from_url, to_url), from a crawl log for example.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    blocked = cut_lineage(blocked_aliases(edges, rules), "blocked-aliases")
    host, path = host_and_path(F.col("url"))
    places = pages.select("page_id", node_of(F.col("url")).alias("node"), host.alias("host"), path.alias("path"))
    # urls without a host fit no rule and are no node: they would be one hot key of the joins
    bare = places.where(F.col("host") == "").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    places = places.where(F.col("host") != "")
    fitted = cut_lineage(fit_rules(places, rules), "fitted-rules")
    both = places.join(fitted, ["host", "path"], "left").join(blocked.withColumn("alias", F.lit(True)), "node", "left")
    verdict = F.coalesce("verdict", F.when(F.col("alias"), F.lit("block")), F.lit("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict")).unionByName(bare)
