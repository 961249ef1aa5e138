"""URL filters with redirect equivalence, in DataFrame operations only.

An address is judged by the longest rule that fits it. Addresses joined by redirects (meta refresh) and canonical links
name one resource: connected components over these edges carry a block decision from any address of a component to its
aliases, known pages or not. An explicit rule comes before what aliases say: an address that an allow rule names stays
allowed, and only those that no rule fits take the component's verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import materialize
from flowguard.llm.components import connected_components

# Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL_TAG = r"(?is)<link\s[^>]*rel\s*=\s*[\"']?canonical[^>]*>"
CANONICAL_URL = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?is)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>"
#: An ampersand as attributes write it.
AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"
REFRESH_URL = r"(?is)url\s*=\s*[\"']?([^\"'\s>]+)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What names the resource: host, path (`/` if empty) and query, without scheme and fragment; null without `://`."""
    path = path_of(url)
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, null if none fits. A rule fits its host and all subdomains, on
    paths that start with its own. The rules are parameters, compiled into the plan longest first."""
    rule = verdict = F.lit(None).cast("string")
    for said, of_host, of_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        rule, verdict = F.when(fits, of_host + of_path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): a row for each page with a canonical link and for each with a meta refresh. Targets are absolute,
    or made so from the page's host and folder; written-out ampersands in them are read as such."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    found = F.array(
        F.regexp_extract(F.regexp_extract(html, CANONICAL_TAG, 0), CANONICAL_URL, 1),
        F.regexp_extract(F.regexp_extract(html, REFRESH_TAG, 0), REFRESH_URL, 1),
    )
    to = F.regexp_replace(F.col("to"), AMPERSAND, "&")
    absolute = (
        F.when(F.instr(to, "://") > 0, to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(F.lit("http://"), host_of(url), to))
        .otherwise(F.concat(F.lit("http://"), host_of(url), F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), r"[^/]*$", ""), to))
    )
    links = pages.where(F.instr(url, "://") > 0).select(url, F.explode(F.filter(found, lambda x: x != "")).alias("to"))
    return links.select(url.alias("url"), absolute.alias("target"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """One row per input row: id_col, host, path, rule (null if none fits) and verdict (`allow` or `block`).

    `edges` (url, target) adds redirects known from elsewhere, such as a crawl log. Defined cases: a url that is null or
    has no `://` has an empty host and path, fits no rule, has no alias and is allowed; null html has no links; null ids
    stay null; repeated rows each keep their row; an empty table gives an empty table; other columns are ignored.
    """
    links = link_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.unionByName(edges.select("url", "target"))
    links = materialize(links.distinct(), "url-links")
    nodes = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    parts = connected_components(nodes)
    of_links = links.select(F.explode(F.array("url", "target")).alias("url"))
    said = of_links.select(node_of(F.col("url")).alias("node"), fitting(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("said"))
    bad = said.where("said = 'block'").select("node").distinct().join(parts, "node").select("component").distinct()
    blocked = parts.join(bad, "component").select(F.col("node").alias("__node"), F.lit(True).alias("__blocked"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    of_pages = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).select("__id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), node_of(F.col("__url")).alias("__node"))
    of_pages = of_pages.select("__id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "__node")
    judged = of_pages.withColumns({"rule": rule, "__verdict": verdict}).join(blocked, "__node", "left")
    return judged.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__verdict", F.when(F.col("__blocked"), "block"), F.lit("allow")).alias("verdict"))
