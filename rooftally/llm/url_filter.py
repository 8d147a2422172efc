"""URL rules with redirect equivalence (operator 6), all in DataFrame functions.

Rules name a host and a path prefix; the longest that fits an address wins. Pages that redirect to each other or name a
canonical address are one resource under several addresses: the connected components over these edges carry a block decision to all
aliases of a blocked address. An address with an allow rule of its own keeps it.

Scale: rules are matched once per different (host, path), by equality on each suffix of the host. Redirects and canonical links
are read in a narrow map; only their edges are shuffled. Components contract with written rounds (see components.py). Pages of
one host have different addresses, so no step groups by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rooftally.functions.plan import compute_once
from rooftally.llm.common import LOWER, UPPER
from rooftally.llm.components import connected_components
from rooftally.workspace import write_and_read

#: The rules that the registered query applies: host, path prefix, action.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _located(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Add host, path and node: what names a resource is host, path and query, without scheme and fragment.

    An empty path is ``/`` in a node; the node of a url without a host is NULL. The parts are computed once per row.
    """
    host, path, query, node = (prefix + c for c in ("host", "path", "query", "node"))
    parts = compute_once(df, **{
        host: host_of(F.col(url)), path: path_of(F.col(url)),
        query: F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^?#]*(\?[^#]*)", 1), F.lit(""))})
    whole = F.when(F.col(host) != "", F.concat(host, F.when(F.col(path) == "", F.lit("/")).otherwise(F.col(path)), query))
    return parts.withColumn(node, whole).drop(query)


def _attribute(tag: str, name: str) -> Column:
    """An attribute's value, in either kind of quotes or none."""
    groups = F.regexp_extract_all(tag, F.lit(rf"(?i)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(1))
    return F.coalesce(F.btrim(F.btrim(F.get(groups, F.lit(0)), F.lit("\"'"))), F.lit(""))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes from canonical links and immediate redirects in ``html``; comments and scripts don't count.

    Relative addresses are seen from the page. Other schemes and mere fragments are no edges.
    """
    seen = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tags = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv")).select(
        "url", F.explode(F.regexp_extract_all(seen, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    told = compute_once(tags, rel=_attribute("tag", "rel"), equiv=F.lower(_attribute("tag", "http-equiv")),
                        link=_attribute("tag", "href"), content=_attribute("tag", "content"))
    href = (F.when(F.col("tag").rlike(r"(?i)^<link\b") & F.col("rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), F.col("link"))
            .when(F.col("tag").rlike(r"(?i)^<meta\b") & (F.col("equiv") == "refresh"),
                  F.btrim(F.regexp_extract("content", r"(?i)\burl\s*=\s*['\"]?([^'\"]*)", 1))))
    found = compute_once(told.select("url", "tag", "rel", "equiv", "link", "content"),
                         href=F.replace(href, F.lit("&amp;"), F.lit("&"))).filter("href <> ''").select("url", "href")
    page = compute_once(_located(found, "url"), folder=F.regexp_extract("path", r"^(.*/)", 1))
    here, to = F.concat(F.lit("http://"), "host"), F.col("href")
    target = (F.when(to.rlike(r"(?i)^https?://"), to)
              .when(to.startswith("//"), F.concat(F.lit("http:"), to))
              .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | to.startswith("#"), F.lit(None))
              .when(to.startswith("/"), F.concat(here, to))
              .when(to.startswith("?"), F.concat(here, "path", to))
              .otherwise(F.concat(here, F.when(F.col("folder") == "", F.lit("/")).otherwise(F.col("folder")), to)))
    ends = _located(compute_once(page.select(F.col("node").alias("src"), "host", "path", "folder", "href"), target=target)
                    .select("src", "target"), "target")
    return ends.select("src", F.col("node").alias("dst"))


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each different (host, path): host, path, rule, action; only places with a rule.

    Of rules of one length for a place the one with the smaller text wins; ``allow`` wins if they are the same.
    """
    labels = F.split("host", r"\.")
    suffixes = places.select("host", "path").distinct().withColumn(
        "rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                                           lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    fits = suffixes.join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action"), "rule_host")
    fits = fits.filter(F.startswith("path", "rule_path")).withColumn("rule", F.concat("rule_host", "rule_path"))
    best = F.struct(-F.length("rule"), F.col("rule"), F.col("action"))
    return fits.groupBy("host", "path").agg(F.min(best).alias("best")).select("host", "path", "best.rule", "best.action")


def url_filter(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict.

    ``rules`` has host, path, action; ``edges`` (src, dst urls) adds redirects known from elsewhere, as from a crawl's log. The
    verdict is the page's own rule; without one it is ``block`` if any address of its component is blocked by a rule, else
    ``allow``. A NULL url, or one without ``://``, has an empty host and path and is allowed. Repeated rows are kept.
    """
    known = _located(pages.select("page_id", "url"), "url")
    links = page_edges(pages)
    if edges is not None:
        ends = _located(_located(edges.select("src", "dst"), "src", "s_"), "dst", "d_")
        links = links.union(ends.select("s_node", "d_node"))
    links = write_and_read(links.filter("src is not null and dst is not null").distinct(), "aliases")
    aliases = connected_components(links)
    # rules also hold for addresses that are only the target of an edge
    named = _located(aliases.withColumn("url", F.concat(F.lit("http://"), F.col("node"))).drop("node"), "url")
    matched = write_and_read(match_rules(known.select("host", "path").union(named.select("host", "path")), rules), "rules")
    blocked = named.join(matched, ["host", "path"]).filter("action = 'block'").select("root").distinct()
    reached = aliases.join(blocked, "root").select("node", F.lit(True).alias("reached"))
    out = known.join(matched, ["host", "path"], "left").join(reached, "node", "left")
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("action", F.when(F.col("reached"), "block"), F.lit("allow")).alias("verdict"))
