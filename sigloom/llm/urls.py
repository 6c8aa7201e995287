"""URL filters with redirect equivalence, in DataFrame operations only.

Every url is cut into host and path and judged by the longest rule that fits. Redirects
and canonical links make urls aliases of one another: connected components over these
edges carry a block decision to every alias without a rule of its own. Allow takes
precedence: an explicit allow rule wins for its own url, and a component that has an
allowed url is not blocked through another one.

A node of the link graph is host plus path: scheme, query and fragment make no
difference. Each canonical link and each refresh of a page is an edge. Edge cases: a null
url or one without ``://`` has an empty host and path, no rule, no aliases, and is
allowed. Relative link targets are read against the page's host and folder, ``&amp;`` in
them as ``&``. Rows with null or repeated ids are judged one by one; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.storage import cut
from sigloom.operators.graph import connected_components

# Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ABSOLUTE = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_IS_CANONICAL = r"""(?is)\brel\s*=\s*["']?canonical\b"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_IS_REFRESH = r"""(?is)http-equiv\s*=\s*["']?refresh\b"""
_URL = r"""(?is)url\s*=\s*["']?([^"'\s>]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else of nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _without_dots(path_: Column) -> Column:
    """``path_`` with its segments ``.`` and ``..`` carried out; those beyond the root have no effect."""
    parts = F.split(path_, "/")
    last = F.element_at(parts, -1)
    climbed = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x))),
    )
    end = F.when(last.isin(".", "..") & (F.size(climbed) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(climbed, "/"), end)


def resolved(target: Column, url: Column) -> Column:
    """Host plus path of a link target read against the page ``url``; null if the target or the page has none."""
    whole = F.when(target.rlike(_ABSOLUTE), target).when(target.startswith("//"), F.concat(F.lit("http:"), target))
    own = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(url), r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    read = F.when(own == "", path(url)).when(own.startswith("/"), _dotted(own)).otherwise(_dotted(F.concat(folder, own)))
    relative = ~target.rlike(_SCHEME) & (host(url) != "")
    return F.when(whole.isNotNull(), F.concat(host(whole), path(whole))).when(relative, F.concat(host(url), read))


def _dotted(path_: Column) -> Column:
    return F.when(path_.rlike(r"(?s)/\.{1,2}(/|$)"), _without_dots(path_)).otherwise(path_)


def link_targets(html: Column) -> Column:
    """Array of the targets that a page's canonical links and its refreshes name, as written.

    The page is cut at ``>`` and each piece at its first ``<link`` or ``<meta``, so that
    no pattern runs beyond a tag; a link has to be closed. Of several refreshes in one tag the last
    one with a url counts.
    """
    pieces = F.split(html, ">")
    closed = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    links = F.transform(F.filter(closed, lambda p: p.rlike(r"(?i)<link\b")), lambda p: F.regexp_extract(p, r"(?is)<link\b.*+", 0))
    canonical = F.transform(F.filter(links, lambda tag: tag.rlike(_IS_CANONICAL)), lambda tag: F.regexp_extract(tag, _HREF, 1))
    metas = F.transform(F.filter(pieces, lambda p: p.rlike(r"(?i)<meta\b")), lambda p: F.regexp_extract(p, r"(?is)<meta\b.*+", 0))
    after = lambda tag: F.slice(F.split(tag, _IS_REFRESH, -1), F.lit(2), F.size(F.split(tag, _IS_REFRESH, -1)))
    refresh = F.transform(F.filter(metas, lambda tag: tag.rlike(_IS_REFRESH)), lambda tag: F.coalesce(F.try_element_at(F.filter(F.transform(after(tag), lambda x: F.regexp_extract(x, _URL, 1)), lambda x: x != ""), F.lit(-1)), F.lit("")))
    return F.transform(F.filter(F.concat(canonical, refresh), lambda t: t != ""), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): host plus path of each page that has link targets, and of each target."""
    hinted = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(link_targets(F.col("html"))).alias("target"))
    found = hinted.select(F.concat(host(F.col("url")), path(F.col("url"))).alias("a"), resolved(F.col("target"), F.col("url")).alias("b"))
    return found.where("a != '' and b != ''")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``redirects`` may add edges between urls as columns ``a`` and ``b``.
    """
    edges = page_links(pages)
    if redirects is not None:
        ends = (F.concat(host(F.col(x)), path(F.col(x))).alias(x) for x in "ab")
        edges = edges.union(redirects.select(*ends).where("a != '' and b != ''"))
    members = connected_components(edges)
    own = fitting(F.regexp_extract("node", r"(?s)^([^/]*)(.*)$", 1), F.regexp_extract("node", r"(?s)^([^/]*)(.*)$", 2), rules)["verdict"]
    ruled = members.withColumn("own", own)
    sums = ruled.groupBy("root").agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"))
    tainted = sums.where(F.col("blocked") & ~F.coalesce("allowed", F.lit(False))).select("root")
    aliases = cut(members.join(tainted, "root", "left_semi").select("node"), "aliases")

    cut_up = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = cut_up.withColumn("fit", fitting(F.col("host"), F.col("path"), rules)).withColumn("node", F.concat("host", "path"))
    out = judged.join(aliases.withColumn("tainted", F.lit(True)), "node", "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("tainted"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
