"""URL filters with redirect equivalence (DataFrame functions only).

A rule names a host and a path prefix. A url's own longest rule decides; a url without a rule
takes the decision of its aliases: the urls joined to it by redirect and canonical-link edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import connected_components
from .common import written

#: (host/path, verdict). A rule fits its host and all subdomains, if the path starts with its path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """One key for a page by whichever scheme, fragment, www or trailing slash it is reached."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.regexp_replace(F.coalesce(rest, F.lit("")), r"(?<=.)/$", "")
    key = F.concat(F.regexp_replace(url_host(url), r"^www\.", ""), F.when(rest == "", "/").otherwise(rest))
    return F.when(url.contains("://"), key)


def exact_key(url: Column) -> Column:
    """One key for urls that differ in scheme and fragment alone."""
    return F.when(url.contains("://"), F.concat(url_host(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit(""))))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits (ties: rule order), else null."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        at, _, prefix = rule.partition("/")
        own = (host == at) | host.endswith("." + at)
        fits.append(F.when(own & path.startswith("/" + prefix), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def _without_dots(path: Column) -> Column:
    """A path (from `/` on) without its segments `.` and `..`."""
    parts = F.split(path, "/")
    walk = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"),
        lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x))),
    )
    plain = F.concat(F.lit("/"), F.array_join(walk, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(walk) > 0), "/").otherwise(""))
    return F.when(path.contains("/."), plain).otherwise(path)


def _absolute(link: Column, base: Column) -> Column:
    """A link as an absolute url: a relative one takes the page's scheme, host, directory or path. Null for
    links of other kinds (mailto:, javascript:)."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    path, tail = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)", 1)
    return (
        F.when(link.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*)?://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, _without_dots(path), tail))
        .when(path == "", F.concat(page, link))
        .otherwise(F.concat(origin, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), tail))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None, same=page_key) -> DataFrame:
    """Edges (a, b) of page keys: all canonical links and meta refreshes in the html, and, if given,
    rows (from_url, to_url) of a redirect log. Relative links go from the page's directory, or from its
    first `<base href>`; of the entities in a link the ampersand is decoded."""
    link = lambda tag, name: F.regexp_replace(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1), "(?i)&(amp|#38|#x26);", "&")
    tags = lambda pattern: F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    canonical = F.transform(tags(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), lambda t: link(t, "href"))
    refresh = F.transform(tags(r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), lambda t: link(t, "url"))
    root = link(F.regexp_extract(F.col(html), r"(?is)(<base\b[^>]*\bhref\s*=[^>]*>)", 1), "href")
    # a cheap test first: most pages name neither
    marked = F.lower(F.col(html)).rlike("canonical|refresh")
    links = pages.where(marked).select(F.col(url).alias("a"), root.alias("root"), F.explode(F.concat(canonical, refresh)).alias("to")).where(F.col("to") != "")
    base = F.coalesce(F.when(F.col("root") != "", _absolute(F.col("root"), F.col("a"))), F.col("a"))
    links = links.withColumn("base", base).select("a", _absolute(F.col("to"), F.col("base")).alias("b"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")))
    return links.select(same(F.col("a")).alias("a"), same(F.col("b")).alias("b")).dropna().where("a != b").distinct()


def judge_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None, same=page_key) -> DataFrame:
    """Returns page_id, host, path, rule, verdict, component (the least key of the alias group, null outside one).

    A url's own rule decides. Without one: if a member of its alias group has an allow rule, allow
    (explicit allow goes before block); else if a member has a block rule, block; else allow.
    Urls of one key are aliases of each other; `same` makes the key of a url, which begins with its host and path
    (page_key: whatever the scheme, `www.`, fragment and last slash; exact_key: whatever the fragment alone). Null urls and urls without `://` have an empty
    host and path, no rule and no alias: allow. Repeated rows are judged alike; other columns of
    `pages` are not read, whatever their names. An empty table gives no rows.
    """
    u = F.col(url)
    judged = pages.select(F.col(page_id).alias("page_id"), url_host(u).alias("host"), url_path(u).alias("path"), same(u).alias("key"))
    judged = judged.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    edges = written(alias_edges(pages, url, html, redirects, same), "alias-edges")
    groups = connected_components(edges, "a", "b")  # by the keys themselves: no two pages are ever taken for one
    of_edges = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    of_edges = of_edges.withColumn("own", longest_rule(F.regexp_extract("key", r"(?s)^([^/?]*)", 1), F.regexp_extract("key", r"(?s)^[^/?]*([^?]*)", 1), rules))
    member = (
        judged.select("key", "own").where("key is not null and own is not null").unionByName(of_edges.where("own is not null"))
        .groupBy(F.col("key").alias("node")).agg(F.max(F.col("own.verdict") == "allow").alias("allows"), F.max(F.col("own.verdict") == "block").alias("blocks"))
    )
    whole = groups.join(member, "node", "left").groupBy("component").agg(F.max("allows").alias("allows"), F.max("blocks").alias("blocks"))
    # group -> node; nodes outside every edge stand for their own key
    at_node = (
        groups.join(whole, "component").select("node", "component", "allows", "blocks")
        .unionByName(member.join(groups, "node", "left_anti").select("node", F.lit(None).cast("string").alias("component"), "allows", "blocks"))
    )
    out = judged.withColumn("node", F.col("key")).join(at_node, "node", "left")
    inherited = F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), inherited).alias("verdict"), "component",
    )
