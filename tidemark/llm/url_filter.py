"""URL filters with redirect equivalence.

Rules (allow or block a host and its subdomains under a path prefix) decide the urls they fit; the longest rule wins.
Decisions then spread to aliases: urls tied by redirects or canonical links, found in the pages themselves and in an
edge table if one is given, form connected components, worked out as a distributed job. In a component an explicit
allow takes precedence over any block; a url that no rule fits gets the component's decision, and `allow` without one.

Edges of a page: from its url to its canonical link, to the target of its meta refresh and to its og:url, relative ones
resolved against the url's host, and from every url to its plain form (no scheme, fragment, tracking parameter,
trailing slash or `.html`, no leading `www.`), by which different spellings of an address meet. Urls and plain forms
are nodes of two kinds; only urls are judged, so an address that quotes another in its path or query is judged as itself.

Rows: a NULL url, or one without `://`, has empty host and path, fits no rule, has no aliases and is allowed. NULL html
has no links. Repeated urls share a decision; each row stays. Rules of the same length: allow first. Empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.operators.ordering import settle

#: What nodes of the edge table start with: full urls and plain forms.
URL, FORM = "u:", "f:"

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

# Query parameters that do not change what an address shows.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid"

# Where a page names another address for itself.
LINKS = (
    r"(?is)<link\b[^>]*\brel=[\"']?canonical\b[^>]*\bhref=[\"']([^\"']+)",
    r"(?is)<link\b[^>]*\bhref=[\"']([^\"']+)[\"'][^>]*\brel=[\"']?canonical\b",
    r"(?is)<meta\b[^>]*\bhttp-equiv=[\"']?refresh\b[^>]*\bcontent=[\"'][^\"']*?url=([^\"'>]+)",
    r"(?is)<meta\b[^>]*\bproperty=[\"']?og:url\b[^>]*\bcontent=[\"']([^\"']+)",
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for NULL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def plain_form(url: Column) -> Column:
    """Host and path without what does not change the address; what is left of the query follows."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(?:\?([^#]*))?", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.rlike(rf"^(?:{TRACKING})(?:=|$)") & (p != ""))
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/index\.html?|\.html?|/)$", "")
    tail = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def _absolute(link: Column, url: Column) -> Column:
    """A link as a full url; relative ones hang on the url's scheme and host, or its folder."""
    link = F.trim(link)
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def _node(kind: str, name: Column) -> Column:
    return F.concat(F.lit(kind), name)


def _fits(rule: Rule) -> Column:
    _, host, path = rule
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def _ruled(rules: Sequence[Rule], value) -> Column:
    """value(rule) of the longest rule that fits; NULL where none does."""
    out = F.when(F.lit(False), value(rules[0])) if rules else F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        out = out.when(_fits(rule), value(rule))
    return out


def alias_edges(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """a, b: nodes (urls and plain forms, by kind) that stand for one another. edges: more of them, as src and dst urls."""
    known = pages.select("url", "html").filter(F.col("url").contains("://"))
    html = F.coalesce("html", F.lit(""))
    links = F.array_distinct(F.array(*(F.regexp_extract(html, pattern, 1) for pattern in LINKS)))
    found = known.select("url", F.explode(links).alias("link")).filter("link <> ''")
    found = found.select(F.col("url").alias("src"), _absolute(F.col("link"), F.col("url")).alias("dst"))
    if edges is not None:
        more = edges.select("src", "dst").filter(F.col("src").contains("://") & F.col("dst").contains("://"))
        found = found.unionByName(more)
    found = settle(found.distinct())
    urls = known.select("url").unionByName(found.select(F.col("src").alias("url"))).unionByName(
        found.select(F.col("dst").alias("url"))
    )
    spelled = urls.distinct().select(_node(URL, F.col("url")).alias("a"), _node(FORM, plain_form(F.col("url"))).alias("b"))
    return spelled.unionByName(found.select(_node(URL, F.col("src")).alias("a"), _node(URL, F.col("dst")).alias("b")))


def verdicts(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and by: `rule`, `alias` or `default`."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumns(
        {"rule": _ruled(rules, lambda r: F.lit(r[1] + r[2])), "ruled": _ruled(rules, lambda r: F.lit(r[0]))}
    )
    stars = settle(components(alias_edges(pages, edges)))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    member = stars.unionByName(roots)
    # What rules say about the urls of a component, pages or only link targets: 2 for allow, 1 for block.
    urls = member.filter(F.col("node").startswith(URL)).select("root", F.substr("node", F.lit(len(URL) + 1)).alias("url"))
    judged = urls.select("root", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    said = _ruled(rules, lambda r: F.lit(2 if r[0] == "allow" else 1).cast("string")).cast("int")
    spread = judged.select("root", said.alias("said")).groupBy("root").agg(F.max("said").alias("said"))
    member = urls.join(spread.filter("said IS NOT NULL"), "root").select(F.col("url").alias("_url"), "said")
    out = rows.join(member, rows["url"] == member["_url"], "left")
    heard = F.when(F.col("said") == 2, "allow").when(F.col("said") == 1, "block")
    by = F.when(F.col("ruled").isNotNull(), "rule").when(heard.isNotNull(), "alias").otherwise("default")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", heard, F.lit("allow")).alias("verdict"), by.alias("by")
    )
