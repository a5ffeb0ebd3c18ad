"""URL filters: prefix rules plus redirect equivalence (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

#: (action, host, path prefix): the rules of the production query.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct(size, action, rule)``; null if none fits.

    A rule fits its host and all subdomains when the path starts with the
    rule's. Equally long rules cannot both fit one url unless they are the
    same rule; then allow wins.
    """
    fits = []
    for action, h, p in rules:
        ok = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        size = len(h) + len(p)
        # order: longer first, allow before block
        fits.append(F.when(ok, F.struct(F.lit(size).alias("size"), F.lit(int(action == "allow")).alias("allow"), F.lit(action).alias("action"), F.lit(h + p).alias("rule"))))
    if not fits:
        return F.lit(None).cast("struct<size:int,allow:int,action:string,rule:string>")
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def _no_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    closed = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(closed, "/").otherwise(""))


def _decoded(target: Column) -> Column:
    """The basic character references of an attribute, and those of ``& / :`` by number."""
    for ref, char in ((r"lt|#0*60|#x0*3c", "<"), (r"gt|#0*62|#x0*3e", ">"), (r"quot|#0*34|#x0*22", '"'), (r"apos|#0*39|#x0*27", "'"), (r"#0*47|#x0*2f", "/"), (r"#0*58|#x0*3a", ":"), (r"amp|#0*38|#x0*26", "&")):
        target = F.regexp_replace(target, f"(?i)&(?:{ref});", char)
    return target


def _absolute(target: Column, url: Column) -> Column:
    """Resolve a link target against the page's url; null for other schemes, and for relative ones on a url without ``://``."""
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"(?s)^(.*?):", 1)
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, _no_dots(path), rest))
        .when(target.startswith("?"), F.concat(origin, path_of(url), target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^([^#]*)", 1), target))
        .otherwise(F.concat(origin, _no_dots(F.concat(folder, path)), rest))
    )


def node_of(url: Column) -> Column:
    """A url as a node of the alias graph: scheme and host in lower case, an empty path as ``/``, no fragment; null without ``://``."""
    part = lambda i: F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^?#]*)(\?[^#]*)?", i)
    path = F.when(part(2) == "", "/").otherwise(part(2))
    return F.when(url.contains("://"), F.concat(F.translate(part(1), _UPPER, _LOWER), path, part(3)))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Alias edges ``u, v`` between urls (as of :func:`node_of`): all canonical links and meta-refresh redirects."""
    tag = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    refresh = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"
    src = pages.select(F.col(url).alias("_u"), F.col(html).alias("_h")).where("_u is not null and _h is not null")
    # a plain substring test spares the regular expressions on pages that have neither
    low = F.lower("_h")
    src = src.where(low.contains("canonical") | low.contains("refresh"))
    links = src.select("_u", F.explode(F.concat(F.regexp_extract_all("_h", F.lit(tag), F.lit(1)), F.regexp_extract_all("_h", F.lit(refresh), F.lit(1)))).alias("_t"))
    links = links.select("_u", _decoded(F.col("_t")).alias("_t"))
    edges = links.where("_t <> ''").select(node_of(F.col("_u")).alias("u"), node_of(_absolute(F.col("_t"), F.col("_u"))).alias("v"))
    return edges.where("u is not null and v is not null and u <> v").distinct()


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Judge every page's url: ``page_id, host, path, rule, verdict``.

    A url that a rule fits gets the verdict of the longest one. Any other url
    takes its alias group's verdict: groups are the connected components over
    redirect and canonical-link edges (``redirects`` adds further ``u, v``
    edges). A group blocks its undecided aliases when a rule blocks one of its
    urls and no rule explicitly allows one: an explicit allow goes before any
    block. Without a group, or in a group without decisions, it is allowed.

    Null urls, and urls without ``://``, have an empty host and path, fit no
    rule and have no aliases. Repeated rows are each judged. Other columns of
    the input, whatever their names, are not read.
    """
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("_url")).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    own = own.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages, url, html)
    if redirects is not None:
        more = redirects.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v"))
        edges = edges.union(more.where("u is not null and v is not null and u <> v")).distinct()
    edges = cut(edges, "alias-edges")
    if edges.isEmpty():
        group_verdict = None
    else:
        groups = cut(connected_components(edges), "aliases")
        seen = groups.withColumn("_best", best_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
        verdict = seen.groupBy("component").agg(
            F.max((F.col("_best.action") == "block").cast("int")).alias("b"), F.max((F.col("_best.action") == "allow").cast("int")).alias("a")
        ).where("b = 1 and coalesce(a, 0) = 0")
        group_verdict = groups.join(verdict.select("component"), "component", "left_semi").select(F.col("node").alias("_node"), F.lit("block").alias("_group"))
    judged = ["page_id", "host", "path", F.col("_best.rule").alias("rule")]
    if group_verdict is None:
        return own.select(*judged, F.coalesce(F.col("_best.action"), F.lit("allow")).alias("verdict"))
    # only urls without a rule, and with a node, ask for their group's verdict
    asks = F.col("_best").isNull() & F.coalesce(F.col("_url").contains("://"), F.lit(False))
    asking = own.where(asks).withColumn("_node", node_of(F.col("_url"))).join(group_verdict, "_node", "left")
    rest = own.where(~asks).select(*judged, F.coalesce(F.col("_best.action"), F.lit("allow")).alias("verdict"))
    return asking.select(*judged, F.coalesce("_group", F.lit("allow")).alias("verdict")).union(rest)


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url,
         translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                               ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*')) AS tag FROM pages WHERE url LIKE '%://%' AND regexp_matches(html, '(?i)canonical|refresh')),
hrefs AS (SELECT url, regexp_extract(tag, '(?is)^.*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM tags WHERE regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b')
          UNION ALL SELECT url, regexp_extract(tag, '(?is)^.*\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags WHERE regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b')),
plain AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
            '&(?:lt|#0*60|#x0*3c);', '<', 'gi'), '&(?:gt|#0*62|#x0*3e);', '>', 'gi'), '&(?:quot|#0*34|#x0*22);', '"', 'gi'), '&(?:apos|#0*39|#x0*27);', chr(39), 'gi'),
            '&(?:#0*47|#x0*2f);', '/', 'gi'), '&(?:#0*58|#x0*3a);', ':', 'gi'), '&(?:amp|#0*38|#x0*26);', '&', 'gi') AS t FROM hrefs WHERE t <> ''),
cut AS (SELECT url, t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
               regexp_extract(t, '(?s)^[^?#]*') AS tp, regexp_extract(t, '(?s)^[^?#]*(.*)', 1) AS rest FROM plain),
joined AS (SELECT *, string_split(substr(CASE WHEN tp[1] = '/' THEN tp ELSE coalesce(nullif(regexp_extract(path, '(?s)^.*/'), ''), '/') || tp END, 2), '/') AS segs FROM cut),
clean AS (SELECT *, list_reduce([''] || segs, lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) AS k FROM joined),
full_path AS (SELECT *, CASE WHEN k = '' THEN '/' WHEN segs[-1] IN ('.', '..') THEN k || '/' ELSE k END AS np FROM clean),
target AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                            WHEN t[1:2] = '//' THEN regexp_extract(url, '(?s)^(.*?):', 1) || ':' || t WHEN t[1] = '?' THEN origin || path || t WHEN t[1] = '#' THEN url ELSE origin || np || rest END AS t FROM full_path),
node AS (SELECT DISTINCT x, translate(regexp_extract(x, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                || coalesce(nullif(regexp_extract(x, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(x, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1) AS n
         FROM (SELECT t AS x FROM target WHERE t LIKE '%://%' UNION SELECT url FROM p WHERE url LIKE '%://%')),
edge AS (SELECT a.n AS u, b.n AS v FROM target JOIN node a ON a.x = target.url JOIN node b ON b.x = target.t WHERE a.n <> b.n),
reach(n, c) AS (SELECT n, n FROM (SELECT u AS n FROM edge UNION SELECT v FROM edge) UNION
                SELECT e.o, reach.c FROM reach JOIN (SELECT u AS n, v AS o FROM edge UNION SELECT v, u FROM edge) e USING (n)),
grp AS (SELECT n, min(c) AS c FROM reach GROUP BY n),
fits AS (SELECT grp.n, grp.c, r.action, row_number() OVER (PARTITION BY grp.n ORDER BY length(r.h || r.p) DESC) AS k
         FROM grp JOIN rules r ON (regexp_extract(grp.n, '(?s)^.*?://([^/?#]*)', 1) = r.h OR ends_with(regexp_extract(grp.n, '(?s)^.*?://([^/?#]*)', 1), '.' || r.h))
                              AND starts_with(regexp_extract(grp.n, '(?s)^.*?://[^/?#]*([^?#]*)', 1), r.p)),
blocked AS (SELECT c FROM fits WHERE k = 1 GROUP BY c HAVING bool_and(action = 'block')),
m AS (SELECT p.page_id, p.url, p.host, p.path, r.h || r.p AS rule, r.action, row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
      FROM p LEFT JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))
SELECT m.page_id, m.host, m.path, m.rule, coalesce(m.action, CASE WHEN b.c IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM m LEFT JOIN node ON node.x = m.url LEFT JOIN grp ON grp.n = node.n LEFT JOIN blocked b ON b.c = grp.c WHERE m.k = 1
"""
