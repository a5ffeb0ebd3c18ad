"""URL handling as column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that never change which document is returned.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "utm_brand", "utm_social",
    "utm_social-type", "utm_swu", "utm_cid", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid", "yclid",
    "_hsenc", "_hsmi", "hsctatracking", "ref", "ref_src", "ref_url", "referrer", "source", "src", "cmpid", "cmp", "ncid", "ito", "at_medium",
    "at_campaign", "sh", "spm", "share", "shared", "smid", "smtyp", "partner", "__twitter_impression", "guccounter", "guce_referrer",
    "guce_referrer_sig", "amp", "outputType", "s_kwcid",
)
#: Hosts that wrap a destination in a parameter.
REDIRECT_HOSTS = {
    "news.google.com": ("url",), "www.google.com": ("url", "q"), "google.com": ("url", "q"),
    "l.facebook.com": ("u",), "out.reddit.com": ("url",), "www.bing.com": ("u",),
}
#: Suffixes under which an organisation has three labels.
LONG_SUFFIXES = (".co.uk", ".ac.uk", ".gov.uk", ".org.uk", ".co.jp", ".com.au", ".co.nz", ".com.br", ".co.in", ".com.cn", ".gov.au", ".ac.jp", ".org.au")

#: Hosts by kind of source.
REGULATORS = (
    "nrc.gov", "ferc.gov", "sec.gov", "epa.gov", "fda.gov", "ftc.gov", "cftc.gov", "occ.gov", "federalreserve.gov", "eia.gov", "doe.gov",
    "energy.gov", "esma.europa.eu", "ec.europa.eu", "ofgem.gov.uk", "fca.org.uk", "onr.org.uk", "iaea.org", "cnsc-ccsn.gc.ca",
)
GOVERNMENT = (".gov", ".mil", ".gov.uk", ".gc.ca", ".gov.au", ".govt.nz", ".europa.eu")
VIDEO = ("youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "c-span.org")
FORUM = ("reddit.com", "news.ycombinator.com", "stackexchange.com", "quora.com")
SOCIAL = ("x.com", "twitter.com", "bsky.app", "mastodon.social", "threads.net", "linkedin.com")
PRESS = ("prnewswire.com", "businesswire.com", "globenewswire.com", "newswire.ca", "eqs-news.com")
PRESS_PATHS = ("/press-release", "/press-releases", "/news-release", "/newsroom", "/media-release", "/press/", "/pressroom")
FILINGS = ("/archives/edgar", "/cgi-bin/browse-edgar", "sec.gov/ix?doc=")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once; nested expressions stay small for code generation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: What a path keeps as it is when it is written anew; the rest is percent-encoded.
SAFE_IN_PATH = "/%:@!$&'()*+,;=~-._"


def _decoded(text: Column, plus: bool) -> Column:
    """Percent-encoding undone, and ``+`` as a blank if ``plus``; text that is not well encoded stays."""
    return F.coalesce(F.try_url_decode(text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _path_encoded(path: Column) -> Column:
    """A path decoded and encoded again, so that its spellings agree."""
    out = F.replace(F.url_encode(_decoded(path, False)), F.lit("+"), F.lit("%20"))
    for c in SAFE_IN_PATH:
        if not (c.isalnum() or c in "-._*"):  # these the encoder keeps
            out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(path.rlike(r"[^A-Za-z0-9/:@!$&'()*+,;=~\-._]"), out).otherwise(path)


def _form_encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _params(query: Column) -> Column:
    """Name and value of each parameter that has both, decoded."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    return F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1), True).alias("k"), _decoded(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, 1 << 30), True).alias("v")))


def _ascii_host(host: Column) -> Column:
    """An international host in its ASCII form; a name that has none stays."""
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host), host)).otherwise(host)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def with_scheme(url: Column) -> Column:
    """The url, https where it names no scheme; null for what is no web address."""
    u = F.trim(url)
    bad = (u == "") | u.rlike("^(javascript:|data:|mailto:|#)")
    return F.when(~bad, F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), F.regexp_replace(u, "^/+", ""))))


def unwrap_redirect(url: Column) -> Column:
    """The destination that a known redirector's url carries, else the url."""
    wanted = F.create_map(*[x for name, params in REDIRECT_HOSTS.items() for x in (F.lit(name), F.array(*map(F.lit, params)))])[F.lower(_part(url, 2))]

    def target(params: Column) -> Column:
        # the first of the host's parameters, in that order, that holds a url
        named = lambda p: F.get(F.filter(params, lambda x: (x["k"] == p) & _decoded(x["v"], False).contains("://")), F.lit(0))["v"]
        return F.get(F.filter(F.transform(wanted, named), lambda v: v.isNotNull()), F.lit(0))

    return F.when(wanted.isNotNull(), F.coalesce(with_scheme(_decoded(let(_params(_part(url, 5)), target), False)), url)).otherwise(url)


def canonicalize(url: Column) -> Column:
    """A clean url that can still be fetched; null when unusable.

    Lower-case scheme and host (ASCII form), no default port, no fragment, no
    trailing slash, paths and parameters in one encoding, no tracking or empty
    parameters, the others sorted. Redirectors are unwrapped, up to three in one another.
    """
    return let(let(let(let(with_scheme(url), unwrap_redirect), unwrap_redirect), unwrap_redirect), _canonical)


def _canonical(u: Column) -> Column:
    scheme, host, port, path, query = F.lower(_part(u, 1)), _ascii_host(F.lower(_part(u, 2))), _part(u, 3), _path_encoded(_part(u, 4)), _part(u, 5)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    kept = F.array_sort(F.filter(_params(query), lambda p: ~F.lower(p["k"]).isin(*[t for t in TRACKING if t != "outputType"])))
    kept = F.transform(kept, lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"])))
    path = F.when(path == "", "/").when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    path = F.when(path == "", "/").otherwise(path)
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), out)


def host_of(url: Column) -> Column:
    """Lower-case host without one leading www., m., mobile. or amp. label; null without a host."""
    u = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return let(F.lower(_part(u, 2)), _bare_host)


def _bare_host(host: Column) -> Column:
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    host = F.when((dots > 1) & host.rlike(r"^(www|m|mobile|amp)\."), F.regexp_replace(host, r"^[a-z]+\.", "")).otherwise(host)
    return F.nullif(host, F.lit(""))


def registrable_domain(host: Column) -> Column:
    """Last two labels of a host, three under the listed suffixes."""
    labels = F.split(host, r"\.")
    long_ = F.lit(False)
    for s in LONG_SUFFIXES:
        long_ = long_ | host.endswith(s)
    return F.when(F.size(labels) <= 2, host).when(long_, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def identity_key(url: Column) -> Column:
    """For comparison only: host and path without scheme, AMP form, index page and paging parameters."""
    return let(canonicalize(url), _key)


def _key(u: Column) -> Column:
    path = F.regexp_replace(_part(u, 4), r"(?<=.)(/amp/|/amp\.html|/amp-story|/amp|\.amp)$", "")
    path = F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"(/*)index\.html$", "")
    params = F.array_sort(F.filter(F.split(_part(u, 5), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin("amp", "outputtype", "page")))
    return F.lower(F.concat(host_of(u), path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")))


def classify(url: Column, title: Column | None = None, is_news: Column | None = None) -> Column:
    """Source type of a url, by ordered rules."""
    title = F.lit("") if title is None else F.lower(F.trim(F.coalesce(title, F.lit(""))))
    is_news = F.lit(False) if is_news is None else is_news
    host = F.coalesce(host_of(url), F.lit(""))
    domain, low = registrable_domain(host), F.lower(url)
    path = F.lower(_part(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url)), 4))
    filing = functools.reduce(operator.or_, [low.contains(x) for x in FILINGS])
    press = functools.reduce(operator.or_, [path.contains(x) for x in PRESS_PATHS])
    gov = functools.reduce(operator.or_, [host.endswith(s) for s in GOVERNMENT])
    return (
        F.when(url.isNull() | (url == ""), "web_page")
        .when(filing, "corporate_filing")
        .when(domain.isin(*VIDEO), "video").when(domain.isin(*FORUM), "forum_post").when(domain.isin(*SOCIAL), "social_post")
        .when(domain.isin(*PRESS), "press_release").when(domain.isin(*REGULATORS) | host.isin(*REGULATORS), "regulatory_document")
        .when(gov, "government_document")
        .when(press | title.rlike("^(press|news|media) release"), "press_release")
        .when(is_news, "secondary_news_reporting").otherwise("web_page")
    )
