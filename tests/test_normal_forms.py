"""Urls, identifiers, titles and text in every spelling that has to agree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sieveline.functions import fingerprint, ids, markdown, text, urls
from sieveline.sources import mcp, queries


def check(spark, cases, expr):
    df = spark.createDataFrame([(k, v) for k, v in cases], "x string, want string")
    bad = [(r.x, r.got, r.want) for r in df.select("x", "want", expr(F.col("x")).alias("got")).collect() if r.got != r.want]
    assert not bad


def test_urls(spark):
    check(spark, [
        ("https://Example.COM/A/B/", "https://example.com/A/B"), ("http://example.com:80/x", "http://example.com/x"), ("https://example.com:443/x", "https://example.com/x"), ("https://example.com:8443/x", "https://example.com:8443/x"),
        ("https://example.com/x#section", "https://example.com/x"), ("example.com/x", "https://example.com/x"), ("https://example.com", "https://example.com/"),
        ("https://example.com/a?utm_source=twitter&id=7&fbclid=xyz&page=2", "https://example.com/a?id=7&page=2"), ("https://e.com/a?b=2&a=1", "https://e.com/a?a=1&b=2"), ("https://e.com/a?a-b=1&a=2&c=", "https://e.com/a?a=2&a-b=1"),
        ("https://news.google.com/rss/articles/CBMi?url=https%3A%2F%2Fapnews.com%2Farticle%2Fabc&hl=en", "https://apnews.com/article/abc"),
        ("https://www.google.com/url?q=https%3A%2F%2Fl.facebook.com%2F%3Fu%3Dhttps%253A%252F%252Fx.org%252Fp", "https://x.org/p"),
        ("https://e.com/a%20b/%7Euser/%41", "https://e.com/a%20b/~user/A"), ("https://e.com/caf\u00e9", "https://e.com/caf%C3%A9"), ("https://e.com/100%25", "https://e.com/100%"), ("https://e.com/a+b(c)", "https://e.com/a+b(c)"),
        ("https://e.com/?q=a+b&r=%C3%A9*~", "https://e.com/?q=a+b&r=%C3%A9%2A~"), ("https://b\u00fccher.example/x", "https://xn--bcher-kva.example/x"), ("https://e.com/bad%zz", "https://e.com/bad%zz"),
        ("javascript:alert(1)", None), ("data:text/html,x", None), ("mailto:a@b.c", None), ("", None), (None, None), ("#anchor", None), ("ftp://e.com/x", None),
    ], urls.canonicalize)
    check(spark, [("https://www.bbc.co.uk/news/story-1/amp", "bbc.co.uk/news/story-1"), ("https://bbc.co.uk/news/story-1", "bbc.co.uk/news/story-1")], urls.identity_key)
    check(spark, [("https://m.example.com/a", "example.com"), ("https://sub.news.bbc.co.uk/x", "sub.news.bbc.co.uk")], urls.host_of)
    check(spark, [("https://sub.news.bbc.co.uk/x", "bbc.co.uk"), ("https://www.reuters.com/a", "reuters.com"), ("https://example.org", "example.org")], lambda u: urls.registrable_domain(urls.host_of(u)))


def test_dois(spark):
    check(spark, [
        ("10.1038/S41586-020-2649-2", "10.1038/s41586-020-2649-2"), ("https://doi.org/10.1038/x", "10.1038/x"), ("http://dx.doi.org/10.1038/x", "10.1038/x"), ("doi:10.1038/x", "10.1038/x"), ("DOI: 10.1038/x.", "10.1038/x"),
        ("see 10.1234/abc).", "10.1234/abc"), ("10.1234/abc(1)", "10.1234/abc(1)"), ("(10.1234/abc(1)),", "10.1234/abc(1)"), ("10.1234/a[b]]", "10.1234/a[b]"), ("https://doi.org/10.1000%2FAB%28c%29", "10.1000/ab(c)"),
        ("", None), (None, None), ("not a doi", None), ("10.x/abc", None), ("https://example.com/a", None),
    ], ids.normalize_doi)
    check(spark, [("DOI:10.1000/xyz", "https://doi.org/10.1000/xyz")], ids.doi_to_url)
    check(spark, [("As shown in 10.1016/j.enpol.2024.114001 and 10.1038/s41586-020-2649-2.", "10.1016/j.enpol.2024.114001|10.1038/s41586-020-2649-2")], lambda t: F.array_join(ids.extract_dois(t), "|"))
    check(spark, [("arXiv:2401.01234v2", "2401.01234"), ("https://arxiv.org/abs/2401.01234", "2401.01234"), ("https://arxiv.org/pdf/2401.01234v3.pdf", "2401.01234"), ("10.48550/arXiv.2401.01234", "2401.01234"), ("hep-th/9901001v3", "hep-th/9901001"), ("https://example.com/abs/2401.01234", None)], ids.normalize_arxiv_id)


def test_titles_and_text(spark):
    check(spark, [("The Costs of SMRs - Reuters", "costs of smrs"), ("Caf\u00e9 Stra\u00dfe \u2014 \u00c9t\u00e9", "cafe strasse"), ("\u0141\u00f3d\u017a news today", "odz news today"), ("\uff21\uff22\uff23 def", "abc def"), (None, "")], text.normalize_title)
    check(spark, [("Small Modular Reactors: A Review!", "small-modular-reactors-a-review"), ("small modular reactors a review", "small-modular-reactors-a-review"), ("Q3 results", None), ("Introduction", None)], text.title_key)
    check(spark, [("a\u00a0b\r\nc  d \n\n\n\ne", "a b\nc d\n\ne"), ("\ufb01ne \u2460", "fine 1"), ("e\u0301", "\u00e9"), (None, "")], text.normalize_whitespace)
    check(spark, [("A  B\n\nC", "true")], lambda t: (fingerprint.content_hash(t) == fingerprint.content_hash(F.lit("a b\nc"))).cast("string"))


def test_wire_credits(spark):
    check(spark, [("WASHINGTON (Reuters) - the company said", "Reuters"), ("By Associated Press - March 4", "Associated Press"), ("PARIS (AFP) - officials confirmed", "Agence France-Presse"), ("Our reporter found documents showing", None)], ids.wire_service)


def test_markdown(spark):
    check(spark, [("a\n\nb", "> a\n>\n> b")], markdown.blockquote)
    check(spark, [("no|te [x]", "[[no te (x)]]")], markdown.wikilink)
    check(spark, [('T: "x"\n---', '---\na: "1"\ntitle: "T: \\"x\\"\\n---"\n---\n')], lambda t: markdown.frontmatter({"title": t, "a": F.lit(1), "none": F.lit(None).cast("string"), "empty": F.lit("")}))


def test_tag_and_terms(spark):
    check(spark, [("recent Nuclear-energy policy debate", "nuclearenergy"), ("news what", "newswhat")], queries.hashtag)
    check(spark, [("of the grid-scale storage", "all:the AND all:grid-scale AND all:storage"), ("a b", "all:a b")], queries.arxiv_terms)


@pytest.mark.parametrize(("body", "want"), [('{"a": 1}', '{"a": 1}'), ("event: m\ndata: {x\ndata: {\"b\": 2}\ndata: done", '{"b": 2}'), ("", None), (None, None), ("{broken", None), ("prose", None)])
def test_tool_replies(spark, body, want):
    check(spark, [(body, want)], mcp.payload)
