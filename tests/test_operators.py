"""Operators on small frames with known answers."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sieveline.functions import dates, fingerprint, ids, text, urls
from sieveline.operators import claims, dedup, graph, logs, passages, relational, retrieval
from sieveline.plans.source_plans import sample_hits
from sieveline.sources import files


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_urls(spark):
    cases = {
        "HTTP://www.Example.com:80/a/?utm_source=x&b=2&a=1#f": "http://www.example.com/a?a=1&b=2",
        "example.org": "https://example.org/",
        "mailto:a@b.c": None,
        "https://www.google.com/url?q=https%3A%2F%2Fx.org%2Fp%3Fgclid%3D1": "https://x.org/p",
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, want string")
    for r in df.select("u", "want", urls.canonicalize(F.col("u")).alias("got")).collect():
        assert r.got == r.want, r
    assert one(spark, "https://m.news.co.uk/x/amp/", "string", urls.identity_key) == "news.co.uk/x"
    assert one(spark, "a.b.co.uk", "string", urls.registrable_domain) == "b.co.uk"
    assert one(spark, "https://www.sec.gov/archives/edgar/1", "string", urls.classify) == "corporate_filing"


def test_identifiers(spark):
    assert one(spark, "see https://doi.org/10.1234/AbC).", "string", ids.normalize_doi) == "10.1234/abc"
    assert one(spark, "none", "string", ids.normalize_doi) is None
    assert one(spark, "arXiv:2401.01234v2", "string", ids.normalize_arxiv_id) == "2401.01234"
    assert one(spark, "https://other.org/2401.01234", "string", ids.normalize_arxiv_id) is None
    assert one(spark, "PARIS (AFP) - text", "string", ids.wire_service) == "Agence France-Presse"
    assert one(spark, "evidence:12", "string", ids.id_ordinal) == 12


def test_text(spark):
    assert one(spark, " a\r\n\r\n\r\n\r\nb \t c ", "string", text.normalize_whitespace) == "a\n\nb c"
    assert one(spark, "Breaking The Long Headline Here - Reuters", "string", text.title_key) == "the-long-headline-here"
    assert one(spark, "Q3 results", "string", text.title_key) is None
    assert [one(spark, w, "string", text.fold) for w in ("studies", "running", "as")] == ["study", "runn", "as"]
    assert one(spark, "“Quoted” — text…", "string", text.comparable) == '"quoted" - text...'


def test_fingerprints(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    got = df.select(fingerprint.jaccard(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(round(r.j, 4), r.c) for r in got] == [(0.3333, 0.5), (0.0, 0.0), (1.0, 1.0)]
    assert one(spark, [1.0, 0.0], "array<double>", lambda x: fingerprint.cosine(x, x)) == 1.0


def test_dates(spark):
    assert one(spark, "3 March 2024", "string", dates.parse_date) == dt.datetime(2024, 3, 3)
    assert one(spark, "soon", "string", dates.parse_date) is None


def test_copies_are_one_source(spark):
    story = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"outlet{i % 3}", "t", story + (" extra" if i == 4 else ""), "news") for i in range(5)] + [(9, "x", "t", "short", "web")], "id long, outlet string, title string, text string, family string")
    v = dedup.verdicts(dedup.similarity(dedup.candidates(docs), docs), docs)
    keys = {r.id: r.independence_key for r in dedup.independence(docs, v.where("relation <> 'independent'")).collect()}
    assert {keys[i] for i in range(5)} == {0} and keys[9] == 9


def test_roots_follow_chains(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "id long, matched_id long")
    assert {r.root for r in dedup.roots(chain).collect()} == {0}


def test_rrf_and_metrics(spark):
    ranks = spark.createDataFrame([(0, "lexical", 1, 1), (0, "vector", 1, 2), (0, "lexical", 2, 2)], "query_id int, retriever string, id int, rank int")
    got = {r.id: r.score for r in retrieval.rrf(ranks, retrieval.retriever_weight()).collect()}
    assert abs(got[1] - (1 / 61 + 0.9 / 62)) < 1e-7 and got[1] > got[2]
    m = retrieval.ranking_metrics(spark.createDataFrame([(0, 5, 1), (0, 7, 2)], "query_id int, id int, rank int"), spark.createDataFrame([(0, 7), (1, 3)], "query_id int, id int")).orderBy("query_id").collect()
    assert (m[0].recall, m[0].precision, m[0].rr) == (1.0, 0.5, 0.5) and m[1].recall == 0.0


def test_status_rules(spark):
    ev = spark.createDataFrame(
        [(1, 1, "supports", 7, "regulatory_document", dt.datetime(2024, 1, 1), False, True, None), (2, 2, "supports", 7, "web_page", dt.datetime(2024, 1, 1), False, False, None),
         (3, 3, "supports", 1, "web_page", dt.datetime(2024, 1, 1), True, True, None), (4, 4, "contradicts", 1, "web_page", dt.datetime(2024, 2, 1), False, True, None), (4, 5, "supports", 2, "web_page", dt.datetime(2024, 1, 1), False, True, None)],
        "claim_id int, document_id int, stance string, source_key int, source_type string, published_at timestamp_ntz, retracted boolean, has_excerpt boolean, wire_service string",
    )
    a = {r.claim_id: r for r in claims.assessment(spark.createDataFrame([(i,) for i in range(1, 6)], "claim_id int"), ev).collect()}
    assert [a[i].status for i in range(1, 6)] == ["supported", "insufficient_evidence", "insufficient_evidence", "mixed", "unverified"]
    assert a[4].superseded and a[5].gaps == ["no_evidence"]


def test_failures_and_gate(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), 1, "x", i < 3, 10.0, 0) for i in range(6)]
    calls = spark.createDataFrame(rows, "call_id long, ts timestamp_ntz, provider long, kind string, ok boolean, amount double, k int")
    assert logs.consecutive_failures(calls).first().failures == 3
    assert logs.circuit_breaker(calls).count() == 1
    assert logs.budget_gate(calls, 35.0).where("allowed").count() == 3


def test_chase_is_bounded(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(3, 0)], "src int, dst int")
    got = graph.chase(spark.createDataFrame([(0,)], "seed int"), edges, 4)
    assert sorted((r.id, r.hop) for r in got.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]


def test_upsert_and_ignore(spark):
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, relational.upsert(base, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, relational.insert_or_ignore(base, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_passages_are_verbatim():
    t = "One sentence here. " * 120 + "\n\n" + "tail " * 300
    cuts = passages.cut_text(t)
    assert all(b - a <= passages.LIMIT + passages.SHORT for a, b in cuts)
    assert "".join(t[a:b] for a, b in cuts).replace("\n", "") == t.replace("\n", "")


def test_payloads(spark):
    hits = {r.provider: r for r in sample_hits(spark).collect()}
    assert len(hits) == 10
    assert hits["openalex"].text == "one two three" and hits["openalex"].doi is None
    assert hits["crossref"].published == dt.datetime(2023, 5, 1) and hits["crossref"].text == "Hello there"
    assert hits["arxiv"].title == "Ar xiv" and hits["arxiv"].authors == ["X Y"]
    assert hits["gdelt"].published == dt.datetime(2024, 1, 3, 4)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Front\n---\n# Head\nbody")
    (tmp_path / "b.html").write_text("<html lang='en'><head><title>T</title></head><body><nav>no</nav><article><p>yes &amp; so</p></article></body></html>")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "c.txt").write_bytes("First line\nna\xefve".encode("cp1252"))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.html", "c.txt"}
    assert got["a.md"].title == "Front" and got["b.html"].text == "yes & so" and got["c.txt"].text.endswith("naïve")


def test_titles_keep_their_source():
    """Cut and other references are as written in the source; the title itself is decoded."""
    page = files.parse_page("<html>\n<head>\n<title>a &lt;b&gt; &quot;c&quot; &amp</title></head><body><svg><title>x</title></svg></body>")
    assert page[0] == 'a <b> "c" &' and page[6] == "a &lt;b&gt; &quot;c&quot; &amp"
    stated = files.parse_page('<meta property="og:title" content="T"><title>x &amp</title>')
    assert stated[0] == "T" and stated[6] is None and files.parse_page(None)[6] is None


def test_no_nested_loop_in_similarity_plans(spark, sf):
    from sieveline.plans import QUERIES

    for name in ("join_lsh_candidates", "dedup_near_lsh", "join_edge_both_ends"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_pdf_and_json_ld(spark, tmp_path):
    import zlib

    body = b"BT (Hello \\(PDF\\)) Tj 0 -14 Td (line \\050two\\051) Tj <FEFF00E9> Tj ET"
    raw = b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(body) + b"\nendstream\nendobj\n%%EOF"
    assert files.pdf_text(raw) == "Hello (PDF)\nline (two)é"
    (tmp_path / "x.pdf").write_bytes(raw)
    assert files.read_folder(spark, str(tmp_path)).first().title == "Hello (PDF)"
    html = '<script type="application/ld+json">{"@graph": [{"headline": "H", "author": [{"name": "A"}, "B"], "publisher": {"name": "P"}}]}</script><script type="application/ld+json">{bad</script>'
    assert files.parse_html(html)[5] == {"title": "H", "published": "", "authors": ["A", "B"], "site": "P", "description": ""}


def test_passage_queries_take_the_whole_query_set(spark, sf):
    from sieveline.plans import QUERIES

    want = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id % 20 = 0").collect()}
    for name in ("select_passages", "bm25_passage"):
        assert {r.query_id for r in QUERIES[name](spark, sf).select("query_id").distinct().collect()} == want


def test_similarity_equals_plain_sets(spark):
    """Hashed shingles give the scores of sets of strings, also for repeated, short and empty texts."""
    texts = {1: "a b c d e f g h", 2: "x a b c d e f g h y", 3: "a b c", 4: "", 5: None, 6: "a b c d e " * 4, 7: "A, b; c"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs = [(a, b) for a in texts for b in texts if a < b]
    got = {(r.a, r.b): r.score for r in dedup.similarity(spark.createDataFrame(pairs, "a long, b long"), docs).collect()}

    def shingles(text):
        w = re.findall("[a-z0-9]+", (text or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    for a, b in pairs:
        x, y = shingles(texts[a]), shingles(texts[b])
        both = len(x & y)
        want = max(both / len(x | y), both / len(x), both / len(y)) if x and y else 0.0
        assert got[a, b] == pytest.approx(want), (a, b)


def test_pairs_carry_shared_members_only(spark):
    """Pairs of texts that share nothing, and of equal ones, cost no set on the way; overlaps are those of whole sets."""
    own = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    texts = {i: own(i, 400) for i in range(20)} | {20: own(0, 400), 21: own(1, 200) + " " + own(99, 30), 22: None, 23: ""}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "a long, b long")
    out = dedup.overlaps(pairs, docs)
    got = {(r.a, r.b): (r.na, r.nb, r.i) for r in out.collect()}
    assert len(got) == 24 * 23 // 2 and got[0, 20] == (396, 396, 396) and got[1, 21] == (396, 226, 196) and got[22, 23] == (0, 0, 0)
    assert all(i == 0 for k, (_, _, i) in got.items() if k not in ((0, 20), (1, 21)))
    # no set of a text goes along with the pair, and only texts 1 and 21 have to be met
    assert "array_intersect" in out._jdf.queryExecution().optimizedPlan().toString()
    thin = [f for f in out.inputFiles() if "/shared-" in f]
    assert thin and {len(r.t) for r in spark.read.parquet(*sorted(set(thin))).collect()} == {196}


def test_passages_lose_nothing_but_blanks():
    import random

    g = random.Random(2)
    for _ in range(300):
        t = "".join(g.choice(["a.b", "word ", "3.14", "...", ". ", "! ", "?x", "\n", "\n\n", " \n \n", "é" * g.randrange(400), "x" * g.randrange(1200), "\t"]) for _ in range(g.randrange(1, 40)))
        cuts = passages.cut_text(t)
        assert "".join("".join(t[a:b].split()) for a, b in cuts) == "".join(t.split())
        assert all(a < b <= c for (a, b), (c, _) in zip(cuts, cuts[1:], strict=False)) and all(b - a <= passages.LIMIT + passages.SHORT for a, b in cuts)
