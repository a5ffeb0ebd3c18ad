"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import bpe, components, decontam, jaccard, kdtree, quality, registry, suffix_dedup, textbytes, token_count, toxicity, url_filter, warc
from sieveline.llm.common import shared_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Columns that no operator may trip over.
CLASH = "doc_id long, text string, rid long, n int, score double, component string, ranges string, _text string, key string"
rnd = random.Random(7)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]


def words(n: int, pool: int = 4000) -> str:
    return " ".join(f"w{rnd.randrange(pool)}x" for _ in range(n))


def docs_of(spark, texts, schema=CLASH):
    return spark.createDataFrame([(i, t, 1, 2, 0.5, "c", "r", "t", "k") for i, t in texts], schema)


ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "a"), (5, "é中👍 naïve"), (6, "x" * 30_000), (7, "ab " * 5000), (8, "<s> </s> <|endoftext|>")]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_bpe_equals_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, *((100 + i, "".join(rnd.choice("ab \n\t\x0b\x1c\x85　é中1'st.!") for _ in range(80))) for i in range(200)), (400, "ab" * 999), (401, " " * 700 + "z"), (402, "中文字符没有空格" * 400), (403, "".join(rnd.choice("etaoinshr") for _ in range(9000))), (404, "é中a" * 900)]
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs_of(spark, texts), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in texts:
        want = enc.encode_ordinary(t or "")
        assert list(got[i].ids) == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert bytes(got[i].decoded) == (t or "").encode()


def test_token_counts_equal_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*ODD, *((100 + i, "".join(rnd.choice("the in er  \n▁é中a'") for _ in range(60))) for i in range(300)), *((500 + k, " " * k + "the") for k in range(40))]
    got = {r.doc_id: r for r in token_count.token_counts(docs_of(spark, texts), MODEL, 100).collect()}
    for i, t in texts:
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), t


def thue_morse(a: str, b: str, n: int) -> str:
    """Two letters in an order on which hashes modulo a power of two collide with its complement's."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


TWINS = [thue_morse(*pair, n) for x, y in ("in", "er", "es", "ab") for n in (1024, 2048) for pair in ((x, y), (y, x))]


def test_token_counts_of_twins(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(docs_of(spark, list(enumerate(TWINS))).coalesce(1), MODEL).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in enumerate(TWINS)}


def test_twins_are_different_texts(spark):
    df = docs_of(spark, list(enumerate(TWINS)))
    assert all(r.component_id == r.doc_id for r in jaccard.jaccard_components(df).collect())
    want = brute_repeats({i: t.encode() for i, t in enumerate(TWINS)}, 400)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, 400).collect()} == want


def test_identity_hash():
    data = np.frombuffer("".join(TWINS).encode() * 60, np.uint8)  # over several blocks
    h = textbytes.IdentityHash(data)
    n = len("".join(TWINS))
    start = np.cumsum([0] + [len(t) for t in TWINS])[:-1]
    size = np.array([len(t) for t in TWINS])
    once = h(start, start + size)
    assert len(set(once.tolist())) == len(TWINS) and (h(start + 59 * n, start + 59 * n + size) == once).all()
    p = 2**61 - 1
    want = 0
    for i, c in enumerate(data[:3000].tolist()):
        want = (want + (c + 1) * pow(textbytes._POINT, i, p)) % p
    assert int(h.sums[3000]) == want


@pytest.mark.parametrize("chunk", [5, 97, 1024])
def test_chunk_maps_compose(monkeypatch, chunk):
    monkeypatch.setattr(token_count, "CHUNK", chunk)
    c = token_count.TokenCounter(MODEL)
    for text in ("abcdefghij" * 700, thue_morse("in", "er", 3000), "the" * 900, "".join(rnd.choice("theinrsa") for _ in range(4000))):
        maps = c.chunk_maps(text)
        prefixes = token_count.scan(maps)
        state, n = c.fst.start, 0
        for i in range(0, len(text), chunk):
            state, more = c.fst.run(state, text[i : i + chunk])
            n += more
            assert prefixes[i // chunk](c.fst.start) == (state, n)
        # entry states were known before the scan
        assert sum(len(m.known) for m in maps) >= len(maps)


def test_warc_chain_rejects_magic_in_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a.b/ c\r\nX: y", "same", "q"), (2, None, "same", "q"), (3, "u", None, "q"), (4, "u", "", "q"), (5, "u", inner, "q"), (6, "u", inner + "more", "q"), (7, "u", "é" * 5000, "q"), (2, None, "same", "q"), (None, "u", "nul", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, value string").repartition(2)
    got = warc.warc_round_trip(pages, shared_path(spark, "warc-test")).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, r)
    assert by[1].record_type == "revisit" and by[1].refers_to == 2 and by[2].record_type == "response"
    assert by[3].record_type == "revisit" and by[3].refers_to == 4 and by[3].payload_bytes == 0
    for k, html in ((1, "same"), (5, inner), (6, inner + "more"), (7, "é" * 5000)):
        raw = html.encode()
        assert by[k].payload_bytes == len(raw) and by[k].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert warc.warc_round_trip(pages.limit(0), shared_path(spark, "warc-empty")).count() == 0


def test_pointer_jumping():
    offsets = np.array([0, 10, 15, 30, 40])
    assert warc.reachable(offsets, np.array([10, 30, 22, 99, 50])).tolist() == [True, True, False, True, False]
    assert warc.reachable(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_components_match_union_find(spark):
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def test_url_rules_and_aliases(spark):
    page = lambda u, h="": (u, h)
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [page("HTTP://A.Example.COM/en/7?x"), page("http://b.com/en/1"), page(None), page("nourl"), page("http://c.net/x", link("http://b.com/en/1")), page("http://d.net/y", '<meta http-equiv="refresh" content="0; url=http://c.net/x">'),
            page("http://e.net/z", link("http://example.com/en/70")), page("http://f.net/", link("http://b.com/en/2")), page("http://g.net/", link("http://e.net/z") + "<meta http-equiv=refresh content='0;url=http://b.com/en/3'>"), page("http://netx/de/1"), page("://com/en/")]
    df = spark.createDataFrame([(i, *r, "v") for i, r in enumerate(rows)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1].verdict == "block" and (got[2].host, got[2].path, got[2].verdict) == ("", "", "allow") and got[3].host == ""
    assert got[4].verdict == "block" and got[5].verdict == "block"  # aliases of a blocked url
    assert got[6].verdict == "allow" and got[7].verdict == "block" and got[8].verdict == "allow"  # an explicit allow in the group goes first
    assert got[9].rule is None and got[10].rule == "com/en/"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_top_k_shards(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(200)] + [(200 + i, [0.5] * 8) for i in range(50)]
    bad = [(1000, None), (1020, [1.0, None] * 4), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "s") for i, v in vecs + bad + vecs[:3]], "vec_id long, embedding array<double>, shard string")
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vecs}
    got = {}
    for r in kdtree.top_k(df, 7, 64, 20, shard_rows=40, block_rows=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i in (x for x in q if x % 20 == 0):
        want = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:7]
        assert sorted(got.pop(i)) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    assert not got and kdtree.top_k(df.limit(0)).count() == 0


def test_top_k_beyond_64_bits(spark):
    vecs = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [1e-3, 2.0]), (4, [0.0, -3e16]), (20, [1e308, 1e308]), (40, [1e9, 1.0]), (5, [1.0])]
    got = {}
    for r in kdtree.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"), 3, 64, 20, shard_rows=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: [max(-(10**300), min(10**300, math.floor(64 * Fraction(x)))) for x in v] for i, v in vecs}
    most = 2**63 - 1
    for i in (0, 20, 40):
        score = {j: max(-most, min(most, sum(a * b for a, b in zip(q[i], q[j], strict=True)))) for j in q if j not in (i, 5)}
        want = sorted((-s, j) for j, s in score.items())[:3]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]


def test_tree_opens_few_nodes():
    rng = np.random.default_rng(4)
    points = np.floor(64 * rng.normal(size=(4000, 3)))
    tree, opened = kdtree.KDTree(np.arange(4000), points, 16), []
    scan = tree._scan
    tree._scan = lambda q, rows, *rest: (opened.append(len(q)), scan(q, rows, *rest))
    queries = points[:50]
    scores, ids = tree.search(np.arange(50), queries, 5, np.full(50, -np.inf), np.full(50, 2**62))
    every = queries @ points.T
    every[np.arange(50), np.arange(50)] = -np.inf
    assert (scores == -np.sort(-every, 1)[:, :5]).all() and sum(opened) < 0.2 * 50 * (tree.child < 0).sum()


def brute_repeats(texts: dict, length: int) -> dict:
    c = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[k] = (len(t), int(cover.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~cover].tobytes()).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    passage = words(40)
    texts = [*ODD, (20, words(60) + passage + words(10)), (21, passage), (22, words(5) + " " + passage[7:] + words(9)), (23, "é" * 400), (24, "x" + "é" * 300), (25, words(80)), (26, "abc" * 400 + words(20))]
    texts += [(27, dict(texts)[25]), (28, passage * 3)]
    df = docs_of(spark, texts)
    want = brute_repeats({i: (t or "").encode() for i, t in texts}, 120)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, 120).collect()}
    assert got == want
    kept = {r.doc_id: r for r in suffix_dedup.cut_repeats(df.withColumn("n_chars", F.length("text")), 120).collect()}
    assert 21 not in kept and kept[0].text is None and kept[1].text == "" and kept[20].n_chars == len(kept[20].text) and kept[25 - 5].key == "k"
    assert suffix_dedup.remove_repeats(df.limit(0), 120).count() == 0


@pytest.mark.parametrize("length", [3, 6])
def test_two_stage_suffix_order(length):
    for _ in range(60):
        alphabet = rnd.choice([b"ab", b"a", bytes([0, 1, 255]), b"abcd"])
        spans = [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(length, 30))) for _ in range(rnd.randint(1, 6))]
        counts = np.array([len(s) - length + 1 for s in spans])
        order, raw, window = suffix_dedup.suffix_order(spans, counts, length)
        base = np.cumsum([0] + [len(s) + 1 for s in spans])
        cut = lambda p: spans[np.searchsorted(base, p, "right") - 1][p - base[np.searchsorted(base, p, "right") - 1] :][:length]
        keys = [cut(p) for p in order[window[order]]]
        assert keys == sorted(keys) and len(keys) == counts.sum()


def brute_jaccard(texts, width, num, den):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (t or "").translate(fold)) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "num", "block", "thin"), [(3, 90, 8192, False), (5, 80, 8192, False), (3, 90, 2, False), (5, 80, 3, False), (5, 80, 8192, True), (3, 90, 8192, True), (5, 80, 3, True)])
def test_jaccard_equals_brute_force(spark, width, num, block, thin):
    texts = [*ODD, (9, "two words"), (10, "TWO  words"), (11, "words two")]
    for g in range(8):
        base = words(rnd.choice([12, 40, 150])).split()
        for k in range(5):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"edit{rnd.randrange(99)}"
            texts.append((100 + 10 * g + k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts), width, num, 100, block=block, thin=thin).collect()}
    assert got == brute_jaccard(texts, width, num, 100)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2)])
def test_similar_sets_share_a_signature(num, den):
    rng, scheme = np.random.default_rng(2), jaccard.PartEnum(num, den)
    for _ in range(400):
        n = int(rng.integers(2, 300))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        add = int(rng.integers(0, n * (den - num) // num + 1))
        gone = 0
        while den * (n - gone - 1) >= num * (n + add) and n - gone > 1:
            gone += 1
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, add).astype(np.uint64)])
        if not gone and not add:
            continue
        s, rows = scheme.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert set(s[rows == 0].tolist()) & set(s[rows == 1].tolist())


def test_url_filter_follows_every_link(spark):
    canon = lambda t: f'<link rel="canonical" href="{t}">'
    base = "http://a.com/fr/"
    rows = [
        (1, "http://a.com/en/x", ""), (2, base + "y", canon("../en/x")), (3, base + "z", canon("y")), (4, base + "q?id=1", canon("http://a.com/en/x?a=1&amp;b=2")),
        (5, "http://a.com/en/x?a=1&b=2", ""), (6, base + "two", canon("http://c.net/none") + canon("/de/../en/x")), (7, base + "r", canon("?id=1")), (8, base + "r?id=1", canon("./y")),
        (9, base + "s", '<meta http-equiv="refresh" content="0; url=http://c.net/n"><meta http-equiv="refresh" content="5; url=../en/x">'), (10, base + "m", canon("mailto:x@a.com")), (11, "http://b.com", canon("free")), (12, "http://b.com/free", ""),
    ]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    edges = {(r.u, r.v) for r in url_filter.link_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {("http://b.com/", "http://b.com/free"), (base + "q?id=1", "http://a.com/en/x?a=1&b=2")} <= edges


def test_url_filter_equals_its_sql(spark):
    """The SQL's closure over pages that do have aliases, some under hosts in upper case."""
    import duckdb

    canon = lambda t: f'<LINK href="{t}" rel=canonical>'
    hosts = ["a.com", "B.com", "b.com", "c.net", "EXAMPLE.com", "d.org", "e.test"]
    rows = []
    for i in range(160):
        n = i % 40
        paths = [f"/{n}", f"/en/1{n}", f"/en/7{n}", f"/de/81{n}", f"/es/2{n}?q=1", f"/x{n}/../en/3{n}", f"/x/y{n}#z"]
        targets = [f"http://{h}{p}" for h in hosts for p in paths] + [f"../en/9{n}", f"/en/8{n}", f"?a={n}&amp;b=2", "#top", f"page{n}", f"./q{n}/.", "mailto:x@y.z", f"//b.com/en/1{n}", ""]
        html = rnd.choice(["", canon(rnd.choice(targets)), f"<meta content='0;url={rnd.choice(targets)}' http-equiv='Refresh'>", canon(rnd.choice(targets)) + canon(rnd.choice(targets)), "<link rel=stylesheet href=http://a.com/en/1> canonical"])
        rows.append((i, rnd.choice([f"http://{rnd.choice(hosts)}{rnd.choice(paths)}", f"http://u{i}.test/x/{i}", None if i % 20 == 0 else f"https://v{i}.test"]), html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows], "url": pa.array([r[1] for r in rows], pa.string()), "html": [r[2] for r in rows]}))
    names = ["page_id", "host", "path", "rule", "verdict"]
    want = {r[0]: r for r in con.execute(f"SELECT {', '.join(names)} FROM ({url_filter.SQL})").fetchall()}
    got = {r.page_id: tuple(r[n] for n in names) for r in url_filter.filter_urls(df).collect()}
    assert got == want and sum(r[3] is None and r[4] == "block" for r in got.values()) > 5


def test_decontamination_slots(spark):
    item = "A train leaves the old station at 40 km and a second train follows at 60 km so when after 40 minutes do they meet"
    same = item.replace("40", "35").replace("60", "75")
    odd = item.replace("at 40", "at 35")  # the first 40 becomes 35, the second stays
    texts = [(1, "Intro words here. " + item + " and more"), (2, "see " + same), (3, "see " + odd), (4, words(50)), (5, None), (6, ""), (7, "short item"), (1, "Intro words here. " + item + " and more")]
    bench = spark.createDataFrame([(10, item, "n"), (11, None, "n"), (12, "", "n"), (13, "short item", "n")], "item_id long, text string, rid string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert {(1, 10), (2, 10), (7, 13)} <= got and not {d for d, _ in got} & {4, 5, 6}
    kept = {r.doc_id for r in decontam.drop_contaminated(docs_of(spark, texts), bench).collect()}
    assert {4, 5, 6} <= kept and not kept & {1, 2, 7}
    assert decontam.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0 and decontam.contaminated(docs_of(spark, texts).limit(0), bench).count() == 0
    # in a stretch of the slots' disagreement, no line of six windows is left
    assert (3, 10) not in got


def test_decontamination_exact_copies(spark):
    items = [
        (1, "Question: What is the capital city of the old northern land today?"), (2, "Compute 3 + 4 * Alice Bob Carol 5 6 kg."),
        (3, "Days pass and the river runs on"), (4, "7 8 9"), (5, "Water boils"),
    ]
    texts = [(i, f"see here the next one {t} and so on") for i, t in items] + [(10 + i, f"It ends. {t} And so on") for i, t in items]
    texts += [(20, "we have 3 " + items[2][1]), (21, "see Answer" + items[0][1][8:]), (22, "Compute 3 + 4 * Dora Bob Carol 5 6 kg."), (23, "7 8 10"), (24, "see Alice boils")]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i + k, i) for i, _ in items for k in (0, 10)} | {(20, 3)}


def accuracy(rows, labels, held):
    right = [(r.predicted == labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out == held]
    return sum(right) / max(1, len(right))


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = registry.op1_quality(spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert accuracy(rows, labels, True) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = registry.op5_toxicity(spark, d).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert accuracy(rows, labels, True) >= 0.95
    toxic = [r for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    named = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None and r.predicted == 1]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(labels[r.doc_id] for r in named) >= 0.85 * len(named)


def test_classifiers_take_odd_rows(spark):
    df = docs_of(spark, ODD)
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality.classify_quality, toxicity.classify_toxicity):
        assert f(df, labels).count() == len(ODD) and f(df, labels.limit(0)).count() == len(ODD) and f(df.limit(0), labels).count() == 0
    none = quality.classify_quality(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def plain_hash(data: bytes) -> int:
    arr = np.frombuffer(data, np.uint8)
    return int(textbytes.RangeHash(arr)(np.array([0]), np.array([len(arr)]))[0])


@pytest.mark.parametrize("bag", [0, 2, 6])
def test_toxicity_equals_plain_scorer(bag):
    """Scores by dictionaries and loops: subwords of each word, their mean in a bag, the worst bag."""
    texts = [f"good {words(9, 30)}" for _ in range(30)] + [f"{words(4, 30)} vilest slurword {words(3, 30)}" for _ in range(30)]
    m = toxicity.train([t.encode() for t in texts], np.array([0.0] * 30 + [1.0] * 30), buckets=1 << 12, epochs=8, bag_words=bag)
    table = dict(enumerate(m.subword.astype(float).tolist()))

    def score(text: str) -> float:
        logits, found = [], __import__("re").findall("[0-9A-Za-z\x80-\U0010ffff]+", text)
        for k in range(0, len(found), bag or max(1, len(found))):
            total = n = 0
            for w in found[k : k + (bag or len(found))]:
                b = b"<" + w.encode() + b">"
                grams = [b] + [b[i : i + g] for g in range(3, 7) if g < len(b) for i in range(len(b) - g + 1)]
                total += sum(table[plain_hash(g) % (1 << 12)] for g in grams)
                n += len(grams)
            logits.append(total / n + m.bias)
        return 1 / (1 + math.exp(-max(logits, default=m.bias)))

    some = [*texts[:5], *texts[-5:], "", "  ", "é slurw0rd", "one", "a b c d e f g h", "slurword!"]
    got = np.concatenate([m.score(d, o) for _, _, d, o in textbytes.chunks(pa.array(some))])
    assert np.allclose(got, [score(t) for t in some], atol=1e-9)


def test_quality_equals_plain_scorer():
    """Scores by dictionaries: relative frequencies of each text's n-grams, taken alone, times their weights."""
    texts = [words(20, 40) for _ in range(40)]
    alone = [quality.vectors(*next((d, o) for _, _, d, o in textbytes.chunks(pa.array([t]))))[0] for t in texts]
    m = quality.ftrl(alone, np.array([float("w1" in t) for t in texts]), epochs=3)
    weight = {i: float(w) for i, w in enumerate(m.weights) if w}

    def score(text: str) -> float:
        total = m.bias
        for _, _, data, offsets in textbytes.chunks(pa.array([text])):
            for idx, _ in quality.features(data, offsets):
                counts = Counter(idx.tolist())
                total += sum(quality.MASS * c / len(idx) * weight.get(i, 0.0) for i, c in counts.items())
        return 1 / (1 + math.exp(-total))

    some = [*texts[:8], "", "w1x", "Ab, cd. EF-12!", " . ", texts[0] + " " + texts[1]]
    got = np.concatenate([m.score(d, o) for _, _, d, o in textbytes.chunks(pa.array(some))])
    assert np.allclose(got, [score(t) for t in some], atol=1e-6) and weight
    # word n-grams of a text, counted by a dictionary, are as many as the hashed ones
    idx, _ = quality.features(*next((d, o) for _, _, d, o in textbytes.chunks(pa.array([texts[0]]))))[1]
    assert sorted(Counter(idx.tolist()).values()) == sorted(Counter(zip(texts[0].split(), texts[0].split()[1:], strict=False)).values())


def test_repeated_rows_are_each_judged(spark):
    twice = [(1, "one text here"), (1, "one text here"), (1, "another text under it"), (None, "x y"), (None, "x y")]
    df, none = docs_of(spark, twice), docs_of(spark, []).limit(0)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (
        lambda d: quality.classify_quality(d, labels), lambda d: toxicity.classify_toxicity(d, labels), lambda d: token_count.token_counts(d, MODEL),
        lambda d: bpe.bpe_round_trip(d, RANKS, public_tokenizers.PATTERN), lambda d: jaccard.jaccard_components(d), lambda d: suffix_dedup.remove_repeats(d, 400),
    ):
        assert f(df).count() == len(twice) and f(none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "")] * 3 + [(None, None, None)] * 2, "page_id long, url string, html string")
    assert url_filter.filter_urls(pages).count() == 5 and url_filter.filter_urls(pages.limit(0)).count() == 0


def test_decontamination_of_long_texts(spark):
    item = "Which of the seven rivers of the eastern plain carries the most water in spring"
    long_ = [(1, words(60_000) + " " + item + " " + words(60_000)), (2, words(120_000))]
    got = decontam.contaminated(docs_of(spark, long_), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)]


def test_warc_of_long_payloads(spark):
    magic = "WARC/1.1\r\nContent-Length: 999999999\r\n\r\n" * 400
    pages = spark.createDataFrame([(1, "u", "é<" * 2_000_000), (2, "u", magic)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.warc_round_trip(pages, shared_path(spark, "warc-long")).collect()}
    assert got[1].payload_bytes == 6_000_000 and got[2].payload_bytes == len(magic.encode()) and all(r.verified for r in got.values())


def test_ftrl_learns_a_word():
    good, bad = pa.array([f"fine {words(8)}" for _ in range(60)]), pa.array([f"junk {words(8)}" for _ in range(60)])
    rows, y = [], []
    from sieveline.llm.textbytes import chunks

    for arr, label in ((good, 1.0), (bad, 0.0)):
        for _, _, data, offsets in chunks(arr):
            vecs = quality.vectors(data, offsets)
            rows += vecs
            y += [label] * len(vecs)
    m = quality.ftrl(rows, np.array(y), epochs=6)
    score = lambda t: float(np.concatenate([m.score(d, o) for _, _, d, o in chunks(pa.array([t]))])[0])
    assert score("fine day") > 0.7 > score("junk day")
