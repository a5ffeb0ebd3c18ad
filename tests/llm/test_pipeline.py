"""The pipeline's stages on small tables, each against what it should keep."""

from __future__ import annotations

import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as cp  # noqa: E402
from test_ops import brute_jaccard, brute_repeats  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_and_run(spark, docs):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeats", "decontamination", "encoding"]
    out = cp.run(spark, SF)
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_quality_keeps_clean(spark, docs):
    kept = cp.quality_stage(spark, docs, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert kept.columns == docs.columns and sum(i in ids for i in clean) >= 0.97 * len(clean)


def test_near_duplicates_keep_one(spark, docs):
    want = {c for _, c in brute_jaccard([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100).values()}
    kept = cp.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_repeats_are_cut(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    want = brute_repeats(texts, cp.REPEAT_BYTES)
    kept = {r.doc_id: r for r in cp.repeat_stage(spark, docs, SF).collect()}
    for i, (n, removed, _, sha) in want.items():
        if removed == 0:
            assert kept[i].text.encode() == texts[i]
        elif i in kept and hashlib.sha256(kept[i].text.encode()).hexdigest() != sha:
            assert n - removed - 8 <= len(kept[i].text.encode()) <= n - removed  # bytes of cut characters


def test_no_benchmark_item_is_left(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = cp.decontamination_stage(spark, docs, SF).collect()
    assert not [r for r in kept if any(t in r.text for t in items)]
    held = [r.doc_id for r in docs.collect() if any(t in r.text for t in items)]
    assert docs.count() - len(kept) == len(held)


def test_texts_without_an_id_of_their_own(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, "one text that nothing else is like at all"), (None, "quite another story about rivers and hills"), (None, "quite another story about rivers and hills"), (1, "first words under this very id"), (1, "second thing told by the same number"), (None, f"Here it is. {item}"), (None, None), (2, f"Here it is. {item}"), (2, "clean text under two")]
    odd = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], docs.schema)
    texts = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    near = " ".join(f"word{k}" for k in range(80))
    more = odd.union(spark.createDataFrame([(3, near, "en", "web", 1), (7, near + " end", "en", "web", 1), (7, "a text of its own under seven", "en", "web", 1), (None, near, "en", "web", 1)], docs.schema))
    want = {(i or 0, t or "") for i, t in rows} - {(0, f"Here it is. {item}")} | {(3, near), (7, "a text of its own under seven")}
    assert texts(cp.near_duplicate_stage(spark, more, SF)) == sorted(want)
    assert texts(cp.decontamination_stage(spark, odd, SF)) == sorted((i or 0, t or "") for i, t in rows if item not in (t or ""))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_odd_rows(spark, docs, name):
    """Nulls in any column, empty and long texts, repeated rows."""
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "web", 0), (None, "x " * 40_000, None, "web", 80_000), (3, "ab" * 30_000, "en", None, None), (3, " \n ", "de", "s", 3)]
    odd = spark.createDataFrame(rows, docs.schema)
    out = dict(cp.STAGES)[name](spark, odd, SF)
    got = out.collect()
    if name == "encoding":
        assert len(got) == len(rows) and all((r.n_tokens == 0) == (r.decoded_sha256 == hashlib.sha256(b"").hexdigest()) for r in got)
    else:
        assert out.columns == docs.columns and {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, *_ in rows} | {(r.doc_id, r.text) for r in got if name == "repeats"}
    if name == "near_duplicates":
        assert len(got) == len(set(rows))
    if name == "decontamination":
        assert len(got) == len(rows)


def test_stages_take_empty_tables(spark, docs):
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
