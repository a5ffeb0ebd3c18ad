"""What each combination of retrievers is worth."""

from __future__ import annotations

import random

import duckdb
import pytest
from conftest import rows_of

from sieveline.operators import evaluation as ev
from sieveline.plans import ORACLE_SQL, QUERIES
from sieveline.plans import retrieval_plans as rp

rnd = random.Random(3)


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    """Sixty documents, of which a few hold the items asked for, and vectors of the same ids."""
    path = str(tmp_path_factory.mktemp("judged"))
    words = [f"w{i}" for i in range(80)]
    items = {i: " ".join(rnd.sample(words, 6)) for i in (0, 20, 40)}
    texts = [" ".join(rnd.choices(words, k=30)) for _ in range(60)]
    for i, at in ((0, (3, 9, 21)), (20, (25,)), (40, (41, 42))):
        for x in at:
            texts[x] = " ".join([*rnd.choices(words, k=5 * x), items[i], "end"])
    write = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    write([(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write(list(items.items()), "item_id long, text string", "benchmark")
    write([(i, [rnd.gauss(0, 1) for _ in range(8)], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int", "embeddings")
    return path


def test_every_combination_has_its_row(spark, judged):
    """Five combinations, each with all averages, as in SQL; those that operators rank by themselves have the same values."""
    df = QUERIES["ablation_eval"](spark, judged)
    got = df.collect()
    rows = {r.combo: r for r in got}
    assert set(rows) == {"lexical", "lexical+graph", "lexical+vector", "vector", "all"} and all(r.queries == 3 for r in got)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{judged}/{t}.parquet/*.parquet'")
    q = con.execute(ORACLE_SQL["ablation_eval"])
    names = [x[0] for x in q.description]
    assert rows_of(df.columns, got, sorted(names)) == rows_of(names, q.fetchall(), sorted(names))
    rel, lex = rp._relevant(spark, judged), rp._lexical(spark, judged)
    for combo, run in (("lexical", lex), ("vector", rp._vector_hits(spark, judged)), ("lexical+graph", ev.with_graph(lex, rp.b.citations(spark, judged)))):
        m, r = ev.averages(run.select("query_id", "id", "rank"), rel).first(), rows[combo]
        assert (r.recall_at_5, r.recall, r.mrr, r.ndcg) == (m.recall_at_5, m.recall_at_10, m.mrr, m.ndcg_at_10)
    assert len({tuple(r)[1:] for r in got}) > 2
