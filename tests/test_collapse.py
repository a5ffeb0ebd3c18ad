"""Hits that tell one story take one place."""

from __future__ import annotations

import duckdb
from conftest import rows_of

from sieveline.plans import ORACLE_SQL, QUERIES


def test_near_copies_collapse_too(spark, tmp_path):
    """A text, its exact copy and one with a word more are one source; the copies are named. As in SQL."""
    story = " ".join(f"w{i}" for i in range(40))
    texts = [" ".join(f"x{i}y{j}" for j in range(20)) for i in range(6)] + [story, story, story + " more"]
    write = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(i, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(20, "w1 w2 w3 w7 w9")], "item_id long, text string", "benchmark")
    write([(i, [1.0, float(i)], 0) for i in range(9)], "vec_id long, embedding array<float>, label int", "embeddings")
    df = QUERIES["collapse_copies"](spark, str(tmp_path))
    got = df.collect()
    (row,) = (r for r in got if r.query_id == 20 and r.independence_key == 6)
    assert (row.id, row.copies, sorted(row.copy_ids.split(","))) == (6, 2, ["7", "8"])
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    q = con.execute(ORACLE_SQL["collapse_copies"])
    names = [x[0] for x in q.description]
    assert rows_of(df.columns, got, sorted(names)) == rows_of(names, q.fetchall(), sorted(names))
