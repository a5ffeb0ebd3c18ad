"""Scores of passages against a plain computation; texts are cut into passages once."""

from __future__ import annotations

import math
from collections import Counter

from sieveline.operators import passages as ps


def test_scores_equal_plain_ones_and_come_from_one_stored_table(spark):
    rows = [(1, 0, "red fox runs"), (1, 1, "blue fox"), (1, 2, "—"), (1, 3, "green tea, red cup"), (2, 0, "red"), (3, 0, ""), (4, 0, "tea tea"), (4, 1, "cup"), (4, 2, "pot"), (4, 3, "pan")]
    held = spark.createDataFrame(rows, "id long, passage int, text string")
    out = ps.bm25(held, spark.createDataFrame([(7, "red tea"), (8, "fox a nothing")], "query_id long, text string"))
    want = {}
    for query, terms in ((7, ("red", "tea")), (8, ("fox", "nothing"))):
        for i in {r[0] for r in rows}:
            mine = {p: Counter("".join(c if c.isalnum() else " " for c in t).split()) for j, p, t in rows if j == i}
            avg = sum(sum(c.values()) for c in mine.values()) / len(mine)
            for p, c in mine.items():
                parts = []
                for t in terms:
                    df = sum(t in x for x in mine.values())
                    idf = math.log((len(mine) - df + 0.5) / (df + 0.5))
                    if c[t] and idf > 0:
                        parts.append(idf * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)))
                if parts:
                    want[query, i, p] = round(sum(parts), 6)
    assert want and {(r.query_id, r.id, r.passage): r.score for r in out.collect()} == want
    assert out.inputFiles() and all("/passages-" in f for f in out.inputFiles())
