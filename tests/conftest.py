from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from sieveline.session import ship_package

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(value) -> str:
    """A cell as text, floats to six digits, so that rows of both engines compare."""
    if value is None:
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


def rows_of(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(canonical(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Compare a query with its SQL."""

    def check(query, sql: str) -> int:
        df = query(spark, sf)
        mine, q = df.collect(), duck.execute(sql)
        names = [x[0] for x in q.description]
        order = sorted(df.columns)
        assert sorted(names) == order
        assert rows_of(df.columns, mine, order) == rows_of(names, q.fetchall(), order)
        return len(mine)

    return check
