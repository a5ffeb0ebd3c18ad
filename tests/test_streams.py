"""Streams that are restarted, repeated and fed out of order."""

from __future__ import annotations

import os
import random
import shutil
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sieveline.operators import retrieval as ret
from sieveline.streaming import jobs


def put(spark, df, folder, name, when):
    """One parquet file, whose time says in which order the stream takes it."""
    tmp = f"{folder}-{name}"
    df.coalesce(1).write.mode("overwrite").parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
    shutil.move(f"{tmp}/{part}", f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (when, when))


EVENTS = "event_id long, user_id long, ts timestamp_ntz, event_type string"


def calls(n=240):
    rnd = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(i, rnd.randrange(6), start + timedelta(hours=rnd.randrange(400)), "error" if rnd.random() < 0.6 else "ok") for i in range(n)]
    rows += [(1000 + i, 7, start + timedelta(hours=5), "error") for i in range(4)] + [(1002, 8, start, "ok"), (1001, 8, start, "error"), (1003, 8, start, "error")]
    return rows


def brute(rows):
    out = {}
    for user in {r[1] for r in rows}:
        n = 0
        for _, _, _, kind in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            n = n + 1 if kind == "error" else 0
        out[user] = n
    return out


def run_breaker(spark, folder, root, late="400 days"):
    out = jobs.run_available(jobs.breaker(jobs.read_stream(spark, folder, files_per_trigger=1), late), "update", root)
    return {r.user_id: r.failures for r in jobs.latest(out, "user_id").collect()}


def test_breaker_of_files_in_reverse_order(spark, tmp_path):
    rows = sorted(calls(), key=lambda r: r[2])
    for k in range(4):
        put(spark, spark.createDataFrame(rows[k::4] if k % 2 else rows[60 * k : 60 * k + 60], EVENTS), f"{tmp_path}/mixed", f"f{k}", 1_000_000 + k)
    mixed = [r for k in range(4) for r in (rows[k::4] if k % 2 else rows[60 * k : 60 * k + 60])]
    # a repeated call counts where it stands: as often as it came
    assert run_breaker(spark, f"{tmp_path}/mixed", f"file://{tmp_path}/run0") == brute(mixed)
    chunks = [rows[i : i + 62] for i in range(0, len(rows), 62)]
    for k, chunk in enumerate(reversed(chunks)):
        put(spark, spark.createDataFrame(chunk, EVENTS), f"{tmp_path}/reversed", f"f{k}", 1_000_000 + k)
    assert run_breaker(spark, f"{tmp_path}/reversed", f"file://{tmp_path}/run1") == brute(rows)


def test_breaker_settles_behind_the_watermark(spark, tmp_path):
    """Failures that no late success can cut off are a number; a restart goes on with them."""
    start = datetime(2024, 1, 1)
    for k in range(4):
        rows = [(100 * k + i, 1, start + timedelta(days=k, minutes=i), "error") for i in range(20)]
        put(spark, spark.createDataFrame(rows, EVENTS), f"{tmp_path}/in", f"f{k}", 1_000_000 + k)
    root = f"file://{tmp_path}/run"
    assert run_breaker(spark, f"{tmp_path}/in", root, "1 hour") == {1: 80}
    put(spark, spark.createDataFrame([(900, 1, start + timedelta(days=9), "ok"), (901, 1, start + timedelta(days=9, hours=1), "error")], EVENTS), f"{tmp_path}/in", "f9", 1_000_009)
    assert run_breaker(spark, f"{tmp_path}/in", root, "1 hour") == {1: 1}


DOCS = "id long, text string"


def docs(a, b):
    return [(i, f"text number {i} " * (i % 5)) for i in range(a, b)]


def test_top_up_is_restarted_and_repeated(spark, tmp_path):
    folder, root = f"{tmp_path}/docs", f"{tmp_path}/run"
    held = spark.createDataFrame([(i,) for i in range(0, 100, 10)], "id long")
    stream = lambda: jobs.read_stream(spark, folder, files_per_trigger=1)
    ids = lambda df: Counter(r.id for r in df.collect())
    for k in range(3):
        put(spark, spark.createDataFrame(docs(20 * k, 20 * k + 30), DOCS), folder, f"f{k}", 1_000_000 + k)  # files overlap
    got = ids(jobs.embed_stream(stream(), held, 100, f"file://{root}"))
    want = {i for i in range(70) if i % 10}
    assert got == Counter(want)
    # a restart with a new file, most of which is embedded already
    put(spark, spark.createDataFrame(docs(40, 90), DOCS), folder, "f3", 1_000_003)
    got = ids(jobs.embed_stream(stream(), held, 100, f"file://{root}"))
    assert got == Counter(i for i in range(90) if i % 10)
    # the last batch was written, but the query ended before it was committed: it is repeated
    commits = sorted((f for f in os.listdir(f"{root}/log/commits") if f.isdigit()), key=int)
    os.remove(f"{root}/log/commits/{commits[-1]}")
    if os.path.exists(crc := f"{root}/log/commits/.{commits[-1]}.crc"):
        os.remove(crc)
    assert ids(jobs.embed_stream(stream(), held, 100, f"file://{root}")) == Counter(i for i in range(90) if i % 10)


def test_top_up_keeps_to_its_limit(spark, tmp_path):
    folder = f"{tmp_path}/docs"
    for k in range(2):
        put(spark, spark.createDataFrame(docs(50 * k, 50 * k + 50), DOCS), folder, f"f{k}", 1_000_000 + k)
    none = spark.createDataFrame([], "id long")
    out = jobs.embed_stream(jobs.read_stream(spark, folder, files_per_trigger=1), none, 7, f"file://{tmp_path}/run")
    assert sorted(r.id for r in out.collect()) == [*range(7), *range(50, 57)]
    same = ret.hashing_embeddings(spark.createDataFrame(docs(0, 7), DOCS)).select("id", F.round("norm", 6).alias("n"))
    assert {(r.id, r.n) for r in same.collect()} == {(r.id, r.n) for r in out.where("id < 7").select("id", F.round("norm", 6).alias("n")).collect()}


def test_top_up_query_takes_the_first_of_all_batches(spark, tmp_path):
    """A table in more files than a micro-batch reads: the first documents of the whole table, not of each batch."""
    from sieveline.plans import QUERIES
    from sieveline.plans.stream_plans import TOP_UP

    for k in range(6):  # the files that come first hold the last ids
        put(spark, spark.createDataFrame([(i, t) for i, t in docs(500 - 100 * k, 600 - 100 * k)], "doc_id long, text string"), f"{tmp_path}/documents.parquet", f"f{k}", 1_000_000 + k)
    spark.createDataFrame([(i,) for i in range(0, 600, 10)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(r.id for r in QUERIES["stream_topup"](spark, str(tmp_path)).collect())
    assert got == [i for i in range(600) if i % 10][:TOP_UP]
