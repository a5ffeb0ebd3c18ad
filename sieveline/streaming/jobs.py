"""The log, budget and copy logic on Structured Streaming; each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators import retrieval as ret
from ..session import ship_package


#: Folders that a micro-batch's entries in the ledger of embeddings are dealt into.
LEDGER_BUCKETS = 16


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files as an unbounded table, with the schema of what is there; ``path`` may be a folder or one file of it."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(stream: DataFrame, mode: str, root: str) -> DataFrame:
    """Run until all that is there has been read; the result as a table in the shared folder ``root``, with ``_batch``.

    Every micro-batch writes a folder of its own, which a repeated batch
    replaces. Of a complete result the last batch's rows are returned; of an
    update or append all rows, by which the caller can tell a key's last.
    """
    last = [-1]

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/_batch={number}")
        last[0] = number

    each_batch(stream, work, f"{root}/log", mode)
    spark = stream.sparkSession
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0))
    out = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/_batch={last[0]}" if mode == "complete" else f"{root}/out")
    return out


def latest(out: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of an update result, the last of each key."""
    rest = [c for c in out.columns if c not in (*keys, "_batch")]
    return out.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in rest])


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant: timestamps without zone are read as UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def window_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls by tumbling window and kind; later arrivals than ``late`` are dropped."""
    e = event_time(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "12 hours", late: str = "40 days") -> DataFrame:
    """Runs of a user's calls without a longer gap."""
    e = event_time(events).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def budget(events: DataFrame) -> DataFrame:
    """Durable counters: what each user has spent so far (update or complete mode)."""
    return events.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("used"), F.count("*").alias("calls"))


def first_copies(docs: DataFrame, at: str | None = None, late: str = "1 day") -> DataFrame:
    """The first arrival of each text; state older than the watermark is forgotten.

    Without a column ``at``, the time is that of arrival, so that the watermark
    moves with the stream and a text is held for ``late`` after it came.
    """
    d = docs.withColumn("_at", F.current_timestamp() if at is None else F.col(at).cast("timestamp")).withWatermark("_at", late)
    return d.withColumn("_h", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["_h"]).drop("_h", "_at")


class Breaker(StatefulProcessor):
    """Consecutive failures of one key by the time of its calls, in whatever order these arrive.

    State is the latest success, the failures after it that a late success may
    still cut off, and the number of those that none can: failures behind the
    watermark are only counted. A timer at the last open failure settles keys
    that get no more calls.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "ok_at bigint, ok_id bigint, failures bigint")
        self.open = handle.getListState("open", "at bigint, id bigint")

    def _held(self) -> tuple[tuple[int, int], int, list[tuple[int, int]]]:
        known = self.settled.get()
        ok, failures = ((known[0], known[1]), known[2]) if known is not None else ((-(1 << 62), -(1 << 62)), 0)
        return ok, failures, [(x[0], x[1]) for x in self.open.get()]

    def _keep(self, ok: tuple[int, int], failures: int, open_: list[tuple[int, int]], watermark: int) -> int:
        """Settle what lies behind the watermark (in ms), store the rest, and return the failures in all."""
        rest = [f for f in open_ if f[0] >= watermark * 1000]
        failures += len(open_) - len(rest)
        self.settled.update((*ok, failures))
        self.open.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.open.put(rest)
            self.handle.registerTimer(max(f[0] for f in rest) // 1000 + 1)
        return failures + len(rest)

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timer_values: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        ok, failures, open_ = self._held()
        calls = pd.concat(list(rows))
        each = list(zip(calls["at"].tolist(), calls["event_id"].tolist(), calls["ok"].tolist(), strict=True))
        last = max((c[:2] for c in each if c[2]), default=ok)
        if last > ok:  # what is settled is older than any success that is not too late
            ok, failures = last, 0
        open_ = [f for f in open_ + [c[:2] for c in each if not c[2]] if f > ok]
        n = self._keep(ok, failures, open_, timer_values.getCurrentWatermarkInMs())
        yield pd.DataFrame({"user_id": [key[0]], "failures": [n]})

    def handleExpiredTimer(self, key: tuple, timer_values: TimerValues, expired: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        ok, failures, open_ = self._held()
        self._keep(ok, failures, open_, timer_values.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def breaker(events: DataFrame, late: str = "400 days") -> DataFrame:
    """``user_id, failures``: consecutive failures so far by event time, kept as state by user; calls ``late`` behind the newest are dropped.

    Ties of time go by event id. Files may come in any order.
    """
    spark = events.sparkSession
    ship_package(spark)
    # user-defined state with timers needs this store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    calls = event_time(events).withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return calls.groupBy("user_id").transformWithStateInPandas(Breaker(), "user_id bigint, failures int", "Update", "EventTime")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run ``work`` on every micro-batch until all that is there has been read."""
    q = stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def snapshot_run(stream: DataFrame, by: str, root: str, version: int) -> DataFrame:
    """One run over what has arrived: writes snapshot ``version`` of the counts by ``by``, returns its difference from the one before.

    A snapshot is the one before with the run's counts added; every micro-batch
    writes its counts to a folder of its own, so that a repeated batch counts
    once. ``version, key, before, after`` of the keys that are new or changed.
    """
    spark = stream.sparkSession
    parts = f"{root}/v{version}/parts"

    def work(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{parts}/b{number}")

    each_batch(stream, work, f"{root}/v{version}/log")
    schema = f"key {stream.schema[by].dataType.simpleString()}, n long"
    none = spark.createDataFrame([], schema)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(parts)
    new = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(parts) if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath) else none
    before = spark.read.schema(schema).parquet(f"{root}/v{version - 1}/snapshot") if version else none
    new.unionByName(before).groupBy("key").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{root}/v{version}/snapshot")
    after = spark.read.schema(schema).parquet(f"{root}/v{version}/snapshot")
    diff = after.join(before.withColumnRenamed("n", "before"), "key", "left").where("before is null or before <> n")
    return diff.select(F.lit(version).alias("version"), "key", F.coalesce("before", F.lit(0)).alias("before"), F.col("n").alias("after"))


def embed_stream(docs: DataFrame, held: DataFrame, limit: int, root: str) -> DataFrame:
    """Embeddings of documents (``id, text``) as they arrive, at most ``limit`` a micro-batch, written to ``root``.

    A document that ``held`` or an earlier batch has is passed over; what a
    batch leaves over waits for the next top-up, which reads the table.

    ``root/ledger`` says which ids are done, a folder a micro-batch, beside
    their vectors in ``root/out``. Both are read from the folder, so a restarted
    query goes on where it stopped: a batch that is repeated replaces its own
    folders, and counts only what other batches have written. The ledger is
    dealt by bucket of the id, and a batch reads the buckets that its own ids
    fall in, of all batches: one column of numbers, no vector and no text.
    """
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("id"), F.lit(LEDGER_BUCKETS)).cast("int")

    def work(batch: DataFrame, number: int) -> None:
        ours = batch.withColumn("_bucket", bucket)
        mine = [r[0] for r in ours.select("_bucket").distinct().collect()]  # at most LEDGER_BUCKETS numbers
        seen = _ledger(spark, root, kind).where((F.col("_batch") != number) & F.col("_bucket").isin(mine)).select("id", "_bucket")
        fresh = ours.join(seen, ["_bucket", "id"], "left_anti").drop("_bucket")
        made = ret.hashing_embeddings(ret.top_up(fresh, held, limit))
        made.write.mode("overwrite").parquet(f"{root}/out/b{number}")
        # the vectors are there before the ledger says so
        ids = spark.read.parquet(f"{root}/out/b{number}").select("id", bucket.alias("_bucket"))
        ids.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/ledger/_batch={number}")

    each_batch(docs, work, f"{root}/log")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return ret.hashing_embeddings(spark.createDataFrame([], docs.schema))
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")


def _ledger(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``id, _batch, _bucket`` of what is embedded, by the folder; empty where there is none."""
    schema = f"id {kind}, _batch int, _bucket int"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/ledger").parquet(f"{root}/ledger")
