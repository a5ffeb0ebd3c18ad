"""Rules over append-only logs: failures, budgets, stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consecutive_failures(calls: DataFrame, depth: int = 20) -> DataFrame:
    """``provider, failures``: calls since the last that was ok, among each provider's latest ``depth``."""
    w = Window.partitionBy("provider").orderBy(F.desc("ts"), F.desc("call_id"))
    recent = calls.withColumn("r", F.row_number().over(w)).where(F.col("r") <= depth)
    return recent.groupBy("provider").agg((F.coalesce(F.min(F.when(F.col("ok"), F.col("r"))), F.count("*") + 1) - 1).alias("failures"))


def circuit_breaker(calls: DataFrame, threshold: int = 3) -> DataFrame:
    """Providers that are skipped."""
    return consecutive_failures(calls).where(F.col("failures") >= threshold)


def recent_window(calls: DataFrame, size: int = 4) -> DataFrame:
    """``provider, calls, failing, barren``: shares of the latest ``size`` calls that failed, or were ok and found nothing."""
    w = Window.partitionBy("provider").orderBy(F.desc("ts"), F.desc("call_id"))
    last = calls.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)
    return last.groupBy("provider").agg(F.count("*").alias("calls"), F.round(F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)), 4).alias("failing"), F.round(F.avg(F.when(F.col("ok") & (F.col("k") == 0), 1.0).otherwise(0.0)), 4).alias("barren"))


def budget_usage(calls: DataFrame) -> DataFrame:
    """``provider, kind, used, calls``: the durable counters, as sums of the spend log."""
    return calls.groupBy("provider", "kind").agg(F.round(F.sum("amount"), 4).alias("used"), F.count("*").alias("calls"))


def budget_snapshot(usage: DataFrame, limits: DataFrame, near: float = 0.85) -> DataFrame:
    """``provider, kind, used, limit, remaining, state``; ``limits``: ``kind, limit``, one row for each kind of resource."""
    j = usage.join(F.broadcast(limits), "kind", "left")
    state = F.when(F.col("limit").isNull(), "unlimited").when(F.col("used") >= F.col("limit"), "exhausted").when(F.col("used") >= near * F.col("limit"), "near").otherwise("open")
    return j.select("provider", "kind", "used", "limit", F.round(F.greatest(F.col("limit") - F.col("used"), F.lit(0.0)), 4).alias("remaining"), state.alias("state"))


def budget_gate(calls: DataFrame, limit: float) -> DataFrame:
    """Calls in order, each with what its provider had spent up to it, and whether it fits the allowance.

    Days are summed first and their sums run on by provider; the calls
    themselves are ordered within a day only, so no task holds a provider's history.
    """
    run = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = calls.withColumn("_day", F.to_date("ts"))
    days = dated.groupBy("provider", "_day").agg(F.sum("amount").alias("_sum"))
    days = days.select("provider", "_day", (F.sum("_sum").over(run("provider").orderBy("_day")) - F.col("_sum")).alias("_before"))
    spent = F.round(F.col("_before") + F.sum("amount").over(run("provider", "_day").orderBy("ts", "call_id")), 4)
    return dated.join(days, ["provider", "_day"]).withColumn("spent", spent).withColumn("allowed", F.col("spent") <= limit).drop("_day", "_before")


def stop_rules(state: DataFrame) -> DataFrame:
    """Adds ``stop``: the first rule that holds, in order; null to go on.

    ``state``: exhausted, minutes, open_tasks, failing, barren, window, documents, originals, claims, gaps.
    """
    thin = (F.col("documents") >= 10) & (F.col("originals") < 0.4 * F.col("documents"))
    full = F.col("window") >= 4
    return state.withColumn(
        "stop",
        F.when(F.col("exhausted"), "budget").when(F.col("minutes") >= 60, "runtime").when(F.col("open_tasks") == 0, "no_open_tasks")
        .when(full & (F.col("failing") >= 0.75), "sources_unavailable").when(thin | (full & (F.col("barren") >= 0.75)), "diminishing_returns")
        .when((F.col("claims") >= 2) & (F.col("gaps") == 0), "sufficient"),
    )
