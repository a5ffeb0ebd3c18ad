"""Call logs, budgets and stopping rules over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import logs
from .registry import query

_L = f"WITH {b.CALLS_SQL}"
_RECENT = "recent AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, call_id DESC) AS r FROM calls)"
_FAIL = f"{_RECENT}, cf AS (SELECT provider, (coalesce(min(CASE WHEN ok THEN r END), count(*) + 1) - 1)::BIGINT AS failures FROM recent WHERE r <= 20 GROUP BY 1)"
#: Allowance of each kind of resource.
LIMITS = (("signup", 60.0), ("click", 90.0), ("view", 120.0), ("purchase", 45.0))
_LIM = "lim(kind, lim) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in LIMITS) + ")"
_USE = "used AS (SELECT provider, kind, round(sum(amount), 4) AS used, count(*) AS calls FROM calls GROUP BY 1, 2)"


@query("consecutive_failures", f"{_L}, {_FAIL} SELECT provider, failures FROM cf")
def consecutive_failures(spark, d):
    return logs.consecutive_failures(b.calls(spark, d))


@query("circuit_breaker", f"{_L}, {_FAIL} SELECT provider, failures FROM cf WHERE failures >= 2")
def circuit_breaker(spark, d):
    return logs.circuit_breaker(b.calls(spark, d), 2)


@query("failure_count", f"{_L} SELECT provider, count(*) FILTER (NOT ok) AS failed, count(*) AS calls FROM calls GROUP BY 1")
def failure_count(spark, d):
    return b.calls(spark, d).groupBy("provider").agg(F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("calls"))


@query("recent_window", f"{_L}, {_RECENT} SELECT provider, count(*) AS calls, round(avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END), 4) AS failing, round(avg(CASE WHEN ok AND k = 0 THEN 1.0 ELSE 0.0 END), 4) AS barren FROM recent WHERE r <= 4 GROUP BY 1")
def recent_window(spark, d):
    return logs.recent_window(b.calls(spark, d))


@query("budget_usage", f"{_L}, {_USE} SELECT provider, kind, round(used, 2) AS used, calls FROM used")
def budget_usage(spark, d):
    return logs.budget_usage(b.calls(spark, d)).withColumn("used", F.round("used", 2))


@query("budget_snapshot", f"""{_L}, {_USE}, {_LIM} SELECT provider, u.kind, round(used, 2) AS used, lim AS "limit", round(greatest(lim - used, 0), 2) AS remaining, CASE WHEN lim IS NULL THEN 'unlimited' WHEN used >= lim THEN 'exhausted' WHEN used >= 0.85 * lim THEN 'near' ELSE 'open' END AS state FROM used u LEFT JOIN lim ON lim.kind = u.kind""")
def budget_snapshot(spark, d):
    limits = spark.createDataFrame(LIMITS, "kind string, `limit` double")
    s = logs.budget_snapshot(logs.budget_usage(b.calls(spark, d)), limits)
    return s.withColumn("used", F.round("used", 2)).withColumn("remaining", F.round("remaining", 2))


@query("budget_gate", f"{_L}, g AS (SELECT call_id, provider, round(sum(amount) OVER (PARTITION BY provider ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING), 4) AS spent FROM calls) SELECT provider, count(*) FILTER (spent <= 200) AS allowed, count(*) FILTER (spent > 200) AS refused FROM g GROUP BY 1")
def budget_gate(spark, d):
    g = logs.budget_gate(b.calls(spark, d), 200.0)
    return g.groupBy("provider").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


@query("charge_model", f"{_L} SELECT provider, round(sum(coalesce(CASE kind WHEN 'view' THEN 0.4 WHEN 'click' THEN 1.2 END, 0) * k) / 1e6, 8) AS cost, sum(k)::BIGINT AS tokens FROM calls GROUP BY 1")
def charge_model(spark, d):
    price = F.when(F.col("kind") == "view", 0.4).when(F.col("kind") == "click", 1.2).otherwise(0.0)
    return b.calls(spark, d).groupBy("provider").agg(F.round(F.sum(price * F.col("k")) / 1e6, 8).alias("cost"), F.sum("k").alias("tokens"))


_STATE = f"""{_L}, {_RECENT}, {_USE}, w AS (SELECT provider, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS failing, avg(CASE WHEN ok AND k = 0 THEN 1.0 ELSE 0.0 END) AS barren, count(*) AS win FROM recent WHERE r <= 4 GROUP BY 1),
a AS (SELECT provider, sum(amount) > 5000 AS exhausted, date_diff('minute', min(ts), max(ts)) / 1000.0 AS minutes, count(*) FILTER (kind = 'signup') AS open_tasks, count(*) AS documents, count(DISTINCT k) AS originals, count(*) FILTER (kind = 'view') AS claims, count(*) FILTER (kind = 'purchase') AS gaps FROM calls GROUP BY 1)
SELECT provider, CASE WHEN exhausted THEN 'budget' WHEN minutes >= 60 THEN 'runtime' WHEN open_tasks = 0 THEN 'no_open_tasks' WHEN win >= 4 AND failing >= 0.75 THEN 'sources_unavailable'
WHEN (documents >= 10 AND originals < 0.4 * documents) OR (win >= 4 AND barren >= 0.75) THEN 'diminishing_returns' WHEN claims >= 2 AND gaps = 0 THEN 'sufficient' END AS stop FROM a JOIN w USING (provider)"""


@query("stop_rules", _STATE)
def stop_rules(spark, d):
    c = b.calls(spark, d)
    minutes = F.floor((F.unix_micros(F.date_trunc("minute", F.max("ts"))) - F.unix_micros(F.date_trunc("minute", F.min("ts")))) / 60e6) / 1000.0
    a = c.groupBy("provider").agg(
        (F.sum("amount") > 5000).alias("exhausted"), minutes.alias("minutes"), F.count_if(F.col("kind") == "signup").alias("open_tasks"), F.count("*").alias("documents"),
        F.count_distinct("k").alias("originals"), F.count_if(F.col("kind") == "view").alias("claims"), F.count_if(F.col("kind") == "purchase").alias("gaps"),
    )
    w = logs.recent_window(c).select("provider", "failing", "barren", F.col("calls").alias("window"))
    return logs.stop_rules(a.join(w, "provider")).select("provider", "stop")


@query("dup_objective", r"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) ORDER BY conv_id, turn) AS r FROM conversations WHERE role = 'user') WHERE r = 1")
def dup_objective(spark, d):
    c = b.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("key"))
    return c.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("m")).select("m.conv_id", "m.turn")


@query("followup_bound", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') WHERE r <= 3")
def followup_bound(spark, d):
    from ..operators.relational import top_per_group

    return top_per_group(b.table(spark, d, "conversations").where("role = 'assistant'"), ["conv_id"], [F.col("turn")], 3).select("conv_id", "turn")


@query("planner_validation", "SELECT event_id, least(greatest(user_id % 15, 1), 9)::BIGINT AS priority, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS role FROM events WHERE event_type <> 'error'")
def planner_validation(spark, d):
    e = b.table(spark, d, "events").where("event_type <> 'error'")
    return e.select("event_id", F.least(F.greatest(F.col("user_id") % 15, F.lit(1)), F.lit(9)).cast("bigint").alias("priority"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("other").alias("role"))


@query("cache_key", f"{_L} SELECT call_id, md5(concat_ws('|', kind, provider, coalesce(k, 0))) AS key FROM calls")
def cache_key(spark, d):
    return b.calls(spark, d).select("call_id", F.md5(F.concat_ws("|", "kind", F.col("provider").cast("string"), F.coalesce("k", F.lit(0)).cast("string"))).alias("key"))


@query("worker_result", "SELECT user_id AS worker, count(DISTINCT event_type) - count(DISTINCT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN event_type END) AS new_kinds FROM events GROUP BY 1")
def worker_result(spark, d):
    e = b.table(spark, d, "events").withColumn("old", F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    g = e.groupBy(F.col("user_id").alias("worker")).agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("old"), F.col("event_type"))).alias("o"))
    return g.select("worker", F.size(F.array_except("a", "o")).cast("bigint").alias("new_kinds"))
