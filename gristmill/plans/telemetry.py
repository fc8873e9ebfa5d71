"""Telemetry queries over ``events``, ``conversations``, ``labels`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as ops
from ..sources.tables import table
from .views import CHATS_SQL, EVALS_SQL, METRICS_SQL, NOW, chats, evaluations, metrics

HOURS = 24 * 30
STAGES = ["router_ms", "generation_ms", "total_ms"]


def recent(spark, sf_dir):
    return ops.since(metrics(spark, sf_dir), NOW, HOURS)


def summary_totals(spark, sf_dir):
    return ops.totals(recent(spark, sf_dir))


def stage_stats(spark, sf_dir):
    return ops.stage_stats(recent(spark, sf_dir), STAGES)


def router_distribution(spark, sf_dir):
    return ops.source_distribution(recent(spark, sf_dir))


def slowest_requests(spark, sf_dir):
    return ops.slowest(recent(spark, sf_dir)).select("id", "user_id", "total_ms")


def recent_failures(spark, sf_dir):
    return ops.failures(recent(spark, sf_dir)).select("id", "timed_out", "error", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def admin_overview_counts(spark, sf_dir):
    talk, orders = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "orders")
    counts = [
        talk.agg(F.count(F.lit(1)).alias("v")).select(F.lit("messages").alias("counter"), "v"),
        talk.agg(F.countDistinct("conv_id").alias("v")).select(F.lit("chats"), "v"),
        talk.agg(F.countDistinct(F.col("conv_id") % 97).alias("v")).select(F.lit("users"), "v"),
        orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("v")).select(F.lit("pending_reminders"), "v"),
        orders.agg(F.count_if(~(F.col("o_orderpriority") == "1-URGENT")).alias("v")).select(F.lit("unread_notifications"), "v"),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def users_by_activity(spark, sf_dir):
    return ops.users_by_activity(table(spark, sf_dir, "events"), "user_id", "ts").withColumn("last_active", F.date_format("last_active", "yyyy-MM-dd HH:mm:ss"))


def eval_summary(spark, sf_dir):
    return ops.stage_stats(evaluations(spark, sf_dir), ["faithfulness", "answer_relevancy"], ts="id", key="id", digits=3, low=True, rounded=True)


def worst_samples(spark, sf_dir):
    rows = ops.without_nan(evaluations(spark, sf_dir), ["faithfulness", "answer_relevancy"])
    return rows.filter("faithfulness is not null").orderBy("faithfulness", "id").limit(10).select("id", "faithfulness", "answer_relevancy")


def eval_batch_mean(spark, sf_dir):
    return ops.batch_means(evaluations(spark, sf_dir), ["faithfulness", "answer_relevancy"])


def eval_sample_detail(spark, sf_dir):
    return ops.sample_detail(evaluations(spark, sf_dir), metrics(spark, sf_dir))


def eval_sample_pick(spark, sf_dir):
    candidates = ops.evaluation_candidates(recent(spark, sf_dir), "qdrant")
    return ops.pick_sample(candidates, 100, "id").select("id")


def chats_pinned_order(spark, sf_dir):
    ordered = chats(spark, sf_dir).orderBy(F.desc("pinned"), F.desc("updated_seq"), "chat_id").limit(100)
    return ordered.select("chat_id", "title", "pinned", "updated_seq")


def chats_page(spark, sf_dir):
    return chats(spark, sf_dir).orderBy(F.desc("updated_seq"), "chat_id").offset(20).limit(20).select("chat_id", "title")


def activity_bars(spark, sf_dir):
    return ops.normalised_bars(ops.source_distribution(recent(spark, sf_dir)), "source", "n")


def pulse_severity(spark, sf_dir):
    return ops.pulse(ops.totals(recent(spark, sf_dir)))


QUERIES = {
    "pipeline_summary_totals": summary_totals,
    "pipeline_stage_stats": stage_stats,
    "router_distribution": router_distribution,
    "slowest_requests": slowest_requests,
    "recent_failures": recent_failures,
    "admin_overview_counts": admin_overview_counts,
    "users_by_activity": users_by_activity,
    "eval_summary": eval_summary,
    "worst_samples": worst_samples,
    "eval_batch_mean": eval_batch_mean,
    "eval_sample_detail": eval_sample_detail,
    "eval_sample_pick": eval_sample_pick,
    "chats_pinned_order": chats_pinned_order,
    "chats_page": chats_page,
    "activity_bars": activity_bars,
    "pulse_severity": pulse_severity,
}

_RECENT = f"{METRICS_SQL}, recent AS (SELECT * FROM metrics WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR)"
_TOTALS = """w AS (
  SELECT count(*) AS requests, count(*) FILTER (timed_out) AS timeouts,
    count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (reranker_fallback) AS fallbacks FROM recent),
totals AS (SELECT *, CASE WHEN requests = 0 THEN 0.0 ELSE round_even(timeouts / requests, 4) END AS timeout_rate,
  CASE WHEN requests = 0 THEN 0.0 ELSE round_even(errors / requests, 4) END AS error_rate,
  CASE WHEN requests = 0 THEN 0.0 ELSE round_even(fallbacks / requests, 4) END AS fallback_rate FROM w)"""
_DISTRIBUTION = "dist AS (SELECT source, count(*) AS n FROM (SELECT unnest(sources) AS source FROM recent) GROUP BY source ORDER BY n DESC, source LIMIT 20)"

ORACLE = {
    "pipeline_summary_totals": f"WITH {_RECENT}, {_TOTALS} SELECT * FROM totals",
    "pipeline_stage_stats": f"""
WITH {_RECENT}, long AS (
  SELECT 'router_ms' AS stage, router_ms AS ms, created_at, id FROM recent
  UNION ALL SELECT 'total_ms', total_ms, created_at, id FROM recent),
latest AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY created_at DESC, id DESC) AS rn FROM long WHERE ms IS NOT NULL),
v AS (SELECT stage, list_sort(list(ms)) AS v FROM latest WHERE rn <= 2000 GROUP BY stage),
names AS (SELECT unnest(['router_ms', 'generation_ms', 'total_ms']) AS stage)
SELECT stage, round_even(list_sum(v) / len(v), 0) AS avg_ms,
  v[CAST(least(floor(len(v) * 0.95), len(v) - 1) AS BIGINT) + 1] AS p95_ms, v[len(v)] AS max_ms, CAST(coalesce(len(v), 0) AS BIGINT) AS n
FROM names LEFT JOIN v USING (stage)""",
    "router_distribution": f"WITH {_RECENT}, {_DISTRIBUTION} SELECT * FROM dist",
    "slowest_requests": f"WITH {_RECENT} SELECT id, user_id, total_ms FROM recent WHERE total_ms IS NOT NULL ORDER BY total_ms DESC, id LIMIT 10",
    "recent_failures": f"""WITH {_RECENT} SELECT id, timed_out, error, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM recent WHERE timed_out OR error IS NOT NULL ORDER BY recent.created_at DESC, id DESC LIMIT 20""",
    "admin_overview_counts": """
SELECT 'messages' AS counter, count(*) AS v FROM conversations
UNION ALL SELECT 'chats', count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'users', count(DISTINCT conv_id % 97) FROM conversations
UNION ALL SELECT 'pending_reminders', count(*) FILTER (o_orderstatus = 'O') FROM orders
UNION ALL SELECT 'unread_notifications', count(*) FILTER (o_orderpriority <> '1-URGENT') FROM orders""",
    "users_by_activity": """SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_active FROM events
GROUP BY user_id ORDER BY n DESC, user_id LIMIT 500""",
    "eval_summary": f"""
WITH {EVALS_SQL}, long AS (
  SELECT 'faithfulness' AS stage, faithfulness AS x, id FROM evals UNION ALL SELECT 'answer_relevancy', answer_relevancy, id FROM evals),
latest AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY id DESC) AS rn FROM long WHERE x IS NOT NULL AND NOT isnan(x)),
v AS (SELECT stage, list_sort(list(x)) AS v FROM latest WHERE rn <= 2000 GROUP BY stage)
SELECT stage, round_even(list_reduce(list_prepend(CAST(0 AS DOUBLE), v), lambda a, b: a + b) / len(v), 3) AS avg_ms,
  round_even(v[CAST(least(floor(len(v) * 0.95), len(v) - 1) AS BIGINT) + 1], 3) AS p95_ms,
  round_even(v[CAST(least(floor(len(v) * 0.05), len(v) - 1) AS BIGINT) + 1], 3) AS p5_ms,
  round_even(v[1], 3) AS min_ms, CAST(len(v) AS BIGINT) AS n
FROM v""",
    "worst_samples": f"""WITH {EVALS_SQL} SELECT id, faithfulness, CASE WHEN isnan(answer_relevancy) THEN NULL ELSE answer_relevancy END AS answer_relevancy
FROM evals WHERE NOT isnan(faithfulness) ORDER BY faithfulness, id LIMIT 10""",
    "eval_batch_mean": f"""WITH {EVALS_SQL}, l AS (
SELECT list_sort(list(faithfulness) FILTER (NOT isnan(faithfulness))) AS f, list_sort(list(answer_relevancy) FILTER (NOT isnan(answer_relevancy))) AS a FROM evals)
SELECT round_even(list_reduce(list_prepend(CAST(0 AS DOUBLE), f), lambda x, y: x + y) / len(f), 3) AS faithfulness,
  round_even(list_reduce(list_prepend(CAST(0 AS DOUBLE), a), lambda x, y: x + y) / len(a), 3) AS answer_relevancy FROM l""",
    "eval_sample_detail": f"""WITH {METRICS_SQL}, {EVALS_SQL}
SELECT e.id, m.id IS NOT NULL AS found, coalesce(e.query, m.user_id) AS query, coalesce(m.sources, CAST([] AS VARCHAR[])) AS contexts
FROM evals e LEFT JOIN metrics m ON e.metrics_id = m.id""",
    "eval_sample_pick": f"""WITH {_RECENT}
SELECT id FROM recent WHERE list_contains(sources, 'qdrant') AND len(sources) > 0 AND error IS NULL ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 100""",
    "chats_pinned_order": f"WITH {CHATS_SQL} SELECT chat_id, title, pinned, updated_seq FROM chats ORDER BY pinned DESC, updated_seq DESC, chat_id LIMIT 100",
    "chats_page": f"WITH {CHATS_SQL} SELECT chat_id, title FROM chats ORDER BY updated_seq DESC, chat_id LIMIT 20 OFFSET 20",
    "activity_bars": f"WITH {_RECENT}, {_DISTRIBUTION} SELECT source, least(100.0, n / greatest(1, max(n) OVER ()) * 100) AS percent FROM dist",
    "pulse_severity": f"""WITH {_RECENT}, {_TOTALS}, s AS (SELECT least(1.0, (error_rate + timeout_rate) * 4) AS severity FROM totals)
SELECT severity, CASE WHEN severity > 0.5 THEN 'critical' WHEN severity > 0.15 THEN 'degraded' ELSE 'healthy' END AS band FROM s""",
}
