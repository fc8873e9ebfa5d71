"""Operational telemetry over request logs: totals, rates, stage statistics, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_ROWS = 2000


def since(metrics: DataFrame, now: str, hours: int, ts: str = "created_at") -> DataFrame:
    """Rows of the last ``hours`` before the explicit ``now`` (inclusive lower bound)."""
    start = F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours))
    return metrics.filter(F.col(ts) >= start)


def rate(part: Column, total: Column) -> Column:
    """Share rounded half-even to 4 places; 0 for an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(part / total, 4))


def totals(metrics: DataFrame) -> DataFrame:
    """Requests, timeouts, errors and fallbacks in one pass, with their rates."""
    counted = metrics.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("timed_out")).alias("timeouts"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("reranker_fallback")).alias("fallbacks"),
    )
    return counted.select(
        "*",
        *(rate(F.col(c), F.col("requests")).alias(f"{c[:-1]}_rate") for c in ("timeouts", "errors", "fallbacks")),
    )


def array_percentile(ordered: Column, p: float) -> Column:
    """Order statistic at index min(floor(n*p), n-1) of an ascending array."""
    n = F.size(ordered)
    return F.element_at(ordered, F.least(F.floor(n * F.lit(p)).cast("int"), n - 1) + 1)


def stage_stats(metrics: DataFrame, stages: list[str], ts: str = "created_at", key: str = "id", window: int = WINDOW_ROWS, digits: int = 0, low: bool = False, rounded: bool = False) -> DataFrame:
    """Average, p95 (p5 too with ``low``), extremes and count of each stage's latest ``window`` non-null values.

    One unpivot and one top-k window; a stage with no value gives nulls and count 0.
    """
    long = metrics.select(F.col(ts).alias("__ts"), F.col(key).alias("__key"), *stages).unpivot(["__ts", "__key"], stages, "stage", "ms")
    long = long.filter(F.col("ms").isNotNull() & ~F.isnan(F.col("ms").cast("double")))
    latest = Window.partitionBy("stage").orderBy(F.col("__ts").desc(), F.col("__key").desc())
    kept = long.withColumn("rn", F.row_number().over(latest)).filter(F.col("rn") <= window)
    stats = kept.groupBy("stage").agg(F.sort_array(F.collect_list("ms")).alias("v"))
    names = metrics.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    value = F.col("v")
    mean = F.aggregate(value, F.lit(0.0), lambda a, x: a + x) / F.size(value)
    shown = (lambda c: F.bround(c, digits)) if rounded else (lambda c: c)
    out = [F.bround(mean, digits).alias("avg_ms"), shown(array_percentile(value, 0.95)).alias("p95_ms")]
    if low:
        out += [shown(array_percentile(value, 0.05)).alias("p5_ms"), shown(F.array_min(value)).alias("min_ms")]
    else:
        out += [F.array_max(value).alias("max_ms")]
    return names.join(stats, "stage", "left").select("stage", *out, F.coalesce(F.size(value), F.lit(0)).cast("bigint").alias("n"))


def source_distribution(metrics: DataFrame, limit: int = 20) -> DataFrame:
    """How often each routing source was chosen; ties by name."""
    return (
        metrics.select(F.explode("sources").alias("source"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "source")
        .limit(limit)
    )


def slowest(metrics: DataFrame, limit: int = 10) -> DataFrame:
    return metrics.filter(F.col("total_ms").isNotNull()).orderBy(F.desc("total_ms"), "id").limit(limit)


def failures(metrics: DataFrame, limit: int = 20) -> DataFrame:
    bad = F.col("timed_out") | F.col("error").isNotNull()
    return metrics.filter(bad).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def users_by_activity(rows: DataFrame, user: str, ts: str, limit: int = 500) -> DataFrame:
    """Rows and latest activity of each user, busiest first."""
    return rows.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_active")).orderBy(F.desc("n"), user).limit(limit)


def without_nan(rows: DataFrame, columns: list[str]) -> DataFrame:
    """NaN scores read as missing."""
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def batch_means(rows: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Mean of each score column without NaN; sums are decimals, so that the result doesn't depend on partitioning."""
    exact = [F.sum(F.col(c).cast("decimal(28,15)")).cast("double") for c in columns]
    return without_nan(rows, columns).agg(*(F.bround(total / F.count(c), digits).alias(c) for total, c in zip(exact, columns, strict=True)))


def silent(samples: Column, least: float = 200.0) -> Column:
    """Mean absolute amplitude below ``least``; nothing is silent."""
    return F.coalesce(F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) / F.nullif(F.size(samples), F.lit(0)) < least, F.lit(True))


def root_mean_square(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.nullif(F.size(samples), F.lit(0)))


def sample_detail(evals: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each evaluation with its telemetry row: found flag, query from either side, contexts empty where missing."""
    m = metrics.select(F.col("id").alias("m_id"), "user_id", "sources")
    joined = evals.join(m, F.col("metrics_id") == F.col("m_id"), "left")
    return joined.select(
        "id", F.col("m_id").isNotNull().alias("found"), F.coalesce("query", "user_id").alias("query"), F.coalesce("sources", F.array().cast("array<string>")).alias("contexts")
    )


def evaluation_candidates(metrics: DataFrame, source: str) -> DataFrame:
    """Rows answered from ``source``, with contexts and without an error."""
    return metrics.filter(F.array_contains("sources", source) & (F.size("sources") > 0) & F.col("error").isNull())


def pick_sample(rows: DataFrame, n: int, key: str) -> DataFrame:
    """``n`` rows in the order of the key's MD5: random-looking, repeatable, without replacement."""
    return rows.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def normalised_bars(counts: DataFrame, name: str, value: str) -> DataFrame:
    """Each count as per cent of the largest."""
    top = counts.agg(F.greatest(F.lit(1), F.max(value)).alias("top"))
    return counts.crossJoin(F.broadcast(top)).select(name, F.least(F.lit(100.0), F.col(value) / F.col("top") * 100).alias("percent"))


def pulse(totals_row: DataFrame) -> DataFrame:
    """Severity min(1, 4 * (errors + timeouts)) and its band."""
    s = F.least(F.lit(1.0), (F.col("error_rate") + F.col("timeout_rate")) * 4)
    return totals_row.select(s.alias("severity")).withColumn("band", F.when(F.col("severity") > 0.5, "critical").when(F.col("severity") > 0.15, "degraded").otherwise("healthy"))
