"""Costs, latencies, failures, review and routing policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stage_costs(stages: DataFrame) -> DataFrame:
    """Runs, tokens or cost and duration a stage."""
    return stages.groupBy("stage").agg(F.count("*").alias("n"), F.sum("cost").alias("total_cost"), F.avg("cost").alias("mean_cost"))


def cost_rollup(stages: DataFrame, outer: str, inner: str) -> DataFrame:
    """Costs by outer and inner key, by outer key, and in all."""
    return stages.rollup(outer, inner).agg(F.sum("cost").alias("total_cost"), F.count("*").alias("n"), F.grouping_id().alias("level"))


def latency_percentiles(stages: DataFrame, value: str = "cost", exact: bool = False) -> DataFrame:
    """p50, p95 and p99 a stage, sketched in bounded memory; ``exact`` keeps every distinct value of a stage."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))) if exact else F.approx_percentile(value, [0.5, 0.95, 0.99], 10000)
    return stages.groupBy("stage").agg(p.alias("p")).select("stage", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))


def failure_rates(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(F.count("*").alias("n"), F.avg(F.col("failed").cast("double")).alias("failure_rate"))


def dead_letters(stages: DataFrame, max_attempts: int) -> DataFrame:
    """Units whose last attempt failed with none left."""
    last = stages.groupBy("unit").agg(F.max(F.struct("attempt", "failed", "stage")).alias("l"))
    return last.filter(F.col("l.failed") & (F.col("l.attempt") >= max_attempts)).select("unit", F.col("l.stage").alias("stage"), F.col("l.attempt").alias("attempt"))


def daily_spend(stages: DataFrame, ts: str = "ts") -> DataFrame:
    return stages.groupBy(F.to_date(ts).alias("day")).agg(F.sum("cost").alias("spend"))


def rolling_spend(stages: DataFrame, days: int = 7, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Daily spend and its sum over the last days; days are aggregated first, so windows see one row a day."""
    by = by or []
    daily = stages.groupBy(*by, F.to_date(ts).alias("day")).agg(F.sum("cost").alias("spend"))
    w = Window.partitionBy(*by).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.withColumn("rolling", F.sum("spend").over(w))


def ratio(df: DataFrame, part: str, whole: str, by: list[str], out: str) -> DataFrame:
    """Ratio of sums: prefix-cache hits, prefilter reduction."""
    return df.groupBy(*by).agg((F.sum(part) / F.sum(whole)).alias(out))


def review_metrics(tasks: DataFrame, exact: bool = False) -> DataFrame:
    """Open tasks, median hours to resolve (sketched, unless ``exact``), share corrected, and open ones over 48 hours old, by type."""
    hours = F.when(F.col("status") == "resolved", F.col("hours"))
    return tasks.groupBy("task_type").agg(
        F.count_if(F.col("status") == "open").alias("depth"),
        (F.median(hours) if exact else F.approx_percentile(hours, 0.5, 10000)).alias("median_hours"),
        F.avg(F.when(F.col("status") == "resolved", F.col("corrected").cast("double"))).alias("correction_rate"),
        F.count_if((F.col("status") == "open") & (F.col("hours") > 48)).alias("overdue"),
    )


def outcome_mix(tasks: DataFrame, statuses: list[str]) -> DataFrame:
    return tasks.groupBy("task_type").pivot("status", statuses).agg(F.count(F.lit(1))).na.fill(0)


#: Orders of the review queue: what comes first.
QUEUE_ORDERS = {"priority": lambda: F.desc("priority"), "age": lambda: F.asc("created_at"), "confidence": lambda: F.asc_nulls_first("confidence"), "importance": lambda: F.desc_nulls_last("importance")}


def review_queue(tasks: DataFrame, by: list[str] | None = None, order: str = "priority") -> DataFrame:
    """queue_no: greatest blast radius first (or oldest, least confidence, greatest importance), then oldest."""
    first = QUEUE_ORDERS[order]()
    return tasks.withColumn("queue_no", F.row_number().over(Window.partitionBy(*(by or ["project_id"])).orderBy(first, "created_at", "task_id")))


def policy_at(queries: DataFrame, policies: DataFrame, purpose: str, at: str, unit: str = "day", span: int = 1_000_000) -> DataFrame:
    """Queries with the policy version that held when they came (as-of join).

    Time is cut into units (numbers: into spans), so that a busy purpose is many tasks. A first sweep
    over one row a purpose and unit finds the version in effect when each unit
    begins; the second, within a purpose and unit, carries versions forward to
    the queries. A null time has no version.
    """
    number = dict(queries.dtypes)[at] in ("tinyint", "smallint", "int", "bigint")
    when = lambda: (F.floor(F.col(at) / span) if number else F.date_trunc(unit, F.col(at).cast("timestamp"))).alias("_unit")
    marks = policies.select(F.col(purpose).alias("_purpose"), when(), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.col("version").alias("_version"))
    rows = queries.select(F.col(purpose).alias("_purpose"), when(), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct("*").alias("_row"))
    last = marks.groupBy("_purpose", "_unit").agg(F.max_by("_version", "_at").alias("_version"))
    units = rows.select("_purpose", "_unit").distinct().unionByName(last, allowMissingColumns=True).groupBy("_purpose", "_unit").agg(F.max("_version").alias("_version"))
    earlier = Window.partitionBy("_purpose").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    carried = units.select("_purpose", "_unit", F.lit(-1).alias("_kind"), F.last("_version", ignorenulls=True).over(earlier).alias("_version")).filter("_version is not null")
    w = Window.partitionBy("_purpose", "_unit").orderBy("_kind_first", "_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = marks.unionByName(rows, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True).withColumn("_kind_first", F.col("_kind") >= 0)
    swept = swept.withColumn("policy_version", F.last("_version", ignorenulls=True).over(w)).filter("_kind = 1")
    return swept.select("_row.*", F.when(F.col("_at").isNotNull(), F.col("policy_version")).alias("policy_version"))


def first_resolution(resolutions: DataFrame) -> DataFrame:
    """Of several resolutions of a task the first counts, ties by id: a double click changes nothing."""
    return resolutions.groupBy("task_id").agg(F.min(F.struct("resolved_at", "resolution_id", "outcome")).alias("r")).select("task_id", "r.*")


def stage_status(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """The latest attempt of each stage of a run."""
    return stages.groupBy(run, "stage").agg(F.max(F.struct("attempt", "state", "duration_ms", "error")).alias("s")).select(run, "stage", "s.*")
