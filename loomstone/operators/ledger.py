"""Work queue, budgets, dead letters, backfill and readiness as functions over state frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PRIORITY = {"backfill": 0, "steady": 1}


def enqueue(work: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, lane) after an idempotent enqueue: one row a key, a steady request promotes a backfill one and never the reverse."""
    both = work.select(*key, "lane").unionByName(new.select(*key, "lane"))
    rank = F.when(F.col("lane") == "steady", 1).otherwise(0)
    return both.groupBy(*key).agg(F.max_by("lane", rank).alias("lane"))


def backoff(attempts: Column, base: float, most: float) -> Column:
    """Seconds to wait after so many failures: doubling from ``base``, at most ``most``."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(most)))


def after_failure(failed: DataFrame, max_attempts: int, base: float = 5.0, most: float = 3600.0) -> DataFrame:
    """Failed work with its next status and wait: dead once the attempts are used up."""
    n = F.col("attempts") + 1
    return failed.withColumns({"attempts": n, "status": F.when(n >= max_attempts, "dead").otherwise("pending"), "wait_s": F.when(n < max_attempts, backoff(n, base, most))})


def next_work(work: DataFrame, now: Column, max_attempts: int, n: int = 1) -> DataFrame:
    """The next due rows: pending, not before now, attempts left; oldest first."""
    due = work.where((F.col("status") == "pending") & (F.col("attempts") < max_attempts) & (F.col("not_before") <= now))
    return due.orderBy("not_before", "enqueued_at", "work_id").limit(n)


def spend(costs: DataFrame, seconds: int, at: str = "enqueued_at") -> DataFrame:
    """(window_start, lane, spent, n) in windows aligned to the epoch."""
    start = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds) * seconds
    return costs.groupBy(start.cast("long").alias("window_start"), "lane").agg(F.sum(F.col("cost").cast("decimal(12,6)")).alias("spent"), F.count(F.lit(1)).alias("n"))


def parked(costs: DataFrame, seconds: int, budget: float) -> DataFrame:
    """Windows over their budget; work of that lane waits for the next one."""
    return spend(costs, seconds).where(F.col("spent") > budget).withColumn("resume_at", F.col("window_start") + seconds)


def route_status(work: DataFrame) -> DataFrame:
    return work.groupBy("stage", "lane", "status").agg(F.count(F.lit(1)).alias("n"))


def error_class(trace: Column) -> Column:
    """The exception named in the last line of a traceback, else 'unknown'."""
    last = F.element_at(F.split(F.rtrim(trace), "\n"), -1)
    name = F.regexp_extract(last, r"^([A-Za-z_][A-Za-z0-9_.]*)\s*(?::|$)", 1)
    return F.when(name != "", name).otherwise("unknown")


def dead_letters(dead: DataFrame) -> DataFrame:
    """Dead work grouped by stage, error class and version: count, first and last."""
    return dead.groupBy("stage", error_class(F.col("trace")).alias("error"), "version").agg(F.count(F.lit(1)).alias("n"), F.min("enqueued_at").alias("first"), F.max("enqueued_at").alias("last"))


def poison(dead: DataFrame, cap: int = 5) -> DataFrame:
    """(target, n_versions, versions): targets that died under two versions or more, with at most ``cap`` versions shown."""
    per = dead.groupBy("target").agg(F.count_distinct("version").alias("n_versions"), F.sort_array(F.collect_set("version")).alias("v"))
    return per.where("n_versions >= 2").select("target", "n_versions", F.array_join(F.slice("v", 1, cap), ",").alias("versions"))


def backfill(targets: DataFrame, work: DataFrame, version: str) -> DataFrame:
    """(target, prior_version) of targets without work of the wanted version, with the version they last had."""
    w = Window.partitionBy("target").orderBy(F.desc("enqueued_at"), F.desc("work_id"))
    prior = work.withColumn("r", F.row_number().over(w)).where("r = 1").select("target", F.col("version").alias("prior_version"))
    done = work.where(F.col("version") == version).select("target")
    return targets.select("target").distinct().join(done, "target", "left_anti").join(prior, "target", "left")


def drained(work: DataFrame, version: str) -> DataFrame:
    """(pending): work of a version not yet settled; 0 lets the barrier open."""
    return work.where((F.col("version") == version) & ~F.col("status").isin("done", "dead")).agg(F.count(F.lit(1)).alias("pending"))


def readiness(targets: DataFrame, stages: list[str], work: DataFrame) -> DataFrame:
    """(target, stage, status) for every expected stage, 'missing' where none ran; the latest row of a stage counts."""
    last = work.groupBy("target", "stage").agg(F.max_by("status", F.struct("enqueued_at", "work_id")).alias("status"))
    want = targets.select("target").distinct().select("target", F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    return want.join(last, ["target", "stage"], "left").select("target", "stage", F.coalesce("status", F.lit("missing")).alias("status"))


def dispatch(requests: DataFrame, pending: DataFrame) -> DataFrame:
    """One dispatch a subscription, none where one is pending already."""
    return requests.select("subscription").distinct().join(pending.select("subscription"), "subscription", "left_anti")


def review_queue(reviews: DataFrame) -> DataFrame:
    """Open reviews (review_id, status, expected_impact, created_at), those of most impact first, then the oldest."""
    return reviews.where(F.col("status").isin("pending", "deferred")).orderBy(F.desc_nulls_last("expected_impact"), "created_at", "review_id")
