"""Run logs: windows of steps, skip counters, policy loss, throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_windows(log: DataFrame, every: int) -> DataFrame:
    """Mean loss, example-weighted loss and skips per run of `every` steps."""
    window = F.floor((F.col("step") - 1) / every).alias("window_id")
    return log.groupBy(window).agg(F.count("*").alias("steps"), F.avg("loss").alias("mean_loss"), F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("weighted_loss"), F.count_if("skipped").alias("skipped"))


def without_skipped(log: DataFrame, group: str) -> DataFrame:
    """Groups (micro-batches) in which no row was skipped."""
    any_ = F.bool_or("skipped").over(Window.partitionBy(group))
    return log.withColumn("_any", any_).filter(~F.col("_any")).drop("_any")


def running_means(log: DataFrame, every: int, value: str = "loss") -> DataFrame:
    """Mean of all rows so far at every `every`-th step, from sums per window: windows
    are added up within stretches of 4096, and only one row per stretch is ordered."""
    w = log.groupBy(F.floor((F.col("step") - 1) / every).alias("window_id")).agg(F.sum(value).alias("s"), F.count(value).alias("c")).withColumn("_b", F.floor(F.col("window_id") / 4096))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = w.groupBy("_b").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).select("_b", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_c"))
    upto = Window.partitionBy("_b").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("s", F.sum("s").over(upto)).withColumn("c", F.sum("c").over(upto)).join(starts.hint("shuffle_merge"), "_b")
    return w.select("window_id", (F.col("c") + F.col("_c")).alias("rows_so_far"), ((F.col("s") + F.col("_s")) / (F.col("c") + F.col("_c"))).alias("mean_so_far"))


def policy_loss(tokens: DataFrame, max_len: int, low: float = 0.2, high: float = 0.2, beta: float = 0.0) -> DataFrame:
    """Clipped policy loss over (completion_id, lp, old_lp, ref_lp, mask, advantage),
    normalised by completions times max_len."""
    r = F.exp(F.col("lp") - F.col("old_lp"))
    gain = F.least(r * F.col("advantage"), F.greatest(F.lit(1 - low), F.least(r, F.lit(1 + high))) * F.col("advantage"))
    d = F.col("ref_lp") - F.col("lp")
    drift = F.lit(beta) * (F.exp(d) - d - 1) if beta else F.lit(0.0)
    return tokens.agg((F.sum((drift - gain) * F.col("mask")) / (F.count_distinct("completion_id") * max_len)).alias("loss"), F.sum("mask").cast("bigint").alias("tokens"))


def throughput(rows: DataFrame, by: str, seconds: str, tokens: str) -> DataFrame:
    per = lambda n: F.try_divide(n, F.sum(seconds))
    return rows.groupBy(by).agg(F.count("*").alias("samples"), per(F.count("*")).alias("samples_per_second"), per(F.sum(tokens)).alias("tokens_per_second"))


def status_counts(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.groupBy(status).agg(F.count("*").alias("jobs"))
