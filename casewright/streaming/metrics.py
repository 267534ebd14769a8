"""Windowed job metrics; the same transformations serve batch frames and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rates(jobs: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, type, n, failed, error_ratio, mean_duration. late: watermark, for streams."""
    if late:
        jobs = jobs.withWatermark("created_at", late)
    win = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    out = jobs.groupBy(win.alias("w"), "type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("duration"), 6).alias("mean_duration"))
    return out.select(F.col("w.start").alias("window_start"), "type", "n", "failed", F.round(F.col("failed") / F.col("n"), 6).alias("error_ratio"), "mean_duration")


def latency(jobs: DataFrame, last: int = 1000) -> DataFrame:
    """Per type over its last jobs: n, mean, least, greatest, p50, p95, p99 (value at index n * p / 100 from 0)."""
    w = Window.partitionBy("type").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    rows = jobs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= last)
    got = rows.groupBy("type").agg(F.array_sort(F.collect_list("duration")).alias("d"))  # at most `last` values
    at = lambda p: F.element_at("d", (F.floor(F.size("d") * p / 100) + 1).cast("int"))
    return got.select("type", F.size("d").alias("n"), F.array_min("d").alias("least"), F.array_max("d").alias("greatest"), at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))


def success(jobs: DataFrame) -> DataFrame:
    done, bad = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return jobs.groupBy("type").agg(done.alias("completed"), bad.alias("failed"), F.round(F.when(done + bad > 0, done / (done + bad) * 100).otherwise(0.0), 6).alias("rate"))


def buckets(jobs: DataFrame, bounds: tuple[float, ...] = (1.0, 5.0, 10.0, 50.0)) -> DataFrame:
    """Cumulative histogram: type, le, n."""
    rows = jobs.select("type", "duration", F.explode(F.array(*map(F.lit, bounds))).alias("le"))
    return rows.groupBy("type", "le").agg(F.count_if(F.col("duration") <= F.col("le")).alias("n"))
