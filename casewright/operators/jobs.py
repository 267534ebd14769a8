"""Job queues: order, states, dead letters, counters, and the network's totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dequeue_order(jobs: DataFrame, n: int) -> DataFrame:
    """The next n jobs: high priority first, then oldest, then least id."""
    return jobs.orderBy(F.col("priority").desc(), "created_at", "job_id").limit(n)


def counters(jobs: DataFrame) -> DataFrame:
    """dimension (type, priority or all), value, completed, failed, total_duration, in one pass over the jobs."""
    level = F.grouping_id()
    out = jobs.groupingSets([["type"], ["priority"], []], "type", "priority").agg(level.alias("level"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.sum("duration"), 4).alias("total_duration"))
    dimension = F.when(F.col("level") == 1, "type").when(F.col("level") == 2, "priority").otherwise("all")
    return out.select(dimension.alias("dimension"), F.coalesce("type", F.col("priority").cast("string"), F.lit("")).alias("value"), "completed", "failed", "total_duration")


def dead_letters(jobs: DataFrame) -> DataFrame:
    """By type of the failed jobs: n, oldest, newest."""
    return jobs.filter("status = 'failed'").groupBy("type").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def routed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event with each subscription to its type, and with those to all types (empty), by two equi-joins on a key."""
    subs = subscriptions.select("subscriber", F.coalesce("type", F.lit("")).alias("_type"))
    keyed = events.withColumn("_type", F.explode(F.array_distinct(F.array(F.coalesce("type", F.lit("")), F.lit("")))))
    return keyed.join(subs, "_type").drop("_type")


def network_stats(degrees: DataFrame, scores: DataFrame) -> DataFrame:
    """nodes, edges, mean degrees and the node of most influence (then least id)."""
    d = degrees.agg(F.count("*").alias("nodes"), F.sum("outbound").alias("edges"), F.round(F.avg("inbound"), 9).alias("mean_in"), F.round(F.avg("outbound"), 9).alias("mean_out"))
    top = scores.agg(F.min_by("id", F.struct(-F.round("score", 9), F.col("id"))).alias("most_influential"))
    return d.join(top)  # one row each
