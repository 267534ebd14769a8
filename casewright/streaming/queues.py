"""Queues, delivery and limits as folds over ordered events: one expression a key in batch, one state a key in streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS = 3


def _folded(events: DataFrame, key: str, order: list[str], fields: list[str], zero: Column, step: Callable) -> DataFrame:
    """key, state: the fold over a key's events in order. A key's events are one array: they must fit a row."""
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("events"))
    return rows.select(key, F.aggregate("events", zero, step).alias("state"))


def job_states(events: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """events (job_id, ts, seq, action) -> job_id, status, attempts, dead: actions are enqueue, start, ack and nack. A
    start runs a waiting job and counts an attempt; an ack completes a running one; a nack sends it back (retrying), or
    after `most` attempts to the dead letters (failed). Any other action changes nothing; an enqueue begins anew only
    a job that isn't known."""
    make = lambda status, n: F.struct(status.alias("status") if isinstance(status, Column) else F.lit(status).alias("status"), n.cast("int").alias("attempts"))

    def step(s: Column, e: Column) -> Column:
        status, n = s["status"], s["attempts"]
        return (
            F.when((e["action"] == "enqueue") & (status == "unknown"), make("pending", F.lit(0)))
            .when((e["action"] == "start") & status.isin("pending", "retrying"), make("running", n + 1))
            .when((e["action"] == "ack") & (status == "running"), make("completed", n))
            .when((e["action"] == "nack") & (status == "running"), make(F.when(n >= most, "failed").otherwise("retrying"), n))
            .otherwise(s)
        )

    out = _folded(events, "job_id", ["ts", "seq"], ["action"], make("unknown", F.lit(0)), step)
    return out.select("job_id", "state.status", "state.attempts", (F.col("state.status") == "failed").alias("dead"))


def job_states_stream(events: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """As job_states for a stream: a row for each change of a job's status. State: status and attempts."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("unknown", 0)
        out = []
        for action in pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")["action"]:
            before = status
            if action == "enqueue" and status == "unknown":
                status = "pending"
            elif action == "start" and status in ("pending", "retrying"):
                status, n = "running", n + 1
            elif action == "ack" and status == "running":
                status = "completed"
            elif action == "nack" and status == "running":
                status = "failed" if n >= most else "retrying"
            if status != before:
                out.append((key[0], status, n))
        state.update((status, n))
        yield pd.DataFrame(out, columns=["job_id", "status", "attempts"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, attempts int", "status string, attempts int", "append", "NoTimeout")


def token_bucket(requests: DataFrame, key: str, per_minute: float) -> DataFrame:
    """key, allowed, refused: requests (key, ts) against a bucket that starts full, holds floor(rate) + 1 tokens and gains
    per_minute / 60 a second."""
    per_second = per_minute / 60
    burst = float(int(per_second) + 1)
    zero = F.struct(F.lit(burst).alias("tokens"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("allowed"), F.lit(0).alias("refused"))

    def step(s: Column, e: Column) -> Column:
        have = F.least(F.lit(burst), s["tokens"] + F.coalesce((e["us"] - s["at"]) / 1_000_000, F.lit(0.0)) * per_second)
        return F.struct(
            F.when(have >= 1, have - 1).otherwise(have).alias("tokens"), e["us"].alias("at"), (s["allowed"] + F.when(have >= 1, 1).otherwise(0)).alias("allowed"), (s["refused"] + F.when(have >= 1, 0).otherwise(1)).alias("refused"),
        )

    out = _folded(requests.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), key, ["us"], [], zero, step)
    return out.select(key, "state.allowed", "state.refused")


def halving_mean(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, mean: the first value, then half of the mean so far and half of the next; a mean of 0 starts anew."""
    out = _folded(rows, key, order, [value], F.lit(0.0), lambda s, e: F.when(s == 0, e[value].cast("double")).otherwise((s + e[value]) / 2))
    return out.withColumnRenamed("state", "mean")


def expired(entries: DataFrame, as_of: str, ttl: str = "ttl_seconds", stamp: str = "ts") -> DataFrame:
    """Entries whose time to live is over."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(stamp).cast("timestamp"))) / 1_000_000
    return entries.filter(age > F.col(ttl))


def first_level_ttl(seconds: Column) -> Column:
    """Half of the time to live, a minute at least."""
    return F.greatest(seconds / 2, F.lit(60.0))


def hit_rates(stats: DataFrame) -> DataFrame:
    """Of caches (level, hits, misses): level, rate; all: what the first level misses goes on to the second."""
    rate = lambda h, m: F.when(h + m > 0, h / (h + m)).otherwise(0.0)
    each = stats.groupBy("level").agg(F.sum("hits").alias("h"), F.sum("misses").alias("m")).select("level", rate(F.col("h"), F.col("m")).alias("rate"))
    first, last = F.sum(F.when(F.col("level") == "L1", F.col("hits") + F.col("misses"))), F.sum("hits")
    both = stats.agg(F.when(first > 0, last / first).otherwise(0.0).alias("rate")).select(F.lit("all").alias("level"), "rate")
    return each.unionByName(both)


def unseen(events: DataFrame, key: str, late: str) -> DataFrame:
    """A stream without repeats of a key that come within the watermark; the state is dropped beyond it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def publish(events: DataFrame, handlers: dict[str, Callable], checkpoint: str, everything: Callable | None = None):
    """Starts a stream that hands each batch to the handlers of its types, and all of it to `everything`. A handler gets
    (rows, batch id) and may see a batch again after a failure."""
    def send(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        for kind, handler in handlers.items():
            handler(rows.filter(F.col("type") == kind), batch)
        if everything:
            everything(rows, batch)
        rows.unpersist()

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()


def rooms(events: DataFrame) -> DataFrame:
    """Each event once for each of its rooms: its type's room of all, and the one of its job."""
    return events.withColumn("room", F.explode(F.array(F.concat("type", F.lit(":all")), F.concat("type", F.lit(":"), F.col("job_id").cast("string")))))


def delivery_plan(events: DataFrame, most: int = 3) -> DataFrame:
    """Each event's attempts: attempt from 1, due_at: at once, then 1, 2, 4... seconds after the one before."""
    tries = events.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(most))))
    wait = F.pow(F.lit(2), F.col("attempt") - 1) - 1
    return tries.withColumn("due_at", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (wait * 1_000_000).cast("long")))


def status_counts(jobs: DataFrame) -> DataFrame:
    """depth, pending (with retrying), running, completed, failed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return jobs.agg(F.count("*").alias("depth"), n("pending", "retrying").alias("pending"), n("running").alias("running"), n("completed").alias("completed"), n("failed").alias("failed"))


def job_flags(jobs: DataFrame, as_of: str, most: int = MOST_ATTEMPTS) -> DataFrame:
    """jobs with should_retry and is_scheduled."""
    retry = (F.col("attempts") < most) & (F.col("status") == "retrying")
    return jobs.withColumn("should_retry", retry).withColumn("is_scheduled", F.coalesce(F.col("scheduled_at") > F.lit(as_of).cast("timestamp"), F.lit(False)))


def dead_letter_stats(dead: DataFrame) -> DataFrame:
    """Of failed jobs (type, error, ts, attempts): dimension (type, error or all), value, n, oldest, newest, attempts."""
    out = dead.groupingSets([["type"], ["error"], []], "type", "error").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.round(F.avg("attempts"), 6).alias("attempts"))
    return out.select(F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "error").otherwise("all").alias("dimension"), F.coalesce("type", "error", F.lit("")).alias("value"), "n", "oldest", "newest", "attempts")


def pool_stats(workers: DataFrame) -> DataFrame:
    """Of workers (busy, mean): utilisation, and the greatest of their means."""
    return workers.agg((F.sum(F.col("busy").cast("int")) / F.count("*")).alias("utilisation"), F.max("mean").alias("mean"))
