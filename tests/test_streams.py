"""Streaming forms on file streams, held against their batch forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from casewright.functions import export
from casewright.streaming import metrics, monitoring, queues

BEGIN = datetime.datetime(2024, 1, 1)


def rows(n=400):
    kinds = ("view", "error", "buy")
    return [(k, BEGIN + datetime.timedelta(seconds=37 * k), k * 7 % 11, kinds[k % 3 if k % 10 else 1], float(k * 13 % 97)) for k in range(n)]


@pytest.fixture
def events(spark, tmp_path):
    df = spark.createDataFrame(rows(), "event_id long, ts timestamp, user_id long, type string, value double")
    for k in range(4):  # four files, in time order
        df.filter(F.floor(F.col("event_id") / 100) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))


def drained(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, df.sparkSession.table(name).collect()))


def test_windowed_rates(events, tmp_path):
    batch, stream = events
    one = lambda d: monitoring.rate(d.withColumn("delta", F.lit(1.0)), ["type"], 600, 300, late="1 minute" if d.isStreaming else None)
    assert drained(one(stream()), "update", tmp_path, "rates")[-1] in sorted(map(tuple, one(batch).collect()))
    last = {r[:2]: r for r in drained(one(stream()), "update", tmp_path, "rates2")}
    final = {}
    for r in drained(one(stream()), "update", tmp_path, "rates3"):
        final[r[:2]] = max(final.get(r[:2], r), r)
    assert set(final.values()) == {tuple(r) for r in one(batch).collect()} and len(last) == len(final)


def test_job_rates_and_alerts(events, tmp_path):
    batch, stream = events
    as_jobs = lambda d: d.select(F.col("ts").alias("created_at"), "type", F.when(F.col("type") == "error", "failed").otherwise("completed").alias("status"), F.col("value").alias("duration"))
    got = drained(metrics.rates(as_jobs(stream()), "10 minutes", late="0 seconds"), "append", tmp_path, "jobs")
    want = sorted(map(tuple, metrics.rates(as_jobs(batch), "10 minutes").collect()))
    assert len(got) >= len(want) - 3 * 1 - 3 and set(got) <= set(want)
    bad = F.col("type") == "error"
    got = drained(monitoring.ratio_alerts(stream(), bad, [], 600, 0.35, late="0 seconds"), "append", tmp_path, "ratios")
    assert got and set(got) <= {tuple(r) for r in monitoring.ratio_alerts(batch, bad, [], 600, 0.35).collect()}
    got = drained(monitoring.mean_alerts(stream(), 600, 48.0, late="0 seconds"), "append", tmp_path, "means")
    assert got and set(got) <= {tuple(r) for r in monitoring.mean_alerts(batch, 600, 48.0).collect()}


def test_first_seen(events, tmp_path):
    batch, stream = events
    twice = stream().unionByName(stream())
    assert [r[0] for r in drained(queues.unseen(twice, "event_id", "1 hour").select("event_id"), "append", tmp_path, "seen")] == list(range(400))


def test_job_states(events, tmp_path):
    batch, stream = events
    action = F.element_at(F.array(*map(F.lit, ("enqueue", "start", "nack", "start", "nack", "start", "ack"))), (F.floor(F.col("event_id") / 11) % 7 + 1).cast("int"))
    as_events = lambda d: d.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), action.alias("action"))
    want = {r["job_id"]: (r["status"], r["attempts"]) for r in queues.job_states(as_events(batch)).collect()}
    changes = queues.job_states_stream(as_events(stream()))
    q = changes.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "states")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    order = {"unknown": 0, "pending": 1, "running": 2, "retrying": 3, "failed": 4, "completed": 4}
    for job, status, n in batch.sparkSession.table("states").collect():
        last[job] = max(last.get(job, (0, 0, "")), (n, order[status], status))
    assert {j: (s, n) for j, (n, _, s) in last.items()} == want and {s for s, _ in want.values()} == {"completed"}


def test_held_alerts(events, tmp_path):
    batch, stream = events
    want = sorted(map(tuple, monitoring.held_alerts(batch, ["type"], F.col("value") < 70, 200).collect()))
    got = drained(monitoring.held_alerts_stream(stream().select(F.col("type").alias("series"), "ts", (F.col("value") < 70).alias("ok")), 200), "append", tmp_path, "held")
    assert got == want and want


def test_publish_filters_and_delivers_all(events, tmp_path):
    _, stream = events
    got = {"error": 0, "all": 0}

    def count(name):
        def handler(df, _):
            got[name] += df.count()

        return handler

    q = queues.publish(stream(), {"error": count("error")}, str(tmp_path / "pub"), count("all"))
    q.processAllAvailable()
    q.stop()
    assert got == {"error": sum(r[3] == "error" for r in rows()), "all": 400}


def test_stream_export(events, spark, tmp_path):
    _, stream = events
    q = export.stream_export(stream().select("event_id", "type"), str(tmp_path / "out"), str(tmp_path / "cp"), compress=True)
    q.processAllAvailable()
    q.stop()
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 400 and any(f.suffix == ".gz" for f in (tmp_path / "out").iterdir())
