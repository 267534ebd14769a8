"""Registered queries of monitoring and queues, in batch, with their SQL. Their streaming forms are tested on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.sources.cases import jobs, register as register_views
from casewright.streaming import monitoring, queues

_BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0)
_ACTIONS = "CASE event_id % 4 WHEN 0 THEN 'enqueue' WHEN 1 THEN 'start' WHEN 2 THEN 'nack' ELSE CASE WHEN user_id % 3 = 0 THEN 'ack' ELSE 'start' END END"


def _events(spark, sf_dir):
    register_views(spark, sf_dir)
    return spark.sql("SELECT event_id, cast(ts AS timestamp) AS ts, user_id, event_type AS type, value FROM events")


_SLOT = "time_bucket(INTERVAL {} SECOND, ts, TIMESTAMP '1970-01-01')"
_LIST = "[1.0, 5.0, 10.0, 50.0, 100.0, 'infinity'::DOUBLE]"
_HIST = f"(SELECT event_type AS type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest({_LIST}) AS le) GROUP BY 1, 2)"
#: A counter that starts again each day.
_COUNTER = "SELECT event_type AS type, ts, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id)::DOUBLE AS value FROM events"


def _quantile(q: float) -> str:
    return f"""SELECT type, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (r - below) / (n - below) END AS quantile FROM (
 SELECT *, row_number() OVER (PARTITION BY type ORDER BY le) AS k FROM (SELECT type, le, n, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, {q} * max(n) OVER (PARTITION BY type) AS r FROM {_HIST} WINDOW w AS (PARTITION BY type ORDER BY le)) WHERE n >= r) WHERE k = 1"""


def register(add) -> None:
    def on(name, f, sql):
        add(name, lambda spark, sf_dir: f(_events(spark, sf_dir)), sql)

    day_counter = lambda d: d.select("type", "ts", F.row_number().over(monitoring.Window.partitionBy("type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")).cast("double").alias("value"))
    deltas = f"(SELECT type, ts, CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY type ORDER BY ts) AS b FROM ({_COUNTER})))"
    on("R8_sliding_rate", lambda d: monitoring.rate(monitoring.increments(day_counter(d), ["type"]), ["type"], 300, 60).withColumn("rate", F.round("rate", 9)), f"SELECT window_start, type, sum(delta) AS increase, round(sum(delta) / 300, 9) AS rate FROM (SELECT date_trunc('minute', ts) - to_minutes(k::INT) AS window_start, type, delta FROM {deltas}, range(5) AS r(k)) GROUP BY 1, 2")
    on("R9_increase", lambda d: monitoring.rate(monitoring.increments(day_counter(d), ["type"]), ["type"], 86400).select("window_start", "type", "increase"), f"SELECT date_trunc('day', ts) AS window_start, type, sum(delta) AS increase FROM {deltas} GROUP BY 1, 2")
    on("R10_ratio_alerts", lambda d: monitoring.ratio_alerts(d, F.col("type") == "error", [], 21600, 0.2).withColumn("ratio", F.round("ratio", 9)), f"SELECT {_SLOT.format(21600)} AS window_start, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS ratio FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') / count(*) > 0.2")
    on("R11_quantiles", lambda d: monitoring.histogram_quantile(monitoring.histogram(d, ["type"], _BOUNDS), ["type"], 0.5).withColumn("q", F.lit("p50")).unionByName(monitoring.histogram_quantile(monitoring.histogram(d, ["type"], _BOUNDS), ["type"], 0.99).withColumn("q", F.lit("p99"))).withColumn("quantile", F.round("quantile", 6)),
       f"SELECT type, round(quantile, 6) AS quantile, 'p50' AS q FROM ({_quantile(0.5)}) UNION ALL SELECT type, round(quantile, 6), 'p99' FROM ({_quantile(0.99)})")
    on("A24_histogram", lambda d: monitoring.histogram_totals(d, ["type"]).join(monitoring.histogram(d, ["type"], _BOUNDS).filter("le = 10.0").select("type", F.col("n").alias("upto_10")), "type"), "SELECT event_type AS type, count(*) AS n, round(sum(value), 6) AS total, count(*) FILTER (value <= 10) AS upto_10 FROM events GROUP BY 1")
    on("R12_top_rates", lambda d: monitoring.top_rates(monitoring.rate(d.withColumn("delta", F.lit(1)), ["type"], 86400), 2).select("window_start", "type", "increase"), "SELECT window_start, type, n AS increase FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, type) AS k FROM (SELECT date_trunc('day', ts) AS window_start, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k <= 2")
    on("R13_mean_alerts", lambda d: monitoring.mean_alerts(d, 21600, 45.0).withColumn("mean", F.round("mean", 6)), f"SELECT {_SLOT.format(21600)} AS window_start, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING avg(value) < 45")
    on("R14_held_alerts", lambda d: monitoring.held_alerts(d.select("type", "ts", "value"), ["type"], F.col("value") < 60, 7200), "SELECT type, ts, since FROM (SELECT type, ts, min(ts) OVER (PARTITION BY type, run) AS since FROM (SELECT *, sum(bad) OVER (PARTITION BY type ORDER BY ts) AS run FROM (SELECT event_type AS type, ts, CASE WHEN value < 60 THEN 0 ELSE 1 END AS bad FROM events)) WHERE bad = 0) WHERE epoch_us(ts) - epoch_us(since) >= 7200000000")
    on("R15_absent", lambda d: monitoring.absent(d, d.sparkSession.createDataFrame([("error",), ("view",), ("nothing",)], "type string"), "type", 3600),
       "SELECT type, to_timestamp(slot * 3600)::TIMESTAMP AS window_start FROM (SELECT unnest(['error', 'view', 'nothing']) AS type), (SELECT unnest(range(a, b + 1)) AS slot FROM (SELECT min(epoch_us(ts)) // 3600000000 AS a, max(epoch_us(ts)) // 3600000000 AS b FROM events)) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = type AND epoch_us(e.ts) // 3600000000 = slot)")
    on("R16_gauge_ratio", lambda d: monitoring.gauge_ratio(d.select((F.col("user_id") % 5).alias("pool"), F.when(F.col("event_id") % 2 == 0, "active").otherwise("total").alias("metric"), "ts", "value"), ["pool"], "active", "total").withColumn("ratio", F.round("ratio", 9)), "SELECT user_id % 5 AS pool, round(arg_max(value, ts) FILTER (event_id % 2 = 0) / arg_max(value, ts) FILTER (event_id % 2 <> 0), 9) AS ratio FROM events GROUP BY 1")
    on("R17_P6_progress", lambda d: monitoring.progress(d.select("ts", (F.col("event_id") % 150).alias("n"), "event_id"), 120).select("event_id", "percent"), "SELECT event_id, least((event_id % 150) / 120 * 100, 100)::DOUBLE AS percent FROM events")
    on("R4_job_states", lambda d: queues.job_states(d.selectExpr("user_id AS job_id", "ts", "event_id AS seq", f"{_ACTIONS} AS action")),
       f"""SELECT job_id, s.status AS status, s.attempts AS attempts, s.status = 'failed' AS dead FROM (SELECT job_id, list_reduce(list_prepend({{'status': 'unknown', 'attempts': 0, 'action': ''}}, events), lambda s, e: {{
 'status': CASE WHEN e.action = 'enqueue' AND s.status = 'unknown' THEN 'pending' WHEN e.action = 'start' AND s.status IN ('pending', 'retrying') THEN 'running' WHEN e.action = 'ack' AND s.status = 'running' THEN 'completed' WHEN e.action = 'nack' AND s.status = 'running' THEN CASE WHEN s.attempts >= 3 THEN 'failed' ELSE 'retrying' END ELSE s.status END,
 'attempts': CASE WHEN e.action = 'start' AND s.status IN ('pending', 'retrying') THEN s.attempts + 1 ELSE s.attempts END, 'action': e.action}}) AS s FROM (SELECT user_id AS job_id, list({{'status': '', 'attempts': 0, 'action': {_ACTIONS}}} ORDER BY ts, event_id) AS events FROM events GROUP BY 1))""")
    on("R5_token_bucket", lambda d: queues.token_bucket(d, "type", 0.2), """SELECT type, s.allowed AS allowed, s.refused AS refused FROM (SELECT type, list_reduce(list_prepend({'tokens': 1.0::DOUBLE, 'us': NULL::BIGINT, 'allowed': 0, 'refused': 0}, events), lambda s, e: {
 'tokens': CASE WHEN least(1.0, s.tokens + coalesce((e.us - s.us) / 1000000, 0) * (0.2::DOUBLE / 60)) >= 1 THEN least(1.0, s.tokens + coalesce((e.us - s.us) / 1000000, 0) * (0.2::DOUBLE / 60)) - 1 ELSE least(1.0, s.tokens + coalesce((e.us - s.us) / 1000000, 0) * (0.2::DOUBLE / 60)) END,
 'us': e.us, 'allowed': s.allowed + (least(1.0, s.tokens + coalesce((e.us - s.us) / 1000000, 0) * (0.2::DOUBLE / 60)) >= 1)::INT, 'refused': s.refused + (least(1.0, s.tokens + coalesce((e.us - s.us) / 1000000, 0) * (0.2::DOUBLE / 60)) < 1)::INT}) AS s
 FROM (SELECT event_type AS type, list({'tokens': 0.0::DOUBLE, 'us': epoch_us(ts), 'allowed': 0, 'refused': 0} ORDER BY ts) AS events FROM events GROUP BY 1))""")
    on("A21_R19_halving_mean", lambda d: queues.halving_mean(d, "type", ["ts", "event_id"], "value").withColumn("mean", F.round("mean", 6)), "SELECT event_type AS type, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: CASE WHEN a = 0 THEN x ELSE (a + x) / 2 END), 6) AS mean FROM events GROUP BY 1")
    on("R7_expired", lambda d: queues.expired(d.withColumn("ttl_seconds", queues.first_level_ttl((F.col("user_id") % 9 * 86400).cast("double"))), "2024-01-20").select("event_id"), "SELECT event_id FROM events WHERE (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 1000000 > greatest(user_id % 9 * 86400 / 2, 60)")
    on("A23_hit_rates", lambda d: queues.hit_rates(d.select(F.when(F.col("user_id") % 2 == 0, "L1").otherwise("L2").alias("level"), (F.col("event_id") % 7).alias("hits"), (F.col("event_id") % 3).alias("misses"))).withColumn("rate", F.round("rate", 9)), "SELECT level, round(sum(h) / (sum(h) + sum(m)), 9) AS rate FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'L1' ELSE 'L2' END AS level, event_id % 7 AS h, event_id % 3 AS m FROM events) GROUP BY 1 UNION ALL SELECT 'all', round(sum(event_id % 7) / sum(event_id % 7 + event_id % 3) FILTER (user_id % 2 = 0), 9) FROM events")
    on("R2_rooms", lambda d: queues.rooms(d.withColumn("job_id", F.col("user_id") % 4)).groupBy("room").agg(F.count("*").alias("n")), "SELECT room, count(*) AS n FROM (SELECT unnest([event_type || ':all', event_type || ':' || user_id % 4]) AS room FROM events) GROUP BY 1")
    on("R3_delivery", lambda d: queues.delivery_plan(d.filter("type = 'error'")).select("event_id", "attempt", "due_at"), "SELECT event_id, k::INT AS attempt, ts + to_seconds((2 ** (k - 1) - 1)::INT) AS due_at FROM events, range(1, 4) AS r(k) WHERE event_type = 'error'")
    on("A18_status_counts", lambda d: queues.status_counts(d.withColumn("status", F.element_at(F.array(*map(F.lit, ("pending", "retrying", "running", "completed", "failed"))), (F.col("event_id") % 5 + 1).cast("int")))), "SELECT count(*) AS depth, count(*) FILTER (event_id % 5 < 2) AS pending, count(*) FILTER (event_id % 5 = 2) AS running, count(*) FILTER (event_id % 5 = 3) AS completed, count(*) FILTER (event_id % 5 = 4) AS failed FROM events")
    on("F21_flags", lambda d: queues.job_flags(d.select("event_id", (F.col("user_id") % 5).alias("attempts"), F.when(F.col("type") == "error", "retrying").otherwise("running").alias("status"), F.col("ts").alias("scheduled_at")), "2024-01-15").select("event_id", "should_retry", "is_scheduled"), "SELECT event_id, user_id % 5 < 3 AND event_type = 'error' AS should_retry, ts > '2024-01-15' AS is_scheduled FROM events")
    on("A17_dead_letter_stats", lambda d: queues.dead_letter_stats(d.filter("value < 30").select("type", F.concat(F.lit("e"), (F.col("user_id") % 4).cast("string")).alias("error"), "ts", (F.col("event_id") % 3).alias("attempts"))),
       "WITH d AS (SELECT event_type AS type, 'e' || user_id % 4 AS error, ts, event_id % 3 AS attempts FROM events WHERE value < 30) SELECT 'type' AS dimension, type AS value, count(*) AS n, min(ts) AS oldest, max(ts) AS newest, round(avg(attempts), 6) AS attempts FROM d GROUP BY 2 UNION ALL SELECT 'error', error, count(*), min(ts), max(ts), round(avg(attempts), 6) FROM d GROUP BY 2 UNION ALL SELECT 'all', '', count(*), min(ts), max(ts), round(avg(attempts), 6) FROM d".replace("WITH d AS", "SELECT * FROM (WITH d AS") + ")")
    on("P7_pool", lambda d: queues.pool_stats(d.groupBy("user_id").agg((F.max("event_id") % 2 == 0).alias("busy"), F.round(F.avg("value"), 9).alias("mean"))), "SELECT sum(b) / count(*) AS utilisation, max(m) AS mean FROM (SELECT (max(event_id) % 2 = 0)::INT AS b, round(avg(value), 9) AS m FROM events GROUP BY user_id)")
    add("S13_queue_read", lambda s, d: jobs(s, d).filter("priority = 3").orderBy("created_at", "job_id").limit(25).select("job_id"), "SELECT job_id FROM jobs WHERE priority = 3 ORDER BY created_at, job_id LIMIT 25")
