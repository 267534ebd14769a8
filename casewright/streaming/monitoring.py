"""Rates, quantiles and alerts over metrics. What only groups by windows serves batch frames and streams alike (give a
stream a watermark with `late`); what follows a series has a batch form on window functions and a keyed stateful form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increments(samples: DataFrame, series: list[str]) -> DataFrame:
    """samples (series..., ts, value of a counter) with delta: growth since the sample before; after a reset, the value;
    0 for the first."""
    w = Window.partitionBy(*series).orderBy("ts")
    before = F.lag("value").over(w)
    return samples.withColumn("delta", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def rate(deltas: DataFrame, by: list[str], seconds: int, slide: int | None = None, value: str = "delta", late: str | None = None) -> DataFrame:
    """window_start, by..., increase (sum over the window) and rate (a second). slide: seconds between windows."""
    if late:
        deltas = deltas.withWatermark("ts", late)
    win = F.window("ts", f"{seconds} seconds", f"{slide or seconds} seconds")
    out = deltas.groupBy(win.alias("w"), *by).agg(F.sum(value).alias("increase"))
    return out.select(F.col("w.start").alias("window_start"), *by, "increase", (F.col("increase") / seconds).alias("rate"))


def ratio_alerts(events: DataFrame, bad: Column, by: list[str], seconds: int, threshold: float, late: str | None = None) -> DataFrame:
    """window_start, by..., ratio of the windows in which the share of bad rows is above the threshold."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *by).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return out.withColumn("ratio", F.col("bad") / F.col("n")).filter(F.col("ratio") > threshold).select(F.col("w.start").alias("window_start"), *by, "ratio")


def histogram(events: DataFrame, by: list[str], bounds: tuple[float, ...], value: str = "value") -> DataFrame:
    """by..., le, n: cumulative counts by bounds, the last infinite."""
    le = F.explode(F.array(*(F.lit(float(b)) for b in (*bounds, float("inf")))))
    return events.select(*by, value, le.alias("le")).groupBy(*by, "le").agg(F.count_if(F.col(value) <= F.col("le")).alias("n"))


def histogram_totals(events: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """by..., quantile: interpolated within the first bucket that reaches q of all; the greatest finite bound, if that
    is the last one. No rows: no quantile."""
    w = Window.partitionBy(*by).orderBy("le")
    b = buckets.withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    b = b.withColumn("rank", q * F.max("n").over(Window.partitionBy(*by))).filter((F.col("n") >= F.col("rank")) & (F.col("rank") > 0))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    return b.groupBy(*by).agg(F.min_by(value, "le").alias("quantile"))


def top_rates(rates: DataFrame, k: int) -> DataFrame:
    """The k greatest of each window; in a stream, call it in foreachBatch."""
    w = Window.partitionBy("window_start").orderBy(F.col("rate").desc(), *[c for c in rates.columns if c not in ("window_start", "rate", "increase")])
    return rates.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)


def mean_alerts(samples: DataFrame, seconds: int, below: float, late: str | None = None) -> DataFrame:
    """Windows in which a gauge's mean lies below a floor."""
    if late:
        samples = samples.withWatermark("ts", late)
    out = samples.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.avg("value").alias("mean"))
    return out.filter(F.col("mean") < below).select(F.col("w.start").alias("window_start"), "mean")


def held_alerts(samples: DataFrame, series: list[str], condition: Column, seconds: int) -> DataFrame:
    """series..., ts, since of the samples at which the condition has held for at least `seconds`, without a break."""
    w = Window.partitionBy(*series).orderBy("ts")
    broken = F.last(F.when(~condition, F.col("ts")), ignorenulls=True).over(w)
    s = samples.withColumn("ok", condition).withColumn("broken", broken)
    s = s.filter("ok").withColumn("since", F.min("ts").over(Window.partitionBy(*series, "broken")))
    return s.filter(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) >= seconds * 1_000_000).select(*series, "ts", "since")


def held_alerts_stream(samples: DataFrame, seconds: int) -> DataFrame:
    """As held_alerts for a stream (series string, ts, ok boolean): the state of a series is since when it has held."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            if not ok:
                since = None
                continue
            since = ts if since is None else since
            if (ts - since).total_seconds() >= seconds:
                out.append((key[0], ts, since))
        state.update((since,)) if since is not None else state.exists and state.remove()
        yield pd.DataFrame(out, columns=["series", "ts", "since"])

    return samples.groupBy("series").applyInPandasWithState(step, "series string, ts timestamp, since timestamp", "since timestamp", "append", "NoTimeout")


def absent(samples: DataFrame, series: DataFrame, key: str, seconds: int) -> DataFrame:
    """key, window_start of the windows between the first sample and the last in which an expected series has none."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    ends = samples.agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a is not null")
    slots = ends.select(F.explode(F.sequence("a", "b")).alias("slot"))
    seen = samples.select(key, at.alias("slot")).distinct()
    missing = slots.join(F.broadcast(series.select(key).distinct()), how="cross").join(seen, [key, "slot"], "left_anti")  # expected series times windows
    return missing.select(key, F.timestamp_seconds(F.col("slot") * seconds).alias("window_start"))


def gauge_ratio(samples: DataFrame, by: list[str], part: str, whole: str) -> DataFrame:
    """by..., ratio of the latest values of two gauges; null if the second is 0."""
    last = lambda m: F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("ts")))
    out = samples.groupBy(*by).agg(last(part).alias("_p"), last(whole).alias("_w"))
    return out.select(*by, F.when(F.col("_w") != 0, F.col("_p") / F.col("_w")).alias("ratio"))


def progress(done: DataFrame, total: int) -> DataFrame:
    """done (ts, n of finished steps) with percent, 0 to 100."""
    return done.withColumn("percent", F.when(F.lit(total) > 0, F.least(F.col("n") / total * 100, F.lit(100.0))).otherwise(0.0))
