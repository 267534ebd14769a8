"""The roll-up of validation reports, merges by key, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roll_up(reports: DataFrame) -> DataFrame:
    """total, valid, invalid, mean score, and counts of errors and warnings."""
    ok = F.size("errors") == 0
    return reports.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.round(F.avg("score"), 9).alias("mean_score"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("n_errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("n_warnings"))


def upsert(base: DataFrame, changes: DataFrame, key: str, stamp: str) -> DataFrame:
    """The last version of each key by stamp; at equal stamps the change wins. Nulls in stamp count as oldest."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_new")


def deleted(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def page_after(df: DataFrame, key: str, cursor: str | None, limit: int) -> DataFrame:
    """Keyset page: the limit rows after the cursor, base64 of {"id": key}; has_more tells if others follow."""
    after = df if cursor is None else df.filter(F.col(key) > F.get_json_object(F.unbase64(F.lit(cursor)).cast("string"), "$.id"))
    rows = after.orderBy(key).limit(limit + 1)
    return rows.withColumn("_k", F.row_number().over(Window.orderBy(key))).withColumn("has_more", F.max("_k").over(Window.partitionBy()) > limit).filter(F.col("_k") <= limit).drop("_k")
