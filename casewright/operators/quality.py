"""Duplicates of cases by hashes, and quality in numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def normalised(text: Column) -> Column:
    """Lower case, blanks collapsed, then punctuation deleted."""
    return F.translate(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), ".,;:()[]\"'", "")


def hashed(df: DataFrame) -> DataFrame:
    parts = [normalised(F.col("case_name")), F.lower("court"), F.lower("jurisdiction")]
    return df.withColumn("hash", F.sha2(F.concat_ws("|", *parts), 256))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """hash, n, best: groups of more than one, with the case of best quality (then least id)."""
    g = hashed(df).groupBy("hash").agg(F.count("*").alias("n"), F.min_by("id", F.struct(-F.col("quality_score"), F.col("id"))).alias("best"))
    return g.filter("n > 1")


def first_seen(df: DataFrame) -> DataFrame:
    """Whether an earlier decision already had the case's hash."""
    w = Window.partitionBy("hash").orderBy("decision_date", "case_key")
    return hashed(df).select("id", (F.row_number().over(w) > 1).alias("seen_before"))


def hashes(df: DataFrame) -> DataFrame:
    """df's rows once for each hash they have, with its kind and value: equal numbers, normalised names, courts with
    numbers, long summaries (their first 500 bytes, where there are more than 100), and structure. Blank fields: none."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number, name, court, summary = map(text, ("case_number", "case_name", "court", "summary"))
    level = F.coalesce(F.col("court_level").cast("string"), F.lit("0"))
    made = {
        "case_number": F.when(number != "", F.sha2(number, 256)),
        "case_name": F.when(name != "", F.sha2(normalised(name), 256)),
        "court_case_number": F.when((court != "") & (number != ""), F.sha2(F.concat_ws("|", court, number), 256)),
        "content_fingerprint": F.when(F.octet_length(summary) > 100, F.sha2(F.substring(F.encode(summary, "UTF-8"), 1, 500), 256)),
        "structural": F.sha2(F.concat_ws("|", text("jurisdiction"), court, name, level), 256),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), h.alias("hash")) for k, h in made.items()]))
    return df.withColumn("h", each).select(*df.columns, "h.kind", "h.hash").filter("hash is not null")


def hash_groups(df: DataFrame) -> DataFrame:
    """kind, hash, n, ids (ascending), best: the cases of each hash that more than one has, by each of the five hashes."""
    rank = F.struct(-F.coalesce(F.col("quality_score"), F.lit(0.0)), F.col("id"))
    g = hashes(df).groupBy("kind", "hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("id", rank).alias("best"))
    return g.filter("n > 1")


def duplication(df: DataFrame) -> DataFrame:
    """id, seen (kinds of hash that the case before, by decision date and id, has under another id), score: 0.2 off each."""
    w = Window.partitionBy("kind", "hash").orderBy("decision_date", "id")
    h = hashes(df.select("id", "decision_date", "case_number", "case_name", "court", "summary", "jurisdiction", "court_level").withColumn("row", F.monotonically_increasing_id()))
    h = h.withColumn("other", F.lag("id").over(w))
    g = h.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.when(F.col("other") != F.col("id"), F.col("kind")))).alias("seen"))
    return g.select("id", "seen", F.greatest(F.round(1.0 - 0.2 * F.size("seen"), 9), F.lit(0.0)).alias("score"))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def quality_metrics(df: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    return df.agg(F.count("*").alias("total"), F.count_if(q >= 0.8).alias("high"), F.count_if((q >= 0.6) & (q < 0.8)).alias("medium"), F.count_if(q < 0.6).alias("low"), F.round(F.avg(q), 9).alias("average"))
