"""Stored tables: scans with filters and order, inserts by key, migrations, dimensions from text, staged writes."""

from __future__ import annotations

import ast
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def scan(df: DataFrame, equal: dict, order: str, descending: bool = True, limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows with these values, by one column (nulls last) and id; no limit: all. Empty values don't filter."""
    for name, value in equal.items():
        if value not in (None, "", 0):
            df = df.filter(F.col(name) == value)
    out = df.orderBy(F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last(), "id").offset(offset)
    return out.limit(limit) if limit else out


def latest_rows(df: DataFrame, limit: int = 100, **equal) -> DataFrame:
    """Six columns of the latest decisions."""
    return scan(df, equal, "decision_date", True, limit).select("id", "case_number", "case_name", "court", "jurisdiction", "decision_date")


def between_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """Decisions from the start of one day to the end of another."""
    return df.filter((F.col("decision_date") >= F.lit(start).cast("timestamp")) & (F.col("decision_date") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))


def flat(df: DataFrame) -> DataFrame:
    """Cases as messages hold them: no nulls, times as seconds, counts for lists."""
    return df.select("id", "case_number", F.coalesce("case_name", F.lit("")).alias("case_name"), "court", "court_level", "jurisdiction", F.coalesce(F.unix_timestamp("decision_date"), F.lit(0)).alias("decided"), "status", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), F.size("judges").alias("n_judges"))


def batches(df: DataFrame, size: int = 10) -> Iterator[list[Row]]:
    """The rows in lists of `size`, a partition at a time, as a stream of cases sends them."""
    held: list[Row] = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def years_between(start: Column, end: Column) -> Column:
    return F.year(end) - F.year(start) - F.when(F.dayofyear(end) < F.dayofyear(start), 1).otherwise(0)


def keyed_insert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """base with the new rows; a row with the same key is replaced."""
    return base.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def updated(base: DataFrame, changes: DataFrame, key: str, stamp: str, as_of: str) -> DataFrame:
    """base with the changed columns of changes, matched by key, and stamp set where something changed. Fails if a key
    isn't there, as an update of nothing does."""
    missing = changes.join(base.select(key), key, "left_anti")
    if not missing.isEmpty():
        raise KeyError("no such row to update")
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names), F.lit(True).alias("_hit"))
    out = base.join(new, key, "left")
    for c in names:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.withColumn(stamp, F.when(F.col("_hit"), F.lit(as_of).cast("timestamp")).otherwise(F.col(stamp))).select(*base.columns)


def migration_status(registered: DataFrame, applied: DataFrame) -> DataFrame:
    """version, name, applied_at, pending: registered migrations with when they were applied; pending are those above
    the highest applied version."""
    top = applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("top"))
    return registered.join(applied, "version", "left").crossJoin(F.broadcast(top)).select("version", "name", "applied_at", (F.col("version") > F.col("top")).alias("pending"))  # one row


def dimension(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A small table from a list of flat entries in YAML's block style (- key: value), values as literals or lists."""
    rows: list[dict] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.lstrip()
        if body.startswith("- "):
            rows.append({})
            body = body[2:]
        name, _, value = body.partition(":")
        value = value.strip()
        if value.startswith("["):
            rows[-1][name.strip()] = [x.strip().strip("'\"") for x in value[1:-1].split(",") if x.strip()]
        else:
            try:
                rows[-1][name.strip()] = {"true": True, "false": False, "null": None}[value] if value in ("true", "false", "null") else ast.literal_eval(value)
            except (ValueError, SyntaxError):
                rows[-1][name.strip()] = value
    return spark.createDataFrame([Row(**r) for r in rows], schema)


class Transaction:
    """Writes of several tables that appear together: each is staged beside its path, commit renames them all, rollback
    drops them. If one rename fails, those made are undone, as long as the driver lives; the old tables are kept until
    then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.staged, self.mark = spark, [], uuid.uuid4().hex

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, path: str) -> None:
        df.write.parquet(f"{path}.staged-{self.mark}")
        self.staged.append(path)

    def _each(self, action: Callable) -> None:
        for path in self.staged:
            make, fs = self._fs(path)
            action(make, fs, path)

    def commit(self) -> None:
        done: list[Callable] = []

        def publish(make, fs, path):
            old, new, target = make(f"{path}.old-{self.mark}"), make(f"{path}.staged-{self.mark}"), make(path)
            if fs.exists(target):
                if not fs.rename(target, old):
                    raise OSError(f"could not set {path} aside")
                done.append(lambda: fs.rename(old, target))
            if not fs.rename(new, target):
                raise OSError(f"could not publish {path}")
            done.append(lambda: fs.rename(target, new))

        try:
            self._each(publish)
        except Exception:
            for undo in reversed(done):
                undo()
            raise
        self._each(lambda make, fs, path: fs.delete(make(f"{path}.old-{self.mark}"), True))
        self.staged = []

    def rollback(self) -> None:
        self._each(lambda make, fs, path: fs.delete(make(f"{path}.staged-{self.mark}"), True))
        self.staged = []
