"""Extension points: named processors, validators, exporters and sources, a data source for Spark, and batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Processor:
    """Rewrites columns of the rows it can process. process: df's columns by name -> the new ones."""

    name: str
    process: Callable[[DataFrame], dict[str, Column]]
    can_process: Callable[[DataFrame], Column] = field(default=lambda df: F.lit(True))
    priority: int = 0


@dataclass(frozen=True)
class Validator:
    """A column of messages' struct(field, message, severity) arrays."""

    name: str
    validate: Callable[[DataFrame], Column]
    severity: str = "error"
    stage: str = "custom"


@dataclass(frozen=True)
class Exporter:
    name: str
    export: Callable[[DataFrame], DataFrame]
    extension: str = "txt"
    mime: str = "text/plain"


@dataclass(frozen=True)
class Source:
    """A table function: (spark, options) -> rows."""

    name: str
    read: Callable[[SparkSession, dict], DataFrame]


class Registry:
    """Plugins by kind and name; a name is taken once."""

    def __init__(self):
        self._all: dict[type, dict[str, object]] = {}

    def register(self, plugin) -> None:
        own = self._all.setdefault(type(plugin), {})
        if plugin.name in own:
            raise ValueError(f"{plugin.name} is registered")
        own[plugin.name] = plugin

    def unregister(self, kind: type, name: str) -> None:
        del self._all.get(kind, {})[name]

    def get(self, kind: type, name: str):
        return self._all.get(kind, {})[name]

    def names(self, kind: type) -> list[str]:
        return sorted(self._all.get(kind, {}))

    def count(self, kind: type | None = None) -> int:
        return sum(len(v) for k, v in self._all.items() if kind in (None, k))

    def processors(self) -> list[Processor]:
        """By falling priority, then by name."""
        return sorted(self._all.get(Processor, {}).values(), key=lambda p: (-p.priority, p.name))

    def processed(self, df: DataFrame) -> DataFrame:
        """df through all processors; each sees what those before it made, and leaves rows it can't process alone."""
        for p in self.processors():
            can = F.coalesce(p.can_process(df), F.lit(False))
            df = df.withColumns({c: F.when(can, new).otherwise(F.col(c)) if c in df.columns else F.when(can, new) for c, new in p.process(df).items()})
        return df

    def validated(self, df: DataFrame) -> DataFrame:
        """df with messages of all validators, by name."""
        def signed(v: Validator) -> Column:
            return F.transform(v.validate(df), lambda m: F.struct(F.lit(v.name).alias("validator"), m["field"].alias("field"), m["message"].alias("message"), F.lit(v.severity).alias("severity")))

        found = [signed(v) for _, v in sorted(self._all.get(Validator, {}).items())]
        return df.withColumn("messages", F.concat(*found)) if found else df


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.rows, self.parts = int(options.get("rows", "10")), int(options.get("parts", "2"))

    def partitions(self):
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition) -> Iterator[tuple]:
        for k in range(partition.value, self.rows, self.parts):
            yield (f"sample-{k}", f"[{2000 + k % 24}] EX {k}", f"Sample {k} v. Example", "Example Court")


class RecordSource(DataSource):
    """`sample_cases`: a source of made-up cases, as a pattern for sources that fetch pages: partitions are read by
    executors, and a lost one is read again."""

    @classmethod
    def name(cls) -> str:
        return "sample_cases"

    def schema(self) -> str:
        return "id string, case_number string, case_name string, court string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


class BatchJobs:
    """Named jobs over a frame of cases: each returns a frame, and counts come from it. A failed job leaves the others."""

    def __init__(self, jobs: dict[str, Callable[[DataFrame], DataFrame]]):
        self.jobs = jobs

    def run(self, df: DataFrame, names: list[str]) -> dict[str, dict]:
        out = {}
        for name in names:
            if name not in self.jobs:
                out[name] = {"status": "failed", "error": "unknown job"}
                continue
            try:
                out[name] = {"status": "completed", "rows": self.jobs[name](df).count()}
            except Exception as e:  # noqa: BLE001  reported to the caller
                out[name] = {"status": "failed", "error": str(e).splitlines()[0]}
        return out
