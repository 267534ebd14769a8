"""Export formats as expressions and writers, for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a CSV export, with the field each is made from (fixed values).
CSV = (("ID", "id"), ("CaseName", "case_name"), ("CaseNumber", "case_number"), ("Court", "court"), ("Jurisdiction", "jurisdiction"), ("DecisionDate", "decision_date"), ("URL", "url"), ("Judges", "judges"), ("Summary", "summary"), ("SourceDatabase", "source_database"))
#: What stands between cases in one text.
BETWEEN = {"markdown": "\n---\n\n", "text": "\n" + "=" * 80 + "\n\n", "bibtex": "\n\n"}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _line(c: str, before: str, value: Column | None = None, after: str = "\n") -> Column:
    """before, value, after, where the field holds something."""
    made = _text(c) if value is None else value
    return F.when(F.coalesce(made, F.lit("")) != "", F.concat(F.lit(before), made, F.lit(after))).otherwise("")


def _list(c: str, by: str) -> Column:
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), by)


def _day() -> Column:
    return F.coalesce(F.date_format("decision_date", "MMMM d, yyyy"), F.lit(""))


def bibtex() -> Column:
    key = F.coalesce(F.nullif(_text("id"), F.lit("")), F.replace(_text("case_number"), F.lit(" "), F.lit("_")))
    day = F.coalesce(F.concat(F.lit("  year = {"), F.year("decision_date").cast("string"), F.lit("},\n  month = {"), F.date_format("decision_date", "MMM"), F.lit("},\n")), F.lit(""))
    return F.concat(
        F.lit("@misc{"), key, F.lit(",\n  title = {{"), _text("case_name"), F.lit("}},\n"), _line("court", "  institution = {{", after="}},\n"), day, _line("case_number", "  number = {{", after="}},\n"),
        _line("url", "  url = {", after="},\n"), _line("source_database", "  note = {{Source: ", after="}},\n"), F.lit("}"),
    )


def markdown() -> Column:
    row = lambda name, c, value=None: _line(c, f"| **{name}** | ", value, " |\n")
    table = [row("Citation", "case_number"), row("Court", "court"), row("Jurisdiction", "jurisdiction"), row("Date", "decision_date", _day()), row("Judges", "judges", _list("judges", ", "))]
    link = _line("url", "| **URL** | [Link](", after=") |\n")
    concepts = _line("legal_concepts", "## Legal Concepts\n\n", F.array_join(F.transform(F.coalesce("legal_concepts", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), "\n")
    short = F.when(F.length("full_text") > 1000, F.concat(F.substring("full_text", 1, 1000), F.lit("\n\n*[Truncated]*"))).otherwise(_text("full_text"))
    return F.concat(
        F.lit("# "), _text("case_name"), F.lit("\n\n| Field | Value |\n|-------|-------|\n"), *table, link, row("Source", "source_database"), F.lit("\n"),
        _line("summary", "## Summary\n\n", after="\n\n"), concepts, _line("full_text", "## Full Text\n\n", short, "\n\n"),
    )


def plain_text() -> Column:
    name = _text("case_name")
    fields = [_line(c, f"{n}: ", v) for n, c, v in (("Citation", "case_number", None), ("Court", "court", None), ("Jurisdiction", "jurisdiction", None), ("Date", "decision_date", _day()), ("Judges", "judges", _list("judges", ", ")), ("URL", "url", None), ("Source", "source_database", None))]
    tail = [_line("summary", "\nSummary:\n"), _line("legal_concepts", "\nLegal Concepts: ", _list("legal_concepts", ", ")), _line("full_text", "\nFull Text:\n")]
    return F.concat(name, F.lit("\n"), F.repeat(F.lit("-"), F.octet_length(name)), F.lit("\n\n"), *fields, *tail)


def csv_columns() -> list[Column]:
    value = {"decision_date": F.coalesce(F.date_format("decision_date", "yyyy-MM-dd"), F.lit("")), "judges": _list("judges", "; ")}
    return [value.get(c, _text(c)).alias(n) for n, c in CSV]


def json_line(fields: list[str] | None = None, include_full_text: bool = True) -> Column:
    """One object a row, of the fields given or all; null fields are left out."""
    def pick(columns):
        return [c for c in (fields or columns) if include_full_text or c != "full_text"]

    return lambda df: F.to_json(F.struct(*pick(df.columns)))


def formatted(df: DataFrame, kind: str, fields: list[str] | None = None, include_full_text: bool = True) -> DataFrame:
    """What is written for each row: one column `value` (json, bibtex, markdown, text), or the columns of csv and xml."""
    if not include_full_text and "full_text" in df.columns:
        df = df.withColumn("full_text", F.lit(""))
    if kind in ("json", "jsonl"):
        return df.select(json_line(fields, include_full_text)(df).alias("value"))
    if kind == "csv":
        return df.select(*csv_columns())
    if kind == "xml":
        return df.select(*(fields or df.columns))
    return df.select({"bibtex": bibtex, "markdown": markdown, "text": plain_text}[kind]().alias("value"))


def export(df: DataFrame, path: str, kind: str, rows_per_file: int = 1000, fields: list[str] | None = None, include_full_text: bool = True, compress: bool = False) -> None:
    """jsonl, csv, xml, bibtex, markdown or text, in files of at most rows_per_file rows, each a whole document."""
    out = formatted(df, kind, fields, include_full_text)
    w = out.write.option("maxRecordsPerFile", rows_per_file)
    if compress:
        w = w.option("compression", "gzip")
    if kind == "csv":
        w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    elif kind == "xml":
        w.format("xml").options(rootTag="cases", rowTag="case").save(path)
    else:
        w.option("lineSep", BETWEEN.get(kind, "\n")).text(path)


def json_document(df: DataFrame, order: str = "id") -> DataFrame:
    """The rows as one array with an indent of two spaces: column `value`, in order. One value, so one task holds the
    text: for a page of cases; a collection is exported as lines."""
    rows = df.orderBy(order).select(json_line()(df).alias("value"))
    return rows.agg(F.concat(F.lit("[\n  "), F.array_join(F.collect_list("value"), ",\n  "), F.lit("\n]")).alias("value"))


def stream_export(df: DataFrame, path: str, checkpoint: str, kind: str = "jsonl", compress: bool = False):
    """A streaming export of jsonl or csv; returns the started query."""
    out = formatted(df, kind)
    w = out.writeStream.format("csv" if kind == "csv" else "text").option("path", path).option("checkpointLocation", checkpoint)
    if compress:
        w = w.option("compression", "gzip")
    return (w.option("header", True) if kind == "csv" else w).start()
