"""Source policies: attribution, its formats and checks, compliance of requests, rendered citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a policies table: one row a source, few enough to broadcast.
POLICY = "source_database string, base_url string, terms_url string, requires boolean, attribution_text string, allowed boolean, rate_limit int, delay_seconds int"
RULE = "\n\n" + "-" * 80 + "\n"


def with_policy(df: DataFrame, policies: DataFrame) -> DataFrame:
    return df.join(F.broadcast(policies), "source_database", "left")


def attributed(df: DataFrame, policies: DataFrame) -> DataFrame:
    """df with attribution, source_url, terms_of_service and full_text with its footer. A source without a policy gets a
    general line; one that requires nothing, and no source, get null."""
    d = with_policy(df, policies)
    general = F.concat(F.lit("Data sourced from "), F.col("source_database"), F.when(F.col("url") != "", F.concat(F.lit(" ("), F.col("url"), F.lit(")"))).otherwise(""))
    known, named = F.col("requires").isNotNull(), F.coalesce("source_database", F.lit("")) != ""
    text = F.when(named & known & F.col("requires"), F.col("attribution_text")).when(named & ~known, general)
    footer = F.concat(F.lit(RULE + "ATTRIBUTION:\n"), F.col("attribution_text"), F.lit("\n" + RULE))
    full = F.when(F.col("requires") & (F.col("full_text") != "") & (F.col("attribution_text") != ""), F.concat("full_text", footer)).otherwise(F.col("full_text"))
    url = lambda c: F.when(F.col("requires"), F.col(c))
    return d.select(*(c for c in df.columns if c != "full_text"), full.alias("full_text"), text.alias("attribution"), url("base_url").alias("source_url"), url("terms_url").alias("terms_of_service"))


def formatted(kind: str) -> Column:
    """A required policy's attribution as text, html, markdown or json; empty where none is required."""
    a, u, t, s = (F.coalesce(c, F.lit("")) for c in ("attribution_text", "base_url", "terms_url", "source_database"))
    made = {
        "html": F.format_string('<div class="attribution"><p>%s</p><p><a href="%s">%s</a></p></div>', a, u, u), "markdown": F.format_string("**Attribution:** %s\n\nSource: [%s](%s)", a, s, u),
        "json": F.format_string('{"attribution":"%s","source_url":"%s","terms_url":"%s"}', a, u, t),
    }.get(kind, a)
    return F.when(F.coalesce("requires", F.lit(False)), made).otherwise("")


def attribution_issues(attributed_df: DataFrame, policies: DataFrame) -> DataFrame:
    """df with issues: no source, or metadata missing that the policy (or the lack of one) asks for."""
    d = with_policy(attributed_df, policies)
    named, known = F.coalesce("source_database", F.lit("")) != "", F.col("requires").isNotNull()
    issues = F.array(
        F.when(~named, "No source database specified"), F.when(named & ~known & F.col("attribution").isNull(), "Missing attribution metadata"),
        F.when(named & F.col("requires") & F.col("attribution").isNull(), "Missing attribution in metadata"), F.when(named & F.col("requires") & F.col("source_url").isNull(), "Missing source URL in metadata"),
    )
    return d.select(*attributed_df.columns, F.array_compact(issues).alias("issues"))


def checked(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests (source_database, per_minute) with compliant and violations."""
    d = with_policy(requests, policies)
    known = F.col("allowed").isNotNull()
    v = F.when(~known, F.array(F.concat(F.lit("No policy found for source: "), "source_database"))).when(~F.col("allowed"), F.array(F.lit("Scraping is not allowed for this source")))
    v = v.when(F.col("per_minute") > F.col("rate_limit"), F.array(F.lit("Rate limit exceeded"))).otherwise(F.array().cast("array<string>"))
    return d.select(*requests.columns, v.alias("violations"), F.coalesce("delay_seconds", F.lit(5)).alias("delay_seconds")).withColumn("compliant", F.size("violations") == 0)


def violation_counts(violations: DataFrame, since: str | None = None) -> DataFrame:
    """source, n, latest of violations (source, ts) after a time."""
    v = violations if since is None else violations.filter(F.col("ts") > F.lit(since).cast("timestamp"))
    return v.groupBy("source").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _if(c: str, *parts) -> Column:
    return F.when(_text(c) != "", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise("")


def citation(style: str) -> Column:
    """A case cited in bluebook, apa, mla or plain style. bluebook expects attribution_text and requires, of a policy."""
    name, number, court, day = _text("case_name"), _text("case_number"), _text("court"), F.col("decision_date")
    date = lambda pattern, *around: F.coalesce(F.concat(F.lit(around[0]), F.date_format(day, pattern), F.lit(around[1])), F.lit(""))
    if style == "bluebook":
        source = F.when(F.coalesce("requires", F.lit(False)) & (_text("attribution_text") != ""), F.concat(F.lit(". "), "attribution_text")).otherwise("")
        return F.concat(name, _if("case_number", ", ", number), _if("court", " (", court, date("MMM'.' d, yyyy", " ", ""), ")"), source)
    if style == "apa":
        when = F.when((court != "") & day.isNotNull(), F.concat(F.lit(" ("), court, F.lit(" "), F.year(day).cast("string"), F.lit(")"))).otherwise("")
        return F.concat(name, _if("case_number", ", ", number), when, _if("url", ". Retrieved from ", _text("url")))
    if style == "mla":
        return F.concat(name, F.lit("."), _if("case_number", " ", number, "."), _if("court", " ", court, "."), date("d MMM'.' yyyy", " ", "."), _if("source_database", " ", _text("source_database"), "."), _if("url", " Web."))
    return F.concat(name, _if("case_number", " [", number, "]"), _if("court", ", ", court), date("d MMMM yyyy", ", ", ""), _if("source_database", " (Source: ", _text("source_database"), ")"))
