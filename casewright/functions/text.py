"""Text helpers as expressions: cleaning, court names, dates, ids and courts from addresses, judges, query strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities and what they stand for; court abbreviations; date layouts; month names (fixed values).
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
COURT_WORDS = ((r"\bS\.?C\.?(?![A-Za-z0-9_])", "Supreme Court"), (r"\bC\.?A\.?(?![A-Za-z0-9_])", "Court of Appeal"), (r"\bH\.?C\.?(?![A-Za-z0-9_])", "High Court"), (r"\bD\.?C\.?(?![A-Za-z0-9_])", "District Court"), (r"\bF\.?C\.?(?![A-Za-z0-9_])", "Federal Court"), (r"\bCt\.?(?![A-Za-z0-9_])", "Court"), (r"\bJ\.?(?![A-Za-z0-9_])", "Justice"))
LAYOUTS = ("yyyy-MM-dd", "d/M/yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "d.M.yyyy")
MONTHS = {
    "January": ("janvier", "januar"), "February": ("février", "fevrier", "februar"), "March": ("mars", "märz", "maerz"), "April": ("avril",), "May": ("mai",), "June": ("juin", "juni"),
    "July": ("juillet", "juli"), "August": ("août", "aout"), "September": ("septembre",), "October": ("octobre", "oktober"), "November": ("novembre",), "December": ("décembre", "decembre", "dezember"),
}


def sanitised(text: Column) -> Column:
    """Entities replaced, hard blanks and form feeds as blanks, runs of blanks as one, none outside."""
    t = reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(t, r"[\s \f]+", " "))


def court_name(text: Column) -> Column:
    """Abbreviations written out, whatever their case."""
    return F.trim(reduce(lambda a, w: F.regexp_replace(a, "(?i)" + w[0], w[1]), COURT_WORDS, F.coalesce(text, F.lit(""))))


def any_date(text: Column) -> Column:
    """The day in the first layout that reads it; French and German months are known, and the year-month-day characters
    of Japanese dates; null if none does."""
    t = sanitised(text)
    named = reduce(lambda a, m: F.regexp_replace(a, "(?iu)\\b(" + "|".join(m[1]) + ")\\b", m[0]), MONTHS.items(), t)
    signs = F.regexp_replace(F.regexp_extract(t, r"(\d{4}年\d{1,2}月\d{1,2})日", 1), "[年月]", "-")
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for x in (named,) for f in LAYOUTS), F.try_to_timestamp(signs, F.lit("yyyy-M-d"))).cast("date")


def strict_date(text: Column) -> Column:
    """ISO or day/month/year; anything else fails the query."""
    t = F.trim(text)
    return F.when(t == "", None).when(F.contains(t, F.lit("/")), F.to_date(t, "dd/MM/yyyy")).otherwise(F.to_date(t, "yyyy-MM-dd"))


def id_from_url(url: Column) -> Column:
    """What follows /cases/ without .html, or /doc/ up to a slash, or the last part; no query string."""
    u = F.regexp_replace(url, r"[?#].*$", "")
    case, doc = F.regexp_extract(u, r"/cases/(.+?)(?:\.html)?$", 1), F.regexp_extract(u, r"/doc/([^/]+)", 1)
    return F.coalesce(F.nullif(case, F.lit("")), F.nullif(doc, F.lit("")), F.regexp_extract(u, r"([^/]*?)(?:\.html)?/?$", 1))


def court_from_url(url: Column, segments: dict[str, str]) -> Column:
    """The court of the first segment that the address holds, in the order given."""
    return F.coalesce(*(F.when(F.contains(url, F.lit(k)), v) for k, v in segments.items()), F.lit(None).cast("string"))


def query_url(base: str, params: dict[str, Column]) -> Column:
    """base with the parameters that aren't empty, encoded, in the order given."""
    pairs = F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(k + "="), F.url_encode(v))) for k, v in params.items())))
    return F.concat(F.lit(base), F.when(F.size(pairs) > 0, F.concat(F.lit("&" if "?" in base else "?"), F.array_join(pairs, "&"))).otherwise(""))


def bracketed(text: Column) -> Column:
    return F.regexp_extract(text, r"\[[^\]]*\]", 0)


def judges_after(text: Column) -> Column:
    """Names after Before: or Judges:, up to the end of the line, parted at commas, & and the word and."""
    line = F.regexp_extract(text, r"(?:Before|Judges):\s*([^\n]*)", 1)
    return F.filter(F.transform(F.split(line, r",|&|\sand\s"), lambda x: F.trim(x)), lambda x: x != "")


def judges_in(text: Column, most: int = 5) -> Column:
    """Distinct names with a judge's title in a text, in order; of a report's head, so a few are enough."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:Justice|Judge) ([A-Z][a-z]+)"), F.lit(1))), 1, most)


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")
