"""Search over cases: filters, relevance, highlights, facets, suggestions, spelling."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a term found in a field (fixed values).
NAME, SUMMARY, FULL_TEXT, CONCEPT = 3.0, 2.0, 1.0, 2.5


@dataclass(frozen=True)
class Query:
    """A search: text with its kind, filters (None: any), order and page. Ranks over all matches, then pages."""

    text: str = ""
    kind: str = "terms"  # terms, exact, fuzzy or regex
    jurisdictions: tuple[str, ...] = ()
    courts: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    levels: tuple[int, ...] = ()
    ids: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    min_quality: float = 0.0
    sort: str = "relevance"
    descending: bool = True
    limit: int = 10
    offset: int = 0
    facets: tuple[str, ...] = field(default=("jurisdiction", "court", "court_level", "year"))

    def __post_init__(self):
        if not 1 <= self.limit <= 1000 or self.offset < 0:
            raise ValueError("limit must be 1 to 1000 and offset not negative")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def matches(q: Query) -> Column:
    name, summary = F.lower(F.coalesce("case_name", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    text = q.text.lower()
    if not text:
        return F.lit(True)
    if q.kind == "exact":
        return name.contains(text) | summary.contains(text)
    if q.kind == "regex":
        return F.rlike(F.col("case_name"), F.lit(q.text)) | F.rlike(F.col("summary"), F.lit(q.text))
    if q.kind == "fuzzy":
        both = F.array_union(words(name), words(summary))
        near = lambda t: F.exists(both, lambda w: F.levenshtein(F.rtrim(w, F.lit(".,;:")), F.lit(t), 2) >= 0)
        return reduce(lambda a, b: a & b, [near(t) for t in text.split()])
    return reduce(lambda a, b: a | b, [name.contains(t) | summary.contains(t) for t in text.split()])


def filtered(df: DataFrame, q: Query) -> DataFrame:
    """Filters stay in the plan as plain predicates, so they reach the scan."""
    for col, values in (("jurisdiction", q.jurisdictions), ("court", q.courts), ("status", q.statuses), ("court_level", q.levels), ("id", q.ids)):
        if values:
            df = df.filter(F.col(col).isin(*values))
    if q.start:
        df = df.filter(F.col("decision_date") >= F.lit(q.start).cast("timestamp"))
    if q.end:
        df = df.filter(F.col("decision_date") <= F.lit(q.end).cast("timestamp"))
    if q.min_quality > 0:
        df = df.filter(F.col("quality_score") >= q.min_quality)
    return df.filter(matches(q))


def relevance(text: str) -> Column:
    """Mean over the terms of what each finds, raised by quality; no text: 1."""
    terms = text.lower().split()
    if not terms:
        return F.lit(1.0)
    hit = lambda c, t, w: F.when(F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t), w).otherwise(0.0)
    total = reduce(lambda a, b: a + b, [hit("case_name", t, NAME) + hit("summary", t, SUMMARY) for t in terms])
    return total / len(terms) * (1 + F.coalesce("quality_score", F.lit(0.0)))


def search(df: DataFrame, q: Query) -> DataFrame:
    ranked = filtered(df, q).withColumn("score", relevance(q.text))
    key = {"relevance": F.col("score")}.get(q.sort, F.col(q.sort) if q.sort in df.columns else F.col("score"))
    return ranked.orderBy(key.desc() if q.descending else key.asc(), "id").offset(q.offset).limit(q.limit)


def facets(df: DataFrame, q: Query, top: int = 20) -> DataFrame:
    """The `top` values of each facet over all matches: facet, value, n. One pass: the facets are unpivoted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in q.facets]))
    counts = filtered(df, q).select(pairs.alias("x")).filter("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("facet").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("rank")


def snippet(text: Column, terms: list[str], size: int) -> Column:
    """Text round the first term found, each term in <em> as it is in lower case or with a capital; null if none."""
    low = F.lower(text)
    at = reduce(F.least, [F.when(F.locate(t, low) > 0, F.locate(t, low)) for t in terms], F.lit(None).cast("int")) if len(terms) > 1 else F.when(F.locate(terms[0], low) > 0, F.locate(terms[0], low))
    begin = F.greatest(at - 51, F.lit(0))
    end = F.least(at - 1 + size, F.length(text))
    out = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(text, begin + 1, end - begin), F.when(end < F.length(text), "...").otherwise(""))
    for t in terms:
        for form in dict.fromkeys((t, t.capitalize())):
            out = F.replace(out, F.lit(form), F.lit(f"<em>{form}</em>"))
    return F.when(at.isNotNull(), out)


def similarity(query: str, text: Column) -> Column:
    low, q = F.lower(text), query.lower()
    return F.when(low.startswith(q), 1.0 / (F.length(text) - len(q) + 1)).when(low.contains(q), 0.5 / F.length(text)).otherwise(0.1)


def suggest(df: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Case names and courts that contain the text: kind, value, n, score."""
    if len(text.encode()) < 2:
        return df.select(F.lit("").alias("kind"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score")).limit(0)
    parts = []
    for kind, column, weight in (("case", "case_name", 2.0), ("court", "court", 1.0)):
        c = F.col(column)
        part = df.filter(F.lower(c).contains(text.lower())).groupBy(c.alias("value")).agg(F.count("*").alias("n"))
        parts.append(part.select(F.lit(kind).alias("kind"), "value", "n", (similarity(text, F.col("value")) * weight).alias("score")))
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("score").desc(), "kind", "value").limit(limit)


def spelling(dictionary: DataFrame, column: str, term: str) -> DataFrame:
    """Words of the dictionary within two edits of the term, or the term alone if it is there."""
    d = dictionary.select(F.lower(F.col(column)).alias("word")).distinct().withColumn("distance", F.levenshtein("word", F.lit(term.lower())))
    exact = d.agg(F.coalesce(F.max(F.col("distance") == 0), F.lit(False)).alias("exact"))
    return d.filter("distance <= 2").crossJoin(F.broadcast(exact)).filter("distance = 0 or not exact").select("word", "distance")


#: Courts and concepts offered while typing (fixed values).
OFFERED_COURTS = ("Supreme Court", "Court of Appeal", "High Court", "District Court", "Magistrates Court", "Federal Court", "Circuit Court", "Crown Court", "County Court")
OFFERED_CONCEPTS = (
    "constitutional law", "contract law", "criminal law", "tort law", "property law", "family law", "employment law", "intellectual property", "administrative law", "tax law",
    "due process", "judicial review", "habeas corpus", "negligence", "breach of contract", "damages", "injunction", "precedent", "stare decisis", "jurisdiction",
)


def listed(df: DataFrame, judges=(), concepts=(), parties=(), has_pdf: bool | None = None) -> DataFrame:
    """Cases with any of the judges, any of the concepts, any of the parties, and with a PDF or without."""
    for col, values in (("judges", judges), ("legal_concepts", concepts), ("parties", parties)):
        if values:
            df = df.filter(F.arrays_overlap(col, F.array(*map(F.lit, values))))
    if has_pdf is not None:
        df = df.filter((F.coalesce("pdf_url", F.lit("")) != "") == has_pdf)
    return df


def full_relevance(text: str) -> Column:
    """relevance() with full text and concepts: each matching concept counts. Repeated terms count again."""
    terms = text.lower().split()
    if not terms:
        return F.lit(1.0)
    hit = lambda c, t, w: F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t)), w).otherwise(0.0)
    named = lambda t: F.size(F.filter(F.coalesce("legal_concepts", F.array().cast("array<string>")), lambda c: F.contains(F.lower(c), F.lit(t)))) * CONCEPT
    total = reduce(lambda a, b: a + b, [hit("case_name", t, NAME) + hit("summary", t, SUMMARY) + hit("full_text", t, FULL_TEXT) + named(t) for t in terms])
    return total / len(terms) * (1 + F.coalesce("quality_score", F.lit(0.0)))


def highlighted(text: Column, terms: list[str], size: int) -> Column:
    """snippet(), or without a match the beginning of the text."""
    start = F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
    return F.coalesce(snippet(text, terms, size), start)


def highlights(text: str) -> Column:
    """Of name (100 characters) and summary (200), those that hold a term, as snippets."""
    terms = text.lower().split()
    each = [F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(t)) for t in terms]), snippet(F.col(c), terms, n)) for c, n in (("case_name", 100), ("summary", 200))]
    return F.array_compact(F.array(*each))


def ordered(df: DataFrame, by: str, descending: bool, limit: int = 0, offset: int = 0) -> DataFrame:
    """By one of the table's columns, ties by id; no limit: all. Other names are refused."""
    if by not in df.columns:
        raise ValueError(f"unknown column {by}")
    out = df.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first(), "id").offset(offset)
    return out.limit(limit) if limit else out


def text_index(df: DataFrame) -> DataFrame:
    """term, id, n, size: an inverted index of name, summary and full text. Stored by term, it serves all_terms and
    any_term without reading texts; it is rebuilt for the cases of a batch by anti-joining their ids."""
    terms = F.filter(F.split(F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("case_name", "summary", "full_text")))), "[^a-z0-9]+"), lambda t: t != "")
    rows = df.select("id", terms.alias("t")).select("id", F.size("t").alias("size"), F.explode("t").alias("term"))
    return rows.groupBy("term", "id", "size").agg(F.count("*").alias("n"))


def indexed_search(index: DataFrame, cases: DataFrame, text: str, every: bool, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, matched, rank of the cases that hold every term, or any, ranked by BM25. The corpus' totals come from the
    index; the postings of the terms alone are read from it."""
    terms = sorted(set(t for t in re.split("[^a-z0-9]+", text.lower()) if t))
    totals = cases.agg(F.count("*").alias("n_docs")).crossJoin(index.select("id", "size").distinct().agg(F.avg("size").alias("mean")))  # one row each
    hits = index.filter(F.col("term").isin(*terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    hits = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    out = hits.groupBy("id").agg(F.count("*").alias("matched"), F.sum(part).alias("rank"))
    return out.filter(F.col("matched") == len(terms)) if every else out


def ilike_search(df: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Name, number or full text like %text%, without regard to case; % and _ in the text are wildcards."""
    like = reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in ("case_name", "case_number", "full_text")])
    return df.filter(like).orderBy("id").limit(limit)


def page(df: DataFrame, limit: int = 20, offset: int = 0, most: int = 100) -> DataFrame:
    """A page by id with total and has_more; the limit is at most `most`."""
    limit = min(limit, most)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy("id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row
    return rows.withColumn("has_more", F.lit(offset) + F.least(F.lit(limit), F.col("total") - offset) < F.col("total"))


def suggestions(df: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """kind, value, score: case names (weight 2), judges (1.5), courts and concepts (fixed lists), best first."""
    spark, low = df.sparkSession, text.lower()
    if len(text.encode()) < 2:
        return spark.createDataFrame([], "kind string, value string, score double")
    fixed = spark.createDataFrame([("court", c) for c in OFFERED_COURTS] + [("concept", c) for c in OFFERED_CONCEPTS], "kind string, value string")
    names = df.select(F.lit("case").alias("kind"), F.col("case_name").alias("value")).distinct()
    judges = df.select(F.lit("judge").alias("kind"), F.explode("judges").alias("value")).distinct()
    weight = F.when(F.col("kind") == "case", 2.0).when(F.col("kind") == "judge", 1.5).otherwise(1.0)
    rows = names.unionByName(judges).unionByName(fixed).filter(F.contains(F.lower("value"), F.lit(low)))
    return rows.select("kind", "value", (similarity(text, F.col("value")) * weight).alias("score")).orderBy(F.col("score").desc(), "kind", "value").limit(limit)


def popular(history: DataFrame, limit: int = 10) -> DataFrame:
    """query, n, last_at of a log of searches (user, query, ts), most frequent first."""
    return history.groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("last_at")).orderBy(F.col("n").desc(), "query").limit(limit)


def recent(history: DataFrame, user, limit: int = 10) -> DataFrame:
    return history.filter(F.col("user") == user).orderBy(F.col("ts").desc(), "query").limit(limit)


def in_dictionary(words_df: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """words_df (word) with known: whether its lower-cased form is in the dictionary's column."""
    d = dictionary.select(F.lower(F.col(column)).alias("_w")).distinct().withColumn("_known", F.lit(True))
    return words_df.join(d, F.lower("word") == F.col("_w"), "left").select("word", F.coalesce("_known", F.lit(False)).alias("known"))


def concept_facet(df: DataFrame, top: int = 20) -> DataFrame:
    return df.select(F.explode("legal_concepts").alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(top)


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The cases of a batch of ids (id), missing ones skipped."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def robots_allowed(paths: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """paths (host, path) with allowed. rules (host, agent, allow, pattern): of those for the agent by its name, else for
    names it contains and for *, any allow that matches wins, then any disallow; without a match it is allowed. Patterns
    may have one * anywhere, else they are prefixes."""
    name = agent.lower()
    mine = rules.withColumn("exact", F.lower("agent") == name).filter(F.col("exact") | (F.col("agent") == "*") | F.contains(F.lit(name), F.lower("agent")))
    best = mine.groupBy("host").agg(F.max("exact").alias("any_exact"))
    mine = mine.join(best, "host").filter(F.col("exact") == F.col("any_exact")).select("host", "allow", F.split(F.concat("pattern", F.when(F.contains("pattern", F.lit("*")), "").otherwise("*")), r"\*").alias("ends"))
    hit = F.startswith("path", F.get("ends", F.lit(0))) & F.endswith("path", F.get("ends", F.lit(1)))
    ways = paths.join(F.broadcast(mine), "host").filter(hit).groupBy("host", "path").agg(F.max("allow").alias("allow"))
    return paths.join(ways, ["host", "path"], "left").select("host", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))
