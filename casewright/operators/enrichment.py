"""Enrichment of cases: procedural metadata, courts, document types, jurisdictions, synonyms, concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that decide, first hit wins (fixed values).
APPEAL = ("appeal", "appellant", "appellee", "petition for review")
STAGES = (("motion_to_dismiss", ("motion to dismiss", "dismissal")), ("summary_judgment", ("summary judgment",)), ("trial", ("trial",)), ("sentencing", ("sentencing",)), ("appeal", APPEAL))
DECISIONS = ("affirmed", "reversed", "remanded", "dismissed", "granted", "denied")
COURT_TYPES = (("supreme", ("supreme", "final")), ("appellate", ("appeal",)), ("military", ("military", "court-martial")), ("administrative", ("administrative",)), ("specialized", ("tax", "family", "bankruptcy")))
DOCUMENTS = (("contract", ("contract",)), ("court_decision", ("court decision", "judgment")), ("statute", ("statute", "law")))
SYNONYMS = {
    "contract": ("agreement", "covenant", "accord"),
    "negligence": ("carelessness", "neglect"),
    "damages": ("compensation", "restitution", "reparation"),
    "plaintiff": ("claimant", "complainant"),
    "defendant": ("respondent", "accused"),
    "appeal": ("review", "reconsideration"),
    "judgment": ("decision", "ruling", "verdict"),
    "precedent": ("case law", "authority"),
    "statute": ("law", "act", "legislation"),
    "regulation": ("rule", "ordinance"),
    "injunction": ("restraining order", "prohibition"),
    "liability": ("responsibility", "obligation"),
    "remedy": ("relief", "redress"),
    "jurisdiction": ("authority", "power"),
}
PUNCTUATION = ".,;:!?()[]{}\"'\n\t"


def has_any(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in needles:
        out = out | F.contains(text, F.lit(x))
    return out


def first_hit(text: Column, kinds, default: str | None = None) -> Column:
    """The first kind one of whose words the lower-cased text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(has_any(low, keys), kind) for kind, keys in kinds), F.lit(default))


def procedural(text: Column) -> list[Column]:
    """is_appeal, procedural_stage, decision (null where none shows), unanimous, has_dissent, has_concurrence."""
    low = F.lower(F.coalesce(text, F.lit("")))
    flags = {"unanimous": ("unanimous",), "has_dissent": ("dissent",), "has_concurrence": ("concur",)}
    return [has_any(low, APPEAL).alias("is_appeal"), first_hit(text, STAGES).alias("procedural_stage"), first_hit(text, [(d, (d,)) for d in DECISIONS]).alias("decision"), *(has_any(low, v).alias(k) for k, v in flags.items())]


def court_type(court: Column) -> Column:
    return first_hit(court, COURT_TYPES, "trial")


def document_type(text: Column) -> Column:
    return first_hit(text, DOCUMENTS, "unknown")


def missing_signs(text: Column, required: list[str]) -> Column:
    """missing_<field> for each required field that the text doesn't name, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.transform(F.filter(F.array(*map(F.lit, required)), lambda x: ~F.contains(low, F.lower(x))), lambda x: F.concat(F.lit("missing_"), x))


def expanded(query: Column) -> Column:
    """The words of the lower-cased query in order, each followed by its synonyms."""
    table = F.create_map(*(y for k, v in SYNONYMS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))))
    words = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")))))


def tokens(text: Column) -> Column:
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))
    return F.filter(F.split(low, r"\s+"), lambda w: w != "")


def concept_scores(df: DataFrame, text: Column, taxonomy: list[tuple[str, str, list[str], int]], least: float = 0.3) -> DataFrame:
    """df's rows for each concept that scores at least `least`: concept, area, confidence.

    A keyword weighs its number of words, half as much again where the text holds it whole, nothing where a word is
    missing; the share of all weight, at most 1, is drawn to 1 by the concept's importance. The taxonomy is a
    parameter of the plan and unrolled into expressions: nothing is joined, nothing is shuffled.
    """
    def score(keywords: list[str], importance: int) -> Column:
        got, whole = F.lit(0.0), 0.0
        for k in keywords:
            parts = k.lower().split()
            whole += len(parts)
            got = got + F.when(F.contains(F.col("_low"), F.lit(k.lower())), 1.5 * len(parts)).when(F.forall(F.array(*map(F.lit, parts)), lambda p: F.array_contains(F.col("_tokens"), p)), float(len(parts))).otherwise(0.0)
        part, pull = F.least(got / whole, F.lit(1.0)), importance / 10 * 0.1
        return F.when(got > 0, part * (1 - pull) + pull).otherwise(0.0)

    seen = df.withColumn("_low", F.lower(F.coalesce(text, F.lit("")))).withColumn("_tokens", tokens(text))
    found = F.array(*(F.struct(F.lit(name).alias("concept"), F.lit(area).alias("area"), score(keys, imp).alias("confidence")) for name, area, keys, imp in taxonomy))
    hits = seen.withColumn("_hit", F.explode(F.filter(found, lambda x: x["confidence"] >= least)))
    return hits.select(*df.columns, "_hit.*")
