"""Courts and jurisdictions: the court dimension, fallbacks by name, rules of a jurisdiction, and the enriched case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .enrichment import first_hit, procedural

#: name, abbreviation, jurisdiction, level (3 supreme, 2 appellate, 1 trial), parent's abbreviation (fixed values). A court
#: is precedential unless it is a trial court; its type follows from its level.
COURTS = [
    ("Supreme Court of the United States", "SCOTUS", "United States", 3, None),
    ("U.S. Court of Appeals", "Circuit", "United States", 2, "SCOTUS"),
    ("U.S. District Court", "District", "United States", 1, "Circuit"),
    ("UK Supreme Court", "UKSC", "United Kingdom", 3, None),
    ("Court of Appeal (England & Wales)", "EWCA", "United Kingdom", 2, "UKSC"),
    ("High Court (England & Wales)", "EWHC", "United Kingdom", 1, "EWCA"),
    ("Supreme Court of Canada", "SCC", "Canada", 3, None),
    ("Federal Court of Appeal", "FCA", "Canada", 2, "SCC"),
    ("High Court of Australia", "HCA", "Australia", 3, None),
    ("Federal Court of Australia", "FCA", "Australia", 2, "HCA"),
    ("Court of Final Appeal", "HKCFA", "Hong Kong", 3, None),
    ("Court of Appeal", "HKCA", "Hong Kong", 2, "HKCFA"),
    ("Supreme Court of India", "SCI", "India", 3, None),
    ("High Court", "HC", "India", 2, "SCI"),
    ("Supreme Court of New Zealand", "NZSC", "New Zealand", 3, None),
    ("Court of Appeal of New Zealand", "NZCA", "New Zealand", 2, "NZSC"),
    ("Constitutional Court of South Africa", "ZACC", "South Africa", 3, None),
    ("Supreme Court of Appeal of South Africa", "ZASCA", "South Africa", 2, "ZACC"),
    ("Court of Appeal of Singapore", "SGCA", "Singapore", 3, None),
    ("High Court of Singapore", "SGHC", "Singapore", 1, "SGCA"),
]
#: jurisdiction, pattern of its case numbers, required fields (fixed values).
RULES = [
    ("United States", r"\d+\s+[A-Z]\.?\s*\d+", ["case_number", "court"]),
    ("United Kingdom", r"\[\d{4}\]\s+[A-Z]+\s+\d+", ["case_number", "court"]),
    ("Canada", r"\d{4}\s+[A-Z]+\s+\d+", ["case_number", "court"]),
    ("Australia", r"\[\d{4}\]\s+[A-Z]+\s+\d+", ["case_number", "court"]),
    ("India", None, ["case_number"]),
]
#: Words of a court's name by level and by type where the dimension doesn't know it, first hit wins (fixed values).
LEVEL_WORDS = ((3, ("supreme", "final appeal")), (2, ("appeal", "appellate")), (1, ("high court",)), (0, ("district", "magistrate")))
TYPE_WORDS = (("supreme", ("supreme", "final")), ("appellate", ("appeal",)), ("military", ("military", "court-martial")), ("administrative", ("administrative",)), ("specialized", ("tax", "family", "bankruptcy")))
TYPES = {3: "supreme", 2: "appellate", 1: "trial"}
#: Case types with the words that show them, first hit wins (fixed values).
CASE_TYPES = (
    ("criminal", ("criminal", "prosecution", "defendant", "guilty", "plea", "sentence", "indictment", "conviction", "acquittal", "murder", "assault", "robbery", "theft", "fraud", "drug", "narcotics", "felony", "misdemeanor", "bail", "parole", "probation", "r v ", " v regina", " v the queen")),
    ("constitutional", ("constitutional", "bill of rights", "charter", "fundamental rights", "separation of powers", "judicial review", "unconstitutional", "constitution", "amendment")),
    ("administrative", ("administrative", "regulatory", "agency", "commission", "tribunal", "board of", "minister", "secretary of state", "immigration", "asylum", "license", "permit")),
    ("tax", ("tax", "revenue", "inland revenue", "irs", "vat", "duty", "customs", "excise", "taxation")),
    ("family", ("divorce", "custody", "child support", "alimony", "adoption", "domestic violence", "family law", "matrimonial", "spousal", "parental rights", "guardianship")),
    ("bankruptcy", ("bankruptcy", "insolvency", "liquidation", "receivership", "creditor", "debtor", "chapter 7", "chapter 11")),
    ("employment", ("employment", "unfair dismissal", "discrimination", "wrongful termination", "labor", "workplace", "employee", "employer", "wages", "hours", "harassment", "equal pay")),
    ("intellectual_property", ("patent", "trademark", "copyright", "trade secret", "intellectual property", "infringement", "licensing")),
    ("environmental", ("environmental", "pollution", "clean air", "clean water", "endangered species", "environmental impact", "epa")),
    ("commercial", ("commercial", "business", "corporate", "shareholder", "merger", "acquisition", "securities", "stock")),
    ("tort", ("negligence", "damages", "tort", "personal injury", "malpractice", "defamation", "nuisance", "trespass")),
    ("contract", ("contract", "breach", "agreement", "warranty", "consideration", "offer", "acceptance")),
    ("property", ("property", "real estate", "landlord", "tenant", "lease", "easement", "foreclosure", "title")),
)
#: Jurisdictions by words of a text, first hit wins (fixed values).
PLACES = ("united states", "united kingdom", "canada", "australia", "india", "ireland", "new zealand", "south africa", "singapore", "hong kong")


def court_table(spark: SparkSession) -> DataFrame:
    """The dimension, one row a court; twenty rows, so joins broadcast it."""
    rows = [(n, a, j, level, TYPES[level], p, level > 1) for n, a, j, level, p in COURTS]
    return spark.createDataFrame(rows, "name string, abbreviation string, court_jurisdiction string, level int, type string, parent string, precedential boolean")


def court_keys(spark: SparkSession) -> DataFrame:
    """key (lower-cased name or abbreviation) of each court, the last of those that share one."""
    rows = {}
    for n, a, j, level, p in COURTS:
        rows[a.lower()] = rows[n.lower()] = (n, j, level, TYPES[level], p, level > 1)
    return spark.createDataFrame([(k, *v, k == v[0].lower()) for k, v in rows.items()], "key string, name string, court_jurisdiction string, known_level int, known_type string, parent string, known_precedential boolean, by_name boolean")


def with_court(df: DataFrame, court_col: str = "court") -> DataFrame:
    """df with court_info (name), found_level, found_type, precedential and parent. Names and abbreviations are found
    without regard to case; a level only by the full name, else by words of the name, else that of a trial court. A court
    that isn't known is precedential if its level is above trial."""
    c = F.coalesce(F.col(court_col), F.lit(""))
    level = F.coalesce(*(F.when(_holds(c, words), n) for n, words in LEVEL_WORDS), F.lit(1))
    out = df.join(F.broadcast(court_keys(df.sparkSession)), F.lower(c) == F.col("key"), "left")
    out = out.withColumn("found_level", F.when(F.col("by_name"), F.col("known_level")).otherwise(level))
    out = out.withColumn("found_type", F.coalesce("known_type", first_hit(c, TYPE_WORDS, "trial"))).withColumn("precedential", F.coalesce("known_precedential", F.col("found_level") >= 2))
    return out.withColumnRenamed("name", "court_info").drop("key", "known_level", "known_type", "known_precedential", "by_name", "court_jurisdiction")


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    return F.rlike(F.lower(c), F.lit("|".join(words)))


def parents(spark: SparkSession) -> DataFrame:
    """name, parent_name: each court with the court above it, by the parent's abbreviation in the same jurisdiction."""
    c = court_table(spark)
    up = c.select(F.col("abbreviation").alias("parent"), "court_jurisdiction", F.col("name").alias("parent_name"))
    return c.join(F.broadcast(up), ["parent", "court_jurisdiction"], "left").select("name", "parent_name")


def case_type() -> Column:
    """By name, summary and full text."""
    return first_hit(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("case_name", "summary", "full_text"))), CASE_TYPES, "civil")


def with_rules(df: DataFrame) -> DataFrame:
    """df with citation_valid (null without a pattern or rule) and missing_fields by its jurisdiction's rule, which is
    joined: the pattern of each row comes from the rules' table."""
    rules = df.sparkSession.createDataFrame(RULES, "jurisdiction string, pattern string, required array<string>")
    out = df.join(F.broadcast(rules), "jurisdiction", "left")
    have = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.lit(c)) for c in ("case_number", "court", "decision_date"))))
    out = out.withColumn("citation_valid", F.rlike(F.coalesce("case_number", F.lit("")), F.col("pattern")))
    return out.withColumn("missing_fields", F.coalesce(F.array_except("required", have), F.array().cast("array<string>"))).drop("pattern", "required")


def enriched(df: DataFrame) -> DataFrame:
    """Court, then type, procedure and rules."""
    return with_rules(df.transform(with_court).withColumn("case_type", case_type()).select("*", *procedural(F.concat_ws(" ", "summary", "full_text"))))


def legacy_jurisdiction(text: Column) -> Column:
    return first_hit(text, [(p, (p,)) for p in PLACES], "unknown")
