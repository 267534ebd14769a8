"""The taxonomy of legal concepts: lookups, extraction from cases, areas of a corpus, related concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .enrichment import concept_scores

#: id, name, area, keywords, importance of 1 to 10 (fixed values).
TAXONOMY = [
    ("const-01", "Freedom of Speech", "constitutional", ["freedom of speech", "first amendment", "expression", "free speech", "censorship"], 9),
    ("const-02", "Due Process", "constitutional", ["due process", "procedural fairness", "natural justice", "fair hearing"], 10),
    ("const-03", "Equal Protection", "constitutional", ["equal protection", "discrimination", "equality", "disparate treatment"], 9),
    ("crim-01", "Mens Rea", "criminal", ["mens rea", "criminal intent", "guilty mind", "intention", "recklessness"], 10),
    ("crim-02", "Actus Reus", "criminal", ["actus reus", "guilty act", "criminal act", "physical element"], 10),
    ("crim-03", "Self-Defense", "criminal", ["self-defense", "self-defence", "defense of person", "justification"], 8),
    ("crim-04", "Reasonable Doubt", "criminal", ["reasonable doubt", "beyond reasonable doubt", "burden of proof", "standard of proof"], 10),
    ("cont-01", "Offer and Acceptance", "contract", ["offer", "acceptance", "agreement", "meeting of minds", "consensus ad idem"], 10),
    ("cont-02", "Consideration", "contract", ["consideration", "quid pro quo", "valuable consideration", "bargain"], 10),
    ("cont-03", "Breach of Contract", "contract", ["breach", "breach of contract", "material breach", "fundamental breach", "repudiation"], 9),
    ("cont-04", "Damages", "contract", ["damages", "compensation", "expectation damages", "reliance damages", "restitution"], 8),
    ("tort-01", "Negligence", "tort", ["negligence", "duty of care", "breach of duty", "reasonable person", "standard of care"], 10),
    ("tort-02", "Causation", "tort", ["causation", "proximate cause", "but-for test", "cause in fact", "foreseeability"], 9),
    ("tort-03", "Defamation", "tort", ["defamation", "libel", "slander", "reputation", "false statement"], 7),
    ("prop-01", "Adverse Possession", "property", ["adverse possession", "squatter's rights", "prescription", "possessory title"], 7),
    ("prop-02", "Easement", "property", ["easement", "right of way", "servitude", "profit à prendre"], 6),
    ("fam-01", "Child Custody", "family", ["custody", "child custody", "parental rights", "best interests of child"], 8),
    ("fam-02", "Divorce", "family", ["divorce", "dissolution", "marriage breakdown", "separation"], 7),
    ("admin-01", "Judicial Review", "administrative", ["judicial review", "administrative review", "ultra vires", "unreasonableness"], 8),
    ("admin-02", "Procedural Fairness", "administrative", ["procedural fairness", "natural justice", "right to be heard", "bias"], 9),
    ("labor-01", "Wrongful Dismissal", "labor", ["wrongful dismissal", "unfair dismissal", "termination", "just cause"], 7),
    ("labor-02", "Collective Bargaining", "labor", ["collective bargaining", "union", "labor agreement", "collective agreement"], 6),
    ("evid-01", "Hearsay", "evidence", ["hearsay", "hearsay rule", "out of court statement", "second-hand evidence"], 8),
    ("evid-02", "Privilege", "evidence", ["privilege", "attorney-client privilege", "solicitor-client privilege", "confidential"], 7),
    ("ip-01", "Copyright Infringement", "intellectual_property", ["copyright", "infringement", "fair use", "fair dealing", "reproduction"], 7),
    ("ip-02", "Patent", "intellectual_property", ["patent", "invention", "novelty", "non-obviousness", "utility"], 6),
    ("tax-01", "Tax Evasion", "tax", ["tax evasion", "tax fraud", "tax avoidance", "evasion"], 7),
    ("env-01", "Environmental Impact Assessment", "environmental", ["environmental impact", "assessment", "environmental assessment", "EIA"], 6),
    ("hr-01", "Discrimination", "human_rights", ["discrimination", "protected grounds", "equality", "human rights violation"], 9),
    ("hr-02", "Freedom from Torture", "human_rights", ["torture", "cruel and unusual", "inhuman treatment", "degrading treatment"], 10),
    ("corp-01", "Fiduciary Duty", "corporate", ["fiduciary duty", "duty of loyalty", "duty of care", "fiduciary"], 8),
    ("corp-02", "Piercing the Corporate Veil", "corporate", ["piercing the veil", "corporate veil", "alter ego", "personal liability"], 7),
]


def concept_table(spark: SparkSession) -> DataFrame:
    """concept_id, name, area, keywords, importance: the lookups by id, area or name are filters on it."""
    return spark.createDataFrame(TAXONOMY, "concept_id string, name string, area string, keywords array<string>, importance int")


def keyword_index(concepts: DataFrame) -> DataFrame:
    """keyword (lower case), concept_id."""
    return concepts.select(F.explode("keywords").alias("k"), "concept_id").select(F.lower("k").alias("keyword"), "concept_id").distinct()


def related(concepts: DataFrame) -> DataFrame:
    """name, other: concepts of one area, without itself."""
    a, b = concepts.select("concept_id", "name", "area"), concepts.select(F.col("concept_id").alias("o"), F.col("name").alias("other"), "area")
    return a.join(F.broadcast(b), "area").filter("concept_id <> o").select("name", "other")


def area_totals(concepts: DataFrame) -> DataFrame:
    """area, n_concepts, n_keywords (distinct, in lower case)."""
    k = concepts.select("area", "concept_id", F.explode("keywords").alias("k"))
    return k.groupBy("area").agg(F.count_distinct("concept_id").alias("n_concepts"), F.count_distinct(F.lower("k")).alias("n_keywords"))


def case_text() -> Column:
    """What one case's concepts are read from; a batch reads batch_text()."""
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("case_name", "summary", "full_text")))


def batch_text() -> Column:
    return F.concat_ws(" ", F.coalesce("full_text", F.lit("")), F.coalesce("summary", F.lit("")))


def extracted(df: DataFrame, text: Column, least: float = 0.3) -> DataFrame:
    """id, concept, area, confidence of the concepts that score at least `least`."""
    return concept_scores(df.select("id", text.alias("_text")), F.col("_text"), [(n, a, k, i) for _, n, a, k, i in TAXONOMY], least).drop("_text")


def written_back(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with legal_concepts: names by falling confidence, then by name; empty where none was found."""
    names = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "concept"))), lambda x: x["concept"]).alias("legal_concepts"))
    return df.drop("legal_concepts").join(names, "id", "left").withColumn("legal_concepts", F.coalesce("legal_concepts", F.array().cast("array<string>")))


def area_distribution(found: DataFrame) -> DataFrame:
    return found.groupBy("area").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_cases"))
