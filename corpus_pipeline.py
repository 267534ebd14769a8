"""A training-data pipeline of five stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.common import sql_words, stored
from casewright.llm.jaccard_join import jaccard_components
from casewright.llm.mixing import mix_sources
from casewright.llm.pieces import encode_pieces
from casewright.llm.quality import fit_quality, score_quality
from casewright.llm.suffix_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' weak labels, doesn't reject."""
    docs = docs.select(*COLUMNS)
    scored = score_quality(docs, fit_quality(docs), score_col="quality_score")
    return scored.filter("quality_score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8: the one with the least doc_id, null
    last, and of rows that repeat it the first. Rows are documents, whether or not they share an id."""
    docs = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = jaccard_components(docs, id_col="row", words=5, percent=80).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    ranked = groups.join(docs.select("row", "doc_id"), "row").select("group", rank.alias("rank"))
    first = ranked.groupBy("group").agg(F.min("rank").alias("first")).select(F.col("first.row").alias("row"))
    return docs.join(first, "row", "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that start in an earlier document are cut out; emptied documents go."""
    out = without_repeats(docs.select(*COLUMNS), length=50, size_col="n_chars")
    return out.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it."""
    out = mix_sources(docs, sql_words(F.col("text")), keep=["text", "lang", "n_chars"])
    out = out.filter("copies > 0").withColumn("one", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), F.col("kept_lang").alias("lang"), "source", F.col("kept_n_chars").alias("n_chars"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and whether decoding gives back the text."""
    out = encode_pieces(docs)
    return out.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("mixing sources", mixture), ("sentencepiece", pieces)]

#: Weak-label fitting, byte passages and piece encoding have no SQL; a test recomputes run()'s rows in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
