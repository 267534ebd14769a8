"""Validation stages and quality scores of whole cases, as expressions that one pass computes together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from . import tiles

#: Words that mark a placeholder text (fixed values).
PLACEHOLDERS = ("lorem ipsum", "test", "example", "placeholder", "todo", "tbd")
#: Forms of case numbers (fixed values).
NUMBER_FORMS = (r"^\d+/\d+$", r"^\[\d+\]\s+\w+\s+\d+$", r"^\d+\s+\w+\.?\s*\d*\s+\d+$", r"^\w+-\d+-\d+$", r"^\d{4}-\d+$")
CORE = ("id", "case_number", "case_name", "court", "jurisdiction")
IMPORTANT = ("decision_date", "summary", "court_level")
ENRICHED = ("full_text", "parties", "judges", "legal_concepts", "citations", "url", "pdf_url")
LISTS = ("parties", "judges", "legal_concepts", "citations")


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def filled(name: str) -> Column:
    """Whether a field holds something: text, list, level above 0 or date."""
    if name in LISTS:
        return F.size(F.coalesce(F.col(name), F.array().cast("array<string>"))) > 0
    if name == "court_level":
        return F.coalesce(F.col(name), F.lit(0)) > 0
    if name.endswith("_date"):
        return F.col(name).isNotNull()
    return text(name) != ""


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _one(condition: Column, weight: float = 1.0) -> Column:
    return F.when(condition, weight).otherwise(0.0)


def has_run(value: Column, n: int = 5) -> Column:
    """Whether a character stands n times in a row."""
    return F.rlike(value, F.lit(rf"(?s)(.)\1{{{n - 1}}}"))


def text_quality(value: Column, least: int, most: int) -> Column:
    """0 to 1, by the text without outer blanks: empty 0, short 0.3, long 0.8; less 0.2 for a run of 5 equal characters,
    0.1 for capitals only (beyond 20 bytes), 0.3 for each placeholder word, 0.2 for over 30% special characters."""
    t = F.trim(F.coalesce(value, F.lit("")), F.lit(" \t\n\r"))
    size = F.octet_length(t)
    special = F.length(F.regexp_replace(t, r"[A-Za-z0-9 ]", "")) / F.greatest(size, F.lit(1))
    off = _one(has_run(t), 0.2) + _one((F.upper(t) == t) & (size > 20), 0.1) + _one(special > 0.3, 0.2)
    off = off + _sum([_one(F.contains(F.lower(t), F.lit(p)), 0.3) for p in PLACEHOLDERS])
    graded = F.when(size < least, 0.3).when(size > most, 0.8).otherwise(F.greatest(1.0 - off, F.lit(0.0)))
    return F.when(F.coalesce(value, F.lit("")) == "", 0.0).otherwise(graded)


def completeness() -> Column:
    """Share of the fifteen fields that are filled."""
    return _sum([_one(filled(c)) for c in (*CORE, *IMPORTANT, *ENRICHED)]) / 15


def _mean(checks: list[tuple[Column, Column]]) -> Column:
    """Mean of the scores of the checks that apply; 0.5 if none does."""
    n = _sum([_one(applies) for applies, _ in checks])
    total = _sum([F.when(applies, score).otherwise(0.0) for applies, score in checks])
    return F.when(n > 0, total / n).otherwise(0.5)


def content_quality() -> Column:
    parties = F.size(F.coalesce(F.col("parties"), F.array().cast("array<string>")))
    checks = [(filled(c), text_quality(F.col(c), a, b)) for c, a, b in (("case_name", 10, 200), ("summary", 50, 5000), ("full_text", 100, 100_000))]
    return _mean([*checks, (parties > 0, F.when(parties > 1, 1.0).otherwise(0.5)), (filled("judges"), F.lit(1.0))])


def metadata_quality(as_of: str) -> Column:
    now, day = F.lit(as_of).cast("timestamp"), F.col("decision_date")
    recent = (day < now) & (day > F.add_months(now, -2400).cast("timestamp"))
    tenth = lambda c: F.least(F.size(c) / 10, F.lit(1.0))
    level = F.coalesce(F.col("court_level"), F.lit(0)).between(1, 3)
    return _mean([
        (filled("decision_date"), F.when(recent, 1.0).otherwise(0.3)), (level, F.lit(1.0)), (filled("jurisdiction"), F.lit(1.0)), (filled("court_type"), F.lit(1.0)),
        (filled("legal_concepts"), tenth("legal_concepts")), (filled("citations"), tenth("citations")), (filled("source_database"), F.lit(1.0)),
    ])


def quality(df: DataFrame, as_of: str) -> DataFrame:
    """Adds completeness, content, metadata, quality (their mean), quality_valid and quality_warnings."""
    out = df.withColumns({"completeness": completeness(), "content": content_quality(), "metadata": metadata_quality(as_of)})
    out = out.withColumn("quality", (F.col("completeness") + F.col("content") + F.col("metadata")) / 3)
    codes = F.array(F.when(F.col("quality") < 0.7, "LOW_QUALITY"), F.when(F.col("completeness") < 0.6, "INCOMPLETE_DATA"))
    return out.withColumns({"quality_valid": F.col("quality") >= 0.5, "quality_warnings": F.array_compact(codes)})


def number_valid(value: Column) -> Column:
    """A known form, or some digit and 4 to 50 bytes."""
    forms = reduce(lambda a, b: a | b, [F.rlike(value, F.lit(p)) for p in NUMBER_FORMS])
    return forms | (F.rlike(value, F.lit(r"\d")) & F.octet_length(value).between(4, 50))


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in pairs)))


def structural() -> tuple[Column, Column]:
    """Codes of errors (required fields, names over 500 bytes) and warnings (summaries over 10,000 bytes)."""
    errors = [(F.trim(text(c)) == "", f"{c}:REQUIRED") for c in ("case_name", "court", "jurisdiction")]
    return _codes(*errors, (F.octet_length(text("case_name")) > 500, "case_name:TOO_LONG")), _codes((F.octet_length(text("summary")) > 10_000, "summary:TOO_LONG"))


def semantic(as_of: str) -> tuple[Column, Column]:
    now, day = F.lit(as_of).cast("timestamp"), F.col("decision_date")
    blank = F.transform(F.filter(F.coalesce(F.col("parties"), F.array().cast("array<string>")), lambda p: F.trim(p) == ""), lambda p: F.lit("parties:EMPTY_VALUE"))
    warnings = _codes(
        (day < F.add_months(now, -2400).cast("timestamp"), "decision_date:SUSPICIOUS_DATE"), (filled("case_number") & ~number_valid(text("case_number")), "case_number:INVALID_FORMAT"),
        (~F.coalesce(F.col("court_level"), F.lit(0)).between(1, 3), "court_level:INVALID_VALUE"),
    )
    return _codes((day > now, "decision_date:INVALID_DATE")), F.concat(warnings, blank)


def business() -> Column:
    """Codes of the six rules that a case breaks."""
    court, level = F.lower(text("court")), F.coalesce(F.col("court_level"), F.lit(0))
    concepts = F.coalesce(F.col("legal_concepts"), F.array().cast("array<string>"))
    criminal = F.exists(concepts, lambda c: F.contains(F.lower(c), F.lit("criminal law")) | F.contains(F.lower(c), F.lit("criminal procedure")))
    parties = F.size(F.coalesce(F.col("parties"), F.array().cast("array<string>")))
    return _codes(
        (F.contains(court, F.lit("supreme")) & (level != 3), "supreme:RULE_VIOLATION"), (F.contains(court, F.lit("appeal")) & (level != 2), "appeal:RULE_VIOLATION"),
        (~filled("pdf_url") & filled("url"), "pdf_url:MISSING_RELATED_FIELD"), (criminal & (parties < 2), "parties:RULE_VIOLATION"),
        (~filled("summary") & (level >= 2), "summary:MISSING_RECOMMENDED_FIELD"), (~filled("legal_concepts"), "legal_concepts:MISSING_ENRICHMENT"),
    )


def validated(df: DataFrame, as_of: str) -> DataFrame:
    """Adds errors, warnings and score of each row-wise stage, and valid, score and should_reject of all of them.

    Structural errors make that stage's score 0; a warning costs 0.05 there, 0.05 in the semantic stage (an error 0.2)
    and 0.03 in the business stage; quality is its own score. All must be valid; the score is the mean. A case is to be
    rejected if it has structural errors or its quality isn't valid."""
    s_errors, s_warnings = structural()
    m_errors, m_warnings = semantic(as_of)
    out = quality(df, as_of).withColumns({"s_errors": s_errors, "s_warnings": s_warnings, "m_errors": m_errors, "m_warnings": m_warnings, "b_warnings": business()})
    n = lambda c: F.size(c)
    floor = lambda x: F.greatest(x, F.lit(0.0))
    out = out.withColumns({
        "s_score": F.when(n("s_errors") > 0, 0.0).otherwise(floor(1.0 - 0.05 * n("s_warnings"))), "m_score": floor(1.0 - 0.2 * n("m_errors") - 0.05 * n("m_warnings")),
        "b_score": floor(1.0 - 0.03 * n("b_warnings")),
    })
    return out.withColumns({
        "valid": (n("s_errors") == 0) & (n("m_errors") == 0) & F.col("quality_valid"), "score": (F.col("s_score") + F.col("m_score") + F.col("b_score") + F.col("quality")) / 4,
        "critical": F.concat("s_errors", "m_errors"), "should_reject": (n("s_errors") > 0) | ~F.col("quality_valid"),
    })


def batch_summary(reports: DataFrame) -> DataFrame:
    """total, valid, invalid, mean score and completeness; reports may be missing (null score), and still count."""
    return reports.agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("valid", F.lit(False))).alias("valid"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("invalid"),
        F.round(F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*"), 6).alias("mean_score"), F.round(F.sum(F.coalesce("completeness", F.lit(0.0))) / F.count("*"), 6).alias("mean_completeness"),
    )


def completeness_histogram(df: DataFrame) -> DataFrame:
    """bucket, n of the share of filled fields."""
    c = F.col("completeness")
    bucket = F.when(c >= 0.9, "90-100").when(c >= 0.8, "80-90").when(c >= 0.7, "70-80").when(c >= 0.6, "60-70").otherwise("<60")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def model_problems(df: DataFrame) -> Column:
    """Codes of what the record model forbids: blank required fields, numbers of under 3 bytes or without a letter or
    digit, addresses that aren't http, decisions before filing, levels beyond 1 to 5."""
    number = text("case_number")
    return _codes(
        *((~filled(c), f"{c}:REQUIRED") for c in ("id", "case_name", "court", "jurisdiction")), ((F.octet_length(number) < 3) | ~F.rlike(number, F.lit("[a-zA-Z0-9]")), "case_number:INVALID"),
        (filled("url") & ~F.rlike(F.col("url"), F.lit("^https?://")), "url:INVALID"), (F.col("decision_date") < F.col("filing_date"), "decision_date:BEFORE_FILING"),
        (~F.coalesce(F.col("court_level"), F.lit(0)).between(1, 5), "court_level:INVALID"),
    )


def field_score() -> Column:
    """Seven required fields weigh 1, nine others 0.5, over 11.5."""
    required = [_one(filled(c)) for c in ("id", "case_number", "case_name", "decision_date", "court", "jurisdiction", "url")]
    others = [_one(filled(c), 0.5) for c in ("filing_date", "summary", "full_text", "judges", "citations", "legal_concepts", "outcome", "chief_judge", "parties")]
    return _sum(required + others) / 11.5


def case_hash() -> Column:
    """SHA-256 of lower-cased number and name, court, jurisdiction and, if known, the day of decision."""
    day = F.when(F.col("decision_date").isNotNull(), F.concat(F.lit("|"), F.date_format("decision_date", "yyyy-MM-dd"))).otherwise("")
    return F.sha2(F.concat(F.concat_ws("|", F.lower(text("case_number")), F.lower(text("case_name")), text("court"), text("jurisdiction")), day), 256)


def first_of_each(df: DataFrame, order: str = "id") -> DataFrame:
    """One row of each hash, the first by order. For a stream, dedupe case_hash() within a watermark instead."""
    w = Window.partitionBy("hash").orderBy(order)
    return df.withColumn("hash", case_hash()).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def missing_fields(names: tuple[str, ...] = ("id", "case_number", "case_name", "decision_date", "court", "jurisdiction", "url")) -> Column:
    return F.array_compact(F.array(*(F.when(~filled(c), F.lit(c)) for c in names)))


def is_complete() -> Column:
    return F.size(missing_fields()) == 0


def clamped(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


_EQUAL, _WORDED = ("case_number", "court", "jurisdiction"), ("case_name", "summary")


def compared() -> list[Column]:
    """What similarity reads of a case, none of it null: has is a bit for each field that is there. The words of a text are
    64-bit hashes, which are intersected as plain numbers; mask has a bit for each hash of 64, spare is how many words share
    a bit with another."""
    out = [F.coalesce(f, F.lit("")).alias(f) for f in _EQUAL]
    there = [text(f) != "" for f in (*_EQUAL, *_WORDED)] + [F.col("decision_date").isNotNull()]
    for f in _WORDED:
        words = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.lower(text(f)), r"\s+"), lambda t: t != ""), lambda t: F.xxhash64(t))))
        bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(w, F.lit(64)).cast("int"))
        mask = F.aggregate(words, F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(bit(w)))
        zero = lambda c, kind="int": F.coalesce(c, F.lit(0).cast(kind))
        out += [words.alias(f), zero(F.size(words)).alias(f"{f}_n"), zero(mask, "long").alias(f"{f}_mask"), zero(F.size(words) - F.bit_count(mask)).alias(f"{f}_spare")]
    day = F.coalesce(F.unix_date(F.col("decision_date").cast("date")), F.lit(0))
    return [*out, day.alias("day"), _sum([F.when(c, 1 << k).otherwise(0) for k, c in enumerate(there)]).alias("has")]


def similarity(a: str, b: str, bound: bool = False) -> Column:
    """Of the columns compared() of frames a and b: mean of what both have. Equality of number, court and jurisdiction,
    Jaccard index of the words of name and summary, closeness of the days of decision (a year apart: 0). bound: what it
    can't exceed, from counts and masks of words alone; the same sums in the same order, so rounding can't put it below."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))

    def jaccard(f: str) -> Column:
        bits = x(f"{f}_mask").bitwiseAND(y(f"{f}_mask"))
        exact = F.when(bits == 0, 0).when(x(f) == y(f), x(f"{f}_n")).otherwise(F.size(F.array_intersect(x(f), y(f))))
        shared = F.bit_count(bits) + F.least(x(f"{f}_spare"), y(f"{f}_spare")) if bound else exact
        return shared / F.greatest(x(f"{f}_n") + y(f"{f}_n") - shared, F.lit(1))

    both = x("has").bitwiseAND(y("has"))
    equal = [_one((x(f) == y(f)) & (x(f) != "")) for f in _EQUAL]
    near = F.when(both >= 32, F.greatest(1.0 - F.abs(x("day") - y("day")) / 365, F.lit(0.0))).otherwise(0.0)
    return _sum([*equal, *map(jaccard, _WORDED), near]) / F.greatest(F.bit_count(both), F.lit(1))


def similar_pairs(df: DataFrame, block: list[Column], least: float, tile: int = 2000) -> DataFrame:
    """left, right (left < right), similarity of all pairs that agree on a blocking key and are at least that similar;
    ids are unique. A pair that agrees on several keys is made at the least of them, and scored where it is made: only
    results leave the join. The rows of a key with over `tile` are dealt into tiles, every two of which meet on their own and
    are scored by arrays (a row at a time, Spark's join takes about 1 us of CPU a pair),
    in a stated number of partitions: by their bytes, which don't tell the pairs, Spark would put them into a few tasks."""
    fields = ("id", *_EQUAL, *_WORDED, "decision_date")
    keys = F.array_sort(F.array_distinct(F.array_compact(F.array(*block))))
    keyed = df.select(*fields, keys.alias("keys")).select(*fields, "keys", F.explode("keys").alias("key"))
    large = F.broadcast(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    row = ("key", "id", F.filter("keys", lambda k: k < F.col("key")).alias("before"), *compared())

    def scored(left: DataFrame, right: DataFrame, on: list[str], order: Column) -> DataFrame:
        """The condition holds the bound alone, so that its code stays small enough to be compiled; explode keeps what
        follows out of it."""
        same = reduce(lambda a, b: a & b, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on])
        pairs = left.alias("l").join(right.alias("r"), same & order & (similarity("l", "r", True) >= least))
        exact = F.explode(F.array(F.when(~F.arrays_overlap("l.before", "r.before"), similarity("l", "r"))))
        return pairs.select(F.least("l.id", "r.id").alias("left"), F.greatest("l.id", "r.id").alias("right"), exact.alias("similarity")).filter(F.col("similarity") >= least)

    few = keyed.join(large, "key", "left_anti").repartition("key").select(*row)
    many = keyed.join(large, "key").select(*row, "tiles", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("mine"))
    left = many.withColumns({"i": F.col("mine"), "j": F.explode(F.sequence("mine", F.col("tiles") - 1))})
    right = many.withColumns({"i": F.explode(F.sequence(F.lit(0), "mine")), "j": F.col("mine")})
    each = F.col("l.id") < F.col("r.id")
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    cell, kind = ("key", "i", "j"), df.schema["id"].dataType
    cols = (*cell, "id", "before", *_EQUAL, *_WORDED, "day", "has")
    left, right = (side.select(*(F.col(c).alias(c) for c in cols)).repartition(n, *cell).groupBy(*cell) for side in (left, right))
    out = StructType([StructField("left", kind), StructField("right", kind), StructField("similarity", DoubleType())])
    arrow = to_arrow_schema(out)
    tiled = left.cogroup(right).applyInArrow(lambda a, b: tiles.pairs(a, b, least, _EQUAL, _WORDED, arrow), out)
    return scored(few, few, ["key"], each).unionByName(tiled)


def merge_map(groups: DataFrame) -> DataFrame:
    """groups (ids, best) -> gone, into: which case each duplicate is merged into; the least survivor, if several."""
    each = groups.select(F.explode("ids").alias("gone"), F.col("best").alias("into")).filter("gone <> into")
    return each.groupBy("gone").agg(F.min("into").alias("into"))
