"""Citations: extraction and normalisation from text, and the citation graph."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats in order of precedence with their patterns (fixed formats).
PATTERNS = {
    "ecli": r"ECLI:[A-Z]{2}:[A-Z]+:\d{4}:\d+",
    "uk": r"\[(\d{4})\]\s+(UKSC|UKPC|EWCA|EWHC|EWFC|EWCOP)\s+(?:Civ|Crim|Admin|Ch|QB|Fam|Pat|Comm|TCC|Admlty)?\s*(\d+)",
    "irish": r"\[(\d{4})\]\s+(IESC|IECA|IEHC|IEIC)\s+(\d+)",
    "australian": r"\[(\d{4})\]\s+(HCA|FCAFC|FCA|NSWCA|VCA|QCA|WASCA|SASCFC|TASFC|ACTCA|NTCA)\s+(\d+)",
    "canadian": r"(\d{4})\s+(SCC|FCA|FC|ONCA|BCCA|ABCA|QCCA|SKCA|MBCA|NSCA|NBCA|PECA|NLCA|NWTCA|NUCA|YKCA)\s+(\d+)",
    "bluebook": r"(\d+)\s+([A-Z][A-Za-z.\s]+)\s+(\d+)\s*\((?:[A-Z][A-Za-z.\s]*\s+)?(\d{4})\)",
    "neutral": r"\[(\d{4})\]\s+([A-Z]{2,})\s+(\d+)",
}
#: Reporters and courts with their standard abbreviations (fixed values).
REPORTERS = {
    "u.s.": "U.S.", "us": "U.S.", "s.ct.": "S. Ct.", "s. ct.": "S. Ct.", "sct": "S. Ct.", "f.2d": "F.2d", "f2d": "F.2d", "f.3d": "F.3d", "f3d": "F.3d",
    "f.supp": "F. Supp.", "fsupp": "F. Supp.", "f.supp.2d": "F. Supp. 2d", "fsupp2d": "F. Supp. 2d", "ac": "A.C.", "a.c.": "A.C.", "ch": "Ch.", "ch.": "Ch.", "qb": "Q.B.", "q.b.": "Q.B.",
    "kb": "K.B.", "k.b.": "K.B.", "wlr": "W.L.R.", "w.l.r.": "W.L.R.", "scr": "S.C.R.", "s.c.r.": "S.C.R.", "fc": "F.C.", "f.c.": "F.C.", "drs": "D.R.S.", "d.r.s.": "D.R.S.",
}
COURT_NAMES = {"USSC": "SCOTUS", "US SUPREME COURT": "SCOTUS", "UK SUPREME COURT": "UKSC", "SUPREME COURT OF CANADA": "SCC"}


def extract(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """citing, raw, format: each distinct citation of a text once, by the first format that reads it."""
    return df.select(F.col(id_col).alias("citing"), F.explode(found(text)).alias("x")).select("citing", "x.raw", "x.format")


def found(text: Column) -> Column:
    """The distinct citations of a text in order of format, then of place: array of struct(raw, format). Within the row,
    so nothing is shuffled; texts without a digit are passed over."""
    def read(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r: F.struct(F.trim(r).alias("raw"), F.lit(kind).alias("format")))

    every = F.when(F.rlike(text, F.lit(r"\d")), F.concat(*(read(f, p) for f, p in PATTERNS.items())))
    first = F.aggregate(every, F.expr("cast(array() as array<struct<raw:string,format:string>>)"), lambda got, x: F.when(F.exists(got, lambda g: g["raw"] == x["raw"]), got).otherwise(F.concat(got, F.array(x))))
    return F.coalesce(first, F.expr("cast(array() as array<struct<raw:string,format:string>>)"))


def components(raw: Column, kind: Column) -> Column:
    """struct(year, court, number, volume, reporter, page, country) of a citation; null where a format has no such part."""
    ex = lambda p, g: F.nullif(F.regexp_extract(raw, p, g), F.lit(""))
    ecli = lambda k: F.get(F.split(raw, ":"), F.lit(k))
    by = lambda blue, other, e: F.when(kind == "ecli", e).when(kind == "bluebook", blue).otherwise(other)
    none, b, n = F.lit(None).cast("string"), PATTERNS["bluebook"], r"\[?(\d{4})\]?\s+([A-Z]+)\s+(?:[A-Z][a-z]+|QB|TCC)?\s*(\d+)"
    return F.struct(
        by(ex(b, 4), ex(n, 1), ecli(3)).alias("year"), by(none, ex(n, 2), ecli(2)).alias("court"), by(none, ex(n, 3), ecli(4)).alias("number"), by(ex(b, 1), none, none).alias("volume"),
        by(F.trim(ex(b, 2)), none, none).alias("reporter"), by(ex(b, 3), none, none).alias("page"), by(none, none, ecli(1)).alias("country"),
    )


def valid(parts: Column, raw: Column) -> Column:
    """Something was read, and a year or a court."""
    return (F.coalesce(raw, F.lit("")) != "") & (parts["year"].isNotNull() | parts["court"].isNotNull())


def normalised_reporter(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in REPORTERS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.regexp_replace(F.trim(c), r"\s+", " "))


def normalised_court(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in COURT_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(c))), F.upper(F.trim(c)))


def four_digits(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 4)


def no_leading_zeros(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "", "").otherwise(F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0")))


def normalised(raw: Column, kind: Column) -> Column:
    """The citation in the standard form of its format; as it is where a part is missing."""
    p = components(raw, kind)
    year, court, number = four_digits(p["year"]), normalised_court(p["court"]), no_leading_zeros(p["number"])
    blue = F.concat(p["volume"], F.lit(" "), normalised_reporter(p["reporter"]), F.lit(" "), p["page"], F.lit(" ("), year, F.lit(")"))
    form = F.when(kind == "bluebook", blue).when(kind == "ecli", F.concat_ws(":", F.lit("ECLI"), p["country"], court, year, number))
    form = form.when(kind == "canadian", F.concat(year, F.lit(" "), court, F.lit(" "), number)).otherwise(F.concat(F.lit("["), year, F.lit("] "), court, F.lit(" "), number))
    return F.coalesce(form, raw)


def extracted(df: DataFrame, id_col: str = "id") -> DataFrame:
    """citing, raw, format, normalised of the valid citations in full text and summary."""
    rows = extract(df, id_col, F.concat_ws(" ", F.coalesce("full_text", F.lit("")), F.coalesce("summary", F.lit(""))))
    rows = rows.filter(valid(components(F.col("raw"), F.col("format")), F.col("raw")))
    return rows.withColumn("normalised", normalised(F.col("raw"), F.col("format")))


def resolved(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """citing, raw, normalised, cited: the least id of the cases whose own number, in standard form, is the citation."""
    own = extract(cases.filter("case_number <> ''"), "id", F.col("case_number"))
    own = own.select(normalised(F.col("raw"), F.col("format")).alias("normalised"), "citing").groupBy("normalised").agg(F.min("citing").alias("cited"))
    return citations.join(own, "normalised", "left").select("citing", "raw", "normalised", "cited")


def shortest_chain(edges: DataFrame, start: str, goal: str, most: int = 20) -> DataFrame:
    """path: ids from start to goal along citations, of least length, then least in order; no row if there is none
    within `most` steps. Both must occur. Each step joins the front with the edges; a node is entered once, by its least
    path, so the front holds at most one row a node."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    spark = edges.sparkSession
    ensure_checkpoints(spark)
    steps = edges.select(F.col("citing").alias("a"), F.col("cited").alias("b")).filter("a <> b").distinct().persist()
    schema = StructType([StructField("id", StringType()), StructField("path", ArrayType(StringType()))])
    known = steps.filter((F.col("a") == start) | (F.col("b") == start)).limit(1).count() and steps.filter((F.col("a") == goal) | (F.col("b") == goal)).limit(1).count()
    if not known:
        return spark.createDataFrame([], schema).select("path")
    front = spark.createDataFrame([(start, [start])], schema)
    seen = front.select("id")
    for _ in range(most):
        if front.filter(F.col("id") == goal).limit(1).count():
            break
        front = front.join(steps, front["id"] == steps["a"]).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        front = front.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti").checkpoint()
        seen = seen.unionByName(front.select("id"))
        if front.isEmpty():
            break
    return front.filter(F.col("id") == goal).select("path")


def depth(edges: DataFrame, start: str, most: int = 12) -> DataFrame:
    """depth: nodes on the longest path of distinct nodes that cites onwards from start, up to `most`; 1 if it cites
    nothing, 0 if it doesn't occur. All such paths are followed, so their number may grow with the branching: `most` bounds
    the length (not the branching), and one more row tells whether it was reached."""
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    steps = edges.select(F.col("citing").alias("a"), F.col("cited").alias("b")).filter("a <> b").distinct()
    there = bool(steps.filter((F.col("a") == start) | (F.col("b") == start)).limit(1).count())
    paths, n = spark.createDataFrame([(start, [start])], "id string, path array<string>"), int(there)
    while there and n < most:
        paths = paths.join(steps, paths["id"] == steps["a"]).filter(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path")).checkpoint()
        if paths.isEmpty():
            break
        n += 1
    return spark.range(1).select(F.lit(n).alias("depth"), F.lit(n >= most).alias("cut_off"))


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder from spark.checkpoint.dir; without one, on a local master only, a temporary folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="casewright-"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, inbound, outbound of every node; edges are a multiset and may name unknown ends."""
    out = edges.groupBy(F.col("citing").alias("id")).agg(F.count("*").alias("outbound"))
    inn = edges.groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("inbound"))
    return nodes.select("id").distinct().join(inn, "id", "left").join(out, "id", "left").select("id", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


def influence(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """id, score: scores start at 1; each round a node gets 1 - damping, and damping times what its citers hand out
    evenly over their edges. Parallel edges count; nothing is redistributed. Parallel edges are summed beforehand, so a
    round moves one row per pair. What a pair gives is counted in whole units of 1e-12, so that the scores don't depend
    on the order in which rows are summed."""
    out = edges.groupBy("citing").agg(F.count("*").alias("degree"))
    pairs = edges.groupBy("citing", "cited").agg(F.count("*").alias("n")).join(out, "citing").select("citing", "cited", (F.col("n") / F.col("degree")).alias("share"))
    ensure_checkpoints(nodes.sparkSession)
    pairs = pairs.checkpoint()  # read each round, made once
    known = nodes.select("id").distinct().checkpoint()
    score = known.withColumn("score", F.lit(1.0))
    for k in range(rounds):
        given = pairs.join(score, pairs["citing"] == score["id"]).groupBy(F.col("cited").alias("id")).agg(F.sum(F.floor(F.col("score") * F.col("share") * 1e12 + 0.5)).alias("units"))
        score = known.join(given, "id", "left").select("id", (F.lit(round(1 - damping, 12)) + damping * (F.coalesce("units", F.lit(0)).cast("double") / 1e12)).alias("score"))
        if k % 3 == 2:
            score = score.checkpoint()
    return score


def neighbourhood(edges: DataFrame, start: str, depth: int = 1, direction: str = "both") -> DataFrame:
    """id, distance of what is reached from start within depth steps (citing, cited or both ways)."""
    ways = {"cited": [("citing", "cited")], "citing": [("cited", "citing")], "both": [("citing", "cited"), ("cited", "citing")]}[direction]
    steps = reduce(DataFrame.unionByName, [edges.select(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ways]).distinct()
    reached = edges.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("distance"))
    front = reached
    for d in range(1, depth + 1):
        front = front.join(steps, front["id"] == steps["a"]).select(F.col("b").alias("id")).distinct().join(reached.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        reached = reached.unionByName(front)
    return reached
