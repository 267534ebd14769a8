"""Registered queries of citations, courts and compliance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import citations, compliance, courts
from casewright.sources.cases import cases, dockets, edges

#: A policies table for the registered queries.
POLICIES = [
    ("alpha", "https://alpha.example.org", "https://alpha.example.org/terms", True, "Data sourced from Alpha", True, 20, 3),
    ("beta", "https://beta.example.org", "https://beta.example.org/terms", True, "", True, 10, 6),
    ("gamma", "https://gamma.example.org", "", False, "", False, 5, 12),
]
_VALUES = "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in POLICIES) + ") AS p(source_database, base_url, terms_url, requires, attribution_text, allowed, rate_limit, delay_seconds)"
_JOINED = f"(SELECT d.*, p.* EXCLUDE (source_database) FROM dockets d LEFT JOIN {_VALUES} ON d.source_database = p.source_database)"
_COURTS = "(VALUES " + ", ".join(f"('{n}', '{a}', '{j}', {lv}, '{courts.TYPES[lv]}', {'NULL' if p is None else repr(p)}, {k})" for k, (n, a, j, lv, p) in enumerate(courts.COURTS)) + ") AS c(name, abbreviation, court_jurisdiction, level, type, parent, k)"
_NUMBERS = "concat('[', regexp_extract(raw, '(\\d{4})', 1), '] ')"


def _policies(spark):
    return spark.createDataFrame(POLICIES, compliance.POLICY)


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


def _first(c: str, kinds, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(c, words)} THEN {kind if isinstance(kind, int) else repr(kind)}" for kind, words in kinds) + f" ELSE {default} END"


_KEYS = f"(SELECT lower(key) AS key, arg_max(name, k) AS name, arg_max(level, k) AS level, arg_max(type, k) AS type, arg_max(parent, CASE WHEN parent IS NULL THEN -1 ELSE k END) FILTER (true) AS parent, max(lower(name) = lower(key)) AS by_name FROM (SELECT name AS key, name, level, type, parent, k FROM {_COURTS} UNION ALL SELECT abbreviation, name, level, type, parent, k FROM {_COURTS}) GROUP BY 1)"
_LEVEL = _first("court", courts.LEVEL_WORDS, "1")
_COURT = f"SELECT id, name AS court_info, parent, CASE WHEN by_name THEN level ELSE {_LEVEL} END::INT AS found_level, coalesce(type, {_first('court', courts.TYPE_WORDS, repr('trial'))}) AS found_type, coalesce(level > 1, {_LEVEL} >= 2) AS precedential FROM dockets LEFT JOIN {_KEYS} ON lower(court) = key"
_CASE_TYPE = _first("concat_ws(' ', coalesce(case_name, ''), summary, full_text)", courts.CASE_TYPES, "'civil'")
_PATTERN = "CASE jurisdiction " + " ".join(f"WHEN '{j}' THEN regexp_matches(case_number, '{p}')" for j, p, _ in courts.RULES if p) + " END"
_MISSING = "concat_ws(',', CASE WHEN jurisdiction IN ('United States', 'United Kingdom', 'Canada', 'Australia', 'India') AND case_number = '' THEN 'case_number' END, CASE WHEN jurisdiction IN ('United States', 'United Kingdom', 'Canada', 'Australia') AND court = '' THEN 'court' END)"
_DAY = "strftime(decision_date, '{}')"
_N, _C = "case_number <> ''", "court <> ''"
_STYLES = {
    "bluebook": f"concat(coalesce(case_name, ''), CASE WHEN {_N} THEN ', ' || case_number ELSE '' END, CASE WHEN {_C} THEN concat(' (', court, CASE WHEN decision_date IS NOT NULL THEN ' ' || strftime(decision_date, '%b. %-d, %Y') ELSE '' END, ')') ELSE '' END, CASE WHEN requires AND attribution_text <> '' THEN '. ' || attribution_text ELSE '' END)",
    "apa": f"concat(coalesce(case_name, ''), CASE WHEN {_N} THEN ', ' || case_number ELSE '' END, CASE WHEN {_C} AND decision_date IS NOT NULL THEN concat(' (', court, ' ', year(decision_date), ')') ELSE '' END, CASE WHEN url <> '' THEN '. Retrieved from ' || url ELSE '' END)",
    "mla": f"concat(coalesce(case_name, ''), '.', CASE WHEN {_N} THEN concat(' ', case_number, '.') ELSE '' END, CASE WHEN {_C} THEN concat(' ', court, '.') ELSE '' END, CASE WHEN decision_date IS NOT NULL THEN strftime(decision_date, ' %-d %b. %Y.') ELSE '' END, CASE WHEN source_database <> '' THEN concat(' ', source_database, '.') ELSE '' END, CASE WHEN url <> '' THEN ' Web.' ELSE '' END)",
    "plain": f"concat(coalesce(case_name, ''), CASE WHEN {_N} THEN concat(' [', case_number, ']') ELSE '' END, CASE WHEN {_C} THEN ', ' || court ELSE '' END, CASE WHEN decision_date IS NOT NULL THEN strftime(decision_date, ', %-d %B %Y') ELSE '' END, CASE WHEN source_database <> '' THEN concat(' (Source: ', source_database, ')') ELSE '' END)",
}
#: What stands in each full text, by the rule that made it: format, as found, in standard form.
_IN_TEXT = """(SELECT id, x.f AS format, x.raw AS raw, x.norm AS norm FROM (SELECT id, unnest([
  {'f': 'bluebook', 'raw': NULL, 'norm': NULL}, {'f': 'uk', 'raw': concat('[2003] UKSC 0', case_key % 100), 'norm': concat('[2003] UKSC ', case_key % 100)},
  {'f': 'uk', 'raw': concat('[2010] EWCA Civ ', case_key), 'norm': concat('[2010] EWCA ', case_key)}, {'f': 'ecli', 'raw': concat('ECLI:EU:C:2001:', case_key), 'norm': concat('ECLI:EU:C:2001:', case_key)},
  {'f': 'neutral', 'raw': '[1999] XYZ 5', 'norm': '[1999] XYZ 5'}, {'f': 'canadian', 'raw': '2010 SCC 007', 'norm': '2010 SCC 7'}]) AS x FROM dockets WHERE full_text <> '') WHERE x.raw IS NOT NULL)"""
_FORMS = "(VALUES ('uk', '[2003]  EWHC Admin 007', '[2003] EWHC 7', '2003', 'EWHC'), ('bluebook', '410 us 113 (1973)', NULL, NULL, NULL), ('bluebook', '12 F. Supp  0034 (Del. 1999)', '12 F. Supp 0034 (1999)', '1999', NULL), ('bluebook', '347 U.S. 483 (1954)', '347 U.S. 483 (1954)', '1954', NULL), ('bluebook', '5 WLR 77 (2001)', '5 W.L.R. 77 (2001)', '2001', NULL), ('irish', '[2011] IESC 000', '[2011] IESC 0', '2011', 'IESC'), ('australian', '[1992] HCA 23', '[1992] HCA 23', '1992', 'HCA'), ('canadian', '2004 ONCA 019', '2004 ONCA 19', '2004', 'ONCA'), ('ecli', 'ECLI:EU:C:2023:00123', 'ECLI:EU:C:2023:123', '2023', 'C'), ('neutral', '[2020] ABC 9', '[2020] ABC 9', '2020', 'ABC')) AS v(format, raw, norm, year, court)"


def _forms(spark, sf_dir):
    raws = ["[2003]  EWHC Admin 007", "410 us 113 (1973)", "12 F. Supp  0034 (Del. 1999)", "347 U.S. 483 (1954)", "5 WLR 77 (2001)", "[2011] IESC 000", "[1992] HCA 23", "2004 ONCA 019", "ECLI:EU:C:2023:00123", "[2020] ABC 9"]
    rows = citations.extract(spark.createDataFrame([(x,) for x in raws], "t string"), "t", F.col("t"))
    p = citations.components(F.col("raw"), F.col("format"))
    return rows.select("raw", "format", citations.normalised(F.col("raw"), F.col("format")).alias("norm"), p["year"].alias("year"), p["court"].alias("court"))


def register(add) -> None:
    def on(name, f, sql):
        add(name, lambda spark, sf_dir: f(dockets(spark, sf_dir)), sql)

    add("C1_C6_forms", _forms, f"SELECT raw, format, norm, year, court FROM {_FORMS} WHERE norm IS NOT NULL")
    on("C2_C7_extracted", lambda d: citations.extracted(d).withColumnRenamed("normalised", "norm"), f"SELECT id AS citing, raw, format, norm FROM {_IN_TEXT}")
    on("J14_normalised", lambda d: citations.resolved(citations.extracted(d).filter("format = 'uk'").unionByName(citations.extract(d, "id", F.regexp_replace("case_number", r"\] ", "]  ")).filter("format <> 'bluebook'").withColumn("normalised", citations.normalised(F.col("raw"), F.col("format")))), d).filter("cited is not null").select("citing", "cited").distinct(),
       "SELECT * FROM (WITH own AS (SELECT id, regexp_replace(case_number, '\\s+', ' ', 'g') AS n FROM dockets WHERE regexp_matches(case_number, '^(\\[\\d{4}\\]|\\d{4}) (UKSC|HCA|IESC|SCC) ')), least_ AS (SELECT n, min(id) AS cited FROM own GROUP BY 1), asks AS (SELECT id, n FROM own UNION SELECT id, norm FROM " + _IN_TEXT + " WHERE format = 'uk') SELECT DISTINCT asks.id AS citing, cited FROM asks JOIN least_ USING (n))")
    add("G4_chain", lambda s, d: citations.shortest_chain(edges(s, d), "case-1400", "case-1", 5).select(F.array_join("path", ",").alias("path")),
        "SELECT path FROM (WITH RECURSIVE walk(id, path, n) AS (SELECT 'case-1400', ['case-1400'], 0 UNION ALL SELECT cited, list_append(path, cited), n + 1 FROM walk JOIN (SELECT DISTINCT citing, cited FROM edges WHERE citing <> cited) ON citing = id WHERE n < 5 AND NOT list_contains(path, cited)) SELECT array_to_string(path, ',') AS path, n FROM (SELECT path, n, row_number() OVER (ORDER BY n, path) AS k FROM walk WHERE id = 'case-1') WHERE k = 1)")
    add("G5_depth", lambda s, d: citations.depth(edges(s, d).filter("cast(substring(citing, 6) as long) % 3 = 1"), "case-100", 6),
        "SELECT * FROM (WITH RECURSIVE walk(id, path, n) AS (SELECT 'case-100', ['case-100'], 1 UNION ALL SELECT cited, list_append(path, cited), n + 1 FROM walk JOIN (SELECT DISTINCT citing, cited FROM (SELECT * FROM edges) WHERE citing <> cited AND substring(citing, 6)::BIGINT % 3 = 1) ON citing = id WHERE n < 6 AND NOT list_contains(path, cited)) SELECT max(n)::INT AS depth, max(n) >= 6 AS cut_off FROM walk)")
    on("J6_E3_courts", lambda d: courts.with_court(d).select("id", "court_info", "parent", "found_level", "found_type", "precedential"), _COURT)
    add("J7_parents", lambda s, d: courts.parents(s), f"SELECT a.name, b.name AS parent_name FROM {_COURTS} LEFT JOIN {_COURTS.replace('AS c(', 'AS b(')} ON b.abbreviation = c.parent AND b.court_jurisdiction = c.court_jurisdiction".replace("a.name, b.name", "c.name, b.name"))
    on("E1_case_types", lambda d: d.select("id", courts.case_type().alias("case_type")), f"SELECT id, {_CASE_TYPE} AS case_type FROM dockets")
    on("J8_E4_rules", lambda d: courts.with_rules(d).select("id", "citation_valid", F.array_join("missing_fields", ",").alias("missing")), f"SELECT id, {_PATTERN} AS citation_valid, {_MISSING} AS missing FROM dockets")
    on("E5_enriched", lambda d: courts.enriched(d).groupBy("case_type", "found_type", "has_dissent").agg(F.count("*").alias("n"), F.count_if("citation_valid").alias("valid")),
       f"SELECT case_type, found_type, has_dissent, count(*) AS n, count(*) FILTER (v) AS valid FROM (SELECT d.id, {_CASE_TYPE} AS case_type, contains(lower(concat_ws(' ', summary, full_text)), 'dissent') AS has_dissent, {_PATTERN} AS v FROM dockets d) JOIN ({_COURT}) USING (id) GROUP BY 1, 2, 3")
    on("E7_place", lambda d: d.select("id", courts.legacy_jurisdiction(F.col("jurisdiction")).alias("place")), "SELECT id, CASE WHEN jurisdiction = '' THEN 'unknown' ELSE lower(jurisdiction) END AS place FROM dockets")
    on("Q1_J5_attributed", lambda d: compliance.attributed(d, _policies(d.sparkSession)).select("id", "attribution", "source_url", "terms_of_service", F.sha2("full_text", 256).alias("full_text")),
       f"SELECT id, CASE WHEN source_database = '' THEN NULL WHEN requires THEN attribution_text WHEN requires IS NULL THEN concat('Data sourced from ', source_database, CASE WHEN url <> '' THEN concat(' (', url, ')') ELSE '' END) END AS attribution, CASE WHEN requires THEN base_url END AS source_url, CASE WHEN requires THEN terms_url END AS terms_of_service, sha256(CASE WHEN requires AND full_text <> '' AND attribution_text <> '' THEN concat(full_text, chr(10), chr(10), repeat('-', 80), chr(10), 'ATTRIBUTION:', chr(10), attribution_text, chr(10), chr(10), chr(10), repeat('-', 80), chr(10)) ELSE full_text END) AS full_text FROM {_JOINED}")
    add("Q2_formats", lambda s, d: _policies(s).select("source_database", *(compliance.formatted(k).alias(k) for k in ("text", "html", "markdown", "json"))),
        f"""SELECT source_database, CASE WHEN requires THEN attribution_text ELSE '' END AS "text", CASE WHEN requires THEN concat('<div class="attribution"><p>', attribution_text, '</p><p><a href="', base_url, '">', base_url, '</a></p></div>') ELSE '' END AS html, CASE WHEN requires THEN concat('**Attribution:** ', attribution_text, chr(10), chr(10), 'Source: [', source_database, '](', base_url, ')') ELSE '' END AS markdown, CASE WHEN requires THEN concat('{{"attribution":"', attribution_text, '","source_url":"', base_url, '","terms_url":"', terms_url, '"}}') ELSE '' END AS "json" FROM {_VALUES}""".replace("{{", "{").replace("}}", "}"))
    on("Q3_issues", lambda d: compliance.attribution_issues(compliance.attributed(d, _policies(d.sparkSession)).withColumn("source_url", F.when(F.col("case_key") % 2 == 0, F.col("source_url"))), _policies(d.sparkSession)).select("id", F.array_join("issues", ",").alias("issues")),
       f"SELECT id, concat_ws(',', CASE WHEN source_database = '' THEN 'No source database specified' END, CASE WHEN requires AND case_key % 2 <> 0 THEN 'Missing source URL in metadata' END) AS issues FROM {_JOINED}")
    on("Q4_citations", lambda d: compliance.with_policy(d, _policies(d.sparkSession)).select("id", *(compliance.citation(k).alias(k) for k in _STYLES)), "SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in _STYLES.items()) + f" FROM {_JOINED}")
    on("Q5_compliance", lambda d: compliance.checked(d.groupBy("source_database", (F.col("case_key") % 30).cast("int").alias("per_minute")).agg(F.count("*").alias("n")), _policies(d.sparkSession)).select("source_database", "per_minute", "compliant", "delay_seconds", F.array_join("violations", ",").alias("violations")),
       f"SELECT source_database, per_minute, violations = '' AS compliant, delay_seconds, violations FROM (SELECT DISTINCT source_database, (case_key % 30)::INT AS per_minute, coalesce(delay_seconds, 5)::INT AS delay_seconds, CASE WHEN allowed IS NULL THEN 'No policy found for source: ' || source_database WHEN NOT allowed THEN 'Scraping is not allowed for this source' WHEN case_key % 30 > rate_limit THEN 'Rate limit exceeded' ELSE '' END AS violations FROM {_JOINED})")
    on("F20_A26_violations", lambda d: compliance.violation_counts(d.filter("source_database in ('gamma', 'unlisted')").select(F.col("source_database").alias("source"), F.col("decision_date").alias("ts")), "1996-06-01"),
       "SELECT source_database AS source, count(*) AS n, max(decision_date) AS latest FROM dockets WHERE source_database IN ('gamma', 'unlisted') AND decision_date > '1996-06-01' GROUP BY 1")
