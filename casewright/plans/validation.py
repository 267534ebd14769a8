"""Registered queries of validation and quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import enrichment, quality, scoring, search, validation
from casewright.sources.cases import dockets

AS_OF = "2000-01-01"
_LISTS = ("parties", "judges", "legal_concepts", "citations")
_HAVE = {c: f"coalesce({c}, '') <> ''" for c in ("id", "case_number", "case_name", "court", "jurisdiction", "summary", "full_text", "url", "pdf_url", "court_type", "source_database", "outcome", "chief_judge")}
_HAVE |= {c: f"len({c}) > 0" for c in _LISTS} | {c: f"{c} IS NOT NULL" for c in ("decision_date", "filing_date")} | {"court_level": "court_level > 0"}
_COMPLETE = "((" + " + ".join(f"({_HAVE[c]})::INT" for c in (*scoring.CORE, *scoring.IMPORTANT, *scoring.ENRICHED)) + ")::DOUBLE / 15)"


def _quality_sql(c: str, least: int, most: int) -> str:
    t = f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
    runs = " OR ".join(f"contains({t}, '{x * 5}')" for x in "axX!#+%&*()-=/0123456789. ")  # an engine without back-references
    off = f"0.2 * ({runs})::INT + 0.1 * (upper({t}) = {t} AND strlen({t}) > 20)::INT + 0.2 * (length(regexp_replace({t}, '[A-Za-z0-9 ]', '', 'g'))::DOUBLE / greatest(strlen({t}), 1) > 0.3)::INT"
    off += "".join(f" + 0.3 * contains(lower({t}), '{p}')::INT" for p in scoring.PLACEHOLDERS)
    return f"(CASE WHEN strlen({t}) < {least} THEN 0.3 WHEN strlen({t}) > {most} THEN 0.8 ELSE greatest(1.0 - ({off}), 0.0) END)::DOUBLE"


def _mean_sql(checks: list[tuple[str, str]]) -> str:
    n = " + ".join(f"({a})::INT" for a, _ in checks)
    total = " + ".join(f"(CASE WHEN {a} THEN {b} ELSE 0.0 END)::DOUBLE" for a, b in checks)
    return f"(CASE WHEN {n} > 0 THEN ({total}) / ({n}) ELSE 0.5 END)"


_CONTENT = _mean_sql([*((_HAVE[c], _quality_sql(c, a, b)) for c, a, b in (("case_name", 10, 200), ("summary", 50, 5000), ("full_text", 100, 100000))), ("len(parties) > 0", "CASE WHEN len(parties) > 1 THEN 1.0 ELSE 0.5 END"), ("len(judges) > 0", "1.0")])
_META = _mean_sql([
    ("decision_date IS NOT NULL", f"CASE WHEN decision_date < '{AS_OF}' AND decision_date > '1800-01-01' THEN 1.0 ELSE 0.3 END"), ("court_level BETWEEN 1 AND 3", "1.0"), (_HAVE["jurisdiction"], "1.0"),
    (_HAVE["court_type"], "1.0"), ("len(legal_concepts) > 0", "least(len(legal_concepts) / 10.0, 1.0)"), ("len(citations) > 0", "least(len(citations) / 10.0, 1.0)"), (_HAVE["source_database"], "1.0"),
])
_QUALITY = f"SELECT *, {_COMPLETE} AS completeness, {_CONTENT} AS content, {_META} AS metadata FROM dockets"
_VALID_NUMBER = "(" + " OR ".join(f"regexp_matches(case_number, '{p}')" for p in scoring.NUMBER_FORMS) + r" OR (regexp_matches(case_number, '\d') AND strlen(case_number) BETWEEN 4 AND 50))"


def _codes_sql(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {a} THEN '{b}' END" for a, b in pairs) + "], lambda x: x IS NOT NULL)"


_S = _codes_sql([*((f"trim(coalesce({c}, '')) = ''", f"{c}:REQUIRED") for c in ("case_name", "court", "jurisdiction")), ("strlen(case_name) > 500", "case_name:TOO_LONG")])
_M = _codes_sql([("decision_date < '1800-01-01'", "decision_date:SUSPICIOUS_DATE"), (f"case_number <> '' AND NOT {_VALID_NUMBER}", "case_number:INVALID_FORMAT"), ("court_level < 1 OR court_level > 3", "court_level:INVALID_VALUE")])
_M = f"list_concat({_M}, list_transform(list_filter(parties, lambda p: trim(p) = ''), lambda p: 'parties:EMPTY_VALUE'))"
_CRIMINAL = "len(list_filter(legal_concepts, lambda c: regexp_matches(lower(c), 'criminal (law|procedure)'))) > 0"
_B = _codes_sql([
    ("court ILIKE '%supreme%' AND court_level <> 3", "supreme:RULE_VIOLATION"), ("court ILIKE '%appeal%' AND court_level <> 2", "appeal:RULE_VIOLATION"), ("pdf_url = '' AND url <> ''", "pdf_url:MISSING_RELATED_FIELD"),
    (f"{_CRIMINAL} AND len(parties) < 2", "parties:RULE_VIOLATION"), ("summary = '' AND court_level >= 2", "summary:MISSING_RECOMMENDED_FIELD"), ("len(legal_concepts) = 0", "legal_concepts:MISSING_ENRICHMENT"),
])
_ALL = f"""SELECT id, completeness, (completeness + content + metadata) / 3 AS quality, {_S} AS s, {_M} AS m, CASE WHEN decision_date > '{AS_OF}' THEN 1 ELSE 0 END AS e, {_B} AS b FROM ({_QUALITY})"""
_SCORES = f"""SELECT *, CASE WHEN len(s) > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS s_score, greatest(0.0, 1 - 0.2 * e - 0.05 * len(m))::DOUBLE AS m_score, greatest(0.0, 1 - 0.03 * len(b))::DOUBLE AS b_score,
 len(s) = 0 AND e = 0 AND quality >= 0.5 AS valid FROM ({_ALL})"""
_MEAN = "(s_score + m_score + b_score + quality) / 4"
_MISSING = ("id", "case_number", "case_name", "decision_date", "court", "jurisdiction", "url")
_HASH = "sha256(concat(lower(case_number), '|', lower(coalesce(case_name, '')), '|', court, '|', jurisdiction, CASE WHEN decision_date IS NOT NULL THEN '|' || strftime(decision_date, '%Y-%m-%d') ELSE '' END))"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\\s+'), lambda x: x <> ''))"


def _similar_sql(a: str, b: str) -> str:
    both = lambda f: f"coalesce({a}.{f}, '') <> '' AND coalesce({b}.{f}, '') <> ''"
    w = lambda t, f: _WORDS.format(c=f"{t}.{f}")
    jac = lambda f: f"len(list_intersect({w(a, f)}, {w(b, f)}))::DOUBLE / len(list_distinct(list_concat({w(a, f)}, {w(b, f)})))"
    checks = [(both(f), f"({a}.{f} = {b}.{f})::INT") for f in ("case_number", "court", "jurisdiction")] + [(both(f), jac(f)) for f in ("case_name", "summary")]
    checks.append((f"{a}.decision_date IS NOT NULL AND {b}.decision_date IS NOT NULL", f"greatest(0, 1 - abs(date_diff('day', {b}.decision_date::DATE, {a}.decision_date::DATE))::DOUBLE / 365)"))
    return _mean_sql(checks)


def _joined(*names: str):
    return [F.array_join(c, ",").alias(c) for c in names]


def _pairs(d):
    keys = [F.when(F.col("case_number") != "", F.concat(F.lit("n"), "case_number")), F.when(F.coalesce("case_name", F.lit("")) != "", F.concat(F.lit("c"), "case_name", F.lit("|"), F.year("decision_date").cast("string")))]
    return scoring.similar_pairs(d, keys, 0.6).select("left", "right", F.round("similarity", 9).alias("similarity"))


def _reports(d):
    """Semantic reports as the roll-up takes them."""
    errors, warnings = scoring.semantic(AS_OF)
    out = d.withColumns({"errors": errors, "warnings": warnings})
    return out.withColumn("score", F.greatest(F.lit(0.0), 1.0 - 0.2 * F.size("errors") - 0.05 * F.size("warnings")))


_T = "concat_ws(' ', summary, full_text)"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower({_T}), '{w}')" for w in words) + ")"


def _first(kinds, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {_any(w)} THEN '{k}'" for k, w in kinds) + f" ELSE {default} END"


def register(add) -> None:
    def on(name, f, sql):
        add(name, lambda spark, sf_dir: f(dockets(spark, sf_dir)), sql)

    on("T6_T7_text_quality", lambda d: d.select("id", *(F.round(scoring.text_quality(F.col(c), a, b), 9).alias(c) for c, a, b in (("case_name", 10, 200), ("summary", 50, 5000), ("full_text", 100, 100000)))),
       "SELECT id, " + ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN 0.0::DOUBLE ELSE round({_quality_sql(c, a, b)}, 9) END AS {c}" for c, a, b in (("case_name", 10, 200), ("summary", 50, 5000), ("full_text", 100, 100000))) + " FROM dockets")
    on("T8_number_valid", lambda d: d.select("id", "case_number", scoring.number_valid(F.col("case_number")).alias("valid")), f"SELECT id, case_number, {_VALID_NUMBER} AS valid FROM dockets")
    on("V3_business_rules", lambda d: d.select("id", scoring.business().alias("codes")).select("id", *_joined("codes")), f"SELECT id, array_to_string({_B}, ',') AS codes FROM dockets")
    on("V4_V7_quality", lambda d: scoring.quality(d, AS_OF).select("id", *(F.round(c, 9).alias(c) for c in ("completeness", "content", "metadata", "quality")), "quality_valid", *_joined("quality_warnings")),
       f"SELECT id, round(completeness, 9) AS completeness, round(content, 9) AS content, round(metadata, 9) AS metadata, round(q, 9) AS quality, q >= 0.5 AS quality_valid, concat_ws(',', CASE WHEN q < 0.7 THEN 'LOW_QUALITY' END, CASE WHEN completeness < 0.6 THEN 'INCOMPLETE_DATA' END) AS quality_warnings FROM (SELECT *, (completeness + content + metadata) / 3 AS q FROM ({_QUALITY}))")
    on("V9_pipeline", lambda d: scoring.validated(d, AS_OF).select("id", "valid", F.round("score", 9).alias("score"), *_joined("s_errors", "m_warnings", "b_warnings"), F.size("m_errors").alias("m_errors")),
       f"SELECT id, valid, round({_MEAN}, 9) AS score, array_to_string(s, ',') AS s_errors, array_to_string(m, ',') AS m_warnings, array_to_string(b, ',') AS b_warnings, e::INT AS m_errors FROM ({_SCORES})")
    on("V10_reject", lambda d: scoring.validated(d, AS_OF).filter("should_reject or size(critical) > 0").select("id", "should_reject", *_joined("critical")),
       f"SELECT id, len(s) > 0 OR quality < 0.5 AS should_reject, array_to_string(list_concat(s, CASE WHEN e = 1 THEN ['decision_date:INVALID_DATE'] ELSE []::VARCHAR[] END), ',') AS critical FROM ({_SCORES}) WHERE len(s) > 0 OR quality < 0.5 OR e = 1")
    on("A15_batch_summary", lambda d: scoring.batch_summary(scoring.validated(d, AS_OF)), f"SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, round(sum({_MEAN}) / count(*), 6) AS mean_score, round(sum(completeness) / count(*), 6) AS mean_completeness FROM ({_SCORES})")
    on("A14_histogram", lambda d: scoring.completeness_histogram(scoring.quality(d, AS_OF)), f"SELECT CASE WHEN c >= 0.9 THEN '90-100' WHEN c >= 0.8 THEN '80-90' WHEN c >= 0.7 THEN '70-80' WHEN c >= 0.6 THEN '60-70' ELSE '<60' END AS bucket, count(*) AS n FROM (SELECT {_COMPLETE} AS c FROM dockets) GROUP BY 1")
    on("V12_model", lambda d: d.select("id", scoring.model_problems(d).alias("problems")).select("id", *_joined("problems")),
       "SELECT id, array_to_string(" + _codes_sql([*((f"NOT ({_HAVE[c]})", f"{c}:REQUIRED") for c in ("id", "case_name", "court", "jurisdiction")), ("strlen(case_number) < 3 OR NOT regexp_matches(case_number, '[a-zA-Z0-9]')", "case_number:INVALID"), ("url <> '' AND NOT regexp_matches(url, '^https?://')", "url:INVALID"), ("decision_date < filing_date", "decision_date:BEFORE_FILING"), ("court_level < 1 OR court_level > 5", "court_level:INVALID")]) + ", ',') AS problems FROM dockets")
    on("V13_field_score", lambda d: d.select("id", F.round(scoring.field_score(), 9).alias("score")),
       "SELECT id, round((" + " + ".join(f"({_HAVE[c]})::INT" for c in _MISSING) + " + 0.5 * (" + " + ".join(f"({_HAVE[c]})::INT" for c in ("filing_date", "summary", "full_text", "judges", "citations", "legal_concepts", "outcome", "chief_judge", "parties")) + "))::DOUBLE / 11.5, 9) AS score FROM dockets")
    on("T23_V14_first_seen", lambda d: scoring.first_of_each(d.withColumn("case_number", F.lit("")).withColumn("case_name", F.upper("case_name")).withColumn("decision_date", F.date_trunc("year", "decision_date")), "case_key").select("id", "hash"),
       f"SELECT id, hash FROM (SELECT id, hash, row_number() OVER (PARTITION BY hash ORDER BY case_key) AS k FROM (SELECT *, {_HASH.replace('lower(case_number)', chr(39) * 2).replace('decision_date, ', 'date_trunc(' + chr(39) + 'year' + chr(39) + ', decision_date), ')} AS hash FROM dockets)) WHERE k = 1")
    on("V15_F22_missing", lambda d: d.select("id", scoring.is_complete().alias("complete"), scoring.missing_fields().alias("missing")).select("id", "complete", *_joined("missing")),
       "SELECT id, missing = '' AS complete, missing FROM (SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({_HAVE[c]}) THEN '{c}' END" for c in _MISSING) + ") AS missing FROM dockets)")
    on("P4_clamped", lambda d: d.select("id", scoring.clamped(F.col("quality_score") * 3 - 1).alias("score")), "SELECT id, CASE WHEN quality_score IS NULL THEN 0.0 ELSE least(greatest(quality_score * 3 - 1, 0), 1) END::DOUBLE AS score FROM dockets")
    on("V11_J11_similar_pairs", _pairs,
       f"SELECT a.id AS \"left\", b.id AS \"right\", round({_similar_sql('a', 'b')}, 9) AS similarity FROM dockets a JOIN dockets b ON a.id < b.id AND ((a.case_number <> '' AND a.case_number = b.case_number) OR (coalesce(a.case_name, '') <> '' AND a.case_name = b.case_name AND year(a.decision_date) = year(b.decision_date))) WHERE {_similar_sql('a', 'b')} >= 0.6")
    on("V11_merge_map", lambda d: scoring.merge_map(quality.hash_groups(d).filter("kind = 'case_name'")),
       "SELECT id AS gone, best AS \"into\" FROM (SELECT id, first(id ORDER BY coalesce(quality_score, 0) DESC, id) OVER (PARTITION BY translate(trim(regexp_replace(lower(case_name), '\\s+', ' ', 'g')), '.,;:()[]\"''', '') ORDER BY coalesce(quality_score, 0) DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM dockets WHERE coalesce(case_name, '') <> '') WHERE id <> best")
    on("V1_structural", lambda d: d.select("id", *(c.alias(n) for n, c in zip(("errors", "warnings"), scoring.structural(), strict=True))).select("id", *_joined("errors", "warnings")), f"SELECT id, array_to_string({_S}, ',') AS errors, CASE WHEN strlen(summary) > 10000 THEN 'summary:TOO_LONG' ELSE '' END AS warnings FROM dockets")
    on("V2_semantic", lambda d: _reports(d).select("id", F.round("score", 9).alias("score"), *_joined("errors", "warnings")), f"SELECT id, round(greatest(0.0, 1 - 0.2 * e - 0.05 * len(m)), 9)::DOUBLE AS score, CASE WHEN e = 1 THEN 'decision_date:INVALID_DATE' ELSE '' END AS errors, array_to_string(m, ',') AS warnings FROM ({_ALL})")
    on("A13_roll_up", lambda d: validation.roll_up(_reports(d)), f"SELECT count(*) AS total, count(*) FILTER (e = 0) AS valid, count(*) FILTER (e > 0) AS invalid, round(avg(greatest(0.0, 1 - 0.2 * e - 0.05 * len(m))), 9) AS mean_score, sum(e)::BIGINT AS n_errors, sum(len(m))::BIGINT AS n_warnings FROM ({_ALL})")
    on("V5_completeness", lambda d: d.select("id", F.round(scoring.completeness(), 9).alias("completeness")), f"SELECT id, round({_COMPLETE}, 9) AS completeness FROM dockets")
    on("F15_fuzzy", lambda d: search.filtered(d, search.Query("negligance aplication", "fuzzy")).select("id").unionByName(search.filtered(d, search.Query("juducial", "fuzzy")).select("id")),
       "SELECT id FROM (SELECT id, list_transform(list_filter(string_split_regex(lower(concat_ws(' ', coalesce(case_name, ''), summary)), '\\s+'), lambda x: x <> ''), lambda x: rtrim(x, '.,;:')) AS w FROM dockets) , (SELECT unnest([['negligance', 'aplication'], ['juducial']]) AS terms) WHERE len(list_filter(terms, lambda t: len(list_filter(w, lambda x: levenshtein(x, t) <= 2)) > 0)) = len(terms)")
    on("E2_procedural", lambda d: d.select("id", *enrichment.procedural(F.concat_ws(" ", "summary", "full_text"))),
       f"SELECT id, {_any(enrichment.APPEAL)} AS is_appeal, {_first(enrichment.STAGES)} AS procedural_stage, {_first([(x, (x,)) for x in enrichment.DECISIONS])} AS decision, {_any(('unanimous',))} AS unanimous, {_any(('dissent',))} AS has_dissent, {_any(('concur',))} AS has_concurrence FROM dockets")
    on("E6_document_type", lambda d: d.select("id", enrichment.document_type(F.concat_ws(" ", "summary", "full_text")).alias("kind")), f"SELECT id, {_first(enrichment.DOCUMENTS, repr('unknown'))} AS kind FROM dockets")
    on("E8_O12_missing", lambda d: d.select("id", F.array_join(enrichment.missing_signs(F.concat_ws(" ", "summary", "full_text"), ["damages", "appeal", "warranty"]), ",").alias("missing")), "SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_any((w,))} THEN 'missing_{w}' END" for w in ("damages", "appeal", "warranty")) + ") AS missing FROM dockets")
