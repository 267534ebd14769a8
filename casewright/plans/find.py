"""Registered queries of search, suggestions and concepts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import concepts, search
from casewright.sources.cases import dockets, register as register_views

_TEXT = "Duty appeal duty"
_LOW = {c: f"lower(coalesce({c}, ''))" for c in ("case_name", "summary", "full_text")}


def _score(terms: list[str]) -> str:
    parts = [f"{w} * contains({_LOW[c]}, '{t}')::INT" for t in terms for c, w in (("case_name", 3.0), ("summary", 2.0), ("full_text", 1.0))]
    parts += [f"2.5 * len(list_filter(legal_concepts, lambda c: contains(lower(c), '{t}')))" for t in terms]
    return f"(({' + '.join(parts)}) / {len(terms)} * (1 + coalesce(quality_score, 0)))::DOUBLE"


def _snippet(c: str, terms: list[str], size: int) -> str:
    at = "least(" + ", ".join(f"CASE WHEN contains(lower({c}), '{t}') THEN strpos(lower({c}), '{t}') ELSE 1000000 END" for t in terms) + ")"
    begin = f"greatest({at} - 51, 0)"
    end = f"least({at} - 1 + {size}, length({c}))"
    out = f"concat(CASE WHEN {begin} > 0 THEN '...' ELSE '' END, substring({c}, ({begin} + 1)::BIGINT, ({end} - {begin})::BIGINT), CASE WHEN {end} < length({c}) THEN '...' ELSE '' END)"
    for t in terms:
        for form in (t, t.capitalize()):
            out = f"replace({out}, '{form}', '<em>{form}</em>')"
    return f"CASE WHEN {at} < 1000000 THEN {out} END"


_PUNCT = "".join(f"{x}" for x in ".,;:!?()[]{}\"")
_TOKENS = f"list_filter(string_split_regex(translate(replace(replace(lower(t), chr(39), ' '), chr(10), ' '), '{_PUNCT}', '{' ' * len(_PUNCT)}'), '\\s+'), lambda x: x <> '')"


def _concepts(text: str) -> str:
    rows = []
    for _, name, area, keys, importance in concepts.TAXONOMY:
        q = lambda x: x.lower().replace("'", "''")
        got = " + ".join(f"CASE WHEN contains(low, '{q(k)}') THEN {1.5 * len(k.split())} WHEN list_has_all(tokens, [{', '.join(repr(p) if chr(39) not in p else chr(39) + q(p) + chr(39) for p in k.lower().split())}]) THEN {float(len(k.split()))} ELSE 0.0 END" for k in keys)
        pull = importance / 10 * 0.1
        rows.append(f"SELECT id, '{name}' AS concept, '{area}' AS area, CASE WHEN g > 0 THEN least(g / {sum(len(k.split()) for k in keys)}, 1.0) * {1 - pull} + {pull} ELSE 0 END AS confidence FROM (SELECT id, ({got})::DOUBLE AS g FROM texts)")
    return f"(WITH texts AS (SELECT id, lower(t) AS low, {_TOKENS} AS tokens FROM (SELECT id, {text} AS t FROM dockets)) SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE confidence >= 0.3)"


_CASE = "concat_ws(' ', coalesce(case_name, ''), summary, full_text)"
_BATCH = "concat_ws(' ', full_text, summary)"
_TERMS = "list_filter(string_split_regex(lower(concat_ws(' ', coalesce(case_name, ''), summary, full_text)), '[^a-z0-9]+'), lambda x: x <> '')"
_TABLE = "(VALUES " + ", ".join("('{}', '{}', '{}', [{}])".format(i, n, a, ", ".join("'" + k.lower().replace("'", "''") + "'" for k in ks)) for i, n, a, ks, _ in concepts.TAXONOMY) + ") AS t(concept_id, name, area, keywords)"


def _bm25(terms: list[str], every: bool) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT id, matched, round("rank", 6) AS "rank" FROM (WITH docs AS (SELECT id, {_TERMS} AS t FROM dockets), postings AS (SELECT id, term, count(*) AS n, any_value(size) AS size FROM (SELECT id, len(t) AS size, unnest(t) AS term FROM docs) WHERE term IN ({names}) GROUP BY 1, 2),
 freq AS (SELECT term, count(*) AS df FROM postings GROUP BY 1), total AS (SELECT count(*) AS n_docs, avg(len(t)) FILTER (len(t) > 0) AS mean FROM docs)
 SELECT id, count(*) AS matched, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean))) AS "rank" FROM postings JOIN freq USING (term), total GROUP BY id) {f'WHERE matched = {len(terms)}' if every else ''}"""


_OFFER = "SELECT 'court' AS kind, unnest([" + ", ".join(f"'{c}'" for c in search.OFFERED_COURTS) + "]) AS value UNION ALL SELECT 'concept', unnest([" + ", ".join(f"'{c}'" for c in search.OFFERED_CONCEPTS) + "])"
_HISTORY = "SELECT user_id AS \"user\", event_type AS query, ts FROM events"
_ROBOTS = [("h0", "*", False, "/private"), ("h0", "*", True, "/private/open*"), ("h1", "reader", False, "*.pdf"), ("h1", "*", False, "/"), ("h2", "other", False, "/"), ("h2", "read", False, "/a*z")]


def _paths(spark):
    rows = [(f"h{k % 4}", p) for k in range(4) for p in ("/", "/private/x", "/private/open/x", "/a/b.pdf", "/a.z", "/abz", "/za")]
    return spark.createDataFrame(rows, "host string, path string")


def _history(spark, sf_dir):
    register_views(spark, sf_dir)
    return spark.sql("SELECT user_id AS user, event_type AS query, ts FROM events")


def register(add) -> None:
    def on(name, f, sql):
        add(name, lambda spark, sf_dir: f(dockets(spark, sf_dir)), sql)

    terms = _TEXT.lower().split()
    on("X1_full_relevance", lambda d: d.withColumn("score", search.full_relevance(_TEXT)).filter("score > 0").orderBy(F.col("score").desc(), "id").limit(200).select("id", F.round("score", 9).alias("score")), f"SELECT id, round({_score(terms)}, 9) AS score FROM dockets WHERE {_score(terms)} > 0 ORDER BY {_score(terms)} DESC, id LIMIT 200")
    on("X2_highlights", lambda d: d.select("id", F.array_join(search.highlights("duty appeal"), "|").alias("highlights")), "SELECT id, concat_ws('|', " + ", ".join(_snippet(c, ["duty", "appeal"], n) for c, n in (("case_name", 100), ("summary", 200))) + ") AS highlights FROM dockets")
    on("X3_highlighted", lambda d: d.select("id", search.highlighted(F.col("full_text"), ["warranty", "lease"], 60).alias("snippet")), f"SELECT id, coalesce({_snippet('full_text', ['warranty', 'lease'], 60)}, CASE WHEN length(full_text) > 60 THEN concat(substring(full_text, 1, 60), '...') ELSE full_text END) AS snippet FROM dockets")
    on("F1_F3_ids", lambda d: search.filtered(d, search.Query(ids=("case-1", "case-20", "case-300", "nowhere"), levels=(1, 2))).select("id"), "SELECT id FROM dockets WHERE id IN ('case-1', 'case-20', 'case-300') AND court_level IN (1, 2)")
    on("F2_courts", lambda d: search.filtered(d, search.Query("the appeal", "exact", courts=("UK Supreme Court", "scotus"))).select("id"), "SELECT id FROM dockets WHERE court IN ('UK Supreme Court', 'scotus') AND (contains(lower(summary), 'the appeal') OR contains(lower(coalesce(case_name, '')), 'the appeal'))")
    on("F6_F7_overlap", lambda d: search.listed(d, ("Judge 3", "Judge 12"), ("Evidence", "c")).select("id"), "SELECT id FROM dockets WHERE list_has_any(judges, ['Judge 3', 'Judge 12']) AND list_has_any(legal_concepts, ['Evidence', 'c'])")
    on("F9_F10_parties_pdf", lambda d: search.listed(d, parties=("Party 7", "Party 8", "Party 33"), has_pdf=True).select("id"), "SELECT id FROM dockets WHERE list_has_any(parties, ['Party 7', 'Party 8', 'Party 33']) AND pdf_url <> ''")
    on("F12_ilike", lambda d: search.ilike_search(d, "scc _").select("id"), "SELECT id FROM dockets WHERE case_name ILIKE '%scc _%' OR case_number ILIKE '%scc _%' OR full_text ILIKE '%scc _%' ORDER BY id LIMIT 50")
    on("F13_J1_every_term", lambda d: search.indexed_search(search.text_index(d), d, "duty warranty", True).withColumn("rank", F.round("rank", 6)), _bm25(["duty", "warranty"], True))
    on("F14_any_term", lambda d: search.indexed_search(search.text_index(d), d, "warranty; appeal", False).withColumn("rank", F.round("rank", 6)), _bm25(["appeal", "warranty"], False))
    on("K16_text_index", lambda d: search.text_index(d).groupBy("term").agg(F.count("*").alias("n_cases"), F.sum("n").alias("n")), f"SELECT term, count(DISTINCT id) AS n_cases, count(*)::BIGINT AS n FROM (SELECT id, unnest({_TERMS}) AS term FROM dockets) GROUP BY 1")
    on("F19_page", lambda d: search.page(search.listed(d, concepts=("Contract Law",)).filter("quality_score >= 0.3"), 250, 40).select("id", "total", "has_more"), "SELECT id, count(*) OVER () AS total, 40 + least(100, count(*) OVER () - 40) < count(*) OVER () AS has_more FROM dockets WHERE list_contains(legal_concepts, 'Contract Law') AND quality_score >= 0.3 ORDER BY id LIMIT 100 OFFSET 40")
    on("O1_O2_ordered", lambda d: search.ordered(d, "quality_score", False, 60, 5).select("id", "quality_score"), "SELECT id, quality_score FROM dockets ORDER BY quality_score ASC NULLS FIRST, id LIMIT 60 OFFSET 5")
    on("X5_O9_suggestions", lambda d: search.suggestions(d, "ju", 30).withColumn("score", F.round("score", 9)), f"SELECT kind, value, round((CASE WHEN starts_with(lower(value), 'ju') THEN 1.0 / (length(value) - 1) ELSE 0.5 / length(value) END) * CASE kind WHEN 'case' THEN 2.0 WHEN 'judge' THEN 1.5 ELSE 1.0 END, 9)::DOUBLE AS score FROM (SELECT DISTINCT 'case' AS kind, case_name AS value FROM dockets UNION ALL SELECT DISTINCT 'judge', unnest(judges) FROM dockets UNION ALL {_OFFER}) WHERE contains(lower(value), 'ju') ORDER BY score DESC, kind, value LIMIT 30")
    add("X8_popular", lambda s, d: search.popular(_history(s, d), 5), f"SELECT query, count(*) AS n, max(ts) AS last_at FROM ({_HISTORY}) GROUP BY 1 ORDER BY n DESC, query LIMIT 5")
    add("X8_recent", lambda s, d: search.recent(_history(s, d), 7, 8).select("query", "ts"), f"SELECT query, ts FROM ({_HISTORY}) WHERE \"user\" = 7 ORDER BY ts DESC, query LIMIT 8")
    on("X9_dictionary", lambda d: search.in_dictionary(d.select(F.explode(F.split(F.lower("status"), "(?<=s)")).alias("word")).distinct().unionByName(d.select(F.upper("status").alias("word")).distinct()), d, "status"), "SELECT word, word IN ('ACTIVE', 'CLOSED', 'PENDING', 'active', 'pending') AS known FROM (SELECT unnest(['ACTIVE', 'CLOSED', 'PENDING', 'active', 'clos', 'ed', 'pending']) AS word)")
    on("A5_concept_facet", lambda d: search.concept_facet(d), "SELECT unnest(legal_concepts) AS value, count(*) AS n FROM dockets GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
    on("J13_by_ids", lambda d: search.by_ids(d, d.sparkSession.createDataFrame([("case-7",), ("case-9",), ("case-9",), ("none",)], "id string")).select("id", "court"), "SELECT id, court FROM dockets WHERE id IN ('case-7', 'case-9')")
    add("F17_robots", lambda s, d: search.robots_allowed(_paths(s), s.createDataFrame(_ROBOTS, "host string, agent string, allow boolean, pattern string"), "Reader"),
        "SELECT host, path, CASE WHEN host = 'h0' THEN NOT starts_with(path, '/private') OR starts_with(path, '/private/open') WHEN host = 'h1' THEN NOT ends_with(path, '.pdf') WHEN host = 'h2' THEN NOT (starts_with(path, '/a') AND ends_with(path, 'z')) ELSE true END AS allowed FROM (SELECT unnest(['h0', 'h1', 'h2', 'h3']) AS host), (SELECT unnest(['/', '/private/x', '/private/open/x', '/a/b.pdf', '/a.z', '/abz', '/za']) AS path)")
    on("N2_case_concepts", lambda d: concepts.extracted(d, concepts.case_text()).withColumn("confidence", F.round("confidence", 9)), f"SELECT id, concept, area, round(confidence, 9)::DOUBLE AS confidence FROM {_concepts(_CASE)}")
    on("N3_A9_batch_areas", lambda d: concepts.area_distribution(concepts.extracted(d, concepts.batch_text())), f"SELECT area, count(*) AS n, count(DISTINCT id) AS n_cases FROM {_concepts(_BATCH)} GROUP BY 1")
    on("N4_written_back", lambda d: concepts.written_back(d, concepts.extracted(d, concepts.case_text()).withColumn("confidence", F.round("confidence", 9))).select("id", F.array_join("legal_concepts", ",").alias("concepts")), f"SELECT id, coalesce(string_agg(concept, ',' ORDER BY round(confidence, 9) DESC, concept), '') AS concepts FROM dockets LEFT JOIN {_concepts(_CASE)} USING (id) GROUP BY id")
    add("N5_taxonomy", lambda s, d: concepts.concept_table(s).filter("area = 'tort' or concept_id = 'tax-01'").select("concept_id", "name"), f"SELECT concept_id, name FROM {_TABLE} WHERE concept_id LIKE 'tort-%' OR concept_id = 'tax-01'")
    add("N6_J10_related", lambda s, d: concepts.related(concepts.concept_table(s)), f"SELECT a.name, b.name AS other FROM {_TABLE.replace('AS t(', 'AS a(')}, {_TABLE.replace('AS t(', 'AS b(')} WHERE a.area = b.area AND a.concept_id <> b.concept_id")
    add("J12_keyword_index", lambda s, d: concepts.keyword_index(concepts.concept_table(s)), f"SELECT DISTINCT unnest(keywords) AS keyword, concept_id FROM {_TABLE}")
    add("A10_area_totals", lambda s, d: concepts.area_totals(concepts.concept_table(s)), f"SELECT area, count(DISTINCT concept_id) AS n_concepts, count(DISTINCT k) AS n_keywords FROM (SELECT area, concept_id, unnest(keywords) AS k FROM {_TABLE}) GROUP BY 1")
