"""Queries by name, and the SQL that gives the same rows on an engine with the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import citations, enrichment, quality, search, validation
from casewright.operators import jobs as jobs_ops
from casewright.sources.cases import cases, edges, jobs, oracle, register
from casewright.plans import find as find_plans
from casewright.plans import law as law_plans
from casewright.plans import output as output_plans
from casewright.plans import streams as stream_plans
from casewright.plans import validation as validation_plans
from casewright.streaming import metrics

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "X1_search_ranked"


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = oracle(sql)


def _on(source, f):
    return lambda spark, sf_dir: f(source(spark, sf_dir))


_Q = search.Query("contract negligence", min_quality=0.2, limit=50)
_MATCH = "(lower(case_name) LIKE '%contract%' OR lower(summary) LIKE '%contract%' OR lower(case_name) LIKE '%negligence%' OR lower(summary) LIKE '%negligence%') AND quality_score >= 0.2"
_SCORE = "((CASE WHEN lower(case_name) LIKE '%contract%' THEN 3.0 ELSE 0 END + CASE WHEN lower(summary) LIKE '%contract%' THEN 2.0 ELSE 0 END + CASE WHEN lower(case_name) LIKE '%negligence%' THEN 3.0 ELSE 0 END + CASE WHEN lower(summary) LIKE '%negligence%' THEN 2.0 ELSE 0 END)::DOUBLE / 2 * (1 + quality_score))"
_add("X1_search_ranked", _on(cases, lambda d: search.search(d, _Q).select("id", "case_name", F.round("score", 9).alias("score"))), f"SELECT id, case_name, round({_SCORE}, 9) AS score FROM cases WHERE {_MATCH} ORDER BY {_SCORE} DESC, id LIMIT 50")
_add("A6_facets", _on(cases, lambda d: search.facets(d, _Q)), f"""SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS k FROM (
 SELECT facet, value, count(*) AS n FROM (SELECT 'jurisdiction' AS facet, jurisdiction AS value FROM cases WHERE {_MATCH} UNION ALL SELECT 'court', court FROM cases WHERE {_MATCH}
 UNION ALL SELECT 'court_level', court_level::VARCHAR FROM cases WHERE {_MATCH} UNION ALL SELECT 'year', year::VARCHAR FROM cases WHERE {_MATCH}) GROUP BY 1, 2)) WHERE k <= 20""")
_add("S1_scan_page", _on(cases, lambda d: d.orderBy("id").offset(20).limit(30).select("id", "case_number", "status")), "SELECT id, case_number, status FROM cases ORDER BY id LIMIT 30 OFFSET 20")
_add("S5_point_lookup", _on(cases, lambda d: d.filter(F.col("id") == "case-42").limit(1).select("id", "case_name", "court")), "SELECT id, case_name, court FROM cases WHERE id = 'case-42'")
_add("F1_F8_filters", _on(cases, lambda d: search.filtered(d, search.Query(jurisdictions=("EUROPE", "ASIA"), statuses=("active",), start="1996-01-01", end="1998-12-31", min_quality=0.5)).select("id", "jurisdiction")), "SELECT id, jurisdiction FROM cases WHERE jurisdiction IN ('EUROPE','ASIA') AND status = 'active' AND decision_date >= '1996-01-01' AND decision_date <= '1998-12-31' AND quality_score >= 0.5")
_add("F15_regex", _on(cases, lambda d: search.filtered(d, search.Query("tax|patent", "regex")).select("id")), "SELECT id FROM cases WHERE regexp_matches(summary, 'tax|patent') OR regexp_matches(case_name, 'tax|patent')")
_add("A1_count", _on(cases, lambda d: d.filter("status = 'closed'").agg(F.count("*").alias("n"))), "SELECT count(*) AS n FROM cases WHERE status = 'closed'")
_add("A8_jurisdiction_share", _on(cases, lambda d: (lambda g: g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("jurisdiction", "n", F.round(F.col("n") / F.col("t") * 100, 6).alias("percentage"), F.round("q", 9).alias("avg_quality")))(d.groupBy("jurisdiction").agg(F.count("*").alias("n"), F.avg("quality_score").alias("q")))), "SELECT jurisdiction, count(*) AS n, round(count(*) / (SELECT count(*) FROM cases) * 100, 6) AS percentage, round(avg(quality_score), 9) AS avg_quality FROM cases GROUP BY 1")
_add("X5_suggest", _on(cases, lambda d: search.suggest(d, "court", 10).select("kind", "value", "n", F.round("score", 9).alias("score"))), """SELECT 'court' AS kind, court AS value, count(*) AS n, round(CASE WHEN lower(court) LIKE 'court%' THEN 1.0 / (length(court) - 5 + 1) ELSE 0.5 / length(court) END, 9)::DOUBLE AS score FROM cases WHERE lower(court) LIKE '%court%' GROUP BY court""")
_add("X4_spelling", _on(cases, lambda d: search.spelling(d, "jurisdiction", "EUROBE")), "SELECT lower(jurisdiction) AS word, levenshtein(lower(jurisdiction), 'eurobe')::INT AS distance FROM cases WHERE levenshtein(lower(jurisdiction), 'eurobe') <= 2 GROUP BY 1, 2")
_add("C3_components", _on(cases, lambda d: d.select("id", citations.components(F.col("case_number"), F.when(F.col("case_key") % 5 == 4, "bluebook").otherwise("neutral")).alias("c")).select("id", "c.year", "c.court", "c.number", "c.volume", "c.page")), "SELECT id, year::VARCHAR AS year, CASE case_key % 5 WHEN 0 THEN 'UKSC' WHEN 1 THEN 'HCA' WHEN 2 THEN 'IESC' WHEN 3 THEN 'SCC' END AS court, CASE WHEN case_key % 5 <> 4 THEN case_key::VARCHAR END AS number, CASE WHEN case_key % 5 = 4 THEN case_key::VARCHAR END AS volume, CASE WHEN case_key % 5 = 4 THEN party_key::VARCHAR END AS page FROM cases")
_add("J2_A11_degrees", lambda s, d: citations.degrees(cases(s, d), s.table("edges")), "SELECT id, coalesce(i, 0) AS inbound, coalesce(o, 0) AS outbound FROM cases LEFT JOIN (SELECT cited, count(*) AS i FROM edges GROUP BY 1) ON id = cited LEFT JOIN (SELECT citing, count(*) AS o FROM edges GROUP BY 1) ON id = citing")
_add("G3_most_cited", _on(edges, lambda e: e.groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(20)), "SELECT cited AS id, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, id LIMIT 20")
_add("G6_neighbourhood", _on(edges, lambda e: citations.neighbourhood(e, "case-1", 2, "cited")), "SELECT id, min(d) AS distance FROM (SELECT 'case-1' AS id, 0 AS d UNION ALL SELECT cited, 1 FROM edges WHERE citing = 'case-1' UNION ALL SELECT b.cited, 2 FROM edges a JOIN edges b ON a.cited = b.citing WHERE a.citing = 'case-1') GROUP BY 1")
_round = "r{n} AS (SELECT id, 0.15::DOUBLE + 0.85::DOUBLE * (coalesce(units, 0)::DOUBLE / 1e12::DOUBLE) AS score FROM cases LEFT JOIN (SELECT cited, sum(floor(score * share * 1e12::DOUBLE + 0.5::DOUBLE)::BIGINT) AS units FROM pairs JOIN r{p} ON citing = id GROUP BY 1) ON id = cited)"
_add("G2_influence", lambda s, d: citations.influence(cases(s, d), s.table("edges")), None)
ORACLE_SQL["G2_influence"] = oracle("SELECT 1").removesuffix("SELECT 1") + ", deg AS (SELECT citing AS c, count(*) AS degree FROM edges GROUP BY 1), pairs AS (SELECT citing, cited, count(*)::DOUBLE / max(degree) AS share FROM edges JOIN deg ON c = citing GROUP BY 1, 2), r0 AS (SELECT id, 1.0::DOUBLE AS score FROM cases), " + ", ".join(_round.format(n=k + 1, p=k) for k in range(10)) + " SELECT id, score FROM r10"
_add("A12_network_stats", lambda s, d: jobs_ops.network_stats(citations.degrees(cases(s, d), s.table("edges")), citations.influence(cases(s, d), s.table("edges"))))
ORACLE_SQL["A12_network_stats"] = ORACLE_SQL["G2_influence"].removesuffix("SELECT id, score FROM r10") + "SELECT (SELECT count(*) FROM cases) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM cases), 9) AS mean_in, round((SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM cases), 9) AS mean_out, (SELECT id FROM r10 ORDER BY round(score, 9) DESC, id LIMIT 1) AS most_influential"
_add("A14_quality_metrics", _on(cases, quality.quality_metrics), "SELECT count(*) AS total, count(*) FILTER (quality_score >= 0.8) AS high, count(*) FILTER (quality_score >= 0.6 AND quality_score < 0.8) AS medium, count(*) FILTER (quality_score < 0.6) AS low, round(avg(quality_score), 9) AS average FROM cases")
_H = "sha256(concat_ws('|', translate(trim(regexp_replace(lower(case_name), '\\s+', ' ', 'g')), '.,;:()[]\"''', ''), lower(court), lower(jurisdiction)))"
_add("A16_duplicate_groups", _on(cases, quality.duplicate_groups), f"SELECT {_H} AS hash, count(*) AS n, first(id ORDER BY quality_score DESC, id) AS best FROM cases GROUP BY 1 HAVING count(*) > 1")
_add("V8_first_seen", _on(cases, quality.first_seen), f"SELECT id, row_number() OVER (PARTITION BY {_H} ORDER BY decision_date, case_key) > 1 AS seen_before FROM cases")
_FIVE = " UNION ALL ".join(f"SELECT id, decision_date, quality_score, '{k}' AS kind, sha256({v}) AS hash FROM cases WHERE {w}" for k, v, w in (
    ("case_number", "case_number", "case_number <> ''"), ("case_name", "translate(trim(regexp_replace(lower(case_name), '\\s+', ' ', 'g')), '.,;:()[]\"\'\'', '')", "case_name <> ''"), ("court_case_number", "concat(court, '|', case_number)", "court <> '' AND case_number <> ''"),
    ("content_fingerprint", "substring(summary, 1, 500)", "strlen(summary) > 100"), ("structural", "concat(jurisdiction, '|', court, '|', case_name, '|', court_level)", "true")))
_add("A16_hash_groups", _on(cases, lambda d: quality.hash_groups(d).withColumn("ids", F.array_join("ids", ","))), f"SELECT kind, hash, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids, first(id ORDER BY quality_score DESC, id) AS best FROM ({_FIVE}) GROUP BY 1, 2 HAVING count(*) > 1")
_add("V8_duplication", _on(cases, lambda d: quality.duplication(d).withColumn("seen", F.array_join("seen", ","))), f"SELECT id, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (other <> id), '') AS seen, round(1 - 0.2 * count(*) FILTER (other <> id), 9)::DOUBLE AS score FROM (SELECT *, lag(id) OVER (PARTITION BY kind, hash ORDER BY decision_date, id) AS other FROM ({_FIVE})) GROUP BY id")
_add("T3_normalise", _on(cases, lambda d: d.select("id", quality.normalised(F.col("case_name")).alias("text"))), "SELECT id, translate(trim(regexp_replace(lower(case_name), '\\s+', ' ', 'g')), '.,;:()[]\"''', '') AS text FROM cases")
_add("R8_R10_rates", _on(jobs, lambda j: metrics.rates(j)), "SELECT date_trunc('hour', created_at) AS window_start, type, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'failed') / count(*), 6) AS error_ratio, round(avg(duration), 6) AS mean_duration FROM jobs GROUP BY 1, 2")
_add("A19_latency", _on(jobs, metrics.latency), "SELECT type, len(d)::INT AS n, d[1] AS least, d[-1] AS greatest, d[(len(d) * 50 // 100 + 1)::INT] AS p50, d[(len(d) * 95 // 100 + 1)::INT] AS p95, d[(len(d) * 99 // 100 + 1)::INT] AS p99 FROM (SELECT type, list(duration ORDER BY duration) AS d FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, job_id DESC) AS k FROM jobs) WHERE k <= 1000 GROUP BY 1)")
_add("A20_success", _on(jobs, metrics.success), "SELECT type, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'completed') / count(*) * 100, 6) AS rate FROM jobs GROUP BY 1")
_add("A24_buckets", _on(jobs, metrics.buckets), "SELECT type, le, count(*) FILTER (duration <= le) AS n FROM jobs, (SELECT unnest([1.0::DOUBLE, 5.0, 10.0, 50.0]) AS le) GROUP BY 1, 2")

_HAS = lambda c, *words: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"
_add("E3_court_type", _on(cases, lambda d: d.groupBy("court", enrichment.court_type(F.col("court")).alias("court_type")).agg(F.count("*").alias("n"))), f"SELECT court, CASE WHEN {_HAS('court', 'supreme', 'final')} THEN 'supreme' WHEN {_HAS('court', 'appeal')} THEN 'appellate' ELSE 'trial' END AS court_type, count(*) AS n FROM cases GROUP BY 1, 2")
_add("X7_synonyms", _on(cases, lambda d: d.groupBy(F.col("status").alias("word")).agg(F.count("*").alias("n")).select("word", F.array_join(enrichment.expanded(F.concat(F.lit("Contract "), "word", F.lit(" appeal"))), ",").alias("words"))), "SELECT status AS word, concat('contract,agreement,covenant,accord,', status, ',appeal,review,reconsideration') AS words FROM cases GROUP BY 1")
_CONCEPTS = [("Reasonable Doubt", "criminal", ["reasonable doubt", "beyond reasonable doubt", "burden of proof", "standard of proof"], 10), ("Offer and Acceptance", "contract", ["offer", "acceptance", "agreement", "meeting of minds", "consensus ad idem"], 10)]
_add("N1_concepts", _on(cases, lambda d: enrichment.concept_scores(d.select("id", "summary"), F.col("summary"), _CONCEPTS).select("id", "concept", "area", F.round("confidence", 9).alias("confidence"))), f"""SELECT * FROM (SELECT id, 'Reasonable Doubt' AS concept, 'criminal' AS area, round(0.9 * (1.5 * 5) / 11 + 0.1, 9)::DOUBLE AS confidence FROM cases WHERE {_HAS('summary', 'beyond reasonable doubt')}
 UNION ALL SELECT id, 'Offer and Acceptance', 'contract', round(0.9 * 3.0 / 9 + 0.1, 9)::DOUBLE FROM cases WHERE {_HAS('summary', 'offer and acceptance')})""")
_add("K11_upsert", _on(cases, lambda d: (lambda b: validation.upsert(b, b.filter("status = 'pending'").withColumn("status", F.lit("closed")), "id", "decision_date"))(d.select("id", "status", "decision_date"))), "SELECT id, CASE status WHEN 'pending' THEN 'closed' ELSE status END AS status, decision_date FROM cases")
_add("K12_delete", _on(cases, lambda d: validation.deleted(d.select("id", "court"), d.filter("court_level = 2"), "id")), "SELECT id, court FROM cases WHERE court_level <> 2")
_add("O3b_keyset_page", _on(cases, lambda d: validation.page_after(d.select("id", "status"), "id", "eyJpZCI6ICJjYXNlLTMwMCJ9", 25)), "SELECT id, status, (SELECT count(*) FROM cases WHERE id > 'case-300') > 25 AS has_more FROM cases WHERE id > 'case-300' ORDER BY id LIMIT 25")
_add("O5_dequeue", _on(jobs, lambda j: jobs_ops.dequeue_order(j, 40).select("job_id", "priority")), "SELECT job_id, priority FROM jobs ORDER BY priority DESC, created_at, job_id LIMIT 40")
_add("A22_counters", _on(jobs, jobs_ops.counters), "SELECT CASE grouping_id(type, priority) WHEN 1 THEN 'type' WHEN 2 THEN 'priority' ELSE 'all' END AS dimension, coalesce(type, priority::VARCHAR, '') AS value, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(sum(duration), 4) AS total_duration FROM jobs GROUP BY GROUPING SETS ((type), (priority), ())")
_add("A17_dead_letters", _on(jobs, jobs_ops.dead_letters), "SELECT type, count(*) AS n, min(created_at) AS oldest, max(created_at) AS newest FROM jobs WHERE status = 'failed' GROUP BY 1")
_add("J15_routing", lambda s, d: jobs_ops.routed(jobs(s, d).select("job_id", "type"), s.createDataFrame([("audit", ""), ("alerts", "error")], "subscriber string, type string")), "SELECT job_id, type, 'audit' AS subscriber FROM jobs UNION ALL SELECT job_id, type, 'alerts' FROM jobs WHERE type = 'error'")
_add("A7_storage_stats", lambda s, d: cases(s, d).agg(F.count("*").alias("n")).withColumn("kind", F.lit("cases")).unionByName(s.table("edges").agg(F.count("*").alias("n")).withColumn("kind", F.lit("citations"))).unionByName(s.table("supplier").agg(F.count("*").alias("n")).withColumn("kind", F.lit("judges"))), "SELECT 'cases' AS kind, count(*) AS n FROM cases UNION ALL SELECT 'citations', count(*) FROM edges UNION ALL SELECT 'judges', count(*) FROM supplier")
_add("A25_judge_cases", lambda s, d: (register(s, d), s.table("lineitem").groupBy(F.col("l_suppkey").alias("judge")).agg(F.count_distinct("l_orderkey").alias("n")))[1], "SELECT l_suppkey AS judge, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
_add("S7_F16_judges", lambda s, d: (register(s, d), s.table("supplier").filter(F.contains(F.lower("s_name"), F.lit("0000"))).select(F.col("s_suppkey").alias("judge"), F.col("s_name").alias("name")).orderBy("name"))[1], "SELECT s_suppkey AS judge, s_name AS name FROM supplier WHERE contains(lower(s_name), '0000')")
_add("S8_citations_of", _on(edges, lambda e: e.filter("citing = 'case-5' or cited = 'case-5'")), "SELECT citing, cited FROM edges WHERE citing = 'case-5' OR cited = 'case-5'")

for _module in (find_plans, law_plans, output_plans, stream_plans, validation_plans):
    _module.register(_add)
