"""The cases, edges, jobs and metrics views, derived from the base tables by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

CASES = """
SELECT concat('case-', o_orderkey) AS id, o_orderkey AS case_key, o_custkey AS party_key,
  CASE o_orderkey % 5
    WHEN 0 THEN concat('[', cast(year(o_orderdate) AS string), '] UKSC ', cast(o_orderkey AS string))
    WHEN 1 THEN concat('[', cast(year(o_orderdate) AS string), '] HCA ', cast(o_orderkey AS string))
    WHEN 2 THEN concat('[', cast(year(o_orderdate) AS string), '] IESC ', cast(o_orderkey AS string))
    WHEN 3 THEN concat(cast(year(o_orderdate) AS string), ' SCC ', cast(o_orderkey AS string))
    ELSE concat(cast(o_orderkey AS string), ' U.S. ', cast(o_custkey AS string), ' (', cast(year(o_orderdate) AS string), ')') END AS case_number,
  concat(c_name, ' v. ', n_name) AS case_name,
  CASE o_orderkey % 5 WHEN 0 THEN 'UK Supreme Court' WHEN 1 THEN 'High Court of Australia' WHEN 2 THEN 'Court of Appeal'
    WHEN 3 THEN 'Supreme Court of Canada' ELSE 'U.S. District Court' END AS court,
  cast(1 + o_orderkey % 5 AS int) AS court_level, r_name AS jurisdiction, o_orderdate AS decision_date,
  cast(year(o_orderdate) AS int) AS year,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'closed' ELSE 'pending' END AS status,
  cast(o_orderkey % 101 AS double) / 100 AS quality_score,
  CASE o_orderkey % 7
    WHEN 0 THEN 'The claim in negligence turned on the duty of care owed by the defendant.'
    WHEN 1 THEN 'Damages for breach of contract were assessed after an offer and acceptance.'
    WHEN 2 THEN 'An application for judicial review of the decision was allowed.'
    WHEN 3 THEN 'The prosecution must prove guilt beyond reasonable doubt at trial.'
    WHEN 4 THEN 'The patent was held invalid for want of an inventive step.'
    WHEN 5 THEN 'An appeal against conviction for tax evasion was dismissed.'
    ELSE 'Custody of the child was granted to the mother.' END AS summary
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

#: A case cites the one before it of the same party, and those that share a part's smallest line.
EDGES = """
SELECT concat('case-', k) AS citing, concat('case-', p) AS cited FROM (
  SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) chain
WHERE p IS NOT NULL
UNION ALL
SELECT concat('case-', l_orderkey), concat('case-', first_key) FROM (
  SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY l_partkey) AS first_key FROM lineitem) shared
WHERE l_orderkey <> first_key
"""

JOBS = """
SELECT event_id AS job_id, event_type AS type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  ts AS created_at, value AS duration, cast(1 + user_id % 3 AS int) AS priority FROM events
"""


#: Cases with all fields, lists among them, and with the defects that rules look for.
DOCKETS = """
SELECT id, case_key,
  CASE WHEN case_key % 23 = 0 THEN '' WHEN case_key % 29 = 0 THEN 'n/a' WHEN case_key % 31 = 0 THEN '77/1999' ELSE case_number END AS case_number,
  CASE WHEN case_key % 37 = 0 THEN NULL WHEN case_key % 41 = 0 THEN upper(case_name) WHEN case_key % 43 = 0 THEN concat(case_name, repeat('x', 600))
    WHEN case_key % 47 = 0 THEN 'R v Test' ELSE case_name END AS case_name,
  CASE WHEN case_key % 53 = 0 THEN '' WHEN case_key % 11 = 0 THEN 'scotus' WHEN case_key % 13 = 0 THEN 'High Court'
    WHEN case_key % 17 = 0 THEN 'Tax Court of Appeal' WHEN case_key % 19 = 0 THEN 'Military Court' ELSE court END AS court,
  CASE WHEN case_key % 59 = 0 THEN 0 ELSE court_level END AS court_level,
  CASE jurisdiction WHEN 'AMERICA' THEN 'United States' WHEN 'EUROPE' THEN 'United Kingdom' WHEN 'ASIA' THEN 'India' WHEN 'AFRICA' THEN 'Canada'
    ELSE CASE WHEN case_key % 2 = 0 THEN '' ELSE 'Australia' END END AS jurisdiction,
  CASE WHEN case_key % 61 = 0 THEN NULL WHEN case_key % 67 = 0 THEN cast('1750-05-04 00:00:00' AS timestamp) ELSE cast(decision_date AS timestamp) END AS decision_date,
  CASE WHEN case_key % 3 = 0 THEN NULL WHEN case_key % 31 = 0 THEN cast('2002-01-01 00:00:00' AS timestamp) ELSE cast('1994-01-01 00:00:00' AS timestamp) END AS filing_date,
  status, CASE WHEN case_key % 71 = 0 THEN NULL ELSE quality_score END AS quality_score,
  CASE WHEN case_key % 73 = 0 THEN '' WHEN case_key % 79 = 0 THEN upper(summary) WHEN case_key % 83 = 0 THEN concat(summary, ' aaaaaaa')
    WHEN case_key % 89 = 0 THEN '!!!! #### ++++ %% %% &&&& **** (((( )))) ---- ++++ ==== ////' WHEN case_key % 97 = 0 THEN 'too short'
    WHEN case_key % 14 = 3 THEN concat(summary, ' The appeal was reversed; the dissent would have affirmed.') ELSE summary END AS summary,
  CASE WHEN case_key % 15 = 4 THEN '' ELSE concat(summary, ' We follow 0', cast(case_key AS string), ' f.2d 0012 (1975), [2003] UKSC 0', cast(case_key % 100 AS string),
    ', [2010] EWCA Civ ', cast(case_key AS string), ', ECLI:EU:C:2001:', cast(case_key AS string), ', [1999] XYZ 5 and 2010 SCC 007. ',
    CASE case_key % 12 WHEN 0 THEN 'The charter was invoked.' WHEN 1 THEN 'The agency issued a permit.' WHEN 2 THEN 'The customs office objected.'
      WHEN 3 THEN 'An alimony order stood.' WHEN 4 THEN 'The creditor proved in the insolvency.' WHEN 5 THEN 'Wages were unpaid at the workplace.'
      WHEN 6 THEN 'A trademark was used.' WHEN 7 THEN 'The pollution went on.' WHEN 8 THEN 'The merger was opposed.' WHEN 9 THEN 'The nuisance stopped.'
      WHEN 10 THEN 'A warranty was given.' ELSE 'The lease ran out.' END) END AS full_text,
  {judges} AS judges, {parties} AS parties, {concepts} AS legal_concepts, {citations} AS citations,
  CASE case_key % 17 WHEN 3 THEN '' WHEN 5 THEN 'ftp://example.org/a' ELSE concat('https://example.org/cases/', cast(case_key AS string), '.html') END AS url,
  CASE WHEN case_key % 4 = 1 THEN concat('https://example.org/cases/', cast(case_key AS string), '.pdf') ELSE '' END AS pdf_url,
  CASE case_key % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'unlisted' ELSE '' END AS source_database,
  CASE WHEN case_key % 6 = 1 THEN 'trial' ELSE '' END AS court_type, CASE WHEN case_key % 8 = 1 THEN 'allowed' ELSE '' END AS outcome,
  CASE WHEN case_key % 9 = 1 THEN 'Judge 1' ELSE '' END AS chief_judge
FROM cases
"""
_LISTS = {
    "judges": "CASE case_key % 4 WHEN 0 THEN '' WHEN 1 THEN concat('Judge ', cast(case_key % 11 AS string)) ELSE concat('Judge ', cast(case_key % 11 AS string), '; Judge ', cast(case_key % 13 AS string)) END",
    "parties": "CASE case_key % 5 WHEN 0 THEN '' WHEN 1 THEN concat('Party ', cast(party_key AS string)) WHEN 2 THEN concat('Party ', cast(party_key AS string), ';  ') ELSE concat('Party ', cast(case_key % 50 AS string), '; Party ', cast(party_key AS string)) END",
    "concepts": "CASE case_key % 6 WHEN 0 THEN '' WHEN 1 THEN 'Criminal Law' WHEN 2 THEN 'Negligence; Duty of Care' WHEN 3 THEN 'Criminal Procedure; Evidence; Burden of Proof' WHEN 4 THEN 'Contract Law' ELSE 'a; b; c; d; e; f; g; h; i; j; k; l' END",
    "citations": "CASE case_key % 7 WHEN 0 THEN '' WHEN 1 THEN '2010 SCC 7' ELSE '[2003] UKSC 1; 2010 SCC 7; 1 U.S. 2 (1801)' END",
}


def dockets_sql(spark: bool) -> str:
    """DOCKETS for Spark or for DuckDB, which split texts into lists by other names."""
    split = "filter(split({}, '; '), x -> x <> '')" if spark else "list_filter(string_split({}, '; '), lambda x: x <> '')"
    return DOCKETS.format(**{k: split.format(v) for k, v in _LISTS.items()})


def dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(dockets_sql(True))


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the base tables and of what derives from them."""
    for name in BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in (("cases", CASES), ("edges", EDGES), ("jobs", JOBS)):
        spark.sql(sql).createOrReplaceTempView(name)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table("cases")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table("edges")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table("jobs")


def oracle(body: str) -> str:
    """body with the derived tables in front, for an engine that has the base tables."""
    return f"WITH cases AS ({CASES}), edges AS ({EDGES}), jobs AS ({JOBS}), dockets AS ({dockets_sql(False)}) {body}"
