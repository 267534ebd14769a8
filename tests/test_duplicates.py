"""The five hashes of a case, where the base tables have no duplicates by number or summary."""

from casewright.operators import quality


def test_five_hashes(spark):
    long = "é" * 249 + "ab"  # 500 bytes
    rows = [
        ("a", "2000-01-01", "N 1", "Doe v. Roe", "C1", "short", "J", 1, 0.2),
        ("b", "2000-01-02", "N 1", "Other", "C1", "short", "J", 1, None),
        ("c", "2000-01-03", "N 2", "DOE  v Roe", "C2", long + "x", "J", 1, 0.9),
        ("d", "2000-01-04", "", "", None, long + "y", None, None, 0.1),
        ("e", "2000-01-05", None, None, "", "é" * 50, "", 0, 0.3),
        ("a", "2000-01-06", "N 1", "Doe v. Roe", "C1", "short", "J", 1, 0.2),
    ]
    df = spark.createDataFrame(rows, "id string, decision_date string, case_number string, case_name string, court string, summary string, jurisdiction string, court_level int, quality_score double")
    groups = sorted((r["kind"], tuple(r["ids"]), r["n"], r["best"]) for r in quality.hash_groups(df).collect())
    assert groups == [
        ("case_name", ("a", "a", "c"), 3, "c"), ("case_number", ("a", "a", "b"), 3, "a"), ("content_fingerprint", ("c", "d"), 2, "c"),
        ("court_case_number", ("a", "a", "b"), 3, "a"), ("structural", ("a", "a"), 2, "a"), ("structural", ("d", "e"), 2, "e"),
    ]
    seen = sorted((r["id"], ",".join(r["seen"]), r["score"]) for r in quality.duplication(df).collect())
    assert seen == [
        ("a", "", 1.0), ("a", "case_name,case_number,court_case_number", 0.4), ("b", "case_number,court_case_number", 0.6),
        ("c", "case_name", 0.8), ("d", "content_fingerprint", 0.8), ("e", "structural", 0.8),
    ]
