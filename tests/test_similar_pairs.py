"""Similar pairs against brute force, with keys of many tiles, odd fields and pairs that agree on several keys."""

import datetime as dt
import re

from pyspark.sql import functions as F

from casewright.operators import scoring


def _similarity(a, b):
    scores = [float(x == y) for x, y in zip(a[1:4], b[1:4], strict=True) if x and y]
    for x, y in zip(a[4:6], b[4:6], strict=True):
        if x and y:
            x, y = set(x.lower().split()), set(y.lower().split())
            scores.append(len(x & y) / max(len(x | y), 1))
    if a[6] and b[6]:
        scores.append(max(1 - abs((a[6] - b[6]).days) / 365, 0.0))
    return sum(scores) / max(len(scores), 1)


def test_similar_pairs(spark):
    names, texts = ["Doe v. Roe", "DOE v. Poe", " ", "", None, "a b c d e"], ["one two three", "three two one four", "", None, " ".join(f"w{k}" for k in range(90)), " ".join(f"w{k}" for k in range(9, 99))]
    rows = [
        (f"c{k}", ["n/a", "n/a", "", None, "7"][k % 5], ["A", "B", None][k % 3], "" if k % 7 == 0 else "J", names[k % 6], texts[k * 5 // 3 % 6], None if k % 11 == 0 else dt.datetime(2000, 1, 1) + dt.timedelta(days=k * 9))
        for k in range(120)
    ]
    d = spark.createDataFrame(rows, "id string, case_number string, court string, jurisdiction string, case_name string, summary string, decision_date timestamp")
    keys = [F.when(F.col(c) != "", F.concat(F.lit(c), F.col(c))) for c in ("case_number", "case_name")]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and any(a[k] and a[k] == b[k] for k in (1, 4)) and _similarity(a, b) >= 0.6:
                want[a[0], b[0]] = round(_similarity(a, b), 9)
    assert len(want) > 100
    for tile in (7, 2000):
        got = scoring.similar_pairs(d, keys, 0.6, tile).collect()
        assert len(got) == len(want) and {(r["left"], r["right"]): round(r["similarity"], 9) for r in got} == want


def test_no_pair_is_stored(spark):
    d = spark.range(20).selectExpr("cast(id as string) as id", "'n/a' as case_number", "'x' as case_name", "'c' as court", "'j' as jurisdiction", "timestamp'2000-01-01' as decision_date", "'s' as summary")
    plan = scoring.similar_pairs(d, [F.col("case_number"), F.col("case_name")], 0.6)._jdf.queryExecution().executedPlan().toString()
    above = plan[: re.search("SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", plan).start()]
    assert "Exchange" not in above and "Aggregate" not in above
