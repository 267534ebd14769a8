"""Tiles of similar pairs: scored by arrays, in a stated number of partitions, with the rows of plain Python."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casewright.operators import scoring


def test_tiles_are_not_put_into_a_few_tasks(spark):
    d = spark.range(50).selectExpr("cast(id as string) as id", "'n/a' as case_number", "'x' as case_name", "'c' as court", "'j' as jurisdiction", "timestamp'2000-01-01' as decision_date", "'s' as summary")
    got = scoring.similar_pairs(d, [F.col("case_number"), F.col("case_name")], 0.6, 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(key#\d+, i#\d+, j#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(dealt) == 2 and min(dealt) >= 16 * spark.sparkContext.defaultParallelism
    assert got.count() == 50 * 49 // 2


def test_pairs_of_tiles():
    from casewright.operators import tiles

    rng, equal, worded = np.random.default_rng(5), ("case_number", "court", "jurisdiction"), ("case_name", "summary")
    one = lambda *x: x[rng.integers(len(x))]
    rows = []
    for k in range(90):
        r = {"id": f"{one('é', 'z', 'a', '𝒳')}{k}", "i": 0, "j": k // 60, "before": one([], ["p"], ["q"], ["q", "r"])}
        r |= {f: one("", "A", "B") for f in equal} | {f: sorted(one(*[[], [3], [1, 2, 3], [2, 3, 9], [5, 6]])) for f in worded} | {"day": int(rng.integers(0, 500))}
        r["has"] = sum(bool(r[f]) << b for b, f in enumerate((*equal, *worded))) + (int(rng.integers(2)) << 5)
        rows.append(r)

    def score(a, b):
        total = sum(float(a[f] == b[f] != "") for f in equal)
        for f in worded:
            total += len(set(a[f]) & set(b[f])) / max(len(set(a[f]) | set(b[f])), 1)
        both = a["has"] & b["has"]
        return (total + (max(1 - abs(a["day"] - b["day"]) / 365, 0.0) if both >= 32 else 0.0)) / max(both.bit_count(), 1)

    kinds = {"before": pa.list_(pa.string()), "has": pa.int32(), "day": pa.int32()} | {f: pa.list_(pa.int64()) for f in worded}
    table = lambda x: pa.table({c: pa.array([r[c] for r in x], kinds.get(c)) for c in rows[0]})
    out = pa.schema([("left", pa.string()), ("right", pa.string()), ("similarity", pa.float64())])
    first, second = rows[:60], rows[60:]
    for a, b, j in ((first, first, 0), (first, second, 1)):
        a = [r | {"j": j} for r in a]
        want = {}
        for x in a:
            for y in b:
                if (j or x["id"] < y["id"]) and not set(x["before"]) & set(y["before"]) and score(x, y) >= 0.6:
                    want[min(x["id"], y["id"]), max(x["id"], y["id"])] = score(x, y)
        got = tiles.pairs(table(a), table(b), 0.6, equal, worded, out).to_pylist()
        assert len(want) > 50 and len(got) == len(want) and {(r["left"], r["right"]): r["similarity"] for r in got} == want
