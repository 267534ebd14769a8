"""Exports read back, staged writes, updates, batches, files, plugins and edge cases that the tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from casewright import plugins
from casewright.functions import export, text
from casewright.operators import citations, maintenance, search
from casewright.sources import files, html
from casewright.sources.cases import dockets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def some(spark):
    return dockets(spark, SF).filter("case_key <= 200").persist()


def test_exports_read_back(spark, some, tmp_path):
    n = some.count()
    export.export(some, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert back.columns == [c for c, _ in export.CSV] and back.count() == n
    assert {r["ID"]: r["Judges"] for r in back.collect()} == {r["id"]: "; ".join(r["judges"]) or None for r in some.collect()}
    export.export(some, str(tmp_path / "xml"), "xml", fields=["id", "court", "court_level"])
    back = spark.read.format("xml").option("rowTag", "case").load(str(tmp_path / "xml"))
    assert sorted(r["id"] for r in back.collect()) == sorted(r["id"] for r in some.select("id").collect())
    export.export(some, str(tmp_path / "lines"), "jsonl", fields=["id", "full_text"], include_full_text=False, compress=True, rows_per_file=50)
    back = spark.read.json(str(tmp_path / "lines"))
    assert back.columns == ["id"] and back.count() == n
    assert len([f for f in (tmp_path / "lines").iterdir() if f.name.endswith(".txt.gz")]) >= n // 50
    assert len(json.loads(export.json_document(some.select("id", "judges")).first()[0])) == n
    export.export(some.coalesce(1), str(tmp_path / "md"), "markdown", rows_per_file=0)
    assert sum(f.read_text().count("\n---\n") for f in (tmp_path / "md").iterdir() if f.suffix == ".txt") == n


def test_transactions(spark, some, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    some.select("id").write.parquet(a)
    t = maintenance.Transaction(spark)
    t.write(some.select("id").limit(3), a)
    t.write(some.select("court").limit(2), b)
    t.rollback()
    assert spark.read.parquet(a).count() == some.count() and not (tmp_path / "b").exists()
    t = maintenance.Transaction(spark)
    t.write(some.select("id").limit(3), a)
    t.write(some.select("court").limit(2), b)
    t.commit()
    assert spark.read.parquet(a).count() == 3 and spark.read.parquet(b).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_updates(spark, some):
    base = some.select("id", "status", F.col("decision_date").alias("last_updated"))
    out = maintenance.updated(base, spark.createDataFrame([("case-1", "sealed")], "id string, status string"), "id", "last_updated", "2024-05-01").filter("id = 'case-1'").first()
    assert out["status"] == "sealed" and str(out["last_updated"]).startswith("2024-05-01")
    with pytest.raises(KeyError):
        maintenance.updated(base, spark.createDataFrame([("case-x", "a")], "id string, status string"), "id", "last_updated", "2024-05-01")


def test_batches(some):
    got = list(maintenance.batches(some.select("id"), 10))
    assert [len(x) for x in got[:-1]] == [10] * (len(got) - 1) and sum(map(len, got)) == some.count()


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "d" / "b.txt").write_text("two\n")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    got = files.documents(spark, str(tmp_path)).collect()
    assert sorted(r["text"] or "" for r in got) == ["", "one", "two\n"]


def test_pages(spark):
    page = '<html><title>T</title><h1 class="case-title x">Foo v. Bar</h1><p>Date: 15 January 2023<p>Before: A, B and C</p><div class="judgment-body">Held<script>no</script> so.</div><div class="result"><a href="/2023scc15.html">Foo &amp; Co</a></div><div class="result"><b>no link</b></div>'
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<blockquote><p><b>Old v. New</b></p></blockquote>")], "page_id long, html string")
    got = {r["id"]: r for r in html.details(df).collect()}
    assert got[1]["case_name"] == "Foo v. Bar" and got[1]["decided"] == "Date: 15 January 2023" and got[1]["judges"] == "Before: A, B and C" and got[1]["body"] == "Held so."
    assert got[2]["case_name"] is None and got[3]["body"] is None and got[4]["case_name"] == "Old v. New"
    assert [tuple(r) for r in html.results(df, "div.result").orderBy("place").collect()] == [(1, 0, "Foo & Co", "/2023scc15.html"), (1, 1, "no link", None)]


def test_strict_dates_fail(spark):
    with pytest.raises(Exception, match="(?i)parse|datetime"):
        spark.createDataFrame([("1 May 2020",)], "t string").select(text.strict_date(F.col("t"))).collect()


def test_chains(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a"), ("c", "e"), ("x", "x")], "citing string, cited string")
    chain = lambda a, b: [r["path"] for r in citations.shortest_chain(e, a, b).collect()]
    assert chain("a", "e") == [["a", "b", "c", "e"]] and chain("a", "a") == [["a"]] and chain("e", "a") == [] and chain("a", "nowhere") == []
    depth = lambda a, m=12: tuple(citations.depth(e, a, m).first())
    assert depth("a") == (4, False) and depth("e") == (1, False) and depth("nowhere") == (0, False) and depth("a", 2) == (2, True)


def test_search_refuses(some):
    with pytest.raises(ValueError, match="limit"):
        search.Query(limit=0)
    with pytest.raises(ValueError, match="column"):
        search.ordered(some, "1; drop", True)


def test_plugins(spark, some):
    r = plugins.Registry()
    r.register(plugins.Processor("upper", lambda d: {"court": F.upper("court")}, lambda d: F.col("court_level") == 1, 1))
    r.register(plugins.Processor("mark", lambda d: {"court": F.concat("court", F.lit("!")), "marked": F.lit(True)}, priority=5))
    with pytest.raises(ValueError, match="registered"):
        r.register(plugins.Processor("mark", lambda d: {}))
    assert [p.name for p in r.processors()] == ["mark", "upper"] and r.count() == 2 and r.names(plugins.Processor) == ["mark", "upper"]
    got = {x["id"]: x for x in r.processed(some).collect()}
    for x in some.collect():
        assert got[x["id"]]["court"] == (x["court"].upper() if x["court_level"] == 1 else x["court"]) + "!" and got[x["id"]]["marked"]
    r.register(plugins.Validator("urls", lambda d: F.filter(F.array(F.struct(F.lit("url").alias("field"), F.lit("blank").alias("message"))), lambda m: F.col("url") == ""), "warning"))
    assert r.validated(some).filter("size(messages) > 0").count() == some.filter("url = ''").count()
    r.unregister(plugins.Processor, "mark")
    assert r.count(plugins.Processor) == 1
    r.register(plugins.Exporter("ids", lambda d: d.select(F.col("id").alias("value")), "ids"))
    assert r.get(plugins.Exporter, "ids").export(some).columns == ["value"]
    spark.dataSource.register(plugins.RecordSource)
    assert spark.read.format("sample_cases").option("rows", 7).option("parts", 3).load().count() == 7
    r.register(plugins.Source("sample", lambda s, o: s.read.format("sample_cases").options(**o).load()))
    assert r.get(plugins.Source, "sample").read(spark, {"rows": "3"}).count() == 3
    jobs = plugins.BatchJobs({"validate": lambda d: d.filter("url <> ''"), "broken": lambda d: d.select("nothing")})
    out = jobs.run(some, ["validate", "broken", "other"])
    assert [out[k]["status"] for k in ("validate", "broken", "other")] == ["completed", "failed", "failed"]
