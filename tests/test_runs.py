"""Run bookkeeping that isn't a query: files in and out, guards, orders; and the stream of daily counts."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import census, runs, toc
from vellumspark.operators import package_files as P
from vellumspark.streaming import census as stream


def test_an_earlier_audit_is_read_without_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fatals,errors,warnings,path\n1,2,3,/lib/a.epub\nx,1,1,/lib/b.epub\n0,0,0,\"/lib/c, d.epub\"\nnonsense\n")
    got = {tuple(r) for r in runs.audit_csv(spark, f"file://{tmp_path}/a.csv").collect()}
    assert got == {(1, 2, 3, "/lib/a.epub"), (0, 0, 0, "/lib/c, d.epub")}


def test_artifacts_stay_out_of_the_library(spark, tmp_path):
    with pytest.raises(ValueError, match="scanned"):
        runs.checked_output(f"file://{tmp_path}/lib/x.json", f"{tmp_path}/lib")
    assert runs.checked_output(f"{tmp_path}/library/x", f"{tmp_path}/lib") == f"{tmp_path}/library/x"
    outcomes = spark.createDataFrame([("a", "accept", True), ("b", "partial", False)], "path string, status string, applied boolean")
    made = json.loads(runs.artifact("apply", "/lib", runs.run_counts(outcomes), {"only": "all"}))
    assert made["summary"]["accepted"] == 1 and made["summary"]["candidates"] == 2 and made["only"] == "all"
    runs.written_report(outcomes, f"file://{tmp_path}/out", f"file://{tmp_path}/lib")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_orders_and_limits(spark):
    paths = spark.createDataFrame([("c",), ("a",), ("b",)], "path string")
    assert [r.path for r in runs.candidates(paths, 2).collect()] == ["a", "b"] and runs.candidates(paths).count() == 3
    buckets = spark.createDataFrame([("6-20",), ("0",), (">100",), ("21-100",), ("3-5",), ("2",)], "bucket string")
    assert [r.bucket for r in buckets.orderBy(runs.bucket_order(F.col("bucket"))).collect()] == ["0", "2", "3-5", "21-100", "6-20", ">100"]
    docs = lambda *pos: spark.createDataFrame([("b", k) for k in pos], "book_id string, pos long")
    assert [r.pos for r in runs.corpus(docs(5, 1), docs(0)).orderBy("rank").collect()] == [1, 5, 0]
    codes = spark.createDataFrame([("A", 5), ("B", 9), ("C", 9)], "code string, messages long")
    assert [r.code for r in census.top_codes(codes, 2).collect()] == ["B", "C"]


def test_totals_and_trouble_of_a_run(spark):
    cols = ", ".join(f"{side}_{k} int" for side in ("before", "after") for k in ("fatals", "errors", "warnings"))
    rows = [(2, 1, 0, 0, 1, 0, True, "accept"), (1, 0, 0, 3, 0, 0, False, "reject")]
    got = runs.phase3(spark.createDataFrame(rows, f"{cols}, applied boolean, status string")).first()
    assert (got.before_fatals, got.after_fatals, got.projected_fatals, got.trouble) == (3, 1, 3, 1)


def test_references_of_both_tables_of_contents(spark):
    file = lambda path, text: spark.createDataFrame([("b", path, text)], "book_id string, path string, text string")
    ncx = P.elements(file("toc.ncx", '<ncx><navMap><navPoint><content src="a.html#x"/></navPoint><navPoint><content src="gone.html"/></navPoint></navMap></ncx>'))
    nav = P.elements(file("nav.html", '<nav><a href="b.html">x</a><a href="#here">y</a><a href="http://z">z</a></nav><a href="else.html">no</a>'))
    refs = P.toc_references(ncx, nav)
    names = spark.createDataFrame([("b", "a.html"), ("b", "b.html")], "book_id string, path string")
    assert tuple(toc.accounting(refs, names).first()) == ("b", 3, 1)


def test_days_are_counted_once_they_are_over(spark, tmp_path):
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    rows = [(at(1, 1), "click"), (at(1, 5), "click"), (at(2, 1), "view"), (at(3, 2), "click")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = stream.daily_counts(events).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("click", 2), ("view", 1)}
