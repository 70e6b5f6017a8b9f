"""Archives and findings as data sources: round trips, push-down, splits, commits that leave nothing half done."""

from __future__ import annotations

import csv
import gzip
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sitelens import schemas, sql
from sitelens.sinks import committed, corpus
from sitelens.sources import archive

#: As text, with headers as JSON, as sets of maps cannot be compared.
PLAIN = ["url", "CAST(body AS string) AS body", "status", "content_type", "location", "to_json(headers) AS headers", "error", "fetched_at"]


@pytest.fixture(scope="module")
def responses(spark):
    return spark.range(1000).selectExpr(
        "concat('https://h', id % 10, '.example.com/p/', id) AS url", "CASE WHEN id % 50 <> 0 THEN CAST(repeat('x\r\n\r\nWARC/1.0 \r\n\r\nWARC/1.1\r\nno: field\r\n', CAST(id % 7 AS int)) AS binary) END AS body",
        "CAST(CASE WHEN id % 50 <> 0 THEN 200 + id % 5 END AS int) AS status", "CASE WHEN id % 50 <> 0 AND id % 4 <> 0 THEN 'text/html' END AS content_type", "CASE WHEN id % 50 <> 0 AND id % 3 = 0 THEN '/x' END AS location",
        "CASE WHEN id % 50 = 0 THEN CAST(map() AS map<string,string>) ELSE map('Server', 's: 1', 'X-Id', CAST(id AS string)) END AS headers", "CASE WHEN id % 50 = 0 THEN 'rate' END AS error",
        "CASE WHEN id % 13 <> 0 THEN timestamp_micros(1700000000000000 + id * 1234567) END AS fetched_at",
    ).repartition(4)


@pytest.fixture(scope="module")
def stored(responses, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive"))
    archive.write_archive(responses, path, fileBytes="40000")
    return path


def same(a, b) -> bool:
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_archive_gives_back_what_was_written(spark, responses, stored):
    want = responses.selectExpr(*PLAIN)
    for split in ("1000", "100000000"):
        assert same(archive.read_archive(spark, stored, splitBytes=split).selectExpr(*PLAIN), want)
    few = archive.read_archive(spark, stored, splitBytes="1000")
    assert few.rdd.getNumPartitions() > 60
    assert archive.read_archive(spark, stored, ["status", "url"]).columns == ["status", "url"]
    with pytest.raises(Exception, match="no column"):
        spark.read.format(archive.NAME).schema("nothing string").load(stored).collect()


@pytest.mark.parametrize(
    "condition",
    ["url LIKE 'https://h3%'", "status IN (201, 203)", "status = 204 AND url LIKE 'https://h9.%'", "url = 'https://h7.example.com/p/17'", "status > 202", "status <= 201 AND url > 'https://h5'", "status IS NULL", "status IS NOT NULL", "url LIKE '%/17'",
     "fetched_at > TIMESTAMP '2023-11-14 22:23:20Z'", "NOT status = 201", "status = 1000", "status <=> 203", "error = 'rate'", "url IN ('https://h7.example.com/p/17', 'x')", "length(body) > 100"],
)
def test_filters_that_the_archive_takes_over_change_nothing(spark, responses, stored, condition):
    want = responses.where(condition).selectExpr("url", "status")
    assert same(archive.read_archive(spark, stored).where(condition).select("url", "status"), want)
    if "body" not in condition:
        assert same(archive.read_archive(spark, stored, ["url", "status", "fetched_at", "error"]).where(condition).select("url", "status"), want)


def test_filters_and_columns_are_in_the_plan(spark, stored):
    plan = archive.read_archive(spark, stored, ["url", "status"]).where("url LIKE 'https://h3%' AND status IN (201, 202)")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(url,https://h3)" in plan and "In(status, [201,202])" in plan and "ReadSchema: struct<url:string,status:int>" in plan
    assert "Filter" not in plan.replace("PushedFilters", "")


def test_files_that_cannot_match_are_not_planned(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.range(100).selectExpr("concat('https://h', id % 5, '/', id) AS url", "CAST(200 + id % 5 AS int) AS status").repartitionByRange(5, "url")
    archive.write_archive(rows, path)
    count = lambda c: archive.read_archive(spark, path, ["url", "status"]).where(c).rdd.getNumPartitions()
    whole = count("true")
    assert whole >= 4 and count("url LIKE 'https://h2/%'") < whole and count("status = 203") < whole and count("url = 'https://h4/4'") == 1 and count("status = 999") == 1


def test_archives_of_others_are_read_without_index(spark, responses, stored, tmp_path):
    listed = committed.Folder(stored).files()
    for i, f in enumerate(listed):
        if i % 2:
            shutil.copy(f"{stored}/{f['name']}", tmp_path)
        else:
            with open(f"{stored}/{f['name']}", "rb") as raw, gzip.open(tmp_path / f"{f['name']}.gz", "wb") as out:
                shutil.copyfileobj(raw, out)
    for split in ("700", "5000", "100000000"):
        assert same(archive.read_archive(spark, str(tmp_path), splitBytes=split).selectExpr(*PLAIN), responses.selectExpr(*PLAIN))
    assert archive.read_archive(spark, str(tmp_path)).where("status = 203 AND url LIKE 'https://h3%'").select("location").count() == responses.where("status = 203 AND url LIKE 'https://h3%'").count()


def test_records_of_other_kinds_and_odd_ones():
    block = b"HTTP/1.1 200 OK\r\nContent-type: a\r\nX: 1\r\nX: 2\r\n\r\nbody\r\n\r\n"
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI: <https://e.org/>\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    import io

    rows = [archive.parsed(*r) for r in archive.records(io.BytesIO(text))]
    assert rows[0] is None and len(rows) == 2
    assert rows[1]["url"] == "https://e.org/" and rows[1]["body"] == b"body\r\n\r\n" and rows[1]["content_type"] == "a" and rows[1]["headers"] == [("X", "2")] and rows[1]["fetched_at"].year == 2020


FINDINGS = [
    ("email", f"m{i}@e.org", 0.5, i, i + 1, f"https://e.org/{i}", {"email_kind": "other"} if i % 2 else {}, [{"source_url": f"https://e.org/{i}", "collected_at": None, "extraction_layer": "text_heuristic", "raw_value": "é\n\"x\""}])
    for i in range(40)
] + [("technology", "=cmd", 0.75, 1, 1, "https://e.org/", {}, []), ("phone", "+33140000000", 0.5, 1, 1, None, None, None)]


@pytest.fixture(scope="module")
def findings(spark):
    return spark.createDataFrame(FINDINGS, schemas.FINDING).repartition(3)


def test_findings_round_trip(spark, findings, tmp_path):
    path = str(tmp_path / "f")
    corpus.write_findings(findings, path)
    plain = [c for c in findings.columns if c != "metadata"] + ["to_json(metadata) AS metadata"]
    for split in ("100", "1000000"):
        assert same(corpus.read_findings(spark, path, splitBytes=split).selectExpr(*plain), findings.selectExpr(*plain))
    few = corpus.read_findings(spark, path, ["field", "value"]).where("field = 'phone'")
    assert few.collect()[0]["value"] == "+33140000000" and few.rdd.getNumPartitions() == 1
    assert corpus.read_findings(spark, path).where("field IN ('phone', 'email') AND value = 'm3@e.org'").count() == 1
    assert corpus.read_findings(spark, path).where("field = 'email' AND page_support > 37").count() == 2
    corpus.write_findings(findings.where("field = 'phone'"), path)
    assert corpus.read_findings(spark, path).count() == 43
    corpus.write_findings(findings.where("field = 'phone'"), path, mode="overwrite")
    assert corpus.read_findings(spark, path).count() == 1 and len([f for f in os.listdir(path) if f.endswith(".jsonl")]) == 1


def test_findings_as_csv_are_guarded(spark, findings, tmp_path):
    path = tmp_path / "c"
    corpus.write_findings(findings, str(path), "csv")
    rows = []
    for f in committed.Folder(str(path)).files():
        raw = (path / f["name"]).read_bytes()
        assert raw.startswith(b"\xef\xbb\xbffield,value,") and raw.endswith(b"\r\n")
        rows += csv.DictReader(raw.decode("utf-8-sig").splitlines())
    assert len(rows) == 42 and {r["value"] for r in rows if r["field"] == "technology"} == {"'=cmd"} and {r["metadata"] for r in rows if r["field"] == "email"} == {"email_kind=other", ""}
    with pytest.raises(Exception, match="flat columns"):
        findings.write.format(corpus.NAME).option("kind", "csv").mode("append").save(str(tmp_path / "d"))
    with pytest.raises(Exception, match="jsonl or csv"):
        corpus.write_findings(findings, str(tmp_path / "d"), "doc")


def test_a_task_that_fails_leaves_nothing_to_read(spark, findings, responses, tmp_path):
    path = str(tmp_path / "f")
    corpus.write_findings(findings.where("field = 'phone'"), path)
    before = sorted(os.listdir(path))

    @F.udf("string")
    def breaks(value):
        if value == "m7@e.org":
            os._exit(1)  # as a killed worker: nothing of it can clean up
        return value

    with pytest.raises(Exception):
        corpus.write_findings(findings.withColumn("value", breaks("value")), path)
    assert corpus.read_findings(spark, path).count() == 1
    assert sorted(os.listdir(path)) == sorted({*before, "_staging"}) and not os.listdir(f"{path}/_staging")
    corpus.write_findings(findings, path)
    assert corpus.read_findings(spark, path).count() == 43


def test_what_no_commit_lists_is_not_read(spark, findings, tmp_path):
    path = str(tmp_path / "f")
    corpus.write_findings(findings, path)
    job = committed.Job(path, False)
    with job.file(".jsonl") as (name, raw):
        raw.write(b"{\"field\": \"ema")
    (tmp_path / "f/part-torn.jsonl").write_text("{")
    assert corpus.read_findings(spark, path).count() == 42
    job.commit([None, committed.Written([])])
    assert corpus.read_findings(spark, path).count() == 42 and not os.path.exists(job.staging)
    assert [json.loads((tmp_path / "f/_commits" / n).read_text())["overwrite"] for n in sorted(os.listdir(tmp_path / "f/_commits"))] == [False, False]
    with pytest.raises(ValueError, match="mounted"):
        committed.local("hdfs://x/y")


def test_lateral_extraction_does_not_join_pages_to_themselves(spark):
    sql.register(spark)
    headers = F.expr("array(named_struct('key', 'Server', 'value', 'nginx'))")
    pages = spark.createDataFrame([("https://e.org/", "<p>a@e.org"), ("https://e.org/b", "<p>a@e.org"), ("https://e.org/n", None)], "url string, html string").withColumn("headers", headers)
    rows = spark.sql("SELECT p.url, x.field, x.raw_value FROM {pages} AS p, LATERAL extracted(p.html, p.headers) AS x", pages=pages)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, rows.where("url <> 'https://e.org/n'").collect())) == [(u, f, v) for u in ("https://e.org/", "https://e.org/b") for f, v in (("email", "a@e.org"), ("technology", "nginx"))]
