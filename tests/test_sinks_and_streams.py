"""Exports, ledger, configuration, streams."""

from __future__ import annotations

import csv
import datetime
import json
import tracemalloc
import zipfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens import schemas
from sitelens.operators import aggregate, health
from sitelens.sinks import ledger, report
from sitelens.sources import config
from sitelens.streaming import state, streams

AT = datetime.datetime(2024, 1, 2, 3, 4, 5)
RUN = {
    "run_id": "r-00000001", "started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:01:00Z", "outcome": "completed", "outcome_detail": None, "purpose_category": "self_audit",
    "purpose_note": "=note", "retention_days": 30, "tool_name": "sitelens", "tool_version": "1", "user_agent": "sitelens/1", "target_entered": "e.org", "target_url": "https://e.org/", "scope_host": "e.org",
    "include_subdomains": True, "max_pages": 200, "max_depth": 3, "request_interval_seconds": 1.0, "concurrent_requests": 2, "follow_sitemap": True, "phone_region": "FR", "requests_made": 3,
}


@pytest.fixture(scope="module")
def made(spark):
    rows = [("email", f"{x}@e.org", f"https://e.org/{i}", AT, "text_heuristic", {}, i) for i, x in enumerate(["info", "a", "a"])]
    rows += [("organization_name", "=cmd|[x](y) <b>", "https://e.org/0", AT, "structured_data", {}, 9)]
    found = aggregate.findings(aggregate.accepted(spark.createDataFrame(rows, schemas.CANDIDATE)))
    pages = spark.createDataFrame([("https://e.org/b", 1, "http_error", "gone", 404, None, 0), ("https://e.org/a", 1, "ok", None, 200, "text/html", 2), ("https://e.org/", 0, "skipped_robots", None, None, None, 0)], schemas.PAGE_LOG)
    return report.Report(dict(RUN), found, pages)


def test_all_formats(spark, made, tmp_path):
    written = report.export(made, tmp_path / "run", ["csv", "xlsx", "jsonl", "md"], tmp_path / "copy")
    names = sorted(p.name for p in written if p.parent.name == "run")
    assert names == ["report.findings.csv", "report.json", "report.jsonl", "report.md", "report.pages.csv", "report.xlsx"]
    assert len(list((tmp_path / "copy").iterdir())) == 6
    doc = json.loads((tmp_path / "run/report.json").read_text("utf-8"))
    assert list(doc) == ["schema_version", "run", "target", "settings", "statistics", "findings", "pages"]
    assert doc["statistics"] == {"pages_fetched": 1, "requests_made": 3, "pages_skipped": 1, "pages_failed": 1, "findings_count": 3}
    assert [f["value"] for f in doc["findings"]] == ["a@e.org", "info@e.org", "=cmd|[x](y) <b>"]
    assert doc["findings"][0]["provenance"][0] == {"source_url": "https://e.org/1", "collected_at": "2024-01-02T03:04:05Z", "extraction_layer": "text_heuristic", "raw_value": "a@e.org"}
    assert [p["url"] for p in doc["pages"]] == ["https://e.org/", "https://e.org/a", "https://e.org/b"]
    raw = (tmp_path / "run/report.findings.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r\n" in raw
    rows = list(csv.DictReader(raw.decode("utf-8-sig").splitlines()))
    assert list(rows[0]) == C.FINDING_COLUMNS and len(rows) == 4
    assert rows[3]["value"] == "'=cmd|[x](y) <b>" and rows[0]["email_kind"] == "other" and rows[0]["purpose_note"] == "'=note"
    lines = [json.loads(x) for x in (tmp_path / "run/report.jsonl").read_text("utf-8").splitlines()]
    assert len(lines) == 4 and lines[3]["value"] == "=cmd|[x](y) <b>" and lines[0]["metadata"] == {"email_kind": "other"}
    text = (tmp_path / "run/report.md").read_text("utf-8")
    assert "=cmd\\|\\[x\\](y) &lt;b&gt;" in text and "### email" in text and "| 1 | http\\_error" not in text
    with zipfile.ZipFile(tmp_path / "run/report.xlsx") as z:
        assert z.testzip() is None and len([n for n in z.namelist() if "worksheets/" in n]) == 4
        sheet = z.read("xl/worksheets/sheet2.xml").decode()
        assert "<v>0.9</v>" in sheet and "&apos;=cmd" not in sheet and "'=cmd|[x](y) &lt;b&gt;" in sheet


def test_exports_hold_a_row_at_a_time(spark, made, tmp_path):
    report.export(made, tmp_path, ["xlsx"])
    assert (tmp_path / "report.json").read_text("utf-8") == json.dumps(report.document(made), ensure_ascii=False, indent=2) + "\n"
    assert [r[C.FINDING_COLUMNS.index("value")][0] for r in report.sheet_rows(tmp_path / "report.xlsx", 2)] == ["value", "a@e.org", "a@e.org", "info@e.org", "'=cmd|[x](y) <b>"]
    none = report.Report(dict(RUN), made.findings.limit(0), made.pages)
    report.export(none, tmp_path / "none", [])
    assert (tmp_path / "none/report.json").read_text("utf-8") == json.dumps(report.document(none), ensure_ascii=False, indent=2) + "\n"

    taken = []
    rows = (taken.append(k) or (f"a\x01{k}", k) for k in range(5000))
    parts = report._sheet(["name", "n"], rows)
    assert "".join([next(parts) for _ in range(4)]).endswith('<row r="3"><c r="A3" t="inlineStr"><is><t xml:space="preserve">a1</t></is></c><c r="B3"><v>1</v></c></row>') and len(taken) == 2

    def peak(n):
        with zipfile.ZipFile(tmp_path / f"{n}.xlsx", "w") as z, z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.writelines(p.encode() for p in report._sheet(["name", "n"], ((f"value {k}", k) for k in range(n))))
        tracemalloc.start()
        assert sum(1 for _ in report.sheet_rows(tmp_path / f"{n}.xlsx", 1)) == n + 1
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(20000) < 2 * peak(2000)


def test_re_export_is_byte_stable(spark, made, tmp_path):
    report.export(made, tmp_path, ["csv"])
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    report.re_export(spark, tmp_path, ["csv"])
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == before
    bad = json.loads((tmp_path / "report.json").read_text("utf-8")) | {"schema_version": "1.0"}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError):
        report.load(spark, tmp_path / "bad.json")


def test_a_failing_format_costs_only_itself(made, tmp_path):
    def fail(*_):
        raise OSError("disk")

    with pytest.raises(report.ExportError) as e:
        report.export(made, tmp_path, ["csv", "md"], writers=report.WRITERS | {"csv": fail})
    assert set(e.value.failed) == {"csv"} and {p.name for p in e.value.written} == {"report.json", "report.md"}
    with pytest.raises(ValueError):
        report.export(made, tmp_path, ["pdf"])


def test_key_values_and_tables(spark, made, tmp_path):
    assert [k for k, _ in report.run_pairs(made)] == C.RUN_KEYS and dict(report.run_pairs(made))["include_subdomains"] == "true"
    compliance = dict(report.compliance_pairs(made))
    assert list(compliance) == C.COMPLIANCE_KEYS and compliance["robots_txt_url"] == "https://e.org/robots.txt" and compliance["pages_skipped_by_robots"] == 1
    report.write_tables(made, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/findings").where("run_id = 'r-00000001'").count() == 3


def entry(i, days, created="2024-01-01T00:00:00Z", **more):
    return {"run_id": f"r{i}", "target_host": f"h{i % 2}.example", "target_url": "u", "purpose_category": "self_audit", "purpose_note": "", "created_at": created, "retention_days": days, "directory": "", "pages_fetched": 1, "findings_count": i, "files": ["report.json"]} | more


def test_ledger(spark, tmp_path):
    assert ledger.scan(spark, tmp_path).count() == 0
    for i, days in enumerate([1, 30, 10]):
        folder = tmp_path / f"r{i}"
        folder.mkdir()
        (folder / "report.json").write_text("x" * (i + 1) * 10)
        ledger.record(tmp_path, entry(i, days, directory=str(folder)))
    with (tmp_path / ledger.FILE).open("a") as f:
        f.write("\n")
    rows = ledger.scan(spark, tmp_path)
    assert [r["run_id"] for r in rows.orderBy("line").collect()] == ["r0", "r1", "r2"]
    assert ledger.find(rows, target_host="h0.example").count() == 2 and ledger.find(rows, run_id="r1").count() == 1
    seen = ledger.summaries(rows, ledger.directory_sizes(spark, tmp_path), "2024-01-11 00:00:00").collect()
    assert [(r["run_id"], r["size_bytes"], r["days_remaining"], r["expired"]) for r in seen] == [("r2", 30, 0, True), ("r1", 20, 20, False), ("r0", 10, -9, True)]
    assert tuple(ledger.delete_confirmation(rows).select("runs", "findings").first()) == (3, 3)
    assert ledger.erase(spark, tmp_path, {"nothing"}) == ([], [])
    removed, ids = ledger.erase_expired(spark, tmp_path, "2024-01-11 00:00:00")
    assert ids == ["r0", "r2"] and not (tmp_path / "r0").exists() and (tmp_path / "r1").exists() and len(removed) == 4
    assert [r["run_id"] for r in ledger.scan(spark, tmp_path).collect()] == ["r1"]
    with (tmp_path / ledger.FILE).open("a") as f:
        f.write("{broken\n")
    with pytest.raises(ValueError, match="line 2"):
        ledger.scan(spark, tmp_path)


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.toml"
    path.write_text('contact_email = "a@e.org"\n[crawl]\nmax_pages = 5000\nrequest_interval_seconds = 2\n[export]\nformats = ["md"]\n')
    monkeypatch.setenv("SITELENS_PROJECT_URL", "https://p.example")
    got = config.load(str(path))
    settings, moved = got.settings()
    assert (got.require_contact(), got.project_url, got.formats, settings.max_pages, settings.request_interval_seconds, moved) == ("a@e.org", "https://p.example", ["md"], 2000, 2.0, [("max_pages", 5000, 2000)])
    config.save(got, str(tmp_path / "new/d.toml"))
    assert config.load(str(tmp_path / "new/d.toml")) == got
    path.write_text("max_pages = true\n")
    with pytest.raises(TypeError):
        config.load(str(path))
    with pytest.raises(ValueError):
        config.Config().require_contact()


def streamed(spark, tmp_path, rows, parts=3):
    for k in range(parts):
        rows.where(F.col("seq") % parts == k).coalesce(1).write.mode("append").parquet(str(tmp_path))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_stream_health_equals_batch(spark, tmp_path):
    statuses = ["ok", "http_error", "rate_limited", "skipped_depth", "parse_error"]
    rows = [(f"r{k}", i, statuses[(i * (k + 3) + k) % (2 + k % 4)], None) for k in range(6) for i in range(40)]
    log = spark.createDataFrame(rows, "run_id string, seq long, status string, retry_after double")
    log.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = {(r["run_id"], r["outcome"], r["seq"]) for r in streams.run_to_files(state.health(stream), str(tmp_path / "out")).collect()}
    want = {(r["run_id"], r["outcome"], r["at"]["seq"]) for r in health.first_abort(log).collect()}
    assert got == want and want


def test_stream_spacing_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"h{i % 3}", i, (i * 37 % 11) + i * 0.2) for i in range(90)], "host string, seq long, arrival double")
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    got = {(r["host"], r["seq"]): r["start"] for r in streams.run_to_files(streams.spacing(stream, 0.5), str(tmp_path / "out")).collect()}
    want = {(r["host"], r["seq"]): r["start"] for r in health.request_starts(rows, 0.5, order=["seq"]).collect()}
    assert got == pytest.approx(want)


def test_stream_findings_and_dedup(spark, tmp_path):
    rows = [("email", f"{i % 4}@e.org", f"https://e.org/{i % 5}", AT, "text_heuristic", {}, i) for i in range(60)]
    accepted = aggregate.accepted(spark.createDataFrame(rows, schemas.CANDIDATE))
    stream = streamed(spark, tmp_path / "f", accepted)
    got = {r["dedup_value"]: (r["occurrence_count"], r["first_seen_url"], r["page_support"]) for r in streams.run_to_files(state.live_findings(stream), str(tmp_path / "live"), "update", ["field", "dedup_value"]).collect()}
    want = {r["dedup_value"]: (r["occurrence_count"], r["first_seen_url"], r["page_support"]) for r in aggregate.findings(accepted).collect()}
    assert got == want
    once = streams.run_to_files(streams.once(streamed(spark, tmp_path / "d", accepted), ["source_url"]), str(tmp_path / "once"))
    assert once.count() == 5


def test_frontier_metrics_and_extensions(spark):
    seen = Observation("frontier")
    streams.observed(spark.createDataFrame([("a", 1), ("b", 3)], "url string, depth int"), seen).count()
    assert seen.get == {"queued": 2, "deepest": 3}
    rows = spark.createDataFrame([("email", "x", "https://e.org/", AT, "text_heuristic", {}, 0), ("email", "yy", "https://e.org/", AT, "text_heuristic", {}, 1)], schemas.CANDIDATE)
    short = lambda c: F.when(F.length(c) == 1, F.struct(c.alias("value"), c.alias("dedup_value"), F.expr("CAST(map() AS map<string,string>)").alias("metadata")))
    got = aggregate.validate(rows, more={"email": short}).orderBy("seq").collect()
    assert [r["validated"] and r["validated"]["value"] for r in got] == ["x", None]


def test_run_directory_and_ledger_line(spark, made, tmp_path):
    written = report.export_run(made, tmp_path, ["md"], now=datetime.datetime(2024, 5, 6, tzinfo=datetime.UTC))
    assert sorted(str(p.relative_to(tmp_path)) for p in written) == ["r-00000001/report.json", "r-00000001/report.md"]
    row = ledger.scan(spark, tmp_path).first()
    assert (row["run_id"], row["target_host"], row["findings_count"], row["files"]) == ("r-00000001", "e.org", 3, ["report.json", "report.md"])
    assert ledger.erase(spark, tmp_path, {"r-00000001"})[1] == ["r-00000001"] and not (tmp_path / "r-00000001").exists()


def test_unattributable_findings_fail(spark, made):
    assert aggregate.audited(made.findings).count() == 3 and {r["value"] for r in aggregate.audited(made.findings).collect()}
    for change, why in ((F.expr("filter(provenance, p -> false)"), "no provenance"), (F.transform("provenance", lambda p: p.withField("source_url", F.lit(" "))), "no source URL"), (F.transform("provenance", lambda p: p.withField("collected_at", F.lit(None).cast("timestamp"))), "no time")):
        with pytest.raises(Exception, match=why):
            aggregate.audited(made.findings.withColumn("provenance", change)).collect()


def test_observer_gets_small_lists(spark, tmp_path):
    rows = spark.range(60).selectExpr("id AS seq")
    got = []
    query = streams.deliver(streamed(spark, tmp_path / "in", rows, 2), got.append, str(tmp_path / "progress"), now=True)
    query.awaitTermination()
    assert sorted(map(len, got)) == [5, 5, 25, 25] and sorted(r["seq"] for x in got for r in x) == list(range(60))


def test_streams_to_files(spark, tmp_path):
    rows = spark.range(40).selectExpr("id AS seq", "id % 4 AS k")
    assert streams.run_to_files(streamed(spark, tmp_path / "a", rows), str(tmp_path / "out-a")).count() == 40
    counted = streams.run_to_files(streamed(spark, tmp_path / "b", rows).groupBy("k").count(), str(tmp_path / "out-b"), "complete")
    assert sorted(map(tuple, counted.collect())) == [(k, 10) for k in range(4)]


# -- state of a stream's own --------------------------------------------------------------------------------------
def feed(spark, folder, schema, *batches):
    """A stream that takes each list of rows as a batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"k={k}"))
    import os
    import time

    for k in range(len(batches)):  # files are taken in the order of their times
        for f in (folder / "in" / f"k={k}").iterdir():
            os.utime(f, (time.time() - 1000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in" / "k=*"))


ACCEPTED = "field string, dedup_value string, value string, source_url string, extraction_layer string"


def test_live_findings_over_batches(spark, tmp_path):
    """A page that comes again counts once for support; state has a row for each page and one for the counters."""
    batches = [[("email", f"{i % 3}@e.org", f"{i % 3}@E.org" if (i + k) % 2 else f"{i % 3}@e.org", f"https://e.org/{(i * (k + 1)) % 7}", "semantic_html" if k == 1 else "text_heuristic") for i in range(40)] for k in range(3)]
    stream = feed(spark, tmp_path, ACCEPTED, *batches)
    got = streams.run_to_files(state.live_findings(stream), str(tmp_path / "out"), "update", ["field", "dedup_value"]).collect()
    rows = [r for b in batches for r in b]
    want = {}
    for d in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == d]
        rank = {x: i for i, x in enumerate(C.LAYERS)}
        best = min((rank[r[4]], r[3], r[2]) for r in own)
        want[d] = (best[2], max(C.LAYERS[r[4]] for r in own), len({r[3] for r in own}), len(own), min(r[3] for r in own))
    assert {r["dedup_value"]: (r["value"], r["extraction_confidence"], r["page_support"], r["occurrence_count"], r["first_seen_url"]) for r in got} == want
    kept = spark.read.format("statestore").option("path", str(tmp_path / "out-progress")).option("stateVarName", "pages").load()
    assert kept.count() == sum(w[2] for w in want.values())


def test_stream_health_over_batches_equals_batch(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = [(f"r{k % 5}", k, r.choice(["ok", "http_error", "rate_limited", "skipped_robots", "transport_error"]), r.choice([None, None, 1.0, 700.0])) for k in range(200)]
    schema = "run_id string, seq long, status string, retry_after double"
    stream = feed(spark, tmp_path, schema, rows[:70], rows[70:71], rows[71:])
    got = {tuple(x) for x in streams.run_to_files(state.health(stream), str(tmp_path / "out")).collect()}
    want = {(x["run_id"], x["outcome"], x["at"]["seq"]) for x in health.first_abort(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and want


def test_an_idle_run_loses_its_state(spark, tmp_path):
    import time

    schema = "run_id string, seq long, status string, retry_after double"
    bad = lambda a, b: [("r", k, "http_error", None) for k in range(a, b)]
    for idle, pause, found in ((0.5, 2.0, 0), (600.0, 0.0, 1)):
        folder = tmp_path / str(idle)
        for rows in (bad(0, 6), bad(6, 12)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            stream = state.health(spark.readStream.schema(schema).parquet(str(folder / "in")), idle)
            # one batch: with timers of the clock a query that takes what is there has no end
            query = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "progress")).trigger(once=True).start()
            try:
                assert query.awaitTermination(120)
            finally:
                query.stop()
            time.sleep(pause)
        assert spark.read.schema(stream.schema).parquet(str(folder / "out")).count() == found, idle


REQUEST = "url string, at timestamp, host_key string, status_code int, body binary, error string"


def robots_rows(spark, tmp_path, *batches, **options):
    """Requests (url, second) and answers (host, status, body, second) in batches; returns what the cache says, by second."""
    at = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    rows = [[(x[0], at(x[1]), None, None, None, None) if len(x) == 2 else (None, at(x[3]), x[0], x[1], x[2], None) for x in b] for b in batches]
    stream = feed(spark, tmp_path, REQUEST, *rows)
    asked = stream.where("url IS NOT NULL").select("url", "at")
    answers = stream.where("url IS NULL").select("host_key", "status_code", "body", "error", F.col("at").alias("fetched_at"))
    made = streams.run_to_files(state.robots_cache(asked, answers, **options), str(tmp_path / "out"))
    seconds = lambda r: round((r["at"].replace(tzinfo=datetime.UTC) - at(0)).total_seconds())
    return sorted((seconds(r), r["kind"], r["url"], r["status_code"], r["error"]) for r in made.collect())


A, B, C_ = "https://a.org", "https://b.org", "https://c.org"


def test_robots_cache_waits_refreshes_and_refuses(spark, tmp_path):
    got = robots_rows(
        spark, tmp_path,
        [(A, 200, b"", 0), (f"{A}/1", 5), (f"{B}/1", 6), (f"{B}/2", 7)],  # b.org must be asked for
        [(B, 404, None, 8), (f"{C_}/1", 9)],  # and is; c.org never is
        [(f"{A}/2", 3605), (f"{B}/3", 3606)],  # a.org's answer has lapsed, b.org's has not; c.org is refused
        [(A, 403, None, 3610), (f"{A}/3", 3611)],
        [(f"{B}/4", 9000)],
        ttl_hours=1.0, wait=30.0,
    )
    assert got == sorted([
        (5, "decide", f"{A}/1", 200, None), (6, "refresh", f"{B}/robots.txt", None, None), (8, "decide", f"{B}/1", 404, None), (8, "decide", f"{B}/2", 404, None),
        (9, "refresh", f"{C_}/robots.txt", None, None), (39, "decide", f"{C_}/1", None, "transport"), (3605, "refresh", f"{A}/robots.txt", None, None), (3606, "decide", f"{B}/3", 404, None),
        (3610, "decide", f"{A}/2", 403, None), (3611, "decide", f"{A}/3", 403, None), (9000, "refresh", f"{B}/robots.txt", None, None),
    ])
    left = spark.read.format("statestore").option("path", str(tmp_path / "out-progress")).option("stateVarName", "answer").load()
    assert left.count() == 0, "answers are dropped when they lapse"


def test_robots_stream_decides_as_the_batch_does(spark, tmp_path):
    from sitelens.operators import robots

    body = b"User-agent: *\nDisallow: /private\n"
    at = datetime.datetime(2024, 1, 1)
    rows = [(None, at, f"https://h{k}.org", s, b, e) for k, (s, b, e) in enumerate([(200, body, None), (404, None, None), (503, None, None), (200, b"\xff", None), (None, None, "transport")])]
    rows += [(f"https://h{k}.org/{p}", at + datetime.timedelta(seconds=1 + k), None, None, None, None) for k in range(5) for p in ("private/x", "open")]
    stream = feed(spark, tmp_path, REQUEST, rows)
    answers = lambda df: df.where("url IS NULL").select("host_key", "status_code", "body", "error", F.col("at").alias("fetched_at"))
    made = streams.run_to_files(state.robots_decisions(stream.where("url IS NOT NULL").select("url", "at"), answers(stream)), str(tmp_path / "out"))
    frame = spark.createDataFrame(rows, REQUEST)
    want = robots.decide(frame.where("url IS NOT NULL").select("url"), answers(frame))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and made.count() == 10
