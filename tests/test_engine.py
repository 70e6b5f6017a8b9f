"""A whole run over a stored mini-site, from responses to exports; display projections."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from sitelens import engine, schemas, views
from sitelens.operators import health
from sitelens.operators.settings import Purpose, Settings, Target
from sitelens.sinks import report

AT = datetime.datetime(2024, 1, 1)
BASE = "https://mini.example"
HTML = "text/html; charset=utf-8"
ROUTES = [
    (BASE + "/", b'<meta name="generator" content="Gen"><a href="/contact?utm_source=x">c</a><a href="/team">t</a><a href="/private/x">p</a><a href="https://github.com/mini">g</a><a href="/doc.pdf">d</a><a href="/data">j</a>', 200, HTML),
    (BASE + "/contact", b'<p>info@mini.example</p><a href="mailto:Info@mini.example">mail</a>', 200, HTML),
    (BASE + "/team", "<div class='h-card'><span class='p-name'>Zoé Martin</span></div> info@mini.example".encode(), 200, HTML),
    (BASE + "/private/x", b"<p>secret@mini.example</p>", 200, HTML),
    (BASE + "/data", b'{"json": true}', 200, HTML),
    (BASE + "/map.xml", b"<urlset><loc>https://mini.example/hidden</loc><loc>https://else.example/</loc></urlset>", 200, "application/xml"),
    (BASE + "/hidden", b"<p>hidden@mini.example</p>", 200, HTML),
    (BASE + "/.well-known/security.txt", b"Contact: mailto:sec@mini.example\n", 200, "text/plain"),
]


@pytest.fixture(scope="module")
def made(spark):
    routes = spark.createDataFrame([(u, b, s, t, None, {"Server": "nginx"}) for u, b, s, t in ROUTES], schemas.ROUTE).withColumn("fetched_at", F.lit(AT))
    policy = spark.createDataFrame([(BASE, 200, b"User-agent: *\nDisallow: /private\nSitemap: https://mini.example/map.xml\n", None, AT)], schemas.ROBOTS)
    return engine.report(routes, policy, Target("mini.example"), Settings(), Purpose("self_audit"), "me@e.org", now=AT.replace(tzinfo=datetime.UTC), run_id="r-1")


def test_run(made):
    log = {r["url"].removeprefix(BASE): (r["depth"], r["status"], r["findings_count"]) for r in made.pages.collect()}
    assert log == {"/": (0, "ok", 3), "/contact": (1, "ok", 3), "/team": (1, "ok", 3), "/private/x": (1, "skipped_robots", 0), "https://github.com/mini": (1, "skipped_off_scope", 0), "/doc.pdf": (1, "skipped_extension", 0), "/data": (1, "parse_error", 0),
                   "/.well-known/security.txt": (0, "ok", 1), "/map.xml": (0, "no_findings", 0), "/hidden": (1, "ok", 2), "https://else.example/": (1, "skipped_off_scope", 0)}
    got = {(r["field"], r["value"]): (r["extraction_confidence"], r["page_support"], r["occurrence_count"]) for r in made.findings.collect()}
    assert got["email", "info@mini.example"] == (0.75, 2, 3) and got["email", "sec@mini.example"] == (0.95, 1, 1)
    assert got["person_name", "Zoé Martin"] == (0.75, 1, 1) and ("social_profile", "https://github.com/mini") in got and ("technology", "Gen") in got
    assert ("email", "secret@mini.example") not in got
    assert made.run["outcome"] == "completed" and made.counted()["pages_skipped_by_robots"] == 1


def test_no_page_text_leaves(made, tmp_path):
    report.export(made, tmp_path, ["csv", "jsonl", "md", "xlsx"])
    doc = json.loads((tmp_path / "report.json").read_text("utf-8"))
    assert doc["run"]["tool"]["user_agent"].startswith("sitelens/") and doc["statistics"]["findings_count"] == len(doc["findings"])
    assert all(len(p["raw_value"]) <= 200 for f in doc["findings"] for p in f["provenance"])
    assert not any(b"<p>" in p.read_bytes() or b"secret@" in p.read_bytes() for p in tmp_path.iterdir())


def test_refusals(spark):
    routes = spark.createDataFrame([(BASE + "/", b"<p>x", 500, HTML, None, {})], schemas.ROUTE)
    with pytest.raises(ValueError, match="does not start"):
        engine.report(routes, None, Target("mini.example"), Settings(), Purpose("self_audit"), "me@e.org")


def test_corpus(spark):
    rows = [(f"https://s{i % 3}.example/{i}", 200, "text/html", f"<p>info@s{i % 2}.example</p>", AT, {}) for i in range(12)]
    got = {(r["site"], r["value"]): r["page_support"] for r in engine.corpus_findings(spark.createDataFrame(rows, schemas.FETCHED_PAGE)).collect()}
    assert got == {(f"s{i}.example", f"info@s{j}.example"): 2 for i in range(3) for j in range(2)}


def test_views(spark, made):
    rows = {r["value"]: r for r in views.finding_rows(made.findings).collect()}
    assert rows["info@mini.example"]["extraction"] == "semantic_html" and "Seen on 2 page(s), 3 observation(s)" in rows["info@mini.example"]["tooltip"] and "email_kind: role" in rows["info@mini.example"]["tooltip"]
    pages = views.page_rows(health.numbered(made.pages, order=["depth", "url"])).orderBy("number").collect()
    assert pages[0]["url"] == BASE + "/" and {p["severity"] for p in pages} == {"info", "warning", "error"}
    assert views.summary(made.pages, "r-1", 7, 5).first()[0] == "Run r-1 · 7 findings · 6 pages fetched, 4 skipped, 1 failed · 5 requests"
    one = spark.range(1)
    line = lambda s, n: one.select(views.status_line(F.lit(s), F.lit(3), F.lit(9), F.lit(n))).first()[0]
    assert [line("idle", 0), line("running", 0), line("done", 1), line("done", 2)] == ["Idle", "Crawling: 3/9 pages", "Completed: 1 finding", "Completed: 2 findings"]
    assert one.select(views.progress_text(F.lit(3), F.lit(12), F.lit(61.0))).first()[0] == "3/12 pages, 25%, 01:01"
    names = [r["url"] for r in views.sorted_by(spark.createDataFrame([("b",), ("A",), ("c",)], "url string"), "url").collect()]
    assert names == ["A", "b", "c"]
    assert "scope: e.org +subdomains" in views.compliance_line("x/1", 0.1, "e.org", True)


def test_redirects_robots_on_hops_and_extension_points(spark):
    """A chain ends at its page, a hop to a forbidden URL or out of scope stops; own extractors and validators take part."""
    moved = lambda at, to: (BASE + at, b"", 301, HTML, to, {})
    rows = [
        (BASE + "/", b"<a href='/a'>a</a><a href='/p'>p</a><a href='/out'>o</a><a href='/loop'>l</a><a href='/end'>e</a>", 200, HTML, None, {}),
        moved("/a", "/b"), moved("/b", "/end"), moved("/p", "/private/x"), moved("/out", "https://else.example/"), moved("/loop", "/loop"),
        (BASE + "/end", b"<p>info@mini.example</p><a href='/next'>n</a>", 200, HTML, None, {}), (BASE + "/next", b"<p>next@mini.example</p>", 200, HTML, None, {}),
    ]
    routes = spark.createDataFrame(rows, schemas.ROUTE).withColumn("fetched_at", F.lit(AT))
    policy = spark.createDataFrame([(BASE, 200, b"User-agent: *\nDisallow: /private\n", None, AT), (BASE, 500, None, None, AT - datetime.timedelta(hours=2))], schemas.ROBOTS)

    def pages_seen(parsed):
        empty = F.expr("CAST(map() AS map<string,string>)")
        return parsed.select(F.lit("organization_name").alias("field"), F.lit("Seen Ltd").alias("raw_value"), F.col("url").alias("source_url"), F.col("fetched_at").alias("collected_at"), F.lit("structured_data").alias("extraction_layer"), empty.alias("metadata"), F.lit(7).alias("seq"))

    made = engine.report(routes, policy, Target("mini.example"), Settings(), Purpose("self_audit"), "me@e.org", now=AT.replace(tzinfo=datetime.UTC), extractors=[pages_seen])
    log = {r["url"].removeprefix(BASE): r["status"] for r in made.pages.collect()}
    assert {k: log[k] for k in ("/a", "/p", "/out", "/loop")} == {"/a": "ok", "/p": "skipped_robots", "/out": "off_scope_redirect", "/loop": "too_many_redirects"} or log["/a"] == "no_findings"
    found = {r["value"]: (r["page_support"], r["first_seen_url"]) for r in made.findings.collect()}
    assert found["info@mini.example"] == (1, BASE + "/end") and found["next@mini.example"] == (1, BASE + "/next")
    assert found["Seen Ltd"][0] == 3


def test_background_work_is_drained():
    done, failed = [], []
    with engine.Background(2) as background:
        for i in range(5):
            background.run(lambda i=i: 10 // (i - 2), done.append, failed.append)
    assert sorted(done) == [-10, -5, 5, 10] and [type(e) for e in failed] == [ZeroDivisionError]


def test_statuses(spark, made):
    assert [r[0] for r in views.statuses_seen(made.pages).collect()] == ["no_findings", "ok", "parse_error", "skipped_extension", "skipped_off_scope", "skipped_robots"]
    assert views.of_status(made.pages, "parse_error").count() == 1 and views.of_status(made.pages, None).count() == made.pages.count()
