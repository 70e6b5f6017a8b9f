"""Queries that run whole life cycles: exports read back, the ledger, runs over stored sites, streams and configuration."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens import engine, schemas, views
from sitelens.functions import text as T
from sitelens.operators import aggregate, crawl, extract
from sitelens.operators.settings import Purpose, Settings, Target
from sitelens.plans.registry import query
from sitelens.plans.rendered import SUPPLIERS, _flat, _html, as_pages, suppliers
from sitelens.sinks import ledger, report
from sitelens.sources import config, discovery
from sitelens.storage import shared_dir, stored, table
from sitelens.streaming import state, streams

AT = datetime(2024, 1, 1, tzinfo=UTC)
RUN = {
    "run_id": "r-00000001", "started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:01:00Z", "outcome": "completed", "outcome_detail": None, "purpose_category": "self_audit", "purpose_note": "=note",
    "retention_days": 30, "tool_name": "sitelens", "tool_version": "1", "user_agent": "sitelens/1", "target_entered": "e.org", "target_url": "https://e.org/", "scope_host": "e.org", "include_subdomains": True, "max_pages": 200,
    "max_depth": 3, "request_interval_seconds": 1.0, "concurrent_requests": 2, "follow_sitemap": True, "phone_region": "FR", "requests_made": 3,
}


def _folder(spark: SparkSession) -> Path:
    """A new folder below the shared one, which single-file sinks write on the driver."""
    return Path("/" + re.sub("^file:/*", "", shared_dir(spark)).lstrip("/"))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return stored(spark.createDataFrame(rows, schema), "rows")


# -- exports ------------------------------------------------------------------------------------------------------
FOUND = _flat("SELECT 'organization_name' AS field, s_name AS value, 0.9 AS confidence, 1 AS n, host FROM suppliers UNION ALL SELECT 'email', 'contact@' || host, 0.5, 1, host FROM suppliers")
PAGES = f"WITH {SUPPLIERS} SELECT 'https://' || host || '/' AS url, (s_suppkey % 4)::INT AS depth, CASE s_suppkey % 3 WHEN 0 THEN 'http_error' WHEN 1 THEN 'ok' ELSE 'skipped_robots' END AS status, (s_suppkey % 3 * 2)::INT AS findings_count FROM suppliers"


def _report(spark: SparkSession, sf_dir: str) -> report.Report:
    """Findings and page log of a page for each supplier, as one run's."""
    rows = suppliers(spark, sf_dir)
    body = _html('<script type="application/ld+json">{"@type":"Organization","name":"', F.col("s_name"), '"}</script><p>contact@', F.col("host"), "</p>")
    found = stored(aggregate.findings(aggregate.accepted(extract.candidates(as_pages(rows, body)))), "findings")
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    status = F.when(k % 3 == 0, "http_error").when(k % 3 == 1, "ok").otherwise("skipped_robots")
    log = rows.select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), (k % 4).cast("int").alias("depth"), status.alias("status"), none.alias("detail"), F.lit(200).alias("http_status"), none.alias("content_type"), (k % 3 * 2).cast("int").alias("findings_count"))
    return report.Report(dict(RUN), found, stored(log, "log"))


@query(FOUND)
def report_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical document, written and read back."""
    folder = _folder(spark)
    report.export(_report(spark, sf_dir), folder, [])
    return report.load(spark, folder / "report.json").findings.select("field", "value", "extraction_confidence", "page_support", "occurrence_count", "first_seen_url")


@query(f"""WITH f AS ({FOUND}) SELECT 'r-00000001' AS run_id, '''=note' AS purpose_note, 'e.org' AS scope_host, field, value, CASE field WHEN 'email' THEN 'role' ELSE '' END AS email_kind, extraction_confidence,
  first_seen_url AS source_url, CASE field WHEN 'email' THEN 'text_heuristic' ELSE 'structured_data' END AS extraction_layer, '2024-01-01T00:00:00Z' AS collected_at FROM f""")
def report_csv_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings sheet read back as CSV: guarded cells, kinds, provenance and times."""
    folder = _folder(spark)
    report.export(_report(spark, sf_dir), folder, ["csv"])
    rows = spark.read.option("header", True).option("nullValue", "\0").option("emptyValue", "").csv(str(folder / "report.findings.csv"))
    first = rows.columns[0]
    rows = rows.withColumnRenamed(first, first.lstrip("﻿"))
    return rows.select("run_id", "purpose_note", "scope_host", "field", "value", F.coalesce("email_kind", F.lit("")).alias("email_kind"), F.col("extraction_confidence").cast("double").alias("extraction_confidence"), "source_url", "extraction_layer", "collected_at")


@query(f"SELECT url, depth, status, findings_count, row_number() OVER (ORDER BY depth, url) AS place FROM ({PAGES})")
def report_csv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page log sheet read back, with the place of each line in the file."""
    folder = _folder(spark)
    report.export(_report(spark, sf_dir), folder, ["csv"])
    lines = spark.read.text(str(folder / "report.pages.csv"), wholetext=True).select(F.posexplode(F.split("value", "\r\n")).alias("place", "line")).where("place > 0 AND line <> ''")
    cells = F.split("line", ",")
    of = lambda name: cells[C.PAGE_COLUMNS.index(name)]
    return lines.select(of("url").alias("url"), of("depth").cast("int").alias("depth"), of("status").alias("status"), of("findings_count").cast("int").alias("findings_count"), F.col("place").cast("long").alias("place"))


@query(f"WITH f AS ({FOUND}) SELECT field, value, first_seen_url AS source_url, CASE field WHEN 'email' THEN 'role' ELSE '' END AS email_kind FROM f")
def report_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines read back; metadata are an object."""
    folder = _folder(spark)
    report.export(_report(spark, sf_dir), folder, ["jsonl"])
    rows = spark.read.schema("field string, value string, source_url string, metadata map<string,string>").json(str(folder / "report.jsonl"))
    return rows.select("field", "value", "source_url", T.metadata_get(F.col("metadata"), "email_kind").alias("email_kind"))


@query(f"""WITH f AS ({FOUND}) SELECT '| ' || value || ' | ' || CASE field WHEN 'email' THEN 'text_heuristic (0.5)' ELSE 'structured_data (0.9)' END || ' | 1 | ' || first_seen_url || ' |' AS line FROM f
UNION ALL SELECT '| ' || depth || ' | ' || status || ' | ' || url || ' |  |' FROM ({PAGES})""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table lines of the Markdown document: a finding each, a page each."""
    folder = _folder(spark)
    report.export(_report(spark, sf_dir), folder, ["md"])
    return spark.read.text(str(folder / "report.md")).select(F.col("value").alias("line")).where("line LIKE '| % |%https://%' AND line NOT LIKE '| Target%'")


@query(f"WITH f AS ({FOUND}) SELECT field, value, extraction_confidence, first_seen_url FROM f")
def report_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings sheet of the workbook, read back; numbers are numbers."""
    folder = _folder(spark)
    report.export(_report(spark, sf_dir), folder, ["xlsx"])
    rows = report.sheet_rows(folder / "report.xlsx", 2)
    assert [x for x, _ in next(rows)] == C.FINDING_COLUMNS
    at = {n: i for i, n in enumerate(C.FINDING_COLUMNS)}
    with (folder / "sheet.jsonl").open("w", encoding="utf-8") as f:
        for r in rows:
            assert r[at["extraction_confidence"]][1] is None
            f.write(json.dumps({"field": r[at["field"]][0], "value": r[at["value"]][0], "extraction_confidence": float(r[at["extraction_confidence"]][0]), "first_seen_url": r[at["first_seen_url"]][0]}) + "\n")
    return spark.read.schema("field string, value string, extraction_confidence double, first_seen_url string").json(str(folder / "sheet.jsonl"))


@query("""SELECT * FROM (VALUES ('json', 'report.json', 2), ('md', 'report.md', 2), ('csv', 'report.findings.csv', 2), ('csv', 'report.pages.csv', 2), ('again', 'report.jsonl', 1)) AS t(format, name, places)""".replace(", 2)", ", 2::BIGINT)").replace(", 1)", ", 1::BIGINT)"))
def export_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run in some formats, copied elsewhere, and one format anew from the stored document; JSON is always written."""
    folder = _folder(spark)
    report.export_run(_report(spark, sf_dir), folder, ["md", "csv", "md"], folder / "copy", AT)
    run = folder / RUN["run_id"]
    report.re_export(spark, run, ["jsonl"])
    kinds = {"report.json": "json", "report.md": "md", "report.jsonl": "again"}
    found = [(kinds.get(p.name, "csv"), p.name, 1 + (folder / "copy" / p.name).exists()) for p in run.iterdir()]
    return _rows(spark, found, "format string, name string, places long")


@query(f"WITH f AS ({FOUND}) SELECT 'r-00000001' AS run_id, field, value, page_support FROM f")
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as Parquet, partitioned by run."""
    folder = _folder(spark)
    report.write_tables(_report(spark, sf_dir), str(folder))
    return spark.read.parquet(f"{folder}/findings").select("run_id", "field", "value", "page_support")


@query(f"""WITH p AS ({PAGES}), f AS ({FOUND}) SELECT 'run' AS part, k AS key, CASE k WHEN 'pages_fetched' THEN (SELECT count(*) FROM p WHERE status = 'ok') WHEN 'pages_skipped' THEN (SELECT count(*) FROM p WHERE status = 'skipped_robots')
  WHEN 'pages_failed' THEN (SELECT count(*) FROM p WHERE status = 'http_error') ELSE (SELECT count(*) FROM f) END::VARCHAR AS value FROM (SELECT unnest(['pages_fetched', 'pages_skipped', 'pages_failed', 'findings_count']) AS k)
UNION ALL SELECT 'compliance', k, CASE k WHEN 'robots_txt_honored' THEN 'true' WHEN 'robots_txt_url' THEN 'https://e.org/robots.txt' WHEN 'effective_interval_seconds' THEN '1.0' WHEN 'hard_floor_seconds' THEN '{C.INTERVAL_FLOOR}'
  WHEN 'user_agent' THEN 'sitelens/1' WHEN 'concurrent_requests' THEN '2' WHEN 'pages_skipped_by_robots' THEN (SELECT count(*) FROM p WHERE status = 'skipped_robots')::VARCHAR WHEN 'retention_days' THEN '30' WHEN 'purpose_category' THEN 'self_audit' ELSE '=note' END
FROM (SELECT unnest({C.COMPLIANCE_KEYS}) AS k)
UNION ALL SELECT 'summary', '', 'Run r-00000001 · ' || (SELECT count(*) FROM f) || ' findings · ' || (SELECT count(*) FROM p WHERE status = 'ok') || ' pages fetched, ' || (SELECT count(*) FROM p WHERE status = 'skipped_robots') || ' skipped, ' || (SELECT count(*) FROM p WHERE status = 'http_error') || ' failed · 3 requests'""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run, its compliance statement and its summary line."""
    made = _report(spark, sf_dir)
    counted = {"pages_fetched", "pages_skipped", "pages_failed", "findings_count"}
    rows = [("run", k, str(v)) for k, v in report.run_pairs(made) if k in counted]
    rows += [("compliance", k, str(v)) for k, v in report.compliance_pairs(made)]
    rows.append(("summary", "", views.summary(made.pages, "r-00000001", made.findings.count(), 3).first()[0]))
    return _rows(spark, rows, "part string, key string, value string")


@query(f"""WITH f AS ({FOUND}) SELECT field, value, CASE field WHEN 'email' THEN 'text_heuristic' ELSE 'structured_data' END AS extraction, CASE field WHEN 'email' THEN 'Email' ELSE 'Organization name' END || ': ' || value || chr(10) || 'Extraction: '
  || CASE field WHEN 'email' THEN 'Text heuristic (text_heuristic, confidence 0.50)' ELSE 'Structured data (structured_data, confidence 0.90)' END || chr(10) || 'Seen on 1 page(s), 1 observation(s)' || chr(10) || 'First seen: ' || first_seen_url
  || CASE field WHEN 'email' THEN chr(10) || 'email_kind: role' ELSE '' END AS tooltip FROM f""")
def finding_display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and tooltips of findings."""
    return views.finding_rows(_report(spark, sf_dir).findings).select("field", "value", "extraction", "tooltip")


# -- the ledger ---------------------------------------------------------------------------------------------------
def _ledger(spark: SparkSession, sf_dir: str) -> Path:
    """A ledger with a run for each nation; each run's folder holds one file."""
    folder = _folder(spark)
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        own = folder / f"run-{r['n_nationkey']}"
        own.mkdir(parents=True)
        (own / "report.json").write_bytes(b"x" * (100 + 60 * r["n_nationkey"]))
        entry = {"run_id": f"run-{r['n_nationkey']}", "target_host": f"h{r['n_regionkey']}.example", "created_at": AT, "retention_days": 1 + r["n_nationkey"], "directory": str(own), "pages_fetched": r["n_nationkey"], "findings_count": r["n_regionkey"], "files": ["report.json"]}
        ledger.record(folder, entry)
    return folder


_NATIONS = "SELECT 'run-' || n_nationkey AS run_id, n_nationkey AS k, 'h' || n_regionkey || '.example' AS target_host, n_regionkey AS region FROM nation"


@query(f"SELECT target_host, count(*) AS runs, sum(k)::BIGINT AS pages FROM ({_NATIONS}) WHERE region <> 2 GROUP BY target_host")
def ledger_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger on disk after some runs were forgotten."""
    folder = _ledger(spark, sf_dir)
    ledger.forget(spark, folder, {r["run_id"] for r in ledger.find(ledger.scan(spark, folder), target_host="h2.example").collect()})
    return ledger.scan(spark, folder).groupBy("target_host").agg(F.count("*").alias("runs"), F.sum("pages_fetched").alias("pages"))


@query(f"""SELECT run_id, (100 + 60 * k)::BIGINT AS size_bytes, CASE WHEN 100 + 60 * k >= 1024 THEN printf('%.1f KiB', (100 + 60 * k) / 1024.0) ELSE (100 + 60 * k) || ' B' END AS size, (k - 10)::BIGINT AS days_remaining, k - 10 <= 0 AS expired,
  CASE WHEN k - 10 <= 0 THEN 'expired' WHEN k - 10 = 1 THEN '1 day left' ELSE (k - 10) || ' days left' END AS retention FROM ({_NATIONS})""")
def ledger_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the size of their folders and what is left of their retention."""
    folder = _ledger(spark, sf_dir)
    rows = ledger.summaries(ledger.scan(spark, folder), ledger.directory_sizes(spark, folder), "2024-01-12 00:00:00")
    shown = views.run_rows(rows).select("run_id", "size", "retention")
    return rows.select("run_id", "size_bytes", "days_remaining", "expired").join(shown, "run_id")


@query(f"SELECT run_id, k - 10 <= 0 AS erased, k - 10 > 0 AS in_ledger, k - 10 > 0 AS has_folder FROM ({_NATIONS})")
def ledger_erase_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired runs leave with their folders and their ledger lines."""
    folder = _ledger(spark, sf_dir)
    names = [r["run_id"] for r in ledger.scan(spark, folder).collect()]
    gone = set(ledger.erase_expired(spark, folder, "2024-01-12 00:00:00")[1])
    left = {r["run_id"] for r in ledger.scan(spark, folder).collect()}
    return _rows(spark, [(n, n in gone, n in left, (folder / n).exists()) for n in names], "run_id string, erased boolean, in_ledger boolean, has_folder boolean")


@query(f"SELECT count(*) AS runs, sum(region)::BIGINT AS findings, list(run_id ORDER BY run_id)::VARCHAR AS names FROM ({_NATIONS}) WHERE target_host = 'h1.example'".replace("list(run_id ORDER BY run_id)::VARCHAR", "string_agg(run_id, ' ' ORDER BY run_id)"))
def delete_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What deleting the runs of one host would take with it."""
    folder = _ledger(spark, sf_dir)
    row = ledger.delete_confirmation(ledger.find(ledger.scan(spark, folder), target_host="h1.example"))
    names = F.array_sort(F.transform("directories", lambda d: F.regexp_extract(d, "([^/]*)$", 1)))
    return row.select("runs", "findings", F.array_join(names, " ").alias("names"))


# -- runs over a stored site --------------------------------------------------------------------------------------
BASE = "https://mini.example"
#: A page for each nation below the seed, and a chain of pages below the first.
_SITE = """site AS (SELECT '/n' || n_nationkey AS path, 1 AS depth, n_regionkey AS region, n_nationkey AS k FROM nation)"""


def _site(spark: SparkSession, sf_dir: str, limits: Settings | None = None, **more) -> report.Report:
    nations = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()]
    html = "text/html; charset=utf-8"
    at = lambda k, region: f"/private/n{k}" if region == 2 else f"/n{k}"
    body = {"/": "".join(f"<a href='{at(k, r)}'>n</a>" for k, r in nations) + "<a href='/moved'>m</a><a href='/x.pdf'>p</a><a href='https://else.example/'>e</a><a href='https://u:p@mini.example/secret'>c</a>", "/far1": "<a href='/far2'>f</a>", "/far2": "<a href='/far3'>f</a>", "/far3": "<a href='/far4'>f</a>"}
    body |= {at(k, r): f"<p>mail{k}@mini.example</p>" + ("<a href='/far1'>f</a>" if k == 0 else "") for k, r in nations}
    rows = [(BASE + p, b.encode(), 500 if p == "/n7" else 200, html, None, {}) for p, b in body.items()] + [(BASE + "/moved", b"", 301, html, "/n1", {})]
    routes = spark.createDataFrame(rows, schemas.ROUTE).withColumn("fetched_at", F.expr("TIMESTAMP '2024-01-01 00:00:00'"))
    policy = spark.createDataFrame([(BASE, 200, b"User-agent: *\nDisallow: /private\n", None, datetime(2024, 1, 1))], schemas.ROBOTS)
    return engine.report(routes, policy, Target("mini.example"), limits or Settings(follow_sitemap=False), Purpose("self_audit"), "me@example.org", now=AT, run_id="r-1", **more)


_STATUS = "CASE WHEN n_regionkey = 2 THEN 'skipped_robots' WHEN n_nationkey = 7 THEN 'http_error' ELSE 'ok' END"


@query(f"""SELECT CASE WHEN n_regionkey = 2 THEN '/private' ELSE '' END || '/n' || n_nationkey AS path, 1 AS depth, {_STATUS} AS status, CASE WHEN {_STATUS} = 'ok' THEN 1 ELSE 0 END AS findings_count FROM nation
UNION ALL SELECT * FROM (VALUES ('/', 0, 'no_findings', 0), ('/moved', 1, 'ok', 0), ('/x.pdf', 1, 'skipped_extension', 0), ('https://else.example/', 1, 'skipped_off_scope', 0), ('/far1', 2, 'no_findings', 0), ('/far2', 3, 'no_findings', 0), ('/far3', 4, 'skipped_depth', 0),
  ('/.well-known/security.txt', 0, 'http_error', 0), ('credentials', 1, 'credentials_in_url', 0))""")
def site_run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a stored site: robots, redirects, errors, what is skipped and why, findings of each page."""
    rows = _site(spark, sf_dir).pages
    path = F.when(F.col("status") == "credentials_in_url", F.lit("credentials")).otherwise(F.regexp_replace("url", f"^{BASE}", ""))
    # a redirect has the status of the page that it ends at; findings are that page's own
    return rows.select(path.alias("path"), "depth", F.when(F.col("url") == f"{BASE}/moved", F.lit("ok")).otherwise(F.col("status")).alias("status"), "findings_count")


@query(f"SELECT 'email' AS field, 'mail' || n_nationkey || '@mini.example' AS value, 1::INT AS page_support, '{BASE}/n' || n_nationkey AS first_seen_url FROM nation WHERE {_STATUS} = 'ok' UNION ALL SELECT 'organization_name', 'Site ' || n_nationkey, 1::INT, '{BASE}/n' || n_nationkey FROM nation WHERE {_STATUS} = 'ok'")
def site_run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the run, among them those of an extractor and a validator that the caller brings."""

    def named(parsed: DataFrame) -> DataFrame:
        number = F.regexp_extract("url", "/n([0-9]+)$", 1)
        rows = parsed.where(number != "").select(F.lit("organization_name").alias("field"), number.alias("raw_value"), F.col("url").alias("source_url"), F.col("fetched_at").alias("collected_at"))
        return rows.withColumns({"extraction_layer": F.lit("structured_data"), "metadata": F.expr("CAST(map() AS map<string,string>)"), "seq": F.lit(9)})

    def site(raw):
        return F.struct(F.concat(F.lit("Site "), raw).alias("value"), F.concat(F.lit("site "), raw).alias("dedup_value"), F.expr("CAST(map() AS map<string,string>)").alias("metadata"))

    return _site(spark, sf_dir, extractors=[named], validators={"organization_name": site}).findings.select("field", "value", "page_support", "first_seen_url")


_OK = f"(SELECT count(*) FROM nation WHERE {_STATUS} = 'ok')"


@query(f"SELECT 'completed' AS outcome, 'depth_exhausted' AS with_depth, 'budget_exhausted' AS with_budget, 10::BIGINT AS budget_used, true AS stopped, {_OK} + 4 AS fetched".replace("'completed' AS outcome, 'depth_exhausted' AS with_depth", "'depth_exhausted' AS outcome, 'completed' AS with_depth"))
def site_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How runs over the site end under several bounds, and when they are cancelled."""
    usual = _site(spark, sf_dir)
    deep = _site(spark, sf_dir, Settings(follow_sitemap=False, max_depth=6))
    small = _site(spark, sf_dir, Settings(follow_sitemap=False, max_pages=10))
    links = spark.createDataFrame([], "src string, at int, raw string, dst string, reason string, detail string")
    cancelled = crawl.exact(links, spark.createDataFrame([], "url string, status string"), Target("mini.example"), Settings(), cancelled=lambda: True)
    row = (usual.run["outcome"], deep.run["outcome"], small.run["outcome"], small.run["requests_made"], cancelled.outcome == "stopped_by_operator", usual.counted()["pages_fetched"])
    return _rows(spark, [row], "outcome string, with_depth string, with_budget string, budget_used long, stopped boolean, fetched long")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {str(s in C.REFUSED_SEED).lower()})" for s in C.SKIPPED + C.FAILED + C.FETCHED) + ") AS t(status, refused)")
def seed_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With which status of its first page a run does not start."""
    links = spark.createDataFrame([], "src string, at int, raw string, dst string, reason string, detail string")
    rows = []
    for status in C.SKIPPED + C.FAILED + C.FETCHED:
        try:
            crawl.exact(links, spark.createDataFrame([(BASE + "/", status)], "url string, status string"), Target("mini.example"), Settings())
            rows.append((status, False))
        except ValueError:
            rows.append((status, True))
    return _rows(spark, rows, "status string, refused boolean")


# -- settings and configuration -----------------------------------------------------------------------------------
def _refused(make) -> bool:
    try:
        make()
    except (ValueError, TypeError):
        return True
    return False


@query("SELECT 'purpose ' || p AS what, p NOT IN ('other') AS accepted FROM (SELECT unnest(" + str(C.PURPOSES) + """) AS p) UNION ALL SELECT * FROM (VALUES ('purpose other with a note', true), ('purpose fun', false), ('contact a@e.org', true), ('contact nobody', false), ('region FR', true), ('region fr', false)) """
       + "UNION ALL SELECT 'setting ' || n || ' ' || kind, kind NOT IN ('below', 'above') FROM (SELECT unnest(" + str(list(C.BOUNDS)) + ") AS n), (SELECT unnest(['low', 'high', 'below', 'above']) AS kind)")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run refuses before it starts: purposes, contacts, regions, settings beyond their bounds."""
    rows = [(f"purpose {p}", not _refused(lambda p=p: Purpose(p))) for p in [*C.PURPOSES, "fun"]]
    rows.append(("purpose other with a note", not _refused(lambda: Purpose("other", "x" * C.MIN_PURPOSE_NOTE))))
    rows += [(f"contact {c}", not _refused(lambda c=c: config.Config(contact_email=c).require_contact())) for c in ("a@e.org", "nobody")]
    rows += [(f"region {r}", not _refused(lambda r=r: Settings(phone_region=r))) for r in ("FR", "fr")]
    for name, (_, low, high) in C.BOUNDS.items():
        for kind, value in (("low", low), ("high", high), ("below", low - 1), ("above", high + 1)):
            rows.append((f"setting {name} {kind}", not _refused(lambda name=name, value=value: Settings(**{name: value}))))
    return _rows(spark, rows, "what string, accepted boolean")


@query(f"SELECT r_regionkey::INT AS region, lower(r_name) || '@example.org' AS contact, least(1000 * (r_regionkey + 1), {C.BOUNDS['max_pages'][2]})::INT AS max_pages, 1000 * (r_regionkey + 1) > {C.BOUNDS['max_pages'][2]} AS moved FROM region")
def config_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations written as TOML, read back, and moved into bounds."""
    folder, rows = _folder(spark), []
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():
        own = config.Config(contact_email=f"{r['r_name'].lower()}@example.org", max_pages=1000 * (r["r_regionkey"] + 1))
        path = config.save(own, str(folder / f"{r['r_regionkey']}.toml"))
        again = config.load(str(path))
        settings, moved = again.settings()
        rows.append((r["r_regionkey"], again.contact_email, settings.max_pages, bool(moved)))
    return _rows(spark, rows, "region int, contact string, max_pages int, moved boolean")


@query("SELECT r_regionkey::INT AS region, unnest(['security_txt', 'sitemap', 'sitemap']) AS kind, unnest(['https://r' || r_regionkey || '.example.com/.well-known/security.txt', 'https://r' || r_regionkey || '.example.com/a.xml', 'https://cdn.example.com/b.xml']) AS url FROM region")
def discovery_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run asks for besides its target."""
    rows = []
    for r in table(spark, sf_dir, "region").select("r_regionkey").collect():
        k = r["r_regionkey"]
        rows += [(k, kind, url) for url, kind in discovery.seeds(f"https://r{k}.example.com/x", ["/a.xml", "https://cdn.example.com/b.xml", "ftp://no.example.com/c.xml"])]
    return _rows(spark, rows, "region int, kind string, url string")


# -- streams and background work ----------------------------------------------------------------------------------
@query("""SELECT user_id::VARCHAR AS dedup_value, count(DISTINCT 'https://e/' || (event_id % 11))::INT AS page_support, count(*)::INT AS occurrence_count, min('https://e/' || (event_id % 11)) AS first_seen_url FROM events GROUP BY user_id""")
def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live findings of a stream of events, run to its end: support is exact."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    rows = source.select(F.lit("email").alias("field"), F.col("user_id").cast("string").alias("dedup_value"), F.col("event_type").alias("value"), F.concat(F.lit("https://e/"), (F.col("event_id") % 11).cast("string")).alias("source_url"), F.lit("text_heuristic").alias("extraction_layer"))
    found = streams.run_to_files(state.live_findings(rows), f"{shared_dir(spark)}-findings", "update", ["field", "dedup_value"])
    return found.select("dedup_value", F.col("page_support").cast("int").alias("page_support"), F.col("occurrence_count").cast("int").alias("occurrence_count"), "first_seen_url")


@query(f"SELECT count(*) AS n, true AS small, {C.OBSERVED_ROWS}::BIGINT AS largest, true AS counted FROM nation".replace(f"{C.OBSERVED_ROWS}::BIGINT", f"least(count(*), {C.OBSERVED_ROWS})"))
def stream_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page log handed to an observer in small lists, with the frontier's size as a metric of each batch."""
    folder = shared_dir(spark)
    source = spark.readStream.schema(table(spark, sf_dir, "nation").schema).parquet(f"{sf_dir}/nation.parquet*").withColumn("depth", F.lit(1))
    sizes: list[int] = []
    running = streams.deliver(streams.observed(source, "frontier"), lambda rows: sizes.append(len(rows)), f"{folder}-progress", now=True)
    running.awaitTermination()
    counted = sum(p.observedMetrics["frontier"]["queued"] for p in running.recentProgress if "frontier" in p.observedMetrics)
    return _rows(spark, [(sum(sizes), max(sizes) <= C.OBSERVED_ROWS, max(sizes), counted == sum(sizes))], "n long, small boolean, largest long, counted boolean")


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def background_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs run off the caller's thread, all done when the pool is left."""
    done: list[tuple[str, int]] = []
    with engine.Background() as pool:
        for t in _COUNTED:
            pool.run(lambda t=t: (t, table(spark, sf_dir, t).count()), done.append)
    return _rows(spark, done, "name string, n long")
