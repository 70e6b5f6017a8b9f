"""Queries through what users of Spark meet: archives and findings as data sources, extraction, validation and health as SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import sql
from sitelens.operators import aggregate, extract, inline
from sitelens.plans import runs
from sitelens.plans.registry import ORACLE_SQL, query
from sitelens.plans.rendered import ALL_FIELDS, SUPPLIERS, supplier_pages, suppliers
from sitelens.sinks import corpus
from sitelens.sources import archive
from sitelens.storage import shared_dir, table

_STATUS = "(200 + page_id % 3 * 100)::INT"


def _archived(spark: SparkSession, sf_dir: str) -> str:
    """The pages as stored responses of several statuses, every eleventh a request that got none; returns the archive's folder."""
    path = f"{shared_dir(spark)}-archive"
    lost = F.col("page_id") % 11 == 0
    rows = table(spark, sf_dir, "pages").select(
        "url", F.col("html").cast("binary").alias("body"), F.when(~lost, 200 + F.col("page_id") % 3 * 100).cast("int").alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(F.col("page_id") % 3 == 1, F.col("url")).alias("location"), F.create_map(F.lit("X-Page"), F.col("page_id").cast("string")).alias("headers"), F.when(lost, "rate").alias("error"),
        F.expr("timestamp_seconds(1700000000 + page_id)").alias("fetched_at"),
    )
    archive.write_archive(rows, path)
    return path


@query(f"""SELECT page_id::VARCHAR AS page, url, {_STATUS} AS status, 'text/html; charset=utf-8' AS content_type, CASE WHEN page_id % 3 = 1 THEN url END AS location,
  md5(html) AS digest, 1700000000 + page_id AS seconds FROM pages WHERE page_id % 11 <> 0""")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response of an archive that executors wrote, read from its records."""
    rows = archive.read_archive(spark, _archived(spark, sf_dir), splitBytes=str(1 << 20)).where("status IS NOT NULL")
    return rows.select(F.element_at("headers", "X-Page").alias("page"), "url", "status", "content_type", "location", F.md5("body").alias("digest"), F.unix_timestamp("fetched_at").alias("seconds"))


@query(f"SELECT url, {_STATUS} AS status, 1700000000 + page_id AS seconds FROM pages WHERE url LIKE 'https://%' AND page_id % 11 <> 0 AND page_id % 3 IN (0, 2)")
def archive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some responses by URL and status: the source takes both filters over, and no record is opened."""
    rows = archive.read_archive(spark, _archived(spark, sf_dir), ["url", "status", "fetched_at"])
    return rows.where(F.col("url").startswith("https://") & F.col("status").isin(200, 400)).select("url", "status", F.unix_timestamp("fetched_at").alias("seconds"))


@query("SELECT url, 'rate' AS error FROM pages WHERE page_id % 11 = 0")
def archive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that got no response."""
    return archive.read_archive(spark, _archived(spark, sf_dir), ["url", "status", "error"]).where("status IS NULL").select("url", "error")


@query(f"""WITH {SUPPLIERS}, found AS ({ALL_FIELDS})
SELECT field, value, confidence::DOUBLE AS extraction_confidence, 1::INT AS page_support, n::INT AS occurrence_count, 'https://' || host || '/' AS first_seen_url FROM found WHERE field IN ('email', 'phone', 'company_identifier')""")
def corpus_findings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all suppliers' pages, written by the executors with one commit; of the files only those of three fields are read."""
    path = f"{shared_dir(spark)}-findings"
    corpus.write_findings(aggregate.findings(aggregate.accepted(extract.candidates(supplier_pages(spark, sf_dir)))), path)
    rows = corpus.read_findings(spark, path).where(F.col("field").isin("email", "phone", "company_identifier"))
    return rows.select("field", "value", "extraction_confidence", "page_support", "occurrence_count", "first_seen_url")


@query(f"""WITH {SUPPLIERS}, found AS ({ALL_FIELDS}) SELECT field, value, 'https://' || host || '/' AS source_url, count(*) AS entries FROM found, (SELECT unnest(range(0, 3)) AS k) WHERE k < n GROUP BY ALL
UNION ALL SELECT 'technology', 'Builder ' || s_nationkey, 'https://' || host || '/', 1 FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY 'https://' || host || '/') AS k FROM suppliers) WHERE k <= 10""")
def corpus_findings_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance survives the files: nested rows are read back and flattened."""
    path = f"{shared_dir(spark)}-findings"
    corpus.write_findings(aggregate.findings(aggregate.accepted(extract.candidates(supplier_pages(spark, sf_dir)))), path)
    rows = corpus.read_findings(spark, path, ["field", "value", "provenance"], splitBytes=str(64 << 10))
    return rows.select("field", "value", F.inline("provenance")).groupBy("field", "value", "source_url").agg(F.count("*").alias("entries"))


_FINDINGS = """WITH c AS (SELECT p.url AS source_url, x.* FROM {pages} AS p, LATERAL extracted(p.text, p.headers) AS x),
v AS (SELECT field, source_url, extraction_layer, validated(field, raw_value, metadata, CASE WHEN field IN ('person_name', 'organization_name') THEN fold(raw_value) END) AS v FROM c WHERE layer_allowed(field, extraction_layer)),
f AS (SELECT field, source_url, v.value AS value, v.dedup_value AS dedup_value, layer_rank(extraction_layer) AS rank, layer_confidence(extraction_layer) AS confidence FROM v WHERE v IS NOT NULL)
SELECT field, min_by(value, struct(rank, source_url, value)) AS value, max(confidence) AS extraction_confidence, CAST(count(DISTINCT source_url) AS INT) AS page_support, CAST(count(*) AS INT) AS occurrence_count, min(source_url) AS first_seen_url
FROM f GROUP BY field, dedup_value"""


@query(ORACLE_SQL["all_fields_findings"])
def sql_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pages to findings in SQL alone: a lateral table function extracts, SQL functions validate."""
    sql.register(spark)
    pages = supplier_pages(spark, sf_dir).select("url", "text", F.map_entries("headers").alias("headers"))
    return spark.sql(_FINDINGS, pages=pages)


@query(ORACLE_SQL["all_fields_findings"])
def one_pass_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same findings with one expression over each page's parse instead of unions over a stored one."""
    found = aggregate.findings(aggregate.accepted(inline.candidates(supplier_pages(spark, sf_dir))))
    return found.select("field", "value", "extraction_confidence", "page_support", "occurrence_count", "first_seen_url")


@query(f"""WITH {SUPPLIERS} SELECT s_suppkey, siren, true AS french, s_suppkey % 10 = (10 - ({{digits}}) % 10) % 10 AS other FROM suppliers""".replace("{digits}", "+".join(f"(substr(b, {i}, 1)::INT * {2 if i % 2 == 0 else 1}) % 10 + (substr(b, {i}, 1)::INT * {2 if i % 2 == 0 else 1}) // 10" for i in range(1, 9))))
def sql_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validator in SQL: numbers with and without their check digit."""
    sql.register(spark)
    rows = suppliers(spark, sf_dir).selectExpr("s_suppkey", "siren", "concat(b, CAST(s_suppkey % 10 AS string)) AS tried")
    return spark.sql("SELECT s_suppkey, siren, valid_company_identifier(siren, map()) IS NOT NULL AS french, valid_company_identifier(tried, map()) IS NOT NULL AS other FROM {rows}", rows=rows)


@query(ORACLE_SQL[runs.abort_first.__name__])
def sql_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first abort of each run by a table function over the run's rows in order."""
    sql.register(spark)
    log = table(spark, sf_dir, "events").selectExpr("user_id AS run_id", "ts", "event_id", "event_id AS seq", "CASE WHEN event_type IN ('error', 'view', 'click') THEN 'http_error' ELSE 'ok' END AS status", "CAST(NULL AS double) AS retry_after")
    log.createOrReplaceTempView("sitelens_log")
    return spark.sql("SELECT CAST(run_id AS bigint) AS run_id, outcome, seq AS event_id FROM run_health(TABLE(sitelens_log) PARTITION BY run_id ORDER BY (ts, event_id))")
