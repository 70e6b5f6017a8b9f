"""The one place where operators are wired into runs.

report() is the whole of a run over stored responses: purpose and settings first, then robots, the crawl in claim order, extraction
of the pages it reached, aggregation, counts. corpus_findings() is the same extraction over any number of sites, each
page's host being its site, with no budget and no queue.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens import schemas
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.operators import aggregate, crawl, extract, robots
from sitelens.operators.settings import Purpose, Settings, Target
from sitelens.sinks.report import Report
from sitelens.sources import discovery, snapshot
from sitelens.storage import stored


def session(app: str = "sitelens", **config: str) -> SparkSession:
    """A session with what the operators expect: UTC, adaptive plans."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in config.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def pages_with_status(routes: DataFrame, policy: DataFrame | None, now: Column | None = None) -> DataFrame:
    """Stored responses as pages (schemas.FETCHED_PAGE) with the status that fetching each would have: robots first, then the response, then the parse."""
    pages = snapshot.fetched(routes)
    if policy is not None:
        pages = robots.decide(pages, policy, now=now)
        pages = pages.withColumn("status", F.when(~F.col("robots_allowed"), "skipped_robots").otherwise(F.col("status")))
    return pages


def report(
    routes: DataFrame, policy: DataFrame | None, target: Target, settings: Settings, purpose: Purpose, contact: str, now: datetime | None = None, run_id: str | None = None,
    version: str = "0.1", project_url: str = "https://example.org/sitelens", extractors: Sequence[Callable[[DataFrame], DataFrame]] = (),
    validators: Mapping[str, Callable[[Column], Column]] | None = None,
) -> Report:
    """Crawl the snapshot from the target and report, whatever the outcome; a refused seed raises before anything is written.

    Redirects are followed over the stored responses, every hop checked for scope and robots.txt; a page's findings name the URL
    that it was read at. extractors and validators are further ones, as extract.all_extractors and aggregate.validate take them.
    """
    spark = routes.sparkSession
    now = now or datetime.now(UTC)
    agent = T.user_agent(C.PRODUCT_TOKEN, version, project_url, contact)
    pages = stored(pages_with_status(routes, policy), "pages")
    ends = redirect_ends(routes, pages, target)
    usable = pages.where("status IS NULL").join(ends.select("url"), "url", "left_anti")
    parsed = extract.parse_pages(usable)
    parsed = stored(parsed.withColumn("status", F.when(F.col("parsed.n_elements") == 0, "parse_error").otherwise("ok")), "parsed")
    links = parsed.select(F.col("url").alias("src"), F.posexplode("parsed.links").alias("at", "raw")).withColumn("to", U.canonicalize(F.col("raw"), F.col("src")))
    links = stored(links.select("src", "at", "raw", F.col("to.url").alias("dst"), F.col("to.reason").alias("reason"), F.col("to.detail").alias("detail")), "links")
    statuses = pages.where("status IS NOT NULL").select("url", "status").unionByName(parsed.select("url", "status"))
    arrived = ends.join(statuses.withColumnRenamed("url", "final_url"), "final_url", "left")
    arrived = arrived.select("url", F.coalesce("error", "status", F.lit("transport_error")).alias("status"))
    statuses = statuses.join(ends.select("url"), "url", "left_anti").unionByName(arrived)
    through = links.join(ends.where("error IS NULL").select("url", F.col("final_url").alias("src")), "src")
    links = links.unionByName(through.select(F.col("url").alias("src"), "at", "raw", "dst", "reason", "detail"))
    documents, discovered = _discovery(routes, policy, target, settings)
    run = crawl.exact(links, statuses, target, settings, documents=documents, discovered=discovered)
    log = spark.createDataFrame([(*r, i) for i, r in enumerate(run.log)], "url string, depth int, status string, detail string, seq int")
    reached = log.where(F.col("status").isin(*C.FETCHED)).select("url").join(ends.select("url", "final_url"), "url", "left")
    reached = reached.select(F.coalesce("final_url", "url").alias("url")).distinct()
    own = parsed.join(reached, "url", "left_semi")
    known = U.canonical("/.well-known/security.txt", target.url)[0]
    documents = snapshot.fetched(routes, ["text/plain"]).where((F.col("url") == known) & F.col("status").isNull())
    found = extract.all_extractors(own, extractors).unionByName(discovery.security_txt(documents.select("url", "text", "fetched_at")))
    accepted = stored(aggregate.accepted(found, settings.phone_region, validators), "accepted")
    counts = accepted.groupBy(F.col("source_url").alias("url")).agg(F.count("*").cast("int").alias("n"))
    log = log.join(counts, "url", "left").join(pages.select("url", "status_code", "content_type"), "url", "left")
    status = F.when((F.col("status") == "ok") & F.col("n").isNull(), "no_findings").otherwise(F.col("status"))
    page_log = log.select("url", "depth", status.alias("status"), "detail", F.col("status_code").alias("http_status"), "content_type", F.coalesce("n", F.lit(0)).alias("findings_count"))
    shown = now.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = {
        "run_id": run_id or spark.range(1).select(T.new_run_id()).first()[0], "started_at": shown, "finished_at": shown, "outcome": run.outcome, "outcome_detail": None, "purpose_category": purpose.category,
        "purpose_note": purpose.note, "retention_days": settings.retention_days, "tool_name": C.PRODUCT_TOKEN, "tool_version": version, "user_agent": agent, "target_entered": target.entered, "target_url": target.url,
        "scope_host": target.scope_host, "include_subdomains": target.include_subdomains, "max_pages": settings.max_pages, "max_depth": settings.max_depth,
        "request_interval_seconds": float(settings.request_interval_seconds), "concurrent_requests": settings.concurrent_requests, "follow_sitemap": settings.follow_sitemap,
        "phone_region": settings.phone_region, "requests_made": run.request_slots,
    }
    return Report(head, stored(aggregate.audited(aggregate.findings(accepted, store=False)), "findings"), stored(page_log, "page_log"))


def redirect_ends(routes: DataFrame, pages: DataFrame, target: Target) -> DataFrame:
    """(url, final_url, error): where the redirects among the stored responses end, or the status of what stops them."""
    at = U.canonicalize(F.col("url"), F.lit(None).cast("string"))["url"].alias("url")
    table = routes.select(at, "status", "location" if "location" in routes.columns else F.lit(None).cast("string").alias("location"))
    moved = table.where(F.col("status").isin(*C.REDIRECT_CODES)).select("url").distinct()
    denied = pages.where("status = 'skipped_robots'").select("url")
    ends = crawl.resolve_redirects(moved.join(denied, "url", "left_anti"), table, target, denied=denied)
    return stored(ends.select("url", "final_url", F.when(F.col("error").isNotNull(), crawl.error_status(F.col("error"))).alias("error")), "redirects")


def _discovery(routes: DataFrame, policy: DataFrame | None, target: Target, settings: Settings) -> tuple[list[tuple[str, str]], list[tuple[str, str | None]]]:
    """Discovery documents with their status, and gated URLs of sitemaps: at most five documents of 500 URLs."""
    spark = routes.sparkSession
    site = U.canonical("/", target.url)[0].rstrip("/")
    declared: list[str] = []
    if policy is not None:
        rows = policy.where(F.col("host_key") == site).select(robots.sitemaps(F.col("body").cast("string")).alias("s")).limit(1).collect()
        declared = [u for r in rows for u in r["s"] or []]
    seeds = discovery.seeds(target.url, declared)
    wanted = [u for u, kind in seeds if kind == "security_txt" or settings.follow_sitemap]
    plain = snapshot.fetched(routes, ["text/plain"]).where(F.col("url") == seeds[0][0])
    security = plain.select("url", F.coalesce("status", discovery.security_txt_status(F.col("text")), F.lit("ok")).alias("status"))
    xml = snapshot.fetched(routes, ["application/xml", "text/xml", "text/plain"], C.MAX_SITEMAP)
    read = stored(discovery.sitemap_locations(xml.where("status IS NULL").select("url", "text")).select("url", "text", "kind", "status"), "sitemaps")
    listed = spark.createDataFrame([(u, i) for i, u in enumerate(wanted[1:])], "url string, at int") if settings.follow_sitemap else None
    status = {r["url"]: r["status"] for r in security.collect()}
    if listed is None:
        return [(u, status.get(u, "http_error")) for u in wanted], []
    status |= {r["url"]: r["status"] or "no_findings" for r in read.join(F.broadcast(listed), "url", "left_semi").select("url", "status").collect()}
    urls = discovery.sitemap_urls(listed, read.select("url", "text")).select(U.canonicalize(F.col("url"), F.lit(target.url)).alias("c"))
    gated = urls.select(F.col("c.url").alias("url"), crawl.gate(F.col("c.url"), F.col("c.reason"), F.lit(C.SITEMAP_DEPTH), target, settings).alias("gate"))
    return [(u, status.get(u, "http_error")) for u in wanted[: C.MAX_SITEMAPS + 1]], [(r["url"], r["gate"]) for r in gated.distinct().orderBy("url").collect()]


def corpus_findings(
    pages: DataFrame, region: str = C.DEFAULT_REGION, extractors: Sequence[Callable[[DataFrame], DataFrame]] = (), validators: Mapping[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """Findings of every site of a corpus of pages (schemas.FETCHED_PAGE): one row for each (site, field, dedup_value).

    The parse is stored once, as six extractors read it; sites never meet in one task.
    """
    parsed = stored(extract.parse_pages(pages), "parsed")
    rows = aggregate.accepted(extract.all_extractors(parsed, extractors), region, validators)
    return aggregate.findings(rows.withColumn("dedup_value", F.concat_ws("\n", U.scope_host(F.col("source_url")), "dedup_value"))).select(
        F.split_part("dedup_value", F.lit("\n"), F.lit(1)).alias("site"), *[c for c in ("field", "value", "extraction_confidence", "page_support", "occurrence_count", "first_seen_url", "metadata", "provenance")]
    )


FINDING = schemas.FINDING


class Background:
    """Work off the caller's thread: exports, listings, erasures. Spark takes jobs from several threads; leaving drains them."""

    def __init__(self, threads: int = 4) -> None:
        self._pool = ThreadPoolExecutor(threads)

    def run(self, work: Callable[[], object], on_success: Callable[[object], None] = lambda _: None, on_failure: Callable[[BaseException], None] = lambda _: None) -> Future:
        """Start work; one of the two is called with its result or its error, on the worker's thread."""

        def done(f: Future) -> None:
            error = f.exception()
            if error is None:
                on_success(f.result())
            else:
                on_failure(error)

        future = self._pool.submit(work)
        future.add_done_callback(done)
        return future

    def __enter__(self) -> Background:
        return self

    def __exit__(self, *_: object) -> None:
        self._pool.shutdown(wait=True)
