"""The crawl as iterated joins over a snapshot of pages. Nothing is fetched.

Two modes. waves() is for scale: level by level, every level one join, one anti-join and one write to the shared
folder; depth is the least depth. exact() reproduces the order of a one-worker crawl under a budget, which is sequential
by nature: a queue on the driver of at most max_pages claims (2,000 by the bounds), whose link rows come from the
link table in batches of the next URLs in the queue.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitelens import constants as C
from sitelens.functions import urls as U
from sitelens.functions.html import links_of
from sitelens.operators.health import Tally
from sitelens.operators.settings import Settings, Target
from sitelens.storage import shared_dir, stored

#: URLs whose links exact() asks for at once.
BATCH = 200


def fetch_status(status_code: Column, content_type: Column, size: Column, error: Column, accepted: list[str], cap: int = C.MAX_BODY) -> Column:
    """Status of a response that is no page, else null; the type is checked before the size."""
    media = media_type(content_type)
    return (
        F.when(error.isNotNull(), error_status(error))
        .when(status_code == 429, "rate_limited")
        .when(status_code >= 400, "http_error")
        .when((media != "") & ~media.isin(*accepted), "skipped_content_type")
        .when(size > cap, "too_large")
    )


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def error_status(kind: Column) -> Column:
    """Status code of what went wrong with a fetch."""
    known = {
        "robots": "skipped_robots", "content_type": "skipped_content_type", "off_scope": "off_scope_redirect", "redirects": "too_many_redirects",
        "size": "too_large", "rate": "rate_limited", "http": "http_error", "transport": "transport_error", "parse": "parse_error",
    }
    out = F.lit("transport_error")
    for name, status in known.items():
        out = F.when(kind == name, status).otherwise(out)
    return out


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date; never negative."""
    at = F.concat(F.substring(F.trim(value), 6, 20), F.lit(" +0000"))  # HTTP dates are GMT, whatever the session's zone
    date = F.unix_timestamp(F.try_to_timestamp(at, F.lit("dd MMM yyyy HH:mm:ss Z"))) - F.unix_timestamp(now)
    return F.greatest(F.coalesce(F.trim(value).try_cast("int").cast("long"), date), F.lit(0)).cast("double")


def decode_body(body: Column, charset: Column) -> Column:
    """Declared charset unless it is ISO-8859-1 or unknown, else strict UTF-8, else ISO-8859-1.

    Undeclared, UTF-8 and ISO-8859-1 bodies never leave the JVM; only others go to a Python codec.
    """
    declared = F.lower(F.trim(F.coalesce(charset, F.lit(""))))
    fallback = F.coalesce(F.try_validate_utf8(body.cast("string")), F.decode(body, "ISO-8859-1"))
    usual = declared.isin("", "utf-8", "utf8", "iso-8859-1", "latin-1", "latin1")
    return F.coalesce(by_codec(F.when(~usual, body), declared), fallback)


@F.pandas_udf(StringType())
def by_codec(body: pd.Series, charset: pd.Series) -> pd.Series:
    """The text of each body in its charset, undecodable bytes replaced; null without body or for an unknown charset."""
    texts = []
    for raw, name in zip(body, charset, strict=True):
        try:
            texts.append(None if raw is None else bytes(raw).decode(name, "replace"))
        except (LookupError, ValueError):
            texts.append(None)
    return pd.Series(texts, dtype=object)


def resolve_redirects(requests: DataFrame, routes: DataFrame, target: Target, hops: int = C.MAX_REDIRECTS, denied: DataFrame | None = None) -> DataFrame:
    """(url, final_url, hops, error): where each requested URL ends, over at most `hops` joins with the routes.

    Every hop is canonicalized and scope-checked; a missing location is a transport error. denied: URLs (url) that
    robots.txt forbids: a hop that comes to one ends there.
    """
    table = routes.select(F.col("url").alias("_at"), F.col("status").alias("_status"), F.col("location").alias("_location"))
    stop = (routes.sparkSession.createDataFrame([], "url string") if denied is None else denied).select(F.col("url").alias("_denied")).distinct()
    rows = requests.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("error"))
    for hop in range(hops + 1):
        moved = F.col("_status").isin(*C.REDIRECT_CODES) & F.col("error").isNull()
        rows = rows.join(table, F.col("final_url") == F.col("_at"), "left")
        rows = rows.withColumn("_moved", F.coalesce(moved, F.lit(False)))
        rows = rows.withColumn("_next", U.canonicalize(F.when(F.col("_moved"), F.col("_location")), F.col("final_url")))
        rows = rows.join(stop, F.col("_next.url") == F.col("_denied"), "left")
        inside = U.in_scope(F.col("_next.url"), target.scope_host, target.include_subdomains, F.lit(target.scope_port).cast("int"))
        error = (
            F.when(~F.col("_moved"), F.col("error"))
            .when(F.lit(hop == hops), "redirects")
            .when(F.coalesce(F.trim("_location"), F.lit("")) == "", "transport")
            .when(F.col("_next.reason").isNotNull() | ~inside, "off_scope")
            .when(F.col("_denied").isNotNull(), "robots")
        )
        step = F.col("_moved") & error.isNull()
        rows = rows.select("url", F.when(step, F.col("_next.url")).otherwise(F.col("final_url")).alias("final_url"), (F.col("hops") + step.cast("int")).alias("hops"), error.alias("error"))
    return rows


def link_table(pages: DataFrame, markup: str = "html", url: str = "url") -> DataFrame:
    """(src, at, raw, dst, reason, detail): every link of every page, resolved against its page's canonical URL."""
    own = pages.select(U.canonicalize(F.col(url), F.lit(None).cast("string")).alias("_own"), links_of(F.col(markup)).alias("_links"))
    rows = own.where("_own.reason IS NULL").select(F.col("_own.url").alias("src"), F.posexplode("_links").alias("at", "raw"))
    return rows.select("src", "at", "raw", U.canonicalize(F.col("raw"), F.col("src")).alias("_to")).select("src", "at", "raw", F.col("_to.url").alias("dst"), F.col("_to.reason").alias("reason"), F.col("_to.detail").alias("detail"))


def gate(dst: Column, reason: Column, depth: Column, target: Target, settings: Settings) -> Column:
    """Status of a link that is not followed, 'drop' if it is not even logged, null if it may be followed."""
    inside = U.in_scope(dst, target.scope_host, target.include_subdomains, F.lit(target.scope_port).cast("int"))
    return (
        F.when(reason == "unsupported_scheme", "drop")
        .when(reason.isNotNull(), reason)
        .when(~inside, "skipped_off_scope")
        .when(U.has_skipped_extension(dst), "skipped_extension")
        .when(depth > settings.max_depth, "skipped_depth")
    )


def by_source(links: DataFrame, buckets: int | None = None) -> DataFrame:
    """The links as a table in buckets of `src`, sorted there: joins with a frontier move the frontier alone, level after level.

    The table is one of the session's catalog with its files in the shared folder.
    """
    spark = links.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sitelens_links_{uuid.uuid4().hex}"
    writer = links.repartition(n, "src").write.format("parquet").bucketBy(n, "src").sortBy("src").option("path", f"{shared_dir(spark)}-links")
    writer.saveAsTable(name)
    return spark.table(name)


def _out(links: DataFrame, frontier: DataFrame) -> DataFrame:
    """The links that leave a frontier (url)."""
    return links.join(frontier.select(F.col("url").alias("src")), "src")


def _rank() -> Column:
    """Of several statuses of a URL the least rank counts: a link that is followed beats all that are not, whatever their names."""
    return F.when(F.col("status") == "fetch", 0).otherwise(1).alias("rank")


def waves(links: DataFrame, target: Target, settings: Settings, budget: int | None = None) -> DataFrame:
    """(url, depth, status): 'fetch' for every URL that the crawl reaches, and the log rows of those it does not.

    Within a level, URLs with high-value paths come first, then by URL; what a budget leaves is skipped_budget. A URL's
    row is that of its least depth; being followed beats being skipped, within a level and between levels. links: best from by_source().
    """
    spark = links.sparkSession
    frontier = stored(spark.createDataFrame([(target.url, 0, "fetch")], "url string, depth int, status string"), "wave")
    reached, skipped = frontier, None
    left = None if budget is None else budget - 1
    for depth in range(1, settings.max_depth + 2):
        out = _out(links, frontier)
        rows = out.select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), gate(F.col("dst"), F.col("reason"), F.lit(depth), target, settings).alias("status"))
        rows = rows.where("status IS NULL OR status <> 'drop'").withColumn("status", F.coalesce("status", F.lit("fetch")))
        rows = rows.groupBy("url").agg(F.min("depth").alias("depth"), F.min(F.struct(_rank(), "status"))["status"].alias("status"))
        wave = stored(rows.join(reached.select("url"), "url", "left_anti"), "wave")
        follow = wave.where("status = 'fetch'")
        if left is not None:
            first = follow.orderBy(F.desc(U.path(F.col("url")).rlike(C.HIGH_VALUE_PATH)), "url").limit(max(left, 0))
            first = stored(first, "claimed")
            late = follow.join(first.select("url"), "url", "left_anti").withColumn("status", F.lit("skipped_budget"))
            n = first.count()
            left -= n
            frontier = first
            others = wave.where("status <> 'fetch'").unionByName(late)
        else:
            frontier, others = follow, wave.where("status <> 'fetch'")
            n = frontier.limit(1).count()
        reached = reached.unionByName(frontier)
        skipped = others if skipped is None else skipped.unionByName(others)
        if not n:
            break
    log = reached if skipped is None else reached.unionByName(skipped)
    order = F.struct(_rank(), "depth", "status")
    return log.groupBy("url").agg(F.min(order).alias("_row")).select("url", "_row.depth", "_row.status")


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): every URL within max_depth links of a seed, at its least depth; no scope, no budget. links: best from by_source()."""
    reached = stored(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "reached")
    frontier = reached
    for depth in range(1, max_depth + 1):
        step = _out(links.where("reason IS NULL"), frontier).select(F.col("dst").alias("url")).distinct()
        frontier = stored(step.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if not frontier.limit(1).count():
            break
        reached = reached.unionByName(frontier)
    return reached


@dataclass
class Crawl:
    """What exact() did: page log rows in order, outcome, request slots."""

    log: list[tuple[str, int, str, str | None]] = field(default_factory=list)
    outcome: str = "completed"
    request_slots: int = 0


def exact(
    links: DataFrame, statuses: DataFrame, target: Target, settings: Settings, robots_denied: frozenset[str] = frozenset(), documents: list[tuple[str, str]] | None = None,
    discovered: list[tuple[str, str | None]] | None = None, cancelled: Callable[[], bool] = lambda: False,
) -> Crawl:
    """The log of a one-worker crawl in claim order.

    statuses: (url, status) of what fetching each URL of the snapshot gives; a URL without row is a transport error.
    documents: (url, status) of security.txt and sitemaps, asked for after the seed, each for one unit of the budget.
    discovered: (url, gate) that sitemaps list, queued at depth one. High-value paths go to the front of the queue.
    Aborts follow health.py's rules; cancelled() is asked between pages.
    """
    gated = links.select("src", "at", "dst", "detail", gate(F.col("dst"), F.col("reason"), F.lit(-1), target, settings).alias("gate"))
    known: dict[str, tuple[str, list[tuple]]] = {}
    crawl = Crawl()
    queue: deque[tuple[str, int]] = deque([(target.url, 0)])
    visited: set[str] = set()
    logged: set[str] = set()
    queued = {target.url}
    depth_limited = budget_hit = False
    tally = Tally()

    def record(url: str, depth: int, status: str, detail: str | None = None) -> None:
        if url not in logged:
            logged.add(url)
            crawl.log.append((url, depth, status, detail))

    def enqueue(out: list[tuple], depth: int) -> None:
        nonlocal depth_limited, budget_hit
        for dst, stop, detail in out:
            if stop == "drop" or stop is None and (dst in visited or dst in queued):
                continue
            if stop is None and depth > settings.max_depth:
                stop, depth_limited = "skipped_depth", True
            if stop is None and crawl.request_slots >= settings.max_pages:
                stop, budget_hit = "skipped_budget", True
            if stop is not None:
                record(dst, depth, stop, detail)
            else:
                queued.add(dst)
                (queue.appendleft if U.is_high_value_url(dst) else queue.append)((dst, depth))

    def load() -> None:
        wanted = [u for u, _ in list(queue)[:BATCH] if u not in known]
        for u in wanted:
            known[u] = ("transport_error", [])
        for r in statuses.where(F.col("url").isin(wanted)).collect():
            known[r["url"]] = (r["status"], [])
        for r in gated.where(F.col("src").isin(wanted)).orderBy("src", "at").collect():
            known[r["src"]][1].append((r["dst"], r["gate"], r["detail"]))

    while queue:
        if cancelled():
            crawl.outcome = "stopped_by_operator"
            return crawl
        if crawl.request_slots >= settings.max_pages:
            budget_hit = True
            break
        if queue[0][0] not in known:
            load()
        url, depth = queue.popleft()
        queued.discard(url)
        if url in visited:
            continue
        visited.add(url)
        crawl.request_slots += 1
        status, out = known[url]
        if url in robots_denied:
            status, out = "skipped_robots", []
        if depth == 0 and status in C.REFUSED_SEED:
            raise ValueError(f"the run does not start: {url} is {status}")
        record(url, depth, status)
        if armed := tally.step(status):
            crawl.outcome = armed
            return crawl
        if status in C.FETCHED:
            enqueue(out, depth + 1)
        if url == target.url and depth == 0:
            for document, found in documents or []:
                if document in visited:
                    continue
                if crawl.request_slots >= settings.max_pages:
                    record(document, 0, "skipped_budget")
                    budget_hit = True
                    continue
                visited.add(document)
                crawl.request_slots += 1
                record(document, 0, found)
            enqueue([(u, g, None) for u, g in discovered or []], C.SITEMAP_DEPTH)
    if budget_hit:
        crawl.outcome = "budget_exhausted"
        for url, depth in queue:
            record(url, depth, "skipped_budget")
    elif depth_limited:
        crawl.outcome = "depth_exhausted"
    return crawl


def first_log_row(log: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each URL: the first writer wins."""
    return log.withColumn("_k", F.row_number().over(Window.partitionBy("url").orderBy(order))).where("_k = 1").drop("_k")


def collapse_final(results: DataFrame, order: str = "seq") -> DataFrame:
    """URLs that end at one page are one page: the first result of each final URL stays."""
    return results.withColumn("_k", F.row_number().over(Window.partitionBy("final_url").orderBy(order))).where("_k = 1").drop("_k")


def page_counts(log: DataFrame, *key: str) -> DataFrame:
    """Pages fetched, skipped, failed and skipped by robots."""
    s = F.col("status")
    return log.groupBy(*key).agg(
        F.count_if(s.isin(*C.FETCHED)).alias("pages_fetched"),
        F.count_if(s.isin(*C.SKIPPED)).alias("pages_skipped"),
        F.count_if(s.isin(*C.FAILED)).alias("pages_failed"),
        F.count_if(s == "skipped_robots").alias("pages_skipped_by_robots"),
    )
