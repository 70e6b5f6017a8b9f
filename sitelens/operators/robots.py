"""robots.txt: decisions fail closed, for each URL."""

from __future__ import annotations

from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from sitelens import constants as C
from sitelens.functions import urls as U

RULE = StructType([StructField("allowed", BooleanType()), StructField("delay", DoubleType())])


def host_key(url: Column) -> Column:
    return F.concat(U.scheme(url), F.lit("://"), F.lower(U.authority(url)))


def status_decision(status: Column, error: Column, body: Column) -> Column:
    """struct(reason, allowed) where the response decides by itself; null reason where the body must be read."""
    of = lambda reason, allowed: F.struct(F.lit(reason).alias("reason"), F.lit(allowed).alias("allowed"))
    return (
        F.when(error == "too_many_redirects", of("robots_too_many_redirects", False))
        .when(error.isNotNull() | status.isNull(), of("robots_unreachable_transport", False))
        .when(status == 401, of("robots_refused_401", False))
        .when(status == 403, of("robots_refused_403", False))
        .when(status == 404, of("robots_absent_404", True))
        .when((status >= 400) & (status < 500), of("robots_absent_4xx", True))
        .when(status >= 500, of("robots_unreachable_5xx", False))
        .when((status < 200) | (status >= 300), of("robots_unreachable_transport", False))
        .when(F.octet_length(body) > C.MAX_ROBOTS, of("robots_body_too_large", False))
        .when(~F.is_valid_utf8(body.cast("string")), of("robots_undecodable", False))
    )


@lru_cache(maxsize=256)
def _parser(body: str) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    return parser


@F.pandas_udf(RULE)
def rule(body: pd.Series, url: pd.Series, token: pd.Series) -> pd.DataFrame:
    """What the rules of a body say of a URL for our token; a body is parsed once in each worker."""
    out = []
    for b, u, t in zip(body, url, token, strict=True):
        if b is None:
            out.append((None, None))
            continue
        parser = _parser(b)
        delay, rate = parser.crawl_delay(t), parser.request_rate(t)
        if delay is None and rate is not None and rate.requests:
            delay = rate.seconds / rate.requests
        out.append((parser.can_fetch(t, u), None if delay is None else float(delay)))
    return pd.DataFrame(out, columns=["allowed", "delay"]).astype({"allowed": object, "delay": float})


def sitemaps(body: Column) -> Column:
    """Sitemap: directives, wherever they stand."""
    return F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))


def answers(hosts: DataFrame, routes: DataFrame, hops: int = C.MAX_REDIRECTS, url: str = "url") -> DataFrame:
    """What each host of `hosts` answers for its robots.txt (schemas.ROBOTS), over stored responses (schemas.ROUTE).

    Redirects are followed wherever they lead, `hops` of them at most, a join with the routes for each; no response, or a redirect without a place to go,
    is a transport error. Of a body one byte more than may be read is kept, so one that is too large is known as such.
    """
    dated = F.col("fetched_at") if "fetched_at" in routes.columns else F.lit(None).cast("timestamp")
    table = routes.select(F.col("url").alias("_at"), F.col("status").alias("_status"), F.col("location").alias("_to"), F.substring("body", F.lit(1), F.lit(C.MAX_ROBOTS + 1)).alias("_body"), dated.alias("_time"))
    rows = hosts.select(host_key(F.col(url)).alias("host_key"), U.robots_url(F.col(url)).alias("at")).distinct()
    rows = rows.select("host_key", "at", *[F.lit(None).cast(t).alias(c) for c, t in (("status_code", "int"), ("body", "binary"), ("error", "string"), ("fetched_at", "timestamp"))])
    for hop in range(hops + 1):
        open_ = F.col("status_code").isNull() & F.col("error").isNull()
        moved = F.col("_status").isin(*C.REDIRECT_CODES)
        to = U.canonicalize(F.when(open_ & moved, F.col("_to")), F.col("at"))["url"]
        rows = rows.join(table, open_ & (F.col("at") == F.col("_at")), "left").withColumn("_next", to)
        lost = F.col("_at").isNull() | moved & (F.coalesce(F.trim("_to"), F.lit("")) == "") | moved & F.col("_next").isNull()
        error = F.when(lost, "transport").when(moved & F.lit(hop == hops), "too_many_redirects")
        ends = open_ & ~F.coalesce(moved, F.lit(False)) & F.col("_at").isNotNull()
        rows = rows.select(
            "host_key", F.when(open_ & moved & error.isNull(), F.col("_next")).otherwise(F.col("at")).alias("at"), F.when(ends, F.col("_status")).otherwise(F.col("status_code")).alias("status_code"),
            F.when(ends, F.col("_body")).otherwise(F.col("body")).alias("body"), F.when(open_, error).otherwise(F.col("error")).alias("error"), F.when(open_, F.coalesce("_time", "fetched_at")).otherwise(F.col("fetched_at")).alias("fetched_at"),
        )
    return rows.drop("at")


def decide(urls: DataFrame, robots: DataFrame, token: str = C.PRODUCT_TOKEN, url: str = "url", now: Column | None = None) -> DataFrame:
    """urls with robots_allowed, robots_reason, robots_delay and robots_url.

    robots: (host_key, status_code, body, error, fetched_at), a row for each host, of which answers older than a day
    count as absent transport. A host without row was not reached: denied.
    """
    # of several answers of a host the newest counts, so a table may be added to as answers are asked for anew
    newest = F.max_by(F.struct(*[F.col(c) for c in robots.columns]), F.col("fetched_at")) if "fetched_at" in robots.columns else None
    if newest is not None:
        dated = robots.withColumn("fetched_at", F.coalesce("fetched_at", F.lit("1970-01-01 00:00:00").cast("timestamp")))
        robots = dated.groupBy(F.col("host_key").alias("_host")).agg(newest.alias("r")).select("r.*")
    if now is not None:
        robots = robots.where(F.col("fetched_at") > now - F.expr(f"INTERVAL {C.ROBOTS_TTL_HOURS} HOURS"))
    policy = robots.select("host_key", status_decision(F.col("status_code"), F.col("error"), F.col("body")).alias("_by_status"), F.col("body").cast("string").alias("_body"))
    rows = urls.withColumn("_key", host_key(F.col(url))).join(policy, F.col("_key") == F.col("host_key"), "left")
    return _judged(rows, urls.columns, F.col("host_key").isNull(), token, url)


def judge(asked: DataFrame, token: str = C.PRODUCT_TOKEN, url: str = "url") -> DataFrame:
    """As decide(), for rows that carry their host's answer themselves (status_code, body, error); works on streams."""
    kept = [c for c in asked.columns if c not in ("status_code", "body", "error")]
    rows = asked.withColumn("_by_status", status_decision(F.col("status_code"), F.col("error"), F.col("body"))).withColumn("_body", F.col("body").cast("string"))
    return _judged(rows, kept, F.lit(False), token, url)


def _judged(rows: DataFrame, kept: list[str], unreached: Column, token: str, url: str) -> DataFrame:
    body = F.when(~unreached & F.col("_by_status").isNull(), F.col("_body"))
    rows = rows.withColumn("_rule", rule(body, F.col(url), F.lit(token)))
    allowed = F.when(unreached, False).otherwise(F.coalesce("_by_status.allowed", "_rule.allowed", F.lit(False)))
    by_rule = F.when(F.col("_rule.allowed"), "robots_allow_rule").otherwise("robots_disallow")
    reason = F.when(unreached, "robots_unreachable_transport").otherwise(F.coalesce("_by_status.reason", by_rule))
    return rows.select(*[F.col(c) for c in kept], allowed.alias("robots_allowed"), reason.alias("robots_reason"), F.col("_rule.delay").alias("robots_delay"), U.robots_url(F.col(url)).alias("robots_url"))
