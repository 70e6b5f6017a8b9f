"""Stored responses as pages: a1 to a9 of the fetch path, replayed over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens import schemas
from sitelens.functions import urls as U
from sitelens.operators import crawl


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A snapshot of pages in any format that Spark reads; only columns that a query uses leave the files."""
    return spark.read.format(fmt).options(**options).load(path)


def read_bodies(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """Saved files as (url, body, size): the file's path is the URL."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("url"), F.col("content").alias("body"), F.col("length").alias("size"))


def lower_headers(headers: Column) -> Column:
    """Header names lower-cased; of names that then meet, the last by name stays."""
    entries = F.array_sort(F.map_entries(headers))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(lowered, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(lowered, lambda e: e["key"] == n), -1)["value"].alias("value")))
    return F.map_from_entries(last)


def charset(content_type: Column) -> Column:
    return F.nullif(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1), F.lit(""))


def fetched(routes: DataFrame, accepted: list[str] | None = None, cap: int = C.MAX_BODY) -> DataFrame:
    """Responses (schemas.ROUTE and fetched_at, error) as pages with status.

    The status is null for a usable page; url is canonical; the body is decoded; bodies over the cap never are.
    """
    routes = routes.withColumns({c: F.lit(None).cast(t) for c, t in (("error", "string"), ("fetched_at", "timestamp")) if c not in routes.columns})
    size = F.octet_length("body")
    status = crawl.fetch_status(F.col("status"), F.col("content_type"), size, F.col("error"), accepted or C.HTML_TYPES, cap)
    canonical = U.canonicalize(F.col("url"), F.lit(None).cast("string"))
    return routes.select(
        canonical["url"].alias("url"),
        F.col("status").alias("status_code"),
        "content_type",
        F.when(status.isNull(), crawl.decode_body(F.col("body"), charset(F.col("content_type")))).alias("text"),
        "fetched_at",
        lower_headers(F.coalesce("headers", F.expr("CAST(map() AS map<string,string>)"))).alias("headers"),
        status.alias("status"),
    )


def last_attempt(attempts: Column) -> Column:
    """Of recorded attempts, the one that counts: the first that is not retried, else the last."""
    done = F.filter(attempts, lambda a: ~a["status"].isin(*C.RETRIED_CODES))
    return F.coalesce(F.try_element_at(done, F.lit(1)), F.element_at(attempts, -1))


def retried(attempts: Column, retries: int = C.RETRIES, jitter: Column | None = None) -> Column:
    """struct(status, tries, waited) of recorded attempts (status, retry_after in seconds), as a client that retries sees them.

    An attempt with one of `RETRIED_CODES`, or one of `ASKING_CODES` that says how long to wait, is followed by another while any is left of `retries` and recorded; before it the
    client waits as long as the response asks, else nothing after the first failure and then 2, 4, 8 seconds and so on, `BACKOFF_MOST` at most. jitter: 0 to 1, of `RETRY_JITTER` seconds for each of these.
    """
    shift = F.lit(0.0) if jitter is None else jitter * C.RETRY_JITTER
    seen = F.slice(attempts, 1, retries + 1)
    again = lambda a: a["status"].isin(*C.RETRIED_CODES) | a["status"].isin(*C.ASKING_CODES) & a["retry_after"].isNotNull()
    first = F.array_position(F.transform(seen, lambda a: ~again(a)), True)
    tries = F.when(first > 0, first).otherwise(F.size(seen)).cast("int")
    step = lambda i: F.when(i < 1, 0.0).otherwise(F.least(F.pow(F.lit(2.0), i.cast("double")) + shift, F.lit(C.BACKOFF_MOST)))
    waits = F.transform(F.slice(seen, 1, F.greatest(tries - 1, F.lit(0))), lambda a, i: F.coalesce(a["retry_after"], step(i)))
    return F.struct(F.try_element_at(seen, tries)["status"].alias("status"), tries.alias("tries"), F.aggregate(waits, F.lit(0.0), lambda x, y: x + y).alias("waited"))


PAGE = schemas.FETCHED_PAGE
