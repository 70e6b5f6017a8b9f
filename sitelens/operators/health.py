"""Run health over the page log: consecutive failures, error rate, the first abort, request spacing, backoff.

All are windows over one run or one host in the order of `seq`; a run has at most 2,000 pages by its bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens import constants as C


@dataclass
class Tally:
    """The same figures, one row after the other: what streams, SQL and the sequential crawl keep of a run."""

    limits: int = 0
    failures: int = 0
    failed: int = 0
    attempted: int = 0

    def step(self, status: str, retry_after: float | None = None) -> str | None:
        """Take a row in; the abort that it arms, if any."""
        if status not in C.ATTEMPTED:
            return None
        self.attempted += 1
        self.failed += status in C.FAILED
        self.limits = self.limits + 1 if status == "rate_limited" else 0
        self.failures = self.failures + 1 if status in C.UNHEALTHY else 0
        asked = retry_after if status == "rate_limited" and retry_after is not None and retry_after == retry_after else 0
        if asked > C.ABORT_RETRY_AFTER or self.limits >= C.ABORT_RATE_LIMITS:
            return "aborted_rate_limited"
        if self.failures >= C.ABORT_FAILURES:
            return "aborted_host_unhealthy"
        if self.attempted >= C.ABORT_MIN_FETCHES and self.failed / self.attempted > C.ABORT_ERROR_RATE:
            return "aborted_error_rate"
        return None


def _running(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def run_length(rows: DataFrame, flag: Column, key: list[str], order: list[str], name: str) -> DataFrame:
    """Adds how many rows in a row, up to this one, have the flag (0 where it has not)."""
    rows = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("int"))
    rows = rows.withColumn("_island", F.sum(1 - F.col("_flag")).over(_running(key, order)))
    return rows.withColumn(name, F.sum("_flag").over(_running([*key, "_island"], order))).drop("_flag", "_island")


def health(log: DataFrame, key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Running figures of the attempted pages; pages that were skipped say nothing of the host's health."""
    key, order = key or ["run_id"], order or ["seq"]
    rows = log.where(F.col("status").isin(*C.ATTEMPTED))
    rows = run_length(rows, F.col("status") == "rate_limited", key, order, "consecutive_rate_limits")
    rows = run_length(rows, F.col("status").isin(*C.UNHEALTHY), key, order, "consecutive_failures")
    over = _running(key, order)
    rows = rows.withColumn("attempted", F.count("*").over(over)).withColumn("failed", F.count_if(F.col("status").isin(*C.FAILED)).over(over))
    return rows.withColumn("error_rate", F.col("failed") / F.col("attempted"))


def abort_reason(rows: DataFrame) -> Column:
    """What a row arms, in the order of precedence within the row; null for nothing."""
    retry_after = F.col("retry_after") if "retry_after" in rows.columns else F.lit(None).cast("double")
    return (
        F.when((F.col("status") == "rate_limited") & (retry_after > C.ABORT_RETRY_AFTER), "aborted_rate_limited")
        .when(F.col("consecutive_rate_limits") >= C.ABORT_RATE_LIMITS, "aborted_rate_limited")
        .when(F.col("consecutive_failures") >= C.ABORT_FAILURES, "aborted_host_unhealthy")
        .when((F.col("attempted") >= C.ABORT_MIN_FETCHES) & (F.col("error_rate") > C.ABORT_ERROR_RATE), "aborted_error_rate")
    )


def first_abort(log: DataFrame, key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """(key, outcome, at): the earliest row of each run that arms an abort."""
    key, order = key or ["run_id"], order or ["seq"]
    rows = health(log, key, order)
    armed = rows.withColumn("outcome", abort_reason(rows)).where("outcome IS NOT NULL")
    return armed.groupBy(*key).agg(F.min_by("outcome", F.struct(*order)).alias("outcome"), F.min(F.struct(*order)).alias("at"))


def running_depth(log: DataFrame, key: list[str] | None = None) -> DataFrame:
    return log.withColumn("deepest", F.max("depth").over(_running(key or ["run_id"], ["seq"])))


def numbered(log: DataFrame, first: int = 1, order: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """Page log rows with their display numbers within their run, from an offset. A log without run_id is one run's."""
    key = [c for c in (key or ["run_id"]) if c in log.columns] or [F.lit(0)]
    return log.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy(*(order or ["seq"]))) + F.lit(first - 1))


def request_starts(arrivals: DataFrame, interval: float, host: str = "host", arrival: str = "arrival", order: list[str] | None = None) -> DataFrame:
    """Adds start: each request begins no sooner than `interval` after the one before on its host.

    start(i) = max(arrival(i), start(i - 1) + interval) = i * interval + max over j <= i of (arrival(j) - j * interval).
    """
    order = order or [arrival]
    rows = arrivals.withColumn("_i", F.row_number().over(Window.partitionBy(host).orderBy(*order)).cast("long"))
    lead = F.max(F.col(arrival) - F.col("_i") * F.lit(interval)).over(_running([host], ["_i"]))
    return rows.withColumn("start", lead + F.col("_i") * F.lit(interval)).drop("_i")


def backoff(consecutive: Column, retry_after: Column, jitter: Column) -> Column:
    """Seconds to wait after a 429: as asked, at most the limit; else 2, 4, 8 with jitter."""
    base = F.element_at(F.array(*[F.lit(b) for b in C.BACKOFF]), F.least(F.greatest(consecutive, F.lit(1)), F.lit(len(C.BACKOFF))).cast("int"))
    asked = F.when(retry_after.isNotNull(), F.least(retry_after.cast("double"), F.lit(C.ABORT_RETRY_AFTER)))
    return F.coalesce(asked, base * (1 + jitter * C.JITTER))
