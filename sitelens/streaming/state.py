"""Streams that keep state of their own: live findings, run health, and the robots cache.

Each is a StatefulProcessor over RocksDB state, which holds more keys than memory does and writes only what a batch changed.

- Findings: a row of counters for each finding and a row for each (finding, page), so a page that is seen again costs a look-up and a finding is never rewritten whole.
- Health: five numbers for each run (operators.health.Tally), dropped when a run has been idle for long enough.
- Robots: a host's last answer, and the requests that wait for one. An answer is used for `C.ROBOTS_TTL_HOURS`, then a timer drops it; the next request of that host asks
  for a fresh one and waits; a timer refuses what still waits after `wait` seconds. Time is that of the rows, so a replay decides as the live stream did.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitelens import constants as C
from sitelens import dims
from sitelens.functions import urls as U
from sitelens.operators import robots
from sitelens.operators.health import Tally
from sitelens.storage import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """These processors need a state store with column families."""
    ship(spark)
    spark.conf.set(_STORE, PROVIDER)


# -- findings -----------------------------------------------------------------------------------------------------
FINDING = "field string, dedup_value string, value string, extraction_confidence double, page_support long, occurrence_count long, first_seen_url string"


class Findings(StatefulProcessor):
    """A finding's counters, and the pages that it was seen on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "occurrences long, support long, confidence double, first string, layer int, source string, value string")
        self.pages = handle.getMapState("pages", "source_url string", "occurrences long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        occurrences, support, confidence, first, *best = self.totals.get() if self.totals.exists() else (0, 0, 0.0, None, None, None, None)
        best = tuple(best) if best[0] is not None else None
        for part in rows:
            occurrences += len(part)
            confidence = max(confidence, float(part["confidence"].max()))
            for url, n in part["source_url"].value_counts().items():
                before = self.pages.getValue((url,)) if self.pages.containsKey((url,)) else None
                support += before is None
                self.pages.updateValue((url,), ((before[0] if before else 0) + int(n),))
            least = part["source_url"].min()
            first = least if first is None else min(first, least)
            top = part.sort_values(["layer_ord", "source_url", "value"]).iloc[0]
            own = (int(top["layer_ord"]), top["source_url"], top["value"])
            best = own if best is None else min(best, own)
        self.totals.update((occurrences, support, confidence, first, *best))
        yield pd.DataFrame([(*key, best[2], confidence, support, occurrences, first)], columns=[c.split()[0] for c in FINDING.split(", ")])


def live_findings(accepted: DataFrame) -> DataFrame:
    """Running findings by (field, dedup_value), in update mode: each batch gives the findings that it changed. Counts and support are exact."""
    use_rocksdb(accepted.sparkSession)
    rows = accepted.join(F.broadcast(dims.layers(accepted.sparkSession)), "extraction_layer").select("field", "dedup_value", "value", "source_url", "layer_ord", "confidence")
    return rows.groupBy("field", "dedup_value").transformWithStateInPandas(Findings(), FINDING, "Update", "None")


# -- health -------------------------------------------------------------------------------------------------------
ABORT = "run_id string, outcome string, seq long"


class Health(StatefulProcessor):
    """A run's tally, for as long as rows come."""

    def __init__(self, idle: float | None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {} if self.idle is None else {"ttlDurationMs": int(self.idle * 1000)}
        self.state = handle.getValueState("tally", "limits int, failures int, failed int, attempted int, done boolean", **ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *figures, done = self.state.get() if self.state.exists() else (0, 0, 0, 0, False)
        tally, out = Tally(*figures), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():  # a run's rows of a batch, of which a run has 2,000
            if not done and (outcome := tally.step(r.status, r.retry_after)):
                done = True
                out.append((str(key[0]), outcome, int(r.seq)))
        self.state.update((tally.limits, tally.failures, tally.failed, tally.attempted, done))
        yield pd.DataFrame(out, columns=["run_id", "outcome", "seq"])


def health(log: DataFrame, idle: float | None = None) -> DataFrame:
    """(run_id, outcome, seq): the first abort that each run arms, emitted once.

    log: run_id, seq, status, retry_after. Rows of a run must arrive in the order of seq between batches. idle: seconds without rows after
    which a run's state is dropped; a run that goes on after that starts anew.
    """
    use_rocksdb(log.sparkSession)
    rows = log.select(F.col("run_id").cast("string").alias("run_id"), F.col("seq").cast("long").alias("seq"), "status", F.col("retry_after").cast("double").alias("retry_after"))
    return rows.groupBy("run_id").transformWithStateInPandas(Health(idle), ABORT, "Append", "None" if idle is None else "ProcessingTime")


# -- robots -------------------------------------------------------------------------------------------------------
_ROW = "host_key string, at timestamp, kind string, url string, status_code int, body binary, error string"
_HOUR = 3_600_000


class Robots(StatefulProcessor):
    """A host's answer and the requests that wait for it."""

    def __init__(self, ttl: int, wait: int) -> None:
        self.ttl, self.wait = ttl, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "status_code int, body binary, error string, at long")
        self.waiting = handle.getListState("waiting", "url string, at long")

    def _told(self, url: str, at: int, answer: tuple) -> tuple:
        return at, "decide", url, *answer

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            # an answer counts for what is asked at the same time
            part = part.assign(order=(part["kind"] != "answer")).sort_values(["at", "order", "url"], kind="stable")
            yield self._frame(key, [x for r in part.itertuples() for x in self._row(r)])

    def _row(self, r) -> Iterator[tuple]:  # noqa: ANN001
        at = int(r.at.timestamp() * 1000)
        known = self.answer.get() if self.answer.exists() else None
        if r.kind == "answer":
            if known is not None and known[3] > at:
                return
            told = (None if pd.isna(r.status_code) else int(r.status_code), r.body, r.error)
            self.answer.update((*told, at))
            self.handle.registerTimer(at + self.ttl)
            if self.waiting.exists():
                yield from (self._told(url, max(asked, at), told) for url, asked in self.waiting.get())
                self.waiting.clear()
        elif known is not None and known[3] <= at < known[3] + self.ttl:
            yield self._told(r.url, at, known[:3])
        else:
            if not self.waiting.exists():
                yield at, "refresh", None, None, None, None
            self.handle.registerTimer(at + self.wait)
            self.waiting.appendValue((r.url, at))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.answer.exists() and self.answer.get()[3] + self.ttl <= now:
            self.answer.clear()
        if self.waiting.exists():
            held = list(self.waiting.get())
            late = [(url, at) for url, at in held if at + self.wait <= now]
            out = [self._told(url, at + self.wait, (None, None, "transport")) for url, at in late]
            rest = [x for x in held if x not in late]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        yield self._frame(key, out)

    @staticmethod
    def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in _ROW.split(", ")]
        made = pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), *rest) for at, *rest in rows], columns=names)
        return made.astype({"at": "datetime64[us]", "status_code": "Int32", "kind": object, "url": object, "body": object, "error": object})


def robots_cache(asked: DataFrame, answers: DataFrame, late: str = "0 seconds", ttl_hours: float = C.ROBOTS_TTL_HOURS, wait: float = 30.0) -> DataFrame:
    """What becomes of requests (url, at) as answers (host_key, status_code, body, error, fetched_at) come in.

    Rows of kind `decide` carry the answer to go by; `refresh` says that a host's robots.txt must be asked for, with its URL.
    """
    use_rocksdb(asked.sparkSession)
    requests = asked.select(robots.host_key(F.col("url")).alias("host_key"), F.col("at").cast("timestamp").alias("at"), F.lit("ask").alias("kind"), "url", F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("binary").alias("body"), F.lit(None).cast("string").alias("error"))
    told = answers.select("host_key", F.col("fetched_at").cast("timestamp").alias("at"), F.lit("answer").alias("kind"), F.lit(None).cast("string").alias("url"), "status_code", "body", "error")
    rows = requests.unionByName(told).withWatermark("at", late)
    out = rows.groupBy("host_key").transformWithStateInPandas(Robots(int(ttl_hours * _HOUR), int(wait * 1000)), _ROW, "Append", "EventTime")
    return out.withColumn("url", F.when(F.col("kind") == "refresh", U.robots_url(F.concat("host_key", F.lit("/")))).otherwise(F.col("url")))


def robots_decisions(asked: DataFrame, answers: DataFrame, token: str = C.PRODUCT_TOKEN, **options: float) -> DataFrame:
    """robots.decide() over streams: (url, robots_allowed, robots_reason, robots_delay, robots_url) for each request, once it can be told."""
    rows = robots_cache(asked, answers, **options).where("kind = 'decide'")
    return robots.judge(rows.select("url", "status_code", "body", "error"), token)
