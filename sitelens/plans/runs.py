"""Queries over event-like tables: health, spacing, robots, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import constants as C
from sitelens.functions import text as T
from sitelens.operators import health, robots
from sitelens.plans.registry import query
from sitelens.sinks import ledger, report
from sitelens.storage import shared_dir, table
from sitelens.streaming import state, streams

NOW = "1999-06-01 12:00:00"
EVENTS = "events_log AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'error' THEN 'http_error' ELSE 'ok' END AS status, ts, event_id FROM events)"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page logs: a run for each user, errors as failures."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.when(F.col("event_type") == "error", "http_error").otherwise("ok").alias("status"))
    return rows.withColumn("retry_after", F.lit(None).cast("double"))


@query(f"""WITH {EVENTS}, islands AS (SELECT *, sum((status <> 'http_error')::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM events_log),
runs AS (SELECT run_id, seq, sum((status = 'http_error')::INT) OVER (PARTITION BY run_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM islands)
SELECT run_id, max(n)::BIGINT AS longest FROM runs GROUP BY run_id""")
def abort_consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = health.health(event_log(spark, sf_dir), ["run_id"], ["ts", "event_id"])
    return rows.groupBy("run_id").agg(F.max("consecutive_failures").alias("longest"))


@query(f"""WITH {EVENTS} SELECT run_id, event_id, count(*) OVER w AS attempted, (sum((status = 'http_error')::INT) OVER w)::BIGINT AS failed FROM events_log
WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def abort_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = health.health(event_log(spark, sf_dir), ["run_id"], ["ts", "event_id"])
    return rows.select("run_id", "event_id", "attempted", "failed")


_SICK = EVENTS.replace("event_type = 'error'", "event_type IN ('error', 'view', 'click')")


@query(f"""WITH {_SICK}, islands AS (SELECT *, sum((status <> 'http_error')::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM events_log),
r AS (SELECT run_id, seq, event_id, sum((status = 'http_error')::INT) OVER (PARTITION BY run_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n,
  seq AS attempted, sum((status = 'http_error')::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS failed FROM islands),
armed AS (SELECT *, CASE WHEN n >= 10 THEN 'aborted_host_unhealthy' WHEN attempted >= 20 AND failed > 0.5 * attempted THEN 'aborted_error_rate' END AS outcome FROM r)
SELECT run_id, min_by(outcome, seq) AS outcome, min_by(event_id, seq) AS event_id FROM armed WHERE outcome IS NOT NULL GROUP BY run_id""")
def abort_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first abort that each run arms, when three of five kinds of events count as failures."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.when(F.col("event_type").isin("error", "view", "click"), "http_error").otherwise("ok").alias("status"))
    rows = health.first_abort(log, ["run_id"], ["ts", "event_id"])
    return rows.select("run_id", "outcome", F.col("at.event_id").alias("event_id"))


_ARRIVALS = "a AS (SELECT user_id AS host, event_id, epoch_us(ts) AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"WITH {_ARRIVALS} SELECT host, event_id, max(arrival - i * 60000000) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 60000000 AS start FROM a")
def request_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each request may begin if a host wants a minute between two, in microseconds."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), "ts", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("arrival"))
    return health.request_starts(rows, 60_000_000, order=["ts", "event_id"]).select("host", "event_id", "start")


@query(f"""WITH {EVENTS}, islands AS (SELECT *, sum((status <> 'http_error')::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM events_log),
runs AS (SELECT run_id, event_id, status, sum((status = 'http_error')::INT) OVER (PARTITION BY run_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM islands)
SELECT run_id, event_id, CASE WHEN n = 1 THEN 2.0 WHEN n = 2 THEN 4.0 ELSE 8.0 END::DOUBLE AS wait FROM runs WHERE n > 0""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("limited", F.col("status") == "http_error")
    rows = health.run_length(rows, F.col("limited"), ["run_id"], ["ts", "event_id"], "n").where("n > 0")
    return rows.select("run_id", "event_id", health.backoff(F.col("n"), F.lit(None), F.lit(0.0)).alias("wait"))


@query("""SELECT status, CASE WHEN status = 401 THEN 'robots_refused_401' WHEN status = 403 THEN 'robots_refused_403' WHEN status = 404 THEN 'robots_absent_404'
  WHEN status BETWEEN 400 AND 499 THEN 'robots_absent_4xx' WHEN status >= 500 THEN 'robots_unreachable_5xx' WHEN status < 200 OR status >= 300 THEN 'robots_unreachable_transport' END AS reason,
  CASE WHEN status BETWEEN 200 AND 299 THEN NULL ELSE status BETWEEN 400 AND 499 AND status NOT IN (401, 403) END AS allowed
FROM (SELECT unnest(range(100, 600))::INT AS status)""")
def robots_status_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(100, 600).select(F.col("id").cast("int").alias("status"))
    decision = robots.status_decision(F.col("status"), F.lit(None).cast("string"), F.lit(b""))
    return rows.select("status", decision["reason"].alias("reason"), decision["allowed"].alias("allowed"))


ORDERS = f"SELECT o_orderkey, o_orderdate AS created_at, (1 + o_orderkey % 365)::INT AS retention_days, TIMESTAMP '{NOW}' AS now FROM orders"


@query(f"""SELECT o_orderkey, created_at + to_days(retention_days) <= now AS expired,
  floor((epoch(created_at) + retention_days * 86400 - epoch(now)) / 86400)::BIGINT AS days_remaining FROM ({ORDERS})""")
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger of runs: what is expired at a fixed time."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created_at"), (1 + F.col("o_orderkey") % 365).cast("int").alias("retention_days"))
    now = F.lit(NOW).cast("timestamp")
    created, days = F.col("created_at"), F.col("retention_days")
    return rows.select("o_orderkey", T.is_expired(created, days, now).alias("expired"), T.days_remaining(created, days, now).alias("days_remaining"))


@query("SELECT o_orderstatus AS target_host, count(*) AS runs, sum(o_orderkey)::BIGINT AS findings FROM orders WHERE o_orderstatus = 'F' GROUP BY 1".replace("::BIGINT", "::BIGINT"))
def ledger_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("target_host"), F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("findings_count"))
    return ledger.find(rows, target_host="F").groupBy("target_host").agg(F.count("*").alias("runs"), F.sum("findings_count").alias("findings"))


@query("""SELECT r_regionkey::VARCHAR AS run_id, i::INT AS ord, k AS key, CASE k WHEN 'run_id' THEN r_regionkey::VARCHAR WHEN 'scope_host' THEN lower(r_name) || '.example.com'
  WHEN 'retention_days' THEN '30' ELSE '' END AS value
FROM region, (SELECT unnest(%s) AS k, unnest(range(0, %d)) AS i)""" % (str(C.RUN_KEYS), len(C.RUN_KEYS)))
def run_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as ordered key and value rows."""
    known = {"run_id": F.col("r_regionkey").cast("string"), "scope_host": F.concat(F.lower("r_name"), F.lit(".example.com")), "retention_days": F.lit(30)}
    runs = table(spark, sf_dir, "region").select(*[known.get(k, F.lit(None).cast("string")).alias(k) for k in C.RUN_KEYS])
    return report.run_key_values(runs)


@query("""SELECT user_id AS run_id, count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS fetched, count(*) FILTER (WHERE event_type = 'view') AS skipped,
  count(*) FILTER (WHERE event_type = 'error') AS errors, max(event_id % 7) AS deepest FROM events GROUP BY user_id""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of runs from a stream of events, run to its end."""
    return _streamed(spark, sf_dir, "progress", lambda e: streams.progress(
        e.select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", "http_error").when(F.col("event_type") == "view", "skipped_robots").otherwise("ok").alias("status"), (F.col("event_id") % 7).alias("depth"))
    ), "complete")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "dedup", lambda e: streams.once(e.select("user_id", "event_type"), ["user_id", "event_type"]), "append")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: tumbling windows over the event stream. Complete mode keeps the last windows."""
    rows = _streamed(spark, sf_dir, "windows", lambda e: streams.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "6 hours"), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"""WITH {_SICK}, islands AS (SELECT *, sum((status <> 'http_error')::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM events_log),
r AS (SELECT run_id, seq, ts, sum((status = 'http_error')::INT) OVER (PARTITION BY run_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n,
  seq AS attempted, sum((status = 'http_error')::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS failed FROM islands),
armed AS (SELECT *, CASE WHEN n >= 10 THEN 'aborted_host_unhealthy' WHEN attempted >= 20 AND failed > 0.5 * attempted THEN 'aborted_error_rate' END AS outcome FROM r)
SELECT run_id::VARCHAR AS run_id, min_by(outcome, seq) AS outcome, min(epoch_us(ts)) AS seq FROM armed WHERE outcome IS NOT NULL GROUP BY run_id""")
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first abort of each run from a stream of its log, with state for each run."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    status = F.when(F.col("event_type").isin("error", "view", "click"), "http_error").otherwise("ok")
    return _streamed(spark, sf_dir, "health", lambda e: state.health(e.select(F.col("user_id").alias("run_id"), micros.alias("seq"), status.alias("status"), F.lit(None).cast("double").alias("retry_after"))), "append")


_HOST = "lower(regexp_extract(url, '^[a-z]+://[^/?#]+', 0))"


@query(f"""WITH p AS (SELECT page_id, url, length({_HOST}) % 4 AS kind, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT url, CASE kind WHEN 0 THEN path NOT LIKE '/a%' WHEN 1 THEN true ELSE false END AS robots_allowed,
  CASE kind WHEN 0 THEN CASE WHEN path LIKE '/a%' THEN 'robots_disallow' ELSE 'robots_allow_rule' END WHEN 1 THEN 'robots_absent_404' WHEN 2 THEN 'robots_refused_403' ELSE 'robots_unreachable_5xx' END AS robots_reason FROM p""")
def stream_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page asked for while its host's robots.txt comes in on another stream: each is decided once, by its host's answer."""
    source = spark.readStream.schema(table(spark, sf_dir, "pages").schema).parquet(f"{sf_dir}/pages.parquet*")
    key = robots.host_key(F.col("url"))
    kind = F.length(key) % 4
    asked = source.select("url", F.expr("timestamp_seconds(1700000000 + page_id)").alias("at"))
    body = F.when(kind == 0, F.lit("User-agent: *\nDisallow: /a\n").cast("binary"))
    answers = source.select(key.alias("host_key"), F.when(kind == 0, 200).when(kind == 1, 404).when(kind == 2, 403).otherwise(503).alias("status_code"), body.alias("body"), F.lit(None).cast("string").alias("error"), F.expr("timestamp_seconds(1700000000)").alias("fetched_at"))
    made = streams.run_to_files(state.robots_decisions(asked, answers, ttl_hours=24 * 365), f"{shared_dir(spark)}-robots")
    return made.select("url", "robots_allowed", "robots_reason")


def _streamed(spark: SparkSession, sf_dir: str, name: str, step, mode: str) -> DataFrame:
    """Read a table as a file stream, run the step to the end; its result is written by the executors and read back."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return streams.run_to_files(step(source), f"{shared_dir(spark)}-{name}", mode)


@query("SELECT r_name, n_name, count(*) AS n, grouping(r_name) + grouping(n_name) AS level FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def extra_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: not an operator of the reference."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), (F.grouping("r_name").cast("long") + F.grouping("n_name").cast("long")).alias("level"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def extra_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: session windows."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")
