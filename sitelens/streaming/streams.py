"""A run as streams: progress, deduplication, windows and request spacing; and where a stream's rows go.

Progress and dedup are built-in stateful operators. Spacing keeps a number for each host; its batch form is a window in operators.health.
Live findings, health and the robots cache keep state of their own: see streaming.state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from sitelens import constants as C


def progress(log: DataFrame) -> DataFrame:
    """Fetched, skipped, errors and the deepest depth of each run."""
    s = F.col("status")
    return log.groupBy("run_id").agg(
        F.count_if(s.isin(*C.FETCHED)).alias("fetched"),
        F.count_if(s.isin(*C.SKIPPED)).alias("skipped"),
        F.count_if(s.isin(*C.FAILED)).alias("errors"),
        F.max("depth").alias("deepest"),
    )


def once(rows: DataFrame, keys: list[str], event_time: str | None = None, late: str = "24 hours") -> DataFrame:
    """Each key once; with an event time, its state is kept only as long as duplicates may come."""
    return rows.dropDuplicates(keys) if event_time is None else rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling or sliding windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide or width), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def spacing(requests: DataFrame, interval: float) -> DataFrame:
    """(host, seq, arrival, start): each host's requests at least `interval` seconds apart."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values("seq").reset_index(drop=True)
        starts = []
        for arrival in rows["arrival"]:
            last = max(float(arrival), last + interval)
            starts.append(last)
        state.update((last,))
        yield rows.assign(start=starts)[["host", "seq", "arrival", "start"]]

    rows = requests.select("host", F.col("seq").cast("long").alias("seq"), F.col("arrival").cast("double").alias("arrival"))
    return rows.groupBy("host").applyInPandasWithState(step, "host string, seq long, arrival double, start double", "last double", "append", GroupStateTimeout.NoTimeout)


def observed(frontier: DataFrame, name: str | Observation) -> DataFrame:
    """The rows as they are, with the size and the deepest depth of the frontier as metrics of each batch or run."""
    return frontier.observe(name, F.count(F.lit(1)).alias("queued"), F.max("depth").alias("deepest"))


def run_to_files(stream: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None, **options: str) -> DataFrame:
    """Everything that is available now, written by the executors below a new path, and read back.

    append: a file sink. complete: each batch holds the whole result, and the last one's files are read. update: each batch holds what it changed, and
    the last row of each of `keys` is read. A batch that runs again replaces its files.
    """
    writer = stream.writeStream.options(**options).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    batches: list[int] = []
    if mode == "append":
        query = writer.format("parquet").option("path", path).outputMode("append").start()
    else:

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/{batch}" if mode == "complete" else f"{path}/batch={batch}")
            batches.append(batch)

        query = writer.outputMode(mode).foreachBatch(write).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    spark = stream.sparkSession
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(path)
    if not batches:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/{max(batches)}")
    changes = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("_last")).select(*keys, "_last.*").select(stream.columns)


def deliver(stream: DataFrame, observer: Callable[[list[Row]], None], checkpoint: str, rows: int = C.OBSERVED_ROWS, every: str = C.OBSERVED_EVERY, mode: str = "append", now: bool = False) -> StreamingQuery:
    """Hand a stream's rows to an observer in lists of at most `rows`, as often as `every` allows, and what is left at the end.

    For one run's page log or findings table, whose rows a run bounds.
    """

    def batch(found: DataFrame, _: int) -> None:
        held: list[Row] = []
        for row in found.toLocalIterator():
            held.append(row)
            if len(held) == rows:
                observer(held)
                held = []
        if held:
            observer(held)

    trigger = {"availableNow": True} if now else {"processingTime": every}
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**trigger).start()
