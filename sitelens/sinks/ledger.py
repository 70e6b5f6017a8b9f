"""The ledger of runs: JSON Lines, appended for each export; rewritten only when runs are erased."""

from __future__ import annotations

import json
import os
import shutil
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import schemas
from sitelens.functions import text as T

FILE = "index.jsonl"


def record(folder: str | Path, entry: dict) -> None:
    """Append one line; created_at in UTC with second precision."""
    path = Path(folder) / FILE
    path.parent.mkdir(parents=True, exist_ok=True)
    entry = dict(entry)
    if isinstance(entry.get("created_at"), datetime):
        entry["created_at"] = entry["created_at"].astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    names = [x.split()[0] for x in schemas.LEDGER.split(", ")]
    with path.open("a", encoding="utf-8") as f:
        f.write(json.dumps({n: entry.get(n) for n in names}, ensure_ascii=False) + "\n")


def scan(spark: SparkSession, folder: str | Path) -> DataFrame:
    """The ledger's rows in written order (`line`); blank lines are skipped, a corrupt one is fatal and named."""
    path = Path(folder) / FILE
    if not path.exists():
        return spark.createDataFrame([], schemas.LEDGER + ", line long")
    lines = spark.read.text(str(path), wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    lines = lines.where(F.trim("value") != "").withColumn("entry", F.from_json("value", schemas.LEDGER + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = lines.where("entry IS NULL OR entry._corrupt_record IS NOT NULL OR entry.run_id IS NULL").agg(F.min("line")).first()[0]
    if bad is not None:
        raise ValueError(f"{path}: line {bad + 1} is corrupt")
    return lines.select("entry.*", F.col("line").cast("long").alias("line")).drop("_corrupt_record")


def find(ledger: DataFrame, target_host: str | None = None, run_id: str | None = None) -> DataFrame:
    if target_host is not None:
        ledger = ledger.where(F.col("target_host") == target_host)
    return ledger.where(F.col("run_id") == run_id) if run_id is not None else ledger


def directory_sizes(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(directory, size_bytes) of the run folders, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).select("path", "length")
    root = str(Path(folder).resolve())
    name = F.regexp_extract("path", r"^file:/*(/.*)/[^/]*$", 1)
    return files.withColumn("directory", name).where(F.col("directory") != root).groupBy("directory").agg(F.sum("length").alias("size_bytes"))


def summaries(ledger: DataFrame, sizes: DataFrame | None, now: datetime | str) -> DataFrame:
    """Runs newest first, with size, days remaining and whether they are expired; one predicate for both."""
    at = F.lit(now).cast("timestamp")
    rows = ledger.join(sizes, "directory", "left") if sizes is not None else ledger.withColumn("size_bytes", F.lit(0).cast("long"))
    rows = rows.withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))
    rows = rows.withColumn("days_remaining", T.days_remaining(F.col("created_at"), F.col("retention_days"), at))
    rows = rows.withColumn("expired", T.is_expired(F.col("created_at"), F.col("retention_days"), at))
    return rows.orderBy(F.desc("created_at"), F.desc("run_id"))


def expired(ledger: DataFrame, now: datetime | str) -> DataFrame:
    return ledger.where(T.is_expired(F.col("created_at"), F.col("retention_days"), F.lit(now).cast("timestamp")))


def delete_confirmation(ledger: DataFrame) -> DataFrame:
    """What deleting these runs takes with it, in one row."""
    return ledger.agg(F.count("*").alias("runs"), F.coalesce(F.sum("findings_count"), F.lit(0)).alias("findings"), F.array_sort(F.collect_list("directory")).alias("directories"))


def forget(spark: SparkSession, folder: str | Path, run_ids: set[str]) -> None:
    """Rewrite the ledger without these runs: a new file beside it, then one rename."""
    ledger = scan(spark, folder)
    ids = spark.createDataFrame([(r,) for r in sorted(run_ids)], "run_id string")
    kept = ledger.join(F.broadcast(ids), "run_id", "left_anti").orderBy("line").withColumn("created_at", T.rfc3339(F.col("created_at")))
    names = [x.split()[0] for x in schemas.LEDGER.split(", ")]
    path = Path(folder) / FILE
    new = path.with_suffix(".new")
    with new.open("w", encoding="utf-8") as f:
        for row in kept.select(names).toLocalIterator():
            f.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False) + "\n")
    os.replace(new, path)


def remove_tree(path: str | Path) -> list[Path]:
    """Delete a folder, deepest first; returns what was there. Nothing there is success."""
    path = Path(path)
    if not path.exists():
        return []
    removed = sorted(path.rglob("*"), key=lambda p: (-len(p.parts), p)) + [path]
    shutil.rmtree(path)
    return removed


def erase(spark: SparkSession, folder: str | Path, run_ids: set[str]) -> tuple[list[Path], list[str]]:
    """Delete the folders of these runs, then their ledger lines: (removed paths, removed run ids)."""
    if not run_ids:
        return [], []
    ids = spark.createDataFrame([(r,) for r in sorted(run_ids)], "run_id string")
    rows = scan(spark, folder).join(F.broadcast(ids), "run_id", "left_semi").orderBy("run_id").collect()
    removed = [p for r in rows for p in remove_tree(r["directory"])]
    if rows:
        forget(spark, folder, {r["run_id"] for r in rows})
    return removed, [r["run_id"] for r in rows]


def erase_expired(spark: SparkSession, folder: str | Path, now: datetime | str) -> tuple[list[Path], list[str]]:
    return erase(spark, folder, {r["run_id"] for r in expired(scan(spark, folder), now).select("run_id").collect()})
