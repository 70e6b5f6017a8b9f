"""Two-pass external shuffle into shards, with DataFrame functions only.

First pass: every record gets a bucket by a seeded hash of its columns, which scatters records uniformly into buckets
that fit a task's memory; only the buckets' counts are gathered, and their running sums are taken in two levels, so
that no task sees them all. Each bucket gets a Fisher-Yates permutation of its positions (Spark's array shuffle,
seeded) in the task that has the bucket, stored in the shared folder, so that a task that runs again finds the same.
Second pass: the records go to their buckets, are numbered by hash within them, and take the permuted position.

Records that are equal in all columns have one hash. Where more than `equal_rows` are, they are dealt over many buckets by
the place of each in its file, which is the same whenever the file is read; a table that does not come from files
is stored first. All other records' buckets depend on their columns alone.

Buckets follow each other in the order of their numbers, and shards are even cuts of that sequence, so the law is `rows`: shard
counts differ by one at most, and a bucket's task writes to a few shards only. Records move once.

Defined cases: null and empty texts have size 16 and CRC-32 zero; equal rows are interchangeable and get places of
their own; an empty table gives no rows and no shards; columns named bucket, shard or slot are replaced; any other name
may occur.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import renamed, stored, table

SHARDS = 40
SEED = 20_240_607
#: Bytes of records in a bucket, about.
BUCKET_BYTES = 4 << 20
#: Equal records that may share one bucket.
EQUAL_ROWS = 1000
#: Buckets whose counts are summed by one task.
SUMMED_BUCKETS = 4096
#: Bytes that a record counts for besides its text.
RECORD_BYTES = 16


def record_size(text: str = "text") -> str:
    return f"CAST(coalesce(octet_length(`{text}`), 0) + {RECORD_BYTES} AS BIGINT)"


def _placed(docs: DataFrame) -> DataFrame:
    """The table with its columns aside and `place`, a hash of each row's file and its number there."""
    names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("place")
    try:
        return docs.select(*names, place)
    except AnalysisException:
        return stored(docs.select(*names), "records").select("*", place)


def _starts(counts: DataFrame) -> DataFrame:
    """(bucket, n, first): how many records the buckets before hold. Sums within ranges of buckets, then of the ranges."""
    ranges = counts.withColumn("range", F.expr(f"bucket div {SUMMED_BUCKETS}"))
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range: some thousands for 100 TB
    totals = ranges.groupBy("range").agg(F.sum("n").alias("total")).withColumn("base", before("total", Window.orderBy("range")))
    within = ranges.withColumn("inner", before("n", Window.partitionBy("range").orderBy("bucket")))
    return within.join(totals.select("range", "base"), "range").selectExpr("bucket", "n", "base + inner AS first")


def shuffle_into_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES, equal_rows: int = EQUAL_ROWS
) -> DataFrame:
    """The records with bucket, shard (0 to shards - 1) and slot (place in the shard, gapless from 0)."""
    docs = docs.drop("bucket", "shard", "slot")
    rows = _placed(docs)
    columns = rows.columns[:-1]
    names = dict(zip(docs.columns, columns, strict=True))
    total, n = rows.selectExpr(f"sum({record_size(names[text])})", "count(*)").first()
    if not n:
        return docs.selectExpr("*", "CAST(NULL AS INT) AS bucket", "CAST(NULL AS INT) AS shard", "CAST(NULL AS BIGINT) AS slot").limit(0)
    buckets = max(1, -(-total // bucket_bytes))
    hashed = rows.withColumn("hash", F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]))
    # hashes of over equal_rows records: at most n / equal_rows rows
    often = stored(hashed.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > equal_rows).select(F.col("hash").alias("often")), "equal")
    hashed = hashed.join(often, F.col("hash") == F.col("often"), "left")
    hashed = hashed.withColumn("hash", F.when(F.col("often").isNull(), F.col("hash")).otherwise(F.xxhash64("hash", "place", F.lit(seed))))
    dealt = hashed.select(*columns, "hash", F.pmod(F.xxhash64("hash", F.lit(seed)), F.lit(buckets)).cast("int").alias("bucket"))
    starts = stored(_starts(dealt.groupBy("bucket").agg(F.count("*").alias("n"))), "starts")
    tasks = max(1, -(-buckets // SUMMED_BUCKETS))
    # in the order of buckets, so that the generator's draws fall to the same buckets whenever it runs
    orders = starts.repartition(tasks, "bucket").sortWithinPartitions("bucket").withColumn("order", F.shuffle(F.expr("sequence(1, CAST(n AS INT))"), F.lit(seed)))
    orders = stored(orders.select(F.col("bucket").alias("of_bucket"), "first", "order"), "permutations")
    numbered = dealt.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("hash")))
    ranked = numbered.join(orders, F.col("bucket") == F.col("of_bucket")).select(*columns, "bucket", F.expr("first + element_at(order, k) - 1").alias("rank"))
    shard = F.expr(f"CAST(({shards} * (rank + 1) - 1) div {n} AS INT)")
    sharded = ranked.withColumn("shard", shard).withColumn("slot", F.expr(f"rank - (shard * {n}L) div {shards}"))
    return sharded.select(*renamed(names), "bucket", "shard", "slot")


def write_shards(sharded: DataFrame, path: str, **options: str) -> None:
    """One folder for each shard, its files' rows in the order of slots."""
    sharded.sortWithinPartitions("shard", "slot").write.options(**options).partitionBy("shard").parquet(path)


def op8_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shuffle_into_shards(table(spark, sf_dir, "documents"))
    return sharded.selectExpr(
        "doc_id",
        f"{record_size()} AS size",
        "coalesce(crc32(text), 0L) AS text_crc32",
        "'rows' AS law",
        "shard",
        "slot",
        "CAST(NULL AS INT) AS grown_shard",
        "bucket",
    )
