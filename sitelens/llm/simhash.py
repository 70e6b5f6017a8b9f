"""Near-duplicates by SimHash: multi-index hashing over 64-bit fingerprints, then connected components.

Fingerprint: the text's A-Z lower-cased, its words taken (runs of characters other than ASCII white space), every run
of three words joined by spaces (repeats included; fewer words: the whole sequence) hashed by XXH64 with seed 42; a
bit is set if it is set in over half the hashes. No words: zero, linked like any other.

Search: fingerprints, made distinct, are cut into two segments of 32 bits. Two fingerprints that differ in at most
three bits differ in at most one bit of some segment, so each is filed under its segment's value and enumerates the
ball of radius one around it. As of two values one bit apart exactly one has that bit set, it is enough to clear set
bits: 16 probes a segment on average instead of 32, and no link is lost. The rows that meet under a key are verified
on all 64 bits.

A key's rows are linked by a spanning forest, not by all pairs, so the links grow with the rows however large a
group of copies is. A segment value that over `HOT` fingerprints have is cut by the bytes of the other segment: values at
most three bits apart share one of four bytes, so each such key becomes 1,024 smaller ones on as many tasks. Within a task,
large keys are cut so once more and compared block against block, in bounded memory.

Components: alternating large-star and small-star steps on the links between distinct fingerprints, each written to the
shared folder, until nothing changes. Copies with equal fingerprints only meet in the last join, whose skew Spark
splits.

Defined cases: null and empty texts have fingerprint zero; null doc_ids are kept and take part, a component of null ids
alone has a null component_id; repeated rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, aside, chunks, renamed, ship, stored, table

MAX_DISTANCE = 3
SEED = 42
WORDS = 3
#: Rows of a key that are compared directly; more are cut by bytes first.
DIRECT = 2048
#: Fingerprints of one segment value beyond which its keys are dealt over many tasks.
HOT = 20_000
#: Rows that a search task gets, about.
TASK_ROWS = 1_000_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprint(text: bytes) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.fromiter([digest(s, seed) for s in shingles], ">u8")
    octets = h.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """(doc_id, fp), and key where a column is named for it: fp as a signed long."""
    ship(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                fps = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
                columns = [part.column(0).cast(pa.int64()), pa.array(fps), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "key"][: len(columns)])

    columns = ["doc_id", F.col(f"`{text}`").alias("text")] + ([F.col(f"`{key}`").alias("key")] if key else [])
    return docs.select(*columns).mapInArrow(apply, "doc_id long, fp long" + (", key struct<a:long,b:long>" if key else ""))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i]; every class keeps its smallest index as root."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            parent = _roots(parent)
    return parent


def link(fps: np.ndarray, most: int = MAX_DISTANCE, direct: int = DIRECT) -> np.ndarray:
    """For sorted distinct fingerprints, the index of the smallest member of each one's class."""
    parent = np.arange(len(fps))

    def compare(rows: np.ndarray, parent: np.ndarray) -> np.ndarray:
        for i in range(0, len(rows), direct):
            for j in range(i, len(rows), direct):
                x, y = rows[i : i + direct], rows[j : j + direct]
                near = np.bitwise_count(fps[x][:, None] ^ fps[y][None, :]) <= most
                a, b = np.nonzero(near)
                parent = _join(parent, x[a], y[b])
        return parent

    if len(fps) <= direct:
        return compare(np.arange(len(fps)), parent)
    halves = [fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF)]
    half = max(halves, key=lambda x: len(np.unique(x)))
    for k in range(4):  # three bits cannot touch all four bytes of a half
        octet = (half >> np.uint64(8 * k)).astype(np.uint8)
        order = np.argsort(octet, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(octet[order])) + 1):
            if len(rows) > 1:
                parent = compare(np.sort(rows), parent)
    return parent


def _probes(own: str, mark: str) -> str:
    """The key of a segment value, and those of the values with one set bit cleared."""
    cleared = f"filter(sequence(0, 31), i -> (shiftrightunsigned({own}, i) & 1L) = 1L)"
    return f"concat(array({own} + {mark}), transform({cleared}, i -> {own} - shiftleft(1L, i) + {mark}))"


#: Each segment's value, the mark that keeps the segments' keys apart, and the other segment's value.
_SEGMENTS = [("(shiftrightunsigned(fp, 32) & 4294967295L)", "0L", "(fp & 4294967295L)"), ("(fp & 4294967295L)", "4294967296L", "(shiftrightunsigned(fp, 32) & 4294967295L)")]


def _keyed(distinct: DataFrame, hot: int) -> DataFrame:
    """(fp, key, part): a row for each key of a fingerprint; a hot key's rows four times, once for each byte of the other segment."""
    parts = [distinct.selectExpr("fp", f"{other} AS other", f"explode({_probes(own, mark)}) AS key") for own, mark, other in _SEGMENTS]
    keyed = parts[0].union(parts[1])
    values = [distinct.selectExpr(f"{own} AS own").groupBy("own").count().where(F.col("count") > hot).selectExpr(f"explode({_probes('own', mark)}) AS hot") for own, mark, _ in _SEGMENTS]
    found = stored(values[0].union(values[1]).distinct(), "hot")
    if found.isEmpty():
        return keyed.selectExpr("fp", "key", "-1 AS part")
    octets = ", ".join(f"{256 * k} + CAST(shiftrightunsigned(other, {8 * k}) & 255L AS INT)" for k in range(4))
    joined = keyed.join(found, F.col("key") == F.col("hot"), "left")
    return joined.selectExpr("fp", "key", f"explode(CASE WHEN hot IS NULL THEN array(-1) ELSE array({octets}) END) AS part")


def links(distinct: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """(a, b), a < b as signed longs: a forest that connects all fingerprints within MAX_DISTANCE of each other."""
    ship(distinct.sparkSession)
    dealt = _keyed(distinct, hot).repartition(max(1, -(-34 * n // TASK_ROWS)), "key", "part")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not parts:
            return
        fp, key, part = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((fp, part, key))
        fp, key, part = fp[order], key[order], part[order]
        ends = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
        starts = np.concatenate([[0], ends])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        a, b = [], []
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= MAX_DISTANCE]
        a.append(fp[near])
        b.append(fp[near + 1])
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            group = fp[start : start + size]
            root = link(group)
            member = np.flatnonzero(root != np.arange(size))
            a.append(group[root[member]])
            b.append(group[member])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return dealt.mapInArrow(apply, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes that have an edge."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        # large star: every neighbour above u is tied to the smallest of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(tied.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(marks: DataFrame) -> DataFrame:
    """(_fp, least): for each fingerprint, the first row of its component as (no id, doc_id, key)."""
    distinct = stored(marks.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "key")).alias("least")), "distinct")
    root = components(links(distinct.select("fp"), distinct.count()))
    of = stored(distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    firsts = of.groupBy("root").agg(F.min("least").alias("first"))
    return of.join(firsts, "root").select(F.col("fp").alias("_fp"), F.col("first").alias("least"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    marks = stored(fingerprints(docs, text).withColumn("key", F.lit(0)), "fingerprints")
    joined = marks.join(_classes(marks), F.col("fp") == F.col("_fp"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents of which one row stays of each component: the smallest doc_id (none last), then the smallest row hash.

    Rows are told apart by all their columns, not by doc_id alone: different texts that share an id are different rows,
    and rows without an id are copies like any. Of equal rows one stays.
    """
    rows, names = aside(docs)
    columns = list(names.values())
    rows = rows.withColumn("key", F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(SEED), *columns).alias("b")))
    ident = F.col(names["doc_id"]).cast("long").alias("doc_id") if "doc_id" in names else F.lit(None).cast("long").alias("doc_id")
    marks = stored(fingerprints(rows.select(ident, F.col(names[text]).alias("text"), "key"), key="key"), "fingerprints")
    firsts = _classes(marks).select("least.key").distinct().select(F.col("key").alias("of_key"))
    # equal rows are removed first, in each task before the shuffle too, so that a row that is there very often meets no task as often
    return rows.dropDuplicates(["key"]).join(firsts, F.col("key") == F.col("of_key")).select(*renamed(names))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
