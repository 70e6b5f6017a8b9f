"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts are lower-cased, ASCII punctuation parts words, and every run of five words is a shingle; a text of fewer words
is one shingle, its whole sequence. An item is found in a document if at least 80 % of the item's distinct shingles
are in the document, wherever they stand.

Items are partitioned by the size n of their shingle set, by powers of two. A partition fixes the length of its MinHash
sketches from its upper size h: the k = 2 * (h - ceil(0.8 h)) + 1 smallest hashes of an item (bottom-k MinHash, all
of them if there are fewer). The share of a sketch that occurs in a document estimates the containment. Of an item that
is contained, at most n - ceil(0.8 n) shingles are missing, so at least k - (n - ceil(0.8 n)) of its sketch occur: that is the
threshold, and with it the search has no false negatives, while a shingle that many texts share makes no candidate
alone. A partition also bounds the documents that it is searched in: those with fewer distinct shingles than 80 % of its
smallest item skip it. Candidates are then verified by counting the item's shingles in the document.

The sketch is taken of the items, which are the small sets, and is looked up in the document's whole shingle set: signatures on
both sides, as for Jaccard similarity, would have to find an item's twenty shingles among a document's twenty thousand.

Tasks write each partition's sketches as sorted arrays to the shared folder, in blocks of about `block_shingles`
shingles, and workers memory-map them; items never pass the driver and nothing of their size is broadcast. Documents are
read once for all blocks, and never shuffled, cut or held in groups.

Defined cases: null and empty texts have no shingles, are never found and find nothing; equal items each find;
an item without an id is searched as any other and its rows have a null item_id; an item of fewer than five words is
found only in a document of the same words; a repeated document row gives a repeated result row; an empty table on
either side gives no rows; other columns are ignored. Documents are dropped row by row, by their own text: rows that
share an id, or have none, are judged each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER_ALNUM, WordHashes, as_bytes, aside, chunks, flat_words, mounted, renamed, save, shared_dir, shingle_hashes, ship, stored, table

WORDS = 5
MIN_CONTAINMENT = 0.8
#: Shingles of items in one block: 8 bytes each, mapped.
BLOCK_SHINGLES = 1_000_000
#: Bits of a shingle's hash that a first cheap look goes by.
SKETCH_BITS = 22


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts (repeats included) and the index of the text that each belongs to."""
    words, starts = flat_words(texts, hashes, LOWER_ALNUM)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    h, at = shingle_hashes(words, starts, WORDS)
    short = [i for i in np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < WORDS))]
    if not short:
        return h[at], owner[at]
    more = []
    for i in short:
        own = words[starts[i] : starts[i + 1]]
        value = shingle_hashes(own, np.array([0, len(own)]), len(own))[0][0]
        more.append(int(value) ^ len(own))
    return np.concatenate([h[at], np.array(more, np.uint64)]), np.concatenate([owner[at], np.array(short, np.int64)])


def needed(n: np.ndarray, least: float) -> np.ndarray:
    """How many of n shingles must be shared."""
    return np.ceil(np.round(least * n, 9)).astype(np.int64)


def size_partition(n: int) -> int:
    return n.bit_length() - 1


def sketch_length(partition: int, least: float) -> int:
    """Twice the shingles that the partition's largest item may miss, and one."""
    most = (2 << partition) - 1
    return 2 * (most - int(needed(np.array(most), least))) + 1


@dataclass(frozen=True)
class Block:
    """Where the sketches of some items of one size partition are, and the fewest shingles a document needs for one."""

    folder: str
    name: str
    floor: int


def write_block(folder: str, name: str, partition: int, ids: list[int | None], sets: list[np.ndarray], least: float) -> int:
    """Save the items' shingle sets and their sketches, by sorted value; returns the block's floor."""
    sizes = np.array([len(s) for s in sets], np.int64)
    need = needed(sizes, least)
    k = np.minimum(sketch_length(partition, least), sizes)
    values = np.concatenate([s[:m] for s, m in zip(sets, k, strict=True)])  # sorted sets: the smallest hashes come first
    items = np.repeat(np.arange(len(sets)), k)
    order = np.argsort(values, kind="stable")
    distinct, first = np.unique(values[order], return_index=True)
    maybe = np.zeros(1 << SKETCH_BITS, bool)
    maybe[(distinct & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)] = True
    arrays = {
        "ids": np.array([i or 0 for i in ids], np.int64), "has_id": np.array([i is not None for i in ids], bool), "need": need, "hits": k - (sizes - need),
        "shingles": np.concatenate(sets), "starts": np.concatenate([[0], np.cumsum(sizes)]), "values": distinct, "first": np.append(first, len(values)), "items": items[order], "maybe": maybe,
    }
    for part, array in arrays.items():
        save(folder, f"{name}-{part}", array)
    return int(need.min())


class Sketches:
    """A block's arrays, mapped when first used."""

    def __init__(self, block: Block) -> None:
        for part in ("ids", "has_id", "need", "hits", "shingles", "starts", "values", "first", "items", "maybe"):
            setattr(self, part, np.load(f"{block.folder}/{block.name}-{part}.npy", mmap_mode="r"))

    def candidates(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text index, item index) where enough of the item's sketch occurs in the text; h and owner are distinct pairs."""
        maybe = np.flatnonzero(self.maybe[(h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.values, h[maybe]), len(self.values) - 1)
        hit = self.values[place] == h[maybe]
        place, texts = place[hit], owner[maybe[hit]]
        n = self.first[place + 1] - self.first[place]
        at = np.repeat(self.first[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        pairs, counts = np.unique(np.stack([np.repeat(texts, n), self.items[at]], 1), axis=0, return_counts=True)
        enough = counts >= self.hits[pairs[:, 1]]
        return pairs[enough, 0], pairs[enough, 1]


def find(blocks: list[tuple[Block, Sketches]], h: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int | None, int, int]]:
    """(text index, item_id, shared shingles, item's shingles) of every item found in texts with these shingles."""
    if not len(h):
        return
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    h, owner = h[fresh], owner[fresh]
    starts = np.searchsorted(owner, np.arange(owner[-1] + 2))
    sizes = np.diff(starts)
    for block, sketches in blocks:
        large = sizes >= block.floor
        if not large.any():
            continue
        of_large = slice(None) if large.all() else large[owner]
        for d, k in zip(*sketches.candidates(h[of_large], owner[of_large]), strict=True):
            own = h[starts[d] : starts[d + 1]]
            item = sketches.shingles[sketches.starts[k] : sketches.starts[k + 1]]
            place = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shared = int((own[place] == item).sum())
            if shared >= sketches.need[k]:
                yield int(d), int(sketches.ids[k]) if sketches.has_id[k] else None, shared, len(item)


def index_items(benchmark: DataFrame, least: float = MIN_CONTAINMENT, block_shingles: int = BLOCK_SHINGLES) -> list[Block]:
    """Write the sketches of all items to the shared folder. A row for each size partition and each block reaches the driver."""
    spark = benchmark.sparkSession
    ship(spark)
    folder = mounted(shared_dir(spark)) + "-items"
    os.makedirs(folder, exist_ok=True)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [np.unique(shingle_sets([x], hashes)[0]) for x in as_bytes(batch.column(1))]
            n = pa.array([len(s) for s in sets], pa.int64())
            partition = pa.array([size_partition(len(s)) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), n, partition], ["item_id", "shingles", "n", "partition"])

    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = stored(items.mapInArrow(sized, "item_id long, shingles binary, n long, partition int").where("n > 0"), "shingles")
    blocks = {r["partition"]: max(1, -(-r["n"] // block_shingles)) for r in items.groupBy("partition").agg(F.sum("n").alias("n")).collect()}
    if not blocks:
        return []
    count = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(blocks.items()) for x in kv]), F.col("partition"))
    # equal items are dealt apart by their row
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "shingles", F.monotonically_increasing_id()), count).cast("int"))

    def write(rows: pa.Table) -> pa.Table:
        partition, block = rows["partition"][0].as_py(), rows["block"][0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        name = f"{partition}-{block}"
        floor = write_block(folder, name, partition, rows["item_id"].to_pylist(), sets, least)
        return pa.table({"name": [name], "floor": pa.array([floor], pa.int64())})

    written = dealt.groupBy("partition", "block").applyInArrow(write, "name string, floor long").collect()
    return sorted((Block(folder, r["name"], r["floor"]) for r in written), key=lambda b: b.name)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = MIN_CONTAINMENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item that is found in a document."""
    blocks = index_items(benchmark, least, block_shingles)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = WordHashes(), [(b, Sketches(b)) for b in blocks]
        for batch in batches:
            for part, texts in chunks(batch):
                found = list(find(own, *shingle_sets(texts, hashes)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()).take(pa.array([d for d, *_ in found], pa.int64())),
                        pa.array([i for _, i, _, _ in found], pa.int64()),
                        pa.array([s for *_, s, _ in found], pa.int64()),
                        pa.array([n for *_, n in found], pa.int64()),
                        pa.array([s / n for *_, s, n in found], pa.float64()),
                    ],
                    ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, item_id long, n_shared long, n_item long, containment double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = MIN_CONTAINMENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents in which no item is found, decided for each row where its text is read; nothing is joined."""
    blocks = index_items(benchmark, least, block_shingles)
    rows, names = aside(docs)
    text = names["text"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = WordHashes(), [(b, Sketches(b)) for b in blocks]
        for batch in batches:
            for part, texts in chunks(batch, text):
                clean = np.ones(len(texts), bool)
                for d, *_ in find(own, *shingle_sets(texts, hashes)):
                    clean[d] = False
                yield part.filter(pa.array(clean))

    return rows.mapInArrow(apply, rows.schema).select(*renamed(names))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
