"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

A document's length is its number of words (runs of non-space characters) plus one end token. Documents longer than
the largest capacity are cut into pieces; every full piece fills a sequence of its own, so only remainders, one for
a document, are packed. Nothing is truncated.

Remainders are dealt by a seeded hash of their row into groups of bounded size, and each group is packed
on its own. Within a group, remainders go by falling length into the open bin with the least room that holds them; if
there is none, a new bin is opened. Which size it opens is decided jointly over all permitted lengths: each smallest
size allowed for new bins is tried, new bins take the size with the least cost for a token that can still be
used, and finally every bin is downsized to the smallest permitted length that holds its contents. The cheapest of
these results is taken.

Defined cases: null and empty texts have length one (the end token); repeated rows are packed each; a null doc_id is
packed like any, and ids keep all their 64 bits beside it; ties go by (length, doc_id, row hash); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship, stored, table

#: Permitted sequence lengths.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Remainders in a group, about. Bounds a task's memory; larger groups hardly pack better.
GROUP_ROWS = 20_000
SEED = 17


def sequence_cost(capacity: int) -> float:
    """Cost of running one sequence: linear in tokens, with the quadratic share of attention and a fixed part."""
    return capacity + capacity * capacity / 32768 + 16


def best_fit(lengths: list[int], capacities: tuple[int, ...], cost: Callable[[int], float], opened_from: int) -> list[list[int]]:
    """Bins of indexes of `lengths`, which fall. New bins have at least the size opened_from."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some open bin has r tokens of room
    left = sum(lengths)
    sizes = [c for c in capacities if c >= opened_from]
    for i, n in enumerate(lengths):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            open_bins = by_room[room]
            k = open_bins.pop()
            if not open_bins:
                rooms &= ~(1 << room)
        else:
            k, room = len(bins), min((cost(c) / min(c, left), c) for c in sizes if c >= n)[1]
            bins.append([])
        bins[k].append(i)
        left -= n
        if room > n:
            by_room.setdefault(room - n, []).append(k)
            rooms |= 1 << (room - n)
    return bins


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[list[int]], list[int]]:
    """The cheapest packing over all smallest sizes for new bins: bins of indexes, and each bin's capacity."""
    capacities = tuple(sorted(capacities))
    if any(n > capacities[-1] for n in lengths):
        raise ValueError("an item is longer than the largest capacity")
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    falling = [lengths[i] for i in order]
    best: tuple[float, list[list[int]], list[int]] | None = None
    for smallest in capacities:
        bins = best_fit(falling, capacities, cost, smallest)
        sized = [next(c for c in capacities if c >= sum(falling[i] for i in b)) for b in bins]
        total = sum(map(cost, sized))
        if best is None or total < best[0]:
            best = (total, bins, sized)
    assert best is not None
    return [[order[i] for i in b] for b in best[1]], best[2]


def pieces(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row_hash, n_tokens): the length of every row. Counted by Spark, only these columns go on."""
    words = F.coalesce(F.expr(f"regexp_count(`{text}`, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")
    return docs.select("doc_id", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], F.lit(SEED)).alias("row_hash"), (words + 1).alias("n_tokens"))


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_rows: int = GROUP_ROWS, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """One row for each piece of a document and its place.

    doc_id, piece (from 0), first_token and n_tokens (of the document), bin_id, capacity, first_slot (in the bin),
    bin_tokens (used in the bin), bin_pieces.
    """
    ship(docs.sparkSession)
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    items = stored(pieces(docs), "lengths")
    n = items.count()
    # a row's place in the stored table tells equal rows apart, and is the same whenever the table is read again
    items = items.withColumn("row", F.monotonically_increasing_id())
    groups = max(1, -(-n // group_rows))
    full = items.where(F.col("n_tokens") >= largest)
    full = full.select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_tokens") / largest) - 1)).alias("piece"))
    whole = full.select(
        "doc_id",
        "piece",
        (F.col("piece") * largest).alias("first_token"),
        F.lit(largest).cast("long").alias("n_tokens"),
        F.format_string("f%d-%d", "row", "piece").alias("bin_id"),
        F.lit(largest).alias("capacity"),
        F.lit(0).cast("long").alias("first_slot"),
        F.lit(largest).cast("long").alias("bin_tokens"),
        F.lit(1).alias("bin_pieces"),
    )
    rest = items.select(
        "doc_id",
        "row_hash",
        F.floor(F.col("n_tokens") / largest).alias("piece"),
        (F.col("n_tokens") % largest).cast("int").alias("n"),
        F.pmod(F.xxhash64("row_hash", "row"), F.lit(groups)).cast("int").alias("grp"),
    ).where("n > 0")

    kinds = {"doc_id": pa.int64(), "piece": pa.int64(), "first_token": pa.int64(), "n_tokens": pa.int64(), "bin_id": pa.string()}
    kinds |= {"capacity": pa.int32(), "first_slot": pa.int64(), "bin_tokens": pa.int64(), "bin_pieces": pa.int32()}

    def fill(rows: pa.Table) -> pa.Table:
        """Ids stay Arrow columns from end to end: no 64-bit value goes through a float."""
        rows = rows.take(pc.sort_indices(rows, [("n", "descending"), ("doc_id", "ascending"), ("row_hash", "ascending")], null_placement="at_end"))
        lengths = rows["n"].to_pylist()
        bins, sized = pack(lengths, capacities, cost)
        group = rows["grp"][0].as_py()
        placed: list[tuple] = [()] * len(lengths)
        for k, (b, c) in enumerate(zip(bins, sized, strict=True)):
            used, at = sum(lengths[i] for i in b), 0
            for i in b:
                placed[i] = (f"g{group}-{k}", c, at, used, len(b))
                at += lengths[i]
        bin_id, capacity, first_slot, bin_tokens, bin_pieces = zip(*placed, strict=True)
        columns = [rows["doc_id"], rows["piece"], pc.multiply(rows["piece"], largest), rows["n"], bin_id, capacity, first_slot, bin_tokens, bin_pieces]
        return pa.table([c.cast(k) if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return whole.unionByName(rest.groupBy("grp").applyInArrow(fill, whole.schema))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
