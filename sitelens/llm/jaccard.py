"""N-gram Jaccard join by vertical partitioning: all links of 80 % and more between sets of word shingles.

A document's set: A-Z lower-cased, words (runs of characters other than ASCII white space), distinct runs of five words,
each as a 64-bit hash; fewer words: the whole sequence as one. Documents with equal sets are one set from here on.

1. Tokens (shingle hashes) are dealt over buckets by their leading bits, packed by blocks of text, each with the hashes of the
   sets that hold it. A bucket has all occurrences of its tokens, so it knows how many sets hold each; those of one set alone
   can never overlap and stay behind. A token that is in over one of `HOT_SHARE` sets is found by a pass before; its
   occurrences are dealt by their set instead, so no bucket grows with it.
2. What is left returns to its set. Of two linked sets each has four fifths of its tokens in the other, so a set with fewer shared
   tokens than that has no link and is dropped: of prose most are.
3. The global order of tokens is (how many sets hold it, in steps of half a power of two; hash). It is cut into `FRAGMENTS` of about
   equal weight, and a set into its segments, one row each.
4. Linked sets share a token among the first n - ceil(0.8 n) + 1 of the order. In rounds, every set is tried against one pivot of those
   that it shares such tokens with, and linked sets get one label; a pair of one label is linked already, if by others. After `ROUNDS` rounds, or when one finds little that is new, all
   sets of different labels that share such a token are compared where they meet, in blocks, by sketches of 16 bits a token that miss no link; as many of the close pairs leave the task
   as connect what all of them do. These are tried, labels become components, and the comparison is made once more for what is left, where every close pair leaves: so none is missed that a sketch hid.
5. A pair is tried by counting the partial overlaps of its segments, fragment by fragment, and summing them: exact.

So a group of near copies costs a few pivots for each of its sets, and no list of its pairs is ever made. What is quadratic is the comparison, within tasks, of a group whose sets share
rare tokens and yet are no links: bits, some hundred bytes a pair.
Two different sets are taken for one if their 64-bit hashes are equal, and tokens are told apart by up to 57 bits within a set's partners.
A block of text has few tokens for each of many buckets beyond some 10 TB; then raise `CHUNK` or `BUCKET_TOKENS`.

Defined cases: null and empty texts and texts of white space have no shingles, are their own component and link with nothing; very long texts are
taken whole, their segments are counted apart; rows with a null doc_id take part, a component of null ids alone has a null component_id;
repeated rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, WordHashes, chunks, flat_words, shingle_hashes, ship, stored, table
from .simhash import components as connected

WORDS = 5
#: Bytes of text whose tokens are packed together.
CHUNK = 16 << 20
#: Occurrences of tokens in a bucket, about, and the fewest buckets.
BUCKET_TOKENS = 2_000_000
LEAST_BUCKETS = 64
#: A token in over one of so many sets is dealt by set; the list of these is broadcast and has at most so many times the mean set size.
HOT_SHARE = 1000
#: Fewer sets than this never make a token hot.
HOT_LEAST = 1000
FRAGMENTS = 4
#: Sets that share a token that are compared with each other at once, and sets that a task of these comparisons has, about.
BLOCK = 1000
SETS_A_TASK = 1000
ROUNDS = 2
#: Bits of a token in the global order; above them stands its frequency.
TOKEN_BITS = 57


def shingle_set(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text given by its words' hashes."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n >= size:
        return np.unique(shingle_hashes(words, np.array([0, n]), size)[0])
    return shingle_hashes(words, np.array([0, n]), n)[0] ^ np.uint64(n)


def text_sets(texts: list[bytes], hashes: WordHashes) -> Iterator[np.ndarray]:
    words, starts = flat_words(texts, hashes, LOWER)
    for i in range(len(texts)):
        yield shingle_set(words[starts[i] : starts[i + 1]])


def set_hash(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes())


def least_shared(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n)."""
    return (4 * n + 4) // 5


def _marks(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, h), and rows (token, sets) for tokens of several sets of a block of text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in chunks(batch, most=CHUNK):
                n, h, distinct = [], [], {}
                for tokens in text_sets(texts, hashes):
                    n.append(len(tokens))
                    h.append(set_hash(tokens))
                    distinct[h[-1]] = tokens
                token, sets = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                often = (sets >= 3) & (sets * HOT_SHARE >= len(distinct))
                token, sets = token[often], sets[often]
                none = [None] * len(token)
                ids = part.column(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids, pa.nulls(len(token), pa.int64())]),
                        pa.array(n + none, pa.int64()),
                        pa.concat_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.nulls(len(token), pa.int64())]),
                        pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(token.view(np.int64))]),
                        pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(sets)]),
                    ],
                    ["doc_id", "n", "h", "token", "sets"],
                )

    return docs.select("doc_id", F.col("text")).mapInArrow(apply, "doc_id long, n long, h long, token long, sets long")


def order_class(sets: np.ndarray) -> np.ndarray:
    """How often a token occurs, in steps of half a power of two, below 64."""
    return np.minimum(np.floor(2 * np.log2(sets)), 63).astype(np.uint64)


_PACKED = "part int, kind int, h binary, n binary, token binary"
_NAMES = ["part", "kind", "h", "n", "token"]


def _packed(rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    part, kind, *arrays = zip(*rows, strict=True) if rows else ([], [], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), *[pa.array([x.tobytes() for x in a], pa.binary()) for a in arrays]], _NAMES)


def _read(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _by_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)


def _occurrences(docs: DataFrame, bits: int, hot: tuple[np.ndarray, np.ndarray], hot_parts: int) -> DataFrame:
    """Blocks of occurrences by bucket: for each set of a block its hash, the number of its tokens here (n), and the tokens' low 48 bits as three planes.

    Hot tokens come whole, in the buckets beyond 2^bits, by set.
    """
    known = docs.sparkSession.sparkContext.broadcast(hot[0])
    low = min(48, TOKEN_BITS - bits)
    shift, mask = np.uint64(64 - bits - low), np.uint64((1 << low) - 1)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hot = WordHashes(), known.value
        for batch in batches:
            for _, texts in chunks(batch, most=CHUNK):
                distinct = {set_hash(tokens): tokens for tokens in text_sets(texts, hashes) if len(tokens)}
                if not distinct:
                    continue
                h, sizes = np.fromiter(distinct, np.uint64, len(distinct)), np.array([len(x) for x in distinct.values()])
                token = np.concatenate(list(distinct.values()))
                owner = np.repeat(np.arange(len(h)), sizes)
                bucket = (token >> np.uint64(64 - bits)).astype(np.int64)
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    is_hot = hot[place] == token
                    bucket[is_hot] = (1 << bits) + _by_part(h[owner[is_hot]], hot_parts)
                order = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.diff(bucket[order])) + 1
                rows = []
                for own in np.split(order, ends):
                    b = int(bucket[own[0]])
                    first = np.concatenate([[0], np.flatnonzero(np.diff(owner[own])) + 1])
                    counts = np.diff(np.append(first, len(own))).astype(np.uint32)
                    t = token[own]
                    if b < 1 << bits:
                        t = (t >> shift) & mask
                        t = np.stack([(t >> np.uint64(16 * k)).astype(np.uint16) for k in range(3)], 1)
                    rows.append((b, 0, h[owner[own[first]]], counts, t))
                yield _packed(rows)

    return docs.select("doc_id", "text").mapInArrow(apply, _PACKED)


def _shared(found: DataFrame, bits: int, hot: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """Each bucket's tokens that several sets hold, as values of the global order, packed by the part of their set."""
    known = found.sparkSession.sparkContext.broadcast(hot)
    low = min(48, TOKEN_BITS - bits)
    cut = np.uint64(64 - bits - low)

    def apply(rows: pa.Table) -> pa.Table:
        b = rows["part"][0].as_py()
        h = np.repeat(_read(rows["h"], np.uint64), _read(rows["n"], np.uint32))
        if b < 1 << bits:
            planes = _read(rows["token"], np.uint16).reshape(-1, 3).astype(np.uint64)
            token = planes[:, 0] | planes[:, 1] << np.uint64(16) | planes[:, 2] << np.uint64(32)
        else:
            token = _read(rows["token"], np.uint64)
        order = np.lexsort((h, token))
        h, token = h[order], token[order]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (h[1:] != h[:-1])])
        h, token = h[fresh], token[fresh]
        if b < 1 << bits:
            first = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1])
            counts = np.diff(np.append(first, len(token)))
            sets = np.repeat(counts, counts)
            token = token | np.uint64(b) << np.uint64(low)
        else:
            tokens, counts = known.value
            sets = counts[np.searchsorted(tokens, token)]
            token = token >> cut
        several = sets > 1
        h, token = h[several], token[several] | order_class(sets[several]) << np.uint64(TOKEN_BITS)
        part = _by_part(h, parts)
        order = np.lexsort((h, part))
        h, token, part = h[order], token[order], part[order]
        out = []
        if len(h):
            for own in np.split(np.arange(len(h)), np.flatnonzero(np.diff(part)) + 1):
                first = np.concatenate([[0], np.flatnonzero(np.diff(h[own])) + 1])
                out.append((int(part[own[0]]), 1, h[own[first]], np.diff(np.append(first, len(own))).astype(np.uint32), token[own]))
        return pa.Table.from_batches([_packed(out)])

    return found.groupBy("part").applyInArrow(apply, _PACKED)


def _sizes(marks: DataFrame, parts: int) -> DataFrame:
    """Each set's size, packed by part like its tokens."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
            n, part = batch.column(1).to_numpy(zero_copy_only=False)[at].astype(np.uint32), _by_part(h, parts)
            yield _packed([(int(p), 0, h[part == p], n[part == p], np.zeros(0, np.uint64)) for p in np.unique(part)])

    return marks.where("n > 0").select("h", "n").mapInArrow(apply, _PACKED)


def _assembled(packed: DataFrame) -> DataFrame:
    """(h, n, tokens in the global order) of the sets that may have a link."""

    def apply(rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        of, tokens = rows.filter(pa.array(kind == 0)), rows.filter(pa.array(kind == 1))
        known, at = np.unique(_read(of["h"], np.uint64), return_index=True)
        sizes = _read(of["n"], np.uint32)[at].astype(np.int64)
        h, token = np.repeat(_read(tokens["h"], np.uint64), _read(tokens["n"], np.uint32)), _read(tokens["token"], np.uint64)
        order = np.lexsort((token, h))
        h, token = h[order], token[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1]) if len(h) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(h)))
        own = h[first]
        n = sizes[np.searchsorted(known, own)]
        stays = counts >= least_shared(n)
        ends = np.concatenate([[0], np.cumsum(counts[stays])])
        values = token[np.repeat(stays, counts)].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        return pa.table({"h": pa.array(own[stays].view(np.int64)), "n": pa.array(n[stays]), "tokens": lists})

    return packed.groupBy("part").applyInArrow(apply, "h long, n long, tokens array<long>")


def hot_tokens(marks: DataFrame, sets: int, share: int = HOT_SHARE, least: int = HOT_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that over one of `share` sets hold, and about how many hold each. At most `share` times the mean set size of them."""
    rows = marks.where("token IS NOT NULL").groupBy("token").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= max(least, sets // share)).toArrow()
    token, counts = rows["token"].to_numpy().view(np.uint64), rows["sets"].to_numpy()
    order = np.argsort(token)
    return token[order], counts[order]


def linkable(docs: DataFrame, marks: DataFrame, hot_share: int = HOT_SHARE, hot_least: int = HOT_LEAST) -> DataFrame:
    """(h, n, tokens): the sets that may have a link, with the tokens that they share with any other set, in the global order."""
    total, rows = marks.where("h IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = hot_tokens(marks, rows, hot_share, hot_least)
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_TOKENS))
    bits = (buckets - 1).bit_length()
    hot_parts = max(1, -(-int(hot[1].sum()) // BUCKET_TOKENS))
    found = _occurrences(docs, bits, hot, hot_parts).repartition(buckets, "part")
    parts = buckets
    packed = _shared(found, bits, hot, parts).union(_sizes(marks.where("h IS NOT NULL"), parts))
    return stored(_assembled(packed), "sets")


def segments(sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """(h, f, tokens): each set cut at the same places of the global order. A class of frequency is cut evenly, as its hashes are spread evenly."""
    weights = sets.selectExpr(f"explode(transform(tokens, t -> shiftright(t, {TOKEN_BITS}))) AS c").groupBy("c").count().orderBy("c").collect()
    total, before, cuts = sum(r["count"] for r in weights), 0, []
    for r in weights:
        while len(cuts) < fragments - 1 and before + r["count"] >= (len(cuts) + 1) * total / fragments:
            part = ((len(cuts) + 1) * total / fragments - before) / r["count"]
            cuts.append((r["c"] << TOKEN_BITS) + int(part * (1 << TOKEN_BITS)) - 1)
        before += r["count"]
    bounds = [-1, *cuts, (1 << 63) - 1]
    parts = ", ".join(f"filter(tokens, t -> t > {a}L AND t <= {b}L)" for a, b in zip(bounds, bounds[1:], strict=False))
    return sets.selectExpr("h", f"posexplode(array({parts})) AS (f, tokens)").where("size(tokens) > 0")


def verified(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """Of the pairs (a, b, na, nb and their labels ca, cb), the links: overlaps are counted for each fragment and summed for each pair."""
    left = pairs.join(cut.select(F.col("h").alias("a"), "f", F.col("tokens").alias("left")), "a")
    both = left.join(cut.select(F.col("h").alias("b"), "f", F.col("tokens").alias("right")), ["b", "f"])
    partial = both.select("a", "b", "na", "nb", "ca", "cb", F.size(F.array_intersect("left", "right")).cast("long").alias("shared"))
    return partial.groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.sum("shared").alias("shared")).where("180 * shared >= 80 * (na + nb)").select("a", "b", "ca", "cb")


def sketches(sets: DataFrame) -> DataFrame:
    """(h, sketch, lost): a set's tokens as sorted distinct numbers of 16 bits, and how many of its tokens fell on another's number."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = batch.column(1).flatten().to_numpy().view(np.uint64), batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            short = ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
            own = [np.unique(short[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
            lost = np.diff(ends) - np.array([len(x) for x in own], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(lost)], ["h", "sketch", "lost"])

    return sets.select("h", "tokens").mapInArrow(apply, "h long, sketch binary, lost long")


def close_pairs(sketch: list[np.ndarray], n: np.ndarray, lost: np.ndarray, label: np.ndarray, fragments: int = FRAGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of sets of different labels that may be links. Overlaps of the sketches are counted for each fragment of the numbers and summed.

    Sets share at most as many tokens as numbers, and those that one of them lost; so no link is missed.
    """
    numbers, at = np.unique(np.concatenate(sketch), return_inverse=True)
    owner = np.repeat(np.arange(len(sketch)), [len(x) for x in sketch])
    shared = np.zeros((len(sketch), len(sketch)), np.float32)
    for k in range(fragments):
        low, high = len(numbers) * k // fragments, len(numbers) * (k + 1) // fragments
        own = (at >= low) & (at < high)
        holds = np.zeros((len(sketch), high - low), np.float32)
        holds[owner[own], at[own] - low] = 1
        shared += holds @ holds.T
    needed = (4 * (n[:, None] + n[None, :]) + 8) // 9
    near = (shared + np.minimum(lost[:, None], lost[None, :]) >= needed) & (label[:, None] != label[None, :])
    near &= 5 * np.minimum(n[:, None], n[None, :]) >= 4 * np.maximum(n[:, None], n[None, :])
    return np.nonzero(np.triu(near, 1))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (a, b) of n nodes are enough to connect what all of them do."""
    parent, kept = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def meetings(own: DataFrame, sketch: DataFrame, count: int, every: bool, block: int = BLOCK) -> DataFrame:
    """(a, b, na, nb, ca, cb): pairs of sets of different labels that share one of the first tokens and whose sketches are close enough for a link.

    A token's sets are compared where they are, in blocks of about `block` sets against each other; only close pairs leave the task: every one, or as many as connect the
    labels that they do.
    """
    sizes = own.groupBy("token").agg(F.count("*").alias("k")).select(F.col("token").alias("of"), F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    rows = own.join(sizes, F.col("token") == F.col("of")).withColumn("i", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    rows = rows.select("token", "h", "n", "c", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).join(sketch, "h")
    rows = rows.select("token", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "h", "n", "c", "lost", "sketch")
    dealt = rows.repartition(max(16, -(-count // SETS_A_TASK)), "token", "i", "j")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        token, i, j, h, n, c, lost = (whole.column(k).to_numpy() for k in range(7))
        sketch = [np.frombuffer(x, np.uint16) for x in whole.column(7).to_pylist()]
        order = np.lexsort((h, j, i, token))
        new = np.flatnonzero((np.diff(token[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        found = [np.zeros((0, 2), np.int64)]
        for group in np.split(order, new):
            if len(group) > 1 and (c[group] != c[group[0]]).any():
                x, y = close_pairs([sketch[g] for g in group], n[group], lost[group], c[group])
                if not every:
                    labels, own = np.unique(c[group], return_inverse=True)
                    kept = forest(own[x], own[y], len(labels))
                    x, y = x[kept], y[kept]
                found.append(np.stack([group[x], group[y]], 1))
        pairs = np.concatenate(found)
        pairs = pairs[np.unique(np.stack([h[pairs[:, 0]], h[pairs[:, 1]]], 1), axis=0, return_index=True)[1]] if len(pairs) else pairs
        a, b = pairs.T
        if not every:
            labels, own = np.unique(c, return_inverse=True)
            kept = forest(own[a], own[b], len(labels))
            a, b = a[kept], b[kept]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (h[a], h[b], n[a], n[b], c[a], c[b])], ["a", "b", "na", "nb", "ca", "cb"])

    return dealt.mapInArrow(apply, "a long, b long, na long, nb long, ca long, cb long")


def links(sets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(h, root) for all sets with a link: the component of each.

    While pairs are tried, a set's label `c` only says that it is linked with all sets of that label; components are made of all links at the end.
    """
    spark = sets.sparkSession
    count = sets.count()
    if not count:
        return spark.createDataFrame([], "h long, root long")
    cut = stored(segments(sets), "segments")
    first = "size(tokens) - (4 * n + 4) div 5 + 1"
    heads = sets.selectExpr("h", "n", "h AS c", f"explode(slice(tokens, 1, CAST({first} AS INT))) AS token")
    found: list[DataFrame] = []

    def still_open(rows: DataFrame) -> tuple[DataFrame, int]:
        """The rows of tokens at which sets of several labels meet, and how many pairs of sets of different labels meet there."""
        by = rows.groupBy("token", "c").count().groupBy("token").agg(F.sum("count").alias("k"), F.sum(F.col("count") * F.col("count")).alias("same"))
        left = by.selectExpr("token AS open", "(k * k - same) div 2 AS pairs", "k").where("pairs > 0")
        kept = stored(rows.join(left, F.col("token") == F.col("open")).select("token", "h", "n", "c", (F.col("pairs") / F.col("k")).alias("share")), "open")
        return kept.drop("share"), round(kept.agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0])

    def take(pairs: DataFrame) -> tuple[DataFrame, int]:
        """Try pairs (a, b, na, nb, ca, cb); returns the links that there are, with their labels, and their number."""
        fresh = stored(verified(pairs, cut), "links")
        found.append(fresh.select("a", "b"))
        return fresh, fresh.count()

    def edges() -> DataFrame:
        """All links so far."""
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def components(links: DataFrame) -> DataFrame:
        return connected(links).select(F.col("node").alias("h"), "root")

    def merged(rows: DataFrame, fresh: DataFrame) -> DataFrame:
        """The rows with each label replaced by the least one within two links of it: a pivot and all that it links get one."""
        both = fresh.select(F.col("ca").alias("u"), F.col("cb").alias("v")).union(fresh.select(F.col("cb").alias("u"), F.col("ca").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        up = both.join(least.select(F.col("u").alias("v"), "m"), "v").groupBy(F.col("u").alias("old")).agg(F.min("m").alias("new"))
        return rows.join(up, F.col("c") == F.col("old"), "left").select("token", "h", "n", F.coalesce("new", "c").alias("c"))

    own, left = still_open(heads)
    fruitful = True
    for k in range(rounds):
        if not left or not fruitful:
            break
        pivots = own.groupBy("token").agg(F.min(F.struct(F.xxhash64("h", F.lit(k)), "h", "n", "c")).alias("p"))
        tried = own.join(pivots, "token").where("c <> p.c AND 5 * least(n, p.n) >= 4 * greatest(n, p.n)").groupBy("h", "n", "c", "p").count()
        best = tried.groupBy("h", "n", "c").agg(F.max(F.struct("count", "p")).alias("best"))
        fresh, n = take(best.selectExpr("h AS a", "best.p.h AS b", "n AS na", "best.p.n AS nb", "c AS ca", "best.p.c AS cb"))
        fruitful = n * 100 > count
        if n:
            own, left = still_open(merged(own, fresh))
    if not left:
        return components(edges()) if found else spark.createDataFrame([], "h long, root long")
    sketch = stored(sketches(sets), "sketches")
    take(stored(meetings(own, sketch, count, False).distinct(), "near"))
    roots = components(edges())
    own, left = still_open(own.drop("c").join(roots, "h", "left").select("token", "h", "n", F.coalesce("root", "h").alias("c")))
    # what is left after that are sets that are no links, and close ones whose sketches said more than their tokens: every pair of these
    if left and take(stored(meetings(own, sketch, count, True).distinct(), "near"))[1]:
        found[:] = [roots.select(F.col("h").alias("a"), F.col("root").alias("b")), found[-1]]
        roots = components(edges())
    return roots


def jaccard_components(docs: DataFrame, rounds: int = ROUNDS, hot_share: int = HOT_SHARE, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    ship(docs.sparkSession)
    marks = stored(_marks(docs), "marks")
    roots = links(linkable(docs, marks, hot_share, hot_least), rounds)
    own = marks.where("h IS NOT NULL").select("doc_id", "n", "h")
    least = own.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("least"))
    of = least.join(roots, "h", "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    firsts = of.groupBy("root").agg(F.min("least").alias("first"))
    classes = stored(of.join(firsts, "root").select(F.col("h").alias("own"), "first"), "classes")
    joined = own.join(classes, (F.col("h") == F.col("own")) & (F.col("n") > 0), "left")
    return joined.selectExpr("doc_id", "n AS n_shingles", "CASE WHEN n > 0 THEN first ELSE doc_id END AS component_id")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
