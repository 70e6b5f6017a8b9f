"""Interpolated modified Kneser-Ney n-gram model of any order: counted in Spark, kept as sorted hash arrays, memory-mapped.

Training first counts words by their 64-bit hash; a word's id is its rank among the sorted hashes. Then n-grams of the
highest order are counted by their ids, and from each order the counts of the next lower one follow: the number of different
words before it, or for an n-gram at a text's start, which has none, how often it is there. Each order is one round
of count, shuffle and merge.

Workers count in numpy over a few million tokens at a time and send one compressed array for each bucket instead of a
row for each n-gram. An n-gram's bucket is cut from the hash of its context, so the figures of a context (how often it
occurs, with how many successors seen once, twice and more often) are complete where its n-grams are merged, and no
task gathers them from others; a context has at most as many n-grams as there are words. Only the counts of single words come
from all buckets: they are summed for ranges of ids in two steps, about a square root of the buckets in each. The number of
buckets grows with the text, so that a bucket does not.

A merged bucket is written to the shared folder by the task that merges it: under a name of its own first, then
renamed, so a task that runs again replaces the file by an equal one. Scoring maps these files and searches them;
nothing of the model's size is broadcast, collected or loaded. The folder of spark.checkpoint.dir must therefore be
mounted on all machines (a file: path), as on any cluster with a shared file system.

Tokens: A-Z lower-cased, words are runs of characters other than ASCII white space, then one end token. Before a text stand
start marks. Discounts of each order come from its counts of counts by the usual formulas, or 0.5, 1 and 1.5
where these give no value in range. The distribution of single words is interpolated with 1 / (V + 1) each, which is
what an unknown word gets.

Defined cases: null and empty texts are an end token alone; repeated rows count each time; without training text every
token has probability one over (0 + 1); rows with null doc_id are learned from; an empty table gives no rows;
columns that are not needed are ignored; ids take 32 bits while they fit, else 64.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, WordHashes, chunks, mounted, save, shared_dir, ship, table

#: Words in the longest n-grams.
ORDER = 3
#: Hash of the end token: a newline is no word.
END = xxhash.xxh64_intdigest(b"\n")
#: Tokens that a worker counts before it sends arrays on: some 100 MB of memory at the peak.
FLUSH = 2_000_000
#: Tokens for a bucket, about: its distinct n-grams are fewer.
BUCKET_KEYS = 2_000_000
#: Bits of a key that come from the context and may choose the bucket: up to a million buckets.
CONTEXT_BITS = 20
#: Ids of single words whose counts one task sums.
RANGE = 1 << 19
#: Bytes of text for a token, about, to choose the number of buckets before tokens are counted.
TOKEN_BYTES = 6
#: Bytes of text that are scored at once: each lot is looked up in all buckets, so larger lots cost less.
SCORED_BYTES = 8 << 20
#: Files that a worker keeps mapped.
MAPS = 4096


def _packed(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes: the high bytes of small numbers are nearly nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blobs: pd.Series | list, kind: str | type) -> np.ndarray:
    reader, size = zstandard.ZstdDecompressor(), np.dtype(kind).itemsize
    planes = (np.frombuffer(reader.decompress(b), np.uint8).reshape(size, -1) for b in blobs)
    return np.concatenate([np.ascontiguousarray(x.T).reshape(-1).view(kind) for x in planes])


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys whose results look random (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _chained(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The key of a sequence of ids with one more id after it."""
    with np.errstate(over="ignore"):
        return _mixed(key * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64) + np.uint64(1))


_HIGH = np.uint64(((1 << CONTEXT_BITS) - 1) << (64 - CONTEXT_BITS))


def keys_of(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(context key, n-gram key) of n-grams given as a column for each place; both begin with the same CONTEXT_BITS bits."""
    context = np.zeros(len(ids[0]), np.uint64)
    for x in ids[:-1]:
        context = _chained(context, x)
    return context, context & _HIGH | _chained(context, ids[-1]) & ~_HIGH


def _power(n: float) -> int:
    """The exponent of two for about n / BUCKET_KEYS buckets."""
    return int(np.clip(np.ceil(np.log2(max(n / BUCKET_KEYS, 1))), 0, CONTEXT_BITS))


def _bucket(hashes: np.ndarray, power: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(hashes), np.int64)


def _small(values: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sums, the place of one row of each)."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts[order], starts), order[starts]


def save_keys(folder: str, name: str, keys: np.ndarray, power: int) -> None:
    """Save a bucket's sorted keys in half their size: where each block of keys begins, and 32 bits of each key in its block.

    The bits before those choose the bucket and the block, of about sixteen keys. The last bits of a key are left out: with
    buckets of a million, 2^p of them, 48 + p bits stay, so that some 2^p / 500 pairs of n-grams have one key.
    """
    bits = int(np.clip(len(keys).bit_length() - 4, 1, 24))
    rest = keys << np.uint64(power)
    index = np.searchsorted(rest >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    save(folder, f"{name}-index", index.astype(np.uint32 if len(keys) < 1 << 32 else np.uint64))
    save(folder, f"{name}-low", (rest >> np.uint64(32 - bits)).astype(np.uint32))


def save_counts(folder: str, name: str, counts: np.ndarray, bits: int = 8) -> None:
    """Save counts in a byte or half a byte each; those that do not fit are marked by the largest, and told with their places."""
    many = (1 << bits) - 1
    large = np.flatnonzero(counts >= many)
    small = np.minimum(counts, many).astype(np.uint8)
    if bits == 4:
        small = np.append(small, np.zeros(len(small) % 2, np.uint8))
        small = small[::2] | small[1::2] << 4
    save(folder, name, small)
    save(folder, f"{name}-most", np.stack([large, counts[large]]))


def find_keys(index: np.ndarray, low: np.ndarray, keys: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key in a saved bucket, by halving its block."""
    bits = (len(index) - 1).bit_length() - 1
    rest = keys << np.uint64(power)
    block = (rest >> np.uint64(64 - bits)).astype(np.int64)
    want = (rest >> np.uint64(32 - bits)).astype(np.uint32)
    at, end = index[block].astype(np.int64), index[block + 1].astype(np.int64)
    last, top = end, len(low) - 1
    wide = int((end - at).max(initial=0))
    for step in (1 << k for k in reversed(range(wide.bit_length()))):  # the largest steps that stay before a key not less
        ahead = at + step
        at = np.where((ahead <= last) & (low[np.minimum(ahead, len(low)) - 1] < want), ahead, at)
    place = np.minimum(at, top)
    return place, (at < end) & (low[place] == want)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if len(values):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
        for start, end in zip(starts, [*starts[1:], len(values)], strict=True):
            yield int(values[start]), int(start), int(end)


class Mapped:
    """Arrays of a folder by name, mapped when first used; None for a bucket that got nothing."""

    def __init__(self, folder: str) -> None:
        self.folder, self.open = folder, OrderedDict()

    def __call__(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = f"{self.folder}/{name}.npy"
            self.open[name] = np.asarray(np.load(path, mmap_mode="r")) if os.path.exists(path) else None
            if len(self.open) > MAPS:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]

    def counts(self, name: str, place: np.ndarray, bits: int = 8) -> np.ndarray:
        """Saved counts at these places."""
        if bits == 4:
            found = (self(name)[place >> 1] >> (place % 2 * 4).astype(np.uint8) & 15).astype(np.int64)
        else:
            found = self(name)[place].astype(np.int64)
        many = np.flatnonzero(found == (1 << bits) - 1)
        if len(many):
            own, values = self(f"{name}-most")
            found[many] = values[np.searchsorted(own, place[many])]
        return found

    def look_up(self, tables: list[tuple[str, tuple[str, ...]]], keys: np.ndarray, power: int) -> list[np.ndarray]:
        """For each table in turn, whether each key is in it and in none before, and its columns there, else zero."""
        keys, inverse = np.unique(keys, return_inverse=True)
        out = [[np.zeros(len(keys), np.int64) for _ in range(1 + len(columns))] for _, columns in tables]
        for b, start, end in _runs(_bucket(keys, power)):
            left = np.arange(start, end)
            for (table, columns), (hits, *values) in zip(tables, out, strict=True):
                index = self(f"{table}-{b}-index")
                if index is None or not len(left) or not (low := self(f"{table}-{b}-low")).size:
                    continue
                place, hit = find_keys(index, low, keys[left], power)
                found, place, left = left[hit], place[hit], left[~hit]
                hits[found] = 1
                for x, name in zip(values, columns, strict=True):
                    x[found] = self.counts(f"{table}-{b}-{name}", place, 4 if name == "counts" else 8)
        return [x[inverse] for of in out for x in of]


@dataclass
class Vocabulary:
    """Ids and counts of words in files of sorted hashes; len() is V. Ids V and V + 1 are the unknown word and the start mark."""

    folder: str
    power: int
    firsts: np.ndarray  # id of the first word of each bucket, then V
    tokens: int

    def __len__(self) -> int:
        return int(self.firsts[-1])

    @property
    def kind(self) -> type:
        return np.uint32 if len(self) + 2 < 1 << 32 else np.uint64

    def look_up(self, arrays: Mapped, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of sorted hashes; an unknown word has the id V and count 0."""
        ids, counts = np.full(len(hashes), len(self), np.int64), np.zeros(len(hashes), np.int64)
        for b, start, end in _runs(_bucket(hashes, self.power)):
            if self.firsts[b] == self.firsts[b + 1]:
                continue
            words = arrays(f"words-{b}")
            place = np.minimum(np.searchsorted(words, hashes[start:end]), len(words) - 1)
            hit = words[place] == hashes[start:end]
            ids[start:end] = np.where(hit, self.firsts[b] + place, len(self))
            counts[start:end] = np.where(hit, arrays.counts(f"counts-{b}", place), 0)
        return ids, counts


def token_hashes(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end token after each text, and where each text begins and the last ends."""
    end = np.array([END], np.uint64)
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words = text.translate(LOWER).split()
        parts += [hashes.of(words), end]
        starts[i + 1] = starts[i] + len(words) + 1
    return np.concatenate(parts), starts


def windows(ids: np.ndarray, starts: np.ndarray, order: int, mark: int) -> list[np.ndarray]:
    """A column for each place of the n-grams that end at each token, start marks where the text has not begun."""
    at = np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))  # place in the text
    columns = []
    for back in range(order - 1, 0, -1):
        shifted = np.empty_like(ids)
        shifted[back:] = ids[:-back] if back < len(ids) else ids[:0]
        shifted[at < back] = mark
        columns.append(shifted)
    return [*columns, ids]


Discounts = tuple[float, float, float]


@dataclass
class KneserNey:
    """A trained model: where its arrays are, and a few numbers."""

    words: Vocabulary
    order: int
    powers: dict[int, int] = field(default_factory=dict)  # of each order's buckets
    discounts: dict[int, Discounts] = field(default_factory=dict)
    continuations: int = 0
    span: int = RANGE  # ids whose counts are in one file
    word_rest: float = 1.0  # share of the distribution of single words that goes to 1 / (V + 1)

    def score(self, arrays: Mapped, hashes: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Figures of each text from the hashes of its tokens."""
        v = len(self.words)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        ids, seen = self.words.look_up(arrays, distinct)
        follows = np.zeros(len(ids))
        if self.words.tokens:
            known = np.flatnonzero(ids < v)
            known = known[np.argsort(ids[known], kind="stable")]
            for r, i, j in _runs(ids[known] // self.span):
                follows[known[i:j]] = arrays(f"follows-{r}")[ids[known[i:j]] % self.span]
        lower = (follows - _discount(follows, self.discounts.get(1, FALLBACK))) / max(self.continuations, 1) + self.word_rest / (v + 1)
        p = lower[inverse]
        grams = windows(ids[inverse], starts, self.order, v + 1)
        for n in range(2, self.order + 1) if self.words.tokens else ():
            d = self.discounts[n]
            context, key = keys_of(grams[-n:])
            _, total, n1, n2, n3, once = arrays.look_up([(f"contexts{n}", ("total", "n1", "n2", "n3")), (f"once{n}", ())], context, self.powers[n])
            total, n1 = total + once, n1 + once
            _, count = arrays.look_up([(f"grams{n}", ("counts",))], key, self.powers[n])
            some = np.where(total > 0, total, 1)
            p = np.where(total > 0, (count - _discount(count, d)) / some + (d[0] * n1 + d[1] * n2 + d[2] * n3) / some * p, p)
        base = np.log10((seen + 1) / (self.words.tokens + v + 1))
        at = starts[:-1]
        return {
            "n_tokens": np.diff(starts),
            "n_known": np.add.reduceat((seen > 0)[inverse].astype(np.int64), at),
            "base_score": np.add.reduceat(base[inverse], at),
            "score": np.add.reduceat(np.log10(p), at),
        }


def _discount(counts: np.ndarray, d: Discounts) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


FALLBACK: Discounts = (0.5, 1.0, 1.5)


def discounts(n: list[int]) -> Discounts:
    """D1, D2, D3+ from how many n-grams have the counts one to four."""
    if not all(n):
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple(k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3))
    return d if all(0 < x < k + 1 for k, x in enumerate(d)) else FALLBACK


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, 5)]


def _vocabulary(train: DataFrame, folder: str, power: int) -> Vocabulary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            rows = [(b, _packed(_steps(words[i:j])), _packed(counts[i:j].astype(np.uint32))) for b, i, j in _runs(_bucket(words, power))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "words", "counts"])

        for batch in batches:
            for _, texts in chunks(batch):
                held.append(token_hashes(texts, hashes)[0])
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        b = int(rows["bucket"].iloc[0])
        parts = [np.cumsum(_unpacked([x], np.uint64), dtype=np.uint64) for x in rows["words"]]
        words, counts, _ = _summed(np.concatenate(parts), _unpacked(rows["counts"], np.uint32).astype(np.int64))
        save(folder, f"words-{b}", words)
        save_counts(folder, f"counts-{b}", counts)
        return pd.DataFrame({"bucket": [b], "n": [len(words)], "tokens": [int(counts.sum())]})

    parts = train.mapInArrow(count, "bucket long, words binary, counts binary")
    merged = parts.groupBy("bucket").applyInPandas(merge, "bucket long, n long, tokens long").collect()  # a row for each bucket
    sizes = np.zeros(1 << power, np.int64)
    for r in merged:
        sizes[r["bucket"]] = r["n"]
    return Vocabulary(folder, power, np.concatenate([[0], np.cumsum(sizes)]), sum(r["tokens"] for r in merged))


#: What counting sends: n-grams of one bucket as a column for each place, in one array, and their counts.
SENT = "bucket long, n long, grams binary, counts binary"


def _sent(columns: list[np.ndarray], counts: np.ndarray, bucket: np.ndarray, kind: type) -> list[tuple]:
    """Rows of SENT; the n-grams of a bucket go by their first word, of which only the steps are sent."""
    order = np.argsort(bucket.astype(np.uint64) << np.uint64(64 - CONTEXT_BITS) | columns[0].astype(np.uint64))
    columns, counts, bucket = [c[order].astype(kind) for c in columns], counts[order], bucket[order]
    size = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
    return [(b, j - i, _packed(np.concatenate([_steps(columns[0][i:j]), *(c[i:j] for c in columns[1:])])), _packed(counts[i:j].astype(size))) for b, i, j in _runs(bucket)]


def _received(rows: pd.DataFrame, order: int, kind: type) -> tuple[list[np.ndarray], np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in range(order)]
    counts = []
    for n, grams, sizes in zip(rows["n"], rows["grams"], rows["counts"], strict=True):
        if n:
            first, *others = _unpacked([grams], kind).reshape(order, n)
            for column, x in zip(columns, [np.cumsum(first, dtype=kind), *others], strict=True):
                column.append(x)
            counts.append(_counts(sizes, n))
    return [np.concatenate(c) for c in columns], np.concatenate(counts)


def _counts(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return _unpacked([blob], np.uint32 if len(raw) == 4 * n else np.uint64).astype(np.int64)


def _told(order: int) -> list[str]:
    """Columns for the counts of counts of all orders above the one that a row is of."""
    return [f"o{n}c{k}" for n in range(2, order + 1) for k in range(1, 5)]


def _merge(folder: str, order: int, top: int, power: int, next_power: int, kind: type, mark: int, span: int):
    """Sum a bucket of n-grams, save them and their contexts' figures, and send on what they say of the next lower order."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        b = int(rows["bucket"].iloc[0])
        told = {x: int(rows[x].sum()) if x in rows else 0 for x in _told(top)}
        columns, counts = _received(rows, order, kind)
        context, key = keys_of(columns)
        key, counts, at = _summed(key, counts)
        columns, context = [c[at] for c in columns], context[at]
        save_keys(folder, f"grams{order}-{b}", key, power)
        save_counts(folder, f"grams{order}-{b}-counts", counts, 4)
        by = np.argsort(context)
        sorted_context, of = context[by], counts[by]
        starts = np.flatnonzero(np.concatenate([[True], sorted_context[1:] != sorted_context[:-1]]))
        figures = [np.add.reduceat(x.astype(np.int64), starts) for x in (of, of == 1, of == 2, of >= 3)]
        often = figures[0] > 1  # most contexts occur once: of these the key says all
        save_keys(folder, f"once{order}-{b}", sorted_context[starts][~often], power)
        save_keys(folder, f"contexts{order}-{b}", sorted_context[starts][often], power)
        for name, x in zip(("total", "n1", "n2", "n3"), figures, strict=True):
            save_counts(folder, f"contexts{order}-{b}-{name}", x[often])
        told |= {f"o{order}c{k}": n for k, n in enumerate(_count_of_counts(counts), 1)}
        # the n-gram without its first word: one more word before it, or at a text's start as often as it is there
        worth = np.where(columns[1] == mark, counts, 1) if order > 2 else np.ones(len(counts), np.int64)
        shorter = columns[1:]
        if order > 2:
            keys, sums, at = _summed(keys_of(shorter)[1], worth)
            out = _sent([c[at] for c in shorter], sums, _bucket(keys, next_power), kind)
        else:
            ids, sums, _ = _summed(shorter[0], worth)
            out = [(r, j - i, _packed(_steps(ids[i:j])), _packed(sums[i:j].astype(np.uint64))) for r, i, j in _runs((ids // kind(span)).astype(np.int64))]
        frame = pd.DataFrame(out, columns=["bucket", "n", "grams", "counts"])
        for x, n in told.items():  # they go with the first row
            frame[x] = [n] + [0] * (len(out) - 1)
        frame["source"] = b
        return frame

    return merge


def train_model(train: DataFrame, text: str = "text", order: int = ORDER) -> KneserNey:
    """Count the n-grams of all rows and write the model's arrays to the shared folder."""
    if order < 2:
        raise ValueError("the order is at least two")
    spark = train.sparkSession
    ship(spark)
    folder = mounted(shared_dir(spark)) + "-language-model"
    os.makedirs(folder, exist_ok=True)
    train = train.select(F.col(text).alias("text"))
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = _vocabulary(train, folder, _power(size / TOKEN_BYTES / 8))
    span = RANGE
    model = KneserNey(words, order, span=span)
    if not words.tokens:
        return model
    v, kind, mark = len(words), words.kind, len(words) + 1
    powers = model.powers = {n: _power(words.tokens) for n in range(2, order + 1)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, arrays = WordHashes(), Mapped(folder)
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            keys, counts, at = _summed(keys_of(columns)[1], np.ones(len(columns[0]), np.int64))
            rows = _sent([c[at] for c in columns], counts, _bucket(keys, powers[order]), kind)
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["bucket", "n", "grams", "counts"])

        for batch in batches:
            for _, texts in chunks(batch):
                tokens, starts = token_hashes(texts, hashes)
                distinct, inverse = np.unique(tokens, return_inverse=True)
                ids = words.look_up(arrays, distinct)[0].astype(kind)[inverse]
                held.append(windows(ids, starts, order, mark))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    names = _told(order)

    def part(rows: pd.DataFrame) -> tuple[int, np.ndarray, list[int]]:
        r = int(rows["bucket"].iloc[0])
        dense = np.zeros(min(span, v - r * span), np.int64)
        for ids, sums in zip(rows["grams"], rows["counts"], strict=True):
            dense[(np.cumsum(_unpacked([ids], kind), dtype=kind) % kind(span)).astype(np.int64)] += _unpacked([sums], np.uint64).astype(np.int64)
        return r, dense, [int(rows[x].sum()) for x in names]

    def halfway(rows: pd.DataFrame) -> pd.DataFrame:
        r, dense, told = part(rows)
        ids = np.flatnonzero(dense)
        return pd.DataFrame([(r, len(ids), _packed(_steps((ids + r * span).astype(kind))), _packed(dense[ids].astype(np.uint64)), *told)], columns=["bucket", "n", "grams", "counts", *names])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        r, follows, told = part(rows)
        save(folder, f"follows-{r}", _small(follows))
        return pd.DataFrame([(*told, *_count_of_counts(follows), int((follows >= 3).sum()), int(follows.sum()))], columns=[*names, *SUMS])

    told_too = SENT + "".join(f", {x} long" for x in names)
    sent = train.mapInArrow(count, SENT)
    for n in range(order, 1, -1):
        sent = sent.groupBy("bucket").applyInPandas(_merge(folder, n, order, powers[n], powers.get(n - 1, 0), kind, mark, span), told_too + ", source long")
    salt = max(1, int(np.sqrt(1 << powers[2])))
    half = sent.withColumn("salt", F.col("source") % salt).groupBy("bucket", "salt").applyInPandas(halfway, told_too)
    found = half.groupBy("bucket").applyInPandas(gather, ", ".join(f"{x} long" for x in [*names, *SUMS]))
    sums = found.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in [*names, *SUMS]]).first()
    for n in range(2, order + 1):
        model.discounts[n] = discounts([sums[f"o{n}c{k}"] for k in range(1, 5)])
    d = model.discounts[1] = discounts([sums[f"w{k}"] for k in range(1, 5)])
    model.continuations = sums["total"]
    model.word_rest = (d[0] * sums["w1"] + d[1] * sums["w2"] + d[2] * sums["w3_up"]) / sums["total"]
    return model


SUMS = ["w1", "w2", "w3", "w4", "w3_up", "total"]


def score_texts(docs: DataFrame, model: KneserNey, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) of every row."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, arrays = WordHashes(), Mapped(model.words.folder)
        for batch in batches:
            for part, texts in chunks(batch, text, SCORED_BYTES):
                found = model.score(arrays, *token_hashes(texts, hashes))
                perplexity = 10 ** np.minimum(-found["score"] / found["n_tokens"], 300)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(found[x]) for x in names[1:5]), pa.array(perplexity)], names)

    return docs.select("doc_id", text).mapInArrow(apply, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def is_held_out() -> Column:
    return F.expr("coalesce(crc32(CAST(doc_id AS STRING)) % 7 = 2, false)")


def op2_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_model(docs.where(~is_held_out()))
    scored = score_texts(docs, model)
    return scored.select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
