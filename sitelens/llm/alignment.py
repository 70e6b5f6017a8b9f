"""Cross-tokenizer alignment: which tokens of two tokenizers overlap in a text, and how often each pair of ids does in the corpus.

Both encode the text without special tokens. The two token streams spell the same bytes, and a transducer reads them: its state is the side that leads and
the bytes of that side's last token that the other has not matched yet (the dangling suffix). The side that lags reads next; its token
overlaps the leader's, which is a link, and either shortens the suffix, ends it, or leads from there with what it has beyond it. An empty suffix closes a group, at a byte
offset where tokens of both sides end. Transitions are computed once for each (state, token) and kept; a table of over `KEPT` transitions starts anew.

Of neither tokenizer does a token hold a space or line feed after another character, so both end a token before each run of these: the stretch from one run to the next is
encoded and aligned by itself, and a text is the sum of its stretches. New stretches are encoded joined to groups, which are cut again at their ends; a worker keeps
those it meets most for all tasks of a run. Texts with other white space are encoded whole, and so are all texts if a vocabulary is not of that kind (`Pair.parts`).

First pass: a row for each document holds its groups' digest, both id sequences and two bits a step, which
give the links again without encoding. Each task sums its links by pair of ids and sends them packed by bucket. Buckets (by the
second tokenizer's id) are summed in lanes of `LANES` tasks, lanes again, until one is left, so no task receives more than
`LANES` packed parts of one bucket; a part is bounded by the vocabularies, whatever the corpus. A bucket's task writes its pairs, counts and the highest count
of each of its ids as sorted arrays to the shared folder. Second pass: workers map these and look each document's links up.

Vocabulary files are read on the driver and broadcast (a few MB); their folder is a parameter. The folder of the arrays must be mounted (`file:`).

Defined cases: null and empty texts and texts whose joined token bytes differ from space + text have no tokens: zeros and an empty string;
texts of any length are encoded whole; null doc_ids are kept; repeated rows each count and get a row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_bytes, chunks, mounted, save, shared_dir, ship, table

TOKENIZERS = "/opt/tokenizers"
FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
#: Transitions that a worker keeps.
KEPT = 1_000_000
#: Stretches that a worker keeps (half of them, the most met ones, when there are more), steps for each of these at most on average, and stretches
#: that it encodes at once, in groups of so many joined.
STRETCHES = 300_000
STEPS = 16
AT_ONCE = 10_000
GROUP = 50
#: Stretches whose links are listed at once.
LISTED = 100_000
#: Bytes of text that are aligned at once, and bytes of the first side's ids whose links are looked up at once.
TEXTS = 1 << 20
PACKED = 1 << 20
BUCKETS = 64
#: Packed parts of a bucket that are summed at once.
LANES = 256
#: Distinct pairs of ids that a task holds before it sends them.
PAIRS = 4_000_000


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, first: str, second: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        table = byte_level()
        n = self.first.get_vocab_size()
        self.first_bytes = [self._byte_level(self.first.id_to_token(i), table) for i in range(n)]
        self.second_bytes = [self._piece(i) for i in range(self.second.get_piece_size())]
        self.first_sizes, self.second_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.first_bytes, self.second_bytes))
        # a stretch is encoded behind a letter, which takes the space that the second tokenizer puts first
        self.lead = self.second.piece_to_id("▁x")
        kind = json.loads(first)
        splits = kind["normalizer"] is None and kind["pre_tokenizer"] == kind["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.parts = splits and self.second.encode("x") == [self.lead] and not any(re.search("[^▁]▁|[ \n]", self.second.id_to_piece(i)) for i in range(self.second.get_piece_size()))

    @staticmethod
    def _byte_level(token: str | None, table: dict[str, int]) -> bytes:
        token = token or ""
        return bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()

    def stretches(self, text: str) -> list[str] | None:
        """Of space + text, each run of spaces and line feeds with what follows it; none if it must be encoded whole."""
        return _STRETCH.findall(f" {text}") if self.parts and not _OTHER_SPACE.search(text) else None

    def encode(self, stretches: list[str]) -> tuple[Streams, np.ndarray]:
        """Both streams of the stretches whose token bytes on both sides are theirs, and which these are."""
        ours, theirs = self._ids(stretches)
        raw = [t.encode() for t in stretches]
        good = np.array([b[0] == self.lead for b in theirs], bool)
        streams = Streams.of(ours, [b[1:] for b in theirs])
        sizes = np.array([len(t) for t in raw], np.int64)
        good &= (_sums(self.first_sizes[streams.a], streams.n_a) == sizes) & (_sums(self.second_sizes[streams.b], streams.n_b) == sizes)
        if not good.all() or not self._same(b"".join(raw), streams.a.tolist(), streams.b.tolist()):
            good &= np.array([self._same(t, a, b[1:]) for t, a, b in zip(raw, ours, theirs, strict=True)], bool)
            kept = np.flatnonzero(good)
            streams = Streams.of([ours[i] for i in kept], [theirs[i][1:] for i in kept])
        return streams, good

    def encode_joined(self, stretches: list[str]) -> Iterator[tuple[list[str], Streams, np.ndarray]]:
        """As `encode`, for parts of the stretches: those in groups whose tokens end where they end, and the others each by itself."""
        filled = [t for t in stretches if t.strip(" \n")]  # white space alone would become one with what follows
        groups = [filled[i : i + GROUP] for i in range(0, len(filled), GROUP)]
        ours, theirs = self._ids(["".join(g) for g in groups])
        same = [b[0] == self.lead and self._same("".join(g).encode(), a, b[1:]) for g, a, b in zip(groups, ours, theirs, strict=True)]
        kept = [i for i, ok in enumerate(same) if ok]
        joined = Streams.of([ours[i] for i in kept], [theirs[i][1:] for i in kept])
        part = [t for i in kept for t in groups[i]]
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in part), np.int64, len(part)))
        cut = [np.cumsum(sizes[ids]) for ids, sizes in ((joined.a, self.first_sizes), (joined.b, self.second_sizes))]
        to_a, to_b = (np.searchsorted(x, ends, "right") for x in cut)
        if part and all((x[to - 1] == ends).all() for x, to in zip(cut, (to_a, to_b), strict=True)):
            yield part, Streams(joined.a, joined.b, np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)), np.ones(len(part), bool)
        else:
            same = [False] * len(groups)
        rest = [t for t in stretches if not t.strip(" \n")] + [t for g, ok in zip(groups, same, strict=True) if not ok for t in g]
        if rest:
            yield rest, *self.encode(rest)

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers, of the second behind a letter."""
        ours = [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]
        return ours, self.second.encode([f"x{t}" for t in texts], num_threads=1)

    def encode_whole(self, text: str) -> Streams | None:
        """Both streams of space + text; none where their bytes are not those, or the text is empty."""
        a, b = self.first.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.second.encode(text)
        return Streams.of([a], [b]) if text and self._same(f" {text}".encode(), a, b) else None

    def _same(self, want: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.first_bytes.__getitem__, a)) == want and b"".join(map(self.second_bytes.__getitem__, b)) == want


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each stretch of values."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


@dataclass(frozen=True)
class Streams:
    """The ids of several stretches one after the other, and how many each has."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    @classmethod
    def of(cls, ours: list[list[int]], theirs: list[list[int]]) -> Streams:
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in (ours, theirs)]
        return cls(*flat, *[np.fromiter(map(len, x), np.int64, len(x)) for x in (ours, theirs)])


#: A run of spaces and line feeds and all up to the next one.
_STRETCH = re.compile(r"[ \n]+[^ \n]*")
#: White space that may make one token with what stands beside it.
_OTHER_SPACE = re.compile(r"[^\S \n]")


class State(dict):
    """What follows each token that this state's side reads: the lagging side, or the first where nothing dangles."""

    __slots__ = ("code", "owner", "rest", "side")

    def __init__(self, owner: Transducer, side: int, rest: bytes) -> None:
        self.owner, self.side, self.rest = owner, side, rest
        self.code = side | (0 if rest else 2)

    def __missing__(self, token: int) -> State:
        return self.owner.step(self, token)


class Transducer:
    def __init__(self, first: list[bytes], second: list[bytes], kept: int = KEPT) -> None:
        self.bytes, self.kept = (first, second), kept
        self._anew()

    def _anew(self) -> None:
        self.size, self.states = 0, {}
        self.start = self._state(0, b"")

    def _state(self, side: int, rest: bytes) -> State:
        return self.states.setdefault((side, rest), State(self, side, rest))

    def step(self, state: State, token: int) -> State:
        t, rest = self.bytes[state.side][token], state.rest
        if not rest:
            after = self._state(1, t)
        elif len(t) < len(rest):
            after = self._state(state.side, rest[len(t) :])
        elif len(t) > len(rest):
            after = self._state(1 - state.side, t[len(rest) :])
        else:
            after = self.start
        state[token] = after
        self.size += 1
        return after

    def steps(self, a: list[int], b: list[int]) -> np.ndarray:
        """A number for each token read: bit 0 the side that reads next, bit 1 that nothing dangles."""
        if self.size > self.kept:
            self._anew()
            gc.collect()  # states refer to each other
        state, out = self.start, bytearray()
        read_a, read_b, push = iter(a).__next__, iter(b).__next__, out.append
        try:
            while True:
                state = state[read_b() if state.side else read_a()]
                push(state.code)
        except StopIteration:
            return np.frombuffer(bytes(out), np.uint8)


def read_before(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each step, whether the second side read, and whether nothing dangled before (no link)."""
    before = np.concatenate([np.array([2], np.uint8), after[:-1]])
    return (before & 1).astype(bool), (before >> 1).astype(bool)


def linked(a: np.ndarray, b: np.ndarray, second: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both sides of every link."""
    own = ~opens
    at_b = np.cumsum(second) - 1
    at_a = np.arange(len(second)) - at_b - 1
    return a[at_a[own]], b[at_b[own]]


class Spelling:
    """Writes groups as `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, first: int, second: int) -> None:
        self.first = first
        self.text = np.array([b"%d%c" % (i, c) for c, n in ((44, first), (124, first), (44, second), (59, second)) for i in range(n)], object)
        self.second = second

    def of(self, own: Links) -> list[bytes]:
        """The groups of each stretch."""
        a, b = own.streams.a, own.streams.b
        group = np.cumsum(own.closes) - own.closes
        of_a, of_b = group[~own.second], group[own.second]
        last_a, last_b = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (of_a, of_b))
        words = np.concatenate([a + self.first * last_a, b + 2 * self.first + self.second * last_b])
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        texts = self.text[words[order]].tolist()
        ends = np.cumsum(own.streams.n_a + own.streams.n_b).tolist()
        return [b"".join(texts[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]


class Links:
    """What the transducer says of streams: which side each step read, whether it closed a group, and how many groups each stretch has."""

    def __init__(self, machine: Transducer, streams: Streams) -> None:
        after = machine.steps(streams.a.tolist(), streams.b.tolist())
        self.streams, self.after = streams, after
        self.second, _ = read_before(after)
        self.closes = (after >> 1).astype(bool)
        self.n_groups = _sums(self.closes, streams.n_a + streams.n_b)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class Tally:
    """Counts of pairs of ids, within bounded memory."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        k, c = _summed([keys], [counts])
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)
        if self.held > PAIRS:
            k, c = _summed(self.keys, self.counts)
            self.keys, self.counts, self.held = [k], [c], len(k)

    def full(self) -> bool:
        return self.held > PAIRS

    def empty(self, first: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Its parts by bucket; afterwards it holds nothing."""
        if self.held:
            k, c = _summed(self.keys, self.counts)
            bucket = (k // np.uint64(first)) % np.uint64(BUCKETS)
            for b in np.unique(bucket):
                yield int(b), k[bucket == b].tobytes(), c[bucket == b].tobytes()
        self.__init__()


class Aligned:
    """Stretches with their ids, steps and groups, each under a number; how often they were met since their links were listed (`uses`), and of late (`weight`)."""

    #: Instead of a number: not met yet, and not to be aligned by itself.
    NEW, BAD = -1, -2

    def __init__(self, pair: Pair, kept: int = STRETCHES) -> None:
        self.pair, self.kept = pair, kept
        self.sizes = len(pair.first_bytes), len(pair.second_bytes)
        self.machine = Transducer(pair.first_bytes, pair.second_bytes)
        self.spelling = Spelling(*self.sizes)
        self.numbers: dict[str, int] = {}
        self.groups: list[bytes] = []
        types = {"a": _id_type(self.sizes[0]), "b": _id_type(self.sizes[1]), "after": np.uint8}
        self.columns = {c: [np.zeros(0, types.get(c, np.int64))] for c in ("a", "b", "after", "n_a", "n_b", "n_groups", "uses", "weight")}

    def column(self, name: str) -> np.ndarray:
        parts = self.columns[name]
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts)]
        return parts[0]

    def begin(self) -> None:
        """A task begins: what another met is not its own."""
        self.column("uses")[:] = 0

    def full(self) -> bool:
        return max(len(self.numbers), len(self.groups)) > self.kept or len(self.column("after")) > STEPS * self.kept

    def _add(self, streams: Streams) -> range:
        """The numbers that the stretches of streams get."""
        own, n, first = Links(self.machine, streams), len(streams.n_a), len(self.groups)
        none = np.zeros(n, np.int64)
        new = {"a": streams.a, "b": streams.b, "after": own.after, "n_a": streams.n_a, "n_b": streams.n_b, "n_groups": own.n_groups, "uses": none, "weight": none}
        for c, values in new.items():
            self.columns[c].append(values.astype(self.columns[c][0].dtype))
        self.groups += self.spelling.of(own)
        return range(first, first + n)

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), AT_ONCE):
            for part, streams, good in self.pair.encode_joined(new[i : i + AT_ONCE]):
                made = iter(self._add(streams))
                self.numbers |= {s: next(made) if ok else self.BAD for s, ok in zip(part, good.tolist(), strict=True)}

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all stretches of all texts, and how many each text has: those of its parts, one of the whole where it must be, or none."""
        cut = [self.pair.stretches(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(x for x in cut if x))
        at = np.fromiter(map(self.numbers.get, flat, repeat(self.NEW)), np.int64, len(flat))
        missing = np.flatnonzero(at == self.NEW).tolist()
        if missing:
            self._learn(list(dict.fromkeys(map(flat.__getitem__, missing))))
            at[missing] = np.fromiter((self.numbers[flat[i]] for i in missing), np.int64, len(missing))
        n = np.array([len(x or ()) for x in cut], np.int64)
        text = np.repeat(np.arange(len(texts)), n)
        whole = np.union1d(text[at == self.BAD], [i for i, x in enumerate(cut) if x is None]).astype(np.int64)
        if len(whole):
            made = [(i, streams) for i in whole.tolist() if (streams := self.pair.encode_whole(texts[i])) is not None]
            own = np.array([self._add(streams)[0] for _, streams in made], np.int64)
            parts = ~np.isin(text, whole)
            text, at = np.concatenate([text[parts], np.array([i for i, _ in made], np.int64)]), np.concatenate([at[parts], own])
            order = np.argsort(text, kind="stable")
            at, n = at[order], np.bincount(text, minlength=len(texts))
        return at, n

    def texts(self, texts: list[str], times: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes], list[bytes], list[int], list[str]]:
        """Ids of both sides, bits of the steps, number of groups and their digest of each text, which is met so many times."""
        at, n = self._numbers(texts)
        met = np.bincount(at, np.repeat(times, n), len(self.groups)).astype(np.int64)
        for c in ("uses", "weight"):
            self.column(c)[:] += met
        n_a, n_b = self.column("n_a"), self.column("n_b")
        of_a, of_b = _sums(n_a[at], n), _sums(n_b[at], n)
        ids = [_cut(_taken(self.column(c), of, at), own) for c, of, own in (("a", n_a, of_a), ("b", n_b, of_b))]
        # nothing dangles at a stretch's end
        read = read_before(_taken(self.column("after"), n_a + n_b, at))
        ends = np.cumsum(of_a + of_b).tolist()
        bits = [[np.packbits(x[i:j]).tobytes() for i, j in zip([0, *ends], ends, strict=False)] for x in read]
        ends, spelt = np.cumsum(n).tolist(), list(map(self.groups.__getitem__, at.tolist()))
        digests = [hashlib.sha256(b";".join(spelt[i:j])).hexdigest() if j > i else "" for i, j in zip([0, *ends], ends, strict=False)]
        return *ids, *bits, _sums(self.column("n_groups")[at], n).tolist(), digests

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of ids by stretch and how often they were met since the last time."""
        uses, n_a, n_b = self.column("uses"), self.column("n_a"), self.column("n_b")
        met = np.flatnonzero(uses)
        for i in range(0, len(met), LISTED):
            at = met[i : i + LISTED]
            second, opens = read_before(_taken(self.column("after"), n_a + n_b, at))
            la, lb = linked(*[_taken(self.column(c), of, at).astype(np.int64) for c, of in (("a", n_a), ("b", n_b))], second, opens)
            yield (lb * self.sizes[0] + la).astype(np.uint64), np.repeat(uses[at], _sums(~opens, n_a[at] + n_b[at]))
        uses[:] = 0

    def forget(self) -> None:
        """Keep at most half of what a worker may keep, the stretches that were met most; their links must have been listed."""
        named = np.fromiter((i for i in self.numbers.values() if i >= 0), np.int64)
        weight, n_a, n_b = self.column("weight"), self.column("n_a"), self.column("n_b")
        most = named[np.argsort(-weight[named], kind="stable")][: self.kept // 2]
        at = np.sort(most[np.cumsum((n_a + n_b)[most]) <= STEPS * self.kept // 2])
        for c, of in (("a", n_a), ("b", n_b), ("after", n_a + n_b)):
            self.columns[c] = [_taken(self.column(c), of, at)]
        for c in ("n_a", "n_b", "n_groups", "uses", "weight"):
            self.columns[c] = [self.column(c)[at]]
        self.columns["weight"][0] //= 2
        self.groups = [self.groups[i] for i in at.tolist()]
        new = dict(zip(at.tolist(), range(len(at)), strict=True))
        self.numbers = {s: new[i] for s, i in self.numbers.items() if i in new}


_OF_WORKER: dict[str, Aligned] = {}


def of_worker(run: str, files: tuple[str, bytes]) -> Aligned:
    """What this worker keeps for the tasks of a run; that of another run goes."""
    if run not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[run] = Aligned(Pair(*files))
    own = _OF_WORKER[run]
    own.begin()
    return own


_DOCS = "doc_id long, a binary, b binary, steps binary, opens binary, n_groups long, groups_sha256 string"
_PARTS = "bucket int, lane long, keys binary, counts binary"
_NAMES = [c.split()[0] for c in f"{_DOCS}, {_PARTS}".split(", ")]


def _id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _taken(values: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of stretches of values, those with these numbers, one after the other."""
    n = counts[at]
    ends = np.cumsum(n)
    return values[np.repeat((np.cumsum(counts) - counts)[at] - ends + n, n) + np.arange(n.sum())]


def _cut(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of each stretch of values."""
    raw, ends = values.tobytes(), (values.itemsize * np.cumsum(counts)).tolist()
    return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def encoded(docs: DataFrame, files: tuple[str, bytes], text: str = "text") -> DataFrame:
    """A row for each document with its ids and steps, and rows of packed pair counts (bucket not null); stored."""
    spark = docs.sparkSession
    known, path = spark.sparkContext.broadcast(files), f"{shared_dir(spark)}-encoded"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the stretches that are kept make no cycles, and looking for them takes a quarter of the time
        try:
            yield from rows_of(batches)
        finally:
            gc.enable()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = of_worker(path, known.value)
        tally, lane = Tally(), TaskContext.get().partitionId()

        def tell() -> None:
            for keys, n in aligned.links():
                tally.add(keys, n)

        def counts() -> pa.RecordBatch:
            rows = list(tally.empty(aligned.sizes[0]))
            none = pa.nulls(len(rows))
            return pa.RecordBatch.from_arrays(
                [none.cast(t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string())]
                + [pa.array([r[0] for r in rows], pa.int32()), pa.array([lane] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                _NAMES,
            )

        for batch in batches:
            for part, raw in chunks(batch, most=TEXTS):
                times = Counter(raw)
                if aligned.full():
                    tell()
                    aligned.forget()
                made = aligned.texts([t.decode() for t in times], np.fromiter(times.values(), np.int64, len(times)))
                place = dict(zip(times, range(len(times)), strict=True))
                own = [place[t] for t in raw]
                columns = [[c[i] for i in own] for c in made]
                none = pa.nulls(len(raw))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *[pa.array(c, pa.binary()) for c in columns[:4]], pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.string()), *[none.cast(t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())]],
                    _NAMES,
                )
                if tally.full():
                    yield counts()
        tell()
        yield counts()

    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).mapInArrow(apply, f"{_DOCS}, {_PARTS}")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _summed([np.frombuffer(x, np.uint64) for x in rows["keys"].to_pylist()], [np.frombuffer(x, np.int64) for x in rows["counts"].to_pylist()])


def write_counts(parts: DataFrame, first: int, second: int) -> str:
    """Sum the packed parts and write each bucket's pairs, counts and highest counts; returns the folder. Nothing but the number of tasks reaches the driver."""
    spark = parts.sparkSession
    folder = mounted(shared_dir(spark)) + "-pairs"
    os.makedirs(folder, exist_ok=True)

    def merge(rows: pa.Table) -> pa.Table:
        k, c = _merged(rows)
        return pa.table({"bucket": rows["bucket"][:1], "lane": rows["lane"][:1], "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary())})

    def write(rows: pa.Table) -> pa.Table:
        k, c = _merged(rows)
        b = rows["bucket"][0].as_py()
        best = np.zeros(second, np.int64)
        np.maximum.at(best, (k // np.uint64(first)).astype(np.int64), c)
        for name, values in (("keys", k), ("counts", c), ("best", best[b::BUCKETS])):
            save(folder, f"{b}-{name}", values)
        return pa.table({"bucket": pa.array([b], pa.int32())})

    lanes = parts.agg(F.max("lane")).first()[0]
    while lanes is not None and lanes >= LANES:
        path = f"{shared_dir(spark)}-lanes"
        parts.withColumn("lane", F.expr(f"lane div {LANES}")).groupBy("bucket", "lane").applyInArrow(merge, _PARTS).write.parquet(path)
        parts, lanes = spark.read.schema(_PARTS).parquet(path), lanes // LANES
    if lanes is not None:
        parts.groupBy("bucket").applyInArrow(write, "bucket int").write.format("noop").mode("overwrite").save()
    return folder


class Counts:
    """Corpus-wide counts of pairs, mapped when first used."""

    def __init__(self, folder: str, first: int) -> None:
        self.folder, self.first, self.open = folder, first, {}

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair, and the highest count of any pair of its second id."""
        at, distinct = pd.factorize(keys)
        count, best = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        b = (distinct // np.uint64(self.first)).astype(np.int64)
        for bucket in np.unique(b % BUCKETS):
            if bucket not in self.open:
                self.open[bucket] = [np.load(f"{self.folder}/{bucket}-{name}.npy", mmap_mode="r") for name in ("keys", "counts", "best")]
            k, c, most = self.open[bucket]
            own = b % BUCKETS == bucket
            count[own] = c[np.searchsorted(k, distinct[own])]
            best[own] = most[b[own] // BUCKETS]
        return count[at], best[at]


def align(docs: DataFrame, tokenizers: str = TOKENIZERS, first: str = FIRST, second: str = SECOND, text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs."""
    ship(docs.sparkSession)
    with open(f"{tokenizers}/{first}", encoding="utf-8") as f, open(f"{tokenizers}/{second}", "rb") as g:
        files = f.read(), g.read()
    pair = Pair(*files)
    sizes = len(pair.first_bytes), len(pair.second_bytes)
    rows = encoded(docs, files, text)
    folder = write_counts(rows.where("bucket IS NOT NULL").select("bucket", "lane", "keys", "counts"), *sizes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(folder, sizes[0])
        for batch, a in (x for whole in batches for x in chunks(whole, "a", most=PACKED)):
            b, steps, opens = (as_bytes(batch.column(k)) for k in range(2, 5))
            n_a, n_b = (np.array([len(x) for x in ids], np.int64) // np.dtype(_id_type(size)).itemsize for ids, size in zip((a, b), sizes, strict=True))
            bits = [[np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(packed, (n_a + n_b).tolist(), strict=True)] for packed in (steps, opens)]
            second, open_ = (np.concatenate([np.zeros(0, np.uint8), *x]).astype(bool) for x in bits)
            la, lb = linked(*[np.frombuffer(b"".join(ids), _id_type(size)).astype(np.int64) for ids, size in zip((a, b), sizes, strict=True)], second, open_)
            count, best = counts.of((lb * sizes[0] + la).astype(np.uint64))
            n_links = _sums(~open_, n_a + n_b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_a), pa.array(n_b), batch.column(5), pa.array(n_links), pa.array(_sums(count == best, n_links)), pa.array(_sums(count, n_links)), batch.column(6)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    own = rows.where("bucket IS NULL").select("doc_id", "a", "b", "steps", "opens", "n_groups", "groups_sha256")
    return own.mapInArrow(apply, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
