"""Quality rules: gradient-boosted trees over document statistics.

The trees are trained here, in numpy, on a bounded sample of labelled rows, with monotonic constraints on chosen
features, then flattened into node arrays that score a whole batch at once.

Defined cases: a null text is empty; empty texts have zero statistics and fail the base rule (under 10 words);
repeated rows and ties are scored alike; an empty table gives no rows; columns that are not needed stay untouched.
Without both classes among the labels there is no model and only the base rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import WordHashes, aside, chunks, flat_words, renamed, shingle_hashes, ship, stored, table

#: Labelled rows that the trees are fitted on, at most (those with the smallest hashes of doc_id).
MAX_LABELLED = 20_000
#: A document is kept when the estimated probability of good quality is at least this.
KEEP_AT = 0.35
WINDOW = 5
#: The counted symbols, white space between words, ASCII capitals and digits.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Model inputs with the sign of their constraint: 1 quality may only rise with it, -1 only fall, 0 free.
FEATURES = {
    "log_words": 0, "chars_per_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "exclaim_per_word": -1, "distinct_share": 1, "same_as_last_share": -1,
    "words_per_line": 0,
}


def _among(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def statistics(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text (columns STATS) and model inputs (columns FEATURES)."""
    words, starts = flat_words(texts, hashes, None)
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(texts)), n)
    repeats = np.zeros(len(texts), np.int64)
    h, at = shingle_hashes(words, starts, WINDOW)
    if len(at):
        with np.errstate(over="ignore"):
            keys = h[at] + owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = at[counts[inverse] > 1]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        repeats = np.bincount(owner[np.cumsum(cover)[:-1] > 0], minlength=len(texts))
    distinct = np.zeros(len(texts), np.int64)
    same = np.zeros(len(texts), np.int64)
    if len(words):
        with np.errstate(over="ignore"):
            keys = words + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = np.unique(keys, return_index=True)[1]
        distinct = np.bincount(owner[first], minlength=len(texts))
        again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1]))
        same = np.bincount(owner[again], minlength=len(texts))
    rows = np.zeros((len(texts), 8), np.int64)
    for i, raw in enumerate(texts):
        lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
        length = len(raw.decode("utf-8", "replace"))
        rows[i] = (
            length - _among(raw, SPACES), _among(raw, SYMBOLS), len(lines) - len(set(lines)), len(lines),
            _among(raw, UPPER), raw.count(b"!"), _among(raw, DIGITS), length,
        )
    chars, symbols, dup, lines, upper, exclaim, digits, length = rows.T
    counts = np.stack([n, chars, symbols, dup, repeats], 1)
    some = np.maximum(n, 1)
    inputs = np.stack(
        [
            np.log1p(n), chars / some, symbols / some, dup / np.maximum(lines, 1), repeats / some,
            upper / np.maximum(length, 1), digits / np.maximum(length, 1), exclaim / some, distinct / some,
            same / some, n / np.maximum(lines, 1),
        ],
        1,
    )
    return counts, inputs


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


@dataclass
class Trees:
    """All trees in flat node arrays; a leaf points to itself, so a fixed number of steps reaches every leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


@dataclass
class _Nodes:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        k = len(self.value)
        for to, x in ((self.feature, 0), (self.cut, 0.0), (self.left, k), (self.right, k), (self.value, value)):
            to.append(x)
        return k


def fit_trees(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15,
    bins: int = 64, ridge: float = 1.0, least: int = 5,
) -> Trees:
    """Newton boosting of the logistic loss over binned features.

    A split that breaks the sign of its feature is refused, and both children inherit the bounds that keep
    deeper splits monotonic (the middle of the two child values).
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    raw, nodes, roots = np.full(len(y), base), _Nodes(), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        step = np.zeros(len(y))
        low, high = -np.inf, np.inf
        roots.append(nodes.add(0.0))
        todo = [(roots[-1], np.arange(len(y)), 0, low, high)]
        while todo:
            k, rows, level, low, high = todo.pop()
            value = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
            nodes.value[k] = value * rate
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, q in enumerate(cuts):
                    if not len(q):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(q) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(q) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(q) + 1))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                    gain = gl * vl - (hl + ridge) * vl**2 / 2 + gr * vr - (hr + ridge) * vr**2 / 2
                    gain -= total_g * value - (total_h + ridge) * value**2 / 2
                    ok = (nl >= least) & (len(rows) - nl >= least) & (signs[f] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], (f, j, float(vl[j]), float(vr[j])))
            if best[1] is None:
                step[rows] = nodes.value[k]
                continue
            f, j, vl, vr = best[1]
            nodes.feature[k], nodes.cut[k] = f, float(cuts[f][j])
            nodes.left[k], nodes.right[k] = nodes.add(0.0), nodes.add(0.0)
            goes = binned[rows, f] <= j
            mid = (vl + vr) / 2
            lows, highs = ((low, mid), (mid, high)) if signs[f] > 0 else ((mid, high), (low, mid)) if signs[f] < 0 else ((low, high), (low, high))
            todo += [(nodes.left[k], rows[goes], level + 1, *lows), (nodes.right[k], rows[~goes], level + 1, *highs)]
        raw += step
    return Trees(*(np.array(v) for v in (nodes.feature, nodes.cut, nodes.left, nodes.right, nodes.value, roots)), depth, base)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, condition=None) -> DataFrame:
    """At most `most` labelled rows, those with the smallest hashes of doc_id: (doc_id, text, label).

    The chosen ids are bounded by `most`, so they are broadcast; of rows that share an id one is taken, the one with the
    smallest hash of its text, so the rows have that bound too. They are stored, so that documents are read once.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if condition is not None:
        picked = picked.where(condition)
    picked = picked.groupBy("doc_id").agg(F.max(label).alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("row"))
    return stored(first.select("doc_id", "row.text", "row.label"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees | None:
    """Trees from labels.quality; only statistics of at most max_labelled rows reach the driver."""
    ship(docs.sparkSession)
    names = list(FEATURES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in chunks(batch):
                inputs = statistics(texts, hashes)[1]
                columns = [pa.array(inputs[:, k]) for k in range(inputs.shape[1])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2).cast(pa.int32()), *columns], ["doc_id", "label", *names])

    sample = labelled_sample(docs, labels, "quality", max_labelled)
    rows = sample.mapInArrow(features, "doc_id long, label int, " + ", ".join(f"{x} double" for x in names)).toPandas()
    rows = rows.sort_values(["doc_id", *names])
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    return fit_trees(rows[names].to_numpy(float), y, list(FEATURES.values()))


def score_quality(docs: DataFrame, model: Trees | None, keep_at: float = KEEP_AT, text: str = "text") -> DataFrame:
    """Add the statistics, base_failed, quality (probability) and kept to every row.

    Columns that have such a name are replaced; all others stay.
    """
    ship(docs.sparkSession)
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
    clash = [c for c in docs.columns if c.lower() in new]
    docs = docs.drop(*clash)
    kinds = ["long"] * 5 + ["boolean", "double", "boolean"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in chunks(batch, text):
                counts, inputs = statistics(texts, hashes)
                failed = base_failed(counts)
                good = model.score(inputs) if model else np.ones(len(texts))
                columns = [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(good), pa.array(~failed & (good >= keep_at))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *new])

    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(new, kinds, strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(apply, schema)


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the rules keep, with their own columns and values."""
    rows, names = aside(docs)
    return score_quality(rows, fit(docs, labels), text=names["text"]).where("kept").select(*renamed(names))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *STATS, "base_failed", "kept", "quality")
