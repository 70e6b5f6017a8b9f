"""Toxicity by weak supervision.

Voters look at a text and vote toxic, clean, or abstain. They are words of a fixed lexicon, patterns (an insult beside a
pronoun of address, shouting, how many and how dense such words are), and words and word beginnings mined from a
bounded sample of labelled rows: those whose share of toxic rows is too high to be chance vote toxic, those whose share
is too low vote clean (binomial divergence against the number of candidates). A beginning may ask for up to three words
that begin so. Copies and near copies of a text teach once, so that a text copied a thousand times makes no voters of its words.

A generative label model estimates each voter's rates of voting toxic and clean in both hidden classes by expectation
maximisation over the votes alone: no row's label enters its posterior. The voters' rates on labelled rows are its prior beliefs,
worth half as many texts, and tell which hidden class is which; without labels it believes that a toxic vote is
likelier on a toxic text, and a clean one on a clean text. Correlations between voters are estimated from the
covariance that is left within the classes, and voters that repeat each other share their weight. The posterior of the
hidden class is the soft label that a logistic classifier over the votes and their totals is trained on, and that classifier
scores every document. So a mislabelled row teaches nothing but a few counts of the mining.

Without labels of both classes nothing is mined: the lexicon and the patterns vote on a bounded sample of documents, and the
label model and the classifier learn from that.

Labels are read for learning only; labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts have no words and get the score of a text without votes; repeated rows repeat results;
an empty table gives no rows; a learning sample of under 50 distinct texts leaves the classifier at fixed weights on the lexicon.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import labelled_sample
from .shared import LOWER_ALNUM, WordHashes, as_bytes, chunks, flat_words, shingle_hashes, ship, stored, table

#: Rows that are learned from, at most (those with the smallest hashes of doc_id).
MAX_LABELLED = 20_000
#: Distinct texts below which nothing is learned and the classifier keeps fixed weights.
LEAST_ROWS = 50
#: Mined voters of either kind, at most: the size of the model. The strongest are taken.
MAX_VOTERS = 400
#: Lengths in bytes of the word beginnings that may become voters.
PREFIXES = (4, 5, 6, 7)
#: A voter may ask for so many words with one beginning, at most.
LEVELS = 3
#: How far beyond chance a mined voter must be, in nats above the logarithm of the number of candidates.
MARGIN = 3.0
#: Words that are insults in most uses, and pronouns of address.
LEXICON = (
    "idiot idiots moron morons stupid dumb dumbass loser losers scum trash pathetic worthless disgusting clown clowns "
    "imbecile cretin jerk bastard vermin filth degenerate retard retarded whore slut bitch asshole fuck fucking shit"
).split()
ADDRESS = set(b"you your youre u ur tu toi vous du dich ihr usted vos".split())
#: Pattern voters, in the order of their columns: insult beside an address, capitals, distinct voters' words, their density.
PATTERNS = ("address", "shouting", "several", "dense")


def patterns(raw: bytes) -> set[bytes]:
    """What a text offers to mined voters: its words (1=word), and beginnings of one, two or three of its words (3^word)."""
    counts = Counter(raw.translate(LOWER_ALNUM).split())
    found = {b"1=" + w for w in counts}
    for n in PREFIXES:
        starts: Counter = Counter()
        for w, c in counts.items():
            if len(w) > n:
                starts[w[:n]] += c
        for x, c in starts.items():
            found.update(b"%d^" % k + x for k in range(1, min(c, LEVELS) + 1))
    return found


class Votes:
    """The votes of all voters on a text: toxic patterns, clean patterns, then PATTERNS."""

    def __init__(self, toxic: list[bytes], clean: list[bytes] = ()) -> None:
        self.toxic, self.clean = list(toxic), list(clean)
        self.words: dict[bytes, int] = {}
        self.starts: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for j, v in enumerate(self.toxic + self.clean):
            if v[1:2] == b"=":
                self.words[v[2:]] = j
            else:
                self.starts[v[2:]].append((int(v[:1]), j))
        self.lengths = sorted({len(v) for v in self.starts})
        self.lexicon = {w.encode() for w in LEXICON}

    def __len__(self) -> int:
        return len(self.toxic) + len(self.clean) + len(PATTERNS)

    def of(self, raw: bytes) -> tuple[list[int], list[int], int, int]:
        """Voters that say toxic, voters that say clean, words that some toxic voter knows, all words."""
        ordered = raw.translate(LOWER_ALNUM).split()
        counts = Counter(ordered)
        words = counts.keys()
        votes, known, n = set(), set(), len(self.toxic)
        for w in words & self.words.keys():
            votes.add(j := self.words[w])
            if j < n:
                known.add(w)
        for k in self.lengths:
            starts: Counter = Counter()
            for w, c in counts.items():
                if len(w) > k and (x := w[:k]) in self.starts:
                    starts[x] += c
                    if self.starts[x][0][1] < n:
                        known.add(w)
            for x, c in starts.items():
                votes.update(j for level, j in self.starts[x] if c >= level)
        first = n + len(self.clean)
        says = sorted(j for j in votes if j < n)
        denies = sorted(j for j in votes if j >= n)
        if not words & self.lexicon:
            denies.append(first)
        elif not ADDRESS.isdisjoint(words) and any(ordered[i] in self.lexicon and ADDRESS & set(ordered[max(0, i - 3) : i + 4]) for i in range(len(ordered))):
            says.append(first)
        letters = sum(map(len, ordered))
        capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        if letters > 20 and 10 * capitals > 6 * letters:
            says.append(first + 1)
        often = sum(counts[w] for w in known)
        (says if often > 2 else denies if not often else []).append(first + 2)
        (says if 100 * often > len(ordered) else denies if not often else []).append(first + 3)
        return says, denies, often, len(ordered)

    def row(self, found: tuple[list[int], list[int], int, int]) -> np.ndarray:
        """Inputs of the classifier: votes as 1 and -1, then totals."""
        says, denies, known, words = found
        x = np.zeros(len(self) + 4, np.float32)
        x[says], x[denies] = 1, -1
        x[-4:] = known > 0, np.log1p(known), np.log1p(len(says)), known / max(words, 1)
        return x

    def inputs(self, texts: list[bytes | None]) -> np.ndarray:
        return np.stack([self.row(self.of(raw or b"")) for raw in texts])


#: How much an abstention counts beside a vote.
ABSTAIN = 0.3


@dataclass
class LabelModel:
    """What the label model has estimated: the prior, rates of each voter by class (clean, toxic), and weights."""

    prior: float
    says: np.ndarray  # 2 x voters: the rate of voting toxic
    denies: np.ndarray  # 2 x voters: the rate of voting clean
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        abstains = np.clip(1 - self.says - self.denies, 1e-6, 1)
        odds = [np.log(x[1] / x[0]) * self.weight for x in (self.says, self.denies, abstains)]
        total = (votes > 0) @ odds[0] + (votes < 0) @ odds[1] + ABSTAIN * ((votes == 0) @ odds[2]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


#: The prior beliefs of `label_model` where labels tell nothing: how large a share is toxic, how many times likelier
#: a toxic vote is on a toxic text, and a clean vote on a clean one; and what share of the texts a belief is worth.
SHARE = 0.1
SAYS_TIMES = 20.0
DENIES_TIMES = 4.0
BELIEF = 0.5


@dataclass
class Beliefs:
    """Rates of each voter of saying toxic and of denying it, both 2 x voters (clean, toxic), weights, and the share of toxic texts."""

    says: np.ndarray
    denies: np.ndarray
    weight: np.ndarray
    share: float

    @staticmethod
    def of_votes(votes: np.ndarray, share: float = SHARE) -> Beliefs:
        """A voter's own rates, split between the classes."""
        says, denies = np.clip((votes > 0).mean(0), 1e-6, 1), np.clip((votes < 0).mean(0), 1e-6, 1)
        toxic_says = np.minimum(says / (share + (1 - share) / SAYS_TIMES), 0.9)
        clean_denies = np.minimum(denies / (1 - share + share / DENIES_TIMES), 0.95)
        return Beliefs(np.stack([toxic_says / SAYS_TIMES, toxic_says]), np.stack([clean_denies, clean_denies / DENIES_TIMES]), _weights(votes - votes.mean(0), len(votes)), share)

    @staticmethod
    def of_labels(votes: np.ndarray, toxic: np.ndarray) -> Beliefs:
        """A voter's rates on labelled rows, half a vote added to each."""
        sizes = [(~toxic).sum(), toxic.sum()]
        rates = [np.stack([((votes[of] * sign > 0).sum(0) + 0.5) / (n + 1) for of, n in zip((~toxic, toxic), sizes, strict=True)]) for sign in (1, -1)]
        left = votes - np.where(toxic[:, None], votes[toxic].mean(0), votes[~toxic].mean(0))
        return Beliefs(rates[0], rates[1], _weights(left, len(votes)), float(np.clip(toxic.mean(), 1e-3, 0.5)))


def label_model(votes: np.ndarray, beliefs: Beliefs | None = None, rounds: int = 40) -> LabelModel:
    """Rates of all voters from their votes (1, 0, -1) alone, by expectation maximisation over the hidden class.

    The beliefs are the first guess and stay as pseudo-counts; the share of toxic texts stays as believed.
    """
    n, says, denies = len(votes), (votes > 0).astype(float), (votes < 0).astype(float)
    beliefs = beliefs or Beliefs.of_votes(votes)
    model = LabelModel(beliefs.share, beliefs.says, beliefs.denies, beliefs.weight)
    for _ in range(rounds):
        toxic = model.posterior(votes)
        left = np.zeros(votes.shape)
        all_says, all_denies = [], []
        for c, of in enumerate((1 - toxic, toxic)):
            size, worth = of.sum(), BELIEF * n * (beliefs.share if c else 1 - beliefs.share)
            all_says.append((of @ says + worth * beliefs.says[c]) / (size + worth))
            all_denies.append((of @ denies + worth * beliefs.denies[c]) / (size + worth))
            left += of[:, None] * (votes - (of @ votes) / max(size, 1e-9))
        model = LabelModel(beliefs.share, np.stack(all_says), np.stack(all_denies), _weights(left, n))
    return model


def _weights(left: np.ndarray, n: int) -> np.ndarray:
    """One over how many voters say what each says, from the correlation of what the classes leave unexplained."""
    spread = np.sqrt((left**2).mean(0)) + 1e-6
    correlation = (left.T @ left / n) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    return 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(1))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps; y may be soft."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1).astype(float)
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + penalty * w
        hessian = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Classifier:
    """The linear classifier, and how the label model and the labels differ: rows, labels, flips of the posterior."""

    voters: tuple[list[bytes], list[bytes]]
    weights: np.ndarray
    bias: float
    flips: tuple[int, int, int] = (0, 0, 0)

    def score(self, votes: Votes, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes.inputs(texts) @ self.weights + self.bias, -30, 30)))


def mine_voters(sample: DataFrame, most: int = MAX_VOTERS) -> tuple[list[bytes], list[bytes]]:
    """Patterns whose share of toxic rows is beyond chance, too high and too low, strongest first; counted by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["pattern", "n1", "n0"])
            toxic.clear()
            clean.clear()
            return out

        for batch in batches:
            for raw, label in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                (toxic if label > 0 else clean).update(patterns(raw or b""))
                if len(toxic) + len(clean) > 500_000:
                    yield flush()
        yield flush()

    counts = sample.select("text", "label").mapInArrow(count, "pattern binary, n1 long, n0 long").groupBy("pattern").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 + n0 >= 3")
    n1, n0 = sample.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    share = n1 / (n1 + n0)
    q = "n1 / (n1 + n0)"
    odds = f"(n1 + n0) * (CASE WHEN n1 > 0 THEN {q} * ln({q} / {share}) ELSE 0 END + CASE WHEN n0 > 0 THEN (1 - {q}) * ln((1 - {q}) / {1 - share}) ELSE 0 END)"
    counts = stored(counts.selectExpr("pattern", "n1", f"{q} > {share} AS toxic", f"{odds} AS odds"), "patterns")
    beyond = float(np.log(max(counts.count(), 2)) + MARGIN)
    found = []
    for kind in (F.col("toxic") & (F.col("n1") > 2), ~F.col("toxic")):
        rows = counts.where(kind & (F.col("odds") > beyond)).orderBy(F.desc("odds"), "pattern").limit(2 * most).collect()
        found.append(_spared([bytes(r["pattern"]) for r in rows])[:most])
    return found[0], found[1]


def _spared(voters: list[bytes]) -> list[bytes]:
    """Those that no stronger voter repeats: a word or a beginning after a beginning of it that asks for as many words."""
    kept: list[bytes] = []
    for v in voters:
        if not any(k[1:2] == b"^" and k[:1] == v[:1] and v[2:].startswith(k[2:]) for k in kept):
            kept.append(v)
    return kept


def distinct_texts(sample: DataFrame) -> DataFrame:
    """Rows of the sample without copies: of texts with the same smallest shingle hash (of five words), which near copies share, one."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in chunks(batch):
                least = []
                for text in texts:
                    words, starts = flat_words([text], hashes, LOWER_ALNUM)
                    h, _ = shingle_hashes(words, starts, 5)
                    least.append(int(h.min()) if len(h) else int(words.sum()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), part.column(2).cast(pa.int32()), pa.array(np.array(least, np.uint64).view(np.int64))], ["doc_id", "text", "label", "mark"])

    rows = sample.select("doc_id", "text", "label").mapInArrow(marked, "doc_id long, text string, label int, mark long")
    first = rows.groupBy("mark", "label").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", "text")).alias("row"))
    return stored(first.select("row.doc_id", "row.text", "label"), "distinct")


def fit(docs: DataFrame, labels: DataFrame, condition=None, max_labelled: int = MAX_LABELLED) -> Classifier:
    """The classifier from at most max_labelled rows, labelled ones for which the condition holds where there are any.

    Only votes and labels of the sample reach the driver, no texts.
    """
    ship(docs.sparkSession)
    seed = [b"1=" + w.encode() for w in LEXICON]
    sample = distinct_texts(labelled_sample(docs, labels, "toxic", max_labelled, condition))
    classes = {r[0] for r in sample.select(F.col("label") > 0).distinct().collect()}
    toxic: list[bytes] = []
    clean: list[bytes] = []
    if labelled := classes == {True, False}:
        toxic, clean = mine_voters(sample)
    else:
        chosen = docs.select(F.xxhash64("doc_id", "text").alias("hash"), F.xxhash64("text").alias("of")).distinct().orderBy("hash", "of").limit(max_labelled)
        rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("hash")).join(F.broadcast(chosen), "hash", "left_semi").dropDuplicates(["hash"])
        sample = distinct_texts(rows.select("doc_id", "text", F.lit(None).cast("int").alias("label")))
    votes = Votes(toxic + [v for v in seed if v not in set(toxic)], clean)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes.of(raw or b"") for raw in as_bytes(batch.column(1))]
            columns = [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32())]
            columns += [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            columns += [pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "says", "denies", "known", "words"])

    schema = "doc_id long, label int, says array<int>, denies array<int>, known long, words long"
    rows = sample.mapInArrow(vote, schema).orderBy("doc_id", "words", "known").collect()
    if len(rows) < LEAST_ROWS:
        return Classifier((votes.toxic, votes.clean), np.concatenate([np.zeros(len(votes)), [1.0, 1.5, 0.0, 8.0]]), -2.5)
    x = np.stack([votes.row((r["says"], r["denies"], r["known"], r["words"])) for r in rows])
    of = x[:, : len(votes)].astype(float)
    told = np.array([bool(r["label"] and r["label"] > 0) for r in rows])
    posterior = label_model(of, Beliefs.of_labels(of, told) if labelled else None).posterior(of)
    flips = len(rows), len(rows) * labelled, int(((posterior >= 0.5) != told).sum()) * labelled
    return Classifier((votes.toxic, votes.clean), *logistic(x, posterior), flips)


def score_toxicity(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    ship(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(*model.voters)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                score = model.score(votes, as_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", text).mapInArrow(apply, "doc_id long, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.expr("crc32(CAST(doc_id AS STRING)) % 5")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder != 0)
    held = F.expr("coalesce(crc32(CAST(doc_id AS STRING)) % 5 = 0, false)").alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held, "score", "predicted")
