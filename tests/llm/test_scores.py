"""Quality, toxicity, language model: brute force, held-out accuracy, defined cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitelens.llm import language_model, quality, toxicity
from sitelens.llm.shared import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \t\n", "One", "a b c d e " * 4, "a\nb\na\n\n \na", "x#*$%&|<> <b>", "é è\x0bü x", "a b c d e f a b c d e", "w " * 3000]


def plain_counts(text: str | None) -> list[int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_statistics_equal_brute_force(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    counts, inputs = quality.statistics([(t or "").encode() for t in texts], WordHashes())
    assert counts.tolist() == [plain_counts(t) for t in texts]
    assert np.isfinite(inputs).all() and inputs.shape == (len(texts), len(quality.FEATURES))


def plain_tree_score(model, row):
    total = model.base
    for k in model.roots:
        while model.left[k] != k:
            k = model.left[k] if row[model.feature[k]] <= model.cut[k] else model.right[k]
        total += model.value[k]
    return 1 / (1 + math.exp(-total))


def test_trees_are_monotonic_and_flattening_changes_nothing():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 3))
    y = (r.random(3000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + np.sin(3 * x[:, 2]))))).astype(float)
    model = quality.fit_trees(x, y, [1, -1, 0])
    assert np.allclose(model.score(x[:200]), [plain_tree_score(model, row) for row in x[:200]])
    grid = np.linspace(-3, 3, 80)
    for row in x[:40]:
        for f, sign in ((0, 1), (1, -1)):
            moved = np.repeat(row[None], len(grid), 0)
            moved[:, f] = grid
            assert (sign * np.diff(model.score(moved)) >= -1e-12).all()
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.7


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score_quality(docs, model).join(labels.withColumnRenamed("quality", "label"), "doc_id").where("doc_id % 2 = 1 AND NOT base_failed").collect()
    good = [r for r in rows if r["label"] == 1]
    bad = [r for r in rows if r["label"] == 0]
    assert np.mean([r["kept"] for r in good]) > 0.98 and np.mean([not r["kept"] for r in bad]) > 0.8


def test_quality_defined_cases(spark):
    rows = [(i, t, "x", True) for i, t in enumerate(ODD)] + [(None, "word " * 2, "x", False)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, kept boolean")
    got = quality.score_quality(docs, None).collect()
    assert len(got) == len(rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    one = {r["doc_id"]: r for r in got}
    assert one[4]["base_failed"] and not one[8]["base_failed"] is None
    assert quality.score_quality(docs.limit(0), None).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns and all(r["kept"] for r in kept.where("doc_id IS NOT NULL").collect())


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    pos = np.array(label) > 0
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op3_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([s for s, _, _ in held], [t for _, t, _ in held]) > 0.9
    assert np.mean([p == t for _, t, p in held]) > 0.93


def test_label_model_discounts_copies_of_a_voter():
    """Labels are not shown to it, and it finds the classes that three good voters agree on, not what twelve copies of one say."""
    r = np.random.default_rng(8)
    y = (r.random(4000) < 0.3).astype(float)
    good = (r.random((4000, 3)) < np.where(y[:, None] > 0, 0.7, 0.02)).astype(float)
    noise = (r.random((4000, 1)) < np.where(y[:, None] > 0, 0.35, 0.25)).astype(float)
    votes = np.concatenate([good, np.repeat(noise, 12, 1)], 1)
    labels = np.where(r.random(4000) < 0.9, y, 1 - y) > 0
    model = toxicity.label_model(votes, toxicity.Beliefs.of_labels(votes, labels))
    posterior = model.posterior(votes)
    assert ((posterior > 0.5) == (y > 0)).mean() > 0.95
    assert ((posterior > 0.5) != labels).mean() > 0.05  # it turns the labels that are wrong
    assert model.weight[3:].max() < 0.2 < model.weight[:3].min()
    told = np.log(model.says[1] / model.says[0]) * model.weight
    assert told[:3].min() > told[3:].sum()  # each good voter outweighs the copies together


def plain_label_model(votes, beliefs, rounds):
    """The same expectation maximisation, text by text and voter by voter."""
    n, v = len(votes), len(votes[0])
    says, denies, weight, post = beliefs.says.tolist(), beliefs.denies.tolist(), beliefs.weight.tolist(), [0.0] * n

    def expect():
        for i in range(n):
            odds = math.log(beliefs.share / (1 - beliefs.share))
            for j in range(v):
                rates = [{1: says[c][j], -1: denies[c][j], 0: min(max(1 - says[c][j] - denies[c][j], 1e-6), 1)}[int(votes[i][j])] for c in (0, 1)]
                odds += weight[j] * math.log(rates[1] / rates[0]) * (toxicity.ABSTAIN if votes[i][j] == 0 else 1)
            post[i] = 1 / (1 + math.exp(-min(max(odds, -30), 30)))

    for _ in range(rounds):
        expect()
        of = [[1 - p for p in post], post]
        mean = [[sum(of[c][i] * votes[i][j] for i in range(n)) / max(sum(of[c]), 1e-9) for j in range(v)] for c in (0, 1)]
        left = [[votes[i][j] - sum(of[c][i] * mean[c][j] for c in (0, 1)) for j in range(v)] for i in range(n)]
        for c in (0, 1):
            worth = toxicity.BELIEF * n * (beliefs.share if c else 1 - beliefs.share)
            for kind, sign, prior in ((says, 1, beliefs.says), (denies, -1, beliefs.denies)):
                for j in range(v):
                    kind[c][j] = (sum(of[c][i] for i in range(n) if votes[i][j] == sign) + worth * prior[c][j]) / (sum(of[c]) + worth)
        spread = [math.sqrt(sum(x[j] ** 2 for x in left) / n) + 1e-6 for j in range(v)]
        for j in range(v):
            others = [sum(x[j] * x[k] for x in left) / n / spread[j] / spread[k] for k in range(v) if k != j]
            weight[j] = 1 / (1 + sum(x for x in others if x > 0.1))
    expect()
    return post


def test_label_model_equals_a_plain_one():
    r = np.random.default_rng(2)
    votes = r.choice([-1.0, 0.0, 1.0], (60, 5), p=[0.2, 0.5, 0.3])
    votes[:, 4] = np.abs(votes[:, 3])
    for beliefs in (toxicity.Beliefs.of_votes(votes), toxicity.Beliefs.of_labels(votes, r.random(60) < 0.3)):
        got = toxicity.label_model(votes, beliefs, rounds=7).posterior(votes)
        assert got == pytest.approx(plain_label_model(votes.tolist(), beliefs, 7), abs=1e-9)


def test_toxicity_without_labels_and_with_copies(spark):
    """The lexicon alone finds its insults; a text copied many times makes no voters of its words."""
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("bdgklmnprst"), 5)) for _ in range(300)]
    rows = []
    for i in range(400):
        text = list(r.choice(words, 40))
        if i % 8 == 0:
            text[3:3] = ["you", "pathetic"]
            text[9:9] = ["idiot", "scum"]
        rows.append((i, " ".join(text)))
    copied = " ".join(r.choice(words, 40)) + " zzzzzzz idiot scum moron"
    rows += [(1000 + i, copied) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i] == (i % 8 == 0) for i in range(400)) and all(got[1000 + i] for i in range(200))
    labels = spark.createDataFrame([(i, int(i % 8 == 0 or i >= 1000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert not any(b"zzzz" in v for v in model.voters[0])
    assert model.flips[0] < 450 and model.flips[1] == model.flips[0]


def test_toxicity_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "You IDIOT, you moron!"), (3, "You IDIOT, you moron!"), (None, "fine words " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def plain_model(train, order):
    """Interpolated modified Kneser-Ney by dictionaries, order by order."""
    tokens_of = lambda text: [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), "\n"]
    words, counts = Counter(), {order: Counter()}
    for text in train:
        tokens = tokens_of(text)
        words.update(tokens)
        padded = ["<s>"] * (order - 1) + tokens
        counts[order].update(tuple(padded[i : i + order]) for i in range(len(tokens)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter()
        for gram, c in counts[n + 1].items():
            counts[n][gram[1:]] += c if gram[1] == "<s>" else 1

    def d_of(values):
        n = [sum(c == k for c in values) for k in range(1, 5)]
        if not all(n):
            return (0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
        return d if all(0 < x < k for k, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)

    d = {n: d_of(c.values()) for n, c in counts.items()}
    of = lambda n, c: 0 if c == 0 else d[n][min(c, 3) - 1]
    total, rest = Counter(), defaultdict(float)
    for n in range(2, order + 1):
        for gram, c in counts[n].items():
            total[gram[:-1]] += c
            rest[gram[:-1]] += of(n, c)
    v, kinds = len(words), sum(counts[1].values())
    spare = sum(of(1, c) for c in counts[1].values()) / kinds if kinds else 1.0

    def p(gram):
        n = len(gram)
        c = counts[n][gram]
        if n == 1:
            return (c - of(1, c)) / max(kinds, 1) + spare / (v + 1)
        lower = p(gram[1:])
        return (c - of(n, c) + rest[gram[:-1]] * lower) / total[gram[:-1]] if total[gram[:-1]] else lower

    def score(text):
        tokens = tokens_of(text)
        padded = ["<s>"] * (order - 1) + tokens
        return sum(math.log10(p(tuple(padded[i : i + order]))) for i in range(len(tokens)))

    return words, sum(words.values()), v, score


@pytest.mark.parametrize("many", [False, True])
def test_language_model_equals_brute_force(spark, sf_dir, many, monkeypatch):
    if many:  # many buckets, many sendings
        monkeypatch.setattr(language_model, "BUCKET_KEYS", 300)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    words, n, v, score = plain_model([r["text"] for r in rows if not held[r["doc_id"]]], language_model.ORDER)
    got = {r["doc_id"]: r for r in language_model.op2_kneser_ney_scoring(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        tokens = [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")), "\n"]
        x = got[r["doc_id"]]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[r["doc_id"]], len(tokens), sum(words[w] > 0 for w in tokens), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert x["score"] == pytest.approx(score(r["text"]), rel=1e-9)
        assert x["perplexity"] == pytest.approx(10 ** (-x["score"] / len(tokens)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_of_any_order_equals_brute_force(spark, order, monkeypatch):
    """Several buckets, several ranges of ids, repeated and empty texts."""
    monkeypatch.setattr(language_model, "BUCKET_KEYS", 50)
    monkeypatch.setattr(language_model, "RANGE", 16)
    r = np.random.default_rng(order)
    texts = [" ".join(f"w{min(k, 59)}" for k in r.zipf(1.4, r.integers(0, 30))) for _ in range(80)]
    texts += ["", None, texts[0], texts[0], "w1", "w1 w2", "w5 w6 w7 " * 400]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    *_, score = plain_model(texts, order)
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["w1 w2 unseen w3 w1", "unseen", *texts[:20]])], "doc_id long, text string")
    model = language_model.train_model(docs, order=order)
    for x in language_model.score_texts(docs.union(more), model).join(docs.union(more), "doc_id").collect():
        assert x["score"] == pytest.approx(score(x["text"]), rel=1e-9), x["text"]


def test_language_model_sums_to_one(spark):
    texts = ["a b a c", "a b", "c c a b d", "", None, "b d"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = language_model.train_model(docs)
    arrays, hashes = language_model.Mapped(model.words.folder), WordHashes()

    def log10(*tokens):
        h = np.array([language_model.END if t == "\n" else hashes[t.encode()] for t in tokens], np.uint64)
        return model.score(arrays, h, np.array([0, len(h)]))["score"][0]

    words = ["a", "b", "c", "d", "unseen", "\n"]
    assert sum(10 ** log10(w) for w in words) == pytest.approx(1)
    for context in words[:-1]:
        assert sum(10 ** (log10(context, w) - log10(context)) for w in words) == pytest.approx(1)


def test_language_model_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (3, "x " * 30_000)], "doc_id long, text string")
    model = language_model.train_model(docs.limit(0))
    got = language_model.score_texts(docs, model).collect()
    assert [r["n_tokens"] for r in sorted(got, key=lambda r: r["n_tokens"])] == [1, 1, 3, 30_001]
    assert all(r["n_known"] == 0 and r["score"] == 0 and r["base_score"] == 0 for r in got)
    full = language_model.train_model(docs)
    assert language_model.score_texts(docs.limit(0), full).count() == 0
    assert all(r["score"] < 0 for r in language_model.score_texts(docs, full).collect())
