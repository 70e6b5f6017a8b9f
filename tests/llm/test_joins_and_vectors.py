"""N-gram Jaccard join, embedding whitening and cross-tokenizer alignment against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitelens.llm import alignment, jaccard, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def plain_set(text: str | None) -> set[tuple[str, ...]]:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_components(rows) -> list[tuple]:
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(frame) -> list[tuple]:
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=str)


def copies(seed: int, groups: int, each: int, words: int) -> list[str]:
    """Groups of texts around one base, with one to six words changed, cut or added, and a passage that all texts share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)] + passage
        for _ in range(each):
            own = list(base)
            for _ in range(r.randint(0, 6)):
                k = r.randrange(len(own))
                own[k : k + r.randint(0, 2)] = [word() for _ in range(r.randint(0, 2))]
            out.append(" ".join(own))
    return out


def test_jaccard_join_of_the_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(jaccard.op11_ngram_jaccard_join(spark, sf_dir)) == plain_components(rows)


@pytest.mark.parametrize("rounds, hot, block", [(2, 1000, 1000), (0, 4, 7)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, rounds, hot, block):
    """With pivots first; and all by blocks of a few sets, with hot tokens dealt by set."""
    monkeypatch.setattr(jaccard, "BUCKET_TOKENS", 2000)
    monkeypatch.setattr(jaccard.meetings, "__defaults__", (block,))
    texts = copies(1, 12, 14, 60) + copies(2, 3, 30, 20) + copies(3, 1, 60, 100)
    rows = list(enumerate(texts + texts[:40]))
    assert found(jaccard.jaccard_components(frame(spark, rows), rounds, hot, 20 if hot == 4 else 1000)) == plain_components(rows)


def test_sketches_miss_no_link():
    """Sets at and around the threshold, large enough that numbers of 16 bits meet by chance."""
    r = np.random.default_rng(4)
    for n in (3, 40, 900, 9000):
        base = r.integers(0, 1 << 62, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[r.random(n) > x], r.integers(0, 1 << 62, int(n * x)).astype(np.uint64)])) for x in (0, 0.05, 0.1, 0.11, 0.12, 0.2)]
        short = [((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16) for x in sets]
        own = [np.unique(x) for x in short]
        size = np.array([len(x) for x in sets])
        got = set(zip(*map(np.ndarray.tolist, jaccard.close_pairs(own, size, size - np.array([len(x) for x in own]), np.arange(len(sets)))), strict=True))
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both * 100 >= 80 * (size[i] + size[j] - both):
                    assert (i, j) in got
        assert len(got) < 15 or n < 40


def test_jaccard_join_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d"), (8, "a b c d e"), (9, "a b c d e f"), (None, "x y z"), (None, "x y z"), (10, "p q r s t u"), (10, "p q r s t u"), (11, "Ä ä É x y z"), (3, None), (12, "w " * 3000)]
    docs = frame(spark, rows).withColumnsRenamed({"lang": "h", "source": "token", "n_chars": "n"})
    assert found(jaccard.jaccard_components(docs)) == plain_components(rows)
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []


def plain_whitening(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, eigenvectors and centred rows of integers."""
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return values[::-1], vectors[:, ::-1], c


def test_whitening_equals_a_dense_decomposition(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([[int(np.floor(64 * float(c))) for c in r["embedding"]] for r in rows])
    ids = [r["vec_id"] for r in rows]
    values, vectors, c = plain_whitening(x.astype(float))
    n, sums = len(x), (x + 1_000_000).sum(0)
    deviation = ((n * (x + 1_000_000) - sums) ** 2).sum(1)
    got = whitening.op12_embedding_whitening(spark, sf_dir).toPandas()
    assert len(got) == 32 * n and set(got["n"]) == {n}
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == dict(zip(ids, deviation.tolist(), strict=True))
    assert (got["identity_error"] < 1e-10).all() and got["identity_error"].nunique() == 1
    share = got.groupby("component")["explained"].first().to_numpy()
    np.testing.assert_allclose(share, values[:32] / values.sum(), rtol=1e-10)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = c @ vectors[:, :32] / np.sqrt(values[:32])
    sign = np.sign((wide * want).sum(0))
    np.testing.assert_allclose(wide, want * sign, atol=1e-7)


def spectrum(values: list[float], d: int, seed: int) -> np.ndarray:
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return q @ np.diag(values + [0.0] * (d - len(values))) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [1.0] * 200,
        [10.0] * 20 + [1.0] * 180,
        [7.0, 7.0, 7.0] + [1e-9] * 197,
        [2.0**-k for k in range(200)],
        [5.0],
        list(np.linspace(9, 1, 200)),
        [100.0, 50.0] + [3.0 + 1e-7 * k for k in range(198)][::-1],
    ],
)
def test_lanczos_with_multiple_values_breakdowns_and_restarts(values):
    v = spectrum(values, 200, 1)
    passes = []
    got, u = whitening.eigenpairs(lambda q: passes.append(1) or v @ q, 200, 12, block=4, most=64)
    want = np.linalg.eigvalsh(v)[::-1][:12]
    np.testing.assert_allclose(got, want, atol=1e-10 * max(values))
    np.testing.assert_allclose(u.T @ u, np.eye(12), atol=1e-12)
    assert np.linalg.norm(v @ u - u * got, axis=0).max() <= 1e-9 * max(values)


def test_lanczos_takes_fewer_passes_than_the_dimension_asks():
    v = spectrum([2.0**-k for k in range(40)], 400, 2)
    passes = []
    whitening.eigenpairs(lambda q: passes.append(1) or v @ q, 400, 8)
    assert len(passes) < 15


def test_whitening_defined_cases(spark):
    schema = "vec_id long, embedding array<float>, component int, n string"
    rows = [(1, [1.0, 2.0, 3.0], 0, "a"), (2, None, 0, "a"), (3, [1.0, None, 2.0], 0, "a"), (4, [float("nan"), 1.0, 1.0], 0, "a"), (5, [float("inf"), 0.0, 0.0], 0, "a"), (6, [0.5, 0.25, -1.0], 0, "a"), (7, [], 0, "a"), (8, [1.0, 2.0], 0, "a"), (None, [0.0, 0.0, 0.0], 0, "a"), (1, [1.0, 2.0, 3.0], 0, "a")]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    x = np.floor(64 * np.array([[1, 2, 3], [0.5, 0.25, -1], [0, 0, 0], [1, 2, 3]], float))
    values, _, _ = plain_whitening(x)
    assert Counter(r["vec_id"] for r in got) == {1: 4, 6: 2, None: 2}
    assert {r["n"] for r in got} == {4} and {r["component"] for r in got} == {1, 2}
    np.testing.assert_allclose(sorted({r["explained"] for r in got}, reverse=True), values[:2] / values.sum())
    for few in ([], rows[1:2], rows[:1], [rows[0], rows[0]]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).collect() == []
    huge = [(k, [3e38 * (k % 2), float(k)], 0, "a") for k in range(4)]
    got = whitening.whiten(spark.createDataFrame(huge, schema)).collect()
    assert {r["component"] for r in got} == {1} and {r["deviation"] for r in got} == {None} and abs(got[0]["explained"] - 1) < 1e-9


TEXTS = [
    "a plain text", "", None, "x", "<s>not special</s> <unk> <|endoftext|> [INST]", "  two  spaces \n\ttabs ", "naïve Ünïcödé — 漢字かな 🙂👩‍👩‍👧", "0x0A <0x0A> ▁ ▁▁under", "a\x00b\x01", "word " * 3000,
    "antidisestablishmentarianism floccinaucinihilipilification", "https://example.org/a?b=c&d=%20", "ﬁ ligature ½ \u00a0nbsp \u2028 line", "RTL \u202e abc \ufeff bom", "\n", " ", "\ud55c\uad6d\uc5b4 \u0e44\u0e17\u0e22",
]


@pytest.fixture(scope="module")
def pair():
    with open(f"{alignment.TOKENIZERS}/{alignment.FIRST}", encoding="utf-8") as f, open(f"{alignment.TOKENIZERS}/{alignment.SECOND}", "rb") as g:
        return alignment.Pair(f.read(), g.read())


def plain_alignment(pair, rows):
    """By byte offsets: tokens overlap where their ranges do."""
    docs, pairs = [], Counter()
    for doc, text in rows:
        spaced = (" " + (text or "")).encode()
        a, b = pair.first.encode(spaced.decode(), add_special_tokens=False).ids, pair.second.encode(text or "")
        ends = [np.cumsum([len(table[i]) for i in ids]) for ids, table in ((a, pair.first_bytes), (b, pair.second_bytes))]
        joined = [b"".join(table[i] for i in ids) for ids, table in ((a, pair.first_bytes), (b, pair.second_bytes))]
        if not text or joined != [spaced, spaced]:
            docs.append((doc, 0, 0, 0, [], ""))
            continue
        all_ends = np.union1d(*ends)
        links = [(a[i], b[j]) for i, j in zip(np.searchsorted(ends[0], all_ends), np.searchsorted(ends[1], all_ends), strict=True)]
        groups, i, j = [], 0, 0
        for end in np.intersect1d(*ends):
            k, m = np.searchsorted(ends[0], end) + 1, np.searchsorted(ends[1], end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        pairs.update(links)
        docs.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return sorted(((d, n_a, n_b, g, len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), sha) for d, n_a, n_b, g, links, sha in docs), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(frame) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def test_alignment_of_the_documents(spark, sf_dir, pair):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert aligned(alignment.op13_cross_tokenizer_alignment(spark, sf_dir)) == plain_alignment(pair, rows)


def test_alignment_of_odd_texts_and_in_lanes(spark, monkeypatch, pair):
    monkeypatch.setattr(alignment, "LANES", 2)
    rows = [*enumerate(TEXTS), (None, "x y"), (3, "x"), (3, "x")]
    docs = frame(spark, rows).withColumnsRenamed({"lang": "bucket", "source": "keys", "n_chars": "lane"}).repartition(7)
    got = aligned(alignment.align(docs))
    assert got == plain_alignment(pair, rows)
    assert sum(r[1] > 0 for r in got) > 12
    assert alignment.align(frame(spark, [])).collect() == []


def test_alignment_states_are_dangling_suffixes(pair):
    machine = alignment.Transducer([b"ab", b"c", b"abcd"], [b"a", b"bc", b"b", b"cd"])
    assert machine.steps([0, 1], [0, 1]).tolist() == [1, 1, 0, 2]
    assert {(s.side, s.rest) for s in machine.states.values()} == {(0, b""), (1, b"ab"), (1, b"b"), (0, b"c")}
    assert machine.size == 4 and machine.steps([0, 1], [0, 1]).tolist() == [1, 1, 0, 2] and machine.size == 4
    small = alignment.Transducer(pair.first_bytes, pair.second_bytes, kept=3)
    large = alignment.Transducer(pair.first_bytes, pair.second_bytes)
    for text in ("one two three", "four five", "Ünï five four"):
        whole = pair.encode_whole(text)
        a, b = whole.a.tolist(), whole.b.tolist()
        assert small.steps(a, b).tolist() == large.steps(a, b).tolist()


def test_stretches_give_what_whole_texts_give(spark, monkeypatch, pair):
    """Every mixture of white space and characters of all kinds, cut and whole; with a table of few stretches."""
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", " \n", "a", "bc", "don't", "'s", "Ü", "漢字", "12", "3.5", "!?", "_", "▁", "▁▁", "<s>", "🙂", "é", "e\u0301", "\u200b", "x", "word", "<0x0A>", "\u00ad", "\x1f"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(3000)] + ["".join(r.choice([*parts, "\t", "\u00a0", "\r\n", "\u3000"]) for _ in range(8)) for _ in range(500)]
    assert pair.parts and pair.stretches("a\tb") is None and pair.stretches("a  b\nc ") == [" a", "  b", "\nc", " "]
    cut = 0
    for text in texts:
        own = pair.stretches(text)
        streams, good = pair.encode(own) if own else (None, np.zeros(1, bool))
        if good.all():
            cut += 1
            whole = pair.encode_whole(text)
            assert (streams.a.tolist(), streams.b.tolist()) == (whole.a.tolist(), whole.b.tolist()), repr(text)
    assert cut > 1500
    monkeypatch.setattr(alignment, "STRETCHES", 5)
    rows = list(enumerate(texts[:400] + texts[-200:]))
    assert aligned(alignment.align(frame(spark, rows))) == plain_alignment(pair, rows)


def test_pairs_are_summed_within_bounds(monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 50)
    tally, r, sent, want = alignment.Tally(), np.random.default_rng(1), Counter(), Counter()
    for _ in range(40):
        keys = r.integers(0, 300, 30).astype(np.uint64)
        want.update(keys.tolist())
        tally.add(keys, np.ones(len(keys), np.int64))
        if tally.full():
            for _, k, c in tally.empty(10):
                sent.update(dict(zip(np.frombuffer(k, np.uint64).tolist(), np.frombuffer(c, np.int64).tolist(), strict=True)))
            assert tally.held == 0
    for _, k, c in tally.empty(10):
        sent.update(dict(zip(np.frombuffer(k, np.uint64).tolist(), np.frombuffer(c, np.int64).tolist(), strict=True)))
    assert sent == want


def test_stretches_reach_the_tokenizers_in_groups_and_once(monkeypatch, pair):
    """Joined to groups they give what each gives by itself, also beside some that no token spells; what a worker has met is not encoded again."""
    r = random.Random(6)
    odd = [" ", "\n \n", "  ﬁ½", " é", " a\x00", " ­", " ", " �▁", "\n🙂"]
    texts = [" " + "".join(r.choice("abcdeéÜ漢1!") for _ in range(r.randint(1, 9))) for _ in range(1000)]
    stretches = list(dict.fromkeys(texts + odd))
    r.shuffle(stretches)

    def of(parts) -> dict:
        made = {}
        for own, streams, good in parts:
            at, n_a, n_b = -1, np.append(0, np.cumsum(streams.n_a)), np.append(0, np.cumsum(streams.n_b))
            for s, ok in zip(own, good.tolist(), strict=True):
                at += ok
                made[s] = (streams.a[n_a[at] : n_a[at + 1]].tolist(), streams.b[n_b[at] : n_b[at + 1]].tolist()) if ok else None
        return made

    single = of([(stretches, *pair.encode(stretches))])
    assert of(pair.encode_joined(stretches)) == single and list(pair.encode_joined([])) == [] and of(pair.encode_joined(odd)) == {s: single[s] for s in odd}
    given, ids = [], alignment.Pair._ids
    monkeypatch.setattr(alignment.Pair, "_ids", lambda self, x: given.extend(x) or ids(self, x))
    own, once = alignment.Aligned(pair), np.ones(1, np.int64)
    text = "".join(texts)[1:]
    first = own.texts([text], once)
    assert 0 < len(given) <= len(set(texts)) // alignment.GROUP + 1
    given.clear()
    assert own.texts([text], once) == first and not given


def test_a_worker_keeps_the_stretches_it_meets_most(pair):
    """With room for few stretches, texts and counts of pairs stay whole, also those of texts that are encoded whole and of a task after another."""
    r = random.Random(7)
    words = ["often", "rare", "Ünï", "x\ty", "q▁r", *[f"w{k}" for k in range(40)]]
    small, large = alignment.Aligned(pair, kept=12), alignment.Aligned(pair)

    def listed(own) -> Counter:
        met = Counter()
        for keys, n in own.links():
            for k, m in zip(keys.tolist(), n.tolist(), strict=True):
                met[k] += m
        return met

    for _ in range(2):
        small.begin(), large.begin()
        counts, forgot = Counter(), 0
        for _ in range(60):
            texts, times = [" ".join(["often", *r.choices(words, k=4)]) for _ in range(3)] + ["", "often often "], np.array([1, 2, 1, 5, 3])
            if small.full():
                counts += listed(small)
                small.forget()
                forgot += 1
                assert " often" in small.numbers and len(small.groups) == len(small.numbers) <= 6
            assert small.texts(texts, times) == large.texts(texts, times)
        assert counts + listed(small) == listed(large) and forgot > 10


def test_tasks_of_a_run_share_what_a_worker_keeps(pair, monkeypatch):
    monkeypatch.setattr(alignment, "_OF_WORKER", {})
    monkeypatch.setattr(alignment, "Pair", lambda *files: pair)
    own = alignment.of_worker("one", ("", b""))
    own.texts(["a b"], np.ones(1, np.int64))
    assert alignment.of_worker("one", ("", b"")) is own and not own.column("uses").any() and len(own.numbers) == 2
    other = alignment.of_worker("two", ("", b""))
    assert other is not own and not other.numbers and list(alignment._OF_WORKER) == ["two"]
