"""SimHash, decontamination and line dedup against brute force, and their defined cases."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from sitelens.llm import decontaminate, line_dedup, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def plain_fingerprint(text: str | None) -> int:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_is_the_stated_one():
    for text in ("", " \t\n", "one", "One two", "One TWO three", "Ä ä É x", "a a a a a a", prose(1, 400), "x\x0by\x0cz w", "a b c d e"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    want = {r["doc_id"]: ("%016x" % f, c) for r, f, c in zip(docs, fps, plain_components([r["doc_id"] for r in docs], fps), strict=True)}
    got = simhash.op7_simhash_near_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def chain(seed: int, n: int) -> np.ndarray:
    """Fingerprints in clusters and chains: each differs from an earlier one in one to five bits."""
    r = random.Random(seed)
    fps = [r.getrandbits(64)]
    while len(fps) < n:
        base = r.choice(fps) if r.random() < 0.9 else r.getrandbits(64)
        for _ in range(r.randint(1, 5)):
            base ^= 1 << r.randrange(64)
        fps.append(base)
    return np.unique(np.array(fps, np.uint64))


@pytest.mark.parametrize("direct", [7, 64, 100_000])
def test_link_finds_the_same_classes_however_rows_are_cut(direct):
    fps = chain(direct, 500)
    root = simhash.link(fps, direct=direct)
    want = plain_components(list(range(len(fps))), [int(x) for x in fps])
    assert root.tolist() == want


def test_links_and_components_over_dense_clusters(spark):
    fps = chain(5, 1500)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, len(fps))).collect()}
    signed = fps.view(np.int64).tolist()
    want = plain_components(signed, [int(x) for x in fps])
    assert [got.get(x, x) for x in signed] == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)}


def test_near_duplicates_defined_cases(spark):
    long = prose(3, 20_000)
    rows = [(1, None, "s"), (2, "", "s"), (3, "a b c", "s"), (3, "a b c", "s"), (4, "A B C", None), (None, "a b c", "s"), (5, long, "s"), (6, long, "t")]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (5, 5), (6, 5)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 3, 5]


def test_keep_one_tells_rows_apart_by_all_columns(spark):
    rows = [(1, prose(1, 40), "s", 1), (1, prose(2, 40), "s", 2), (None, prose(3, 40), "s", 3), (None, prose(3, 40), "s", 4), (None, prose(4, 40), "t", 5), (7, prose(4, 40), "t", 6), (8, prose(5, 40), "s", 7), (8, prose(5, 40), "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key int")
    kept = sorted((r["text"], r["doc_id"] or 0, r["key"]) for r in simhash.keep_one(docs).collect())
    assert [(t, d) for t, d, _ in kept] == sorted([(prose(1, 40), 1), (prose(2, 40), 1), (prose(3, 40), 0), (prose(4, 40), 7), (prose(5, 40), 8)])


def test_hot_segment_values_are_dealt_over_many_keys(spark):
    """Thousands of fingerprints share one segment: the same classes come out, however the keys are cut."""
    r = np.random.default_rng(4)
    fps = np.unique(np.concatenate([np.uint64(0xABCDEF01 << 32) | r.integers(0, 1 << 32, 600, np.uint64), np.uint64(0xABCDEF01) | r.integers(0, 1 << 32, 300, np.uint64) << np.uint64(32)]))
    fps = np.unique(np.concatenate([fps, fps[:200] ^ np.uint64(0b1011), fps[200:300] ^ np.uint64(1 << 40)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = [{(x["node"], x["root"]) for x in simhash.components(simhash.links(df, len(fps), hot)).collect()} for hot in (50, 10**9)]
    assert found[0] == found[1] and len(found[0]) >= 300
    assert simhash._keyed(df, 50).groupBy("key", "part").count().agg({"count": "max"}).first()[0] < 100


def shingles(text: str | None) -> set[str]:
    words = re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalnum() else " ", text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_contaminated(docs, items):
    out = set()
    for d, text, *_ in docs:
        own = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and 5 * len(s & own) >= 4 * len(s):
                out.add((d, i, len(s & own), len(s)))
    return out


def test_contamination_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = decontaminate.op6_benchmark_decontamination(spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got} == plain_contaminated(docs, items)
    assert got


@pytest.mark.parametrize("block", [1, 60, 1_000_000])
def test_contamination_of_scattered_and_altered_items(spark, block):
    r = random.Random(9)
    items = [(i, prose(100 + i, r.randint(1, 60))) for i in range(12)] + [(50, None), (51, ""), (52, prose(100, 5))]
    docs = []
    for d in range(60):
        words = items[d % 12][1].split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "zzz"
        cut = r.randint(0, len(words))
        docs.append((d, " ".join([prose(d, r.randint(0, 300)), *words[:cut], *(["gap"] if d % 3 == 0 else []), *words[cut:], prose(d + 500, 50)]).upper() + ".", "s"))
    docs += [(100, None, "s"), (101, "", "s"), (102, items[3][1], "s"), (102, items[3][1], "s")]
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_shingles=block).collect()
    assert {(x["doc_id"], x["item_id"], x["n_shared"], x["n_item"]) for x in got} == plain_contaminated(docs, items)
    left = decontaminate.drop_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    found = {x["doc_id"] for x in got}
    assert sorted(x["doc_id"] for x in left.collect()) == sorted(d for d, *_ in docs if d not in found)


def test_documents_are_dropped_row_by_row(spark):
    item = prose(100, 30)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, prose(1, 50)), (1, f"{prose(2, 50)} {item}"), (None, f"{prose(3, 50)} {item}"), (None, prose(4, 50)), (None, None), (5, "")]
    left = decontaminate.drop_contaminated(frame(spark, [(d, t, "s") for d, t in rows]), items).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(1, prose(1, 50)), (0, prose(4, 50)), (0, ""), (5, "")])


def test_sketches_lose_no_contained_item_and_prune_the_rest():
    """The threshold of sketch hits holds for every way to miss a fifth of an item; texts that share a few shingles are no candidates."""
    r = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 15, 16, 31, 40, 200):
        p = decontaminate.size_partition(n)
        k = min(decontaminate.sketch_length(p, 0.8), n)
        need = int(decontaminate.needed(np.array(n), 0.8))
        assert 1 <= k - (n - need) <= k
        for _ in range(50):
            missing = r.choice(n, n - need, replace=False)
            assert k - np.isin(missing, np.arange(k)).sum() >= k - (n - need)
    assert decontaminate.sketch_length(5, 0.8) < decontaminate.sketch_length(6, 0.8)


def test_items_without_an_id_are_searched(spark):
    items = spark.createDataFrame([(None, prose(100, 20)), (1, prose(101, 20))], "item_id long, text string")
    docs = frame(spark, [(1, f"{prose(1, 50)} {prose(100, 20)}", "s"), (2, f"{prose(2, 50)} {prose(101, 20)}", "s"), (3, prose(3, 50), "s")])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items, block_shingles=1).collect()}
    assert got == {(1, None), (2, 1)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()] == [3]


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, [(1, "a b c d e f", "s")]), items).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, []), one).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_line_dedup_equals_its_sql(spark, sf_dir, broadcast_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = line_dedup.drop_lines(docs, broadcast_rows=broadcast_rows).select("doc_id", "text", "n_lines", "n_dropped")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(line_dedup.OP10_SQL).fetchall())


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_line_dedup_defined_cases(spark, broadcast_rows):
    rows = [(i, f"menu\nown {i} {prose(i, 12)}\n\n  \nfoot", "a") for i in range(10)]
    rows += [(20, None, "a"), (21, "", "a"), (22, "menu", None), (23, "menu\r", "b")]
    # a page that is copied often is one page: its lines stay
    rows += [(100 + i, f"copied {prose(7, 30)}\nsecond line", "a") for i in range(50)]
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(frame(spark, rows), max_ratio=0.3, broadcast_rows=broadcast_rows).collect()}
    assert len(got) == len(rows)
    for i in range(10):
        assert got[i]["text"] == f"own {i} {prose(i, 12)}\n\n  "
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (5, 2)
    assert got[20]["text"] is None and got[21]["text"] == "" and got[22]["text"] == "menu"
    assert got[100]["text"] == rows[14][1] and got[100]["n_dropped"] == 0
    empty = line_dedup.drop_lines(frame(spark, []))
    assert empty.count() == 0 and empty.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_a_common_line_that_is_the_longest_of_its_pages_is_dropped(spark):
    licence = prose(1, 60)
    rows = [(i, f"Own sentence {i}.\n{licence}\nmenu", "a") for i in range(40)]
    got = line_dedup.drop_lines(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in got) == [(i, f"Own sentence {i}.", 2) for i in range(40)]
    counted = line_dedup.boilerplate(frame(spark, rows)).collect()
    assert sorted((r["pages"], r["host_pages"]) for r in counted) == [(40, 40), (40, 40)]
