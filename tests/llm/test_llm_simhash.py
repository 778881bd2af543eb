import random
import re

import numpy as np
import odd_rows
import pytest
import xxhash

from dayloom.llm import jaccard_join as J, simhash_dedup as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    size = min(3, len(words))
    hashes = [
        xxhash.xxh64(" ".join(words[i : i + size]).encode(), seed=42).intdigest() for i in range(len(words) - size + 1)
    ] if words else []
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(id, fingerprint, component) of each row, by comparing all pairs."""
    prints = [plain_fingerprint(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    lowest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lowest[find(i)] = min(lowest.get(find(i), key), key)
    return sorted(((key, f"{p:016x}", lowest.get(find(i))) for i, ((key, _), p) in enumerate(zip(rows, prints))), key=repr)


def found(spark, rows):
    docs = odd_rows.documents(spark, [t for _, t in rows], [i for i, _ in rows])
    out = S.near_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n // 6):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        for _ in range(6):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(rng.choice([" ", "\n", "\t  "]).join(text))
    return list(enumerate(rows))


def test_fingerprint_is_the_majority_of_bits():
    for _, text in [*corpus(1, 60), (0, None), (0, " \x0b\n"), (0, "one"), (0, "one Two"), (0, "a " * 70_000)]:
        assert S.fingerprint((text or "").encode().lower().split()) == plain_fingerprint(text)


def test_same_hash_as_the_built_in_function(spark):
    (row,) = spark.sql("select xxhash64('one two thrée') as h").collect()
    assert S.fingerprint("one two thrée".encode().split()) == row.h % 2**64


def clustered(seed, n, middles):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2**64, middles, dtype=np.uint64)[rng.integers(0, middles, n)]
    for _ in range(4):
        codes ^= np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(codes)


@pytest.mark.parametrize("n, middles", [(1, 1), (2, 1), (9, 1), (700, 2), (1500, 40)])
def test_index_finds_all_pairs(n, middles):
    codes = clustered(n, n, middles)
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    index = S.GrayIndex(codes)
    got = {(q, int(index.order[c])) for qs, cs in index.search(codes) for q, c in zip(qs.tolist(), cs.tolist())}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(apart <= 3))))
    later = [pair for qs, cs in index.search(index.codes, np.arange(len(codes))) for pair in zip(qs.tolist(), cs.tolist())]
    assert len(later) == len(set(later)) == (len(got) - len(codes)) // 2 and all(a < b for a, b in later)


def test_gray_neighbours_differ_in_one_bit():
    rank = S.gray_rank(np.arange(4096, dtype=np.uint64))
    by_rank = np.argsort(rank)
    assert sorted(rank.tolist()) == list(range(4096))
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


@pytest.mark.parametrize("leaf, depth", [(2048, 3), (16, 3), (16, 1), (4, 2)])
def test_links_in_small_and_split_nodes(spark, monkeypatch, leaf, depth):
    """Also with nodes that are split, and cut into blocks at the end."""
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "DEPTH", depth)
    codes = clustered(5, 120, 4)
    signed = codes.view(np.int64).tolist()
    frame = spark.createDataFrame([(c,) for c in signed], "fp bigint")
    got = {r.node: r.root for r in S.linked_codes(frame).collect()}
    root = np.arange(len(codes))
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
    S._hang(root, a, b)
    lowest = {}
    for i, r in enumerate(root.tolist()):
        lowest[r] = min(lowest.get(r, signed[i]), signed[i])
    want = {c: lowest[r] for c, r in zip(signed, root.tolist()) if lowest[r] != c}
    assert got == want


def test_against_all_pairs(spark):
    rows = corpus(3)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    texts = [(None, None), (0, ""), (1, " \n"), (2, "word"), (2, "word"), (None, "word"), (7, "wörd " * 5000), (None, "alone here now")]
    assert found(spark, texts) == brute(texts)
    assert S.near_duplicates(odd_rows.empty(spark)).count() == 0


def test_short_rows_are_written_in_few_files(spark, monkeypatch):
    wanted = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    written = []

    def settle(df, *files):
        out = settle_as_it_is(df, *files)
        written.append((out.columns, out.rdd.getNumPartitions()))
        return out

    settle_as_it_is = S.settle
    monkeypatch.setattr(S, "settle", settle)
    monkeypatch.setattr(J, "settle", settle)
    rows = corpus(11)
    docs = odd_rows.documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(30)
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        got = sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=repr)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == brute(rows)
    assert len(written) > 4 and {files for _, files in written} == {1}
