import random
from itertools import combinations

import numpy as np
import odd_rows
import pytest

from dayloom.llm import jaccard_join as J
from dayloom.llm.decontaminate import words_of


def brute(rows):
    """(class, links) of each row with an id, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = words_of((text or "").encode())
        size = min(5, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    lowest = {}
    for i, (key, _) in enumerate(rows):
        lowest[find(i)] = min(lowest.get(find(i), key), key)
    return sorted((key, lowest[find(i)], links[i]) for i, (key, _) in enumerate(rows))


def corpus(seed, groups=12, size=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(groups):
        base = passage * (rng.random() < 0.5) + [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


def joined(spark, rows):
    docs = odd_rows.documents(spark, [t for _, t in rows], [i for i, _ in rows])
    return sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect())


def test_runs_reach_the_recall():
    assert J.runs_for(0.999999) >= 10 and J.runs_for(0.9) < J.runs_for(0.99) <= 4


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(40):
        tokens = J._mixed(rng.integers(0, 2**63, 900).astype(np.uint64))
        a, b = J.signature(tokens[:850]), J.signature(tokens[50:])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 800 / 900) < 0.02


def test_against_all_pairs(spark):
    rows = corpus(7)
    assert joined(spark, rows) == brute(rows)


@pytest.mark.parametrize("leaf, depth", [(3, 0), (3, 3)])
def test_splitting_and_blocks_lose_nothing(spark, monkeypatch, leaf, depth):
    """With tiny leaves everything is split, and what stays together is compared in blocks."""
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "DEPTH", depth)
    rows = corpus(8, groups=6, size=10)
    assert joined(spark, rows) == brute(rows)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i + 1, i) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    edges = spark.createDataFrame(chain + star + [(7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in J.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)}


def test_odd_rows(spark):
    got = [(r.doc_id, r.class_id, r.n_links) for r in J.join(odd_rows.odd(spark, "word", "a b c d")).collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=key) == [
        (None, None, 0), (None, None, 0), (0, 0, 0), (1, 1, 0), (2, 2, 2), (2, 2, 2), (3, 3, 0), (10, 2, 2), (11, 11, 0),
    ]
    assert J.join(odd_rows.empty(spark)).count() == 0
    docs = odd_rows.odd(spark, "word", "a b c d")
    kept = J.one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [
        (True, i) for i in (0, 1, 2, 3, 11)
    ]
    assert kept.where("doc_id is null").count() == 2


def test_one_of_each_with_ids_that_repeat(spark):
    """The same id on different texts: each class keeps one row."""
    long = " ".join(f"v{i}" for i in range(60))
    docs = odd_rows.documents(spark, ["one two", "three four", "three four", long, long + " end"], [5, 5, 3, 4, 9])
    assert sorted((r.doc_id, r.text[:5]) for r in J.one_of_each(docs).collect()) == [(3, "three"), (4, "v0 v1"), (5, "one t")]
