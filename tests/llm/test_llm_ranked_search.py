import math
import random
import re
from collections import Counter

import odd_rows
import pytest
from pyspark.sql import functions as F

from dayloom.llm import ranked_search as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=10):
    """(item, rank, doc, score) by scoring every document for every item."""
    counts = [(key, Counter(terms(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        out += [(item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def sample(seed, n=150):
    rng = random.Random(seed)
    rare = [f"r{i}É" for i in range(80)]
    common = ["the", "Of", "and", "in", "to"]

    def text(size):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(size))

    docs = [text(rng.choice([1, 3, 10, 60, 200])) for _ in range(n)]
    docs += docs[:20] + ["the", "of the"]
    items = [text(rng.choice([1, 2, 8, 30])) for _ in range(12)] + ["the the of", "nowhere", ""]
    return list(enumerate(docs)), list(enumerate(items))


def found(spark, docs, items, cuts=3):
    frame = odd_rows.documents(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(cuts)
    wanted = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id bigint, text string, score double")
    out = R.best(frame, wanted)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_against_scoring_everything(spark):
    docs, items = sample(1)
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("block, sets, owners", [(16, 512, 4), (64, 5, 2), (2048, 512, 1)])
def test_in_blocks_and_sets(spark, monkeypatch, block, sets, owners):
    """Also with small blocks of documents, items in several sets, other numbers of stages."""
    monkeypatch.setattr(R, "DOCS", block)
    monkeypatch.setattr(R, "ITEMS", sets)
    monkeypatch.setattr(R, "OWNERS", owners)
    docs, items = sample(2, 100)
    assert found(spark, docs, items) == brute(docs, items)


def test_what_cannot_reach_the_best_is_dropped(spark, monkeypatch):
    """After the rare terms, a bundle holds fewer documents than have common ones."""
    docs, items = sample(3, 400)
    sizes = []
    whole = R.added

    def seen(postings, terms, rest, owner, places, scores, total):
        out = whole(postings, terms, rest, owner, places, scores, total)
        sizes.append((owner, len(out[0]), len(total)))
        return out

    _, counts = zip(*[(i, Counter(R.words_of(t.encode()))) for i, t in items if terms(t)])
    words = sorted({w for c in counts for w in c})
    numbers = {w: i for i, w in enumerate(words)}
    frame = odd_rows.documents(spark, [t for _, t in docs]).coalesce(1)
    sent = spark.sparkContext.broadcast(numbers)
    row = R.packed_blocks(frame, sent, "doc_id", "text").toArrow()
    n, total, holding = R.statistics(R.packed_blocks(frame, sent, "doc_id", "text"))
    search = R.search_of([{numbers[w]: k for w, k in c.items()} for c in counts], n, total, holding, len(words))
    postings = search.postings({c: row.column(c)[0] for c in row.column_names})
    most = {t: int(c.max()) for t, (_, c) in postings.items()}
    import numpy as np

    room = np.zeros(n, np.int64)
    for wanted in search.items:
        rest = [sum(k * most.get(t, 0) for t, k in wanted.items() if search.owner[t] == o) for o in range(R.OWNERS)]
        places, scores = np.zeros(0, np.int16), np.zeros(0, np.int64)
        for owner in range(R.OWNERS):
            mine = {t: p for t, p in postings.items() if search.owner[t] == owner}
            places, scores = seen(mine, wanted, rest, owner, places, scores, room)
            assert not room.any()
    assert min(size for owner, size, _ in sizes if owner == R.OWNERS - 1) <= R.TOP
    assert sum(size for owner, size, _ in sizes if owner == 2) < 0.5 * len(search.items) * n


def test_odd_rows(spark):
    docs = [(None, None), (0, ""), (1, " \n"), (2, "word"), (2, "word"), (None, "word two"), (7, "wörd " * 5000), (8, "two")]
    items = [(None, "word"), (0, None), (1, ""), (2, "wörd two"), (2, "wörd two"), (3, "TWO two")]
    assert found(spark, docs, items) == brute(docs, items)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert R.best(odd_rows.empty(spark), none.unionByName(spark.createDataFrame([(1, "a")], none.schema))).count() == 0
    assert R.best(odd_rows.odd(spark), none).count() == 0


def test_a_term_of_all_documents_is_cut_with_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "DOCS", 50)
    frame = odd_rows.documents(spark, ["the same word"] * 400)
    sent = spark.sparkContext.broadcast({b"same": 0})
    sizes = R.packed_blocks(frame, sent, "doc_id", "text").select(F.octet_length("places")).collect()
    assert len(sizes) >= 8 and max(r[0] for r in sizes) <= 100
