import hashlib
import random
import re

import odd_rows
import pytest

from dayloom.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    ws, hit, found = words(text), set(), set()
    for item, content in items:
        its = words(content)
        size = min(10, len(its))
        windows = {tuple(its[i : i + size]) for i in range(len(its) - size + 1)} if its else set()
        for at in range(len(ws) - size + 1):
            if size and tuple(ws[at : at + size]) in windows:
                hit.update(range(at, at + size))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(ws), len(hit), len(found), digest, bool(hit)


def sample(seed, n=120):
    rng = random.Random(seed)
    letters = ["a", "B", "c", "é", "d1"]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 9, 10, 14, 30])))) for i in range(14)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            parts[rng.randint(0, len(parts)) :] = words(rng.choice(items)[1]) + parts[:5]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return items, texts


def test_words():
    assert D.words_of("Ab-c É1_x²\x7f中".encode()) == ["ab".encode(), b"c", "É1".encode(), "x²".encode(), "中".encode()]


@pytest.mark.parametrize("block_bytes", [4_000_000, 40])
def test_against_all_windows(spark, monkeypatch, block_bytes):
    """Also with the items in many blocks, one pass for each."""
    monkeypatch.setattr(D, "BLOCK_BYTES", block_bytes)
    items, texts = sample(4, 60 if block_bytes == 40 else 300)
    items = items[:6] if block_bytes == 40 else items
    docs = odd_rows.documents(spark, texts)
    rows = D.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == {i: brute(t, items) for i, t in enumerate(texts)}


def test_blocks_are_searched_for_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    items, texts = sample(4, 60)
    items = items[:6]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    written = []
    monkeypatch.setattr(D, "settle", lambda df, settle=D.settle: written.append(df.columns) or settle(df))
    clean = D.without_contaminated(odd_rows.documents(spark, texts), frame)
    assert clean._jdf.queryExecution().toString().count("MapInArrow") <= 4  # one stage in each form of the plan
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, t in enumerate(texts) if not brute(t, items)[4]]
    # The items are written once, and of the documents no more than digests and hits.
    assert [c for c in written if "text" in c] == [["block", "item", "text"]] and len(written) > 3
    blocks = [block() for block in D.item_blocks(frame)]
    assert sorted(i for block in blocks for i, _ in block) == [str(i) for i, _ in items] and len(blocks) > 1
    assert all(len(block) == 1 or sum(len(t) for _, t in block) <= 40 for block in blocks)


def test_odd_rows(spark):
    item = " ".join("abcdefghijkl")
    items = spark.createDataFrame([(None, None), (1, ""), (7, item), (7, item), (None, "word")], "item_id bigint, text string")
    docs = odd_rows.odd(spark, "x " + item.upper() + " y", " ".join("abcdefghi"))
    rows = D.contamination(docs, items).collect()
    assert len(rows) == 9
    assert sorted((r.doc_id, r.n_hit, r.items) for r in rows if r.contaminated) == [
        (2, 1, ["null"]), (2, 1, ["null"]), (10, 12, ["7"]),
    ]
    clean = D.without_contaminated(docs, items)
    assert clean.schema == docs.schema and clean.count() == 6
    assert D.contamination(odd_rows.empty(spark), items).count() == 0
    none = D.contamination(docs, items.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == 9
