import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from dayloom.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, words array<int>, id string, box binary"


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """The nodes of the trie, from every prefix of every rebuilt conversation."""
    original = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            original[conv].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in original.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(who) - 1) * words
    return sorted(
        (
            (
                who[0], len(path), members[path[:-1]][0] if path else None, len(who), kids.get(path, 0), leaves[path], saved[path],
                hashlib.sha256(",".join(str(c) for c in who if len(built[c]) == len(path)).encode()).hexdigest(),
            )
            for path, who in members.items()
        ),
        key=repr,
    )


def found(spark, rows):
    out = T.trie(spark.createDataFrame([(*r, 1, [1], "i", b"b") for r in rows], SCHEMA))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def sample(seed, convs=150, long=0):
    """Conversations that branch often, with copies, missing heads of families and a few long ones."""
    rng = random.Random(seed)
    rows, copies = [], []
    for c in rng.sample(range(3 * convs), convs):
        turns = [rng.choice("ab") * rng.choice([1, 1, 2]) + " x" * rng.randint(0, 2) for _ in range(rng.randint(1, 7))]
        if copies and rng.random() < 0.4:
            turns = rng.choice(copies)[: rng.randint(1, 9)] + turns[: rng.randint(0, 2)]
        copies.append(turns)
        rows += [(c, i, "user" if i % 2 else "bot", t) for i, t in enumerate(turns)]
    shared = [rng.choice("ab") for _ in range(300)]
    for k in range(long):
        turns = shared[: rng.randint(100, 300)] + [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        rows += [(10_000 + 20 * k, i, "user", t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket, span, long", [(256, 64, 0), (4, 64, 0), (1, 4, 0), (3, 5, 6)])
def test_against_all_prefixes(spark, monkeypatch, bucket, span, long):
    """Also with containers that burst and conversations of many segments."""
    monkeypatch.setattr(T, "BUCKET", bucket)
    monkeypatch.setattr(T, "SPAN", span)
    monkeypatch.setattr(T, "PACKED", 3)
    rows = sample(span + bucket, 60 if long else 120, long)
    assert found(spark, rows) == brute(rows)


def test_one_conversation_and_copies(spark):
    rows = [(7, i, "user", f"t{i}") for i in range(200)]
    assert found(spark, rows) == brute(rows)
    rows = [(20 * k, i, "user", f"t {i}") for k in range(400) for i in range(3)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (20, None, "user", "first"), (20, 3, None, None), (20, 3, None, None), (20, 3, "", "b"),
        (21, 0, "user", ""), (22, 0, "user", "ü " * 3000), (23, 1, "x", "y"), (23, 1, "x", "a"), (-5, 0, "user", "neg"),
        (41, 0, "user", "own"), (42, 0, "user", "own"), (43, 0, "u", "1"), (43, 1, "u", "2"), (43, 2, "u", "3"), (43, 3, "u", "4"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(None, 0, "user", "lost")]) == []


def test_a_conversation_of_one_family_only(spark):
    rows = [(c, i, "user", f"{c} {i}" if i else "hello") for c in range(60) for i in range(c % 5)]
    assert found(spark, rows) == brute(rows)
