"""Personal data and quality rules: brute force, and plans without Python."""

import collections
import hashlib
import random
import re
from functools import reduce

import odd_rows
from pyspark.sql import functions as F

from dayloom.llm import pii, quality_rules as Q


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (
        "card", r"[0-9]([\x20-]?[0-9])+",
        lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m)),
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m.group())]
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_personal_data_against_plain_patterns(spark):
    rng = random.Random(9)
    parts = [
        "a", "é", "@", ".", "-", "_", "+", " ", "1", "12", "255", "256", "0", "4111 1111 1111 1111", "b.co", "x@y.zz",
        "+1 (017) 555-7713", "10.0.0.1", "\n", "999", "(", "4539-1488-0343-6467", "%", "😀",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2500)]
    rows = {r.doc_id: r for r in pii.personal_data(odd_rows.documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        for k, (name, _, _) in enumerate(BASE):
            assert rows[i][f"n_{name}"] == sum(s.startswith(name) for s in want.split(","))
        assert set(filter(None, want.split(","))) <= set(rows[i].spans.split(","))


def test_checksums_and_context_add_spans(spark):
    texts = [
        "pay to DE89 3704 0044 0532 0130 00 now", "pay to DE89 3704 0044 0532 0130 01 now", "GB82WEST12345698765432",
        "ssn 078-05-1120", "part 078-05-1120", "call (017) 555-7713", "+1 (017) 555-7713",
    ]
    rows = {r.doc_id: r for r in pii.personal_data(odd_rows.documents(spark, texts)).collect()}
    assert [rows[i].spans for i in range(7)] == [
        "iban:7:34", "", "iban:0:22", "ssn:4:15", "", "local_phone:5:19", "phone:0:17",
    ]
    assert rows[3].scores == "60" and rows[0].scores == "90"


def test_personal_data_on_odd_rows(spark):
    docs = odd_rows.odd(spark, "1." * 30_000, "9" * 60_000, "a" * 60_000 + "@", "1 " * 5_000 + "x@y.z")
    found = pii.personal_data(docs)
    rows = found.collect()
    assert len(rows) == 11 and no_python(found)
    assert {r.doc_id: r.n_ip for r in rows if r.doc_id == 10} == {10: 7_500}
    assert {r.doc_id: (r.n_email, r.n_card) for r in rows if r.doc_id == 13} == {13: (1, 0)}
    assert pii.personal_data(odd_rows.empty(spark)).count() == 0


def test_many_spans_in_one_text(spark):
    """More spans than a block of blocks holds, and words nearby on both sides of a piece's border."""
    many = " ".join(f"é user{i}@mail.org, 10.0.{i % 300}.7 and 078-05-{i:04d}" for i in range(5000))
    lines = [f"{'é' * pad} ssn: 078-05-1120 {'x' * 30}" for pad in range(200, 300)]
    lines += [f"{'é' * pad} 078-05-1120 is the ssn" for pad in range(200, 300)]
    lines += [f"{'é' * pad} ssn {'x' * 40} 078-05-1120 {'x' * 20} ssn" for pad in range(200, 300)]
    rows = {r.doc_id: r for r in pii.personal_data(odd_rows.documents(spark, [many, *lines])).collect()}
    assert rows[0].base_sha256 == hashlib.sha256(base_spans(many).encode()).hexdigest()
    assert (rows[0].n_email, rows[0].n_ip) == (5000, 5000 - sum(i % 300 > 255 for i in range(5000)))
    for i, line in enumerate(lines):
        at = line.index("078")
        want = f"ssn:{at}:{at + 11}" if i < 200 else ""
        assert (rows[i + 1].spans, rows[i + 1].scores) == (want, "60" if want else "")


def test_added_spans_inside_base_spans_go(spark):
    rng = random.Random(3)
    parts = ["+1 (017) 555-7713", "(017) 555-7713", " phone ", "078-05-1120", " ssn ", "+49 ", "GB82WEST12345698765432", "@x.org", "é", ", "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(400)]
    for row in pii.personal_data(odd_rows.documents(spark, texts)).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]
        base = [s for s in spans if s[0] in dict((name, 0) for name, _, _ in BASE)]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in base) == base_spans(texts[row.doc_id])
        assert not [s for s in spans if s not in base and any(b[1] <= s[1] and s[2] <= b[2] for b in base)]


def counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(ws, ws[1:], ws[2:]))
    often = collections.Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(ws) < 50 or 100 * len(covered) > 50 * len(ws),
    )


def test_quality_counts(spark):
    rng = random.Random(4)
    parts = ["a", "b", "c", "é", "#", "$$", "\n", "\t", " ", "  ", "\x0b", "\xa0", "long word", "x y z", "\n\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(600)] + ["", "a", "\n"]
    rows = {r.id: r for r in Q.measured(odd_rows.documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text), text


def labelled(n, seed):
    rng = random.Random(seed)
    texts, marks = [], []
    for _ in range(n):
        kind = rng.choice(["good", "good", "symbols", "shouts"])
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        if kind == "symbols":
            words = [w + rng.choice(["***", "$$$", "##"]) for w in words]
        if kind == "shouts":
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words) + ("" if rng.random() < 0.7 else " & co."))
        marks.append(int(kind == "good"))
    return texts, marks


def jobs_of(spark, run):
    """How many jobs `run()` starts."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_repeats_with_digests_that_collide(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["u v w " * 40]
    docs = odd_rows.documents(spark, texts)
    # Two bits of each digest; then digests whole but places that do not fit; then as it is.
    for bits in (62, 3, Q.PLACE_BITS):
        monkeypatch.setattr(Q, "PLACE_BITS", bits)
        found = {r.id: r.n_repeat_words for r in Q.measured(docs).collect()}
        assert found == {i: counts(text)[4] for i, text in enumerate(texts)}, bits


def test_words_of_a_text_are_listed_once(spark):
    """Texts are split, and each pattern is applied to them, once; no step is worked out again for the next."""
    plan = Q.measured(odd_rows.documents(spark, ["a"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1 and plan.count("array_distinct(windows") + plan.count("array_distinct(w#") == 1
    assert len(re.findall(r"regexp_replace\(text#", plan)) == 1 and len(re.findall(r"split\(text#", plan)) == 2


def test_rules_part_good_from_bad(spark):
    texts, marks = labelled(500, 1)
    docs = odd_rows.documents(spark, texts)
    known = odd_rows.labels(spark, [(i, m) for i, m in enumerate(marks[:350])] + [(3, marks[3]), (None, 0), (4, None)])
    judged = Q.judged(docs, known)
    kept = {r.doc_id: r.kept for r in judged.collect()}
    wrong = [i for i in range(350, 500) if kept[i] != bool(marks[i])]
    assert len(wrong) <= 2 and no_python(judged)
    rules = {r.rule for r in judged.select("rule").distinct().collect()} - {None}
    assert rules and all(" > " in r or " <= " in r for r in rules)


def test_a_stated_list_is_found_again(spark):
    """From cells of a known conjunction, the same conjunction is learnt."""
    rows = []
    for a in range(17):
        for b in range(17):
            bad = a >= 9 and b < 5
            for prune in (False, True):
                rows.append((a, b, *[0] * (len(Q.GRID) - 2), prune, 7 if bad else 0, 0 if bad else 7))
    names = ", ".join(f"{f} int" for f in Q.GRID)
    cells = spark.createDataFrame(rows, f"{names}, prune boolean, bad bigint, good bigint")
    rules = Q.learn(cells)
    first, second = list(Q.GRID)[:2]
    assert len(rules) == 1 and {(c.feature, c.above) for c in rules[0]} == {(first, True), (second, False)}
    covered = cells.where(Q._covered(rules[0])).agg(F.sum("bad"), F.sum("good")).first()
    total = cells.agg(F.sum("bad")).first()[0]
    assert covered[1] == 0 and covered[0] >= 0.7 * total


def kinds_in_cells(spark, kinds, good=(3, 3, 3, 3, 3, 3, 6)):
    """Cells of good texts and of one kind of bad texts for each ({feature: bin}, bad, good when growing, when pruning)."""
    names, rows = list(Q.GRID), []
    for prune in (False, True):
        rows.append((*good, prune, 0, 500))
        for bins, bad, *mixed in kinds:
            rows.append((*[bins.get(f, g) for f, g in zip(names, good)], prune, bad, mixed[prune]))
    return spark.createDataFrame(rows, ", ".join(f"{f} int" for f in names) + ", prune boolean, bad bigint, good bigint")


def test_a_candidate_that_fails_hides_no_other(spark):
    noisy, pure = ({"symbol_share": 14}, 60, 0, 10), ({"digit_share": 14}, 50, 0, 0)
    assert [[c.feature for c in rule] for rule in Q.learn(kinds_in_cells(spark, [pure]))] == [["digit_share"]]
    assert [[c.feature for c in rule] for rule in Q.learn(kinds_in_cells(spark, [noisy, pure]))] == [["digit_share"]]
    assert Q.learn(kinds_in_cells(spark, [noisy])) == []


def test_as_many_rules_as_kinds_and_as_many_conditions_as_needed(spark):
    above = [({f: len(t)}, 50, 0, 0) for f, t in Q.GRID.items()]
    kinds = [*above, ({"word_length": 0}, 50, 0, 0), ({"symbol_share": 0, "repeat_share": 0}, 50, 0, 0)]
    alone = [({f: 0}, 0, 300, 300) for f in ("symbol_share", "repeat_share")]
    cells = kinds_in_cells(spark, [*kinds, *alone])
    rules = Q.learn(cells)
    assert len(rules) == 9
    covered = reduce(lambda a, b: a | b, map(Q._covered, rules))
    assert cells.where(covered).agg(F.sum("bad"), F.sum("good")).first() == (900, 0)
    first = list(Q.GRID)[:4]
    corner = [({f: 14 for f in first}, 50, 0, 0)]
    sides = [({f: 14 for f in first if f != out}, 0, 300, 300) for out in first]
    (rule,) = Q.learn(kinds_in_cells(spark, [*corner, *sides]))
    assert {c.feature for c in rule} == set(first)


def test_bad_texts_like_good_ones_end_the_search(spark, monkeypatch):
    """No condition parts them; one that all texts fulfil is no condition to go on with."""
    alike, pure = ({}, 20, 0, 0), ({"digit_share": 14}, 50, 0, 0)
    assert Q.learn(kinds_in_cells(spark, [alike])) == []
    assert [[c.feature for c in rule] for rule in Q.learn(kinds_in_cells(spark, [alike, pure]))] == [["digit_share"]]
    monkeypatch.setattr(Q, "HELD_CELLS", 0)
    assert Q.learn(kinds_in_cells(spark, [alike])) == []


def noisy_cells(spark):
    rng = random.Random(8)
    rows = [
        (*(rng.randint(0, len(t)) for t in Q.GRID.values()), rng.random() < 0.4, rng.choice([0, 0, 0, 2, 9]), rng.choice([0, 1, 4]))
        for _ in range(400)
    ]
    return spark.createDataFrame(rows, ", ".join(f"{f} int" for f in Q.GRID) + ", prune boolean, bad bigint, good bigint")


def test_learning_takes_as_many_jobs_for_any_number_of_candidates(spark):
    cells = noisy_cells(spark).checkpoint()
    assert jobs_of(spark, lambda: Q.learn(cells)) <= 6


def test_the_same_rules_from_cells_held_and_from_a_table(spark, monkeypatch):
    noisy, pure = ({"symbol_share": 14}, 60, 0, 10), ({"digit_share": 14, "word_length": 0}, 50, 0, 0)
    cells = kinds_in_cells(spark, [noisy, pure])
    held = Q.learn(cells)
    monkeypatch.setattr(Q, "HELD_CELLS", 3)
    assert len(held) == 1 and Q.learn(cells) == held


def test_a_list_of_very_many_rules(spark):
    thresholds = [i / 400 for i in range(399, 0, -1)]
    rules = [(Q.Condition("digit_share", True, t),) for t in thresholds]
    rows = spark.createDataFrame([(0.001,), (0.701,), (0.003,)], "digit_share double").select(Q.rule_of(rules).alias("rule"))
    assert [r.rule for r in rows.collect()] == [None, "digit_share > 0.7", "digit_share > 0.0025"]


def test_quality_rules_on_odd_rows(spark):
    docs = odd_rows.odd(spark, "w " * 30_000)
    rows = Q.judged(docs, odd_rows.labels(spark, [])).collect()
    assert len(rows) == 8 and not any(r.kept for r in rows)
    assert {r.n_repeat_words for r in rows if r.doc_id == 10} == {30_000}
    assert Q.judged(odd_rows.empty(spark), odd_rows.labels(spark, [(1, 0)])).count() == 0
