"""URL filter, language model and line classifier."""

import collections
import math
import random
import re
import zlib

import numpy as np
import odd_rows
import pytest

from dayloom.llm import elias_fano, line_crf as L, lm_scores as M, url_filter as U
from dayloom.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", 0.1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, score double")


def test_hosts_paths_and_rules(spark):
    rng = random.Random(2)
    bits = ["http", "://", "org", "com", "example.org", "www.", "EXAMPLE", ".", "/", "/es/", "/en/1", "/fr/", "/de/", "?", "#", "é", "É", "\n"]
    urls = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(400)]
    urls += [None, "", "://", "https://example.org", "https://a.example.org/en/12", "http://org/", "http://xorg/", "x://com/fr/?/de/"]
    rows = U.filter_urls(pages(spark, urls), URL_RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        best = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, best and best.text)
        assert best is None or r.verdict == ("allow" if best.allow else "block")
        assert r.verdict in ("allow", "block")


def probability(counts, context, symbol):
    """Witten-Bell by its recursion."""
    def at(order):
        if order < 0:
            return 1.0 / U.SYMBOLS
        key = context[len(context) - order :] if order else ()
        here = {k[-1]: 0 for k in counts}
        total = kinds = own = 0
        seen = collections.Counter()
        for gram, n in counts.items():
            if gram[U.ORDER - order : U.ORDER] == key:
                seen[gram[-1]] += n
        total, kinds, own = sum(seen.values()), len(seen), seen[symbol]
        return at(order - 1) if not total else (own + kinds * at(order - 1)) / (total + kinds)

    return at(U.ORDER)


def test_character_model_is_witten_bell():
    rng = random.Random(6)
    urls = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 9))).encode() for _ in range(30)]
    grams = collections.Counter()
    for u in urls:
        codes = [0] * U.ORDER + list(u.translate(U._CODES)) + [1]
        grams.update(tuple(codes[i : i + U.ORDER + 1]) for i in range(len(codes) - U.ORDER))
    numbers, begins = U.contexts(urls)
    assert len(numbers) == sum(grams.values()) and len(begins) == len(urls)
    table = U.log_probabilities(np.bincount(numbers, minlength=U.SYMBOLS ** (U.ORDER + 1)).astype(float))
    for gram in [*list(grams)[:20], (0, 0, 5, 7), (9, 9, 9, 9)]:
        place = 0
        for code in gram:
            place = place * U.SYMBOLS + code
        assert table[place] == pytest.approx(math.log(probability(grams, gram[:-1], gram[-1])))


def test_unseen_urls_are_judged_like_their_kind(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rules = [U.Rule(True, "good.net", "/"), U.Rule(False, "bad.net", "/")]
    urls = [f"http://{word()}.good.net/read/{word()}" for _ in range(300)] + [f"http://{word()}.bad.net/win-win/{word()}" for _ in range(300)]
    urls += [f"http://{word()}.net/read/{word()}" for _ in range(40)] + [f"http://{word()}.net/win-win/{word()}" for _ in range(40)]
    rows = {r.page_id: r for r in U.filter_urls(pages(spark, urls), rules).collect()}
    assert sum(rows[i].verdict == "allow" for i in range(600, 640)) >= 38
    assert sum(rows[i].verdict == "block" for i in range(640, 680)) >= 36


def test_query_fragment_and_urls_without_scheme_are_judged(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rules = [U.Rule(True, "good.net", "/"), U.Rule(False, "bad.net", "/")]
    urls = [f"http://{word()}.good.net/{word()}?read={word()}" for _ in range(300)]
    urls += [f"http://{word()}.bad.net/{word()}#win-win-{word()}" for _ in range(300)]
    urls += [f"http://{word()}.net/{word()}?read={word()}" for _ in range(40)] + [f"http://{word()}.net/{word()}#win-win-{word()}" for _ in range(40)]
    urls += ["www.a.good.net/abc?read=abcde", "www.a.bad.net/abc#win-win-abcde"]
    rows = {r.page_id: r for r in U.filter_urls(pages(spark, urls), rules).collect()}
    assert sum(rows[i].verdict == "allow" for i in range(600, 640)) >= 38
    assert sum(rows[i].verdict == "block" for i in range(640, 680)) >= 36
    assert (rows[680].host, rows[681].host) == ("", "") and rows[680].score > rows[681].score


def test_url_filter_without_examples(spark):
    assert U.filter_urls(pages(spark, []), URL_RULES).count() == 0
    rows = U.filter_urls(pages(spark, ["http://a.net/x", None, "y" * 50_000]), URL_RULES).collect()
    assert {r.verdict for r in rows} == {"allow"} and len(rows) == 3


@pytest.mark.parametrize("n, top", [(0, 10), (1, 0), (5, 3), (4096, 10**6), (10000, 2**63), (9000, 50), (20000, 2**40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n, dtype=np.uint64))
    if top > 10**6:
        values = np.unique(values)
    sequence = elias_fano.Sequence(b"12345678" + elias_fano.encode(values) + b"more", 8)
    assert (sequence.slice(0, len(values)) == values).all() and len(sequence) == len(values)
    for begin, end in ((0, 1), (100, 4500), (4096, 4096)):
        if end <= len(values):
            assert (sequence.slice(begin, end) == values[begin:end]).all()
    queries = np.concatenate([rng.integers(0, top + 2, 300, dtype=np.uint64), values[::7]])
    for asked in (np.sort(queries), np.sort(queries)[::97]):
        places, equal = sequence.successors(asked)
        want = np.searchsorted(values, asked)
        assert (places == want).all()
        assert equal.tolist() == [p < len(values) and values[p] == q for p, q in zip(want, asked)]


def model_by_brute_force(texts, contexts):
    """Scores with the same quantisation; texts are (id, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None], M.crc32(i) % 7 == 2) for i, t in texts]
    counts = collections.Counter(w for ws, held in rows if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    def rank(w):
        code = 1 if w is None else M.xxhash.xxh3_64_intdigest(w.encode())
        return -counts[w], code - 2**64 * (code >= 2**63)
    own = set(sorted(counts, key=rank)[:contexts])
    place = lambda w: w if w in own else "other"
    pairs, totals = collections.Counter(), collections.Counter()
    for ws, held in rows:
        for a, b in zip(["", *ws], ws) if not held else ():
            a = "start" if a == "" else ("word", place(a))
            pairs[a, b] += 1
            totals[a] += 1
    kinds = collections.Counter(a for a, _ in pairs)
    out = []
    for ws, held in rows:
        base = score = 0.0
        for a, b in zip(["", *ws], ws):
            a = "start" if a == "" else ("word", place(a))
            share = (counts[b] + 1) / (n + v + 1)
            p = share
            if totals[a]:
                p = M.DISCOUNT * kinds[a] / totals[a] * share
                if pairs[a, b]:
                    code = min(254, max(0, round(-math.log10((pairs[a, b] - M.DISCOUNT) / totals[a]) * M.STEPS)))
                    p += 10 ** (-code / M.STEPS)
            base += math.log10(share)
            score += math.log10(p)
        out.append((held, len(ws), sum(counts[w] > 0 for w in ws), n, base, score))
    return out


@pytest.mark.parametrize("contexts", [5, 1000])
def test_language_model(spark, monkeypatch, contexts):
    monkeypatch.setattr(M, "CONTEXTS", contexts)
    monkeypatch.setattr(M, "CHUNK_BYTES", 700)
    monkeypatch.setattr(M, "SHARD_TOKENS", 300)
    rng = random.Random(3)
    vocabulary = ["The", "the", "é", "cat", "dog", *map(str, range(60))]
    texts = [(i, " ".join(rng.choice(vocabulary[: rng.choice([3, 65])]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    texts += [(None, None), (3, "the the"), (200, "")]
    docs = odd_rows.documents(spark, [t for _, t in texts], [i for i, _ in texts])
    # The broadcast tables carry the small settings; tasks read the module's own.
    scores, tries = M.scored(docs)
    key = lambda r: (r[0], r[1], round(r[4], 6), round(r[5], 6), r[2])
    got = sorted(((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scores.collect()), key=key)
    want = sorted(model_by_brute_force(texts, contexts), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:])
    data = [bytes(r.trie) for r in tries.collect()]
    assert sum(len(M.Trie(t).contexts) for t in data) == sum(1 for _ in set_of_pairs(texts, contexts))


def scores_of(spark, texts):
    docs = odd_rows.documents(spark, [t for _, t in texts], [i for i, _ in texts])
    rows = M.scored(docs)[0].select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return {r.doc_id: tuple(r)[1:] for r in rows.collect()}


def assert_scores(got, texts):
    want = model_by_brute_force(texts, None)  # no limit: every word is a context
    assert len(got) == len(want)
    for (i, _), w in zip(texts, want):
        assert got[i][:4] == w[:4] and got[i][4:] == pytest.approx(w[4:])


def test_all_words_are_contexts_of_their_own(spark):
    rng = random.Random(13)
    # More words than are numbered, so that pairs of each kind occur; the last of them all equally rare.
    vocabulary = [f"w{i}" for i in range(M.__dict__.get("FREQUENT", 65_534) + 3000)]
    texts = [(i, " ".join(vocabulary[i::40])) for i in range(40)]
    texts += [(40 + i, " ".join(rng.choices(vocabulary, k=3000)) + " new words only") for i in range(10)]
    assert_scores(scores_of(spark, texts), texts)


@pytest.mark.parametrize("frequent", [0, 1, 8])
def test_numbered_words_change_no_score(spark, monkeypatch, frequent):
    monkeypatch.setattr(M, "FREQUENT", frequent)
    monkeypatch.setattr(M, "CHUNK_BYTES", 700)
    monkeypatch.setattr(M, "SHARD_TOKENS", 300)
    rng = random.Random(4)
    vocabulary = ["The", "the", "é", *map(str, range(60))]
    texts = [(i, " ".join(rng.choices(vocabulary[: rng.choice([3, 63])], k=rng.randint(0, 60)))) for i in range(90)]
    assert_scores(scores_of(spark, texts), texts)


def set_of_pairs(texts, contexts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(t or "").translate(lower).split() + [None] for i, t in texts if M.crc32(i) % 7 != 2]
    counts = collections.Counter(w for ws in rows for w in ws)
    def rank(w):
        code = 1 if w is None else M.xxhash.xxh3_64_intdigest(w.encode())
        return -counts[w], code - 2**64 * (code >= 2**63)
    own = set(sorted(counts, key=rank)[:contexts])
    return {("start" if a == "" else a if a in own else "other", b) for ws in rows for a, b in zip(["", *ws], ws)}


@pytest.fixture()
def many_parts(spark):
    """Shuffles in 30 parts that stay as they are."""
    wanted = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield 30
    for name, value in before.items():
        spark.conf.set(name, value)


def test_language_model_writes_few_files_and_no_table_of_all_words(spark, monkeypatch, many_parts):
    written = []

    def settle(df, *files):
        out = settle_as_it_is(df, *files)
        written.append((out.columns, out.rdd.getNumPartitions(), out))
        return out

    settle_as_it_is = M.settle
    monkeypatch.setattr(M, "settle", settle)
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices([*"abcdefgh", "The"], k=rng.randint(0, 40)))) for i in range(90)]
    docs = odd_rows.documents(spark, [t for _, t in texts], [i for i, _ in texts]).repartition(many_parts)
    rows = M.scored(docs)[0].select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert_scores({r.doc_id: tuple(r)[1:] for r in rows.collect()}, texts)
    assert [(columns, files) for columns, files, _ in written] == [
        (["chunk", "shard", "ids", "payload"], 1), (["chunk", "shard", "payload"], 1),
    ]
    # Small parts of the input are one chunk, not one for each part.
    assert written[0][2].count() == 1


def test_language_model_of_nothing(spark):
    assert M.scored(odd_rows.empty(spark))[0].count() == 0
    rows = M.scored(odd_rows.documents(spark, ["a b"], [next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)]))[0].collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(True, 3, 0, 0, 0.0, 0.0)]


# Line classifier

def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    field = L.LineField(rng.normal(size=L.FEATURES), rng.normal(size=(2, 2)), 0.5)
    counts = np.array([4, 1, 3])
    features = rng.normal(size=(8, L.FEATURES))
    marginals, pairs, log_sum = field.passes(features, counts)
    want, want_pairs, total, at = np.zeros((8, 2)), np.zeros((2, 2)), 0.0, 0
    for n in counts:
        rows = features[at : at + n] @ field.weights
        weights = {}
        for number in range(2**n):
            states = [(number >> i) & 1 for i in range(n)]
            weights[tuple(states)] = math.exp(
                sum(r * s for r, s in zip(rows, states)) + sum(field.transitions[a, b] for a, b in zip(states, states[1:]))
            )
        z = sum(weights.values())
        for states, w in weights.items():
            for i, s in enumerate(states):
                want[at + i, s] += w / z
            for a, b in zip(states, states[1:]):
                want_pairs[a, b] += w / z
        total += math.log(z)
        at += n
    assert marginals == pytest.approx(want) and pairs == pytest.approx(want_pairs) and log_sum == pytest.approx(total)


def test_features_look_at_neighbours():
    features, sizes, counts = L.line_features(["a b c d.\n\n###\nA! A!".encode(), b"", " \n".encode(), b"one"])
    assert counts.tolist() == [3, 0, 0, 1] and sizes.tolist() == [8, 3, 5, 3]
    own = 1 + L._OWN
    assert features[0, own + len(L._NEAR)] == features[1, 1] > 0  # the symbols of the next line
    assert features[3, own] == features[3, 1] == 0  # no neighbour: its own


def quality_corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts, marks = [], []
    for _ in range(n):
        good = rng.random() < 0.7
        lines = [" ".join(word() for _ in range(rng.randint(1, 12))).capitalize() + "." for _ in range(rng.randint(1, 8))]
        if not good:
            lines[1:] = [" ".join(word() + rng.choice(["***", "!!", "$$"]) for _ in range(12)) for _ in lines]
        texts.append("\n".join(lines))
        marks.append(int(good))
    return texts, marks


def test_classifier_on_held_out_rows(spark):
    texts, marks = quality_corpus(400, 5)
    docs = odd_rows.documents(spark, texts)
    known = odd_rows.labels(spark, list(enumerate(marks)))
    rows = {r.doc_id: r for r in L.quality_scores(docs, known).collect()}
    held = [i for i in rows if rows[i].held_out]
    assert held == [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([rows[i].predicted == marks[i] for i in held]) >= 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    turned = odd_rows.labels(spark, [(i, 1 - m if i in held else m) for i, m in enumerate(marks)])
    assert {r.doc_id: r.score for r in L.quality_scores(docs, turned).collect()} == {i: r.score for i, r in rows.items()}


def test_classifier_on_odd_rows(spark):
    docs = odd_rows.odd(spark, "line\n" * 5000)
    rows = L.quality_scores(docs, odd_rows.labels(spark, [])).collect()
    assert len(rows) == 8 and {r.score for r in rows} == {0.5}
    known = odd_rows.labels(spark, [(2, 1), (2, 1), (3, 0), (None, 1), (4, None), (77, 1)])
    assert L.quality_scores(docs, known).count() == 8
    assert L.quality_scores(odd_rows.empty(spark), known).count() == 0
    kept = L.good_documents(docs, known)
    assert kept.schema == docs.schema and kept.count() <= 8


def test_long_texts_are_learnt_from(spark, monkeypatch):
    texts, marks = quality_corpus(60, 6)
    long = [(t + "\n") * (600 // t.count("\n") if "\n" in t else 600) for t in texts]
    learnt = []
    train = L.train
    monkeypatch.setattr(L, "train", lambda samples: learnt.append(samples) or train(samples, rounds=5))
    known = odd_rows.labels(spark, [*enumerate(marks), *((i, 1) for i in range(1000, 1400))])
    L.fit(odd_rows.documents(spark, long), known)
    in_training = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(learnt[-1]) == len(in_training) and all(len(f) > 500 for f, _ in learnt[-1])
    # Labels without a document, or with an empty one, take no place in the sample.
    monkeypatch.setattr(L, "SAMPLE_ROWS", 20)
    L.fit(odd_rows.documents(spark, [*long, *[" \n", None] * 30]), odd_rows.labels(spark, [*enumerate(marks), *((i, 1) for i in range(60, 1400))]))
    assert len(learnt[-1]) == 20
    monkeypatch.setattr(L, "SAMPLE_LINES", 1500)
    L.fit(odd_rows.documents(spark, long), known)
    assert sum(len(f) for f, _ in learnt[-1]) == 1500
