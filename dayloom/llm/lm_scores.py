"""Language-model scores from n-gram tries in Elias-Fano form.

The model predicts a word from the one before it. Every training word is a context
of its own, and so is the start of a text. The probability of a word is its
discounted share in the context, plus what the discount has freed there times the
word's add-one share in the corpus:

    p(w | k) = (n(k, w) - D) / n(k)  [if seen]  +  D * T(k) / n(k) * (c(w) + 1) / (N + V + 1)

After a context without training text it is the share in the corpus alone.

How it runs: the most frequent words are numbered, in a table of bounded size that
all tasks hold with their counts; it saves bytes and spreads hot words, and changes
no score. All other words go by their hashes. Texts are cut into chunks of bounded
size. A chunk sends each pair of (word, context) in it once, with its training
count, to the shard of that pair: the counts of all texts, however often a pair
occurs, arrive as one row for each chunk and shard. A pair after a rare word goes
to the shard of that context, and the rare word's own count with it; else a rare
word's pair goes to the shard of the word, and pairs of two frequent words are
spread by both, so that no word fills a shard. A shard sums the counts, and so
knows n(k) and T(k) of its rare words, and builds its trie: the hashes of rare
words with cumulative n and T, the words, pointers to where each word's contexts
begin, and the contexts, all as monotone Elias-Fano sequences in one mapped
buffer, and one byte for the quantised probability of each pair. It then answers
the chunks' pairs, in order, by successor search: first for the word, then for the
context among those of the word, with n and T of its rare words. Chunks put the
answers together with what all texts share: N, V, and n and T of the numbered words. A trie
lives in the memory of the task that asks it; none is kept on disk.

Probabilities in the trie have steps of 1/16 in log10. Null and empty texts hold
the end token alone. With no training text at all, every count is 0. Ids may
repeat or be null; each row is scored alone. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import mmap
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dayloom.llm import elias_fano
from dayloom.llm.jaccard_join import groups
from dayloom.llm.tables import crc32, in_full_tasks, settle, slices, utf8

FOLDS, HELD_OUT = 7, 2
FREQUENT = 65_534  # words that are numbered: all tasks hold their counts
# Where set, only so many frequent words are numbered and contexts of their own, and all others are one context.
CONTEXTS: int | None = None
CHUNK_BYTES = 12_000_000
SHARD_TOKENS = 3_000_000
DISCOUNT = 0.75
STEPS = 16  # of a power of ten
_START, _OTHER, _FIRST = 0, 1, 2
_WIDTH = 1 << 17  # above the numbers of frequent words; from here on, places in a list of rare words
_LOW = (1 << 32) - 1
_END = np.uint64(1)  # the hash that stands for the end of a text
_UNSEEN = 255
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Chunk:
    """Texts as numbers of words: distinct hashes, frequent ones first; all tokens; tokens and training flag of each text."""

    hashes: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray
    training: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], training: list[bool]) -> Chunk:
        number: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        parts, lengths = [], []
        for text in texts:
            words = text.lower().split()
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            lengths.append(len(words) + 1)
        hashes = np.array([_END, *map(xxhash.xxh3_64_intdigest, number)], np.uint64)
        hashes, place = np.unique(hashes, return_inverse=True)
        tokens = place.astype(np.int32)[np.concatenate(parts)]
        del number, parts
        # Low numbers for frequent words: these compress.
        order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return cls(hashes[order], rank[tokens], np.array(lengths, np.int64), np.array(training, bool))

    def token_training(self) -> np.ndarray:
        return np.repeat(self.training, self.lengths)

    def pack(self) -> bytes:
        return _packed(self.hashes, self.tokens, self.lengths, self.training)

    @classmethod
    def unpack(cls, data: bytes) -> Chunk:
        return cls(*_unpacked(data, np.uint64, np.int32, np.int64, bool))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed buffer, their bytes apart by place, which compresses better."""
    raw = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    body = b"".join(raw)
    head = np.array([len(body), *map(len, arrays)], np.int64).tobytes()
    return head + pa.compress(body, "zstd", asbytes=True)


def _unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    size, *lengths = np.frombuffer(data, np.int64, 1 + len(kinds)).tolist()
    body = pa.decompress(data[8 * (1 + len(kinds)) :], size, "zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind, n in zip(kinds, lengths):
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        out.append(np.ascontiguousarray(raw).view(kind).ravel())
        at += n * width
    return out


@dataclass
class Contexts:
    """What all chunks and shards share: the frequent words in order of their hashes, with counts; N, V, texts."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    words: int
    ends: int
    shards: int
    pooled: bool  # whether all other words are one context

    def __post_init__(self) -> None:
        self.totals = np.zeros(_FIRST + len(self.hashes))
        self.totals[_START] = self.ends
        self.totals[_FIRST:] = self.counts
        if self.pooled:
            known_end = _END in self.hashes
            self.totals[_OTHER] = self.tokens - self.counts.sum() - (0 if known_end else self.ends)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Of each word, its number; `_OTHER` for rare words."""
        if not len(self.hashes):
            return np.full(len(hashes), _OTHER)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, place + _FIRST, _OTHER)

    def shard(self, mixed: np.ndarray) -> np.ndarray:
        return ((mixed * _ODD >> np.uint64(32)) % np.uint64(self.shards)).astype(np.int64)


@dataclass
class Pairs:
    """The rare words of a chunk in order of shard and hash, and its distinct (word, context) pairs in order of shard, word and context.

    A word is its number, or `_WIDTH` and its place among the chunk's rare hashes.
    """

    hashes: np.ndarray  # of the rare words, ascending
    own: np.ndarray  # places of the rare words, in order of shard
    own_shard: np.ndarray
    own_counts: np.ndarray  # in training texts
    shard: np.ndarray
    word: np.ndarray
    context: np.ndarray
    counts: np.ndarray  # in training texts
    of_token: np.ndarray  # of each token, its pair

    @classmethod
    def of(cls, chunk: Chunk, shared: Contexts) -> Pairs:
        numbers = shared.numbers(chunk.hashes)
        rare = np.flatnonzero(numbers == _OTHER)
        rare = rare[np.argsort(chunk.hashes[rare])]
        hashes = chunk.hashes[rare]
        words = numbers.astype(np.int64)
        words[rare] = _WIDTH + np.arange(len(rare))
        before = np.empty(len(chunk.tokens), np.int32)
        before[1:] = (numbers if shared.pooled else words)[chunk.tokens[:-1]]
        before[np.cumsum(chunk.lengths) - chunk.lengths] = _START
        # Places and counts in a chunk fit 32 bits, and what is done with goes before more is made.
        keys = words[chunk.tokens]
        keys <<= 32
        keys |= before
        del before
        keys, of_token = np.unique(keys, return_inverse=True)
        of_token = of_token.astype(np.int32)
        word, context = (keys >> 32).astype(np.int32), (keys & _LOW).astype(np.int32)
        del keys
        training = chunk.token_training()
        counts = np.bincount(of_token, training, len(word)).astype(np.int32)
        own_counts = np.bincount(chunk.tokens, training, len(chunk.hashes)).astype(np.int64)[rare]
        del training
        mixed = word.astype(np.uint64) * np.uint64(_WIDTH) + context.astype(np.uint64)
        for part in (word, context):
            by_hash = part >= _WIDTH
            mixed[by_hash] = hashes[part[by_hash] - _WIDTH]
        shard, own_shard = shared.shard(mixed), shared.shard(hashes)
        del mixed
        own, order = np.argsort(own_shard, kind="stable"), np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return cls(
            hashes, own, own_shard[own], own_counts[own], shard[order], word[order], context[order], counts[order],
            rank[of_token],
        )

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """(shard, the rare words and pairs for it), in order of the shards."""
        for shard in np.union1d(self.shard, self.own_shard):
            own = slice(*np.searchsorted(self.own_shard, [shard, shard + 1]))
            mine = slice(*np.searchsorted(self.shard, [shard, shard + 1]))
            word, context = self.word[mine], self.context[mine]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            # Words of other shards come along before a context of this one.
            listed = np.unique(np.concatenate([self.own[own], word[word >= _WIDTH] - _WIDTH]))
            counts = np.full(len(listed), -1, np.int32)
            counts[np.searchsorted(listed, self.own[own])] = self.own_counts[own]
            yield int(shard), _packed(
                self.hashes[listed], counts, _renumbered(word[first], listed).astype(np.int32),
                np.diff(np.append(first, len(word))).astype(np.int32), _renumbered(context, listed).astype(np.int32),
                self.counts[mine].astype(np.int32),
            )


def _renumbered(words: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Words whose places are in one list, by their places in the ascending part of it that `listed` gives."""
    return np.where(words < _WIDTH, words, _WIDTH + np.searchsorted(listed, words - _WIDTH))


# The trie of a shard

class Trie:
    """Rare words with n and T as contexts, and words, their contexts and quantised probabilities in one mapped buffer."""

    def __init__(self, data: bytes):
        self.memory = mmap.mmap(-1, max(len(data), 1))
        self.memory.write(data)
        at, levels = 0, []
        for _ in range(6):
            levels.append(elias_fano.Sequence(self.memory, at))
            at = levels[-1].end
        self.hashes, self.totals, self.kinds, self.words, self.pointers, self.contexts = levels
        self.codes = np.frombuffer(self.memory, np.uint8, len(self.contexts), at)
        self.width = _WIDTH + len(self.hashes)

    @staticmethod
    def build(
        hashes: np.ndarray, totals: np.ndarray, words: np.ndarray, contexts: np.ndarray, counts: np.ndarray,
        shared: Contexts,
    ) -> bytes:
        """From rare words with their counts, and training pairs, both in order."""
        new = np.append(True, words[1:] != words[:-1]) if len(words) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        # The contexts of a word stand after those of the word before: one monotone sequence.
        places = contexts + (np.cumsum(new) - 1) * (_WIDTH + len(hashes))
        rare = contexts >= _WIDTH
        kinds = np.bincount(contexts[rare] - _WIDTH, minlength=len(hashes))
        whole = np.empty(len(contexts))
        whole[rare] = totals[contexts[rare] - _WIDTH]
        whole[~rare] = shared.totals[contexts[~rare]]
        share = np.log10((counts - DISCOUNT) / np.maximum(whole, 1))
        codes = np.clip(np.rint(-share * STEPS), 0, _UNSEEN - 1).astype(np.uint8)
        levels = (
            hashes, np.append(0, np.cumsum(totals)), np.append(0, np.cumsum(kinds)), words[begins],
            np.append(begins, len(words)), places,
        )
        return b"".join([*map(elias_fano.encode, levels), codes.tobytes()])

    def rare_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word or -1, n, T) of ascending hashes."""
        words = np.full(len(hashes), -1, np.int64)
        both = np.zeros((2, len(hashes)), np.int64)
        if len(self.hashes):
            place, known = self.hashes.successors(hashes)
            words[known] = _WIDTH + place[known]
            for out, level in zip(both, (self.totals, self.kinds)):
                out[known] = np.diff(level.slice(0, len(level)).astype(np.int64))[place[known]]
        return words, both[0], both[1]

    def lookup(self, words: np.ndarray, pairs: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The code of each pair, for words in ascending order with `pairs` contexts each; -1 for what no training text has."""
        codes = np.full(len(contexts), _UNSEEN, np.uint8)
        if not len(self.words):
            return codes
        place, found = np.full(len(words), -1, np.int64), words >= 0
        place[found], equal = self.words.successors(words[found].astype(np.uint64))
        found[found] = equal
        asked = np.flatnonzero(np.repeat(found, pairs) & (contexts >= 0))
        wanted = np.repeat(place, pairs)[asked] * self.width + contexts[asked]
        at, equal = self.contexts.successors(wanted.astype(np.uint64))
        codes[asked[equal]] = self.codes[at[equal]]
        return codes


# Spark

def _flags(ids: pa.Array) -> list[bool]:
    return [crc32(i) % FOLDS != HELD_OUT for i in ids.to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Chunk]]:
    """(ids, chunk) of at most `CHUNK_BYTES` of text, or one text."""
    ids, texts, training, size = [], [], [], 0
    for batch in (part for full in batches for part in slices(full)):
        for key, flag, text in zip(batch.column(0).to_pylist(), _flags(batch.column(0)), utf8(batch.column(1))):
            if texts and size + len(text) > CHUNK_BYTES:
                yield ids, Chunk.of(texts, training)
                ids, texts, training, size = [], [], [], 0
            ids.append(key)
            texts.append(text)
            training.append(flag)
            size += len(text)
    if texts:
        yield ids, Chunk.of(texts, training)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) of the training words of each chunk."""
    for packed in (payload for batch in batches for payload in batch.column(0)):
        chunk = Chunk.unpack(packed.as_py())
        counts = np.bincount(chunk.tokens, chunk.token_training(), len(chunk.hashes)).astype(np.int64)
        some = counts > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.hashes[some].view(np.int64)), pa.array(counts[some])], names=["hash", "n"]
        )


def contexts_of(chunks: DataFrame) -> Contexts:
    """The bounded tables of the corpus: sums, and its most frequent words (ties by hash).

    One query asks for both, so that the counts of all words are shuffled once and written nowhere else.
    """
    counted = chunks.select("payload").mapInArrow(_count_words, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    ends = F.sum(F.when(F.col("hash") == int(_END), F.col("n")))
    sums = counted.agg(F.sum("n").alias("tokens"), F.count("*").alias("words"), ends.alias("ends"))
    top = counted.orderBy(F.desc("n"), "hash").limit(FREQUENT if CONTEXTS is None else CONTEXTS)
    found = top.unionByName(sums, allowMissingColumns=True).toArrow()
    top = found.filter(found["hash"].is_valid())
    (sums,) = found.filter(found["hash"].is_null()).select(["tokens", "words", "ends"]).to_pylist()
    hashes, counts = top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hashes)
    tokens = sums["tokens"] or 0
    shards = tokens // SHARD_TOKENS + 1
    return Contexts(hashes[order], counts[order], tokens, sums["words"], sums["ends"] or 0, shards, CONTEXTS is not None)


def _encode(kind: pa.DataType):
    """Chunks, numbered by task and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for serial, (ids, chunk) in enumerate(_chunks(batches)):
            number = TaskContext.get().partitionId() << 32 | serial
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([-1], pa.int64()), pa.array([ids], kind),
                    pa.array([chunk.pack()], pa.binary()),
                ],
                names=["chunk", "shard", "ids", "payload"],
            )

    return run


_ROUTED = "chunk bigint, shard bigint, payload binary"


def _ask(shared):
    """The pairs of each chunk, one row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for number, packed in zip(batch.column("chunk").to_pylist(), batch.column("payload")):
                questions = Pairs.of(Chunk.unpack(packed.as_py()), tables).questions()
                while part := list(itertools.islice(questions, 64)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number] * len(part), pa.int64()), pa.array([s for s, _ in part], pa.int64()),
                            pa.array([p for _, p in part], pa.binary()),
                        ],
                        names=["chunk", "shard", "payload"],
                    )

    return run


def _answer(shared, tries: bool = False):
    """Of each shard, answers to the chunks and in how many pairs each numbered context is (chunk -1); or else its trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for group in groups(batches, "shard"):
            chunks, shard = group.column("chunk").to_pylist(), group.column("shard")[0].as_py()
            asked = [_unpacked(p.as_py(), np.uint64, *[np.int32] * 5) for p in group.column("payload")]
            payloads, trie_data, kinds = _answers(asked, tables)
            chunks, payloads = ([-1], [trie_data]) if tries else ([*chunks, -1], [*payloads, kinds])
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), pa.array([shard] * len(chunks), pa.int64()), pa.array(payloads, pa.binary())],
                names=["chunk", "shard", "payload"],
            )

    return run


def _answers(asked: list, tables: Contexts) -> tuple[list[bytes], bytes, bytes]:
    """(answer to each chunk, trie of all training pairs, in how many of them each numbered context is).

    All chunks' pairs are put in order once, and looked up in one pass over the trie.
    """
    hashes = np.unique(np.concatenate([a[0] for a in asked]))
    totals = np.zeros(len(hashes), np.int64)
    keys, owned = [], []
    for listed, own, words, pairs, contexts, _ in asked:
        places = np.searchsorted(hashes, listed)
        owned.append(places[own >= 0])
        totals[owned[-1]] += own[own >= 0]
        names = np.append(np.arange(_WIDTH), _WIDTH + places)
        keys.append(np.repeat(names[words], pairs) << 32 | names[contexts])
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    place = place.astype(np.int32)
    counts = np.bincount(place, np.concatenate([a[5] for a in asked]), len(keys)).astype(np.int64)
    words, contexts, trained = (keys >> 32).astype(np.int32), (keys & _LOW).astype(np.int32), counts > 0
    del keys
    used = totals > 0
    for part in (words[trained], contexts[trained]):
        used[part[part >= _WIDTH] - _WIDTH] = True
    kept = np.append(np.arange(_WIDTH), _WIDTH + np.cumsum(used) - 1)
    trie_data = Trie.build(
        hashes[used], totals[used], kept[words[trained]], kept[contexts[trained]], counts[trained], tables
    )
    trie = Trie(trie_data)
    rare, n, kinds = trie.rare_words(hashes)
    names = np.append(np.arange(_WIDTH), rare)
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    codes = trie.lookup(names[words[first]], np.diff(np.append(first, len(words))), names[contexts])
    answers, at = [], 0
    for mine, (_, _, _, _, of_chunk, _) in zip(owned, asked):
        answers.append(_packed(n[mine], kinds[mine], codes[place[at : at + len(of_chunk)]]))
        at += len(of_chunk)
    numbered, times = np.unique(contexts[trained & (contexts < _WIDTH)], return_counts=True)
    return answers, trie_data, _packed(numbered.astype(np.int64), times.astype(np.int64))


def _spread_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0):
            kinds, n = _unpacked(payload.as_py(), np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["context", "n"])


def _of_words(words: np.ndarray, numbered: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Of each word, what belongs to its number or to its place among the rare words."""
    by_number = words < _WIDTH
    out = np.empty(len(words))
    out[by_number] = numbered[words[by_number]]
    out[~by_number] = rare[words[~by_number] - _WIDTH]
    return out


def _finish(shared, freed, kind: str):
    """Scores of the texts of each chunk, from its tokens and the shards' answers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, kinds = shared.value, freed.value
        loose = np.where(tables.totals > 0, DISCOUNT * kinds / np.maximum(tables.totals, 1), 1.0)
        shares = np.append(10.0 ** (-np.arange(_UNSEEN) / STEPS), 0.0)
        whole = tables.tokens + tables.words + 1.0
        for group in groups(batches, "chunk"):
            ids = group.column("ids")[0].as_py()
            payloads = group.column("payload").to_pylist()
            chunk = Chunk.unpack(payloads[0])
            pairs = Pairs.of(chunk, tables)
            answers = [_unpacked(p, np.int64, np.int64, np.uint8) for p in payloads[1:]]
            n, freed_here = np.zeros((2, len(pairs.own)), np.int64)
            n[pairs.own] = np.concatenate([a[0] for a in answers])
            freed_here[pairs.own] = np.concatenate([a[1] for a in answers])
            codes = np.concatenate([a[2] for a in answers])
            counts = _of_words(pairs.word, tables.totals, n)
            base = (counts + 1.0) / whole
            rare_loose = np.where(n > 0, DISCOUNT * freed_here / np.maximum(n, 1), 1.0)
            likely = shares[codes] + _of_words(pairs.context, loose, rare_loose) * base
            begins = np.cumsum(chunk.lengths) - chunk.lengths
            known = (counts > 0)[pairs.of_token]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, kind), pa.array(~chunk.training), pa.array(chunk.lengths),
                    pa.array(np.add.reduceat(known.astype(np.int64), begins)),
                    pa.array(np.full(len(ids), tables.tokens, np.int64)),
                    pa.array(np.add.reduceat(np.log10(base)[pairs.of_token], begins)),
                    pa.array(np.add.reduceat(np.log10(likely)[pairs.of_token], begins)),
                ],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row of scores for each document, the tries of all shards as (shard, trie), built anew when asked for)."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    spark, id_type = docs.sparkSession, texts.schema["id"].dataType.simpleString()
    arrow_id = _arrow_type(texts)
    chunks = settle(
        in_full_tasks(texts, "text", CHUNK_BYTES).mapInArrow(_encode(pa.list_(arrow_id)), f"chunk bigint, shard bigint, ids array<{id_type}>, payload binary")
    )
    tables = contexts_of(chunks)
    shared = spark.sparkContext.broadcast(tables)
    asked = (
        chunks.select("chunk", "payload").mapInArrow(_ask(shared), _ROUTED)
        .repartition(tables.shards, "shard").sortWithinPartitions("shard")
    )
    answered = settle(asked.mapInArrow(_answer(shared), _ROUTED), tables.shards)
    kinds = (
        answered.where(F.col("chunk") == -1).select("payload").mapInArrow(_spread_kinds, "context bigint, n bigint")
        .groupBy("context").agg(F.sum("n").alias("n")).toArrow()
    )
    per_context = np.zeros(len(tables.totals))
    per_context[kinds["context"].to_numpy()] = kinds["n"].to_numpy()
    freed = spark.sparkContext.broadcast(per_context)
    together = chunks.unionByName(answered.where(F.col("chunk") >= 0), allowMissingColumns=True)
    scores = (
        together.repartition("chunk").sortWithinPartitions("chunk", "shard").mapInArrow(
            _finish(shared, freed, arrow_id),
            f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double",
        ).withColumnRenamed("id", id_column)
    )
    tries = asked.mapInArrow(_answer(shared, True), _ROUTED).select("shard", F.col("payload").alias("trie"))
    return scores, tries


def _arrow_type(texts: DataFrame) -> pa.DataType:
    return texts.select("id").limit(0).toArrow().schema.field("id").type
