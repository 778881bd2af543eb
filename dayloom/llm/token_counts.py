"""Token counts: merges of a byte-level BPE applied rank by rank to many words at once.

The new words of a batch are held as one ragged array of symbols. In every round
each word applies its lowest-ranked pair, at all places of the word at once; words
without a pair of the vocabulary are done and leave the array. What is left of a
word are its tokens; only their number is kept.

A word of more than `LONG` bytes would take a round over all its symbols for each rank
it uses. Its pairs are filed by rank instead: a round takes the pairs of the lowest
rank, applies them all, and files anew the pairs next to them.

Null and empty texts have no tokens. Texts are taken whole. The table of known runs
is emptied at `KNOWN_BYTES` and keeps no run of more than `KEPT` characters, so
that its size does not grow with the data.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dayloom.llm.tables import per_row, texts

# Bytes of known runs, about what Python adds to each, and the longest that is kept.
KNOWN_BYTES, PER_RUN, KEPT = 64_000_000, 130, 64
LONG = 256
# A batch of new words goes through the arrays in parts of at most this many bytes.
PART_BYTES = 4_000_000
_NONE = np.iinfo(np.int32).max
# White space for str.split(), but not for the vocabulary's pattern.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class Merges:
    """Ranked pairs of symbols; symbols are the byte values, those at a word's end 256 higher, then the merged ones."""

    def __init__(self, vocabulary: dict):
        model = vocabulary["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        end = model.get("end_of_word_suffix") or ""
        if not end or model.get("ignore_merges"):
            raise ValueError("only models with word ends are supported")
        letters = _byte_letters()
        number = {c: b for b, c in enumerate(letters)} | {c + end: 256 + b for b, c in enumerate(letters)}
        pairs = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = number.setdefault(a + b, len(number))
            pairs.append((number[a], number[b], rank, joined))
        table = np.array(pairs, np.int64).reshape(-1, 4)
        keys = table[:, 0] << 32 | table[:, 1]
        # A pair listed twice has its last rank.
        order = np.lexsort((table[:, 2], keys))
        last = np.append(keys[order][1:] != keys[order][:-1], True)
        self.keys, kept = keys[order][last], table[order][last]
        self.ranks, self.joined = kept[:, 2].astype(np.int32), kept[:, 3].astype(np.int32)

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, `_NONE` if it has none, and its place in the table."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], _NONE), place

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; words are not empty."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if short:
            out[short] = self._together([words[i] for i in short])
        for i in set(range(len(words))).difference(short) if len(short) < len(words) else ():
            out[i] = self._long(words[i])
        return out

    def _long(self, word: bytes) -> int:
        """Tokens of one long word; `after` and `before` lead from symbol to symbol."""
        symbols = np.frombuffer(word, np.uint8).astype(np.int64)
        symbols[-1] += 256
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.found(symbols[:-1], symbols[1:])[0], _NONE)
        filed: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def file(places: np.ndarray) -> None:
            places = places[rank[places] < _NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[places])) + 1
            for part in np.split(places, cuts) if len(places) else ():
                here = int(rank[part[0]])
                if here not in filed:
                    filed[here] = []
                    heapq.heappush(waiting, here)
                filed[here].append(part)

        file(np.arange(n - 1))
        left = n
        while waiting:
            lowest = heapq.heappop(waiting)
            at = np.unique(np.concatenate(filed.pop(lowest)))
            at = at[rank[at] == lowest]
            if not len(at):
                continue
            # Of pairs that overlap, every second one from the left.
            begins = np.append(True, after[at[:-1]] != at[1:])
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0]
            gone = after[at]
            _, place = self.found(symbols[at], symbols[gone])
            symbols[at] = self.joined[place]
            rank[gone] = _NONE
            after[at] = after[gone]
            follows = after[at] < n
            before[after[at][follows]] = at[follows]
            left -= len(at)
            near = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            last = after[near] >= n
            rank[near[last]] = _NONE
            near = near[~last]
            rank[near] = self.found(symbols[near], symbols[after[near]])[0]
            file(near)
        return left

    def _together(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[np.cumsum(lengths) - 1] += 256
        owner = np.repeat(np.arange(len(words)), lengths)
        left = lengths.copy()
        while len(symbols) > 1:
            rank, place = self.found(symbols[:-1], symbols[1:])
            rank = np.append(np.where(owner[1:] == owner[:-1], rank, _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            at = np.flatnonzero((rank == best) & (best < _NONE))
            if not len(at):
                break
            # Of pairs that overlap (equal symbols in a row), every second one from the left.
            begins = np.append(True, np.diff(at) != 1)
            offset = at - at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
            at = at[offset % 2 == 0]
            symbols[at] = self.joined[place[at]]
            np.subtract.at(left, owner[at], 1)
            active = best < _NONE
            active[at + 1] = False
            symbols, owner = symbols[active], owner[active]
        return left


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class TokenCounter:
    """Counts tokens as the vocabulary file at `path` defines them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        self.merges = Merges(vocabulary)
        steps = vocabulary["normalizer"]["normalizers"]
        cuts = vocabulary["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            raise ValueError("this normalisation or splitting is not supported")
        self.blank = regex.compile(steps[1]["pattern"]["Regex"])
        if not steps[1]["content"].isspace():
            raise ValueError("white space must stay white space")
        # No word holds white space; line ends keep the runs of a batch apart.
        self.word = regex.compile("\n|" + cuts[0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in vocabulary["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = {t[0] for t in special}
        self.known: dict[str, int] = {}
        self.held = 0

    def _runs(self, text: str) -> tuple[int, list[str]]:
        """(special strings, runs without white space) of a text; no word holds white space."""
        parts = [text] if not any(mark in text for mark in self.marks) else self.special.split(text)
        return len(parts) - 1, [run for part in parts for run in self._split(part)]

    def _split(self, part: str) -> list[str]:
        if any(c in part for c in _SEPARATORS):
            return self.blank.split(part)
        return part.split()

    def _learn(self, runs: list[str]) -> None:
        """Count the tokens of runs that are not known yet, in parts of bounded size."""
        at = 0
        while at < len(runs):
            begin, size = at, 0
            while at < len(runs) and (at == begin or size < PART_BYTES):
                size += len(runs[at])
                at += 1
            self.known.update(zip(runs[begin:at], self._count_runs(runs[begin:at])))

    def _count_runs(self, runs: list[str]) -> list[int]:
        joined = "\n".join(runs)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined)
        # Lower case goes letter by letter: no special form for a sigma at the end of a word.
        words = self.word.findall(joined.replace("Σ", "σ").lower())
        distinct = list(set(words) - {"\n"})
        count = {"\n": -1}
        if distinct:
            count.update(zip(distinct, self.merges.counts([w.encode() for w in distinct]).tolist()))
        tokens = np.fromiter(map(count.__getitem__, words), np.int64, len(words))
        ends = np.append(np.flatnonzero(tokens < 0), len(tokens))
        total = np.append(0, np.cumsum(np.maximum(tokens, 0)))[ends]
        return np.diff(total, prepend=0).tolist()

    def counts(self, batch: list[str]) -> list[int]:
        """Tokens of each text."""
        out, at = [], 0
        while at < len(batch):
            pieces, size = [], 0
            while at < len(batch) and size < PART_BYTES:
                pieces.append(self._runs(batch[at]))
                size += len(batch[at])
                at += 1
            if self.held > KNOWN_BYTES:
                self.known.clear()
                self.held = 0
            new = {run for _, runs in pieces for run in runs}.difference(self.known)
            self._learn(list(new))
            count = self.known.__getitem__
            out += [special + sum(map(count, runs)) for special, runs in pieces]
            for run in new:
                if len(run) > KEPT:
                    del self.known[run]
                else:
                    self.held += len(run) + PER_RUN
        return out


@functools.lru_cache(maxsize=1)
def token_counter(path: str) -> TokenCounter:
    """The counter of this process; what it has learnt serves the next task too."""
    return TokenCounter(path)


def token_counts(
    docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than `limit` tokens."""

    def compute():
        counter = token_counter(vocabulary_path)

        def work(column):
            batch = texts(column)
            tokens = counter.counts(batch)
            return [
                pa.array([len(t.encode()) for t in batch], pa.int64()), pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ]

        return work

    return per_row(docs, [id_column], [text_column], compute, "n_bytes bigint, n_tokens bigint, over_limit boolean")
