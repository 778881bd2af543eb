"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks over a text and keeps, for every position in a window as long as
the longest piece, the piece that ends there on the best path, as a backpointer.
When the paths of all positions in the window go back to one boundary, nothing
that follows can change what lies before it: its ids are committed and forgotten.

What makes a path the best one follows the model:

* unigram: the highest sum of the pieces' log-probabilities;
* BPE: the path that the merges would give. A row of pieces is what the merges
  give exactly if each two neighbours are, so a path may go from one piece to the
  next only if no merge would cross their border. One piece ends each prefix, and
  the search needs no scores.

Ids equal those of the library for the same model file. Where every piece of the
vocabulary is spaces followed by letters only or by other characters only, no
piece crosses a border between two such runs, so all paths meet there: runs are
then committed one by one, and known runs are looked up.

Null and empty texts have no ids and decode to the empty text. A U+2581 in a text
is the same symbol as a space and decodes to one. The table of known runs is
emptied when it is full.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dayloom.llm.tables import per_row, texts

SPACE = "▁"
# Borders that are remembered; bytes of known runs, about what Python adds to each, and the longest that is kept.
KNOWN_BORDERS = 400_000
KNOWN_BYTES, PER_RUN, KEPT = 64_000_000, 150, 64
PART_CHARS = 2_000_000
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
# Spaces, and then either letters or other characters.
_ONE_CLASS = regex.compile(rf"{SPACE}*(?:\p{{L}}*|[^\p{{L}}{SPACE}]*)")
_RUNS = regex.compile(r" *\p{L}+| *[^\p{L} ]+| +")


def _fields(message: bytes):
    """(number, value) of a serialised message: integers, 4-byte and length-delimited values."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


class PieceModel:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores = []
        for message in (value for number, value in parts if number == 1):
            fields = dict(_fields(message))
            self.pieces.append(fields[1].decode())
            scores.append(struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0)
            self.kinds.append(fields.get(3, _NORMAL))
        trainer = dict(_fields(next((v for n, v in parts if n == 2), b"")))
        normaliser = dict(_fields(next((v for n, v in parts if n == 3), b"")))
        self.is_bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2) or _USER in self.kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only models that leave texts as they are and escape spaces are supported")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.unknown = self.kinds.index(_UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.cuts = all(_ONE_CLASS.fullmatch(p) for p in self.ids)
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self.length = [len(p) for p in self.pieces]
        if self.is_bpe:
            self._learn_splits()
        self.ends = self._trie_of_ends()
        self.known: dict[str, bytes] = {}
        self.held = 0
        # Of each id, the bytes it decodes to, in one buffer.
        out = []
        for piece, kind in zip(self.pieces, self.kinds):
            if kind == _NORMAL:
                out.append(piece.replace(SPACE, " ").encode())
            else:
                out.append(bytes([int(piece[3:5], 16)]) if kind == _BYTE else " ⁇ ".encode() if kind == _UNKNOWN else b"")
        self.sizes = np.array(list(map(len, out)), np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(out), np.uint8)

    def _trie_of_ends(self) -> dict:
        """Pieces by their characters from the last to the first; key 0 holds the id."""
        root: dict = {}
        for piece, number in self.ids.items():
            if self.is_bpe and not self._made(piece):
                continue
            node = root
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[0] = number
        return root

    # Borders between pieces of a BPE model

    def _learn_splits(self) -> None:
        """Rank of each piece and the two parts of its last merge; pieces that no merge reaches are left out."""
        order = sorted(self.score, key=lambda p: -self.score[p])
        self.rank = {p: r for r, p in enumerate(order) if len(p) > 1}
        self.split: dict[str, tuple[str, str]] = {}
        self.borders: dict[int, bool] = {}
        # A piece's parts can have a higher rank than itself only if it is never made.
        for piece in sorted(self.rank, key=lambda p: (len(p), self.rank[p])):
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                if self._made(left) and self._made(right) and self._border_holds(left, right, self.rank[piece]):
                    if max(self.rank.get(left, -1), self.rank.get(right, -1)) < self.rank[piece]:
                        self.split[piece] = (left, right)
                        break

    def _made(self, piece: str) -> bool:
        return len(piece) == 1 or piece in self.split

    def _border_holds(self, left: str, right: str, before: float = float("inf")) -> bool:
        """Whether no merge ranked before `before` crosses the border of two pieces.

        Goes back in time: undoes the later of the two pieces' last merges, and
        looks whether the symbols that then met at the border would have been
        merged first. Equal ranks go from left to right.
        """
        rank = self.rank
        across = rank.get(left + right)
        if across is not None and across < before:
            return False
        while True:
            made_left, made_right = rank.get(left, -1), rank.get(right, -1)
            if len(left) == 1 and len(right) == 1:
                return True
            if len(right) == 1 or (len(left) > 1 and made_left > made_right):
                left = self.split[left][1]
                across = rank.get(left + right)
                if across is not None and across < made_left:
                    return False
            else:
                right = self.split[right][0]
                across = rank.get(left + right)
                if across is not None and across <= made_right:
                    return False

    # Encoding

    def _unknown_ids(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of a text whose spaces are escaped already."""
        ids: list[int] = []
        start = 0  # everything before is committed
        # For each position from `start` on, the id of the piece that ends there
        # (-1: a character without a piece; None: nothing) and the best score.
        last: list[int | None] = [None]
        best = [0.0]
        step = self._step_by_merges if self.is_bpe else self._step_by_score
        for at in range(1, len(symbols) + 1):
            step(symbols, start, at, last, best)
            if at - start >= 8 * self.longest:
                sizes = [1 if number in (-1, None) else self.length[number] for number in last]
                common = self._meeting(sizes, max(0, at - start - self.longest + 1), at - start)
                if common:
                    ids += self._path(symbols, start, common, last)
                    del last[:common], best[:common]
                    start += common
        return ids + self._path(symbols, start, len(symbols) - start, last)

    def _step_by_merges(self, symbols: str, start: int, at: int, last: list, best: list) -> None:
        node, first, found = self.ends, at, []
        while first > start:
            node = node.get(symbols[first - 1])
            if node is None:
                break
            first -= 1
            if 0 in node:
                found.append(node[0])
        length, borders = self.length, self.borders
        for number in reversed(found):
            before = last[at - length[number] - start]
            if before is None or before < 0:
                last.append(number)
                return
            key = before << 32 | number
            holds = borders.get(key)
            if holds is None:
                if len(borders) > KNOWN_BORDERS:
                    borders.clear()
                holds = borders[key] = self._border_holds(self.pieces[before], self.pieces[number])
            if holds:
                last.append(number)
                return
        last.append(-1)

    def _step_by_score(self, symbols: str, start: int, at: int, last: list, best: list) -> None:
        winner, score = -1, best[-1] + self.unknown_score
        node, first = self.ends, at
        while first > start:
            node = node.get(symbols[first - 1])
            if node is None:
                break
            first -= 1
            if 0 in node:
                here = best[first - start] + self.score[self.pieces[node[0]]]
                if here > score or winner < 0:
                    winner, score = node[0], here
        last.append(winner)
        best.append(score)

    @staticmethod
    def _meeting(sizes: list[int], first: int, end: int) -> int:
        """The last boundary that the paths of all positions from `first` to `end` share."""
        paths = set(range(first, end + 1))
        while len(paths) > 1:
            far = max(paths)
            paths.remove(far)
            paths.add(far - sizes[far])
        return paths.pop()

    def _path(self, symbols: str, start: int, end: int, last: list) -> list[int]:
        """Ids from `start` to `end` positions further, along the backpointers."""
        back = []
        while end > 0:
            number = last[end]
            if number < 0:
                back += reversed(self._unknown_ids(symbols[start + end - 1]))
                end -= 1
            else:
                back.append(number)
                end -= self.length[number]
        back.reverse()
        return back

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 4-byte integers."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        whole = (" " if self.dummy_prefix else "") + text
        if not self.cuts:
            return self._word(whole)
        runs, known, long = _RUNS.findall(whole), self.known, {}
        for run in set(runs).difference(known):
            ids = self._word(run)
            if len(run) > KEPT:
                long[run] = ids
            else:
                known[run] = ids
                self.held += len(run) + len(ids) + PER_RUN
        return b"".join([known[run] if run in known else long[run] for run in runs] if long else map(known.__getitem__, runs))

    def _word(self, word: str) -> bytes:
        ids = self.encode_symbols(word.replace(" ", SPACE))
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        out = []
        for text in batch:
            if self.held > KNOWN_BYTES:
                self.known.clear()
                self.held = 0
            out.append(self.encode(text))
        return out

    # Decoding

    def decode_batch(self, batch: list[bytes]) -> list[str]:
        """Texts of ids given as little-endian 4-byte integers."""
        out, at = [], 0
        while at < len(batch):
            begin, size = at, 0
            while at < len(batch) and (at == begin or size < PART_CHARS):
                size += len(batch[at])
                at += 1
            out += self._decode(batch[begin:at])
        return out

    def _decode(self, batch: list[bytes]) -> list[str]:
        ids = np.frombuffer(b"".join(batch), "<i4")
        sizes = self.sizes[ids]
        ends = np.append(0, np.cumsum(sizes))
        places = np.repeat(self.places[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        raw = self.bytes[places].tobytes()
        cuts = ends[np.append(0, np.cumsum([len(b) // 4 for b in batch]))]
        out = []
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            text = raw[begin:end].decode("utf-8", "replace")
            out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
        return out


@functools.lru_cache(maxsize=1)
def piece_model(path: str) -> PieceModel:
    """The model of this process; the words it has met serve the next task too."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every text, the text they decode to, and whether that is the text itself."""

    def compute():
        model = piece_model(model_path)

        def work(column):
            batch = texts(column)
            encoded = model.encode_batch(batch)
            decoded = model.decode_batch(encoded)
            counts = np.array([len(e) // 4 for e in encoded], np.int32)
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            ids = pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32())
            return [
                pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(offsets, ids), pa.array(decoded, pa.string()),
                pa.array([a == b for a, b in zip(batch, decoded)], pa.bool_()),
            ]

        return work

    return per_row(
        docs, [id_column], [text_column], compute,
        "n_tokens bigint, ids array<int>, decoded string, lossless boolean",
    )
