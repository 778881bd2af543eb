"""Benchmark decontamination: Wu-Manber search for many windows of words at once.

Every benchmark item is cut into windows of ten consecutive words (an item of
fewer words is one window). All windows of one length share a block shift table:
the last three words before the reading position say how far the search may
advance without missing a window. Where the shift is zero, the block also names
the bucket of windows that end with it, and a direct comparison confirms one.
Where the items are too many for one block of bounded size, each block is a pass
over the texts that writes only digests of texts and what was found in them.

Rules for odd input: null and empty texts have no words, null and empty items no
windows; an item whose id is null is listed as "null", one whose id repeats
counts once; ids of documents may repeat or be null, each row is judged alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dayloom.llm.tables import per_row, rows_where, sent_if_small, settle, slices, utf8

WINDOW = 10
BLOCK = 3
# Items are searched for in blocks of at most this many bytes of text (or one
# item), so that neither the driver nor a task holds more of them at a time.
BLOCK_BYTES = 4_000_000

_FOLD = bytes(
    b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all non-ASCII characters."""
    return text.translate(_FOLD).split()


class WuManber:
    """Search for patterns of `length` words each; `patterns` maps a pattern to what it stands for."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set]):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, set]] = {}
        for pattern, meaning in patterns.items():
            for end in range(self.block, length + 1):
                block = b" ".join(pattern[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.bucket.setdefault(b" ".join(pattern[length - self.block :]), {})[b" ".join(pattern)] = meaning

    def find(self, words: list[bytes]) -> list[tuple[int, set]]:
        """(position of the last word, meaning) of every occurrence."""
        found, shift, size, far = [], self.shift.get, self.block, self.far
        at, n = self.length, len(words)
        while at <= n:
            block = b" ".join(words[at - size : at])
            step = shift(block, far)
            if step:
                at += step
                continue
            meaning = self.bucket[block].get(b" ".join(words[at - self.length : at]))
            if meaning is not None:
                found.append((at - 1, meaning))
            at += 1
        return found


def machines(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One machine for each length of window among the items."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if words else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[at : at + size]), set()).add(item)
    return [WuManber(size, patterns) for size, patterns in sorted(by_length.items())]


def search(searchers: list[WuManber], words: list[bytes]) -> tuple[np.ndarray | None, set]:
    """(which words are hit, items found); None where none is."""
    hit, items = None, set()
    for machine in searchers:
        for end, meaning in machine.find(words):
            if hit is None:
                hit = np.zeros(len(words), bool)
            hit[end - machine.length + 1 : end + 1] = True
            items |= meaning
    return hit, items


def item_blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[Callable[[], list]]:
    """Readers of lists of (id, UTF-8 text) of bounded size; Spark numbers the items and keeps them."""
    limit = BLOCK_BYTES

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = size = 0
        for batch in batches:
            numbers = []
            for n in pc.binary_length(batch.column("text")).to_pylist():
                if size and size + n > limit:
                    block, size = block + 1, 0
                numbers.append(TaskContext.get().partitionId() << 32 | block)
                size += n
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], names=["block", "item", "text"])

    kept = settle(
        items.where(F.col(text_column).isNotNull()).select(
            F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"),
            F.col(text_column).cast("binary").alias("text"),
        ).mapInArrow(number, "block bigint, item string, text binary")
    )
    sizes = kept.groupBy("block").agg(F.sum(F.length("text")).alias("n")).orderBy("block").collect()
    # Blocks of several tasks are sent together while they fit.
    together, size = [], 0
    for row in [*sizes, None]:
        if row is None or together and size + row.n > limit:
            chosen = kept.where(F.col("block").isin(together)) if together else kept.where(F.lit(False))
            yield lambda chosen=chosen: [(r.item, bytes(r.text)) for r in chosen.select("item", "text").collect()]
            together, size = [], 0
        if row is not None:
            together.append(row.block)
            size += row.n


def _in_block(texts: DataFrame, block: Callable[[], list]) -> DataFrame:
    """Of each distinct text with a hit: its SHA-256, a bit for each word, items found. Written to the shared folder."""
    patterns = texts.sparkSession.sparkContext.broadcast(block())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = machines(patterns.value)
        for batch in (part for full in batches for part in slices(full)):
            rows = {}
            for raw in utf8(batch.column(0)):
                hit, found = search(searchers, words_of(raw))
                if hit is not None:
                    rows[hashlib.sha256(raw).hexdigest()] = (np.packbits(hit).tobytes(), sorted(found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(rows), pa.string()), pa.array([h for h, _ in rows.values()], pa.binary()),
                    pa.array([f for _, f in rows.values()], pa.list_(pa.string())),
                ],
                names=["__text", "__hits", "__found"],
            )

    hits = texts.mapInArrow(run, "__text string, __hits binary, __found array<string>")
    # Copies of a text give the same row, and meet before they are sent.
    kept = settle(hits.groupBy("__text").agg(F.first("__hits").alias("__hits"), F.first("__found").alias("__found")))
    patterns.unpersist()
    return kept


# Copies of one text are dealt over so many tasks where rows meet their text's hits.
_SALT = 16


def _salted(docs: DataFrame, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    return docs.withColumn("__text", F.sha2(text, 256)).withColumn("__salt", F.spark_partition_id() % _SALT)


def _for_all_salts(hits: DataFrame) -> DataFrame:
    return hits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))


def _passes(docs: DataFrame, id_column: str, text_column: str, items: DataFrame) -> DataFrame:
    """Id, n_words, hits (for each word a bit, from one or more blocks), found (ids); one pass for each block of items.

    With several blocks, a pass writes what it found under the text's digest, and no text.
    """
    blocks = item_blocks(items)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        patterns = docs.sparkSession.sparkContext.broadcast(block())

        def compute():
            searchers = machines(patterns.value)

            def work(text):
                counts, bits, names = [], [], []
                for raw in utf8(text):
                    words = words_of(raw)
                    hit, found = search(searchers, words)
                    counts.append(len(words))
                    bits.append([] if hit is None else [np.packbits(hit).tobytes()])
                    names.append(sorted(found))
                return [
                    pa.array(counts, pa.int64()), pa.array(bits, pa.list_(pa.binary())), pa.array(names, pa.list_(pa.string()))
                ]

            return work

        return per_row(
            docs, [id_column], [text_column], compute, "__n_words bigint, __hits array<binary>, __found array<string>"
        )
    texts = docs.select(text_column)
    hits = reduce(DataFrame.unionAll, [_in_block(texts, b) for b in chain([block, following], blocks)])
    merged = hits.groupBy("__text").agg(
        F.collect_list("__hits").alias("__hits"), F.flatten(F.collect_list("__found")).alias("__found")
    )
    counted = per_row(
        _salted(docs, text_column), [id_column, "__text", "__salt"], [text_column],
        lambda: lambda text: [pa.array([len(words_of(raw)) for raw in utf8(text)], pa.int64())], "__n_words bigint",
    )
    joined = counted.join(_for_all_salts(merged), ["__text", "__salt"], "left")
    return joined.select(id_column, "__n_words", "__hits", "__found")


def _ones(bits: list[bytes]) -> int:
    """How many words are hit in any of the blocks."""
    if not bits:
        return 0
    return int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in bits])).sum())


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: words, words hit, items found, digest, verdict."""
    found = _passes(docs.select(id_column, text_column), id_column, text_column, items)

    def compute():
        def work(n_words, hits, names):
            lists = [sorted(set(x or [])) for x in names.to_pylist()]
            hit = [_ones(h or []) for h in hits.to_pylist()]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
            return [
                n_words, pa.array(hit, pa.int64()), pa.array(map(len, lists), pa.int64()), pa.array(digest),
                pa.array([h > 0 for h in hit], pa.bool_()), pa.array(lists, pa.list_(pa.string())),
            ]

        return work

    return per_row(
        found, [id_column], ["__n_words", "__hits", "__found"], compute,
        "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>",
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows in which no window of any item occurs, with all their columns."""
    blocks = item_blocks(items)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        patterns = docs.sparkSession.sparkContext.broadcast(block())

        def verdict():
            searchers = machines(patterns.value)
            return lambda text: [search(searchers, words_of(raw))[0] is None for raw in utf8(text)]

        return rows_where(docs, [text_column], verdict)
    texts = docs.select(text_column)
    found = [_in_block(texts, b).select("__text") for b in chain([block, following], blocks)]
    bad = settle(reduce(DataFrame.unionAll, found).distinct())
    few = sent_if_small(_for_all_salts(bad))
    return _salted(docs, text_column).join(few, ["__text", "__salt"], "left_anti").drop("__text", "__salt")
