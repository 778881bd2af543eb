"""Ranked lexical search by pipelined term partitioning.

Documents are scored for each item of a query set with integer term weights, and
the best `TOP` of each are returned.

The terms of the items are split among `OWNERS`, rarest first, so that each owner
has about the same number of postings. Documents are cut into blocks, and for each
block an owner holds the postings of its terms as one row of packed arrays. A
bundle, one for each item and block, goes through the owners one after another: in
each stage bundles and postings meet in a cogroup by block, the owner adds the
contributions of its terms to the bundle's sparse accumulators (places of documents
in the block, and their scores so far), and the bundle travels on. After the last
stage a bundle holds its block's best documents, of which the best of all blocks
are chosen.

What travels stays small without losing a result: bundles are made with the
highest contribution each owner can still give to a document of the block. Once
`TOP` documents of a block have a score, an accumulator that cannot reach the last of
them any more is dropped, and documents that can only begin too low are not taken
up. As common terms come last, few documents are left when they come.

No posting list is whole anywhere: a term that all documents have is cut with the
blocks, at `DOCS` documents or `BLOCK_BYTES` of text. Items are answered in sets of at
most `ITEMS` items and `ITEM_BYTES` of text, so that the sent vocabulary and the
accumulators of a block are bounded; each set is one pass over the documents.

Odd rows: null and empty texts have no terms and do not count as documents, items
without terms get no rows. Every row is a document or an item of its own, if its id
repeats or is null too; null ids come first among equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm.decontaminate import words_of
from dayloom.llm.tables import settle, utf8

TOP, OWNERS = 10, 4
DOCS, BLOCK_BYTES = 2048, 64_000_000
ITEMS, ITEM_BYTES = 512, 1_000_000
# The length norm in percent, and the weight of it against the occurrences.
NORM, MEAN_SHARE = 100, 75


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norm(terms: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    return NORM - MEAN_SHARE + (MEAN_SHARE * terms * documents) // all_terms


def saturation(occurrences: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * occurrences) // (1000 * occurrences + 8 * norm)


def item_sets(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple]]:
    """Lists of (id, terms with their occurrences) of bounded size; Spark numbers and keeps the items."""
    rows = items.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("item"), F.col(text_column).alias("text")
    )
    kind = rows.schema["item"].dataType.simpleString()
    items_in_set, limit = ITEMS, ITEM_BYTES

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = size = count = 0
        for batch in batches:
            numbers = []
            for n in pc.binary_length(batch.column("text")).to_pylist():
                if count and (size + n > limit or count == items_in_set):
                    block, size, count = block + 1, 0, 0
                numbers.append(TaskContext.get().partitionId() << 32 | block)
                size, count = size + n, count + 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], names=["block", "item", "text"])

    kept = settle(rows.mapInArrow(number, f"block bigint, item {kind}, text string"))
    sizes = kept.groupBy("block").agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("n"))
    together, count, size = [], 0, 0
    for row in [*sizes.orderBy("block").collect(), None]:
        if together and (row is None or size + row.n > limit or count + row.items > items_in_set):
            chosen = kept.where(F.col("block").isin(together)).select("item", "text").collect()
            yield [(r.item, Counter(words_of(r.text.encode()))) for r in chosen]
            together, count, size = [], 0, 0
        if row is not None:
            together.append(row.block)
            count, size = count + row.items, size + row.n


PACKED = "ids array<{}>, terms binary, ends binary, places binary, occurrences binary, lengths binary"


def packed_blocks(docs: DataFrame, vocabulary, id_column: str, text_column: str) -> DataFrame:
    """One row for each block of documents: postings of the terms of `vocabulary`, term by term.

    `ids` and `lengths` (terms with repeats) are those of its documents; the postings of
    the i-th of `terms` lie before the i-th of `ends`.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(ids: list[pa.Array], lengths: list[int], terms: list, places: list, counts: list) -> pa.RecordBatch:
        term, place = np.array(terms, np.int32), np.array(places, np.int16)
        order = np.argsort(term, kind="stable")
        held, begins = np.unique(term[order], return_index=True)
        ends = np.append(begins, len(term))[1:].astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids))
        number = TaskContext.get().partitionId() << 32 | pack.blocks
        pack.blocks += 1
        arrays = (held, ends, place[order], np.array(counts, np.int32)[order], np.array(lengths, np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), listed, *(pa.array([a.tobytes()], pa.binary()) for a in arrays)],
            names=["block", "ids", "terms", "ends", "places", "occurrences", "lengths"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        pack.blocks = 0
        ids, lengths, terms, places, counts, size = [], [], [], [], [], 0
        for batch in batches:
            for row, raw in enumerate(utf8(batch.column("text"))):
                words = words_of(raw)
                if not words:
                    continue
                if lengths and (len(lengths) == DOCS or size + len(raw) > BLOCK_BYTES):
                    yield pack(ids, lengths, terms, places, counts)
                    ids, lengths, terms, places, counts, size = [], [], [], [], [], 0
                for word, n in Counter(words).items():
                    term = known.get(word)
                    if term is not None:
                        terms.append(term)
                        places.append(len(lengths))
                        counts.append(n)
                ids.append(batch.column("id").slice(row, 1))
                lengths.append(len(words))
                size += len(raw)
        if lengths:
            yield pack(ids, lengths, terms, places, counts)

    return settle(rows.mapInArrow(run, f"block bigint, {PACKED.format(kind)}"))


def _ints(cell: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(cell.as_py(), kind)


def statistics(blocks: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents, all their terms, and for each term of the vocabulary the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        holding: Counter = Counter()
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = _ints(batch.column("lengths")[row], np.int64)
                documents, total = documents + len(lengths), total + int(lengths.sum())
                ends = _ints(batch.column("ends")[row], np.int32)
                holding.update(dict(zip(_ints(batch.column("terms")[row], np.int32).tolist(), np.diff(ends, prepend=0).tolist())))
        found = [(-2, documents), (-1, total), *holding.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.int64())], names=["term", "n"]
        )

    counts = blocks.select("terms", "ends", "lengths").mapInArrow(run, "term int, n bigint")
    sums = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.pop(-2, 0), sums.pop(-1, 0), sums


@dataclass
class Search:
    """What all tasks of a pass know: counts of the corpus, weight and owner of each term, terms of each item."""

    documents: int
    all_terms: int
    weight: np.ndarray
    owner: np.ndarray
    items: list[dict[int, int]]

    def postings(self, row: dict, terms_of_owner=None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and contributions for each term of a block (of one owner)."""
        terms, ends = _ints(row["terms"], np.int32), _ints(row["ends"], np.int32)
        places, occurrences = _ints(row["places"], np.int16), _ints(row["occurrences"], np.int32).astype(np.int64)
        norm = length_norm(_ints(row["lengths"], np.int64), self.documents, self.all_terms)
        given = saturation(occurrences, norm[places])
        return {
            term: (places[begin:end], given[begin:end] * self.weight[term])
            for term, begin, end in zip(terms.tolist(), [0, *ends[:-1].tolist()], ends.tolist())
        }


def search_of(items: list[dict[int, int]], documents: int, all_terms: int, holding: dict[int, int], n_terms: int) -> Search:
    """Rare terms go to the first owner; each owner has about the same number of postings."""
    df = np.array([holding.get(t, 0) for t in range(n_terms)], np.int64)
    weight = np.array([term_weight(documents, n) for n in df.tolist()], np.int64)
    order = np.lexsort((np.arange(n_terms), df))
    upto = np.cumsum(df[order])
    owner = np.zeros(n_terms, np.int64)
    owner[order] = np.minimum((upto - df[order] // 2) * OWNERS // max(int(upto[-1]), 1), OWNERS - 1) if n_terms else 0
    return Search(documents, all_terms, weight, owner, items)


def owned(blocks: DataFrame, sent, owner: int) -> DataFrame:
    """The postings of one owner; the last one also has the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                terms, ends = _ints(batch.column("terms")[row], np.int32), _ints(batch.column("ends")[row], np.int32)
                mine = search.owner[terms] == owner
                size = np.diff(ends, prepend=0)
                kept = np.repeat(mine, size)
                arrays = (
                    terms[mine], np.cumsum(size[mine]).astype(np.int32), _ints(batch.column("places")[row], np.int16)[kept],
                    _ints(batch.column("occurrences")[row], np.int32)[kept],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(row, 1) for c in ("block", "ids")),
                        *(pa.array([a.tobytes()], pa.binary()) for a in arrays), batch.column("lengths").slice(row, 1),
                    ],
                    names=batch.schema.names,
                )

    out = blocks.mapInArrow(run, blocks.schema)
    return out if owner == OWNERS - 1 else out.drop("ids")


BUNDLE = "block bigint, item int, rest array<bigint>, places binary, scores binary"


def bundles(blocks: DataFrame, sent) -> DataFrame:
    """For each block and item with a term there: the most that each owner can give to a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                most = {t: int(c.max()) for t, (_, c) in search.postings({c: batch.column(c)[row] for c in batch.schema.names}).items()}
                numbers, rests = [], []
                for number, terms in enumerate(search.items):
                    rest = [0] * OWNERS
                    for term, times in terms.items():
                        if term in most:
                            rest[search.owner[term]] += times * most[term]
                    if any(rest):
                        numbers.append(number)
                        rests.append(rest)
                none = pa.array([b""] * len(numbers), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("block")[row].as_py()] * len(numbers), pa.int64()),
                        pa.array(numbers, pa.int32()), pa.array(rests, pa.list_(pa.int64())), none, none,
                    ],
                    names=["block", "item", "rest", "places", "scores"],
                )

    return blocks.mapInArrow(run, BUNDLE)


def added(
    postings: dict[int, tuple[np.ndarray, np.ndarray]], terms: dict[int, int], rest: list[int], owner: int,
    places: np.ndarray, scores: np.ndarray, total: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """A bundle's accumulators after the owner's terms; `total` is zero, as long as the block, and is left so."""
    held = [(postings[t], times) for t, times in terms.items() if t in postings]
    if not held:
        return places, scores
    floor = np.partition(scores, -TOP)[-TOP] if len(scores) >= TOP else 0
    later = sum(rest[owner + 1 :])
    total[places] = scores
    for (at, gives), times in held:
        total[at] += gives * times
    if rest[owner] + later >= floor:
        places = np.flatnonzero(total).astype(np.int16)
    scores = total[places]
    total[:] = 0
    if len(scores) > TOP:
        floor = np.partition(scores, -TOP)[-TOP]
        kept = scores + later >= floor
        places, scores = places[kept], scores[kept]
    return places, scores


def stage(travelling: DataFrame, held: DataFrame, sent, owner: int, kind: str) -> DataFrame:
    """The bundles after one owner; after the last, (item, id, score) of the best in each block."""
    last = owner == OWNERS - 1

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        search = sent.value
        # A block that Spark made again after a loss is the same block.
        row = {c: right.column(c)[0] for c in right.column_names}
        postings = search.postings(row)
        total = np.zeros(len(row["lengths"].as_py()) // 8, np.int64)
        out = []
        for k in range(left.num_rows):
            number, rest = left.column("item")[k].as_py(), left.column("rest")[k].as_py()
            out.append(
                added(
                    postings, search.items[number], rest, owner, _ints(left.column("places")[k], np.int16),
                    _ints(left.column("scores")[k], np.int64), total,
                )
            )
        if not last:
            return pa.table(
                [
                    *(left.column(c) for c in ("block", "item", "rest")),
                    pa.array([p.tobytes() for p, _ in out], pa.binary()), pa.array([s.tobytes() for _, s in out], pa.binary()),
                ],
                names=["block", "item", "rest", "places", "scores"],
            )
        numbers = np.repeat(left.column("item").to_numpy(), [len(p) for p, _ in out]).astype(np.int32)
        places = np.concatenate([p for p, _ in out]) if out else np.zeros(0, np.int16)
        scores = np.concatenate([s for _, s in out]) if out else np.zeros(0, np.int64)
        ids = row["ids"].values.take(pa.array(places.astype(np.int64)))
        return pa.table([pa.array(numbers), ids, pa.array(scores)], names=["item", "id", "score"])

    schema = f"item int, id {kind}, score bigint" if last else BUNDLE
    return travelling.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(meet, schema)


def best(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item, rank, doc, score): the best documents of each item, from 1."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    item_kind = items.schema[item_column].dataType.simpleString()
    answers = []
    for chosen in item_sets(items, item_column, item_text):
        words = sorted({w for _, counts in chosen for w in counts})
        numbers = {w: i for i, w in enumerate(words)}
        vocabulary = spark.sparkContext.broadcast(numbers)
        blocks = packed_blocks(docs, vocabulary, id_column, text_column)
        vocabulary.unpersist()
        documents, all_terms, holding = statistics(blocks)
        if not documents:
            continue
        terms = [{numbers[w]: n for w, n in counts.items()} for _, counts in chosen]
        sent = spark.sparkContext.broadcast(search_of(terms, documents, all_terms, holding, len(words)))
        found = bundles(blocks, sent)
        for owner in range(OWNERS):
            found = stage(found, owned(blocks, sent, owner), sent, owner, kind)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
        ranked = found.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(chosen)], f"item int, name {item_kind}")
        answers.append(
            settle(ranked.join(F.broadcast(names), "item").select(
                F.col("name").alias(item_column), "rank", F.col("id").alias(id_column), "score"
            ))
        )
        sent.unpersist()
    if not answers:
        return spark.createDataFrame([], f"`{item_column}` {item_kind}, rank int, `{id_column}` {kind}, score bigint")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
