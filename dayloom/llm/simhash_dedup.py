"""SimHash near-duplicates with a Gray-order hierarchical index.

A text's fingerprint has a bit set where more than half of the hashes of its
three-word shingles have it set. Fingerprints of at most three differing bits are
linked; a document's component is the smallest id that links lead to.

Equal fingerprints are one node from the start, so copies cost nothing further.
The index is a tree of masked bit patterns: a node holds the bits that all
fingerprints below it share and its parent does not hold yet, so that differences
add up on the way down and a whole group is left as soon as they exceed three.

* The upper nodes are spread over the cluster. Of four fields of bits, two linked
  fingerprints agree in one at least, so the first level has a node for each value
  of each field. A node with more than `LEAF` fingerprints gets four children
  levels of its own, over a quarter of the bits that are still open, and so on
  `DEPTH` times. What is then still large is cut into blocks, and all pairs of blocks
  are searched, each in a task of its own.
* Within such a node, fingerprints are sorted by Gray rank, which puts those of
  few differing bits side by side; `FAN` neighbours at a time are factored into a
  node of their shared bits, level by level. All fingerprints are then searched
  for at once, as arrays of (fingerprint, node, differences so far).

A task returns no pairs, only each linked fingerprint with the lowest one it hangs
together with there; `components` joins these over tasks.

Odd rows: a text without words (null, empty, blank) has the fingerprint zero, linked
like any other; one of fewer than three words has one shingle, all its words. Rows
without an id count as links and have the component of those they link, or null.
Ids may repeat, each row is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dayloom.llm.jaccard_join import components, groups
from dayloom.llm.tables import files_of, in_full_tasks, per_row, sent_if_small, settle, utf8

SHINGLE, SEED, REACH = 3, 42, 3
# Fingerprints in a node that one task searches; levels of upper nodes; nodes in a node.
LEAF, DEPTH, FAN = 2048, 3, 8
# Fields at each level: one more than the differing bits, so that one field agrees.
FIELDS = REACH + 1
# Fingerprints that are searched for at once, and shingles whose bits are counted at once.
TOGETHER, COUNTED = 256, 65_536
# Bytes of text that a task has at least, where the input comes in smaller parts.
TASK_BYTES = 4_000_000
_ALL = (1 << 64) - 1


def fingerprint(words: list[bytes]) -> int:
    """The majority of the bits of all shingles' hashes; zero without words."""
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    count = len(words) - size + 1
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, COUNTED):
        upto = min(at + COUNTED, count)
        spans = zip(begins[at:upto].tolist(), ends[at + size - 1 : upto + size - 1].tolist())
        hashes = np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, upto - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed number."""

    def compute():
        def work(text):
            found = [fingerprint(raw.lower().split()) for raw in utf8(text)]
            return [pa.array(np.array(found, np.uint64).view(np.int64))]

        return work

    rows = in_full_tasks(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "text", TASK_BYTES)
    return per_row(rows, ["id"], ["text"], compute, "fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


class GrayIndex:
    """Codes in Gray order under nodes of shared bits; the first level is the codes themselves."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        shared, pattern = [np.full(len(codes), _ALL, np.uint64)], [self.codes]
        while len(pattern[-1]) > FAN:
            below, bits = shared[-1], pattern[-1]
            begins = np.arange(0, len(bits), FAN)
            first = np.repeat(bits[begins], np.diff(np.append(begins, len(bits))))
            common = np.bitwise_and.reduceat(below & ~(bits ^ first), begins)
            shared.append(common)
            pattern.append(bits[begins] & common)
        # A node's own bits are those that its parent does not hold.
        self.own = [
            mask & ~np.repeat(above, FAN)[: len(mask)] for mask, above in zip(shared, shared[1:])
        ] + [shared[-1]]
        self.pattern = pattern

    def search(self, queries: np.ndarray, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the query, place of a code in Gray order) of at most REACH differing bits.

        With `after`, only codes behind that place count, for each query.
        """
        top = len(self.pattern) - 1
        for at in range(0, len(queries), TOGETHER):
            n = min(TOGETHER, len(queries) - at)
            query = np.repeat(np.arange(at, at + n), len(self.pattern[top]))
            node = np.tile(np.arange(len(self.pattern[top])), n)
            apart = np.zeros(len(query), np.int64)
            for level in range(top, -1, -1):
                if level < top:
                    query, apart = np.repeat(query, FAN), np.repeat(apart, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    there = node < len(self.pattern[level])
                    query, node, apart = query[there], node[there], apart[there]
                apart = apart + np.bitwise_count((queries[query] ^ self.pattern[level][node]) & self.own[level][node])
                near = apart <= REACH
                if after is not None:
                    near &= (node + 1) * FAN**level - 1 > after[query]
                query, node, apart = query[near], node[near], apart[near]
            if len(query):
                yield query, node


def _hang(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of each a and b; afterwards every member points at its lowest."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (further := root[root] != root).any():
            root[further] = root[root[further]]


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each fingerprint of a task with a link there: the lowest one it hangs together with.

    Side 0 is searched for among side 1; side -1 among itself.
    """
    for group in groups(batches, "task"):
        codes, sides = group.column("fp").to_numpy().view(np.uint64), group.column("side").to_numpy()
        if len(codes) < 2:
            continue
        one, other = np.flatnonzero(sides <= 0), np.flatnonzero(sides != 0)
        if not len(one) or not len(other):
            continue
        index = GrayIndex(codes[other])
        among = sides[0] < 0
        place = other[index.order]
        root = np.arange(len(codes))
        if among:
            found = index.search(index.codes, np.arange(len(codes)))
            query_place = place
        else:
            found, query_place = index.search(codes[one]), one
        for query, node in found:
            _hang(root, query_place[query], place[node])
        moved = np.flatnonzero(root != np.arange(len(codes)))
        if len(moved):
            signed = codes.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[root[moved]])], names=["a", "b"])


def fields(held: int) -> list[int]:
    """The open bits, those not in `held`, cut into FIELDS masks."""
    rest = [bit for bit in range(64) if not held >> bit & 1]
    cuts = [len(rest) * k // FIELDS for k in range(FIELDS + 1)]
    return [sum(1 << bit for bit in rest[a:b]) for a, b in zip(cuts, cuts[1:])]


def below(nodes: DataFrame) -> DataFrame:
    """(path, held, fp) of the children of each (path, held, fp): one for each field of the open bits.

    A child is named by its parent, its field and the fingerprint's bits there.
    """
    shape = "path bigint, held bigint, fp bigint, mask bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held").to_numpy()
            for mask in np.unique(held).tolist():
                part = batch.filter(pa.array(held == mask))
                for field in fields(mask % (1 << 64)):
                    signed = field - (1 << 64) if field >> 63 else field
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(part.num_rows, signed, np.int64))],
                        names=["path", "held", "fp", "mask"],
                    )

    return nodes.select("path", "held", "fp").mapInArrow(run, shape).select(
        F.xxhash64("path", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("path"),
        F.col("held").bitwiseOR(F.col("mask")).alias("held"), "fp",
    )


def upper_nodes(codes: DataFrame) -> DataFrame:
    """(path, n, fp): the nodes that tasks search, each with two fingerprints or more."""
    root = codes.select(F.lit(0).cast("bigint").alias("path"), F.lit(0).cast("bigint").alias("held"), "fp")
    open_nodes, done, n_open = root, None, codes.count()
    for depth in range(1, DEPTH + 1):
        nodes = below(open_nodes)
        sizes = nodes.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        met = settle(nodes.join(sizes, "path"), files_of(FIELDS * n_open))
        large = F.col("n") > LEAF
        last = depth == DEPTH or not (n_open := met.where(large).count())
        ready = (met if last else met.where(~large)).select("path", "n", "fp")
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        open_nodes = met.where(large)


def tasks(nodes: DataFrame) -> DataFrame:
    """(task, side, fp): small nodes are a task each, large ones one for each pair of blocks."""
    blocks = F.ceil(F.col("n") / LEAF).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = nodes.withColumn("blocks", blocks).withColumn("block", mine)
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return spread.select(F.when(F.col("blocks") == 1, F.col("path")).otherwise(pair).alias("task"), side.alias("side"), "fp")


def linked_codes(codes: DataFrame) -> DataFrame:
    """(node, root): each linked fingerprint of the distinct `codes` with the lowest that links lead to."""
    dealt = tasks(upper_nodes(codes)).repartition("task").sortWithinPartitions("task")
    return components(dealt.mapInArrow(linked, "a bigint, b bigint"), files_of(codes.count()))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint in hexadecimal, component_id), one row for each document."""
    marked = settle(fingerprints(docs, id_column, text_column))
    files = files_of(marked.count())
    codes = settle(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), files)
    rooted = codes.join(linked_codes(codes.select("fp")), codes["fp"] == F.col("node"), "left").select(
        "fp", "low", "n", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # A document whose id is its component's needs no row here.
    other = (F.col("n") > 1) | (F.col("component_id") != F.col("low")) | F.col("low").isNull()
    named = settle(rooted.join(lowest, "root").where(other).select("fp", "component_id"), files)
    out = marked.join(sent_if_small(named), "fp", "left").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumnRenamed("id", id_column)
