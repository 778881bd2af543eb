"""N-gram Jaccard self-join by chosen paths, with the groups of linked texts.

Texts are sets of five-word shingles; two are linked at a Jaccard similarity of
0.8 or more. Texts of the same words are copies: one of them stands for all.

Every set gets a signature of minimum hashes, in which two sets agree at any
place with the probability of their similarity. In each run all sets are split by
one place of the signature; a bucket that is still large is split again by places
that the path to it chooses, and so on; a set takes `BRANCHES` paths at each
split. Sets that end up alone are done. Small buckets are compared by brute
force: first signatures, then, for sets that look similar to another, the shingles
themselves. The number of runs follows from the target recall, so that a pair at
the threshold is missed with a probability below 1 - `RECALL`.

Large buckets whose members agree in half of the places are not split further, as
no split would part them; they, and what is left after `DEPTH` splits, are cut
into blocks, and all pairs of blocks are compared, each in a task of its own. No pairs are shuffled: a bucket returns, for each of its sets,
the number of links and the part of the bucket it hangs together with. A pair that meets in
several buckets is looked at in the one with the lowest number.

Result, one row for each document: `class_id`, the lowest id among all documents
connected by copies and links; `n_links`, the number of other documents linked to
it, copies included. Texts of fewer than five words have one shingle, all their
words. Null, empty and wordless texts are linked to nothing. Rows without an id
get no class and no links, and count for no other row; rows that repeat count as
copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from dayloom.llm.decontaminate import words_of
from dayloom.llm.tables import sent_if_small, settle, utf8

SHINGLE, SIMILARITY = 5, 0.8
RECALL, BRANCHES, DEPTH, LEAF, DENSE = 0.999999, 2, 8, 512, 0.5
PLACES = 128
# Of PLACES places, a pair at the threshold agrees in fewer than this with a
# probability of about 1e-7 (5.4 standard deviations below the mean).
ALIKE = int(PLACES * SIMILARITY - 5.4 * math.sqrt(PLACES * SIMILARITY * (1 - SIMILARITY)))
KNOWN_WORDS = 300_000


def runs_for(recall: float, similarity: float = SIMILARITY, branches: int = BRANCHES) -> int:
    """Runs after which a pair at the threshold has met in some bucket with this probability.

    A pair stays together in a bucket if it agrees at one of the chosen places
    and stays together below it: s = 1 - (1 - similarity * s) ** branches.
    """
    stays = 1.0
    for _ in range(200):
        stays = 1 - (1 - similarity * stays) ** branches
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity * stays))


_random = np.random.default_rng(20240607)
_FACTORS = _random.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**63, PLACES, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of hashed shingles; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct shingles of a text with at least one word."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        size = min(SHINGLE, len(words))
        n = len(words) - size + 1
        total = np.full(n, size, np.uint64)
        for at in range(size):
            total = _mixed(total + hashes[at : at + n]) * np.uint64(0x94D049BB133111EB)
        return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set, mixed."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024, None] * _FACTORS
        part += _SHIFTS
        np.minimum(least, part.min(0), out=least)
    return _mixed(least)


def copy_key(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, copy key, places to begin at, signature; null for texts without words."""
    runs = runs_for(RECALL)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("id").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            keys, roots, places = [], [], []
            for raw in utf8(batch.column(1)):
                words = words_of(raw)
                keys.append(copy_key(words))
                mins = signature(shingler(words)) if words else None
                roots.append(None if mins is None else mins[:runs].view(np.int64))
                places.append(None if mins is None else (mins >> np.uint64(48)).astype(np.uint16).view(np.int16))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(keys, pa.binary()), pa.array(roots, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.int16())),
                ],
                names=["id", "copy", "roots", "places"],
            )

    return rows.mapInArrow(run, f"id {kind}, copy binary, roots array<bigint>, places array<smallint>")


def leaves(sets: DataFrame) -> DataFrame:
    """(copy, leaf, n): buckets that are compared by brute force, with their sizes."""
    paths = sets.select("copy", F.posexplode("roots").alias("run", "root")).select(
        "copy", F.xxhash64("run", "root").alias("path")
    )
    chosen = F.expr(
        f"transform(sequence(1, {BRANCHES}), k -> "
        f"struct(k, xxhash64(path, k, places[cast(pmod(xxhash64(path, k), {PLACES}) as int)]) as child))"
    )
    done = []
    for depth in range(DEPTH + 1):
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        shared = settle(paths.join(sizes, "path"))
        large = F.col("n") > LEAF
        if depth == DEPTH or shared.where(large).isEmpty():
            done.append(shared)
            break
        done.append(shared.where(~large))
        split = settle(
            shared.where(large).join(sets.select("copy", "places"), "copy")
            .select("copy", "path", "n", F.explode(chosen).alias("c")).select("copy", "path", "n", "c.k", "c.child")
        )
        # The share of pairs that a split keeps together estimates how similar
        # the members are; a bucket of similar sets is not split any more.
        together = (
            split.groupBy("path", "k", "child").agg(F.count("*").alias("m"), F.first("n").alias("n"))
            .groupBy("path").agg((F.sum(F.col("m") * F.col("m")) / F.first(F.col("n") * F.col("n"))).alias("kept"))
            .withColumn("dense", F.col("kept") >= DENSE * BRANCHES).select("path", "dense")
        )
        judged = settle(split.join(together, "path"))
        done.append(judged.where(F.col("dense") & (F.col("k") == 1)).select("path", "copy", "n"))
        paths = judged.where(~F.col("dense")).select("copy", F.col("child").alias("path")).distinct()
    out = done[0].select("path", "copy", "n")
    for more in done[1:]:
        out = out.unionByName(more.select("path", "copy", "n"))
    return out.withColumnRenamed("path", "leaf")


def _tasks(members: DataFrame) -> DataFrame:
    """Members with the key of the task that compares them; large leaves are cut into blocks.

    A member of block b goes to the tasks of all pairs of blocks with b in them.
    """
    blocks = F.ceil(F.col("n") / LEAF).cast("int")
    mine = F.pmod(F.xxhash64("copy"), F.col("blocks")).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("block", mine)
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("leaf", F.least("block", "other"), F.greatest("block", "other"))
    # Within the task, side 0 and side 1 are compared; -1 means all with all.
    side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return spread.withColumn("task", F.when(F.col("blocks") == 1, F.col("leaf")).otherwise(pair)).withColumn(
        "side", side
    ).drop("n", "blocks", "block", "other")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            part = batch.slice(begin, end - begin)
            if held and held[-1].column(key)[0] != part.column(key)[0]:
                yield _joined(held)
                held = []
            held.append(part)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind, copy=False).reshape(-1, width)


def _may_pair(group: pa.RecordBatch) -> np.ndarray:
    """Which pairs (a member, a later one) this task decides on.

    Members on the same side of a pair of blocks meet elsewhere, and so do those
    that share a leaf with a lower number than this one.
    """
    sides = group.column("side").to_numpy()
    n = len(sides)
    mine = np.triu(np.ones((n, n), bool), 1) & ((sides[:, None] < 0) | (sides[:, None] != sides[None, :]))
    lists = group.column("leaves")
    owner = np.repeat(np.arange(n), pa.compute.list_value_length(lists).to_numpy())
    values = lists.flatten().to_numpy()
    lower = values < group.column("leaf")[0].as_py()
    if not lower.any():
        return mine
    distinct, column = np.unique(values[lower], return_inverse=True)
    several = np.bincount(column) > 1
    if not several.any():
        return mine
    kept = several[column]
    for at in range(0, int(several.sum()), 4096):
        place = (np.cumsum(several) - 1)[column[kept]] - at
        here = (place >= 0) & (place < 4096)
        member = np.zeros((n, min(4096, int(several.sum()) - at)), np.float32)
        member[owner[lower][kept][here], place[here]] = 1
        mine &= (member @ member.T) == 0
    return mine


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a task whose signature is like that of another member it is compared with."""
    for group in groups(batches, "task"):
        n = group.num_rows
        if n < 2:
            continue
        places = _matrix(group.column("places"), PLACES, np.int16)
        mine = _may_pair(group)
        keep = np.zeros(n, bool)
        for at in range(0, n, 32):
            rows = slice(at, min(at + 32, n))
            if not mine[rows].any():
                continue
            agree = (places[rows][:, None, :] == places[None, :, :]).sum(2)
            similar = (agree >= ALIKE) & mine[rows]
            keep[rows] |= similar.any(1)
            keep |= similar.any(0)
        if keep.any():
            yield group.filter(pa.array(keep)).drop_columns(["places"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), list(map(len, sets)))
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.append(True, tokens[1:] != tokens[:-1])
    column = np.cumsum(new) - 1
    several = np.bincount(column) > 1
    owner, column = owner[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    common = np.zeros((n, n), np.float32)
    width = 8192
    begins = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for begin, end in zip(begins, begins[1:]):
        part = np.zeros((n, width), np.float32)
        part[owner[begin:end], column[begin:end] % width] = 1
        common += part @ part.T
    return common


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member with a link: its links here, and the number of the members it hangs together with."""
    for group in groups(batches, "task"):
        keys = group.column("copy").to_pylist()
        # A row that is there twice brings its set twice.
        first = list({key: row for row, key in reversed(list(enumerate(keys)))}.values())[::-1]
        n = len(first)
        if n < 2:
            continue
        rows = group.take(pa.array(first))
        keys = rows.column("copy").to_pylist()
        sets = [np.asarray(s.values.to_numpy()) for s in rows.column("shingles")]
        sizes = np.array(list(map(len, sets)), float)
        common = _common(sets)
        linked = common / (sizes[:, None] + sizes[None, :] - common) >= SIMILARITY
        linked &= _may_pair(rows)
        lefts, rights = np.nonzero(linked)
        if not len(lefts):
            continue
        copies = rows.column("n_copies").to_numpy()
        links, root = linked @ copies + linked.T @ copies, list(range(n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(lefts.tolist(), rights.tolist()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        touched = np.union1d(lefts, rights)
        task = np.uint64(group.column("task")[0].as_py() % 2**64)
        hung = np.array([find(t) for t in touched.tolist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([keys[t] for t in touched.tolist()], pa.binary()), pa.array(links[touched]),
                pa.array(_mixed(_mixed(hung + np.uint64(1)) ^ task).view(np.int64)),
            ],
            names=["copy", "links", "part"],
        )


def rooted_links(found: DataFrame) -> DataFrame:
    """(copy, links, root) from (copy, links, part): members of one part hang together.

    A part lies in one task and so has a bounded number of members, and a copy is
    in few parts. Twice, the lowest key goes from each part to its members and on
    to their other parts; what this leaves apart, in long chains, is joined by
    `components` over the keys that are left.
    """
    label = F.col("copy")
    rows = found.withColumn("label", label)
    for _ in range(2):
        rows = rows.withColumn("label", F.min("label").over(Window.partitionBy("part")))
        rows = rows.withColumn("label", F.min("label").over(Window.partitionBy("copy")))
    rows = settle(rows.withColumn("low", F.min("label").over(Window.partitionBy("part"))))
    total = rows.groupBy("copy").agg(F.sum("links").alias("links"), F.min("label").alias("root"))
    apart = rows.where(F.col("label") != F.col("low")).select(F.col("label").alias("a"), F.col("low").alias("b"))
    if apart.isEmpty():
        return total
    hung = components(apart).select(F.col("node").alias("root"), F.col("root").alias("lowest"))
    return total.join(hung, "root", "left").select("copy", "links", F.coalesce("lowest", "root").alias("root"))


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root): the lowest node that each node is connected with; large and small stars in turn.

    What each turn leaves is written in at most `files` files, where given.
    """

    def stars(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if small:
            both = both.where(F.col("b") < F.col("a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        hung = both.join(least, "a")
        if small:
            moved = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
                least.select("a", F.col("low").alias("b"))
            )
        else:
            moved = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        return moved.where(F.col("a") != F.col("b")).distinct()

    def print_of(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    pairs = settle(edges.where(F.col("a") != F.col("b")).distinct(), files)
    before = print_of(pairs)
    while True:
        pairs = settle(stars(stars(pairs, False), True), files)
        now = print_of(pairs)
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _shingles_of(rows: DataFrame) -> DataFrame:
    """(copy, shingles) of (copy, text), where the text has that copy key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            keys, sets = [], []
            for key, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = words_of(raw)
                if copy_key(words) == key:
                    keys.append(key)
                    sets.append(shingler(words).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["copy", "shingles"]
            )

    return rows.mapInArrow(run, "copy binary, shingles array<bigint>")


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id and copy key of each row with an id; for each copy key: id, n_copies, root of its class, links)."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marked = settle(fingerprints(docs, id_column, text_column))
    sets = settle(
        marked.where(F.col("copy").isNotNull()).groupBy("copy").agg(
            F.min("id").alias("id"), F.count("*").alias("n_copies"), F.first("roots").alias("roots"),
            F.first("places").alias("places"),
        )
    )
    met = leaves(sets)
    lists = met.groupBy("copy").agg(F.collect_list(F.struct("leaf", "n")).alias("met"))
    members = (
        lists.withColumn("leaves", F.col("met.leaf")).join(sets.drop("roots"), "copy")
        .select("copy", "id", "n_copies", "places", "leaves", F.explode("met").alias("m"))
        .select("copy", "id", "n_copies", "places", "leaves", "m.leaf", "m.n")
    )
    tasks = _tasks(members)
    kind = tasks.schema["id"].dataType.simpleString()
    candidates = settle(
        tasks.select("task", "side", "leaf", "copy", "id", "n_copies", "leaves", "places")
        .repartition("task").sortWithinPartitions("task").mapInArrow(
            alike,
            f"task bigint, side int, leaf bigint, copy binary, id {kind}, n_copies bigint, leaves array<bigint>",
        )
    )
    wanted = settle(candidates.select("id", "copy").distinct())
    shingles = _shingles_of(texts.join(sent_if_small(wanted), "id").select("copy", "text"))
    found = settle(
        candidates.join(shingles, "copy").repartition("task").sortWithinPartitions("task")
        .select("task", "side", "leaf", "copy", "n_copies", "leaves", "shingles")
        .mapInArrow(verified, "copy binary, links bigint, part bigint")
    )
    rooted = sets.select("copy", "id", "n_copies").join(rooted_links(found), "copy", "left")
    return marked.select("id", "copy"), rooted.select(
        "copy", "id", "n_copies", F.coalesce("root", "copy").alias("root"), F.coalesce("links", F.lit(0)).alias("links")
    )


def join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, class_id, n_links), one row for each document."""
    marked, rooted = classes(docs, id_column, text_column)
    lowest = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    named = rooted.join(lowest, "root").select("copy", "class_id", (F.col("n_copies") - 1 + F.col("links")).alias("n_links"))
    worded = marked.where(F.col("copy").isNotNull()).join(named, "copy").select("id", "class_id", "n_links")
    none = F.lit(0).cast("bigint").alias("n_links")
    wordless = marked.where(F.col("copy").isNull()).select("id", F.col("id").alias("class_id"), none)
    nameless = docs.where(F.col(id_column).isNull()).select(
        F.col(id_column).alias("id"), F.col(id_column).alias("class_id"), none
    )
    return worded.unionByName(wordless).unionByName(nameless).withColumnRenamed("id", id_column)


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each class, that of the lowest id, with all its columns; rows without an id or a word stay."""
    marked, rooted = classes(docs, id_column, text_column)
    kept = settle(rooted.groupBy("root").agg(F.min(F.struct("id", "copy")).alias("first")).select("first.*"))
    repeated = marked.groupBy("id", "copy").agg(F.count("*").alias("n")).where(F.col("n") > 1).join(kept, ["id", "copy"])
    repeated = settle(repeated.select("id", "copy"))
    judged = F.col(id_column).isNotNull() & F.coalesce(F.col(text_column).rlike("[^\\x00-/:-@\\[-`{-\\x7f]"), F.lit(False))
    key = _fresh(docs.columns)
    keyed = _with_copy_key(docs.where(judged), text_column, key["row"])

    def of(pairs: DataFrame, how: str) -> DataFrame:
        named = pairs.select(F.col("id").alias(key["id"]), F.col("copy").alias(key["copy"]))
        same = (F.col(id_column) == F.col(key["id"])) & (F.col(key["row"]) == F.col(key["copy"]))
        return keyed.join(sent_if_small(named), same, how)

    once = of(kept.join(repeated, ["id", "copy"], "left_anti"), "left_semi")
    if not repeated.isEmpty():
        once = once.unionByName(of(repeated, "left_semi").dropDuplicates([id_column, key["row"]]))
    return once.select(*docs.columns).unionByName(docs.where(~judged))


def _fresh(columns: list[str]) -> dict[str, str]:
    """Names that no column has."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return {c: prefix + c for c in ("id", "copy", "row")}


def _with_copy_key(rows: DataFrame, text_column: str, name: str) -> DataFrame:
    at = rows.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([copy_key(words_of(raw)) for raw in utf8(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, rows.select("*", F.lit(b"").alias(name)).schema)
