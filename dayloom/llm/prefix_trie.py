"""Prefix trie of conversations as burst tries.

Conversations are rebuilt (see `rebuilt`), and every sequence of turns that one of
them begins with is a node of the trie.

Turns become ids of fixed length, a digest of role and text and the text's number of
words, so that a sequence is one binary string that sorts turn by turn; texts are
left behind at once. The trie is built from containers of suffixes:

* A container holds the distinct rests of conversations below one node, its head, each
  with the number of its conversations and the lowest of them. All start in the
  container of the root, so copies are one row from the first exchange on.
* A container of more than `BUCKET` rests is burst: what all its rests begin with
  becomes nodes of the upper trie, and the rests go to new containers by the next turn
  id. Ever fewer rows take part in each round.
* Containers that are small enough are sorted and swept, in tasks over many containers:
  a stack of open nodes, closed when the common prefix with the last rest ends.

A rest is at most `SPAN` turns long. Longer conversations go on in the container of the
node they have reached, which is named by a digest of all turns before and so is known
without building what lies above; positions and digests along a long conversation
come from range pieces, never from one task. What a node's subtree sums up is added
inside containers by the sweep, and over containers by doubling along their parents.

The digest over members goes over their ids in order: runs of ids are packed to texts
in range pieces, and the texts of a group are hashed one after another.

Odd rows: turns without a conversation belong to none. Null roles and texts are
empty. Turns of equal number, and rows that repeat, are turns of their own, ordered
by the digest of role and text. No conversation, no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dayloom.llm.tables import crc_of, sent_if_small, settle
from dayloom.operators.long_series import indexed, range_pieces

# Bytes of a turn id (digest, words), turns of a rest, rests of a container, ids packed together.
DIGEST, WIDTH, SPAN, BUCKET, PACKED = 16, 20, 64, 256, 8192
GIVEN, FAMILY = 4, 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ROWS_OUT = 20_000


def _turn_id(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.unhex(F.concat(digest, F.lpad(F.hex(words.cast("long")), 2 * (WIDTH - DIGEST), "0")))


def _part(ids: Column, first: Column, turns: Column) -> Column:
    """Some turns of a sequence, from a 0-based place."""
    return ids.substr(first * WIDTH + 1, turns * WIDTH)


def _words(ids: Column, place: Column) -> Column:
    """Words of the turn at a 0-based place."""
    cell = ids.substr(place * WIDTH + DIGEST + 1, F.lit(WIDTH - DIGEST))
    return F.conv(F.hex(cell), 16, 10).cast("bigint")


def _length(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / WIDTH).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, place, id): the turns that conversations are made of, `place` from 0.

    Conversation c has the first h original turns of the first one of its family of
    twenty, then its own after its first h; h is crc32(c) mod 4. A row without an id
    stands for each conversation, which may have no turns.
    """
    c = F.col("conv_id")
    rows = turns.where(c.isNotNull()).select(
        c.cast("bigint").alias("conv_id"), F.col("turn"), _turn_id(F.col("role"), F.col("text")).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    )
    pieces = range_pieces(rows, ["conv_id"], ["turn", "id", "row"])
    family, given = c - c % FAMILY, (crc_of(c) % GIVEN).cast("int")
    placed = indexed(pieces, ["conv_id"], "at").select(
        "conv_id", family.alias("family"), given.alias("given"), F.col("at").cast("bigint").alias("at"), "id"
    )
    first = placed.where((F.col("conv_id") == F.col("family")) & (F.col("at") < GIVEN - 1))
    heads = settle(
        first.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("head"))
        .select("family", F.col("head.id").alias("head"))
    )
    sent = sent_if_small(heads)
    moved = F.least(F.col("given"), F.coalesce(F.size("head"), F.lit(0))) - F.col("given")
    own = placed.where(F.col("at") >= F.col("given")).join(sent, "family", "left").select(
        "conv_id", (F.col("at") + moved).alias("place"), "id"
    )
    convs = pieces.select("conv_id").distinct().select("conv_id", family.alias("family"), given.alias("given"))
    taken = convs.where(F.col("given") > 0).join(sent, "family").select(
        "conv_id", F.posexplode(F.slice("head", F.lit(1), F.col("given"))).alias("place", "id")
    )
    none = convs.select("conv_id", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("binary").alias("id"))
    return own.unionByName(taken).unionByName(none)


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, ids, x, y): sequences cut at SPAN turns, with two digests of their turns.

    A conversation whose last segment is full has an empty one behind it.
    """
    segment = F.floor(F.col("place") / SPAN).cast("bigint")
    here = F.struct(segment.alias("segment"), "place", "id")
    behind = F.struct((segment + 1).alias("segment"), "place", F.lit(None).cast("binary").alias("id"))
    full = F.col("id").isNotNull() & (F.col("place") % SPAN == SPAN - 1)
    rows = turns.select("conv_id", F.explode(F.when(full, F.array(here, behind)).otherwise(F.array(here))).alias("t"))
    rows = rows.select("conv_id", "t.*")
    known = F.col("id").isNotNull()
    ordered = F.sort_array(F.collect_list(F.when(known, F.struct("place", "id"))))
    return rows.groupBy("conv_id", "segment").agg(
        F.unhex(F.array_join(F.transform(ordered, lambda t: F.hex(t["id"])), "")).alias("ids"),
        F.coalesce(F.bit_xor(F.when(known, F.xxhash64("place", "id"))), F.lit(0)).alias("x"),
        F.coalesce(F.bit_xor(F.when(known, F.xxhash64("id", F.lit("y"), "place"))), F.lit(0)).alias("y"),
    )


def _before(cut: DataFrame) -> DataFrame:
    """(conv_id, segment, x0, y0, words) of segments behind the first: digests of all turns before, words of the last."""
    long = cut.where(F.col("segment") == 1).select("conv_id")
    rows = cut.join(sent_if_small(long), "conv_id", "left_semi").select(
        "conv_id", "segment", "x", "y", _words(F.col("ids"), F.lit(SPAN - 1)).alias("words")
    )
    pieces = range_pieces(rows, ["conv_id"], ["segment"])
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_piece = so_far(Window.partitionBy("conv_id", "_piece").orderBy("segment"))
    of_pieces = so_far(Window.partitionBy("conv_id").orderBy("_piece"))
    summary = pieces.groupBy("conv_id", "_piece").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    carried = summary.select(
        "conv_id", "_piece", *(F.coalesce(F.bit_xor(k).over(of_pieces), F.lit(0)).alias(f"{k}1") for k in "xy")
    )
    digests = pieces.join(carried, ["conv_id", "_piece"]).select(
        "conv_id", "segment",
        *(F.coalesce(F.bit_xor(k).over(in_piece), F.lit(0)).bitwiseXOR(F.col(f"{k}1")).alias(f"{k}0") for k in "xy"),
    )
    last = pieces.select("conv_id", (F.col("segment") + 1).alias("segment"), "words")
    return digests.join(last, ["conv_id", "segment"])


def _box(segment: Column, x: Column, y: Column) -> Column:
    return F.md5(F.concat_ws(",", segment.cast("string"), x.cast("string"), y.cast("string")).cast("binary"))


def members(cut: DataFrame) -> DataFrame:
    """(box, at, words, ids, next, conv_id): the container each segment is in, and the one where it goes on.

    `at` is the depth of the container's head, `words` those of its last turn.
    """
    zero = F.lit(0).cast("bigint")
    rows = cut.where(F.col("segment") == 0).select("*", zero.alias("x0"), zero.alias("y0"), zero.alias("words"))
    further = cut.where(F.col("segment") > 0)
    if not further.isEmpty():
        rows = rows.unionByName(further.join(_before(cut), ["conv_id", "segment"]))
    segment, full = F.col("segment"), F.octet_length("ids") == SPAN * WIDTH
    ahead = _box(segment + 1, F.col("x0").bitwiseXOR(F.col("x")), F.col("y0").bitwiseXOR(F.col("y")))
    return rows.select(
        _box(segment, F.col("x0"), F.col("y0")).alias("box"), (segment * SPAN).alias("at"), "words", "ids",
        F.when(full, ahead).alias("next"), "conv_id",
    )


def ends(of: DataFrame) -> DataFrame:
    """(low, sha): digest of the ids of the conversations that end together, and the lowest of them."""
    spark = of.sparkSession
    ended = of.where(F.col("next").isNull()).select(
        F.md5(F.concat(F.col("box").cast("binary"), F.col("ids"))).alias("group"), F.col("conv_id").alias("low")
    )
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, run = None, []
        out: list[tuple] = []

        def close() -> None:
            if run:
                out.append((held, run[0], ",".join(map(str, run))))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["group", "low", "text"])

        for batch in batches:
            for group, low in zip(batch.column("group").to_pylist(), batch.column("low").to_pylist()):
                if group != held or len(run) == PACKED:
                    close()
                    held, run = group, []
                run.append(low)
            yield batch_of()
        close()
        yield batch_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low, sha = None, None, None
        for batch in batches:
            found = []
            for group, first, text in zip(*(batch.column(c).to_pylist() for c in ("group", "low", "text"))):
                if group != held:
                    if held is not None:
                        found.append((low, sha.hexdigest()))
                    held, low, sha = group, first, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield of_pairs(found)
        if held is not None:
            yield of_pairs([(low, sha.hexdigest())])

    def of_pairs(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["low", "sha"])

    runs = ended.repartitionByRange(pieces, "group", "low").sortWithinPartitions("group", "low").mapInArrow(
        pack, "group string, low bigint, text string"
    )
    return runs.repartition("group").sortWithinPartitions("group", "low").mapInArrow(digest, "low bigint, sha string")


REST = ("box", "up", "parent", "at", "words", "ids", "next", "n", "low")
NODE = ("box", "up", "conv_id", "depth", "parent", "n", "children", "leaves", "saved", "ended")


def burst(rests: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rests of containers to sweep, nodes of the upper trie, links to containers of further segments)."""
    done, nodes, links = None, None, None
    while True:
        sizes = rests.groupBy("box").agg(
            F.count("*").alias("size"), F.min("ids").alias("first"), F.max("ids").alias("last"),
            F.sum("n").alias("all"), F.min("low").alias("lowest"),
        ).where(F.col("size") > BUCKET)
        same = F.transform(
            F.sequence(F.lit(0), F.lit(SPAN - 1)),
            lambda i: (_part(F.col("first"), i, F.lit(1)) == _part(F.col("last"), i, F.lit(1)))
            & (_length(F.col("first")) > i),
        )
        large = settle(sizes.withColumn("shared", (F.array_position(same, F.lit(False)) - 1).cast("int")))
        if large.isEmpty():
            ready = rests
        else:
            sent = sent_if_small(large.select("box", "size", "shared", "lowest"))
            marked = rests.join(sent, "box", "left")
            goes_on = _length(F.col("ids")) > F.col("shared")
            child = F.md5(F.concat(F.col("box").cast("binary"), _part(F.col("ids"), F.lit(0), F.col("shared") + 1)))
            marked = settle(marked.withColumn("child", F.when(goes_on, child)))
            ready = marked.where(F.col("size").isNull()).select(*REST)
        done = ready if done is None else done.unionByName(ready)
        if ready is rests:
            return done, nodes, links
        split = marked.where(F.col("size").isNotNull())
        heads = split.groupBy("box", "up", "parent", "at", "words").agg(
            F.count_distinct("child").alias("kids"), F.max(F.when(F.col("child").isNull(), F.col("low"))).alias("ended")
        )
        upper = _upper_nodes(heads.join(large, "box"))
        nodes = upper if nodes is None else nodes.unionByName(upper)
        # A rest that is used up where its segment ends goes on in the container there.
        rest = _part(F.col("ids"), F.col("shared") + 1, F.lit(SPAN))
        border = (F.octet_length(rest) == 0) & F.col("next").isNotNull()
        across = split.where(F.col("child").isNotNull() & border).select(
            "next", F.col("lowest").alias("parent"), F.col("box").alias("up")
        )
        links = across if links is None else links.unionByName(across)
        rests = split.where(F.col("child").isNotNull() & ~border).select(
            F.col("child").alias("box"), F.col("box").alias("up"), F.col("lowest").alias("parent"),
            (F.col("at") + F.col("shared") + 1).alias("at"), _words(F.col("ids"), F.col("shared")).alias("words"),
            rest.alias("ids"), "next", "n", "low",
        )


def _upper_nodes(heads: DataFrame) -> DataFrame:
    """A burst container's head and the nodes below it that all its rests share, one row each."""
    every = F.transform(
        F.sequence(F.lit(0), F.col("shared")),
        lambda j: F.when(j == 0, F.col("words")).otherwise(_words(F.col("first"), j - 1)),
    )
    return heads.withColumn("every", every).select("*", F.posexplode("every").alias("j", "_")).select(
        "box", "up", F.col("lowest").alias("conv_id"), (F.col("at") + F.col("j")).alias("depth"),
        F.when(F.col("j") == 0, F.col("parent")).otherwise(F.col("lowest")).alias("parent"), F.col("all").alias("n"),
        F.when(F.col("j") == F.col("shared"), F.col("kids")).otherwise(F.lit(1).cast("bigint")).alias("children"),
        F.lit(0).cast("bigint").alias("leaves"),
        ((F.col("all") - 1) * F.aggregate(
            F.slice("every", F.col("j") + 1, F.lit(SPAN + 1)), F.lit(0).cast("bigint"), lambda a, w: a + w
        )).alias("saved"),
        F.when(F.col("j") == F.col("shared"), F.col("ended")).alias("ended"),
        (F.col("j") == 0).alias("head"),
    )


class _Open:
    """A node of the sweep that further rests may still go through."""

    __slots__ = ("words", "n", "low", "children", "leaves", "saved", "ended", "closed", "ahead", "border")

    def __init__(self, words: int):
        self.words, self.n, self.low, self.children, self.leaves, self.saved = words, 0, None, 0, 0, 0
        self.ended, self.closed, self.ahead, self.border = None, [], [], []

    def count(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None or low < self.low else self.low


NODE_KIND, AHEAD_KIND, BORDER_KIND = 0, 1, 2
SWEPT = (
    "kind int, box string, up string, conv_id bigint, depth bigint, parent bigint, n bigint, children bigint, "
    "leaves bigint, saved bigint, ended bigint, head boolean, next string"
)


class _Sweep:
    """One container after another, each with its rests in order; rows for `SWEPT`.

    Nodes have the sums of their subtrees inside the container. A rest that goes on
    in another container gives a row for each node above (AHEAD) and one for
    the last of them (BORDER).
    """

    def __init__(self) -> None:
        self.box = None
        self.rows: list[tuple] = []

    def begin(self, box: str, up: str | None, parent: int | None, at: int, words: int) -> None:
        self.box, self.up, self.parent, self.at = box, up, parent, at
        self.open, self.last = [_Open(words)], b""

    def add(self, ids: bytes, further: str | None, n: int, low: int) -> None:
        length, shared = len(ids) // WIDTH, 0
        least = min(length, len(self.last) // WIDTH)
        while shared < least and ids[shared * WIDTH : shared * WIDTH + WIDTH] == self.last[shared * WIDTH : shared * WIDTH + WIDTH]:
            shared += 1
        while len(self.open) - 1 > shared:
            self.close()
        for place in range(len(self.open) - 1, length - (further is not None)):
            self.open[-1].children += 1
            cell = ids[place * WIDTH + DIGEST : place * WIDTH + WIDTH]
            self.open.append(_Open(int.from_bytes(cell, "big")))
        node = self.open[-1]
        node.count(n, low)
        if further is None:
            node.ended = low
        else:
            node.children += 1
            node.ahead.append(further)
            node.border.append(further)
        self.last = ids

    def close(self) -> None:
        node, depth = self.open.pop(), self.at + len(self.open)
        if not node.children:
            node.leaves += 1
        node.saved += (node.n - 1) * node.words
        head = not self.open
        of = (depth, node.n, node.children, node.leaves, node.saved, node.ended)
        for child in node.closed:
            self.node(child, node.low, False)
        for further in node.ahead:
            self.rows.append((AHEAD_KIND, self.box, None, node.low, depth, *[None] * 7, further))
        for further in node.border:
            self.rows.append((BORDER_KIND, self.box, None, node.low, depth, *[None] * 7, further))
        if head:
            self.node((node.low, of), self.parent, True)
            return
        above = self.open[-1]
        above.count(node.n, node.low)
        above.leaves += node.leaves
        above.saved += node.saved
        above.closed.append((node.low, of))
        above.ahead += node.ahead

    def node(self, child: tuple, parent: int | None, head: bool) -> None:
        low, (depth, *rest) = child
        self.rows.append((NODE_KIND, self.box, self.up if head else None, low, depth, parent, *rest, head, None))

    def end(self) -> None:
        while self.box is not None and self.open:
            self.close()


def swept(rests: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [
            {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]
            for c in SWEPT.split(", ")
        ]
        names = [c.split()[0] for c in SWEPT.split(", ")]
        sweep = _Sweep()

        def out() -> pa.RecordBatch:
            columns = list(zip(*sweep.rows)) or [()] * len(kinds)
            sweep.rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for box, up, parent, at, words, ids, further, n, low in zip(*(batch.column(c).to_pylist() for c in REST)):
                if box != sweep.box:
                    sweep.end()
                    sweep.begin(box, up, parent, at, words)
                sweep.add(ids, further, n, low)
                if len(sweep.rows) >= ROWS_OUT:
                    yield out()
        sweep.end()
        yield out()

    return rests.select(*REST).repartition("box").sortWithinPartitions("box", "ids").mapInArrow(run, SWEPT)


def subtree_sums(boxes: DataFrame) -> DataFrame:
    """(box, leaves, saved): sums over a container and all below it, of (box, up, leaves, saved).

    Each round doubles the reach: a container's sum goes to the ancestor at the reach.
    """
    state = settle(boxes)
    while not state.where(F.col("up").isNotNull()).isEmpty():
        below = state.where(F.col("up").isNotNull())
        given = below.groupBy(F.col("up").alias("box")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("further"))
        above = state.select(F.col("box").alias("up"), F.col("up").alias("higher"))
        # Heads without a parent have no key to join by.
        moved = below.join(above, "up").select("box", F.col("higher").alias("up"), "leaves", "saved").unionByName(
            state.where(F.col("up").isNull())
        )
        state = settle(
            moved.join(given, "box", "left").select(
                "box", "up", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("further", F.lit(0))).alias("saved"),
            )
        )
    return state.drop("up")


def trie(turns: DataFrame) -> DataFrame:
    """One row for each node, of (conv_id, turn, role, text)."""
    cut = settle(segments(rebuilt(turns)))
    placed = settle(members(cut))
    digests = settle(ends(placed))
    none = F.lit(None)
    rests = settle(
        placed.groupBy("box", "at", "words", "ids", "next").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
        .select("*", none.cast("string").alias("up"), none.cast("bigint").alias("parent")).select(*REST)
    )
    ready, upper, links = burst(rests)
    rows = settle(swept(ready))
    small = rows.where(F.col("kind") == NODE_KIND).select(*NODE, "head")
    border = rows.where(F.col("kind") == BORDER_KIND).select("next", F.col("conv_id").alias("parent"), F.col("box").alias("up"))
    links = settle(border if links is None else border.unionByName(links))
    upper = settle(upper) if upper is not None else small.where(F.lit(False))
    if not links.isEmpty():
        small, upper = _with_links(small, links), _with_links(upper, links)
    heads = small.where("head").unionByName(upper.where("head"))
    sums = subtree_sums(heads.select("box", "up", "leaves", "saved"))
    ahead = rows.where(F.col("kind") == AHEAD_KIND).select("conv_id", "depth", F.col("next").alias("box"))
    below = ahead.join(sums, "box").groupBy("conv_id", "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    if not links.isEmpty():
        small = small.join(below, ["conv_id", "depth"], "left").withColumns(
            {"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}
        )
    own = upper.where("head").select("box", F.col("saved").alias("own"))
    of_head = own.join(sums.select("box", F.col("leaves").alias("l"), F.col("saved").alias("s")), "box")
    upper = upper.join(of_head, "box").withColumns(
        {"leaves": F.col("l"), "saved": F.col("saved") + F.col("s") - F.col("own")}
    )
    nodes = small.select(*NODE).unionByName(upper.select(*NODE))
    last = F.col("ended").isNotNull()
    ended = nodes.where(last).join(digests, nodes["ended"] == digests["low"]).select(*NODE, "sha")
    whole = ended.unionByName(nodes.where(~last).withColumn("sha", F.lit(EMPTY_SHA)))
    return whole.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("sha").alias("ends_sha256"),
    )


def _with_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Heads of further segments learn the node and the container above them."""
    waits = F.col("head") & F.col("up").isNull() & (F.col("depth") > 0)
    named = sent_if_small(links.select(F.col("next").alias("box"), F.col("parent").alias("p"), F.col("up").alias("u")))
    told = nodes.where(waits).join(named, "box").withColumns({"parent": F.col("p"), "up": F.col("u")}).drop("p", "u")
    return nodes.where(~waits).unionByName(told)
