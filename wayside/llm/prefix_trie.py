"""Prefix trie of conversations: which openings are shared, by whom, and how many tokens sharing them saves.

A prefix of a conversation is known by a 128-bit digest: the exclusive or of a hash of every turn with its depth. So the
digests of all prefixes are running values, made in sorted ranges, and the digest of a prefix's parent is one step away.

*Screening.* All prefix digests are counted in a count-min sketch whose cells stop at two. An estimate is never below the
truth, so an estimate of one proves that a prefix belongs to one conversation; with its parent's estimate the node is known
where its row stands, and tails are emitted there. Only prefixes that may be shared are shuffled, and grouped exactly.

*Subtrees without descending.* A node belongs to its smallest member. So what a subtree sums over its nodes is what its
members sum over the deeper prefixes they own: one running sum per conversation, then one grouping by digest. Rounds do not
grow with the depth.

The sketch has ROWS x ``width`` cells of a byte, ``width`` the power of two from twice the number of prefixes on and at most
2^23 (32 MB), which bounds what is merged and broadcast. Beyond some ten million prefixes more and more singletons pass
for shared: they are shuffled too, and results stay the same.

Turns are ordered by turn number (null first), role and a hash of the text. Null role or text is empty. Rows without a conversation id
take part in nothing; repeated rows are turns of their own. An empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.llm.text import whole, words
from wayside.operators.ordered import Order, positions, runnings
from wayside.session import cut, join_counted

ROWS = 4
LEAST_WIDTH, MOST_WIDTH = 1 << 13, 1 << 23
PIECE = 1 << 13  # cells of a piece of the sketch: what tasks hand over and merge
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
LISTED = 100_000  # member ids in one piece of a list
NONE_SHA = hashlib.sha256(b"").hexdigest()


# --- turns ----------------------------------------------------------------------------------------


def digested(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns without their texts: conv_id, pos (from 0, by turn), d1 and d2 (a 128-bit digest of role and text), n_words, last."""
    said = F.struct(whole(role).alias("role"), whole(text).alias("text"))
    slim = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said.alias("s"))
    slim = slim.select(
        "conv_id", "turn", F.col("s.role").alias("role"), *[F.xxhash64(F.lit(i), "s.role", "s.text").alias(f"d{i}") for i in (1, 2)],
        F.size(words("s.text")).cast("long").alias("n_words"))
    order = Order(("conv_id",), "turn", ("role", "d1", "d2"))
    placed = positions(cut(slim), order)
    return placed.select("conv_id", "pos", "d1", "d2", "n_words", (F.col("pos") == F.col("n") - 1).alias("last"))


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per conversation and depth from 1 on: conv_id, depth, x and y (the prefix's digest), px and py (its parent's),
    n_words, last. ``turns``: as ``digested`` gives them."""
    step = {"x": F.xxhash64("pos", "d1", "d2"), "y": F.xxhash64("d2", "pos", "d1")}
    given = cut(turns.withColumns({f"h{c}": h for c, h in step.items()}))
    order = Order(("conv_id",), "pos").sampled(given)
    summed = runnings(given, order, {c: F.col(f"h{c}") for c in step}, "xor")
    return summed.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"),
        F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "n_words", "last")


# --- screening ------------------------------------------------------------------------------------


def cells_of(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Cell of every digest in each row of the sketch (ROWS x n)."""
    a, b = x.view(np.uint64), y.view(np.uint64)
    mixed = (a[None, :] ^ (b[None, :] * MIX[:, None])) * MIX[::-1, None]
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(width)).astype(np.int64)


class Sketch:
    """Counters that stop at two, ROWS x width of them in one row."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.piece = min(PIECE, width)
        self.cells = np.zeros(ROWS * width, np.uint8)

    def places(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return cells_of(x, y, self.width) + np.arange(ROWS)[:, None] * self.width

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        held, n = np.unique(self.places(x, y), return_counts=True)
        self.cells[held] = np.minimum(self.cells[held] + np.minimum(n, 2), 2)

    def merge(self, piece: int, counts: bytes) -> None:
        mine = self.cells[piece * self.piece:(piece + 1) * self.piece]
        np.minimum(mine + np.frombuffer(counts, np.uint8), 2, out=mine)

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        for piece in np.unique(np.flatnonzero(self.cells) // self.piece).tolist():
            yield piece, self.cells[piece * self.piece:(piece + 1) * self.piece].tobytes()

    def single(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the estimate of a digest, the least of its counters, is one."""
        return (self.cells[self.places(x, y)] == 1).any(0)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


SKETCH_ROW = "piece int, counts binary"


def handed_over(sketch: Sketch) -> Iterator[pa.RecordBatch]:
    for piece, counts in sketch.pieces():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([counts], pa.binary())], names=["piece", "counts"])


def sketch_of(found: DataFrame, width: int) -> Sketch:
    """The sketch of all rows (x, y). Tasks hand over the pieces they touched; pieces are merged as they come in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Sketch(width)
        for batch in batches:
            mine.add(numbers(batch, "x"), numbers(batch, "y"))
        yield from handed_over(mine)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Sketch(width)
        for batch in batches:
            for piece, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                mine.merge(piece, counts)
        yield from handed_over(mine)

    parts = found.select("x", "y").mapInArrow(count, SKETCH_ROW)
    whole_sketch = Sketch(width)
    for row in parts.repartition("piece").mapInArrow(merged, SKETCH_ROW).collect():  # ROWS x width bytes at most
        whole_sketch.merge(row["piece"], bytes(row["counts"]))
    return whole_sketch


def screened(found: DataFrame, most: int = MOST_WIDTH) -> DataFrame:
    """Rows of ``prefixes`` with ``single`` and ``parent_single``: whether the estimate proves a prefix one conversation's own."""
    n = found.count()
    width = min(most, max(LEAST_WIDTH, 1 << (2 * n).bit_length()))
    known = found.sparkSession.sparkContext.broadcast(sketch_of(found, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                mine, above = (known.value.single(numbers(batch, a), numbers(batch, b)) for a, b in (("x", "y"), ("px", "py")))
                above &= numbers(batch, "depth") > 1  # the root is everybody's
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(mine), pa.array(above)], names=[*batch.schema.names, "single", "parent_single"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(run, f"{fields}, single boolean, parent_single boolean")


# --- nodes ----------------------------------------------------------------------------------------


def id_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the hash of the ids of each node, ascending and joined by commas.

    Ids are sorted in ranges and joined range by range; the hash, which is sequential by nature, reads a node's pieces in
    order and holds one at a time.
    """
    order, dealt = Order(("node",), "conv_id", (), LISTED).dealt(ends)
    pieces = dealt.groupBy("node", "_range").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    sorted_pieces = pieces.repartition("node").sortWithinPartitions("node", "_range").select("node", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([node], pa.string()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

        for batch in batches:
            for here, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if here == node:
                    state.update(b",")
                else:
                    if node is not None:
                        yield done()
                    node, state = here, hashlib.sha256()
                state.update(ids.as_py().encode())
        if node is not None:
            yield done()

    return sorted_pieces.mapInArrow(run, "node string, ends_sha256 string")


def node_name(x: str, y: str) -> Column:
    return F.concat_ws("/", F.hex(x), F.hex(y))


def trie(turns: DataFrame, members: DataFrame | None = None, most_width: int = MOST_WIDTH) -> DataFrame:
    """One row per node of the trie, the root included.

    ``turns``: conv_id, pos (0, 1, … in every conversation), d1, d2, n_words, last, as ``digested`` makes them. ``members``: all
    conversations (conv_id), for those without turns; by default those that have any.

    conv_id: smallest member. depth. parent_conv_id: the parent's smallest member (root: null). n_convs: members. n_children.
    n_leaves: nodes without children in the subtree. saved_tokens: words that members beyond the first need not repeat, over
    the subtree. ends_sha256: hash of the ids of those members that end here, ascending and joined by commas.
    """
    rows = cut(screened(cut(prefixes(turns)), most_width))
    all_members = rows.select("conv_id").distinct() if members is None else members.select("conv_id").distinct()
    having = rows.where("depth = 1").select("conv_id", F.lit(True).alias("some"))
    zero, one = (F.lit(n).cast("long") for n in (0, 1))
    roots = all_members.join(having, "conv_id", "left").select(
        "conv_id", zero.alias("depth"), zero.alias("x"), zero.alias("y"), F.lit(None).cast("long").alias("px"),
        F.lit(None).cast("long").alias("py"), zero.alias("n_words"), F.col("some").isNull().alias("last"), F.lit(False).alias("parent_single"))
    # prefixes that may be shared, and the root of every conversation
    maybe = rows.where("NOT single").drop("single")
    shared = cut(maybe.unionByName(roots).withColumns({"node": node_name("x", "y"), "parent": node_name("px", "py")}))
    grouped = cut(shared.groupBy("node").agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"),
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("parent_single").alias("parent_single")))

    # children of grouped nodes, themselves grouped or proven single, find their parent's smallest member
    kid = ["parent", "node", "conv_id", "depth", "last"]
    heads = rows.where("single AND NOT parent_single").select(
        node_name("px", "py").alias("parent"), F.lit(None).cast("string").alias("node"), "conv_id", "depth", "last")
    inner = grouped.where("depth > 0 AND NOT parent_single").select(
        "parent", "node", F.col("owner").alias("conv_id"), "depth", F.lit(False).alias("last"))
    kids = cut(heads.select(kid).unionByName(inner.select(kid)))
    children = cut(kids.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).join(
        grouped.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id")), "parent"))
    placed = cut(join_counted(kids, children, "parent", "n_children"))

    # what a member adds to the subtrees it lies in: words of nodes it does not own, and the leaf where it ends, if it owns it
    met = join_counted(shared.select("node", "conv_id", "depth", "n_words", "last"), grouped.select("node", "owner", "n_convs", "n_ends"), "node", "n_convs")
    own = F.col("owner") == F.col("conv_id")
    added = met.select(
        "node", "conv_id", (-F.col("depth")).alias("up"), F.when(own, 0).otherwise(F.col("n_words")).alias("spared"),
        (own & F.col("last") & (F.col("n_convs") == F.col("n_ends"))).cast("long").alias("leaf"))
    lone_ends = rows.where("single AND last").select(
        F.lit(None).cast("string").alias("node"), "conv_id", (-F.col("depth")).alias("up"), zero.alias("spared"), one.alias("leaf"))
    below = runnings(cut(added.unionByName(lone_ends)), Order(("conv_id",), "up"), {"saved": F.col("spared"), "leaves": F.col("leaf")})
    sums = below.where("node IS NOT NULL").groupBy("node").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    ends = id_lists(cut(shared.where("last").select("node", "conv_id")))
    above = placed.where("node IS NOT NULL").select("node", "parent_conv_id")
    counts = children.select(F.col("parent").alias("node"), "n_children")
    full = grouped.join(sums, "node").join(ends, "node", "left").join(counts, "node", "left").join(above, "node", "left")
    nodes = full.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("parent_single"), F.col("owner")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.when(F.col("n_ends") == F.col("n_convs"), zero).otherwise(one)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE_SHA)).alias("ends_sha256"))
    proven = placed.where("node IS NULL").select("conv_id", "depth", "parent_conv_id", "last").unionByName(
        rows.where("single AND parent_single").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "last"))
    own_end = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    lone = proven.select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(F.col("last"), zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("last"), own_end).otherwise(F.lit(NONE_SHA)).alias("ends_sha256"))
    return nodes.unionByName(lone)


# --- rebuilt conversations ------------------------------------------------------------------------


def with_openings(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first turns replaced by those of another: (turns, members).

    ``base``: of conv_id, the conversation whose opening is taken; ``taken``: how many turns, three at most. A conversation
    gets the first ``taken`` turns of its base (all if fewer, none if there is no such conversation) and its own turns after
    its first ``taken``.
    """
    said = ["pos", "d1", "d2", "n_words"]
    openings = turns.where("pos < 3").groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct(*said))).alias("said"))
    every = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    plans = every.select("conv_id", "n", base.cast("long").alias("base"), taken.cast("int").alias("taken")).join(openings, "base", "left")
    none = F.array().cast("array<struct<pos:bigint,d1:bigint,d2:bigint,n_words:bigint>>")
    opening = F.slice(F.coalesce("said", none), F.lit(1), F.col("taken"))
    plans = cut(plans.select("conv_id", "n", "taken", opening.alias("opening"), F.size(opening).alias("got")))
    heads = plans.select("conv_id", "n", "taken", "got", F.inline("opening")).select(
        "conv_id", *said, ((F.col("n") <= F.col("taken")) & (F.col("pos") == F.col("got") - 1)).alias("last"))
    own = join_counted(turns, plans.select("conv_id", "n", "taken", "got"), "conv_id", "n").where("pos >= taken")
    moved = own.withColumn("pos", F.col("pos") - F.col("taken") + F.col("got")).select("conv_id", *said, "last")
    return heads.unionByName(moved), plans.select("conv_id")
