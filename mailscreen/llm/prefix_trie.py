"""The trie of conversation prefixes by a splitter skeleton.

Every distinct sequence of first d turns (role, text) of a conversation is a node of depth d;
the root has none.  A conversation is a member of all nodes on its path.

1. paths     A conversation becomes one thin row: the 128-bit digests of its turns in order,
             and the number of words of each.  Texts are not moved.
2. shards    The rows are range-partitioned by (path, conv_id): the members of a node lie
             next to each other, and those that end in it come first.  A path that very many
             conversations share is split by conv_id.
3. skeleton  Between two shards lies a splitter.  The prefixes that the last path before and
             the first path behind it have in common are the nodes that cross it; they form
             the skeleton, a trie of splitter paths with a number for each node.  It has at
             most one path per shard and is broadcast.
4. local     Each shard is read once, sorted, with a stack of the open nodes.  Nodes outside
             the skeleton lie in one shard and are finished there.  For each skeleton node a
             shard gives one partial row; it is made so that partials simply add up: the
             shard in which a node begins counts it as a child and takes off its one unsaved
             copy, the shard in which it ends says whether it is a leaf.
5. reduce    Partials of skeleton nodes are summed (combined before the shuffle), and the
             finished nodes below them learn their parent's smallest member from the result.

The digest of the members that end in a node is taken over their ids in order.  In a shard the
ids pass through an incremental SHA-256.  A skeleton node's ids leave the shards as sorted
chunks of up to `chunk_ids`; one task per node hashes its chunks in turn, as they arrive.

Memory: a task holds the nodes on one path and the finished children of those that are still
open, a part of one shard.  The driver holds two paths per shard.  A conversation's path (16
bytes a turn) is one row.

Edge cases: rows without a conv_id belong to no conversation and are left out; null turns come
first, ties in turn are ordered by role and by the digest of role and text, repeated rows are
turns of their own; null role or text is empty; a conversation without turns is a member of
the root only; other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen.session import join_summary, parallelism, written

WORDS = r"[^\x20\x09-\x0D]+"
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_LOCAL, _PARTIAL, _CHUNK = 0, 1, 2
_KINDS = {
    "kind": pa.int32(),
    "node": pa.int64(),  # number of the skeleton node; null for local ones
    "parent": pa.int64(),  # number of its parent, if that is in the skeleton
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends": pa.string(),  # digest of a local node, ids of a chunk
    "shard": pa.int64(),
    "seq": pa.int64(),
}
_SCHEMA = ", ".join(f"{name} {'string' if pa.types.is_string(kind) else 'int' if kind == pa.int32() else 'long'}" for name, kind in _KINDS.items())


@dataclass(frozen=True)
class TrieSettings:
    shards: int | None = None  # None: as many as there are shuffle partitions
    chunk_ids: int = 4096


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def conversation_paths(turns: DataFrame, within: Column | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path, words): the turns of each conversation in order, as digests and word counts.

    `within` is a key that all turns of a conversation share; the rows are laid out by it.
    """
    who, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    thin = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        (F.col(conv_id) if within is None else within).cast("bigint").alias("_within"),
        F.struct(
            F.col(turn).alias("turn"),
            who.alias("role"),
            turn_digest(who, said).alias("digest"),
            F.regexp_count(said, F.lit(WORDS)).alias("words"),
        ).alias("_turn"),
    )
    gathered = thin.repartition(parallelism(turns.sparkSession), "_within").groupBy("_within", "conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    return gathered.select("_within", "conv_id", F.col("_turns.digest").alias("path"), F.col("_turns.words").alias("words"))


def common_depth(a: list, b: list) -> int:
    depth = 0
    for x, y in zip(a, b):
        if x != y:
            break
        depth += 1
    return depth


@dataclass
class Skeleton:
    """Numbers of the nodes that cross the splitters; what a shard must know of its two."""

    left: dict[int, list[int]] = field(default_factory=dict)  # shard -> nodes by depth that begin before it
    right: dict[int, list[int]] = field(default_factory=dict)  # shard -> nodes by depth that go on behind it
    right_path: dict[int, list[bytes]] = field(default_factory=dict)


def build_skeleton(bounds: list[tuple[int, list[bytes], list[bytes]]]) -> Skeleton:
    """`bounds` are (shard, first path, last path) in order."""
    skeleton = Skeleton()
    open_: list[int] = []  # numbers of the nodes on the path of the last splitter
    path: list[bytes] = []
    count = 0
    for (shard, _, last), (following, first, _) in zip(bounds, bounds[1:]):
        shared = common_depth(last, first)
        same = min(common_depth(path, last), shared) + 1 if open_ else 0
        open_, path = open_[:same], last[:shared]
        while len(open_) <= shared:
            open_.append(count)
            count += 1
        skeleton.right[shard], skeleton.left[following], skeleton.right_path[shard] = list(open_), list(open_), path
    return skeleton


class _Node:
    __slots__ = ("depth", "words", "before", "after", "conv_id", "n", "longer", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, words: int, before: int | None, after: int | None) -> None:
        self.depth, self.words, self.before, self.after = depth, words, before, after
        self.conv_id: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.longer = False  # whether a member goes on below
        self.ends = None
        self.waiting: list[dict] = []  # finished children that lack the parent's smallest member

    @property
    def number(self) -> int | None:
        return self.before if self.before is not None else self.after


class ShardReader:
    """Turns the sorted rows of one shard into node rows."""

    def __init__(self, shard: int, skeleton: Skeleton, chunk_ids: int) -> None:
        self.shard, self.chunk_ids = shard, chunk_ids
        self.left, self.right = skeleton.left.get(shard, []), skeleton.right.get(shard, [])
        self.right_path = skeleton.right_path.get(shard, [])
        self.stack: list[_Node] = []
        self.path: list[bytes] = []
        self.matched = 0  # how far the path follows the splitter behind this shard
        self.first, self.seq = True, 0
        self.out: list[dict] = []

    def add(self, path: list[bytes], words: list[int], conv_id: int) -> None:
        shared = common_depth(self.path, path)
        while len(self.stack) > shared + 1:
            self._close()
        self.matched = min(self.matched, shared)
        while self.matched < len(path) and self.matched < len(self.right_path) and path[self.matched] == self.right_path[self.matched]:
            self.matched += 1
        while len(self.stack) <= len(path):
            depth = len(self.stack)
            before = self.left[depth] if self.first and depth < len(self.left) else None
            after = self.right[depth] if depth <= self.matched and depth < len(self.right) else None
            self.stack.append(_Node(depth, words[depth - 1] if depth else 0, before, after))
        self.first, self.path = False, path
        top = self.stack[-1]
        top.n += 1
        top.conv_id = conv_id if top.conv_id is None else min(top.conv_id, conv_id)
        self._end(top, conv_id)

    def _end(self, node: _Node, conv_id: int) -> None:
        if node.number is None:
            if node.ends is None:
                node.ends = hashlib.sha256(str(conv_id).encode())
            else:
                node.ends.update(b",%d" % conv_id)
            return
        if node.ends is None:
            node.ends = []
        node.ends.append(conv_id)
        if len(node.ends) >= self.chunk_ids:
            self._chunk(node)

    def _chunk(self, node: _Node) -> None:
        self.out.append({"kind": _CHUNK, "node": node.number, "ends": ",".join(map(str, node.ends)), "shard": self.shard, "seq": self.seq})
        self.seq += 1
        node.ends = []

    def _close(self) -> None:
        node = self.stack.pop()
        if not node.longer and node.after is None:
            node.leaves = 1
        node.saved += node.words * (node.n - (node.before is None))
        parent = self.stack[-1] if self.stack else None
        row = {"conv_id": node.conv_id, "depth": node.depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        if parent is not None:
            parent.longer = True
            parent.n += node.n
            parent.conv_id = node.conv_id if parent.conv_id is None else min(parent.conv_id, node.conv_id)
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.children += node.before is None
            row["parent"] = parent.number
        for child in node.waiting:
            child["parent_conv_id"] = node.conv_id
            self.out.append(child)
        if node.number is not None:
            if node.ends:
                self._chunk(node)
            self.out.append(row | {"kind": _PARTIAL, "node": node.number})
            return
        row |= {"kind": _LOCAL, "ends": (node.ends or hashlib.sha256()).hexdigest()}
        if parent is None or parent.number is not None:
            self.out.append(row)
        else:
            parent.waiting.append(row)

    def finish(self) -> None:
        while self.stack:
            self._close()


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in _KINDS.items()], names=list(_KINDS))


def _local_nodes(sharded: DataFrame, skeleton: Skeleton, settings: TrieSettings) -> DataFrame:
    shared = sharded.sparkSession.sparkContext.broadcast(skeleton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: ShardReader | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for shard, path, words, conv_id in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if reader is None or reader.shard != shard:
                        if reader is not None:
                            reader.finish()
                            yield _batch(reader.out)
                        reader = ShardReader(shard, shared.value, settings.chunk_ids)
                    reader.add(path, words, conv_id)
                if len(reader.out) >= 1024:
                    yield _batch(reader.out)
                    reader.out = []
        if reader is not None:
            reader.finish()
            yield _batch(reader.out)

    in_order = sharded.repartitionByRange(parallelism(sharded.sparkSession), "shard").sortWithinPartitions("shard", "path", "conv_id")
    return in_order.select(F.col("shard").cast("bigint"), "path", "words", "conv_id").mapInArrow(run, _SCHEMA)


def _chunk_digests(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256): the chunks of each node, hashed in order as they stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for number, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != node:
                    if digest is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = number, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array([d[0] for d in done], pa.int64()), "ends_sha256": pa.array([d[1] for d in done], pa.string())})
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "ends_sha256": pa.array([digest.hexdigest()], pa.string())})

    in_order = chunks.repartition(parallelism(chunks.sparkSession), "node").sortWithinPartitions("node", "shard", "seq")
    return in_order.select("node", "ends").mapInArrow(run, "node long, ends_sha256 string")


def prefix_trie(paths: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """The nodes of the trie of (conv_id, path, words), one row each, as NODE_COLUMNS.

    `parent_conv_id` is the parent's smallest member (null for the root); `n_leaves` and
    `saved_tokens` run over the node's subtree, the node included.
    """
    spark = paths.sparkSession
    shards = settings.shards or parallelism(spark)
    ranged = paths.select("path", "words", "conv_id").repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    sharded = written(ranged, "trie-shards")
    ends = sharded.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).collect()
    skeleton = build_skeleton([(r["shard"], list(map(bytes, r["first"])), list(map(bytes, r["last"]))) for r in sorted(ends, key=lambda r: r["shard"])])
    found = written(_local_nodes(sharded, skeleton, settings), "trie-nodes")

    partials = found.where(F.col("kind") == _PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    digests = _chunk_digests(found.where(F.col("kind") == _CHUNK))
    crossing = written(partials.join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "trie-skeleton")
    tops = crossing.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    local = found.where(F.col("kind") == _LOCAL).withColumn("ends_sha256", F.col("ends"))
    local = join_summary(local, tops, ["parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    above = join_summary(crossing, tops, ["parent"], "left").withColumn("parent_conv_id", F.col("_above"))
    return local.select(*NODE_COLUMNS).unionByName(above.select(*NODE_COLUMNS))


def rebuilt_conversations(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, path, words) of conversations that share openings, as of an agent's sessions.

    Conversation c begins with the first h turns of conversation c - c % group (all if it has
    fewer, none if it is absent) and goes on with its own from turn h on, where h is
    crc32(c) % most.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    own = conversation_paths(turns, base)
    # Laid out by the base already, which has at most 2 * group conversations.
    opening = F.max(F.when(F.col("conv_id") == F.col("_within"), F.struct(*[F.slice(c, 1, most - 1).alias(c) for c in ("path", "words")]))).over(Window.partitionBy("_within"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.select("conv_id", "path", "words", opening.alias("_o"), h.alias("_h"))

    def spliced(name: str) -> Column:
        nothing = F.slice(name, 1, 0)
        head = F.coalesce(F.slice(F.col(f"_o.{name}"), F.lit(1), F.col("_h")), nothing)
        return F.concat(head, F.slice(name, F.col("_h") + 1, F.greatest(F.size(name) - F.col("_h"), F.lit(0))))

    return joined.select("conv_id", spliced("path").alias("path"), spliced("words").alias("words"))
