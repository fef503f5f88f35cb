"""Prefix trie of conversations by truncation peeling.

A conversation is the path of its turns; every prefix is a node. Nodes are peeled from
their deepest turn: conversations that end on a node are merged with the nodes that survive
below it, the last turn is stripped, and what is left is regrouped under the shorter prefix, which
gathers its totals while it is found. Nothing is looked at twice.

A round for each depth would be a shuffle for each turn of the longest conversation. Here
paths are range-sorted, so that nodes to be regrouped are neighbours, and each task peels its range
in one pass that holds one path. Only prefixes of a range's first and last path can go
on in another range: these two come out unfinished, and a second pass over them, two rows a
range, finishes them. Copies of one conversation are spread over ranges by their ids.

Turns are told apart by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import whole_text
from mercato.session import checkpoint

#: Bytes of a path for each turn: the turn's digest and the length of its text.
DIGEST = 16
STEP = DIGEST + 4


def turn_step(role: Column, text: Column) -> Column:
    """A turn as ``STEP`` bytes in hex: its digest, then the UTF-8 bytes of its text."""
    length = F.octet_length(text)
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(framed, 256), 1, 2 * DIGEST), F.lpad(F.hex(length), 2 * STEP - 2 * DIGEST, "0"))


def conversation_paths(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, path) of every conversation, its turns in order as one binary.

    Turns are ordered by number, null first; turns of one number by their
    digest, and repeated rows are turns of their own. Null roles and texts count as empty. A null
    id names no conversation. A conversation's digests, 20 bytes a turn, are one row.
    """
    steps = turns.filter(F.col(f"`{id}`").isNotNull()).select(
        F.col(f"`{id}`").cast("bigint").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"), F.unhex(turn_step(whole_text(role), whole_text(text))).alias("step")
        ).alias("entry"),
    )
    whole = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    joined = F.array_join(F.transform("entries", lambda e: F.hex(e["step"])), "")
    return whole.select("conv_id", F.unhex(joined).alias("path"))


def rebuilt(paths: DataFrame, base: Column, shared: Column) -> DataFrame:
    """Each conversation with the first ``shared`` turns of conversation ``base`` for its own first ones.

    A base that is not there gives no turns. The columns are of ``paths``.
    """
    wanted = paths.select("conv_id", "path", base.alias("base"), shared.cast("int").alias("shared"))
    bases = paths.select(F.col("conv_id").alias("base"), F.col("path").alias("start"))
    met = wanted.join(bases, "base", "left")
    start = F.substring(F.coalesce("start", F.lit(b"")), F.lit(1), F.col("shared") * STEP)
    return met.select(
        "conv_id",
        F.concat(start, F.substring("path", F.col("shared") * STEP + 1, F.octet_length("path"))).alias("path"),
    )


class _Node:
    """Totals of a prefix while its subtree is peeled."""

    __slots__ = ("key", "size", "least", "count", "children", "leaves", "saved", "ends", "digest")

    def __init__(self, key: bytes, size: int):
        self.key, self.size = key, size
        self.least: int | None = None
        self.count = self.children = self.leaves = self.saved = 0
        #: Ids that end here: as they are for other tasks, or their digest so far.
        self.ends: list[bytes] = []
        self.digest = None

    def end(self, ids: bytes, whole: bool) -> None:
        if not whole:
            self.ends.append(ids)
        elif self.digest is None:
            self.digest = hashlib.sha256(ids)
        else:
            self.digest.update(b"," + ids)

    def merge(self, least: int | None, count: int, children: int, leaves: int, saved: int) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.count += count
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def finish(self) -> None:
        """Close the node; all its members are known."""
        self.saved += (self.count - 1) * self.size
        if not self.children:
            self.leaves = 1


ROOT = bytes(DIGEST)
_CLOSED = pa.schema(
    [
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)
_PART = pa.struct(
    [
        ("least", pa.int64()),
        ("count", pa.int64()),
        ("children", pa.int64()),
        ("leaves", pa.int64()),
        ("saved", pa.int64()),
        ("ends", pa.binary()),
    ]
)
_OPEN = pa.schema([("place", pa.int64()), ("path", pa.binary()), ("first", pa.int64()), ("parts", pa.list_(_PART))])
_BOTH = pa.schema([*_CLOSED, *_OPEN])
_DDL = (
    "key binary, parent_key binary, conv_id bigint, depth bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, ends_sha256 string, place bigint, path binary, first bigint,"
    " parts array<struct<least: bigint, count: bigint, children: bigint, leaves: bigint, saved: bigint, ends: binary>>"
)
ROWS = 4096


class _Peeler:
    """Peels paths that come in order. ``whole`` says that no other task has further members."""

    def __init__(self, whole: bool):
        self.whole = whole
        self.first: bytes | None = None
        self.path = b""
        #: Nodes of the present path, the root first.
        self.stack: list[_Node] = []
        #: Parts of nodes on the first path that the present path left, deepest first.
        self.head: list[dict] = []
        #: Turns that all paths so far share with the first.
        self.common = 0
        self.out: list[dict] = []

    def add(self, path: bytes, first: int, parts: list[dict]) -> None:
        """Parts of the nodes at depths ``first`` and below on ``path``."""
        if self.first is None:
            self.first = self.path = path
            self.common = len(path) // STEP
            self.stack = [_Node(ROOT, 0)]
            self._extend(path)
        shared, most = 0, min(len(path), len(self.path)) // STEP
        while shared < most and path[shared * STEP : shared * STEP + STEP] == self.path[shared * STEP : shared * STEP + STEP]:
            shared += 1
        self._strip(shared)
        self._extend(path)
        for depth, part in enumerate(parts, start=first):
            node = self.stack[depth]
            node.merge(part["least"], part["count"], part["children"], part["leaves"], part["saved"])
            if part["ends"]:
                node.end(part["ends"], self.whole)

    def _extend(self, path: bytes) -> None:
        """Go down to the end of ``path``, which begins with the stripped one."""
        for at in range((len(self.stack) - 1) * STEP, len(path), STEP):
            step = path[at : at + STEP]
            key = hashlib.sha256(self.stack[-1].key + step).digest()[:DIGEST]
            self.stack.append(_Node(key, int.from_bytes(step[DIGEST:], "big")))
        self.path = path

    def _strip(self, depth: int) -> None:
        """Strip turns from the present path until ``depth`` are left."""
        while len(self.stack) > depth + 1:
            at = len(self.stack) - 1
            node = self.stack.pop()
            above = self.stack[-1]
            if self.whole or at > self.common:
                node.finish()
                self.out.append(self._closed(node, above.key, at))
                above.merge(node.least, node.count, 1, node.leaves, node.saved)
            else:
                # Other tasks may have members of a prefix of the first path; its totals go on without it.
                self.head.append(self._part(node))
        self.common = min(self.common, depth)

    def _closed(self, node: _Node, parent: bytes | None, depth: int) -> dict:
        ends = node.digest or hashlib.sha256(b",".join(node.ends))
        return {
            "key": node.key,
            "parent_key": parent,
            "conv_id": node.least,
            "depth": depth,
            "n_convs": node.count,
            "n_children": node.children,
            "n_leaves": node.leaves,
            "saved_tokens": node.saved,
            "ends_sha256": ends.hexdigest(),
        }

    def _part(self, node: _Node) -> dict:
        return {
            "least": node.least,
            "count": node.count,
            "children": node.children,
            "leaves": node.leaves,
            "saved": node.saved,
            "ends": b",".join(node.ends),
        }

    def end(self, place: int) -> None:
        """Finish the nodes that are left, or give them out unfinished."""
        if self.first is None:
            return
        if self.whole:
            self._strip(0)
            root = self.stack.pop()
            root.finish()
            self.out.append(self._closed(root, None, 0))
            return
        if self.head:
            depth = len(self.first) // STEP - len(self.head) + 1
            self.out.append(
                {"place": 2 * place, "path": self.first, "first": depth, "parts": self.head[::-1]}
            )
        parts = [self._part(node) for node in self.stack]
        self.out.append({"place": 2 * place + 1, "path": self.path, "first": 0, "parts": parts})

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= least:
            yield pa.RecordBatch.from_pylist(self.out, schema=_BOTH)
            self.out = []


def _peel(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peeler = _Peeler(whole)
        for batch in batches:
            for row in batch.to_pylist():
                if whole:
                    peeler.add(row["path"], row["first"], row["parts"])
                else:
                    mine = {"least": row["conv_id"], "count": 1, "children": 0, "leaves": 0, "saved": 0}
                    path = row["path"]
                    peeler.add(path, len(path) // STEP, [mine | {"ends": str(row["conv_id"]).encode()}])
                yield from peeler.batches(ROWS)
        peeler.end(TaskContext.get().partitionId())
        yield from peeler.batches(1)

    return run


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row for every node of the trie of ``paths`` (conv_id, path), the empty prefix included.

    ``conv_id`` is the smallest member's, ``parent_conv_id`` that of the prefix one turn shorter (null for
    the root), ``n_convs`` counts members, ``n_children`` prefixes one turn longer, ``n_leaves`` childless nodes of
    the subtree, ``saved_tokens`` sums over the subtree each node's (members - 1) times the bytes
    of its last text, and ``ends_sha256`` is the digest of the ids that end here, ascending and comma-joined.
    A conversation without turns ends on the root. No conversations give no rows.

    A task holds one path and the ids of its copies in its range; ids of a node
    that many ranges share are hashed one range after the other.
    """
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    peeled = checkpoint(ordered.mapInArrow(_peel(False), _DDL))
    ranges = peeled.filter(F.col("place").isNotNull()).select(*_OPEN.names)
    last = ranges.repartition(1).sortWithinPartitions("place").mapInArrow(_peel(True), _DDL)
    nodes = checkpoint(
        peeled.filter(F.col("place").isNull()).select(*_CLOSED.names).unionByName(last.select(*_CLOSED.names))
    )
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent_key", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations, each rebuilt on the first turns of the one at the head of its five."""
    paths = checkpoint(conversation_paths(conversations))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie(rebuilt(paths, F.col("conv_id") - F.col("conv_id") % 5, shared))
