"""Conversation prefix trie: union-find over the common prefixes of sorted neighbours, partition forests merged over their borders.

Conversations are strings of fixed-size turn tokens.  Spark sorts them in ranges; a range joins its neighbours in descending order of
their common depth, and every merge of two components makes (or extends) a branching node.  Nodes that no later range can reach are
finished; what lies above the first and the last string of a range is contracted to a few marks and joined with the next ranges' in a tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5, sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.store import stage

#: Bytes of a turn's token: 16 of its hash, 8 of the length of its text.
TOKEN = 24
#: A conversation takes its first turns from the first of its ``SIBLINGS``; how many, by its hash modulo ``HEADS``.
SIBLINGS, HEADS = 5, 9
#: Ranges that one task of the tree takes in.
FAN = 8
NO_MEMBER = sha256(b"").hexdigest()

NODE = "key string, parent_key string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
OPEN = "part bigint, first binary, last binary, marks array<struct<on_last: boolean, depth: bigint, n: bigint, least: bigint, children: bigint, leaves: bigint, saved: bigint>>"
#: kind 0: a finished node; 1: an open range; 2: members that end at a node which is still open.
ROW = f"kind int, {NODE}, {OPEN}, ids binary"
_MARK = pa.struct([("on_last", pa.bool_()), *((c, pa.int64()) for c in ("depth", "n", "least", "children", "leaves", "saved"))])
_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.string()), ("parent_key", pa.string()), *((c, pa.int64()) for c in (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("part", pa.int64()),
    ("first", pa.binary()), ("last", pa.binary()), ("marks", pa.list_(_MARK)), ("ids", pa.binary())])


def turn_tokens(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, token) of the rows with a conv_id; null roles and texts are empty."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), F.concat(name, size).alias("token"))


def head_size(conv_id: int) -> int:
    return crc32(str(conv_id).encode()) % HEADS


def _rebuilt(siblings: int):
    """Sorted turns, siblings together and their first one leading -> one row per conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = head = conv = None
        held: list[bytes] = []

        def close() -> tuple[int, bytes]:
            nonlocal head
            own = b"".join(held)
            if conv == group:
                head = own[:TOKEN * HEADS]
                return conv, own
            h = TOKEN * head_size(conv)
            return conv, head[:h] + own[h:]

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, convs = (batch.column(i).to_numpy() for i in (0, 1))
            data = b"".join(batch.column(2).to_pylist())
            starts = np.flatnonzero(np.r_[True, convs[1:] != convs[:-1]])
            out = []
            for a, b in zip(starts.tolist(), np.r_[starts[1:], len(convs)].tolist()):
                if convs[a] != conv:
                    if conv is not None:
                        out.append(close())
                    if groups[a] != group:
                        group, head = int(groups[a]), b""
                    conv, held = int(convs[a]), []
                held.append(data[a * TOKEN:b * TOKEN])
            yield _strings(out)
        if conv is not None:
            yield _strings([close()])

    return run


def _strings(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["conv_id", "seq"])


def turn_strings(conversations: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """(conv_id, seq), one row per conversation: its tokens by turn (null first, equal turns by token).

    With ``siblings`` above 1 the first turns come from the conversation conv_id - conv_id % siblings, as many as ``head_size`` says.
    One shuffle of 32 bytes a turn brings siblings together; a task streams its sorted turns and holds one conversation.
    """
    tokens = turn_tokens(conversations).withColumn("g", F.col("conv_id") - F.col("conv_id") % siblings)
    together = tokens.repartition("g").sortWithinPartitions("g", F.col("conv_id") != F.col("g"), "conv_id", F.asc_nulls_first("turn"), "token")
    return together.select("g", "conv_id", "token").mapInArrow(_rebuilt(siblings), "conv_id bigint, seq binary")


def common_depth(a: bytes, b: bytes) -> int:
    """Tokens that two strings share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TOKEN
    lo, hi = 0, n  # equal up to lo, not up to hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo // TOKEN


class Item:
    """A string of the sorted order, and what hangs below it without being listed: members, finished children, their sums."""

    __slots__ = ("seq", "n", "least", "children", "leaves", "saved", "ids")

    def __init__(self, seq, n=0, least=None, children=0, leaves=0, saved=0, ids=None):
        self.seq, self.n, self.least, self.children, self.leaves, self.saved, self.ids = seq, n, least, children, leaves, saved, ids

    def add(self, other: Item) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved


def grow(items: list[Item]) -> tuple[list[Item], np.ndarray, list[int]]:
    """Distinct sorted strings -> (nodes, their depths, their parents; -1 above the top node); the items are the first nodes."""
    nodes, m = list(items), len(items)
    depth = [len(i.seq) // TOKEN for i in items]
    above = [-1] * m
    edges = np.array([common_depth(a.seq, b.seq) for a, b in zip(items, items[1:])], np.int64)
    leader, top = list(range(m)), list(range(m))

    def find(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    # Deepest first, equal depths from the left: the right component then always starts below the edge's depth.
    for e in np.argsort(-edges, kind="stable").tolist():
        d, a, b = int(edges[e]), find(e), find(e + 1)
        over = top[a]
        if depth[over] != d:
            over = len(nodes)
            nodes.append(Item(items[e].seq[:d * TOKEN]))
            depth.append(d)
            above.append(-1)
            above[top[a]] = over
        above[top[b]] = over
        leader[b] = a
        top[a] = over
    return nodes, np.array(depth), above


def resolve(items: list[Item], part: int, ends: tuple[bytes, bytes] | None, level: int) -> Iterator[dict]:
    """Rows of ``ROW``: the nodes that are finished within this range and what stays open, the nodes above its first and last string ``ends``.

    No ``ends``: the range is the whole order.
    """
    nodes, depth, above = grow(items)
    bottom_up = np.argsort(-depth, kind="stable").tolist()
    open_ = set()
    place = {item.seq: i for i, item in enumerate(items)} if ends else {}
    for end in map(place.__getitem__, ends or ()):
        while end >= 0 and end not in open_:
            open_.add(end)
            end = above[end]
    sizes: dict[int, np.ndarray] = {}
    # Sums over whole subtrees: of a finished node they go to the node above it.
    done: dict[int, tuple[int, ...]] = {}
    for i in bottom_up:
        if i in open_:
            continue
        node, up = nodes[i], above[i]
        low, high = int(depth[up]) if up >= 0 else -1, int(depth[i])
        chars = np.frombuffer(node.seq, ">i8")[2::3][max(low, 0):high].astype(np.int64)
        leaves = node.leaves if node.children else 1
        # One entry per depth from low + 1 to high.
        own = (node.n - 1) * (chars if low >= 0 else np.r_[0, chars])
        saved = node.saved + np.cumsum(own[::-1])[::-1]
        sizes[i] = saved
        done[i] = (node.n, node.least, leaves)
        if up >= 0:
            nodes[up].add(Item(b"", node.n, node.least, 1, leaves, int(saved[0])))
    for i, (n, least, leaves) in done.items():
        node, up, saved = nodes[i], above[i], sizes[i]
        high = int(depth[i])
        low = high - len(saved)
        for d in range(low + 1, high + 1):
            row = {"kind": 0, "conv_id": least, "depth": d, "n_convs": n, "n_children": 1, "n_leaves": leaves, "saved_tokens": int(saved[d - low - 1]), "ends_sha256": NO_MEMBER}
            if d > low + 1:
                row["parent_conv_id"] = least
            elif up >= 0 and up in open_:
                row["parent_key"] = md5(nodes[up].seq).hexdigest()
            elif up >= 0:
                row["parent_conv_id"] = done[up][1]
            if d == high:
                row["n_children"] = node.children
                if level:
                    row["key"], row["ends_sha256"] = md5(node.seq).hexdigest(), None
                elif node.ids:
                    row["ends_sha256"] = sha256(node.ids).hexdigest()
            yield row
    if open_:
        first, last = ends
        marks = []
        for i in sorted(open_, key=lambda i: depth[i]):
            node = nodes[i]
            if node.ids:
                yield {"kind": 2, "key": md5(node.seq).hexdigest(), "part": part, "ids": node.ids}
            if node.n:
                marks.append({"on_last": not first.startswith(node.seq), "depth": int(depth[i]), "n": node.n, "least": node.least, "children": node.children,
                              "leaves": node.leaves, "saved": node.saved})
        yield {"kind": 1, "part": part, "first": first, "last": last, "marks": marks}


def _batches(rows: Iterable[dict], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
            held = []
    yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def range_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range of strings -> its finished nodes and its open ends.  Equal strings are one item with the list of its members."""
    items: list[Item] = []
    ids: list[str] = []
    for batch in batches:
        for conv, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not items or items[-1].seq != seq:
                if items:
                    items[-1].ids = ",".join(ids).encode()
                items.append(Item(seq, 0, conv))
                ids = []
            items[-1].n += 1
            items[-1].least = min(items[-1].least, conv)
            ids.append(str(conv))
    if items:
        items[-1].ids = ",".join(ids).encode()
        yield from _batches(resolve(items, TaskContext.get().partitionId(), (items[0].seq, items[-1].seq), 0))


def border_forest(final: bool):
    """Open ranges that lie side by side -> the nodes finished by their union and, unless ``final``, one open range."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found: dict[bytes, Item] = {}
        parts = sorted(table.select(["part", "first", "last", "marks"]).to_pylist(), key=lambda p: p["part"])
        for p in parts:
            for m in p["marks"]:
                item = Item((p["last"] if m["on_last"] else p["first"])[:m["depth"] * TOKEN], m["n"], m["least"], m["children"], m["leaves"], m["saved"])
                if item.seq in found:
                    found[item.seq].add(item)
                else:
                    found[item.seq] = item
        if final:
            found.setdefault(b"", Item(b""))
        items = [found[s] for s in sorted(found)]
        return pa.Table.from_batches(_batches(resolve(items, parts[0]["part"] // FAN, None if final else (parts[0]["first"], parts[-1]["last"]), 1)), _SCHEMA)

    return run


def member_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists in order of (node, range) -> one hash per node, streamed: a node's list is never held whole."""
    now = state = None
    for batch in batches:
        keys, values = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key == now:
                state.update(b"," + ids)
                continue
            if now is not None:
                keys.append(now), values.append(state.hexdigest())
            now, state = key, sha256(ids)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "hash"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["key", "hash"])


def prefix_trie(strings: DataFrame) -> DataFrame:
    """``strings`` (conv_id, seq), conv_ids distinct -> one row per distinct prefix, the empty one included:

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Ranges are dealt by (seq, conv_id), so
    copies of one conversation spread over several.  A range task holds its distinct strings, ``TOKEN`` bytes a turn; a tree task
    the marks of ``FAN`` ranges, at most one per turn of their two border strings.  No conversations give no rows, not even a root.
    """
    ranged = strings.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    rows = stage(ranged.select("conv_id", "seq").mapInArrow(range_forest, ROW), "ranges")
    pieces = rows.where("kind = 2").select("key", "part", "ids")
    levels, now = [rows], rows
    while (n := now.where("kind = 1").count()) > 0:
        final = n <= FAN
        group = F.lit("all") if final else F.expr(f"part div {FAN}")
        now = stage(now.where("kind = 1").groupBy(group).applyInArrow(border_forest(final), ROW), "borders")
        levels.append(now)
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = nodes.where("kind = 0")
    # Nodes that were open for a while: few, found by key for the nodes below them and for the members that end there.
    late = nodes.where("key is not null")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(member_hashes, "key string, hash string")
    late = stage(late.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("hash", F.lit(NO_MEMBER))).drop("hash"), "late")
    nodes = nodes.where("key is null").unionByName(late)
    parents = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent"))
    return nodes.join(parents, "parent_key", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "__parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), rebuilt from their siblings when ``siblings`` is above 1.

    Null roles and texts are empty; turns are ordered null first and ties by token, so the result does not depend on row order; repeated rows
    are turns of their own; rows without a conv_id belong to no conversation; other columns are not read.  Turns are told apart by
    128 bits of a hash.  One conversation is one string of ``TOKEN`` bytes a turn, so it may have up to some 80 million turns.
    """
    return prefix_trie(stage(turn_strings(conversations, siblings), "strings"))
