"""The trie of conversations' shared beginnings, by one global sort and a sweep.

A conversation is the byte string of its turns' hashes, 16 bytes a turn, so a prefix of turns is a prefix
of bytes. All conversations are range-sorted by it (then by conv_id, which splits groups of equal ones);
each task sweeps its range with a stack, from the common prefix of neighbours, and closes nodes. Nodes on
the path of a range's first or last row may go on in other ranges: they are left open, and the open stacks
are stitched in order of the ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import materialize
from paddock.session import ship

WIDTH = 16
#: Bytes of conversations in a range, and of ids in a piece.
RANGE_BYTES, PIECE_BYTES = 32_000_000, 1_000_000
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_OPEN = "array<struct<least:bigint,size:bigint,n:bigint,children:bigint,leaves:bigint,saved:bigint,ends:string>>"
#: kind 0: a node; 1: the open stack of a range; 2: ids of its first run of equal conversations; 3: of its last run, if that is another.
_SWEPT = f"kind int, pid int, part int, slot int, {_NODE}, first binary, last binary, kept int, opened {_OPEN}, ids binary"
_NONE = hashlib.sha256(b"").hexdigest()


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id, hashes (32 hex digits a turn), sizes (code points a turn) of ``turns`` (conv_id, turn, role, text).

    Turns sort by turn, null first, then by role and hash, so ties and repeated rows have one order. Null
    roles and texts are empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    hashed = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), hashed.alias("hash"), F.length(text).alias("size")).alias("t"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.col("t.hash").alias("hashes"), F.col("t.size").alias("sizes"))


def rebuilt(held: DataFrame, donor: Column, head: Column, most: int) -> DataFrame:
    """``turn_arrays`` whose first ``head`` turns (``most`` at most) are those of the conversation ``donor``: all it has if fewer, none if it is absent."""
    given = held.select(F.col("conv_id").alias("_donor"), F.slice("hashes", 1, most).alias("_hashes"), F.slice("sizes", 1, most).alias("_sizes"))
    met = held.withColumn("_of", donor).withColumn("_head", head).join(given, F.col("_of") == F.col("_donor"), "left")

    def put(own: str, other: str, kind: str) -> Column:
        front = F.slice(F.coalesce(F.col(other), F.array().cast(kind)), F.lit(1), F.col("_head"))
        return F.concat(front, F.slice(F.col(own), F.col("_head") + 1, F.greatest(F.size(own) - F.col("_head"), F.lit(0)))).alias(own)

    return met.select("conv_id", put("hashes", "_hashes", "array<string>"), put("sizes", "_sizes", "array<int>"))


class _Node:
    """An open node: least member, code points of its turn, members so far, and what its closed children add up to."""

    #: What an open stack tells of a node.
    TOLD = ("least", "size", "n", "children", "leaves", "saved", "ends")
    __slots__ = ("least", "size", "n", "children", "leaves", "saved", "ends", "left", "waiting", "places")

    def __init__(self, size: int, n: int, left: bool = False):
        # in a sweep, n is the row that opened the node until it is closed
        self.least, self.size, self.n, self.left = None, size, n, left
        self.children = self.leaves = self.saved = 0
        self.ends, self.waiting, self.places = None, [], []

    def add(self, least: int | None, leaves: int, saved: int) -> None:
        self.children += 1
        self.leaves += leaves
        self.saved += saved
        self.meet(least)

    def meet(self, least: int | None) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def totals(self) -> tuple[int, int]:
        """Childless nodes and saved tokens of the whole subtree."""
        return self.leaves or 1, self.saved + (self.n - 1) * self.size


def _common(a: bytes, b: bytes) -> int:
    """Turns that two conversations share from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class _Sweep:
    """One range: rows come in order; finished nodes, ids of the runs at its ends and the open stack go to ``out``."""

    def __init__(self, pid: int):
        self.pid, self.out, self.rows, self.kept, self.part = pid, [], 0, 0, 0
        self.stack: list[_Node] = []
        self.opened: dict[int, _Node] = {}
        self.first = self.last = None
        self.run, self.run_bytes, self.pieces, self.first_run = [], 0, [], True

    def row(self, conv: int, key: bytes, sizes: list[int]) -> None:
        if self.first is None:
            self.first = self.last = key
            self.stack = [_Node(0, 0, True)] + [_Node(s, 0, True) for s in sizes]
            self.kept = len(sizes)
        elif key != self.last:
            self._end_run(False)
            shared = _common(self.last, key)
            while len(self.stack) > shared + 1:
                self._close()
            self.stack += [_Node(s, self.rows) for s in sizes[shared:]]
            self.kept, self.last = min(self.kept, shared), key
        self.rows += 1
        self.stack[-1].meet(conv)
        self.run.append(b"%d" % conv)
        self.run_bytes += 12
        if self.run_bytes >= PIECE_BYTES:
            self._cut()

    def _cut(self) -> None:
        """End a piece of the run's ids; those of the first run are told at once."""
        if self.run:
            self.pieces.append(b",".join(self.run))
        self.run, self.run_bytes = [], 0
        if self.first_run:
            self._tell(2)

    def _tell(self, kind: int) -> None:
        for ids in self.pieces:
            self.out.append({"kind": kind, "pid": self.pid, "part": self.part, "ids": ids})
            self.part += 1
        self.pieces = []

    def _end_run(self, last: bool) -> None:
        """The first and the last run may go on in other ranges, so their ids stay; others are hashed here."""
        self._cut()
        if self.pieces and last:
            self._tell(3)
        elif self.pieces:
            self.stack[-1].ends = hashlib.sha256(b",".join(self.pieces)).hexdigest()
        self.pieces, self.first_run = [], False

    def _close(self) -> None:
        """The deepest open node ends here; one on the path of the first row stays open towards the range before."""
        node = self.stack.pop()
        depth, node.n = len(self.stack), self.rows - node.n
        if node.left:
            self.opened[depth] = node
            return
        told, parent = _closed(node, depth), self.stack[-1]
        self.out += node.waiting
        if parent.left:
            self.out.append(told | {"pid": self.pid, "slot": depth - 1})
        else:
            parent.waiting.append(told)
        parent.add(node.least, told["n_leaves"], told["saved_tokens"])

    def finish(self) -> None:
        """Tell the open stack: nodes on the first row's path from the root, then those on the last row's path alone.

        A node that waits for a parent of the first kind has the parent's depth as its slot, of the second
        kind its depth below 0.
        """
        if self.first is None:
            return
        self._end_run(True)
        right = []
        for depth, node in enumerate(self.stack):
            node.n = self.rows - node.n
            if node.left:
                self.opened[depth] = node
            else:
                right.append(node)
                self.out += [child | {"pid": self.pid, "slot": -depth} for child in node.waiting]
        told = [self.opened[d] for d in sorted(self.opened)] + right
        self.out.append({"kind": 1, "pid": self.pid, "part": 0, "first": self.first, "last": self.last, "kept": self.kept, "opened": [{k: getattr(x, k) for k in _Node.TOLD} for x in told]})


def _closed(node: _Node, depth: int) -> dict:
    """The row of a node whose members are all in; the children that waited for its least member get it."""
    leaves, saved = node.totals()
    for child in node.waiting:
        child["parent_conv_id"] = node.least
    return {"kind": 0, "conv_id": node.least, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": node.ends or _NONE}


class _Stitch:
    """Open stacks of all ranges in order: what continues is merged, what ends is a node."""

    def __init__(self):
        self.stack: list[_Node] = []
        self.out: list[dict] = []
        self.last, self.todo = None, None

    def row(self, r: dict) -> None:
        if r["kind"] == 1:
            self._turn()
            depth, pid = len(r["first"]) // WIDTH, r["pid"]
            shared = _common(self.last, r["first"]) if self.last is not None else -1
            while len(self.stack) > shared + 1:
                self._close()
            for d, told in enumerate(r["opened"][: depth + 1]):
                if d == len(self.stack):
                    self.stack.append(_Node(told["size"], 0))
                self._merge(self.stack[d], told, pid, d)
            self.todo, self.last = (pid, r["kept"], r["opened"][depth + 1 :]), r["last"]
            return
        if r["kind"] == 3:
            self._turn()
        node = self.stack[-1]
        if node.ends is None:
            node.ends = hashlib.sha256(r["ids"])
        else:
            node.ends.update(b"," + r["ids"])

    def _merge(self, node: _Node, told: dict, pid: int, slot: int) -> None:
        node.meet(told["least"])
        for k in ("n", "children", "leaves", "saved"):
            setattr(node, k, getattr(node, k) + told[k])
        node.places.append((pid, slot))

    def _turn(self) -> None:
        """From the path of a range's first row to that of its last."""
        if self.todo is None:
            return
        pid, kept, right = self.todo
        while len(self.stack) > kept + 1:
            self._close()
        for told in right:
            node = _Node(told["size"], 0)
            self._merge(node, told, pid, -len(self.stack))
            node.ends = told["ends"]
            self.stack.append(node)
        self.todo = None

    def _close(self) -> None:
        node = self.stack.pop()
        if node.ends is not None and not isinstance(node.ends, str):
            node.ends = node.ends.hexdigest()
        told = _closed(node, len(self.stack))
        self.out += node.waiting
        self.out += [{"kind": 4, "pid": pid, "slot": slot, "conv_id": node.least} for pid, slot in node.places]
        if self.stack:
            self.stack[-1].add(node.least, told["n_leaves"], told["saved_tokens"])
            self.stack[-1].waiting.append(told)
        else:
            self.out.append(told)

    def finish(self) -> None:
        self._turn()
        while self.stack:
            self._close()


_FIELDS = {
    "kind": pa.int32(), "pid": pa.int32(), "part": pa.int32(), "slot": pa.int32(), **{c: pa.int64() for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}, "ends_sha256": pa.string(),
    "first": pa.binary(), "last": pa.binary(), "kept": pa.int32(), "opened": pa.list_(pa.struct([(k, pa.string() if k == "ends" else pa.int64()) for k in _Node.TOLD])), "ids": pa.binary(),
}


def _flushed(work: _Sweep | _Stitch, least: int) -> Iterator[pa.RecordBatch]:
    if len(work.out) > least:
        rows, work.out = work.out, []
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows[at : at + 20_000]], t) for k, t in _FIELDS.items()], names=list(_FIELDS))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    work = _Sweep(TaskContext.get().partitionId())
    for b in batches:
        for conv, key, sizes in zip(*(c.to_pylist() for c in b.columns)):
            work.row(conv, key, sizes)
        yield from _flushed(work, 20_000)
    work.finish()
    yield from _flushed(work, 0)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    work = _Stitch()
    for b in batches:
        for r in b.to_pylist():
            work.row(r)
        yield from _flushed(work, 20_000)
    work.finish()
    yield from _flushed(work, 0)


def trie(convs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per distinct beginning of ``convs`` (conv_id, hashes, sizes), the textless root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 (of the ids of the conversations that end there). An empty table has no node. A
    conversation is one row of 16 bytes a turn and its sizes. A task holds its open stack and the nodes that wait for
    an open one's least member; one task goes through the open stacks, a row per range, and the ids of runs
    that may cross ranges, which it hashes as they come (SHA-256 can't be taken in parts).
    """
    ship(convs.sparkSession)
    keyed = materialize(convs.select("conv_id", F.unhex(F.array_join("hashes", "")).alias("key"), "sizes"))
    if ranges is None:
        size = keyed.agg(F.sum(F.octet_length("key") * 1.25 + 16)).first()[0] or 0
        ranges = max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size) // RANGE_BYTES + 1)
    ordered = keyed.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = materialize(ordered.select("conv_id", "key", "sizes").mapInArrow(_swept, _SWEPT))
    edges = swept.where("kind between 1 and 3").repartition(1).sortWithinPartitions("pid", "kind", "part")
    stitched = materialize(edges.mapInArrow(_stitched, _SWEPT))
    names = [c.split()[0] for c in _NODE.split(", ")]
    places = stitched.where("kind = 4").select("pid", "slot", F.col("conv_id").alias("_parent"))
    waiting = swept.where("kind = 0 and slot is not null").drop("parent_conv_id").join(places, ["pid", "slot"]).withColumnRenamed("_parent", "parent_conv_id")
    done = swept.where("kind = 0 and slot is null").unionByName(stitched.where("kind = 0"))
    return done.select(*names).unionByName(waiting.select(*names))
