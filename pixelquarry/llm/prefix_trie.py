"""The trie of conversations' common beginnings, from sorted neighbours.

A conversation is the sequence of its turns' keys. Sequences are sorted over range partitions; a
longest common prefix (LCP) with the next one is an edge between neighbours. Union-find takes the
edges in descending depth: what a merge joins at its depth is a branching node there, and between
two merges a component climbs node by node. A partition can finish every node but those on the
paths of its first and its last sequence, which its neighbours may share. These two paths, with what
hangs from them added up, are the partition's contracted forest. Forests of neighbouring partitions
are again sorted sequences with LCP edges: the same steps merge some of them into one, finish what
has become inner, and contract what is left, until one forest is left and its root is finished.

Nothing depends on how many conversations share a turn or are equal: copies are one sequence with a
count, spread over as many partitions as they fill.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm.common import staged

#: Bytes of a turn's key: half of a SHA-256 of role and text.
KEY = 16
#: Conversations of one range partition at least, and forests that are merged into one.
SEQUENCES, FOREST = 20_000, 32

_NONE = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
#: node: a finished node; key: its name if it was on a forest's path; parent_key: its parent's name where that is open still.
#: path: one of the two paths of a forest, ``part`` its place. ids: the members that end at an open path's end, in pieces.
_OUT_DDL = (
    f"kind string, part long, side int, {_NODE}, key binary, parent_key binary, path binary, lens array<long>, "
    "own_n array<long>, own_min array<long>, own_children array<long>, own_leaves array<long>, own_saved array<long>, own_ends array<string>, ids string"
)
_OUT = pa.schema(
    [("kind", pa.string()), ("part", pa.int64()), ("side", pa.int32())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("path", pa.binary()), ("lens", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in ("own_n", "own_min", "own_children", "own_leaves", "own_saved")]
    + [("own_ends", pa.list_(pa.string())), ("ids", pa.string())]
)


@dataclass
class Own:
    """What a node has beside its children in the same forest: finished parts of its subtree, and ends."""

    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None

    def add(self, other: Own) -> None:
        self.n += other.n
        self.least = _least(self.least, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends


@dataclass
class Sequence:
    """One sorted sequence: its keys in a row, its turns' lengths, and what each depth of it owns."""

    path: bytes
    lens: list[int]
    own: dict[int, Own]

    @functools.cached_property
    def names(self) -> list[bytes]:
        """The name of the node at each depth."""
        hashed, found = hashlib.sha256(), []
        for depth in range(len(self.lens) + 1):
            found.append(hashed.digest()[:KEY] + depth.to_bytes(4, "big"))
            hashed.update(self.path[depth * KEY : (depth + 1) * KEY])
        return found


@dataclass
class _Component:
    """Neighbours that share their first ``depth`` turns, and their node there."""

    low: int
    high: int
    depth: int
    node: Own
    #: Rows of finished children, which wait for this node's smallest member.
    waiting: list[dict] = field(default_factory=list)


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def common_depth(a: bytes, b: bytes) -> int:
    """The number of turns that two paths share from the start."""
    most = min(len(a), len(b)) // KEY
    low, step = 0, 8
    while low < most and a[low * KEY : (low + step) * KEY] == b[low * KEY : (low + step) * KEY] and low + step <= most:
        low += step
    while low < most and a[low * KEY : (low + 1) * KEY] == b[low * KEY : (low + 1) * KEY]:
        low += 1
    return low


class Forest:
    """Merge sorted sequences into the nodes of their trie.

    ``last`` says that no other forest is left, so every node can be finished. ``named`` gives
    finished nodes their names: they were open in a forest below.
    """

    def __init__(self, sequences: list[Sequence], last: bool, named: bool) -> None:
        self.sequences, self.last, self.named = sequences, last, named
        self.rows: list[dict] = []
        self.kept: tuple[dict[int, Own], dict[int, Own]] = ({}, {})
        if sequences:
            self._merge()

    def _merge(self) -> None:
        sequences = self.sequences
        depth = np.array([common_depth(a.path, b.path) for a, b in zip(sequences, sequences[1:])], dtype=np.int64)
        parent = list(range(len(sequences)))
        whole = [_Component(i, i, len(s.lens), Own()) for i, s in enumerate(sequences)]
        for component in whole:
            self._enter(component)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for edge in np.argsort(-depth, kind="stable").tolist():
            left, right = root(edge), root(edge + 1)
            a, b = whole[left], whole[right]
            for component in (a, b):
                self._climb(component, int(depth[edge]))
            # The side with more rows waiting takes the other in; sides are intervals, the left one first.
            into, gone, up = (a, b, left) if len(a.waiting) >= len(b.waiting) else (b, a, right)
            into.node.add(gone.node)
            into.waiting += gone.waiting
            into.low, into.high = a.low, b.high
            parent[left], parent[right], whole[up] = up, up, into
        top = whole[root(0)]
        self._climb(top, 0)
        self._leave(top)

    def _enter(self, component: _Component) -> None:
        """Take in what the component's sequences own at its depth."""
        for i in range(component.low, component.high + 1):
            if own := self.sequences[i].own.get(component.depth):
                component.node.add(own)

    def _climb(self, component: _Component, depth: int) -> None:
        while component.depth > depth:
            above = self._leave(component)
            component.depth, component.node = component.depth - 1, above
            self._enter(component)

    def _leave(self, component: _Component) -> Own:
        """Finish the component's node, or keep it if neighbours may share it; what its parent gets of it."""
        node, depth, end = component.node, component.depth, len(self.sequences) - 1
        sequence = self.sequences[end if component.high == end else component.low]
        open_ = not self.last and (component.low == 0 or component.high == end)
        key = sequence.names[depth] if open_ or self.named else None
        for row in component.waiting:
            row |= {"parent_key": key} if open_ else {"parent_conv_id": node.least}
        self.rows += component.waiting
        component.waiting = []
        if open_:
            self.kept[component.low != 0][depth] = node
            return Own()
        leaves = node.leaves if node.children else 1
        saved = node.saved + ((node.n - 1) * sequence.lens[depth - 1] if depth else 0)
        row = {"conv_id": node.least, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": node.ends, "key": key}
        if depth:
            component.waiting = [row]
        else:
            self.rows.append(row)
        return Own(node.n, node.least, 1, leaves, saved)

    def contracted(self) -> list[Sequence]:
        """The first and the last sequence with what their open nodes own; the last owns nothing that both share."""
        ends = [0] if len(self.sequences) == 1 else [0, len(self.sequences) - 1]
        return [Sequence(self.sequences[i].path, self.sequences[i].lens, self.kept[side]) for side, i in enumerate(ends)]


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_OUT)


def _written(forest: Forest, part: int) -> Iterator[pa.RecordBatch]:
    rows = forest.rows
    for at in range(0, len(rows), 10_000):
        yield _table([row | {"kind": "node", "part": part} for row in rows[at : at + 10_000]])
    if not forest.last:
        for side, s in enumerate(forest.contracted()):
            owned = [s.own.get(d, Own()) for d in range(len(s.lens) + 1)]
            row = {"kind": "path", "part": part, "side": side, "path": s.path, "lens": s.lens}
            row |= {"own_n": [o.n for o in owned], "own_min": [o.least for o in owned], "own_children": [o.children for o in owned]}
            row |= {"own_leaves": [o.leaves for o in owned], "own_saved": [o.saved for o in owned], "own_ends": [o.ends for o in owned]}
            yield _table([row])


def _partition_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a sorted range of (path, lens, conv_id); equal paths follow each other."""
    part = TaskContext.get().partitionId()
    sequences: list[Sequence] = []
    pieces: list[str] = []  # of the first path's members, and then of the present one's
    first: list[str] = []
    hashed = hashlib.sha256()

    def close() -> None:
        """The present path is complete here, unless it is the first or the last of the partition."""
        nonlocal first, pieces
        if len(sequences) == 1:
            first = pieces
        else:
            sequences[-1].own[len(sequences[-1].lens)].ends = hashed.hexdigest()
        pieces = []

    for batch in batches:
        for path, lens, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sequences and sequences[-1].path == path:
                own = sequences[-1].own[len(lens)]
                own.n, own.least = own.n + 1, _least(own.least, conv_id)
                hashed.update(b",%d" % conv_id)
            else:
                if sequences:
                    close()
                sequences.append(Sequence(path, lens, {len(lens): Own(1, conv_id)}))
                hashed = hashlib.sha256(b"%d" % conv_id)
            pieces.append(str(conv_id))
    if not sequences:
        return
    for at, ids in ((0, first or pieces), (len(sequences) - 1, pieces))[: min(len(sequences), 2)]:
        s = sequences[at]
        s.own[len(s.lens)].ends = None  # its members may go on in the next partition
        yield _table([{"kind": "ids", "part": part, "side": int(at > 0), "key": s.names[-1], "ids": ",".join(ids)}])
    yield from _written(Forest(sequences, last=False, named=False), part)


def _merged_forest(last: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """One forest of neighbouring ones: FOREST of them at most, two paths each."""
        sequences = []
        for row in sorted(rows.to_pylist(), key=lambda r: (r["part"], r["side"])):
            owned = zip(*(row[c] for c in ("own_n", "own_min", "own_children", "own_leaves", "own_saved", "own_ends")), strict=True)
            sequences.append(Sequence(row["path"], row["lens"], {d: Own(*o) for d, o in enumerate(owned) if o[0] or o[2] or o[5]}))
        return pa.Table.from_batches(_written(Forest(sequences, last, named=True), key[0].as_py()), schema=_OUT)

    return run


def _hashed_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each key's pieces, which come sorted; a piece at a time, so any number of them will do."""
    key, hashed = None, hashlib.sha256()
    for batch in batches:
        found = []
        for own, ids in zip(map(bytes, batch["key"]), batch["ids"]):
            if own == key:
                hashed.update(b",")
            else:
                if key is not None:
                    found.append((key, hashed.hexdigest()))
                key, hashed = own, hashlib.sha256()
            hashed.update(ids.encode())
        yield pd.DataFrame(found, columns=["key", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, hashed.hexdigest())], columns=["key", "ends"])


def rebuilt(conversations: DataFrame, head: Column, base: Column) -> DataFrame:
    """conv_id, path, lens: each conversation's turns, its first ``head`` taken from conversation ``base``.

    ``head`` and ``base`` are expressions over conv_id. A turn is its key and its text's length.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    # Turns that share a number are ordered by role, by the start of the text, and by its key.
    turn = F.struct("turn", role.alias("role"), F.substring(text, 1, 64).alias("start"), key.alias("key"), F.char_length(text).cast("long").alias("len"))
    own = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    # sort_array puts nulls first, in fields of structs, too.
    turns = own.agg(F.sort_array(F.collect_list(turn)).alias("t"))
    turns = staged(turns.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["len"].alias("len"))).alias("t")), "trie-turns")
    bases = turns.select(F.col("conv_id").alias("base"), F.col("t").alias("b"))
    joined = turns.withColumns({"base": base, "h": head}).join(bases, "base", "left")
    nothing = F.array().cast("array<struct<key:string,len:bigint>>")
    rest = F.when(F.size("t") > F.col("h"), F.slice("t", F.col("h") + 1, F.greatest(F.size("t"), F.lit(1)))).otherwise(nothing)
    first = F.when(F.col("b").isNotNull() & (F.col("h") > 0), F.slice("b", F.lit(1), F.greatest("h", F.lit(1)))).otherwise(nothing)
    whole = joined.select("conv_id", F.concat(first, rest).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["key"]), "")).alias("path"), F.transform("t", lambda x: x["len"]).alias("lens"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """A row for each node of the trie over ``sequences`` (conv_id, path, lens); columns as ``conversation_trie``."""
    rows = staged(sequences.select("path", "lens", "conv_id"), "trie-sequences")
    wanted, count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count()
    parts = max(1, min(wanted, count // 64), count // SEQUENCES)
    ordered = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    forests = staged(ordered.mapInArrow(_partition_forest, _OUT_DDL), "trie-forests")
    nodes = forests.where("kind = 'node'")

    # Merge until one forest is left; the places of the first ones say how many rounds that takes.
    last = forests.where("kind = 'path'").agg(F.max("part")).first()[0]
    if last is None:
        return nodes.select(*_COLUMNS, "ends_sha256")
    merged, level, left = [], forests, last + 1
    while left > 1 or not merged:
        left = -(-left // FOREST)
        near = level.where("kind = 'path'").groupBy(F.floor(F.col("part") / F.lit(FOREST)))
        level = staged(near.applyInArrow(_merged_forest(last=left == 1), _OUT_DDL), "trie-forests")
        merged.append(level.where("kind = 'node'"))
    shared = functools.reduce(DataFrame.unionByName, merged)

    # Nodes whose parents were open get them by name. A parent may be hot in the first forests: its name is
    # joined for each partition that has children of it, and they meet it there.
    names = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    wanting = nodes.where("parent_key IS NOT NULL").select("part", "parent_key").distinct()
    inner = nodes.join(wanting.join(names, "parent_key"), ["part", "parent_key"], "left").withColumn("ends", F.lit(None).cast("string"))
    pieces = forests.where("kind = 'ids'").select("key", "part", "side", "ids")
    ends = pieces.repartition("key").sortWithinPartitions("key", "part", "side").mapInPandas(_hashed_ends, "key binary, ends string")
    outer = shared.join(names, "parent_key", "left").join(ends, "key", "left")
    found = {"parent_conv_id": F.coalesce("parent_conv_id", "found"), "ends_sha256": F.coalesce("ends", "ends_sha256", F.lit(_NONE))}
    both = [part.withColumns(found).select(*_COLUMNS, "ends_sha256") for part in (inner, outer)]
    return both[0].unionByName(both[1])


def conversation_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """The prefix trie of rebuilt conversations, a row a node: conv_id (smallest member), depth,
    parent_conv_id (its parent's; null for the root), n_convs (members), n_children, n_leaves
    (childless nodes of its subtree, itself included), saved_tokens (over its subtree, a node's members
    but one times the code points of its last text) and ends_sha256 (of the decimal conv_ids of members
    that end here, ascending, joined by commas).

    Conversation c is rebuilt from the first h turns of conversation ``c - c % group``, h = crc32 of
    decimal c modulo ``heads``, and its own turns after its first h. A turn is its role and whole text, by
    128 bits of a SHA-256 of both. Null roles and texts are empty; turns are sorted by number, nulls
    first, then by role and text (the text's first 64 characters, then its key). Repeated rows are
    turns each. Rows without a conv_id belong to no conversation and are left out. A conversation left
    without turns is a member of the root alone. An empty table gives no nodes; other columns are not
    read. One conversation's keys and lengths, 24 bytes a turn, are one value.
    """
    named = conversations.select("conv_id", "turn", "role", "text")
    own = F.col("conv_id").cast("string")
    return prefix_trie(rebuilt(named, F.pmod(F.crc32(own.cast("binary")), F.lit(heads)).cast("int"), F.col("conv_id") - F.col("conv_id") % group))
