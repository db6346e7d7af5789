"""SimHash near-dedup by tiled exact comparison.

Fingerprints of equal value are one node. Nodes are sorted by population count and cut into tiles;
two tiles whose population counts differ by more than the radius cannot hold a link, so that pair
is never made. A pair of tiles is compared in numpy, exclusive-or and bit count, whole. It gives a
spanning forest of its links and not the links, so a group of n near copies costs n edges a pair of
tiles; components come from those edges in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm.common import boxed, discard, staged

SEED = 42
#: Fingerprints of one tile at most.
TILE = 16_384


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The 64-bit fingerprint of a text, unsigned; no word gives 0.

    A-Z are lower-cased; words are parted by ASCII blanks; shingles of ``words`` words, repeats
    included (fewer words: the whole sequence), are hashed by XXH64; a bit is set if it is set in
    over half the hashes.
    """
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in found))  # one past the blank
    starts = [0, *ends]
    spans = zip(starts, ends[words - 1 :])
    hashes = np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in spans), np.uint64, len(found) - words + 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = np.add.reduce(bits, axis=0, dtype=np.uint32) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    """The columns of a batch with the fingerprint, ``node``, in place of the last one, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.columns[-1].cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
            columns = [*batch.columns[:-1], pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "node"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted range of nodes into tiles; tile numbers follow the order of all nodes."""
    base, count = TaskContext.get().partitionId() << 24, 0
    names = ["tile", "lo", "hi", "nodes"]
    rest = np.zeros(0, dtype=np.uint64)

    def tile(nodes: np.ndarray) -> pa.RecordBatch:
        ones = np.bitwise_count(nodes)
        row = [[base + count], [int(ones[0])], [int(ones[-1])], [nodes.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=names)

    for batch in batches:
        rest = np.concatenate([rest, batch.column(0).to_numpy().view(np.uint64)])
        while len(rest) >= TILE:
            yield tile(rest[:TILE])
            count, rest = count + 1, rest[TILE:]
    if len(rest):
        yield tile(rest)


def tile_forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> np.ndarray:
    """A spanning forest, as an array of (node, node), of the links between two tiles.

    Every product of the tiles is compared, but for blocks of rows and columns whose population
    counts differ beyond the radius; both are sorted by them.
    """
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(nodes))
    ones_a, ones_b = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    edges: list[tuple[int, int]] = []
    rows, columns = 64, 2048
    for i in range(0, len(a), rows):
        block = a[i : i + rows, None]
        first = np.searchsorted(ones_b, ones_a[i] - radius)
        last = np.searchsorted(ones_b, ones_a[min(i + rows, len(a)) - 1] + radius, side="right")
        for j in range(max(first, i if same else 0), last, columns):
            near = np.bitwise_count(block ^ b[None, j : min(j + columns, last)]) <= radius
            if not near.any():
                continue
            x, y = np.nonzero(near)
            x, y = x + i, y + j + shift
            apart = label[x] != label[y]
            if not apart.any():
                continue
            x, y = x[apart], y[apart]
            _, once = np.unique(label[x] * len(nodes) + label[y], return_index=True)
            parent: dict[int, int] = {}

            def root(v: int) -> int:
                while (up := parent.get(v, v)) != v:
                    parent[v] = parent.get(up, up)
                    v = up
                return v

            for u, v in zip(x[once].tolist(), y[once].tolist(), strict=True):
                p, q = root(int(label[u])), root(int(label[v]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    edges.append((u, v))
            changed = np.fromiter(parent, np.int64, len(parent))
            to = np.arange(len(nodes))
            to[changed] = [root(v) for v in parent]
            label = to[label]
    return nodes[np.array(edges, dtype=np.int64).reshape(-1, 2)]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = tile_forest(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), left == right, radius)
                if len(found):
                    ends = found.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    return run


def near_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that join what lies within ``radius`` bits, for ``nodes`` (node, distinct)."""
    parts = max(1, -(-nodes.count() // TILE))
    counted = nodes.select("node", F.bit_count("node").alias("ones"))
    # Unsigned order within a count is of no matter: only the counts decide what is compared.
    ordered = counted.repartitionByRange(parts, "ones", "node").sortWithinPartitions("ones", "node").select("node")
    tiles = staged(ordered.mapInArrow(_tiles, "tile long, lo int, hi int, nodes binary"), "simhash-tiles")

    # Tile numbers follow the counts, so a later tile is near iff its lowest count is in reach.
    reach = F.explode(F.sequence(F.col("lo"), F.col("hi") + radius))
    left = tiles.select(F.col("tile").alias("left"), reach.alias("lo"))
    pairs = left.join(tiles.select(F.col("tile").alias("right"), "lo"), "lo").where(F.col("left") <= F.col("right"))
    pairs = pairs.select("left", "right")
    own, other = tiles.select(F.col("tile").alias("left"), F.col("nodes").alias("x")), tiles.select(F.col("tile").alias("right"), F.col("nodes").alias("y"))
    loaded = pairs.join(own, "left").join(other, "right").select("left", "right", "x", "y")
    return loaded.repartition("left", "right").mapInArrow(_links(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for all nodes of ``edges`` (u, v).

    Alternating star contraction: each round links every node to the smallest of its neighbours,
    first the larger neighbours of each node, then the smaller ones, until nothing changes; the
    rounds grow with the logarithm of the longest chain. Groups are aggregated and joined, never
    gathered; each round is written to the shared folder, and the one before it goes.
    """
    edges = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, staged(small.select("e.u", "e.v").where("u != v").distinct(), "components")
        discard(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _rooted(members: DataFrame, radius: int, least: Column) -> DataFrame:
    """node, ``least`` over its ``members``, and root: the node that names its component."""
    nodes = staged(members.groupBy("node").agg(least.alias("least")), "simhash-nodes")
    roots = components(near_links(nodes.select("node"), radius))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def simhash_components(
    docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest
    identifier that links reach. Null and empty texts, and texts of blanks, have fingerprint zero
    and are linked like any other. Null identifiers keep their rows and never name a component
    that has another identifier; repeated rows are members alike. Texts of any length are read
    whole. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    members = staged(rows.mapInArrow(_fingerprints(words), "id long, node long"), "simhash-members")
    rooted = _rooted(members, radius, F.min("id"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = rooted.join(named, "root").select("node", "component_id")
    # One row a node on the right: a hot fingerprint on the left is split by adaptive execution.
    return members.join(by_node, "node").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )


def kept_documents(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """One row of each component of near copies: the one with the smallest identifier.

    All columns of ``docs`` come back, whatever their names. Of rows that share the identifier, the
    one with the least content hash stays; a row with a null identifier stays only if its whole
    component has no other. Rows are told apart by identifier (null-safe) and content hash, so
    components whose smallest identifiers are equal keep a row each; of rows equal in both, one
    stays. Null and empty texts are near copies of each other; an empty table gives no rows. The
    least row of a component is an aggregate, so a large component is never gathered. The join and
    the last step have the same keys, so the texts move once.
    """
    keys = ["no_id", "id", "sha"]
    tagged = boxed(
        docs,
        no_id=F.isnull("doc_id"),
        id=F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        sha=F.sha2(F.coalesce("text", F.lit("")), 256),
    )
    members = tagged.select(*keys, "row.text").mapInArrow(_fingerprints(words), "no_id boolean, id long, sha string, node long")
    rooted = _rooted(staged(members, "simhash-members"), radius, F.min(F.struct(*keys)))
    chosen = rooted.groupBy("root").agg(F.min("least").alias("key")).select("key.*")
    kept = tagged.join(chosen, keys, "left_semi")
    first = Window.partitionBy(*keys).orderBy(F.isnull("row.text"))
    return kept.withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")
