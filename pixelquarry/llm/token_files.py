"""Token-id output in patched frame-of-reference blocks.

A shard holds whole documents. Its ids are cut into blocks; of a block the minimum is subtracted,
the rest is packed at the width that a percentile of its values needs, and values that need more
are exceptions, kept in a list. The shard's header indexes where each block starts. Shards are rows
of a Parquet table, so they go to any store that Spark can write.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm.bpe import load_tokenizer
from pixelquarry.llm.common import staged

BLOCK = 256
PERCENTILE = 98
#: A shard is closed once it has so many ids.
SHARD_IDS = 1_000_000
#: Distinct words whose ids a Python worker remembers; others are encoded as they come.
REMEMBERED = 700_000
#: Texts that are encoded together, and new words that are encoded as the lines of one text.
TEXTS, LINES = 1024, 500
#: Characters of a text by which rows of one identifier are dealt over partitions.
HEAD = 32
_MAGIC = b"PFB1"
_HEADER = struct.Struct("<4sQQ")


def _low_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value of a row, row after row, each row on its own bytes."""
    out = []
    for at in range(0, len(values), 64):  # the bits of a few rows at a time stay in the cache
        bits = ((values[at : at + 64, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
        out.append(np.packbits(bits.reshape(len(bits), -1), axis=1, bitorder="little").tobytes())
    return b"".join(out)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The bytes of a shard: header; index of block starts, bases and widths; blocks; exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[n - 1]
    table = padded.reshape(blocks, BLOCK)
    base = table.min(axis=1, keepdims=True) if blocks else np.zeros((0, 1), np.uint32)
    rest = table - base
    rank = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    wide = np.partition(rest, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint32)
    width = np.zeros(blocks, dtype=np.uint8)
    for bit in range(32):
        width[wide >= (1 << bit)] = bit + 1
    length = width.astype(np.int64) * (BLOCK // 8)
    start = np.cumsum(length) - length
    body = np.zeros(int(length.sum()), dtype=np.uint8)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            packed = np.frombuffer(_low_bits(rest[which], int(w)), dtype=np.uint8)
            body[(start[which][:, None] + np.arange(length[which[0]])).reshape(-1)] = packed
    patched = np.flatnonzero((rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]).reshape(-1))
    exceptions = rest.reshape(-1)[patched]
    return b"".join(
        [
            _HEADER.pack(_MAGIC, n, len(patched)),
            start.astype("<u8").tobytes(),
            base.astype("<u4").tobytes(),
            width.tobytes(),
            body.tobytes(),
            patched.astype("<u4").tobytes(),
            exceptions.astype("<u4").tobytes(),
        ]
    )


def unpack(data: bytes) -> np.ndarray:
    """The ids of a shard, from its bytes alone."""
    magic, n, patches = _HEADER.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a shard of token ids")
    blocks = -(-n // BLOCK)
    at = _HEADER.size
    start = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    base = np.frombuffer(data, "<u4", blocks, at + 8 * blocks)
    width = np.frombuffer(data, np.uint8, blocks, at + 12 * blocks)
    at += 13 * blocks
    size = int(width.astype(np.int64).sum()) * (BLOCK // 8)
    body = np.frombuffer(data, np.uint8, size, at)
    rest = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            for own in np.array_split(which, -(-len(which) // 64)):
                rows = body[start[own][:, None] + np.arange(int(w) * (BLOCK // 8))]
                bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(own), BLOCK, int(w))
                rest[own] = bits @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    at += size
    patched = np.frombuffer(data, "<u4", patches, at)
    rest.reshape(-1)[patched] = np.frombuffer(data, "<u4", patches, at + 4 * patches)
    return (rest + base[:, None]).reshape(-1)[:n]


#: Words that no single blank, or line feed in front, sets apart: nothing, or with white space.
_ODD = re.compile(r"^$|^\n$|^[^\S\n]|.\s", re.DOTALL)
#: Slots of the store that every encoder has, and the mark of an odd word.
_NOTHING, _END, _IS_ODD = 0, 1, -1


class _Store:
    """Sequences of ids, one a slot, end to end in one array that grows by doubling."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.start, self.count, self.slots = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Add sequences of ``counts`` ids each; the first one's slot."""
        first, used, slots = self.slots, self.used + len(ids), self.slots + len(counts)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while slots > len(self.count):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : used] = ids
        self.count[first:slots], self.start[first:slots] = counts, self.used + np.cumsum(counts) - counts
        self.used, self.slots = used, slots
        return first

    def add_lists(self, lists: list[list[int]]) -> int:
        counts = np.array([len(x) for x in lists], dtype=np.int64)
        return self.add(np.array([i for x in lists for i in x], dtype="<u4"), counts)

    def drop_from(self, slots: int, used: int) -> None:
        self.slots, self.used = slots, used

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``slots`` one after another, and how many ids each of them has."""
        count = self.count[slots]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[slots] - (ends - count), count) + np.arange(total)], count


class _Encoder:
    """Ids of whole texts; a word's ids are remembered, so that it is encoded once.

    Before a single blank or line feed between other characters this tokenizer's pre-tokens always
    end, so a text's ids are those of its words, each with what stands before it. Texts with other
    white space are left to the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int) -> None:
        self.tokenizer = load_tokenizer(path)
        self.feed = self._encoded(["\n"])[0][0]
        self.store = _Store()
        self.store.add_lists([[], [end_id]])
        #: word, as it follows a blank or with its line feed in front -> slot, or the mark of an odd one.
        self.known: dict[str, int] = {}

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots_of(self, words: list[str]) -> np.ndarray:
        """Slots of new words, encoded as the lines of texts: a line feed is a token of its own.

        Words that may hold an added token's string are encoded alone.
        """
        slots = np.full(len(words), _IS_ODD, dtype=np.int64)
        after_blank, after_feed, alone = [], [], []
        for k, w in enumerate(words):
            if not _ODD.search(w):
                (alone if "<|" in w else after_feed if w[0] == "\n" else after_blank).append(k)
        for which, lead, keep in ((after_blank, "\n ", False), (after_feed, "", True)):
            parts = [which[at : at + LINES] for at in range(0, len(which), LINES)]
            texts = ["".join([lead + words[k] for k in part]) for part in parts]
            for part, found in zip(parts, self._encoded(texts), strict=True):
                ids = np.array(found, dtype="<u4")
                cuts = np.flatnonzero(ids == self.feed)
                if len(cuts) != len(part) or cuts[0]:
                    alone += part
                    continue
                counts = np.diff(cuts, append=len(ids))
                first = self.store.add(ids, counts) if keep else self.store.add(ids[ids != self.feed], counts - 1)
                slots[part] = np.arange(first, first + len(part))
        if alone:
            feed = [[self.feed] if words[k][0] == "\n" else [] for k in alone]
            own = self._encoded([words[k][1:] if f else " " + words[k] for k, f in zip(alone, feed)])
            first = self.store.add_lists([f + ids for f, ids in zip(feed, own, strict=True)])
            slots[alone] = np.arange(first, first + len(alone))
        return slots

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, the end id after them."""
        if not len(texts):
            return []
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        lengths = pc.list_value_length(cut).to_numpy().astype(np.int64)  # one at least
        ends = np.cumsum(lengths)
        firsts = ends - lengths
        found = cut.flatten().dictionary_encode()
        words, place = found.dictionary.to_pylist(), found.indices.to_numpy()

        slot = np.array([self.known.get(w, -2) for w in words], dtype=np.int64)
        new = np.flatnonzero(slot == -2)
        fresh = [words[k] for k in new.tolist()]
        mark = self.store.slots, self.store.used
        slot[new] = self._slots_of(fresh)
        if len(self.known) + len(fresh) <= REMEMBERED:
            self.known.update(zip(fresh, slot[new].tolist(), strict=True))
            mark = self.store.slots, self.store.used

        slots = slot[place]
        first_words = cut.flatten().take(pa.array(firsts)).to_pylist()
        slots[firsts] = [_IS_ODD if not w or _ODD.search(w) or w[0] == "\n" else _NOTHING for w in first_words]
        odd = np.zeros(len(texts), dtype=bool)
        odd[np.searchsorted(ends, np.flatnonzero(slots == _IS_ODD), side="right")] = True
        slots[np.repeat(odd, lengths)] = _NOTHING
        heads = [texts[k].as_py() if odd[k] else w for k, w in enumerate(first_words)]  # an odd text whole
        slots[firsts] = self.store.add_lists(self._encoded(heads)) + np.arange(len(heads))
        ids, count = self.store.gather(np.insert(slots, ends, _END))
        self.store.drop_from(*mark)
        each = np.add.reduceat(count, firsts + np.arange(len(texts)))
        return np.split(ids, np.cumsum(each)[:-1])


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> _Encoder:
    return _Encoder(path, end_id)


_SHARDS_DDL = "part int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of one sorted range of documents; ``first`` counts from the range's start."""
        part, first, held = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        encode = _encoder(path, end_id)

        def shard() -> pa.RecordBatch:
            row = [part, first, held, list(doc_ids), list(lengths), pack(np.concatenate(ids))]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = ["part", "first", "n_ids", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                documents, texts = batch.slice(at, TEXTS).columns
                for document, own in zip(documents.to_pylist(), encode(texts), strict=True):
                    ids.append(own)
                    doc_ids.append(document)
                    lengths.append(len(own))
                    held += len(own)
                    if held >= SHARD_IDS:
                        yield shard()
                        first, held = first + held, 0
                        doc_ids.clear(), lengths.clear(), ids.clear()
        if ids:
            yield shard()

    return run


def write_token_files(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the ids of ``docs`` in ascending order of ``id_col`` and return the table of shards.

    A null text counts as empty and gives the end id alone. Null identifiers come first; rows with
    one identifier are in the order of their texts. Texts of any length are encoded whole and stay
    in one shard. An empty table gives no shards; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The head splits rows of one identifier, or of none, and keeps to the order of texts.
    ordered = rows.repartitionByRange("id", F.substring("text", 1, HEAD)).sortWithinPartitions("id", "text")
    return staged(ordered.mapInArrow(_write(path, end_id), _SHARDS_DDL), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"]).astype("<u4")
            lengths = np.array(row["lengths"], dtype=np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], type=pa.int64()),
                    pa.array([row["part"]] * len(crc), type=pa.int32()),
                    pa.array(row["first"] + ends - lengths),
                    pa.array(lengths),
                    pa.array(crc, type=pa.int64()),
                ],
                names=["doc_id", "part", "inside", "n_tokens", "ids_crc32"],
            )


def read_token_files(shards: DataFrame) -> DataFrame:
    """A row for each document, from the shards: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; the ranges' totals are one row for each
    partition of the writer, whatever the data.
    """
    documents = shards.mapInArrow(_read, "doc_id long, part int, inside long, n_tokens long, ids_crc32 long")
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return documents.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
