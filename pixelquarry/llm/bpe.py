"""BPE encoding and decoding by a distinct-word table.

Spark parts the texts' words by single blanks, tasks cut them there by array operations, and each
distinct word is encoded once, wherever it occurs. A block is a bounded batch of documents. One pass over the texts sends each block's distinct words to
a word table, dealt by the words' hash; another turns the block's words into positions in its own
list of distinct ones. The words' ids travel back to the block and are put where its positions say.
The ids that the table holds are joined with the id-to-piece table, and a text is decoded from the
pieces that this join gives. What is shuffled are word lists, positions and ids, all compressed, and
never the texts.

A region, the blocks of a fixed number of scan partitions, has a word table of its own, of a bounded
number of buckets: so a block sends a bounded number of rows, and a bucket gets a bounded number of
them, whatever the size of the whole.

White space never survives this kind of tokenizer's normaliser and no pre-token spans it, so a
text's ids are the ids of the words between its ASCII blanks, one after another (other white space
stays inside words and is left to the tokenizer); ``check_tokenizer`` makes sure of the kind.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.llm.common import staged

#: Bytes of words that one block holds at most, but for a last document that is longer.
BLOCK_BYTES = 12_000_000
#: Bytes of text for each bucket of a region's word table, up to so many buckets.
BUCKET_BYTES, BUCKETS = 20_000_000, 1024
#: Scan partitions whose blocks share a word table.
REGION = 256
#: Rows that are cut into words together, and words whose digests are worked out together.
ROWS, SLICE = 1024, 250_000
_ROWS = pa.schema([("region", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("seal", pa.int64()), ("payload", pa.binary())])
_ROWS_DDL = "region int, block long, bucket int, seal long, payload binary"
#: The bucket number of a block's own row, and of the row that brings its pieces.
_OWN, _PIECES = -1, -2
_BLANKS = r"[\x20\x09-\x0D]+"

_loaded: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, once for each Python worker; truncation and padding stay off."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def check_tokenizer(path: str) -> None:
    """Raise unless blanks part words for this tokenizer, as the module's docstring says."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normalisers = (spec["normalizer"] or {}).get("normalizers", [])
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    blanks = any(n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in normalisers)
    dropped = steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    added = all(not set(" \t\n") & set(t["content"]) and not t["single_word"] for t in spec["added_tokens"])
    if not (blanks and dropped and added and spec["post_processor"] is None and spec["decoder"] is None):
        raise ValueError(f"{path}: not a tokenizer that drops white space between words")


def pieces_of(path: str) -> list[str]:
    """The id-to-piece table: the piece of each id, special tokens included; none holds a line feed."""
    tokenizer = load_tokenizer(path)
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: a row for each id of the tokenizer's file, so its size is known."""
    return spark.createDataFrame(list(enumerate(pieces_of(path))), "id int, piece string")


# --- positions: two bytes for a block's first 49,152 words, four for the others -------------------


def pack_positions(numbers: np.ndarray) -> bytes:
    """Numbers below 2**30 as little-endian 16-bit units: one below 49,152, else two."""
    low = numbers < 0xC000
    if low.all():
        return numbers.astype("<u2").tobytes()
    at = np.cumsum(np.where(low, 1, 2)) - 1  # last unit of each number
    out = np.empty(int(at[-1]) + 1, dtype="<u2")
    out[at] = np.where(low, numbers, numbers & 0xFFFF)
    high = ~low
    out[at[high] - 1] = 0xC000 + (numbers[high] >> 16)
    return out.tobytes()


def unpack_positions(data: bytes) -> np.ndarray:
    units = np.frombuffer(data, dtype="<u2").astype(np.int64)
    if not len(units):
        return units
    lead = units >= 0xC000
    # A unit after a leading one is a low half whatever its value: alternate within runs.
    if lead.any():
        run_start = lead & ~np.concatenate(([False], lead[:-1]))
        start = np.maximum.accumulate(np.where(run_start, np.arange(len(units)), -1))
        leading = lead & ((np.arange(len(units)) - start) % 2 == 0)
        second = np.concatenate(([False], leading[:-1]))
        value = units.copy()
        value[1:][second[1:]] += (units[:-1][second[1:]] - 0xC000) << 16
        return value[~leading]
    return units


def _planes(values: np.ndarray) -> bytes:
    """Compressed byte planes: the high bytes of small numbers are alike."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 3)


def _from_planes(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _cut(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


class _Block:
    """A block as it is read: its documents, its distinct words and their places."""

    def __init__(self, ids: list[int | None], lengths: list[np.ndarray], words: list[pa.Array]) -> None:
        self.ids, self.lengths = ids, np.concatenate(lengths)
        found = pa.concat_arrays(words).dictionary_encode()
        self.places = found.indices.to_numpy()
        self.words = found.dictionary.cast(pa.binary())
        sizes = pc.binary_length(self.words).to_numpy()
        self.seal = zlib.crc32(self.places.tobytes(), zlib.crc32(sizes.tobytes()))

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The words in the order of the block's list, by bucket and then sorted, and their buckets."""
        words = self.words.to_pylist()
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        ordered = pc.sort_indices(self.words).to_numpy().astype(np.int64)
        order = ordered[np.argsort(bucket[ordered], kind="stable")]
        return order, bucket[order]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, _Block]]:
    """Cut a scan of (id, text) into blocks: region, number (by partition and place in it), block.

    Spark has parted the words of a text by single blanks.
    """
    part = TaskContext.get().partitionId()
    number, size = part << 24, 0
    ids: list[int | None] = []
    lengths: list[np.ndarray] = []
    words: list[pa.Array] = []
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        lists, documents = pc.split_pattern(batch.column(1), " "), batch.column(0).to_pylist()
        found, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
        bytes_of = pc.binary_length(found).to_numpy()
        real = np.concatenate(([0], np.cumsum(bytes_of > 0)))[ends]  # a blank at an end leaves an empty one
        found = found.filter(pa.array(bytes_of > 0))
        upto = np.concatenate(([0], np.cumsum(bytes_of, dtype=np.int64)))[ends]
        at, first, before = 0, 0, 0
        while at < len(documents):
            stop = min(len(documents), int(np.searchsorted(upto, before + BLOCK_BYTES - size)) + 1)
            ids += documents[at:stop]
            lengths.append(np.diff(real[at:stop], prepend=first))
            words.append(found.slice(first, int(real[stop - 1]) - first))
            size += int(upto[stop - 1]) - before
            at, first, before = stop, int(real[stop - 1]), int(upto[stop - 1])
            if size >= BLOCK_BYTES:
                yield part // REGION, number, _Block(ids, lengths, words)
                number, size, ids, lengths, words = number + 1, 0, [], [], []
                pa.default_memory_pool().release_unused()
    if ids:
        yield part // REGION, number, _Block(ids, lengths, words)


def _batch(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)


def _send_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, number, block in _blocks(batches):
            order, bucket = block.by_bucket(buckets)
            words = block.words.take(pa.array(order)).to_pylist()
            cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            parts = ((b, words[cuts[b] : cuts[b + 1]]) for b in range(buckets))
            rows = [(region, number, b, block.seal, zstandard.compress(b"\n".join(ws), 3)) for b, ws in parts if ws]
            if rows:
                yield _batch(rows)

    return run


def _send_positions(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's documents, as positions: frequent words get small numbers."""
        for region, number, block in _blocks(batches):
            order = np.argsort(-np.bincount(block.places, minlength=len(block.words)), kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            payload = _join(
                zstandard.compress(json.dumps(block.ids).encode(), 3),
                _planes(block.lengths.astype("<u4")),
                _planes(np.frombuffer(pack_positions(rank[block.places]), dtype="<u2")),
                _planes(rank[block.by_bucket(buckets)[0]].astype("<u4")),
            )
            yield _batch([(region, number, _OWN, block.seal, payload)])

    return run


def _encode_bucket(path: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Encode each distinct word of a bucket once, for all the blocks that have it.

        The first row also gets the distinct ids of the bucket.
        """
        tokenizer = load_tokenizer(path)
        lists = [pa.array(zstandard.decompress(x).decode().split("\n")) for x in rows["payload"]]  # no word holds one
        found = pa.concat_arrays(lists).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        ids: list[list[int]] = []
        for at in range(0, len(distinct), 10_000):
            ids += [e.ids for e in tokenizer.encode_batch_fast(distinct[at : at + 10_000], add_special_tokens=False)]
        count = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.array([i for x in ids for i in x], dtype="<u4")
        start = np.cumsum(count) - count
        sent = []
        for place in np.split(found.indices.to_numpy(), np.cumsum([len(x) for x in lists])[:-1]):
            own = count[place]
            at = np.repeat(start[place] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            sent.append(_join(_planes(own.astype("<u4")), _planes(flat[at])))
        seen = [np.unique(flat).astype(np.int32)] + [None] * (len(rows) - 1)
        return rows[["region", "block", "bucket", "seal"]].assign(payload=sent, ids=seen)

    return run


class _Assembled:
    """A block put together: its documents' words as places in its list, and the list's ids."""

    def __init__(self, rows: list[dict]) -> None:
        rows = sorted(rows, key=lambda r: r["bucket"])
        self.pieces = next((r for r in rows if r["bucket"] == _PIECES), None)
        rows = [r for r in rows if r["bucket"] != _PIECES]
        if len({r["seal"] for r in rows}) != 1 or [r["bucket"] for r in rows].count(_OWN) != 1:
            raise RuntimeError("the documents changed between two passes over them; write them to a table first")
        ids, lengths, positions, listed = _cut(rows[0]["payload"])
        number = _from_planes(listed, "<u4").astype(np.int64)
        parts = [_cut(r["payload"]) for r in rows[1:]]
        none = np.zeros(0, dtype="<u4")
        self.count = np.concatenate([none, *(_from_planes(c, "<u4") for c, _ in parts)]).astype(np.int64)
        self.flat = np.concatenate([none, *(_from_planes(f, "<u4") for _, f in parts)])
        if len(self.count) != len(number):
            raise RuntimeError("some words of a block came back without ids")
        self.start = np.cumsum(self.count) - self.count
        place = np.empty(len(number), dtype=np.int64)
        place[number] = np.arange(len(number))
        words = place[unpack_positions(_from_planes(positions, "<u2").tobytes())]
        ends = np.cumsum(_from_planes(lengths, "<u4"), dtype=np.int64)
        some = self.count[words] > 0  # some words leave nothing
        self.ids = json.loads(zstandard.decompress(ids))
        self.words, self.ends = words[some], np.concatenate(([0], np.cumsum(some)))[ends]

    def slices(self) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """A few documents at a time: identifiers, words, and where each document's words end."""
        at, first = 0, 0
        while at < len(self.ids):
            stop = min(len(self.ids), int(np.searchsorted(self.ends, first + SLICE)) + 1)
            last = int(self.ends[stop - 1])
            yield self.ids[at:stop], self.words[first:last], self.ends[at:stop] - first
            at, first = stop, last

    def ids_of(self, words: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        """The ids of each document of a slice."""
        count = self.count[words]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        flat = self.flat[np.repeat(self.start[words] - (upto - count), count) + np.arange(total)]
        offsets = np.concatenate(([0], np.concatenate(([0], upto))[ends]))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))

    def written(self, symbols: pa.Array, symbol: np.ndarray) -> pa.Array:
        """Each word of the list, its ids written as ``symbols`` with blanks between."""
        offsets = pa.array(np.concatenate((self.start, [len(self.flat)])).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, symbols.take(pa.array(symbol))), " ")


def _texts_of(words: pa.Array, which: np.ndarray, ends: np.ndarray) -> list[str]:
    """The words of each document, joined by one blank."""
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(which))), " ").to_pylist()


def _hashes(texts: list[str]) -> pa.Array:
    return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())


_DIGEST_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Put a block's ids in place, and their joined pieces; take digests of both as texts."""
        block = _Assembled([row for batch in batches for row in batch.to_pylist()])
        flat = block.flat.astype(np.int64)
        distinct, symbol = np.unique(flat, return_inverse=True)
        decimal = block.written(pa.array(map(str, distinct.tolist()), pa.string()), symbol)
        known = np.array(block.pieces["ids"] if block.pieces else [], dtype=np.int64)
        pieces = pa.array(block.pieces["pieces"].split("\n") if block.pieces else [], pa.string())
        at = np.searchsorted(known, flat)
        if len(flat) and not (known[np.minimum(at, len(known) - 1)] == flat).all():
            raise RuntimeError("some ids have no piece")
        decoded = block.written(pieces, at)
        for documents, words, ends in block.slices():
            ids = block.ids_of(words, ends)
            columns = [
                pa.array(documents, pa.int64()),
                pc.list_value_length(ids).cast(pa.int64()),
                _hashes(_texts_of(decimal, words, ends)),
                _hashes(_texts_of(decoded, words, ends)),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*columns, *[ids] * with_ids], names=[*names, *["ids"] * with_ids])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Assembled([row for batch in batches for row in batch.to_pylist()])
    for documents, words, ends in block.slices():
        yield pa.RecordBatch.from_arrays([pa.array(documents, pa.int64()), block.ids_of(words, ends)], names=["doc_id", "ids"])


def encoded_blocks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows from which blocks are put together, and the word table's own.

    Of the first, group by ``block``: each has its documents and its words' ids. The word table has
    a row for each block and bucket; ``ids``, on one row of each bucket, lists the bucket's ids. The
    number of buckets follows the amount of text up to a bound, and a word has one place in its
    region's table for each block at most, so no word is hot. ``docs`` is read twice and must give
    the same rows in the same partitions, as files do; a checksum of each block makes sure of it.
    """
    check_tokenizer(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(text, _BLANKS, " ").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    buckets = min(BUCKETS, buckets)
    lists = words.mapInArrow(_send_words(buckets), _ROWS_DDL)
    table = lists.groupBy("region", "bucket").applyInPandas(_encode_bucket(path), _ROWS_DDL + ", ids array<int>")
    table = staged(table, "bpe-words")
    return words.mapInArrow(_send_positions(buckets), _ROWS_DDL).unionByName(table.drop("ids")), table


def pieces_by_block(table: DataFrame, pieces: DataFrame) -> DataFrame:
    """For each block: ids of its region's word table, in order, and their pieces, a line each.

    An id-to-piece join of the table's distinct ids; a region has as many as the tokenizer at most.
    """
    used = table.select("region", F.explode("ids").alias("id")).distinct().join(F.broadcast(pieces), "id")
    listed = used.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("id", "piece"))).alias("listed"))
    listed = listed.select(
        "region",
        F.transform("listed", lambda x: x["id"]).alias("ids"),
        F.array_join(F.transform("listed", lambda x: x["piece"]), "\n").alias("pieces"),
    )
    return table.select("region", "block").distinct().join(listed, "region")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text, as the tokenizers library gives
    them without added special tokens; a special token's string in a text is that token.

    A null text counts as empty and an empty text has no ids; null and repeated identifiers are
    kept, a row for a row; texts of any length are encoded whole. An empty table gives no rows;
    other columns are not read.
    """
    rows, _ = encoded_blocks(docs, path, id_col, text_col)
    return rows.groupBy("block").applyInArrow(_tokens, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text for ``encoded`` (doc_id, ids): an id-to-piece join.

    The table of pieces has a row for each id of the tokenizer's file, so its size is known before
    it is broadcast. Pieces are joined by one blank, as this kind of tokenizer decodes; no ids or
    null give an empty text. Repeated rows stay apart.
    """
    pieces = F.broadcast(piece_table(encoded.sparkSession, path).withColumnRenamed("id", "token"))
    rows = encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))
    tokens = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("at", "token")).join(pieces, "token", "left")
    placed = tokens.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("placed"))
    return placed.select("doc_id", F.array_join(F.transform("placed", lambda p: p["piece"]), " ").alias("decoded"))


def encode_digest(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every document; edge cases as
    ``encode``."""
    rows, table = encoded_blocks(docs, path)
    pieces = pieces_by_block(table, piece_table(docs.sparkSession, path))
    rows = rows.unionByName(pieces.select("block", F.lit(_PIECES).alias("bucket"), "ids", "pieces"), allowMissingColumns=True)
    schema = _DIGEST_DDL + ", ids array<int>" * with_ids
    return rows.drop("region").groupBy("block").applyInArrow(_digest(with_ids), schema)
