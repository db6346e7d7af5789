"""Substring dedup by fixed-block anchors.

Every 18th position of a document starts an anchor, a reference block of 18 words. Every window of
18 words probes the anchors. A repeat of 35 words or more holds an anchor on either side, whatever
the alignment, so hits say where repeats can be, and a hit is extended to the windows of 35 words
that hold it. Probing goes by fast hashes, whose chance hits cost work only. Whether a window starts
anywhere else is decided on its words, by a cryptographic digest of them (128 bits of BLAKE2b); the
windows that do grow together to the maximal stretches that are removed.

Documents travel in blocks, bounded batches. A block sends the index each distinct window once,
packed, and gets a bit for each back; it never sends positions, since it finds them again from its
texts. So a passage shared by a third of all documents costs an entry for each block that has it,
and no pair of its places is ever made.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm.common import staged

#: Bytes of text of one block at most, but for a last document that is longer.
BLOCK_BYTES = 16_000_000
#: Bytes of text for each bucket of the index; with 32 bits of a window's hash in a bucket this
#: keeps the share of chance hits the same at every size. Chance hits cost work, not results.
BUCKET_BYTES = 16_000_000
#: Bytes of text that are hashed at once.
_PART = 2_000_000
_DDL = "kind string, block long, bucket int, payload binary"
_SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the word hash and of the window hash by which anchors are probed.
_WORD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes, power: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of ``data`` and a 64-bit hash of it, by running polynomial sums."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~_BLANK[raw]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return starts, ends, _mixed((total[ends] - total[starts]) * inverse[starts])


def _window(h: np.ndarray, step: np.uint64, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, by doubling."""
    grown, size, have, done = h, 1, None, 0
    while True:
        if length & size:
            if have is None:
                have, done = grown, size
            else:
                n = len(grown) - done
                have = have[:n] + np.uint64(pow(int(step), done, 1 << 64)) * grown[done:]
                done += size
        if done == length:
            return _mixed(have[: len(h) - length + 1])
        grown = grown[:-size] + np.uint64(pow(int(step), size, 1 << 64)) * grown[size:]
        size *= 2


class _Words:
    """The words of a block's documents: their places and hashes, and where each document's are.

    Words are parted by single blanks in ``texts``.
    """

    def __init__(self, texts: list[bytes]) -> None:
        longest = max(_PART, max(map(len, texts), default=0)) + 1
        power, inverse = _powers(_WORD, longest), _powers(np.uint64(pow(int(_WORD), -1, 1 << 64)), longest)
        self.data = b"\n".join(texts)
        counts, first, last, hashes = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.uint64))
        part: list[int] = []
        base = held = 0

        def hash_part() -> int:
            size = sum(part) + len(part)
            starts, ends, own = word_hashes(self.data[base : base + size], power, inverse)
            counts.append(np.diff(np.searchsorted(starts, np.cumsum(part) + np.arange(1, len(part) + 1)), prepend=0))
            first.append(starts + base), last.append(ends + base), hashes.append(own)
            return base + size

        for text in texts:
            if part and held + len(text) + len(part) > _PART:
                base, part, held = hash_part(), [], 0
            part.append(len(text))
            held += len(text)
        if part:
            hash_part()
        self.n, self.first, self.last, self.hashes = (np.concatenate(x) for x in (counts, first, last, hashes))
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n

    def digests(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """A cryptographic digest, as two numbers, of the ``length`` words from each position."""
        view = memoryview(self.data)
        spans = zip(self.first[at].tolist(), self.last[at + length - 1].tolist(), strict=True)
        found = np.frombuffer(b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in spans]), "<u8").reshape(-1, 2)
        return found[:, 0].copy(), found[:, 1].copy()

    def windows(self, length: int, least: int) -> np.ndarray:
        """Positions where a window of ``length`` words starts, in documents of ``least`` or more."""
        room = np.where(self.n >= least, np.maximum(self.n - length + 1, 0), 0)
        ends = np.cumsum(room)
        return np.repeat(self.starts - (ends - room), room) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Sent:
    """Distinct keys of one bucket, and which key each of a block's positions has."""

    def __init__(self, key: np.ndarray, tail: np.ndarray | None = None) -> None:
        order = np.argsort(key, kind="stable") if tail is None else np.lexsort((tail, key))
        sorted_key = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        if tail is not None:
            new[1:] |= tail[order][1:] != tail[order][:-1]
        at = np.flatnonzero(new)
        self.key = sorted_key[at]
        self.tail = None if tail is None else tail[order][at]
        self.inverse = np.empty(len(key), dtype=np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.many = np.diff(np.append(at, len(key))) > 1


def _planes(values: np.ndarray) -> bytes:
    """Bytes of the differences of sorted values, plane by plane, so that the high ones compress."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return zlib.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(len(gaps), -1).T).tobytes(), 1)


def _from_planes(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).reshape(-1), dtype=dtype)


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _cut(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _bits(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), dtype=np.uint8), count=n).astype(bool)


class SubstringRepeats:
    """The steps of one run: how long a repeat is, how long anchors are, and how many buckets."""

    def __init__(self, words: int, buckets: int) -> None:
        self.words, self.anchor, self.buckets = words, (words + 1) // 2, buckets

    # What a block works out of its texts, the same in every step.

    def probes(self, own: _Words) -> Iterator[tuple[int, np.ndarray, _Sent, np.ndarray]]:
        """bucket, positions, keys and which keys are anchors."""
        at = own.windows(self.anchor, self.words)
        if not len(at):
            return
        h = _window(own.hashes, _STEP, self.anchor)[at]
        inside = at - np.repeat(own.starts, own.n)[at]
        is_anchor = inside % self.anchor == 0
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            which = order[cuts[b] : cuts[b + 1]]
            if len(which):
                sent = _Sent((h[which] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                anchored = np.zeros(len(sent.key), dtype=bool)
                anchored[sent.inverse[is_anchor[which]]] = True
                yield b, at[which], sent, anchored

    def candidates(self, own: _Words, hit: np.ndarray) -> Iterator[tuple[int, np.ndarray, _Sent]]:
        """bucket, positions and keys of the windows of ``words`` that hold a hit."""
        at = own.windows(self.words, self.words)
        if not len(at):
            return
        seen = np.concatenate(([0], np.cumsum(hit)))
        at = at[seen[at + self.words - self.anchor + 1] > seen[at]]
        if not len(at):
            return
        h, tail = own.digests(at, self.words)
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            which = order[cuts[b] : cuts[b + 1]]
            if len(which):
                yield b, at[which], _Sent(h[which], tail[which])

    def marked(self, rows: pd.DataFrame, kind: str) -> dict[int, bytes]:
        found = rows[rows["kind"] == kind]
        return dict(zip(found["bucket"].tolist(), found["payload"], strict=True))

    def hits(self, own: _Words, rows: pd.DataFrame) -> np.ndarray:
        hit = np.zeros(int(own.n.sum()), dtype=bool)
        found = self.marked(rows, "hits")
        for b, at, sent, _ in self.probes(own):
            if b in found:
                hit[at] = _from_bits(found[b], len(sent.key))[sent.inverse]
        return hit

    # Steps.

    def send_probes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _Words(_texts(payload)[1])
                rows = [("probes", block, b, _join([_planes(s.key), _bits(s.many), _bits(a)])) for b, _, s, a in self.probes(own)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    def index(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket: which keys have two places or more, an anchor among them."""
        keys, many, anchored = [], [], []
        for payload in rows["payload"]:
            key, flags, anchor = _cut(payload)
            keys.append(_from_planes(key, "<u4"))
            many.append(_from_bits(flags, len(keys[-1])))
            anchored.append(_from_bits(anchor, len(keys[-1])))
        every = _Sent(np.concatenate(keys))
        anchor = np.zeros(len(every.key), dtype=bool)
        anchor[every.inverse[np.concatenate(anchored)]] = True
        several = every.many.copy()
        several[every.inverse[np.concatenate(many)]] = True
        return self._back(rows, "hits", keys, (anchor & several)[every.inverse])

    def _back(self, rows: pd.DataFrame, kind: str, keys: list[np.ndarray], flags: np.ndarray) -> pd.DataFrame:
        ends = np.cumsum([len(k) for k in keys])
        sent = [(kind, r.block, r.bucket, _bits(f)) for r, f in zip(rows.itertuples(), np.split(flags, ends[:-1]), strict=True) if f.any()]
        return pd.DataFrame(sent, columns=["kind", "block", "bucket", "payload"])

    def send_candidates(self, rows: pd.DataFrame) -> pd.DataFrame:
        sent = []
        if (rows["kind"] == "hits").any():
            own_row = rows[rows["kind"] == "texts"].iloc[0]
            own = _Words(_texts(own_row["payload"])[1])
            for b, _, s in self.candidates(own, self.hits(own, rows)):
                payload = _join([_planes(s.key), s.tail.tobytes(), _bits(s.many)])
                sent.append(("candidates", own_row["block"], b, payload))
        return pd.DataFrame(sent, columns=["kind", "block", "bucket", "payload"])

    def extend(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket: which windows start in two places or more."""
        keys, tails, many = [], [], []
        for payload in rows["payload"]:
            key, tail, flags = _cut(payload)
            keys.append(_from_planes(key, "<u8"))
            tails.append(np.frombuffer(tail, "<u8"))
            many.append(_from_bits(flags, len(keys[-1])))
        every = _Sent(np.concatenate(keys), np.concatenate(tails))
        several = every.many.copy()
        several[every.inverse[np.concatenate(many)]] = True
        return self._back(rows, "repeats", keys, several[every.inverse])

    def removed(self, rows: pd.DataFrame) -> tuple[list[int | None], list[bytes], _Words | None, np.ndarray]:
        ids, texts = _texts(rows[rows["kind"] == "texts"].iloc[0]["payload"])
        found = self.marked(rows, "repeats")
        if not found:
            return ids, texts, None, np.zeros(0, dtype=bool)
        own = _Words(texts)
        change = np.zeros(int(own.n.sum()) + 1, dtype=np.int32)
        for b, at, sent in self.candidates(own, self.hits(own, rows)):
            if b in found:
                start = at[_from_bits(found[b], len(sent.key))[sent.inverse]]
                change[start] += 1
                change[start + self.words] -= 1  # of one bucket, so each place once
        return ids, texts, own, np.cumsum(change[:-1]) > 0

    def cut(self, rows: pd.DataFrame) -> pd.DataFrame:
        ids, texts, own, gone = self.removed(rows)
        out = []
        for k, (document, text) in enumerate(zip(ids, texts, strict=True)):
            kept = text.split()
            n = len(kept)
            if own is not None and (own_gone := gone[own.starts[k] : own.ends[k]]).any():
                kept = [w for w, x in zip(kept, own_gone.tolist(), strict=True) if not x]
            out.append((document, n, n - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    def digest(self, rows: pd.DataFrame) -> pd.DataFrame:
        done = self.cut(rows)
        done["kept_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in done.pop("kept")]
        return done


def _texts(payload: bytes) -> tuple[list[int | None], list[bytes]]:
    ids, lengths, body = _cut(payload)
    ids, lengths, body = json.loads(zlib.decompress(ids)), np.frombuffer(lengths, "<u4"), zlib.decompress(body)
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    return ids, [body[a:b] for a, b in zip([0, *ends], ends)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, count, held = TaskContext.get().partitionId() << 24, 0, 0
    ids: list[int | None] = []
    texts: list[bytes] = []

    def block() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], dtype="<u4").tobytes()
        payload = _join([zlib.compress(json.dumps(ids).encode(), 1), lengths, zlib.compress(b"".join(texts), 1)])
        return pa.RecordBatch.from_arrays([pa.array([base + count]), pa.array([payload], pa.binary())], names=["block", "payload"])

    for batch in batches:
        for document, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(document)
            texts.append(b" ".join(text.split()))
            held += len(text)
            if held >= BLOCK_BYTES:
                yield block()
                count, held = count + 1, 0
                ids.clear(), texts.clear()
    if ids:
        yield block()


def _repeats(docs: DataFrame, words: int, id_col: str, text_col: str) -> tuple[SubstringRepeats, DataFrame]:
    """The steps, and for each block its texts, hits and repeats; group by block."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    steps = SubstringRepeats(words, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))
    blocks = staged(texts.mapInArrow(_blocks, "block long, payload binary"), "substring-blocks")
    own = blocks.select(F.lit("texts").alias("kind"), "block", F.lit(-1).alias("bucket"), "payload")

    probes = blocks.mapInArrow(steps.send_probes, _DDL)
    hits = staged(probes.groupBy("bucket").applyInPandas(lambda rows: steps.index(rows), _DDL), "substring-hits")
    candidates = own.unionByName(hits).groupBy("block").applyInPandas(lambda rows: steps.send_candidates(rows), _DDL)
    repeats = candidates.groupBy("bucket").applyInPandas(lambda rows: steps.extend(rows), _DDL)
    return steps, own.unionByName(hits).unionByName(repeats)


def remove_repeats(docs: DataFrame, words: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``words`` words that also starts anywhere else.

    Returns a row for each row of ``docs``: doc_id, n_words, n_removed, kept (its other words,
    joined by one blank). Windows are judged on the input: all places of a repeat lose it, also
    within one document and where places overlap.

    A null text has no words; null and repeated identifiers are kept, a row for a row, and repeated
    rows are repeats of each other; texts of any length are read whole. An empty table gives no
    rows; other columns are not read. Windows are equal if 128 bits of their words' BLAKE2b are.
    """
    steps, rows = _repeats(docs, words, id_col, text_col)
    return rows.groupBy("block").applyInPandas(lambda rows: steps.cut(rows), "doc_id long, n_words long, n_removed long, kept string")


def repeats_digest(docs: DataFrame, words: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; edge cases as ``remove_repeats``."""
    steps, rows = _repeats(docs, words, "doc_id", "text")
    return rows.groupBy("block").applyInPandas(lambda rows: steps.digest(rows), "doc_id long, n_words long, n_removed long, kept_sha256 string")
