"""Token counts by a two-tier lookup on the map side.

Pieces of the models that ``check_model`` accepts never cross from a word into the blank before the
next one, so a text's tokens are those of its pre-tokens: a run of blanks with the word after it, or
the blanks at the end. Spark counts words over all texts in a frequent-items sketch of fixed size,
of which each task ships one; the lengths of the most frequent ones are a table of bounded size that
is broadcast. A task cuts a batch of texts by array operations, finds most words in that table, and
encodes the rest once for each worker, through a cache of bounded size. Neither texts nor pre-tokens
are shuffled, and the sketch decides only where a length is looked up, never what it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The blank as pieces have it; in a text it counts as a blank.
MARK = "▁"
#: Words of the broadcast table, each of so many bytes at most: 1.1 MB. Spark's sketch gives 10,000 at most.
FREQUENT, WORD_BYTES = 8_192, 128
#: Items that a sketch tracks, and scan partitions whose sketches meet in one task before all meet.
TRACKED, SKETCHES = 32_768, 64
#: Words in a worker's cache, of WORD_BYTES at most; a full one is emptied.
CACHED = 400_000
#: Bytes of text that are cut together, but for a longer text.
SLICE_BYTES = 4_000_000

_loaded: dict[str, object] = {}
_cache: dict[str, dict[str, int]] = {}


def load_model(path: str):
    """The sentencepiece model of a file, once for each Python process."""
    if path not in _loaded:
        from sentencepiece import SentencePieceProcessor

        _loaded[path] = SentencePieceProcessor(model_file=path)
    return _loaded[path]


def check_model(path: str) -> None:
    """Raise unless pre-tokens are independent for this model, as the module's docstring says."""
    if not path.endswith(".model"):
        raise ValueError(f"{path}: not a sentencepiece model")
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    # Types: normal 1, unknown 2, control 3, user-defined 4, unused 5, byte 6. Bytes keep unknown characters apart.
    known = spec.trainer_spec.model_type == 2 and spec.trainer_spec.byte_fallback and kinds <= {1, 2, 3, 6}
    apart = not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces if p.type == 1)
    if not (plain and known and apart and not spec.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError(f"{path}: not a model whose pre-tokens are encoded one by one")


def frequent_words(texts: DataFrame) -> list[str]:
    """The most frequent of all words between single blanks in ``text``, by a sketch over all rows.

    Sketches of scan partitions are merged in two steps, so no task gets more of them than SKETCHES
    or a SKETCHES-th of all. Empty and longer words are left out.
    """
    words = texts.select(
        F.floor(F.spark_partition_id() / F.lit(SKETCHES)).alias("near"),
        F.explode(F.split(F.translate("text", MARK, " "), " ")).alias("word"),
    ).where(F.octet_length("word").between(1, WORD_BYTES))
    near = words.groupBy("near").agg(F.expr(f"approx_top_k_accumulate(word, {TRACKED})").alias("sketch"))
    combined = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {FREQUENT})")
    top = near.groupBy(F.lit("all")).agg(combined.alias("top")).first()  # no row where there are no words
    return sorted({row["item"] for row in top["top"]}) if top else []


def length_table(path: str, words: list[str]) -> bytes:
    """The words and the number of tokens of each, after one blank, as an Arrow stream."""
    counts = [len(ids) for ids in load_model(path).encode(words, num_threads=1)]
    table = pa.record_batch([pa.array(words, pa.string()), pa.array(counts, pa.int32())], names=["word", "tokens"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _encoded(path: str, words: list[str]) -> list[int]:
    """Tokens of each of ``words`` after one blank, through the worker's cache."""
    known, model = _cache.setdefault(path, {}), load_model(path)
    missing = list(dict.fromkeys(w for w in words if w not in known))
    fresh = dict(zip(missing, (len(ids) for ids in model.encode(missing, num_threads=1))))
    out = [known[w] if w in known else fresh[w] for w in words]
    if len(known) + len(fresh) > CACHED:
        known.clear()
    known.update((w, n) for w, n in fresh.items() if len(w) * 4 <= WORD_BYTES)
    return out


def _ends(path: str, blanks: list[int]) -> list[int]:
    """Tokens of so many blanks at the end of a text."""
    model = load_model(path)
    return [len(model.encode("a" + " " * n)) - len(model.encode("a")) for n in blanks]


def count_tokens(path: str, texts: pa.Array, words: pa.Array, tokens: np.ndarray) -> np.ndarray:
    """The number of tokens of each of ``texts``; ``words`` and ``tokens`` are the first tier."""
    lists = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
    found = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)
    number = np.arange(len(found))
    real = pc.binary_length(found).to_numpy() > 0
    # Each word has a blank before it (the first one's is added), an empty one gives its own to the next.
    last = np.maximum.accumulate(np.where(real, number, -1))
    last = np.maximum(np.concatenate(([-1], last[:-1]))[: len(found)], (ends - sizes)[document] - 1)
    blanks = number - last

    counts = np.zeros(len(found), dtype=np.int64)
    at = np.flatnonzero(real)
    distinct = found.take(pa.array(at)).dictionary_encode()
    names, place = distinct.dictionary, distinct.indices.to_numpy()
    hit = pc.index_in(names, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
    lengths = np.append(tokens, 0)[hit].astype(np.int64)  # the last one, for -1, is filled next
    misses = np.flatnonzero(hit < 0)
    lengths[misses] = _encoded(path, names.take(pa.array(misses)).to_pylist())
    counts[at] = lengths[place]

    spaced = np.flatnonzero(real & (blanks > 1))
    if len(spaced):
        named = zip(blanks[spaced].tolist(), found.take(pa.array(spaced)).to_pylist())
        counts[spaced] = _encoded(path, [" " * (n - 1) + word for n, word in named])
    empty = np.flatnonzero(~real[np.maximum(ends - 1, 0)]) if len(found) else np.zeros(0, dtype=np.int64)
    empty = empty[pc.binary_length(texts).to_numpy()[empty] > 0]  # no text has no token
    if len(empty):
        counts[ends[empty] - 1] = _ends(path, blanks[ends[empty] - 1].tolist())
    upto = np.concatenate(([0], np.cumsum(counts)))
    return upto[ends] - upto[ends - sizes]


def _counts(path: str, table: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The columns of a batch with the number of tokens in place of the last one, the text."""
        first = pa.ipc.open_stream(table.value).read_next_batch()
        words, tokens = first.column(0), first.column(1).to_numpy()
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                before = int(upto[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right")))
                part = batch.slice(start, stop - start)
                counted = count_tokens(path, part.column(part.num_columns - 1), words, tokens)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counted)], names=[*part.schema.names[:-1], "n_tokens"])
                start = stop

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row's whole text.

    Tokens are counted as sentencepiece gives them for the model at ``path``, without begin or end;
    a special piece's string in a text is ordinary text. A null text counts as empty and an empty text
    has no token; texts of any length are cut whole. Null and repeated identifiers are kept, a row for
    a row. An empty table gives no rows; other columns are not read.
    """
    check_model(path)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text)
    table = docs.sparkSession.sparkContext.broadcast(length_table(path, frequent_words(docs.select(text))))
    counted = rows.mapInArrow(_counts(path, table), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
