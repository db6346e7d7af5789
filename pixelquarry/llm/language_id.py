"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte trigrams. Each language has several centroids,
clustered from a bounded sample of labelled rows. A text gets the language of the centroid that is
nearest by cosine, and is rejected if its cosine is under 0.4 of the lower quartile of those of the
texts of its size that the language was learned from: short texts lie far out, and clean ones are to
stay. A few outliers or wrong labels among the learned texts set neither a centroid nor a quartile.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm.common import boxed, discard, staged

FEATURES = 4096
#: Labelled rows of each language that the model is fitted on, about, and centroids of each.
SAMPLE, CENTROIDS = 1500, 4
#: Languages that a model holds at most: it is fitted and sent to the tasks whole, 64 KB for each.
MAX_LANGUAGES = 1000
#: The percentile of the learned texts' cosines, and the part of it under which a text is rejected.
LOW, REACH = 25, 0.4
#: Learned texts of a size that a quartile needs, and the part of a language's that a centroid needs.
ENOUGH, FEW = 20, 0.02
#: Sizes of texts: powers of two of their distinct trigrams.
SIZES = 13
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes other than letters become blanks; bytes of other characters stay.
_BLANKS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the lower-cased letters; trigrams of blanks alone don't count."""
    raw = f" {text.lower()} ".encode().translate(_BLANKS)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    blank = (b == 0x20).astype(np.uint8)
    code = code[blank[:-2] + blank[1:-1] + blank[2:] < 3]
    return np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=FEATURES)


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    length = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return v / np.maximum(length, 1e-12)


def _size(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum((counts > 0).sum(axis=-1), 1)).astype(np.int64)


def _least(cosines: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lower quartile of the cosines of each size.

    A size with too few texts takes that of the next smaller one that has enough. Below all of
    these the cosine falls with the root of the number of trigrams. It never falls with size, so
    that outliers of one size don't lower it. If no size has enough, all texts count as of their
    smallest size.
    """
    counts = np.bincount(sizes, minlength=SIZES)
    sizes = sizes if (counts >= ENOUGH).any() else np.full_like(sizes, sizes.min())
    known = [s for s in range(SIZES) if (sizes == s).sum() >= min(ENOUGH, len(sizes))]
    out = np.zeros(SIZES)
    for s in range(SIZES):
        at = max((k for k in known if k <= s), default=known[0])
        out[s] = np.percentile(cosines[sizes == at], LOW) * 2.0 ** (min(0, s - at) / 2)
    return np.maximum.accumulate(out)


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of spherical k-means, seeded by furthest points: no chance in it."""
    centres = [x.mean(axis=0)]
    nearest = np.full(len(x), -np.inf)
    for _ in range(min(k, len(x))):
        last = centres[-1] / max(1e-12, float(np.linalg.norm(centres[-1])))
        nearest = np.maximum(nearest, x @ last)
        centres.append(x[int(nearest.argmin())])
    c = np.stack(centres[1:] if len(centres) > k else centres[: max(1, len(centres) - 1)])
    for _ in range(20):
        own = (x @ c.T).argmax(axis=1)
        moved = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, c, atol=1e-6):
            break
        c = moved
    return c


def _common_means(x: np.ndarray, k: int) -> np.ndarray:
    """Centres that hold more than a few of the texts each; the texts of others seed none.

    Texts are left out for as long as such centres come up, at most half of them.
    """
    left = x
    while True:
        c = _means(left, k)
        own = (left @ c.T).argmax(axis=1)
        held = np.bincount(own, minlength=len(c)) >= FEW * len(x)
        inner = held[own]
        if inner.all() or 2 * inner.sum() < len(x):
            return c[held] if held.any() else c
        left = left[inner]


@dataclass
class LanguageModel:
    languages: list[str]  # one for each centroid
    centroids: np.ndarray
    least: np.ndarray  # by centroid and size: lower quartile of its language's cosines
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rejected = np.ones(len(texts), dtype=bool)
        which = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if which and self.languages:
            counts = np.stack([trigram_counts(texts[i]) for i in which])
            vectors, sizes = _vector(counts, self.idf), _size(counts).tolist()
            cosines = vectors @ self.centroids.T
            best = cosines.argmax(axis=1)
            for i, k, c, size in zip(which, best.tolist(), cosines.max(axis=1).tolist(), sizes, strict=True):
                found[i], scores[i] = self.languages[k], min(1.0, max(0.0, c))
                rejected[i] = c < REACH * self.least[k, size]
        return found, scores, rejected


def is_held_out(doc_id: Column) -> Column:
    """Every fifth document or so, by a checksum of its identifier (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if _LETTER.search(text):
                counts = trigram_counts(text)
                at = np.flatnonzero(counts)
                rows.append((lang, zlib.compress(at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes(), 1)))
        columns = list(zip(*rows)) if rows else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], names=["lang", "counts"])


def _dense(packed: bytes) -> np.ndarray:
    data = zlib.decompress(packed)
    n = len(data) // 6
    out = np.zeros(FEATURES, dtype=np.int64)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<u4", n, 2 * n)
    return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a partition of the sample each feature occurs."""
    n, total = 0, np.zeros(FEATURES, dtype=np.int64)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            total += _dense(packed) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "seen"])


def _clusters(idf: np.ndarray, k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Centroids of one language's sample and the cosines that its texts have."""
        counts = np.stack([_dense(c) for c in sorted(rows["counts"])])
        x = _vector(counts, idf)
        c = _common_means(x, k)
        least = _least((x @ c.T).max(axis=1), _size(counts)).tobytes()
        return pd.DataFrame(
            {"lang": rows["lang"].iloc[0], "k": range(len(c)), "centre": [v.astype("<f4").tobytes() for v in c], "least": least}
        )

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on about ``sample`` rows of each language of ``labelled`` (doc_id, text, lang).

    Rows are chosen by a hash of identifier and text, so every run chooses the same; rows without a
    language, without a text or without a letter are passed over. Languages meet their counts by a
    join. What comes to the driver are feature counts of the sample's partitions and the centroids,
    bounded by the sample and by ``MAX_LANGUAGES``; more labelled languages than that are refused.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    languages = staged(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    known = languages.count()
    if known > MAX_LANGUAGES:
        raise ValueError(f"{known} languages are labelled; a model holds {MAX_LANGUAGES} at most")
    if not known:
        return LanguageModel([], np.zeros((0, FEATURES), np.float32), np.zeros((0, SIZES)), np.ones(FEATURES, np.float32))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.join(languages, "lang").where(draw < F.lit(float(sample)) / F.col("n")).select("text", "lang")
    counts = staged(chosen.mapInArrow(_sparse, "lang string, counts binary"), "language-sample")
    discard(languages)
    seen = counts.select("counts").mapInArrow(_seen, "n long, seen binary").collect()
    n = sum(r["n"] for r in seen)
    found = sum((np.frombuffer(r["seen"], np.int64) for r in seen), np.zeros(FEATURES, np.int64))
    idf = np.log((1 + n) / (1 + found)).astype(np.float32) + 1
    made = counts.groupBy("lang").applyInPandas(_clusters(idf, centroids), "lang string, k int, centre binary, least binary")
    made = sorted(made.collect(), key=lambda r: (r["lang"], r["k"]))
    centres = np.stack([np.frombuffer(r["centre"], "<f4") for r in made]) if made else np.zeros((0, FEATURES), np.float32)
    return LanguageModel([r["lang"] for r in made], centres, np.array([np.frombuffer(r["least"]) for r in made]), idf)


def predict(docs: DataFrame, model: LanguageModel, carry: list[str]) -> DataFrame:
    """The ``carry`` columns with lang_pred, score (the cosine, 0 to 1) and rejected.

    Whole texts are read. A text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing was learned; both count as rejected. Repeated rows are judged alike; of
    equally near centroids the first in order of language wins. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, scores, rejected = shared.value.predict(part.column(0).to_pylist())
                columns = [*part.columns[1:], pa.array(found, pa.string()), pa.array(scores), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    inputs = docs.select(F.col("text").alias("_text"), *carry)
    return inputs.mapInArrow(run, schema)


def learned(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel:
    """The model of the documents that are not held out."""
    return fit(docs.where(~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample, centroids)


def identify(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document.

    The model learns from text and language of documents that are not held out; a prediction reads
    the text alone. A null identifier is not held out; edge cases of texts as ``predict``.
    """
    tagged = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return predict(tagged, learned(docs, sample, centroids), ["doc_id", "held_out"])


def known_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that language identification keeps.

    Rows without a letter in their text, null texts among them, are rejected and go. Repeated rows
    go or stay alike; null identifiers and languages don't matter; an empty table gives no rows, and
    a table without a labelled text keeps none, as nothing is known.
    """
    judged = predict(boxed(docs, text=F.col("text")), learned(docs), ["row"])
    return judged.where("NOT rejected").select("row.*")
