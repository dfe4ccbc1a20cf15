"""Language ID: nearest centroid over normalised TF-IDF vectors of character n-grams, with distance-based rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_binary, carried, lot, text_chunks

#: Buckets for hashed byte n-grams (a power of two).
FEATURES = 4096
_BITS = np.uint32(32 - 12)
#: Centroids are fitted on a sample of about so many documents in all, evenly by language, and never on more than twice as
#: many. Corpus statistics (document frequencies, documents by language) and the limits of distance cover all training rows.
SAMPLE, SAMPLE_EACH = 6000, 1000
CENTROIDS, ROUNDS = 4, 8
#: A text is rejected if it is farther from its centroid than this share of the training rows in its class of length, and a
#: margin more, which is wider for short texts by what sampling so few n-grams may do. A class of fewer than LEAST rows
#: takes the quantile of the nearest class that has them, the longer of two.
REJECT_SHARE, REJECT_MARGIN, REJECT_NOISE, LEAST = 0.001, 0.03, 1.5, 100
CLASSES, BINS = 16, 1000
#: Places of text that are counted at once.
SLICE = 1 << 20

#: Letters keep their byte; all else is a space.
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte 2-grams and 3-grams, one row per text. Only letters and word boundaries count. Long texts are
    counted in slices, and take about ten bytes of memory for each of their own."""
    low = [x.decode("utf-8", "replace").lower().encode() for x in texts]
    joined = _LETTER[np.frombuffer(b" ".join([b"", *low, b"", b""]), np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in low])
    out = np.zeros(len(texts) * FEATURES, np.int64)
    for a in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
        at = joined[a : min(a + SLICE, int(ends[-1])) + 2].astype(np.uint32)
        rows = np.searchsorted(ends, np.arange(a, a + len(at) - 2), "right") * FEATURES
        two = (at[:-2] << np.uint32(8) | at[1:-1]) * np.uint32(0x9E3779B1)
        three = (at[:-2] << np.uint32(16) | at[1:-1] << np.uint32(8) | at[2:]) * np.uint32(0x85EBCA77)
        real = (at[:-2] != 0x20) | (at[1:-1] != 0x20)
        first, last = rows[0], rows[-1] + FEATURES
        for codes in (two, three):
            out[first:last] += np.bincount((rows - first + (codes >> _BITS))[real], minlength=last - first)
    return out.reshape(len(texts), FEATURES).astype(np.float32)


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """centroids: unit vectors, languages: each one's language; limits: least similarity by class of length."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, cosine, and whether it is too far."""
        near = _unit(counts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        score = near[np.arange(len(best)), best]
        return best, score, score < self.limits[_length_class(counts)]


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(int), CLASSES - 1)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the mean and the vectors farthest from what is chosen."""
    chosen = [x[(x @ x.mean(axis=0)).argmax()]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[(x @ np.array(chosen).T).max(axis=1).argmin()])
    centre = np.array(chosen)
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(axis=1)
        centre = np.array([x[own == i].sum(axis=0) if (own == i).any() else centre[i] for i in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return centre


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(FEATURES, np.int64), 0
    for _, texts in text_chunks(batches, "text"):
        seen += (gram_counts(texts) > 0).sum(axis=0)
        n += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(seen, n))], ["feature", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches, "text"):
        counts = np.minimum(gram_counts(texts), 65535).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in counts], pa.binary())], ["lang", "counts"])


def fit(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of the training rows with a text and a language. Without such rows, one that knows no language."""
    rows = docs.where(training & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    texts = rows.select(as_binary(text_col).alias("text"))
    found = texts.mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(FEATURES + 1)
    seen[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])).astype(np.float32) + 1
    each = min(SAMPLE_EACH, SAMPLE // max(1, len(totals)))
    share = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, each / n))).otherwise(share)
    # Drawn by text, a repeated text once, so neither a repeated id nor a repeated row fills the sample.
    drawn = rows.where(lot(F.lit("language"), F.col(id_col), F.col(text_col)) < share).select(as_binary(text_col).alias("text"), F.col(lang_col).alias("lang"))
    drawn = drawn.dropDuplicates().limit(2 * SAMPLE)
    sample = drawn.mapInArrow(_sampled, "lang string, counts binary").toArrow().sort_by([("lang", "ascending"), ("counts", "ascending")])
    by_lang: dict[str, list] = {}
    for lang, counts in zip(sample.column("lang").to_pylist(), sample.column("counts").to_pylist(), strict=True):
        by_lang.setdefault(lang, []).append(np.frombuffer(counts, np.uint16))
    del sample
    languages, centroids = [], []
    for lang in sorted(by_lang):
        centre = _cluster(_unit(np.array(by_lang[lang], np.float32), idf), CENTROIDS)
        languages += [lang] * len(centre)
        centroids.append(centre)
    if not languages:
        return Model(idf, np.zeros((1, FEATURES), np.float32), ["und"], np.full(CLASSES, 2.0))
    model = Model(idf, np.concatenate(centroids).astype(np.float32), languages, np.zeros(CLASSES))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS vectors of FEATURES numbers for each language
    near = texts.mapInArrow(lambda it: _distances(it, shared.value), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # CLASSES * BINS rows at most
    counted = np.zeros(CLASSES * BINS)
    counted[near.column("place").to_numpy()] = near.column("n").to_numpy()
    model.limits = _limits(counted.reshape(CLASSES, BINS))
    return model


def _distances(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How many training rows have which cosine, by class of length: place = class * BINS + bin."""
    seen = np.zeros(CLASSES * BINS, np.int64)
    for _, texts in text_chunks(batches, "text"):
        counts = gram_counts(texts)
        score = np.clip(model.predict(counts)[1], 0, 1)
        seen += np.bincount(_length_class(counts) * BINS + np.minimum((score * BINS).astype(int), BINS - 1), minlength=len(seen))
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["place", "n"])


def _limits(counted: np.ndarray) -> np.ndarray:
    rows = counted.sum(axis=1)
    full = np.flatnonzero(rows >= LEAST)
    if not full.size:
        return np.zeros(CLASSES)
    low = np.array([np.searchsorted(np.cumsum(c), REJECT_SHARE * n, "right") / BINS for c, n in zip(counted, rows, strict=True)])
    near = [full[np.lexsort((-full, np.abs(full - c)))[0]] for c in range(CLASSES)]
    return np.maximum(0.0, low[near] - REJECT_MARGIN - REJECT_NOISE * 2 ** (-np.arange(CLASSES) / 2))


def _labelled(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches, "__text"):
        best, score, far = model.predict(gram_counts(texts))
        wordless = np.array([not any(map(str.isalpha, x.decode("utf-8", "replace"))) for x in texts])
        names = ["und" if no else model.languages[b] for b, no in zip(best, wordless, strict=True)]
        keep = [c for c in batch.schema.names if c != "__text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(names), pa.array(np.where(wordless, 0.0, np.clip(score, 0, 1)).astype(np.float64)), pa.array(far | wordless)],
            [*keep, "lang_pred", "score", "rejected"],
        )


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per row of docs: the carried columns, lang_pred, score (cosine, 0 to 1), rejected.

    Whole texts count. Null texts and texts without a letter are 'und', score 0, rejected; a text whose cosine is
    below the limit for its length is rejected but still gets its nearest language. Ties go to the first centroid.
    Ids do not matter, null or not; repeated rows get the same answer; an empty table gives no rows. Columns that are not
    carried do not matter; of a carried one with the name of a result, the result stays."""
    rows = docs.select(*carried(docs, carry, ("lang_pred", "score", "rejected")), F.col(text_col).cast("binary").alias("__text"))
    own = [T.StructField(n, t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType()))]
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "__text"), *own])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS vectors of FEATURES numbers for each language
    return rows.mapInArrow(lambda it: _labelled(it, shared.value), schema)
