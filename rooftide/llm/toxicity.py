"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, thresholds by language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_binary, carried, lot, text_chunks, word_hashes

#: Buckets of words and beginnings, sizes of an embedding, widths of the filters in words, filters of each width.
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
#: A word's embedding is the sum of its own and those of its beginnings of so many bytes.
PREFIXES = (4, 5)
PARTS = 1 + len(PREFIXES)
#: The classifier is fitted on a sample of labelled rows: about so many of each label, and never more than twice as many.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 3000, 4500
EPOCHS, BATCH, RATE, DROP = 8, 32, 0.01, 0.3
#: Every so many-th row of the sample only calibrates the score of 0.5. Each language's threshold is calibrated on all its
#: labelled training rows, counted by score in BINS; a language with fewer than LEAST rows of either label keeps 0.5.
CALIBRATE, BINS, LEAST = 5, 1000, 20
#: Windows that are pooled at once.
SLICE = 1 << 17
_EDGES = np.array([ord(c) for c in ".,;:!?\"'()[]{}*#$%&@~|-_"], np.uint8)
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[_EDGES] = 0x20
_CLEAN = _CLEAN.tobytes()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and their beginnings, punctuation aside, and each text's number of words. Bucket 0 pads."""
    hashes, counts = word_hashes([x.lower().translate(_CLEAN) for x in texts], PREFIXES)
    hashes = hashes + np.arange(PARTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (hashes % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int32), counts


@dataclass
class Model:
    embeddings: np.ndarray
    filters: list[np.ndarray]
    biases: np.ndarray
    out: np.ndarray
    shift: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def _padded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with every text padded by the widest filter, so that an empty text has a window too; each text's start;
        and the places behind a text's first window of padding, whose windows reach into the next text and do not count."""
        pad = max(WIDTHS)
        starts = np.cumsum(counts + pad) - (counts + pad)
        padded = np.zeros((int((counts + pad).sum()) + pad, PARTS), np.int32)
        padded[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
        return padded, starts, ((starts + counts)[:, None] + np.arange(1, pad)).ravel()

    def pooled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's largest activations, where they are, and the padded words; for a batch of training."""
        padded, starts, beyond = self._padded(ids, counts)
        x = sum(self.embeddings[padded[:, i]] for i in range(PARTS))
        n = len(padded) - max(WIDTHS)
        owner = np.repeat(np.arange(len(counts)), counts + max(WIDTHS))
        tops, places = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            act = sum(x[j : j + n] @ f[j] for j in range(w))
            act[beyond] = -np.inf
            top = np.maximum.reduceat(act, starts)
            hit = act == top[owner]
            place = np.empty(top.shape, np.int64)
            for c in range(FILTERS):
                at = np.flatnonzero(hit[:, c])[::-1]
                place[owner[at], c] = at
            places.append(place)
            tops.append(top)
        return np.concatenate(tops, axis=1) + self.biases, np.concatenate(places, axis=1), padded

    def tops(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each text's largest activations, from slices of windows, so that a long text takes the memory of one slice
        beside 12 bytes for each word."""
        padded, starts, beyond = self._padded(ids, counts)
        n = len(padded) - max(WIDTHS)
        out = np.full((len(counts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for a in range(0, n, SLICE):
            b = min(n, a + SLICE)
            x = sum(self.embeddings[padded[a : b + max(WIDTHS), i]] for i in range(PARTS))
            first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            cuts = np.maximum(starts[first:last], a) - a
            out_of = beyond[np.searchsorted(beyond, a) : np.searchsorted(beyond, b)] - a
            for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                act = sum(x[j : j + b - a] @ f[j] for j in range(w))
                act[out_of] = -np.inf
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                out[first:last, cols] = np.maximum(out[first:last, cols], np.maximum.reduceat(act, cuts))
        return out + self.biases

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.maximum(self.tops(ids, counts), 0) @ self.out[:-1] + self.out[-1]

    def scores(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        a, b = self.shift
        return 1 / (1 + np.exp(-np.clip(a * self.logits(ids, counts) + b, -30, 30)))


def _new(rng: np.random.Generator) -> Model:
    n = FILTERS * len(WIDTHS)
    emb = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    emb[0] = 0
    filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(emb, filters, np.zeros(n, np.float32), np.append(rng.normal(0, 0.3, n), 0).astype(np.float32))


def _batch(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(docs) if docs else np.zeros((0, PARTS), np.int32), np.array([len(d) for d in docs])


def train(docs: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Model:
    """Adagrad on the log loss; gradients reach only the windows that the pooling has chosen."""
    m = _new(rng)
    cache = [np.full_like(x, 1e-3) for x in (m.embeddings, *m.filters, m.biases, m.out)]

    def step(i: int, param: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        cache[i][rows] += grad**2
        param[rows] -= RATE * 5 * grad / np.sqrt(cache[i][rows])

    epochs = min(60, max(EPOCHS, EPOCHS * 1500 // max(1, len(docs))))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            ids, counts = _batch([docs[i] for i in own])
            top, places, padded = m.pooled(ids, counts)
            keep = (rng.random(top.shape) > DROP) / (1 - DROP)
            hidden = np.maximum(top, 0) * keep
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.out[:-1] + m.out[-1], -30, 30)))
            err = ((p - labels[own]) / len(own)).astype(np.float32)
            d_top = (err[:, None] * m.out[:-1] * keep * (top > 0)).astype(np.float32)
            d_out = np.append(hidden.T @ err, err.sum()).astype(np.float32)
            d_filters = [np.zeros_like(f) for f in m.filters]
            touched, grads = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(w):
                    word = padded[places[:, cols] + j]
                    x = m.embeddings[word].sum(axis=2)
                    d_filters[k][j] = np.einsum("bfs,bf->sf", x, d_top[:, cols])
                    grad = (d_top[:, cols, None] * m.filters[k][j].T[None]).reshape(-1, SIZE)
                    for i in range(PARTS):
                        touched.append(word[..., i].ravel())
                        grads.append(grad)
            rows, place = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(g, place, np.concatenate(grads))
            g[rows == 0] = 0
            step(0, m.embeddings, g, rows)
            for k, d in enumerate(d_filters):
                step(1 + k, m.filters[k], d)
            step(len(m.filters) + 1, m.biases, d_top.sum(axis=0))
            step(len(m.filters) + 2, m.out, d_out)
    return m


def _best_cut(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cut of least weighted error, in the middle of the best gap."""
    order = np.argsort(logits)
    x, y, w = logits[order], labels[order], weights[order]
    wrong = np.append(0, np.cumsum(np.where(y == 1, w, -w))) + w[y == 0].sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    cut = best[len(best) // 2]
    low = x[cut - 1] if cut else x[0] - 1
    high = x[cut] if cut < len(x) else x[-1] + 1
    return float((low + high) / 2)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches, "text"):
        ids, counts = words(texts)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([x.tobytes() for x in parts], pa.binary())], ["id", "label", "ids"])


def _marks(labels: DataFrame, training: Column, id_col: str, label_col: str) -> DataFrame:
    return labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Model:
    """A model of the labelled training rows. Languages serve the thresholds only. Of several labels of one id the largest
    counts; rows without an id or a label teach nothing. With one label or none, the score is that label's share."""
    marks = _marks(labels, training, id_col, label_col)
    have = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, SAMPLE_POSITIVE / max(1, have.get(1, 0)))).otherwise(min(1.0, SAMPLE_NEGATIVE / max(1, have.get(0, 0))))
    most = 2 * (SAMPLE_POSITIVE + SAMPLE_NEGATIVE)
    sample = marks.where(lot(F.lit("toxicity"), F.col(id_col)) < share).limit(most)  # a fixed bound: ids are distinct here
    rows = docs.select(id_col, as_binary(text_col).alias("text")).join(F.broadcast(sample), id_col)
    # A repeated row counts once, and rows that share an id do not fill the sample.
    rows = rows.select("text", F.col(id_col).cast("long").alias("id"), "label").dropDuplicates().limit(most)
    found = rows.mapInArrow(_hashed, "id long, label int, ids binary").toArrow().sort_by([("id", "ascending"), ("ids", "ascending")])
    rng = np.random.default_rng(7)
    y = found.column("label").to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        m = _new(rng)
        m.out[:] = 0
        m.out[-1] = 3.0 if len(y) and y[0] == 1 else -3.0
        return m
    ids = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, PARTS) for x in found.column("ids")]
    test = np.arange(len(ids)) % CALIBRATE == 0
    if len(set(y[test].tolist())) < 2:
        test[:] = False
    m = train([d for d, t in zip(ids, test, strict=True) if not t], y[~test], rng)
    held = np.flatnonzero(test) if test.any() else np.arange(len(ids))
    logits = np.concatenate([m.logits(*_batch([ids[i] for i in held[a : a + 64]])) for a in range(0, len(held), 64)])
    back = {1: max(1.0, have.get(1, 0) / SAMPLE_POSITIVE), 0: max(1.0, have.get(0, 0) / SAMPLE_NEGATIVE)}
    weights = np.array([back[int(v)] for v in y[held]])
    cut = _best_cut(logits, y[held], weights)
    m.shift = (1.0, -cut)
    return m


def calibrate(docs: DataFrame, labels: DataFrame, training: Column, model: Model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Model:
    """model with a threshold for each language: the score of least error over all labelled training rows of it. Documents
    are scored first, so only ids and scores meet the labels; they come back as counts by language, label and score."""
    named = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), text_col)
    scored = score(named, model, ("__id", "__lang"), text_col).select("__id", "__lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin"))
    marks = _marks(labels, training, id_col, label_col).withColumnRenamed(id_col, "__id")
    counts = scored.join(marks, "__id").groupBy("__lang", "bin").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") != 1).alias("good"))
    by_lang: dict[str, np.ndarray] = {}
    for lang, place, bad, good in counts.collect():  # BINS rows at most for each language
        by_lang.setdefault(lang, np.zeros((2, BINS)))[:, place] = bad, good
    for lang, (bad, good) in by_lang.items():
        if min(bad.sum(), good.sum()) < LEAST:
            continue
        # Wrong at threshold t / BINS: toxic rows below it and clean ones from it on; of equals, the middle one.
        wrong = np.append(0, np.cumsum(bad)) + good.sum() - np.append(0, np.cumsum(good))
        best = np.flatnonzero(wrong == wrong.min())
        model.thresholds[lang] = float(best[len(best) // 2] / BINS)
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model, size: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches, "__text", 1 << 19):
        scores = model.scores(*words(texts)).astype(np.float64)
        keep = batch.schema.names[:size]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(size)), pa.array(scores)], [*keep, "score"])


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """One row per row of docs: the carried columns, score (0 to 1; 0.5 separates best over all languages), predicted
    (score >= 0.5) and, with lang_col, flagged (score at least the language's own threshold).

    Whole texts count; a null text is an empty one and gets the score of no words. The language is no input of the
    score; an unknown one has threshold 0.5. Null ids and repeated rows are scored like others. An empty table gives no rows.
    Of a carried column with the name of a result, the result stays."""
    own = carried(docs, carry, ("score", "predicted", "flagged"))
    own += [lang_col] if lang_col and lang_col not in own else []
    rows = docs.select(*own, F.col(text_col).cast("binary").alias("__text"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "__text"), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    out = rows.mapInArrow(lambda it: _scored(it, shared.value, len(own)), schema)
    out = out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    if lang_col:
        limit = F.lit(0.5)
        for lang, x in model.thresholds.items():
            limit = F.when(F.col(lang_col) == lang, x).otherwise(limit)
        out = out.withColumn("flagged", F.col("score") >= limit)
    return out
