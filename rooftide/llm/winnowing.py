"""Document fingerprints by winnowing: rolling k-gram hashes, each window's rightmost minimum, positions kept.

Any text of K + WINDOW - 1 code points that two documents share gives them a common fingerprint hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, mix

#: Code points of a gram and grams of a window (powers of two).
K, WINDOW = 16, 16
#: Ranges of ids hold about so many documents, and there are at most so many ranges; rows are streamed, so a range
#: may be of any size.
RANGE_ROWS, RANGES = 2000, 20_000
#: Longer texts are taken in overlapping spans of so many grams, as a place has 24 bits beside its hash.
SPAN = 1 << 24
_BASE = 0x9E3779B97F4A7C15

Prints = tuple[np.ndarray, np.ndarray]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def winnow(points: np.ndarray) -> Prints:
    """Hashes and positions (code points) of the chosen grams, by position. A text shorter than a gram is one gram; one
    with fewer grams than a window is one window; an empty text has none."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = mix(points.astype(np.uint64) + np.uint64(1))
    if len(points) < K:
        return mix(np.array([(h * np.array([pow(_BASE, i, 2**64) for i in range(len(h))], np.uint64)).sum(dtype=np.uint64) + np.uint64(len(h))])) >> np.uint64(24), np.zeros(1, np.int64)
    step, power = 1, _BASE
    while step < K:
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = step * 2, power * power % 2**64
    low = np.uint64(SPAN - 1)
    hashes, places = [], []
    # Every window lies in one span.
    for start in range(0, max(1, len(h) - WINDOW + 1), SPAN - WINDOW + 1):
        part = h[start : start + SPAN]
        # The place counts down in the low bits: among equal hashes the rightmost is the smallest.
        v = (mix(part) & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        if len(v) < WINDOW:
            m = v.min(keepdims=True)
        else:
            m, step = v, 1
            while step < WINDOW:
                m = np.minimum(m[:-step], m[step:])
                step *= 2
            m = m[np.append(True, m[1:] != m[:-1])]
        hashes.append(m >> np.uint64(24))
        places.append((low - (m & low)).astype(np.int64) + start)
    m, at = np.concatenate(hashes), np.concatenate(places)
    new = np.append(True, at[1:] != at[:-1])
    return m[new], at[new]


def _hashes(prints: Prints) -> np.ndarray:
    return np.unique(prints[0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted distinct hash arrays; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return both / (len(a) + len(b) - both)


def digest(prints: Prints) -> str:
    return hashlib.md5(prints[0].tobytes() + prints[1].tobytes(), usedforsecurity=False).hexdigest()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, hashes and positions (arrays) of its whole text. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(code_points((x or b"").decode("utf-8", "replace"))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0].view(np.int64) for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["id", "hashes", "positions"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary"))
    return narrow.mapInArrow(run, "id long, hashes array<long>, positions array<long>").withColumnRenamed("id", id_col)


def _dealt(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row with its range; the rows of a range's largest id once more, after the next range's rows."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, ids)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), np.int8)), *batch.columns], ["part", "next", "id", "text"])
        if (top := np.flatnonzero(bounds[at] == ids)).size:
            own = batch.take(pa.array(top))
            yield pa.RecordBatch.from_arrays([pa.array((at[top] + 1) % len(bounds)), pa.array(np.ones(len(top), np.int8)), *own.columns], ["part", "next", "id", "text"])


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in _NAMES]
    last = None
    for batch in batches:
        for part, is_next, i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last and last[0] != part:
                last = None
            if is_next and not last:
                continue  # ties with the first of the next range
            text = raw.decode("utf-8", "replace")
            prints = winnow(code_points(text))
            now = (part, i, text, prints, _hashes(prints))
            if last:
                half = len(last[2]) // 2
                edited = last[2][: len(last[2]) - half] + text[:half]
                other = winnow(code_points(edited))
                for column, x in zip(out, (last[1], len(last[2]), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), digest(last[3]), digest(other), likeness(last[4], _hashes(other)), likeness(last[4], now[4])), strict=True):
                    column.append(x)
            last = None if is_next else now
        if len(out[0]) > 2000:
            yield _rows(out)
            out = [[] for _ in _NAMES]
    yield _rows(out)


def _rows(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], _NAMES)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_chars, edited_sha256, fingerprint and edited_fingerprint (digests of hashes and
    positions), near_edited, near_next.

    The next document is the one before by id (after the smallest: the largest; after equal ids, by text); the edited
    text has its start in place of the own second half. Ranges of ids, cut at ids that exist, are sorted and streamed;
    the only rows that are needed in two ranges are those of their largest ids. A null text is empty; a null id counts as the largest;
    repeated rows follow each other; a lone row follows itself; an empty table gives no rows."""
    narrow = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    n, top = narrow.agg(F.count("*"), F.max("id")).first()
    if n:
        ranges = min(RANGES, max(1, -(-n // RANGE_ROWS)))
        cuts = [i / ranges for i in range(1, ranges)]
        inner = narrow.agg(F.percentile_approx("id", cuts, 100_000)).first()[0] if cuts else []
        bounds = np.unique(np.array([*inner, top], np.int64))
    else:
        bounds = np.array([NO_ID])
    shared = docs.sparkSession.sparkContext.broadcast(bounds)  # RANGES numbers at most
    dealt = narrow.mapInArrow(lambda it: _dealt(it, shared.value), "part long, next byte, id long, text binary")
    tasks = max(len(bounds), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = dealt.repartition(tasks, "part").sortWithinPartitions("part", "next", F.desc("id"), "text")
    out = ordered.mapInArrow(_compared, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
