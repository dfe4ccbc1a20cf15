"""What the operators of this subpackage share: tables, the shared folder, streaming of groups, numpy text kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Null ids count as the largest id.
NO_ID = 2**63 - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without the setting, a temporary one, in local mode only."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rooftide-"))
    return spark.sparkContext.getCheckpointDir()


#: Tables that this process has written and not dropped.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, which survives lost executors. by: a column of folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*([by] if by else [])).parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialize() that nothing reads any more; what is not such a table is left alone."""
    for df in tables:
        if (path := getattr(df, "_table_path", None)) in _WRITTEN:
            _delete(df.sparkSession, path)


def drop_tables(spark: SparkSession) -> None:
    """Removes all tables that the operators of this process have written. Results are lazy and read these tables, so this
    is for the caller, once the results are written."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def held(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def ascii_lower(text: Column) -> Column:
    """Lowers A-Z only; lower() does the same, and much faster, where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts batches into runs of rows with about `limit` bytes of text (one row at least), texts as bytes, null as empty."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        at = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > limit:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(text)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it. Only for keys whose groups have a bounded size."""
    held_back: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held_back and keys[a] != last:
                yield pa.Table.from_batches(held_back)
                held_back = []
            held_back.append(batch.slice(a, b - a))
            last = keys[a]
    if held_back:
        yield pa.Table.from_batches(held_back)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def seeds(n: int, start: int) -> np.ndarray:
    """n odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)) | np.uint64(1)


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Texts are hashed in pieces of about so many bytes, cut at white space.
PIECE = 1 << 22


def _pieces(blob: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(blob):
        to = min(at + PIECE, len(blob))
        if to < len(blob):
            gaps = np.flatnonzero(_SPACE[blob[at:to]])
            while not gaps.size and to < len(blob):  # a word that is longer than a piece
                low, to = to, min(to + PIECE, len(blob))
                gaps = np.flatnonzero(_SPACE[blob[low:to]]) + (low - at)
            to = at + int(gaps[-1]) + 1 if gaps.size else to
        yield at, to
        at = to


def word_hashes(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and each text's number of words. With prefixes, a row for each
    word: its own hash, then those of its beginnings of so many bytes.

    A word's polynomial hash is a difference of prefix sums, shifted back to place 0. Long texts are hashed in pieces, so
    beside 8 bytes for each hash a text takes a few bytes for each of its own; only a single word of more than PIECE bytes
    takes about 50 for each."""
    blob = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    found, places = [], []
    for at, to in _pieces(blob):
        part = blob[at:to]
        edge = np.flatnonzero(np.diff(_SPACE[part], prepend=True))
        starts, ends = edge[::2], edge[1::2]
        if len(ends) < len(starts):
            ends = np.append(ends, len(part))
        n = len(part) + 1
        sums = np.zeros(n, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[: n - 1], out=sums[1:])
        shift, before = _powers(_BACK, n)[starts], sums[starts]
        each = [mix((sums[x] - before) * shift + (x - starts).astype(np.uint64)) for x in (ends, *(np.minimum(ends, starts + p) for p in prefixes))]
        found.append(np.stack(each, axis=1) if prefixes else each[0])
        places.append(starts + at)
    bounds = np.cumsum([len(x) + 1 for x in texts])
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(places), bounds), prepend=0)


def byte_pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes, cut behind white space."""
    if len(text) <= PIECE:
        yield text
        return
    blob = np.frombuffer(text, np.uint8)
    for at, to in _pieces(blob):
        yield text[at:to]


def lot(*columns: str | Column) -> Column:
    """A number from 0 to 1 drawn for each row by its values."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(1 << 30)


def as_binary(name: str) -> Column:
    return F.col(name).cast("binary").alias(name)


def carried(docs: DataFrame, carry: tuple[str, ...], results: tuple[str, ...]) -> list[str]:
    """The columns to carry, without those whose names the results take."""
    return [c for c in carry if c.lower() not in results]
