"""Helpers shared by the corpus operators: shared storage, Arrow text access
and vectorised word hashing."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.runtime import shared_dir

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

#: Bytes, or words, of which prefix sums are held at once.
SEGMENT = 1 << 20


#: Folders of the tables made so far, in order; None for those dropped.
_tables: list[str | None] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not what
    came before, and no later reader computes ``df`` again.  A table stays until
    the driver ends or :func:`drop_tables` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wavegrid/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    """Number of tables made so far."""
    return len(_tables)


def drop_tables(spark: SparkSession, first: int, last: int) -> None:
    """Drops the tables from the ``first`` made to before the ``last``; nothing that
    is still to be computed may read them."""
    for i in range(first, last):
        if path := _tables[i]:
            _remove(spark, path)
            _tables[i] = None


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already
        pass


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that a text operator reads, so that no other
    column is scanned or can clash with an output's name."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id: 0 for null, else a hash of the text."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def bucket_of(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(modulus)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, without a copy where
    Arrow allows; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        _powers[name] = have
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice ``data[start:end]``; equal bytes give equal
    hashes wherever they stand.  A prefix sum of ``byte * BASE**i`` makes each
    slice two look-ups.  Slices are sorted; they are hashed some ``SEGMENT``
    bytes at a time."""
    if len(data) > SEGMENT and len(starts) > 1:
        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            low = int(starts[at])
            end = max(at + 1, int(np.searchsorted(ends, low + SEGMENT, side="right")))
            out[at:end] = _slice_hashes(data[low : int(ends[end - 1])], starts[at:end] - low, ends[at:end] - low)
            at = end
        return out
    return _slice_hashes(data, starts, ends)


def _slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data) + 1
    up, down = _power(BASE, n, "up"), _power(BASE_INV, n, "down")
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values of ``h``."""
    out = np.empty(max(0, len(h) - size + 1), np.uint64)
    for at in range(0, len(out), SEGMENT):
        part = h[at : at + SEGMENT + size - 1]
        n = len(part)
        up, down = _power(BASE, n, "up"), _power(BASE_INV, n, "down")
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up, dtype=np.uint64)])
        out[at : at + n - size + 1] = mix((sums[size:] - sums[:-size]) * down[: n - size + 1])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``start .. start + length``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def portions(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges (begin, end) of about ``size`` bytes each, one row at least."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end
        at = end
