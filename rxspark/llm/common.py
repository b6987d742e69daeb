"""Helpers shared by the text operators: table access, scratch tables, and byte-level views of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxspark.session import work_path

SLICE_BYTES = 1 << 20  # text handled at once inside a task
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
SEPARATORS = ~np.array([c >= 128 or chr(c).isalnum() for c in range(256)])  # bytes outside words of letters and digits
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows a record batch from here on: rows of whole texts are large, and a batch stands in memory several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: a cut in the lineage that outlives executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of about SLICE_BYTES of text each (one long text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) + 16 * np.arange(len(sizes))) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each row begins (one more entry: the end); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` 64-bit constants that depend on ``seed`` alone."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    with np.errstate(over="ignore"):
        return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class RollingHash:
    """64-bit hashes of any stretches of a byte array: random value per byte, polynomial in the place, prefix sums."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        size = 1 << max(16, int(len(data)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(seeded(seed, 256)[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all_of(self, length: int) -> np.ndarray:
        """Hashes of every stretch of ``length`` bytes."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def words_of(data: np.ndarray, begin: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes outside ``white``), and the row it stands in."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~white[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = begin[:-1][begin[:-1] < len(data)]
    first[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    stop = begin[1:][begin[1:] > 0] - 1
    last[stop] = solid[stop]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(begin, start, "right") - 1


def word_hashes(column: pa.Array, seed: int = 0, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word with A-Z lower-cased, and the row it stands in."""
    data, begin = text_bytes(column)
    start, end, row = words_of(data, begin, white)
    if not len(start):
        return np.zeros(0, np.uint64), row
    return mix(RollingHash(LOWER[data], seed)(start, end)), row


def span_of_rows(row: np.ndarray, rows: int) -> np.ndarray:
    """Where the entries of each row begin in a sorted row index (one more entry: the end)."""
    return np.searchsorted(row, np.arange(rows + 1))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


FILTER_HASHES = 4  # bits set for each value


def filter_places(values: np.ndarray, size: int, which: int) -> np.ndarray:
    return (mix(values.view(np.uint64) + np.uint64(which)) & np.uint64(size - 1)).astype(np.int64)


def bit_filter(values: DataFrame) -> np.ndarray:
    """A filter over the only column (long) of ``values``: passes each of them, and of others the fewer the larger it is.

    It has 16 bits a value, but 2^20 at least and 2^28 (32 MB) at most, so it can be sent to every task.
    """
    size = 1 << min(28, max(20, (16 * values.count()).bit_length()))
    schema = pa.schema([("word", pa.int32()), ("bits", pa.int64())])

    def rows(batches):
        for part in batches:
            keys = part.column(0).to_numpy()
            at = np.unique(np.concatenate([filter_places(keys, size, i) for i in range(FILTER_HASHES)]))
            if len(at):
                word, first = np.unique(at >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield batch(schema, word.astype(np.int32), bits.view(np.int64))

    words = values.mapInArrow(rows, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(size // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values that a bit filter lets pass."""
    live = np.arange(len(values))
    for i in range(FILTER_HASHES):
        at = filter_places(values[live], len(table) * 64, i)
        live = live[(table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return live
