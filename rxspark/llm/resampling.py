"""Importance resampling towards a target distribution, from hashed n-grams counted once per distinct line.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; features are single words and pairs of neighbours
(joined by one space), each hashed to one of BUCKETS by crc32. A bucket's gain is 1000 ln(target share / corpus share),
smoothed by one and rounded down; a document's weight is the mean gain of its features, rounded down. Weights with Gumbel noise
from a hash of the id are scores: the highest ``percent`` of the long enough documents are a draw without replacement.

Counting, by segments: a line feed is never part of a word, so it cuts a text into lines. Equal lines of all documents become
one row with its number of occurrences (combined in the map tasks before the shuffle); its features are computed once and
multiplied. The pairs that this leaves out, the last word of a line with the first word of the next line that has one, are
counted in a second pass over the texts. Both passes end in sums per bucket: BUCKETS rows a task at most.

The gains (BUCKETS numbers, whatever the input) go to the tasks, which score whole texts without a shuffle; only narrow rows
(id and numbers) are sorted for the draw.

Defined cases: null texts and texts without a word have no features and weight 0. Without a target text all buckets count as
unseen there. Rows without an id are counted but cannot be drawn (no score, no rank). Repeated rows count each time and rank one after the
other. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C
from rxspark.operators.scale import dense_ids

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
_SHORT = 64  # bytes; longer words are hashed one by one
_POLYNOMIAL = 0xEDB88320  # fixed: crc32, bits reversed
_ALL = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


@lru_cache(maxsize=_SHORT + 1)
def _moved(length: int) -> np.ndarray:
    """Four tables of 256: what each byte of a checksum turns into when ``length`` zero bytes follow."""
    table = _byte_table()
    value = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(length):
        value = table[value & 255] ^ (value >> 8)
    return value


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of bytes."""
    out = np.zeros(len(start), np.uint32)
    size = end - start
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= _SHORT]
    table, value, at = _byte_table(), np.full(len(order), _ALL, np.uint32), start[order]
    live = len(order)
    sizes = size[order]
    for k in range(int(sizes[0]) if live else 0):
        live = int(np.searchsorted(-sizes, -k, "left"))  # those longer than k come first
        value[:live] = table[(value[:live] ^ data[at[:live] + k]) & 255] ^ (value[:live] >> 8)
    out[order] = value ^ _ALL
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def _joined(left: np.ndarray, right: np.ndarray, size: np.ndarray, data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """crc32 of a word with checksum ``left``, one space, and a word of ``size`` bytes with checksum ``right``."""
    raw = left ^ _ALL
    spaced = (_byte_table()[(raw ^ np.uint32(32)) & 255] ^ (raw >> 8)) ^ _ALL
    out = np.zeros(len(left), np.uint32)
    order = np.argsort(size, kind="stable")
    cuts = np.searchsorted(size[order], np.arange(_SHORT + 2))
    for length in np.unique(size[size <= _SHORT]).tolist():
        some = order[cuts[length] : cuts[length + 1]]
        table, x = _moved(length), spaced[some]
        out[some] = table[0, x & 255] ^ table[1, (x >> 8) & 255] ^ table[2, (x >> 16) & 255] ^ table[3, x >> 24] ^ right[some]
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]], int(spaced[i]))
    return out


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word its row and bucket; of every pair of neighbours its row and bucket, and whether a line feed stands between."""
    data, begin = C.text_bytes(column)
    data = C.LOWER[data]
    start, end, row = C.words_of(data, begin, C.SEPARATORS)
    words = checksums(data, start, end)
    first = np.flatnonzero(row[1:] == row[:-1])
    pairs = _joined(words[first], words[first + 1], (end - start)[first + 1], data, start[first + 1])
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    cross = line[first + 1] != line[first]
    return row, words % np.uint32(buckets), row[first], pairs % np.uint32(buckets), cross


def _sums(buckets: int, lines: bool):
    """Feature counts of a task's rows: of lines ``text, n`` n times each, else only the pairs that cross lines of ``text``."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in C.slices(batches):
            row, words, pair_row, pairs, cross = features(part.column("text"), buckets)
            if lines:
                n = part.column("n").to_numpy()
                np.add.at(total, words, n[row])
                np.add.at(total, pairs, n[pair_row])
            else:
                total += np.bincount(pairs[cross], minlength=buckets)
        some = np.flatnonzero(total)
        yield C.batch(schema, some.astype(np.int32), total[some])

    return run


def count(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: the features of all texts, by distinct lines and the pairs between lines."""
    whole = texts.select(F.col(text).alias("text")).filter("text IS NOT NULL")
    lines = (
        whole.select(F.explode(F.split("text", "\n")).alias("text"))
        .filter(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
        .groupBy("text")
        .agg(F.count("*").alias("n"))
    )
    inside = lines.mapInArrow(_sums(buckets, True), "bucket int, n long")
    between = whole.mapInArrow(_sums(buckets, False), "bucket int, n long")
    return inside.unionByName(between).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of every bucket, from counts of the corpus and the target."""
    both = (
        corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .fillna(0, ["s", "t"])
    )
    sums = C.stored(both, "feature-counts")
    all_s, all_t = (sums.agg((F.sum(c) + buckets).cast("double")).scalar() for c in ("s", "t"))
    ratio = (F.col("t") + 1) * all_s / ((F.col("s") + 1) * all_t)
    return sums.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def _weigh(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain: np.ndarray = shared.value
        for part in C.slices(batches):
            row, words, pair_row, pairs, _ = features(part.column("text"), len(gain))
            n_words, n_pairs = np.bincount(row, minlength=part.num_rows), np.bincount(pair_row, minlength=part.num_rows)
            total = np.zeros(part.num_rows, np.int64)
            np.add.at(total, row, gain[words])
            np.add.at(total, pair_row, gain[pairs])
            n = n_words + n_pairs
            out = [pa.array(x.astype(np.int64)) for x in (n_words, n, total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays([part.column("row"), *out], names=["row", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns; all by default) with ``n_words``, ``n_features`` and ``weight``."""
    own = ["n_words", "n_features", "weight"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    table = gain.orderBy("bucket").toPandas()["gain"].to_numpy(np.int64)  # one number a bucket
    shared = docs.sparkSession.sparkContext.broadcast(table)
    packed = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col(text).alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(_weigh(shared), f"row {row}, n_words long, n_features long, weight long")
    return done.select(*(F.col("row").getField(c).alias(c) for c in keep), *own)


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, times 1000, rounded down."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), id.cast("string")).cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, id: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``weighed`` with ``score`` and ``rank`` (1 for the highest score; null where not drawn)."""
    own = ["score", "rank"]
    rows = weighed.select(*(c for c in weighed.columns if c not in own)).withColumn("score", F.col("weight") + noise(F.col(id), seed))
    rows = C.stored(rows.withColumn("_seq_in", F.monotonically_increasing_id()), "weighed")
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    ranked = dense_ids(rows.filter(able), [F.desc("score"), F.col(id), F.col("n_features"), F.col("_seq_in")], "rank")
    drawn = rows.filter(able).agg(F.expr(f"({percent} * count(*)) div 100"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn.scalar(), F.col("rank")))
    return ranked.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))).drop("_seq_in")
