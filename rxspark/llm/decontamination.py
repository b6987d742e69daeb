"""Passages of benchmark items in documents, found by spaced-seed hashing and confirmed with substitutions allowed.

Words are runs of letters and digits, lower-cased. A mask is laid over every place of a text; the words under its ones
are hashed together, so the words under its zeros may differ. Equal hashes of an item and a document give a diagonal
(place in the document minus place in the item); along it, words are compared one to one in the whole stretch around
the hits. A pair is reported if some WINDOW words in a row (the whole item if it is shorter) agree in at least SHARE;
words of the item before the begin of the document or after its end agree with nothing.

The masks leave nothing out: wherever the words that may differ stand in a window (or a short item), some mask lies in it
with none of them under its ones. Each length has a family of its own, the heaviest masks of which FAMILY are enough.

Tests of documents against items are equi-joins on the hash. Documents first drop hashes that no item can have, by a
bit filter of the items' hashes whose size is fixed between 2^20 and 2^28 bits. What is left goes as *regions*: the
hits and the hashed words REACH around them, so a join row is small and no text is shuffled.

Defined cases: null or empty texts match nothing; items of fewer than SHORTEST words are not searched. Rows without an id are not searched and always kept; rows that repeat an
id are dropped together. Items that repeat are reported once per item id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C

SHORTEST = 5
WINDOW = 16
SHARE = 0.75
REACH = 32
FAMILY = 6  # masks of one length
HEAVIEST = 8
SPAN = 16
PLACEMENTS = 2000


@lru_cache(maxsize=256)
def _family(length: int, differ: int) -> tuple[str, ...]:
    """Masks of which one fits between any ``differ`` words of ``length``, chosen greedily: few and heavy."""
    if math.comb(length, differ) <= PLACEMENTS:
        zeros = np.array([sum(1 << i for i in c) for c in combinations(range(length), differ)], np.int64)
        for weight in range(min(HEAVIEST, length - differ), 1, -1):
            masks = [
                sum(1 << i for i in (0, *inner, span - 1))
                for span in range(weight, min(SPAN, length) + 1)
                for inner in combinations(range(1, span - 1), weight - 2)
            ]
            free = np.array([np.any([zeros & m << i == 0 for i in range(length - m.bit_length() + 1)], axis=0) for m in masks])
            left, chosen = np.ones(len(zeros), bool), []
            while left.any() and len(chosen) < FAMILY:
                best = int(free[:, left].sum(axis=1).argmax())
                chosen.append(f"{masks[best]:b}")
                left &= ~free[best]
            if not left.any():
                return tuple(chosen)
    return ("1" * min(HEAVIEST, -(-(length - differ) // (differ + 1))),)  # the longest run of equal words has so many


def _families(lengths: list[int], share: float) -> dict[int, tuple[str, ...]]:
    """Masks for items of each length."""
    return {n: _family(n, n - math.ceil(n * share)) for n in sorted(lengths)}


def _seeds(words: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash at every place where the mask fits into one row, and these places."""
    span, n = len(mask), len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.flatnonzero(row[span - 1 :] == row[:n])
    factors = C.seeded(41 + span, span) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total += words[j : j + n] * factors[j]
    return C.mix(total[place] + np.uint64(int(mask + "1", 2))), place


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in C.slices(batches):
        words, row = C.word_hashes(part.column("text"), 7, C.SEPARATORS)
        at = C.span_of_rows(row, part.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(words.view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["item", "words"])


def _item_seeds(families: dict[int, tuple[str, ...]], window: int):
    schema = pa.schema([("item", pa.int64()), ("hash", pa.int64()), ("place", pa.int32())])

    def run(batches):
        for part in batches:
            lists = part.column("words")
            words = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            at = C.span_of_rows(row, part.num_rows)
            size = np.minimum(np.diff(at), window)
            ids = part.column("item").to_numpy()
            for mask in sorted({m for family in families.values() for m in family}):
                hashes, place = _seeds(words, row, mask)
                own = np.isin(size[row[place]], [n for n, family in families.items() if mask in family])
                hashes, place = hashes[own], place[own]
                if len(place):
                    r = row[place]
                    yield C.batch(schema, ids[r], hashes.view(np.int64), (place - at[r]).astype(np.int32))

    return run


def _regions(shared, masks: list[str], reach: int):
    hit = pa.struct([("hash", pa.int64()), ("at", pa.int32())])
    schema = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("hits", pa.list_(hit)), ("words", pa.list_(pa.int64()))])

    def run(batches):
        table = shared.value
        if not masks:  # no item is long enough
            return
        for part in C.slices(batches):
            words, row = C.word_hashes(part.column("text"), 7, C.SEPARATORS)
            places, found, spans = [], [], []
            for mask in masks:
                hashes, place = _seeds(words, row, mask)
                live = C.passes(table, hashes)
                hashes, place = hashes[live], place[live]
                places.append(place)
                found.append(hashes)
                spans.append(np.full(len(place), len(mask)))
            place, hashes, span = np.concatenate(places), np.concatenate(found), np.concatenate(spans)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, hashes, span = place[order], hashes[order], span[order]
            at = C.span_of_rows(row, part.num_rows)
            r = row[place]
            a, b = np.maximum(place - reach, at[r]), np.minimum(place + span + reach, at[r + 1])
            far = np.maximum.accumulate(b)
            new = np.r_[True, (a[1:] > far[:-1]) | (r[1:] != r[:-1])]
            first = np.flatnonzero(new)
            low, high = a[first], np.maximum.reduceat(b, first)
            region = np.cumsum(new) - 1
            hits = pa.StructArray.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array((place - low[region]).astype(np.int32))], ["hash", "at"]
            )
            inside = np.concatenate([words[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]).view(np.int64)
            ids = part.column("id").to_numpy()
            yield C.batch(
                schema, ids[r[first]], (low - at[r[first]]).astype(np.int32),
                pa.ListArray.from_arrays(pa.array(np.r_[first, len(place)], pa.int32()), hits),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(high - low)], pa.int32()), pa.array(inside)),
            )

    return run


def overlaps(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: float = SHARE,
) -> DataFrame:
    """``(id, item, n_matched, n_window, first_word, n_item_words)``: each document and item that overlap, once.

    ``n_matched`` of the best ``n_window`` words in a row agree; these begin at word ``first_word`` of the document.
    """
    spark = docs.sparkSession
    sides = items.select(F.col(item_id).cast("long").alias("id"), F.lower(item_text).alias("text")).filter("id IS NOT NULL")
    words = C.stored(sides.mapInArrow(_items, "item long, words array<long>").filter(F.size("words") >= SHORTEST), "items")
    lengths = [r[0] for r in words.select(F.least(F.size("words"), F.lit(window))).distinct().collect()]  # window - SHORTEST + 1 at most
    families = _families(lengths, share)
    masks = sorted({m for family in families.values() for m in family})
    seeds = C.stored(words.mapInArrow(_item_seeds(families, window), "item long, hash long, place int").distinct(), "item-seeds")
    table = C.bit_filter(seeds.select("hash"))
    shared = spark.sparkContext.broadcast(table)  # 32 MB at most
    texts = docs.select(F.col(id).cast("long").alias("id"), F.lower(text).alias("text")).filter("id IS NOT NULL")
    regions = C.stored(
        texts.mapInArrow(_regions(shared, masks, max(REACH, window)), "id long, start int, hits array<struct<hash:long,at:int>>, words array<long>"), "regions"
    )
    diagonals = (
        regions.select("id", "start", F.explode("hits").alias("hit"))
        .select("id", "start", "hit.hash", "hit.at")
        .join(seeds, "hash")
        .select("id", "start", "item", (F.col("at") - F.col("place")).alias("shift"))
        .distinct()
    )
    both = (
        diagonals.join(regions.select("id", "start", F.col("words").alias("here")).dropDuplicates(), ["id", "start"])
        .join(words, "item")
        .withColumn("width", F.least(F.size("words"), F.lit(window)))
        .withColumn("skip", F.greatest(F.lit(0), -F.col("shift")))  # words of the item before the region
        .withColumn("from", F.greatest(F.lit(0), "shift"))
        .withColumn("n", F.least(F.size("words") - F.col("skip"), F.size("here") - F.col("from")))
        .filter("n > 0")
        .withColumn("before", F.least("skip", "width"))
        .withColumn("after", F.least(F.size("words") - F.col("skip") - F.col("n"), F.col("width")))
        .withColumn(
            "same",
            F.concat(
                F.expr("array_repeat(0, before)"),
                F.zip_with(F.expr("slice(words, skip + 1, n)"), F.expr("slice(here, from + 1, n)"), lambda x, y: (x == y).cast("int")),
                F.expr("array_repeat(0, after)"),
            ),
        )
    )
    sums = F.transform(
        F.sequence(F.lit(0), F.size("same") - F.col("width")),
        lambda i: F.struct(
            F.aggregate(F.slice("same", i + 1, F.col("width")), F.lit(0), lambda a, x: a + x).alias("n_matched"), (-i).alias("i")
        ),
    )
    best = both.withColumn("best", F.array_max(sums)).filter(F.col("best.n_matched") >= F.ceil(F.col("width") * F.lit(share)))
    return (
        best.select(
            "id", "item", F.col("best.n_matched").alias("n_matched"), F.col("width").alias("n_window"),
            F.greatest(F.lit(0), F.col("start") + F.col("from") - F.col("before") - F.col("best.i")).alias("first_word"), F.size("words").alias("n_item_words"),
        )
        .groupBy("id", "item")
        .agg(F.max(F.struct("n_matched", (-F.col("first_word")).alias("first"), "n_window", "n_item_words")).alias("b"))
        .select("id", "item", "b.n_matched", "b.n_window", (-F.col("b.first")).alias("first_word"), "b.n_item_words")
    )


def decontaminate(docs: DataFrame, items: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that overlap with an item."""
    found = overlaps(docs, items, id, **options).select(F.col("id").alias("_overlapping")).distinct()
    return docs.join(found, docs[id].cast("long") == F.col("_overlapping"), "left_anti")
