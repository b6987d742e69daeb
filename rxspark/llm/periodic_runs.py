"""Periodic runs of words: suffix trees, constant-time common extensions, candidates from Lyndon roots.

A run is a stretch of words with smallest period q that no neighbour extends; it counts if it is at least
max(``least``, ``exponent`` * q) words long. For a text:

1. Every run has a Lyndon root, and each root is the longest Lyndon word at its place in one of the two orders of the words: it
   reaches to the next smaller suffix, or (other order) to the next larger one. That makes two candidates (i, j) for a place.
2. A candidate of period p = j - i extends to the right by the common prefix of the suffixes i and j, and to the left by the
   common suffix of what stands before them, a common prefix in the reversed text. Both come from suffix trees (Ukkonen) by
   lowest common ancestors on the Euler tour (``suffix_tree``).
3. Stretches of two periods or more are runs, each with its smallest period, since Lyndon words have no shorter one.

Trees are built only where runs can be. In a run that counts, a string of m words begins at least twice, where m is the
least of max(least, exponent * q) - 2q + 1 over all q. Words that no such string covers belong to no run; they cut the text
into parts, to which the same test applies again. A run lies in one part and extends there as in the whole text.

Texts are judged one by one in their task, without a shuffle. Memory follows the largest text, and the longest part of it that
may hold runs (some 600 bytes a word there).

Defined cases: null, empty and blank texts have no words and no runs. Repeated rows are answered each time; the id plays no
part. Runs may overlap; each is listed. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C
from rxspark.llm.suffix_tree import SuffixTree

LEAST = 6
EXPONENT = 4
_MULTIPLY = np.uint64(0x9FB21C651E98DF25)


def window(least: int = LEAST, exponent: int = EXPONENT) -> int:
    """The longest string length of which every run holds one string twice, at each place."""
    return min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2))


def _may_repeat(words: np.ndarray, least: int, size: int) -> Iterator[tuple[int, int]]:
    """Parts ``(start, end)`` of at least ``least`` words in which every word is covered by a string of ``size`` words found twice."""
    todo = [(0, len(words))]
    while todo:
        start, end = todo.pop()
        if end - start < least:
            continue
        part = words[start:end]
        strings = part[: len(part) - size + 1].copy()
        with np.errstate(over="ignore"):
            for k in range(1, size):
                strings = C.mix(strings * _MULTIPLY + part[k : len(part) - size + 1 + k])
        order = np.argsort(strings, kind="stable")
        same = strings[order[1:]] == strings[order[:-1]]
        if not same.any():
            continue
        again = np.zeros(len(strings) + 1, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        edge = np.zeros(len(part) + 1, np.int64)
        at = np.flatnonzero(again)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        if covered.all():
            yield start, end
            continue
        step = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
        todo += [(start + a, start + b) for a, b in zip(step[::2].tolist(), step[1::2].tolist(), strict=True)]


def _next_lower(values: list[int]) -> np.ndarray:
    """For every place, the next one with a lower value (or the number of places)."""
    n = len(values)
    out = [n] * n
    open_: list[int] = []
    for i, value in enumerate(values):
        while open_ and values[open_[-1]] > value:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def all_runs(words: list[int]) -> np.ndarray:
    """``(start, length, period)`` of every run of two periods or more, by start and period; words are numbers of at least 1."""
    n = len(words)
    ahead, back = SuffixTree(words), SuffixTree(words[::-1])
    rank = ahead.rank[:n]
    found = []
    for order in (rank, -rank):
        i = np.arange(n)
        j = _next_lower(order.tolist())
        i, j = i[j < n], j[j < n]
        right = ahead.common(i, j)
        # suffix n - i of the reversed text begins with the word before i
        left = back.common(n - i, n - j)
        start, end, period = i - left, j + right, j - i
        runs = end - start >= 2 * period
        found.append(np.stack([start[runs], (end - start)[runs], period[runs]], 1))
    return np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def runs_of(words: list, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """``(start, length, period)`` of the runs of at least max(least, exponent * period) words, by start and period."""
    if len(words) < least:
        return np.zeros((0, 3), np.int64)
    known: dict = {}
    numbers = np.array([known.setdefault(w, len(known) + 1) for w in words], np.uint64)
    found = [np.zeros((0, 3), np.int64)]
    if len(known) < len(words):
        for start, end in _may_repeat(numbers, least, window(least, exponent)):
            _, part = np.unique(numbers[start:end], return_inverse=True)
            runs = all_runs((part + 1).tolist())
            runs = runs[runs[:, 1] >= np.maximum(least, exponent * runs[:, 2])]
            found.append(runs + np.array([start, 0, 0]))
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _scan(least: int, exponent: int):
    piece = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches):
            found, texts, counts = [], [], []
            for text in part.column("text"):
                words = (text.as_py() or "").encode().split()  # at space, tab, line feed, vertical tab, form feed, carriage return
                runs = runs_of(words, least, exponent)
                counts.append(len(words))
                found.append(runs)
                texts.append(collapse(words, runs).decode())
            flat = np.concatenate(found)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], [f.name for f in piece])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()), parts)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.string())],
                names=["row", "n_words", "runs", "collapsed"],
            )

    return run


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns; all by default) with ``n_words``, ``runs`` (start, length and period, by start and
    period) and ``collapsed``, the text without the repeated periods."""
    if exponent < 2 or least < 1:
        raise ValueError("a run has two periods at least, and one word")
    own = ["n_words", "runs", "collapsed"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col(text).alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    ddl = f"row {row}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return packed.mapInArrow(_scan(least, exponent), ddl).select(*(F.col("row").getField(c).alias(c) for c in keep), *own)
