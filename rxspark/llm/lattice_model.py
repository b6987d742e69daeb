"""Language-model scores: the marginal likelihood of a text over all its segmentations into vocabulary pieces.

The pieces are those of an existing vocabulary; their probabilities begin as its scores say (these are ranks of merges,
so a piece of score -r begins in proportion to 1 / (r + 10)) and are re-estimated on the words of the training texts by
ROUNDS of expectation maximisation. A word is U+2581 followed by its characters. All ways to cut it into pieces form a
lattice; a forward recursion in logarithms sums their probabilities (piece by piece, independent). No piece reaches over
a word's end, so the probability of a text is the product over its words, times that of the end token. Characters that
no piece holds are spelled by byte pieces.

Beside it stands the base score: log10 of smoothed word shares, (c + 0.5) / (N + 0.5 (V + 1)).

Counting: tasks add up their words, then one aggregation by word gives the table (word, c), which grows with the corpus
and stays in Spark. Words with at least 1/FREQUENT of all tokens, hence at most FREQUENT of them, go to every task with
their count and likelihood. The rest, per text, meets the table in an equi-join, so every count is exact.

Defined cases: null and empty texts hold the end token alone. Without training texts N, V and all counts are 0 and the
pieces keep the vocabulary's own probabilities. Repeated rows count and are answered each time, rows without an id too.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C
from rxspark.llm.sentence_pieces import SPACE, Vocabulary

ROUNDS = 3
FREQUENT = 1 << 18
_HELD = 300_000  # words a task holds while it counts
_STEP = np.uint64(0x9E3779B97F4A7C15 | 5)
_TOGETHER = 50_000  # words of which expectations are taken at once
_CELLS = 200_000  # characters of words of one length looked at together


def _spelled(word: str) -> str:
    return SPACE + word


@dataclass
class Lattice:
    """Log-probabilities (natural) of pieces by id; ``end`` is the last entry."""

    vocabulary: Vocabulary
    logs: np.ndarray

    def ready(self) -> None:
        if hasattr(self, "_index"):
            return
        v = self.vocabulary
        normal = [i for i, k in enumerate(v.kinds) if k == "n"]
        self.longest = max(len(v.pieces[i]) for i in normal)
        hashes = []
        for i in normal:
            h = 0
            for c in v.pieces[i]:
                h = (h * int(_STEP) + ord(c) + 1) & (1 << 64) - 1
            hashes.append(h)
        self._index = pd.Index(np.array(hashes, np.uint64).view(np.int64))
        self._ids = np.array(normal)
        self._bytes = np.zeros(256, np.int64)
        for i, k in enumerate(v.kinds):
            if k == "b":
                self._bytes[int(v.pieces[i][3:5], 16)] = i
        self._singles = {p for i in normal for p in [v.pieces[i]] if len(p) == 1}

    def _groups(self, words: list[str]):
        """Words of one length at a time: their places, and by piece length the ids and log-probabilities at each start.

        Arrays have a row for each start and a column for each word; lengths without a piece are left out.
        """
        self.ready()
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        begin = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cuts):
            n = int(lengths[same[0]])
            most = max(1, _CELLS // n)
            for a in range(0, len(same), most):
                own = same[a : a + most]
                matrix = codes[begin[own] + np.arange(n)[:, None]]
                rolling = np.zeros((n, len(own)), np.uint64)
                pieces = []
                for size in range(1, min(n, self.longest) + 1):
                    rolling = rolling[: n - size + 1] * _STEP + matrix[size - 1 :] + np.uint64(1)
                    at = self._index.get_indexer(rolling.ravel().view(np.int64)).reshape(rolling.shape)
                    if size == 1 or (at >= 0).any():
                        ids = self._ids[at]
                        pieces.append((size, np.where(at >= 0, ids, -1), np.where(at >= 0, self.logs[ids], -np.inf)))
                first, spelled = pieces[0], []
                for j, i in np.argwhere(first[1] < 0).tolist():  # characters that are no piece: one path, byte by byte
                    own_bytes = self._bytes[list(chr(int(matrix[j, i])).encode("utf-8", "surrogatepass"))]
                    first[2][j, i] = self.logs[own_bytes].sum()
                    spelled.append((j, i, own_bytes))
                yield own, n, pieces, spelled

    @staticmethod
    def _forward(n: int, logs: list[tuple[int, np.ndarray]], words: int) -> np.ndarray:
        """Log of the summed probability of all ways to each place."""
        alpha = np.full((n + 1, words), -np.inf)
        alpha[0] = 0
        for end in range(1, n + 1):
            ways = [alpha[end - size] + log[end - size] for size, log in logs if size <= end]
            most = ways[0].copy()
            for way in ways[1:]:
                np.maximum(most, way, out=most)
            most[np.isneginf(most)] = 0
            alpha[end] = most + np.log(sum(np.exp(way - most) for way in ways))
        return alpha

    def likelihood(self, words: list[str]) -> np.ndarray:
        """log10 of the marginal probability of each word (already spelled)."""
        out = np.zeros(len(words))
        if words:
            with np.errstate(divide="ignore"):
                for own, n, pieces, _ in self._groups(words):
                    out[own] = self._forward(n, [(size, log) for size, _, log in pieces], len(own))[n]
        return out / np.log(10)

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected in all segmentations of the weighted words."""
        total = np.zeros(len(self.logs))
        with np.errstate(divide="ignore"):
            for own, n, pieces, spelled in self._groups(words) if words else ():
                alpha = self._forward(n, [(size, log) for size, _, log in pieces], len(own))
                beta = self._forward(n, [(size, log[::-1]) for size, _, log in pieces], len(own))[::-1]
                for size, ids, logs in pieces:
                    some = ids >= 0
                    share = np.exp(alpha[: n - size + 1] + logs + beta[size:] - alpha[n]) * weights[own]
                    total += np.bincount(ids[some], share[some], len(total))
                    if size == 1:
                        for j, i, own_bytes in spelled:
                            np.add.at(total, own_bytes, share[j, i])
        return total


def initial(vocabulary: Vocabulary) -> Lattice:
    """Probabilities by the vocabulary's own scores."""
    weight = np.array([
        1 / (10 + min(1e6, -s)) if k == "n" else 1e-6 if k == "b" else 0.0 for s, k in zip(vocabulary.scores, vocabulary.kinds, strict=True)
    ])
    return _normalised(vocabulary, np.r_[weight, weight.max()])


def _normalised(vocabulary: Vocabulary, counts: np.ndarray) -> Lattice:
    with np.errstate(divide="ignore"):
        return Lattice(vocabulary, np.log(counts / counts.sum()))


def _count(batches):
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])
    counts: Counter[bytes] = Counter()

    def send():
        yield C.batch(schema, pa.array([w.decode() for w in counts], pa.string()), np.array(list(counts.values())))

    for part in C.slices(batches):
        for text in part.column("text").to_pylist():
            if text:
                counts.update(text.encode().lower().split())
        if len(counts) > _HELD:
            yield from send()
            counts.clear()
    if counts:
        yield from send()


@dataclass
class Counts:
    """The table (word, c) of the training texts, the number of these, of their tokens N, and of different tokens V."""

    words: DataFrame
    texts: int
    tokens: int
    kinds: int

    @property
    def divisor(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)


def count(docs: DataFrame, text: str = "text") -> Counts:
    texts = docs.select(F.col(text).alias("text"))
    words = C.stored(texts.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    n = docs.count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("v")).first()
    return Counts(words, n, sums["c"] + n, sums["v"] + (n > 0))


def fit(counts: Counts, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Lattice:
    """Piece probabilities by expectation maximisation over the counted words."""
    lattice = initial(vocabulary)
    if not counts.texts:
        return lattice
    normal = np.array([k in "nb" for k in vocabulary.kinds] + [True])
    for _ in range(rounds):
        shared = counts.words.sparkSession.sparkContext.broadcast(lattice)  # as large as the vocabulary

        def expected(batches, shared=shared):
            schema = pa.schema([("piece", pa.int32()), ("n", pa.float64())])
            total, words, weights = 0, [], []

            def settled():
                own = shared.value.expected(words, np.concatenate(weights).astype(float))
                words.clear()
                weights.clear()
                return own

            for part in batches:
                words += [_spelled(w) for w in part.column("word").to_pylist()]
                weights.append(part.column("c").to_numpy())
                if len(words) >= _TOGETHER:
                    total = total + settled()
            if words:
                total = total + settled()
            if np.ndim(total):
                some = np.flatnonzero(total)
                yield C.batch(schema, some.astype(np.int32), total[some])

        sums = counts.words.mapInArrow(expected, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros(len(lattice.logs))
        found[sums["piece"]] = sums["n"]  # a row a piece at most
        found[-1] = counts.texts
        lattice = _normalised(vocabulary, np.where(normal, found + 0.01, 0.0))
    return lattice


def _scan(shared):
    rest = pa.struct([("word", pa.string()), ("times", pa.int64())])

    def run(batches):
        lattice, keys, values, unknown = shared.value
        index = pd.Index(keys)
        for part in C.slices(batches):
            data, begin = C.text_bytes(part.column("text"))
            start, end, row = C.words_of(data, begin)
            lower = C.LOWER[data]
            hashes = C.mix(C.RollingHash(lower, 13)(start, end)).view(np.int64)
            at = index.get_indexer(hashes) if len(keys) else np.full(len(hashes), -1)
            rows = part.num_rows
            hit = at >= 0
            sums = [np.bincount(row[hit], values[at[hit], j], rows).astype(float) for j in (0, 1)]  # of nothing: whole numbers
            known = np.bincount(row[hit], minlength=rows)
            # the other words, once a text
            left = np.flatnonzero(~hit)
            order = left[np.lexsort((hashes[left], row[left]))]
            r, h = row[order], hashes[order]
            new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(order) else np.zeros(0, np.int64)
            times = np.diff(np.r_[new, len(order)])
            raw = lower.tobytes()
            words = [raw[s:e].decode() for s, e in zip(start[order[new]].tolist(), end[order[new]].tolist(), strict=True)]
            different, back = np.unique(h[new], return_inverse=True)
            first = np.zeros(len(different), np.int64)
            first[back[::-1]] = np.arange(len(new))[::-1]
            logs = lattice.likelihood([_spelled(words[i]) for i in first.tolist()])
            sums[1] = sums[1] + np.bincount(r[new], logs[back] * times, rows)
            parts = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], ["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r[new], np.arange(rows + 1)), pa.int32()), parts)
            tokens = np.bincount(row, minlength=rows) + 1
            columns = [pa.array(tokens), pa.array(known), pa.array(sums[0]), pa.array(sums[1] + lattice.logs[-1] / np.log(10)), lists.cast(pa.list_(rest))]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("key"), *columns], names=["row", "key", "n_tokens", "n_known", "base", "score", "rest"]
            )

    return run


def score(docs: DataFrame, counts: Counts, lattice: Lattice, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns; all by default) with ``n_tokens, n_known, train_tokens, base_score, score``."""
    own = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    spark = docs.sparkSession
    least = max(1, -(-counts.tokens // FREQUENT))
    common = counts.words.filter(F.col("c") >= least).toPandas()  # FREQUENT rows at most
    c = common["c"].to_numpy(float)
    words = common["word"].tolist()
    keys, _ = C.word_hashes(pa.array(words, pa.string()), 13)
    values = np.stack([np.log10((c + 0.5) / counts.divisor), lattice.likelihood([_spelled(w) for w in words])], 1) if words else np.zeros((0, 2))
    unknown = float(np.log10(0.5 / counts.divisor))
    shared = spark.sparkContext.broadcast((lattice, keys.view(np.int64), values, unknown))
    packed = docs.select(
        F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.monotonically_increasing_id().alias("key"), F.col(text).alias("text")
    )
    ddl = f"row {packed.schema['row'].dataType.simpleString()}, key long, n_tokens long, n_known long, base double, score double, rest array<struct<word:string,times:bigint>>"
    rows = C.stored(packed.mapInArrow(_scan(shared), ddl), "scores")
    rare = (
        rows.select("key", F.explode("rest").alias("w"))
        .select("key", "w.word", "w.times")
        .join(counts.words, "word", "left")
        .groupBy("key")
        .agg(
            F.sum(F.col("times") * F.coalesce(F.log10((F.col("c") + 0.5) / counts.divisor), F.lit(unknown))).alias("rare_base"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    end = float(np.log10((counts.texts + 0.5) / counts.divisor))
    return rows.drop("rest").join(rare, "key", "left").select(
        *(F.col("row").getField(x).alias(x) for x in keep),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(counts.texts > 0)).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end).alias("base_score"),
        "score",
    )
