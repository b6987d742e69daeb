"""Language identification by prediction by partial matching over bytes, with frozen counts.

Each language has a tree of byte contexts up to ORDER bytes long. A byte costs -log2 of its share in the longest
context in which it was seen; for every longer context that was seen without it, an escape is paid (method C:
d / (n + d) for d different successors among n). Below the empty context stands the uniform choice among 256 bytes.
The code length of a text is the sum over its bytes; nothing is updated while a text is scored. The language with the
shortest code wins (of equal ones, the first by name); ``score`` is its posterior under equal priors.

Counting is a map-side count of (ORDER + 1)-byte strings and one aggregation by (language, string); shorter contexts
are sums of these. All counts are kept, and everything is computed from them in Spark. A byte's cost is a sum of independent parts:

    8 + the escapes of its contexts + for every string that ends with it and was seen, what that saves against its context's
    escape and the next shorter string

so a language is a sparse table of weights, one for each string or context seen in it. Strings with frequent occurrence
(as many as ENTRIES weights allow) go to the tasks, with a bit filter of bounded size over all the others. A byte whose
strings are all frequent or surely unseen is scored in the task; the others leave it as (row, code) and meet their weights in an equi-join. So code
lengths are exact at every size and number of languages, and what is sent to the tasks is bounded.

Defined cases: null text, and text without a letter, get ``und``, as does everything if no language was learned; then
the score is 0. Rows of null language teach nothing. A-Z count as a-z. Repeated rows count and are answered each time.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C

ORDER = 4
ENTRIES = 1 << 20  # weights sent to the tasks (20 bytes each)
COSTS = 1 << 22  # numbers that a task holds at once: codes times languages
UNKNOWN = "und"
_HELD = 1 << 20
_KINDS = 2 * (ORDER + 1)  # a string of each order, and its context


def _codes(data: np.ndarray, begin: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For every byte, the byte and the ``order`` bytes before it in its row as one number (zero bytes before a row)."""
    code = np.zeros(len(data), np.int64)
    for back in range(order, -1, -1):
        code <<= 8
        part = np.zeros(len(data), np.int64)
        part[back:] = C.LOWER[data[: len(data) - back]]
        for cut in range(back):  # the first bytes of a row have no such byte before them
            at = begin[:-1] + cut
            at = at[at < begin[1:]]
            part[at] = 0
        code |= part
    return code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
    names: dict[str, int] = {}
    held: list[pd.Series] = []

    def merged() -> pd.Series:
        both = pd.concat(held)
        return both.groupby(both.index).sum()

    def send(total: pd.Series):
        keys = total.index.to_numpy()
        langs = np.array(list(names), object)[keys >> 40]
        yield C.batch(schema, pa.array(langs, pa.string()), keys & ((1 << 40) - 1), total.to_numpy())

    size = 0
    for part in C.slices(batches):
        data, begin = C.text_bytes(part.column("text"))
        langs = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()], np.int64)
        keys = _codes(data, begin) | (np.repeat(langs, np.diff(begin)) << 40)
        held.append(pd.Series(keys).value_counts(sort=False))
        size += len(held[-1])
        if size > _HELD:
            held = [merged()]
            size = len(held[0])
            if size > _HELD // 2:
                yield from send(held.pop())
                size = 0
    if held:
        yield from send(merged())


@dataclass
class Model:
    """What the tasks get: weights of frequent strings, sorted by key, and a filter over the other keys. ``weights`` has all."""

    langs: list[str]
    keys: np.ndarray | None = None  # each key once
    begin: np.ndarray | None = None  # where its weights begin (one more entry: the end)
    lang: np.ndarray | None = None
    weight: np.ndarray | None = None
    rare: np.ndarray | None = None  # bit filter; None if all keys are frequent
    weights: DataFrame | None = None  # key, lang (its number), weight

    def __getstate__(self):
        return {**self.__dict__, "weights": None}

    def costs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of every code in every language, and which codes have parts that are not here (their cost is 8)."""
        size = len(self.langs)
        cost = np.full((len(codes), size), 8.0)
        open_ = np.zeros(len(codes), bool)
        for kind in range(_KINDS):
            key = _key(codes, kind)
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            if self.rare is not None:
                miss = np.flatnonzero(~hit)
                open_[miss[C.passes(self.rare, key[miss])]] = True
            found = np.flatnonzero(hit)
            first, n = self.begin[at[found]], np.diff(self.begin)[at[found]]
            place = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(found) else np.zeros(0, np.int64)
            cost += np.bincount(np.repeat(found, n) * size + self.lang[place], self.weight[place], len(codes) * size).reshape(cost.shape)
        cost[open_] = 8.0
        return cost, open_


def _key(codes: np.ndarray, kind: int) -> np.ndarray:
    """Key of a code's string of order kind // 2 (even), or of that string's context (odd)."""
    order = kind >> 1
    part = (codes >> 8) & ((1 << 8 * order) - 1) if kind & 1 else codes & ((1 << 8 * (order + 1)) - 1)
    return part | (kind << 40)


def _keys_of(code) -> list:
    """The same keys as Spark expressions."""
    out = []
    for kind in range(_KINDS):
        order = kind >> 1
        part = F.shiftright(code, 8).bitwiseAND((1 << 8 * order) - 1) if kind & 1 else code.bitwiseAND((1 << 8 * (order + 1)) - 1)
        out.append(part.bitwiseOR(F.lit(kind << 40)))
    return out


def _weights(counts: DataFrame, langs: list[str]) -> DataFrame:
    """``key, lang, weight, n`` of every string and context of every language, from ``lang, code, n``."""
    number = F.array_position(F.array(*(F.lit(x) for x in langs)), F.col("lang")).cast("int") - 1
    orders = F.array(*(F.struct(F.lit(k).alias("k"), F.col("code").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")) for k in range(ORDER + 1)))
    grams = (
        counts.select(number.alias("lang"), "n", F.explode(orders).alias("o"))
        .groupBy("lang", F.col("o.k").alias("k"), F.col("o.gram").alias("gram")).agg(F.sum("n").alias("n"))
    )
    grams = C.stored(grams.withColumn("context", F.shiftright("gram", 8)), "language-strings")
    contexts = grams.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    contexts = C.stored(contexts.withColumn("escape", -F.log2(F.col("kinds") / (F.col("total") + F.col("kinds")))), "language-contexts")
    own = grams.join(contexts, ["lang", "k", "context"]).withColumn("own", -F.log2(F.col("n") / (F.col("total") + F.col("kinds"))))
    own = C.stored(own.select("lang", "k", "gram", "n", "own", "escape"), "language-costs")
    shorter = own.select("lang", (F.col("k") + 1).alias("k"), F.col("gram").alias("suffix"), F.col("own").alias("shorter"))
    masks = F.array(*(F.lit((1 << 8 * k) - 1) for k in range(ORDER + 1)))
    saved = own.withColumn("suffix", F.col("gram").bitwiseAND(F.get(masks, F.col("k")))).join(shorter, ["lang", "k", "suffix"], "left")
    kind = lambda odd: F.shiftleft((2 * F.col("k") + odd).cast("long"), 40)
    return C.stored(
        saved.select(
            F.col("gram").bitwiseOR(kind(0)).alias("key"), "lang",
            (F.col("own") - F.col("escape") - F.coalesce("shorter", F.lit(8.0))).alias("weight"), "n",
        ).unionByName(contexts.select(F.col("context").bitwiseOR(kind(1)).alias("key"), "lang", F.col("escape").alias("weight"), F.col("total").alias("n"))),
        "language-weights",
    )


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", entries: int = ENTRIES) -> Model:
    """Learn from every row with a language."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    counts = (
        rows.filter("lang IS NOT NULL AND text != ''")
        .mapInArrow(_count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    counts = C.stored(counts, "language-codes")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # one row a language
    if not langs:
        return Model([])
    listed = F.collect_list(F.struct("lang", "weight"))  # an entry a language
    keys = _weights(counts, langs).groupBy("key").agg(F.sum("n").alias("n"), listed.alias("entries"))
    keys = C.stored(keys.withColumn("scale", F.floor(F.log2("n")).cast("int")).drop("n"), "language-keys")
    steps = keys.groupBy("scale").agg(F.sum(F.size("entries")).alias("entries")).orderBy(F.desc("scale")).collect()  # 63 rows at most
    least, held = 64, 0
    for r in steps:
        held += r["entries"]
        if held > entries:
            break
        least = r["scale"]
    frequent = keys.filter(F.col("scale") >= least).orderBy("key").select("key", "entries.lang", "entries.weight").toArrow()  # ENTRIES weights at most
    column = lambda c: frequent.column(c).combine_chunks()
    rare = None if held <= entries else C.bit_filter(keys.filter(F.col("scale") < least).select("key"))
    return Model(
        langs, column("key").to_numpy(), column("lang").offsets.to_numpy().astype(np.int64), column("lang").flatten().to_numpy().astype(np.int64),
        column("weight").flatten().to_numpy(), rare, keys.select("key", F.inline("entries")),
    )


def _score(shared):
    piece = pa.struct([("code", pa.int64()), ("n", pa.int64())])

    def run(batches):
        model: Model = shared.value
        size = len(model.langs)
        chunk = max(1024, COSTS // max(size, 1))
        known, costs, opens = np.zeros(0, np.int64), np.zeros((0, size)), np.zeros(0, bool)  # codes met before in this task
        for part in C.slices(batches):
            data, begin = C.text_bytes(part.column("text"))
            bits = np.zeros((part.num_rows, size))
            left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a in range(0, len(data) if size else 0, chunk):  # each piece with the bytes before it
                b = min(a + chunk, len(data))
                start = max(0, a - ORDER)
                codes, back = np.unique(_codes(data[start:b], np.clip(begin, start, b) - start)[a - start :], return_inverse=True)
                new = np.setdiff1d(codes, known, assume_unique=True)
                if len(new):
                    more, still = model.costs(new)
                    if len(known) + len(new) > chunk:
                        old = np.flatnonzero(np.isin(known, codes, assume_unique=True))
                        known, costs, opens = known[old], costs[old], opens[old]
                    order = np.argsort(both := np.r_[known, new])
                    known, costs, opens = both[order], np.concatenate([costs, more])[order], np.r_[opens, still][order]
                at = np.searchsorted(known, codes)[back]
                first, last = np.searchsorted(begin, a, "right") - 1, np.searchsorted(begin, b, "left") - 1
                inside = np.arange(first, last + 1)
                inside = inside[np.minimum(begin[inside + 1], b) > np.maximum(begin[inside], a)]
                bits[inside] += np.add.reduceat(costs[at], np.maximum(begin[inside], a) - a, axis=0)
                some = np.flatnonzero(opens[at])
                if len(some):
                    row = np.searchsorted(begin, a + some, "right") - 1
                    pairs, n = np.unique(np.stack([row, known[at[some]]]), axis=1, return_counts=True)
                    left.append((pairs[0], pairs[1], n))
            row, code, n = (np.concatenate(x) for x in zip(*left, strict=True)) if left else (np.zeros(0, np.int64),) * 3
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(part.num_rows + 1))
            parts = pa.StructArray.from_arrays([pa.array(code[order]), pa.array(n[order])], [f.name for f in piece])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * size, pa.int32()), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("id"), part.column("letters"), pa.array(np.diff(begin)), lists, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)],
                names=["row", "id", "letters", "n_bytes", "bits", "open"],
            )

    return run


def _with_open(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """``scored`` with the weights of its open codes added to ``bits``."""
    scored = C.stored(scored, "language-bits")
    open_ = scored.select("id", F.explode("open").alias("o")).select("id", "o.code", "o.n")
    codes = open_.select("code").distinct().withColumn("key", F.explode(F.array(*_keys_of(F.col("code")))))
    cost = codes.join(weights, "key").groupBy("code", "lang").agg(F.sum("weight").alias("weight"))
    sums = open_.join(cost, "code").groupBy("id", "lang").agg(F.sum(F.col("n") * F.col("weight")).alias("more"))
    rows = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "more"))).alias("more"))  # an entry a language
    added = F.transform("bits", lambda b, i: b + F.coalesce(F.element_at("more", i), F.lit(0.0)))
    return scored.join(rows, "id", "left").withColumn("bits", F.when(F.col("more").isNull(), F.col("bits")).otherwise(added)).drop("more")


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns; all by default) with ``lang_pred``, ``lang_score`` (0 to 1) and ``bits_per_byte``
    under the language found."""
    own = ["lang_pred", "lang_score", "bits_per_byte"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    packed = docs.select(
        F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.monotonically_increasing_id().alias("id"), F.col(text).alias("text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    row = packed.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ENTRIES weights, a filter of 32 MB at most
    done = packed.mapInArrow(_score(shared), f"row {row}, id long, letters boolean, n_bytes long, bits array<double>, open array<struct<code:bigint,n:bigint>>")
    if model.rare is not None:
        done = _with_open(done, model.weights)
    columns = [F.col("row").getField(c).alias(c) for c in keep]
    if not model.langs:
        return done.select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(0.0).alias("bits_per_byte"))
    least = F.array_min("bits")
    name = F.element_at(F.array(*(F.lit(x) for x in model.langs)), F.array_position("bits", least).cast("int"))
    share = 1 / F.aggregate("bits", F.lit(0.0), lambda total, b: total + F.pow(F.lit(2.0), F.greatest(least - b, F.lit(-1000.0))))
    return done.select(
        *columns,
        F.when(F.col("letters"), name).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), share).otherwise(0.0).alias("lang_score"),
        (least / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
