"""URL filter: host and path rules, and for the rest the ratio of two character models.

Rules decide first: a rule fits its host and every host below it, if the path begins with the rule's path; of those that
fit, the longest decides (of equally long ones, the first by text). Candidates come from an equi-join of the rules with
every parent of a host, so their number does not matter.

URLs that rules allow or block teach two smoothed variable-order Markov models of characters (contexts of 0 to ORDER
bytes, Witten-Bell interpolation). A URL's log-likelihood difference divided by its length is compared with a threshold
calibrated on the teaching URLs: the cut with the least sum of the two error rates. Every context and byte has its own
code and its exact count in a Spark table. Different URLs are scored once: the FREQUENT most common codes go to the
tasks with their values, all others meet theirs in an equi-join, so no model has to fit into one machine.

Defined cases: null, and text without ``://``, have empty host and path; null and empty URLs have difference 0. If one
of the sides has nothing to learn from, every URL without a rule is allowed. Repeated rows count and are answered each
time. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C

ORDER = 5
BASE = 257  # a byte, or no byte before the begin of the URL
FREQUENT = 1 << 16  # codes whose values are sent to every task
BINS = 200  # per unit of difference, in natural logarithms per byte
_LIMIT = 10 * BINS


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule`` and ``ruling`` (both null where no rule fits). ``rules``: ``rule, verdict``."""
    own = ["host", "path", "rule", "ruling"]
    host, path = parts(url)
    keep = [c for c in urls.columns if c not in own]
    df = urls.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), host.alias("host"), path.alias("path"))
    split = rules.select(
        F.col("rule"), F.col("verdict"),
        F.lower(F.regexp_extract("rule", r"^([^/]*)", 1)).alias("rule_host"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("rule_path"),
    )
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = df.select("host", "path").distinct()
    fits = (
        places.select("host", "path", F.explode(parents).alias("rule_host"))
        .join(split, "rule_host")
        .filter(F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    )
    done = df.join(fits, ["host", "path"], "left")
    return done.select(
        *(F.col("row").getField(c).alias(c) for c in keep), "host", "path", F.col("best.rule").alias("rule"),
        F.col("best.verdict").alias("ruling"),
    )


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code of the ORDER bytes before and the byte itself, for every byte of every URL; its row; where rows begin."""
    data, begin = C.text_bytes(column)
    row = np.repeat(np.arange(len(column)), np.diff(begin))
    code = np.zeros(len(data), np.int64)
    for back in range(ORDER, 0, -1):
        part = np.zeros(len(data), np.int64)
        part[back:] = data[: len(data) - back].astype(np.int64) + 1
        part[np.arange(len(data)) - back < begin[row]] = 0  # before the begin of the URL
        code = code * BASE + part
    return code * 256 + data, row, begin


def _counts(batches):
    schema = pa.schema([("side", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])
    for part in C.slices(batches, "url"):
        code, row, _ = _codes(part.column("url"))
        sides = part.column("side").to_numpy()[row]
        for side in np.unique(sides):
            codes, n = np.unique(code[sides == side], return_counts=True)
            yield C.batch(schema, np.full(len(codes), side, np.int32), codes, n)


def _suffix(code: Column, k: Column) -> Column:
    """The code with the last ``k`` bytes of its context."""
    size = F.array(*(F.lit(BASE**i) for i in range(ORDER + 1)))
    return (F.shiftright(code, 8) % F.get(size, k)) * 256 + code.bitwiseAND(F.lit(255))


def _orders(codes: DataFrame) -> DataFrame:
    """``codes`` once for every order ``k``, with ``key`` in place of ``code``."""
    each = codes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ORDER))))
    return each.withColumn("key", _suffix(F.col("code"), F.col("k"))).drop("code")


def fit(taught: DataFrame, url: str = "url", accepted: str = "accepted") -> DataFrame:
    """``(code, n0, n1)``: how often rejected and accepted URLs hold each code. ``taught`` has a boolean ``accepted``."""
    rows = taught.select(F.col(url).alias("url"), F.col(accepted).cast("int").alias("side")).filter("side IS NOT NULL AND url != ''")
    sums = rows.mapInArrow(_counts, "side int, code long, n long").groupBy("code").agg(
        *(F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in (0, 1))
    )
    return C.stored(sums, "url-counts")


def _values(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``value``: accepted minus rejected log-probability of the code's byte after its context."""
    pairs = C.stored(_orders(counts).groupBy("k", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "url-pairs")
    context = F.shiftright("key", 8).alias("context")
    contexts = pairs.groupBy("k", context).agg(
        *(F.sum(f"n{s}").alias(f"all{s}") for s in (0, 1)), *(F.count_if(F.col(f"n{s}") > 0).alias(f"kinds{s}") for s in (0, 1))
    )
    found = (
        _orders(wanted.select("code")).distinct().withColumn("context", F.shiftright("key", 8))
        .join(pairs, ["k", "key"], "left")
        .join(contexts, ["k", "context"], "left")
    )
    seen = [F.coalesce(F.col(f"all{s}"), F.lit(0)) > 0 for s in (0, 1)]
    size = [F.col(f"all{s}") + F.col(f"kinds{s}") for s in (0, 1)]
    shares = C.stored(
        found.select(
            "k", "key",
            *(F.when(seen[s], F.coalesce(f"n{s}", F.lit(0)) / size[s]).otherwise(0.0).alias(f"own{s}") for s in (0, 1)),
            *(F.when(seen[s], F.col(f"kinds{s}") / size[s]).otherwise(1.0).alias(f"rest{s}") for s in (0, 1)),
        ),
        "url-shares",
    )
    chance = None
    for k in range(ORDER + 1):
        level = shares.filter(F.col("k") == k)
        if chance is None:
            level = level.withColumns({"lower0": F.lit(1 / 256), "lower1": F.lit(1 / 256)})
        else:
            shorter = chance.select(F.col("key").alias("shorter"), F.col("p0").alias("lower0"), F.col("p1").alias("lower1"))
            level = level.withColumn("shorter", _suffix(F.col("key"), F.lit(k - 1))).join(shorter, "shorter")
        chance = level.select("key", *((F.col(f"own{s}") + F.col(f"rest{s}") * F.col(f"lower{s}")).alias(f"p{s}") for s in (0, 1)))
    return wanted.join(chance.select(F.col("key").alias("code"), (F.log("p1") - F.log("p0")).alias("value")), "code")


def _known(shared):
    """Sum of the values of frequent codes, the other codes, and the number of bytes of every URL."""

    def run(batches):
        codes, values = shared.value
        for part in C.slices(batches, "url"):
            code, row, begin = _codes(part.column("url"))
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            sums = np.bincount(row[hit], values[at[hit]], part.num_rows)
            ends = np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=part.num_rows))].astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(code[~hit]))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array(sums), rare, pa.array(np.diff(begin))], names=["id", "url", "known", "rare", "n"]
            )

    return run


def _differences(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``(url, difference)`` of each different URL that is not empty."""
    texts = C.stored(urls.select("url").filter("url != ''").distinct().withColumn("id", F.monotonically_increasing_id()), "url-texts")
    used = texts.select("url", F.lit(0).alias("side")).mapInArrow(_counts, "side int, code long, n long")
    wanted = C.stored(used.groupBy("code").agg(F.sum("n").alias("times")), "url-codes")
    values = C.stored(_values(counts, wanted), "url-values")
    frequent = values.orderBy(F.desc("times"), "code").limit(FREQUENT).toPandas().sort_values("code")
    shared = urls.sparkSession.sparkContext.broadcast((frequent["code"].to_numpy(), frequent["value"].to_numpy()))  # 1 MB at most
    known = C.stored(texts.mapInArrow(_known(shared), "id long, url string, known double, rare array<long>, n long"), "url-known")
    rest = known.select("id", F.explode("rare").alias("code")).join(values.select("code", "value"), "code").groupBy("id").agg(F.sum("value").alias("rest"))
    done = known.join(rest, "id", "left")
    return done.select("url", ((F.col("known") + F.coalesce("rest", F.lit(0.0))) / F.col("n")).alias("difference"))


def with_difference(urls: DataFrame, counts: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``difference``: accepted minus rejected log-likelihood per byte."""
    keep = [c for c in urls.columns if c != "difference"]
    packed = urls.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col(url).alias("url"))
    done = packed.join(_differences(packed, counts), "url", "left")
    return done.select(*(F.col("row").getField(c).alias(c) for c in keep), F.coalesce("difference", F.lit(0.0)).alias("difference"))


def calibrate(scored: DataFrame) -> float:
    """Threshold of ``difference`` from rows with ``side`` (0 rejected, 1 accepted)."""
    bins = (
        scored.select("side", F.least(F.greatest(F.round(F.col("difference") * BINS), F.lit(-_LIMIT)), F.lit(_LIMIT)).cast("int").alias("bin"))
        .groupBy("bin").pivot("side", [0, 1]).count().orderBy("bin").na.fill(0).toPandas()  # 2 * _LIMIT + 1 rows at most
    )
    low, high = bins["0"].to_numpy(float), bins["1"].to_numpy(float)
    # errors if everything from bin i on is accepted
    errors = np.r_[0, np.cumsum(high)] / high.sum() + (low.sum() - np.r_[0, np.cumsum(low)]) / low.sum()
    best = np.flatnonzero(errors == errors.min())
    edges = np.r_[bins["bin"].iloc[0] - 1, bins["bin"].to_numpy(float), bins["bin"].iloc[-1] + 1] / BINS
    i = best[len(best) // 2]
    return float((edges[i] + edges[i + 1]) / 2)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict`` (allow or block) and ``difference``."""
    ruled = C.stored(with_rules(urls, rules, url), "ruled-urls")
    counts = fit(ruled.filter("ruling IS NOT NULL").withColumn("accepted", F.col("ruling") == "allow"), url)
    if counts.agg(F.bool_or(F.col("n0") > 0) & F.bool_or(F.col("n1") > 0)).first()[0]:
        scored = C.stored(with_difference(ruled, counts, url), "scored-urls")
        taught = scored.filter(F.col("ruling").isNotNull() & (F.col(url) != ""))
        own = F.when(F.col("difference") >= calibrate(taught.withColumn("side", (F.col("ruling") == "allow").cast("int"))), "allow").otherwise("block")
    else:
        scored, own = ruled.drop("difference").withColumn("difference", F.lit(0.0)), F.lit("allow")
    return scored.drop("verdict").withColumn("verdict", F.coalesce("ruling", own)).drop("ruling")
