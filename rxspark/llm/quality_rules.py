"""Quality rules in Spark expressions only: countable base rules, and a log-likelihood ratio of hashed n-grams.

Two multinomials over BUCKETS hashed one- and two-token strings are counted: one over the trusted target documents,
one over the whole corpus. A document's ratio is the mean over its n-grams of ln(target share / corpus share), so long
texts weigh no more than short ones; it is kept if the ratio reaches a fixed threshold. Target shares are smoothed
towards the corpus: as if SMOOTHING more n-grams had been drawn from it. Tokens are lower-cased runs of letters and
digits, and runs of other visible characters.

Counting is one pass with map-side sums per bucket; the weights are one array of BUCKETS numbers, whatever the input. Texts are
never shuffled: the trusted ids come to them. TRUSTED of these at most teach (beyond, those with the smallest hashes), so their
table is bounded; the corpus is counted whole.

Defined cases: null or empty texts have no words and fail the base rules; a text without n-grams has ratio 0. With no
target document all ratios are 0. Repeated rows are counted and answered each time. Windows of five words are compared
by 64-bit hash within one text. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxspark.llm.common import stored

BUCKETS = 1 << 14
SMOOTHING = float(BUCKETS)
THRESHOLD = -0.15
WINDOW = 5
TRUSTED = 1 << 20  # ids of target documents (16 bytes each)
_SPACE = r"[\x20\x09-\x0D]+"
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


def base_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``base_failed``."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.struct(F.lit(0).alias("_"), *(c for c in docs.columns if c not in own)).alias("row"), F.col(text).alias("text"))
    df = df.withColumn("words", F.filter(F.split(t, _SPACE), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
        lambda i: F.xxhash64(*(F.element_at("words", i + j) for j in range(WINDOW))),
    )
    df = df.withColumn("windows", F.when(F.size("words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("again", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))

    def twice(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at("again", F.greatest(i, F.lit(1)))["h"])
        after = F.get("again", i + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    df = df.withColumn("places", F.sort_array(F.transform(F.filter("again", twice), lambda x: x["i"])))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["n"] + (p + WINDOW - F.greatest(a["end"], p)).cast("long")).alias("n")
        ),
        lambda a: a["n"],
    )
    return df.select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns if c not in own),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _with_grams(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` with ``grams``: the bucket of every token, and of every token with its successor (or the end)."""
    df = df.withColumn("tokens", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_TOKEN), F.lit(0)))
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    ones = F.transform("tokens", lambda t: bucket(t))
    twos = F.transform("tokens", lambda t, i: bucket(t, F.get("tokens", i + 1)))
    return df.withColumn("grams", F.concat(ones, twos)).drop("tokens")


def fit(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING,
    most: int = TRUSTED,
) -> DataFrame:
    """One row, ``weights``: ln(target share / corpus share) of every bucket. ``target`` holds the trusted ids."""
    trusted = stored(target.select(F.col(target.columns[0]).alias("key")).filter("key IS NOT NULL").distinct(), "trusted")
    n = trusted.count()
    if n > most:
        trusted = trusted.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int((1 << 40) * most / n))
    trusted = F.broadcast(trusted.withColumn("trusted", F.lit(1)))  # TRUSTED rows, by the law of large numbers
    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("text")).join(trusted, "key", "left").select("text", "trusted")
    counts = (
        _with_grams(rows, buckets)
        .select("trusted", F.explode_outer("grams").alias("bucket"))  # explode would count the grams twice, to drop empty texts
        .filter("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.count("trusted").alias("t"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    all_ = every.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("t"),
        F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t")))).alias("b"),
    )
    weight = lambda b: F.ln(
        (b["t"] + smoothing * (b["n"] + 1) / (F.col("n") + buckets)) / (F.col("t") + smoothing) / ((b["n"] + 1) / (F.col("n") + buckets))
    )
    return all_.select(F.transform("b", weight).alias("weights"))


def log_ratio(docs: DataFrame, weights: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``log_ratio``, the mean weight of a document's n-grams."""
    keep = [c for c in docs.columns if c != "log_ratio"]
    df = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col(text).alias("text"))
    df = _with_grams(df, buckets).withColumn("weights", weights.scalar())
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.element_at("weights", g + 1))
    mean = F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))
    return df.select(*(F.col("row").getField(c).alias(c) for c in keep), mean.alias("log_ratio"))


def judge(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with the base signals, ``log_ratio`` and ``kept``."""
    weights = fit(docs, target, id, text)
    scored = log_ratio(base_signals(docs, text), weights, text)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
