"""Toxic passages as maximal scoring segments of token log-odds, with extreme-value calibration.

Tokens are lower-cased runs of letters and digits, known by 64-bit hashes. Every token has the log-odds of toxic
against clean labelled documents under an informative Dirichlet prior: pseudo-tokens spread as in all documents, with half an
occurrence more for every token of a large vocabulary. Log-odds that are not CERTAIN standard deviations from zero count as zero, and every token pays DRIFT, so that the expected score
of clean text is negative. One scan of a text in linear time finds all its maximal scoring segments (no segment can be extended or
cut without a loss, and they do not overlap).

The best segment of clean text follows an extreme-value law: exp(-K n exp(-lambda s)) is the chance that n tokens hold
none above s. lambda solves sum p exp(lambda s) = 1 over the scores of clean tokens (rounded to 1 / STEPS, those beyond LIMIT taken as
LIMIT); K comes from the mean of clean documents. A document's evidence is the sum of lambda s - ln(K n) over its significant
segments (the best one, if none is), LOWEST at least; a logistic curve fitted to labelled documents turns it into a score. The fit takes
evidence beyond HIGHEST as HIGHEST; scores do not.

Token counts and log-odds are made in Spark over all documents; only tokens with certain log-odds go to the tasks. They stand in
labelled text, and labels teach from LABELLED rows at most (beyond, those with the smallest hashes of their ids), so that the
table of labels and the list of tokens are bounded. Calibration is a map-side sum.

Defined cases: null and empty texts, and those without a positive token, have the least evidence. Rows without label or
id do not teach; a label that repeats counts once, the larger one. Without both classes every score is the share of ones
(0.5 without labels). Repeated rows are answered each time; documents of equal evidence have equal scores. Output columns
replace input columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C

LABELLED = 1 << 20  # rows of labels that teach
PRIOR = 0.05  # pseudo-tokens for each labelled token
VOCABULARY = 1 << 20  # different tokens that the prior takes for possible, at least; each weighs half an occurrence
DRIFT = 1.5
CERTAIN = 2.0
LOWEST, HIGHEST = -30.0, 120.0  # evidence without a segment, and from which on the fit does not tell it apart
BINS = 10  # per unit of evidence
STEPS = 2  # per unit of token score
LIMIT = 15  # token scores beyond are counted there
_EULER = 0.5772156649015329
_HELD = 1 << 20  # different tokens that a counting task holds


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, row = C.word_hashes(column, 9, C.SEPARATORS)
    return hashes.view(np.int64), row


def _count(shared):
    """``token, n, toxic, clean`` of a task's documents, combined as long as they fit."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        token, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        sums = np.concatenate([y for _, y in held], axis=1)
        return token, np.stack([np.bincount(back, x, len(token)) for x in sums]).astype(np.int64)

    def run(batches):
        ids, labels = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part in C.slices(batches):
            token, row = _tokens(part.column("text"))
            id = part.column("id").fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, id), max(len(ids) - 1, 0))
            known = part.column("id").is_valid().to_numpy(zero_copy_only=False) & (ids[at] == id if len(ids) else False)
            label = np.where(known, labels[at] if len(ids) else 0, -1)[row]
            held.append(merged([(token, np.stack([np.ones(len(token)), label == 1, label == 0]))]))
            size += len(held[-1][0])
            if size > _HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if size > _HELD // 2:
                    yield C.batch(schema, held[0][0], *held[0][1])
                    held, size = [], 0
        if held:
            token, sums = merged(held)
            yield C.batch(schema, token, *sums)

    return run


def log_odds(counts: DataFrame) -> DataFrame:
    """``(token, odds)`` of the tokens with certain log-odds, from ``token, n, toxic, clean``."""
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"all_{c}") for c in ("n", "toxic", "clean")), F.count("*").alias("kinds")).first()
    pseudo = max(1000.0, PRIOR * (totals["all_toxic"] + totals["all_clean"]))
    prior = pseudo * (F.col("n") + 0.5) / (totals["all_n"] + 0.5 * max(totals["kinds"], VOCABULARY))
    own = {c: F.col(c) + F.col("prior") for c in ("toxic", "clean")}
    side = lambda c: F.ln(own[c] / F.greatest(totals[f"all_{c}"] + pseudo - own[c], F.lit(1e-9)))
    odds = counts.withColumn("prior", prior).withColumn("odds", side("toxic") - side("clean"))
    return odds.filter(F.abs("odds") >= CERTAIN * F.sqrt(1 / own["toxic"] + 1 / own["clean"])).select("token", "odds")


def rate_of(scores: np.ndarray, n: np.ndarray) -> float:
    """lambda: the positive root of sum n exp(lambda score) = sum n (1 if there is none)."""
    if not n.sum() or not (n[scores > 0] > 0).any() or scores @ n >= 0:
        return 1.0
    share = n / n.sum()
    low, high = 1e-6, 1.0
    grown = lambda x: share @ np.exp(np.minimum(x * scores, 500)) - 1
    while grown(high) < 0:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 0 else (low, mid)
    return (low + high) / 2


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of token scores, left to right."""
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    total = np.cumsum(score)
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum at the end, start, end, index of the last with a lower sum before
    for i, right, value in zip(at.tolist(), total[at].tolist(), score[at].tolist(), strict=True):
        left, start = right - value, i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, start, i + 1, j))
                break
            left, _, start, _, _ = found[j]
            del found[j:]
    return [(start, end, right - left) for left, right, start, end, _ in found]


def _scan(shared):
    piece = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        tokens, odds = shared.value
        width = 2 * LIMIT * STEPS + 1
        for part in C.slices(batches):
            token, row = _tokens(part.column("text"))
            score = np.full(len(token), -DRIFT)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
                score += np.where(tokens[at] == token, odds[at], 0)
            step = np.clip(np.round(score * STEPS), -LIMIT * STEPS, LIMIT * STEPS).astype(np.int64) + LIMIT * STEPS
            steps = np.bincount(row * width + step, minlength=part.num_rows * width).astype(np.int32)
            at = C.span_of_rows(row, part.num_rows)
            hot = np.zeros(part.num_rows, bool)
            hot[row[score > 0]] = True
            found = [segments(score[at[i] : at[i + 1]]) if hot[i] else [] for i in range(part.num_rows)]
            flat = [x for y in found for x in y]
            columns = zip(*flat, strict=True) if flat else ([], [], [])
            parts = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, piece, strict=True)], [f.name for f in piece])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()), parts)
            counts = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * width, pa.int32()), pa.array(steps))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(at)), lists, counts], names=["row", "n_tokens", "segments", "steps"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", most: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their log-odds; ``labels`` has ``id`` and ``label`` (0 or 1), the prior comes from all of ``docs``."""
    known = C.stored(_known(labels).select(F.col("id").cast("long").alias("id"), "label"), "labels")
    rows = known.count()
    if rows > most:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * most / rows))
    table = known.toPandas().sort_values("id")  # LABELLED rows, by the law of large numbers
    shared = docs.sparkSession.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["label"].to_numpy(np.int8)))
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    counts = texts.mapInArrow(_count(shared), "token long, n long, toxic long, clean long").groupBy("token")
    counts = C.stored(counts.agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "clean"))), "token-counts")
    odds = log_odds(counts).toPandas().sort_values("token")  # tokens that are frequent in labelled text
    return odds["token"].to_numpy(np.int64), odds["odds"].to_numpy(np.float64)


def _known(labels: DataFrame) -> DataFrame:
    return labels.filter("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").cast("int").alias("label"))


def passages(docs: DataFrame, odds: tuple[np.ndarray, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns; all by default) with ``n_tokens``, ``segments`` (token places
    and scores) and ``steps`` (how many tokens have which score)."""
    own = ["n_tokens", "segments", "steps"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    ddl = f"row {packed.schema['row'].dataType.simpleString()}, n_tokens long, segments array<struct<start:int,end:int,score:double>>, steps array<int>"
    return packed.mapInArrow(_scan(shared), ddl).select(*(F.col("row").getField(c).alias(c) for c in keep), *own)


def _logistic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a lightly penalised logistic curve over binned evidence; the slope is not negative."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x / 10], axis=1)
    target = (ones + n * 1e-3) / (n * (1 + 2e-3))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (target - p)) - 1e-2 * beta
        hessian = (design * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1] / 10, 0.0))


def score(found: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """``found`` (of ``passages``) with ``evidence``, ``n_significant`` and ``score``; ``labels`` teaches the calibration."""
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    known = found.select(F.col(id).alias("id"), "n_tokens", "segments", "steps").join(_known(labels), "id")
    steps = known.filter("label = 0").select(F.posexplode("steps").alias("i", "n")).filter("n > 0").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    rate = rate_of(steps["i"].to_numpy(float) / STEPS - LIMIT, steps["n"].to_numpy(float))
    clean = known.filter("label = 0").filter(best > 0).agg(F.avg(rate * best - F.ln("n_tokens")).alias("m")).first()["m"]
    log_k = 0.0 if clean is None else clean - _EULER
    floor = F.ln(F.greatest("n_tokens", F.lit(1))) + log_k
    over = lambda df: F.aggregate(
        F.filter("segments", lambda s: rate * s["score"] > floor), F.lit(0.0), lambda a, s: a + rate * s["score"] - floor
    )
    many = F.size(F.filter("segments", lambda s: rate * s["score"] > floor))
    evidence = F.when(many > 0, over(found)).when(best > 0, F.greatest(rate * best - floor, F.lit(LOWEST))).otherwise(F.lit(LOWEST))
    evidence = F.greatest(evidence, F.lit(LOWEST))
    bins = (
        known.select(F.round(F.least(evidence, F.lit(HIGHEST)) * BINS).cast("int").alias("bin"), "label").groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").toPandas()  # 150 * BINS + 1 rows at most
    )
    n, ones = bins["n"].to_numpy(float), bins["ones"].to_numpy(float)
    if not len(bins) or ones.sum() in (0, n.sum()):
        chance = F.lit(float(ones.sum() / n.sum()) if len(bins) else 0.5)
    else:
        a, b = _logistic(bins["bin"].to_numpy(float) / BINS, n, ones)
        chance = 1 / (1 + F.exp(-(a + b * F.col("evidence"))))
    keep = [c for c in found.columns if c not in ("evidence", "n_significant", "score", "steps")]
    return found.select(*keep, evidence.alias("evidence"), many.alias("n_significant")).withColumn("score", chance)
