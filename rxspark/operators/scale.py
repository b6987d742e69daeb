"""Building blocks that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rxspark.session import checkpoint_root, stored


def running_totals(
    df: DataFrame, group: str, block: str, order: list[str], totals: dict[str, Column], span: int = 512
) -> DataFrame:
    """Running sums per ``group`` in (block, order), without one task per group.

    ``block`` is an ascending integer (a page). Sums run inside a block, over blocks inside a span of
    ``span`` blocks, and over spans; only one row per block, then one row per span, leaves each level.
    """
    names = list(totals)
    df = df.withColumns({f"_{n}": totals[n].cast("long") for n in names})
    per_block = df.groupBy(group, block).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    per_block = per_block.withColumn("_span", F.floor(F.col(block) / span))
    per_span = per_block.groupBy(group, "_span").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])

    def before(window) -> dict[str, Column]:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return {f"_{n}_before": F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)) for n in names}

    span_start = per_span.withColumns(before(Window.partitionBy(group).orderBy("_span"))).select(
        group, "_span", *[F.col(f"_{n}_before").alias(f"_{n}_span") for n in names]
    )
    block_start = (
        per_block.withColumns(before(Window.partitionBy(group, "_span").orderBy(block)))
        .join(span_start, [group, "_span"])
        .select(
            group, block, *[(F.col(f"_{n}_before") + F.col(f"_{n}_span")).alias(f"_{n}_start") for n in names]
        )
    )
    inside = Window.partitionBy(group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumns({f"_{n}_inside": F.sum(f"_{n}").over(inside) for n in names})
        .join(block_start, [group, block])
        .withColumns({n: F.col(f"_{n}_inside") + F.col(f"_{n}_start") for n in names})
        .drop(*[f"_{n}{suffix}" for n in names for suffix in ("", "_inside", "_start")])
    )


def previous_value(df: DataFrame, series: list[str], ts: str, value: str, span: str = "1 hour") -> DataFrame:
    """``df`` with ``previous``, the value before each row of its series.

    Rows look back inside their time span; the first row of a span takes the last value of the
    nearest earlier span, found on one row per (series, span).
    """
    order = F.struct(F.col(ts), F.col(value))
    df = df.withColumn("_span", F.window(F.col(ts), span).start)
    last = df.groupBy(*series, "_span").agg(F.max(order).getField(value).alias("_last"))
    carry = last.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(*series).orderBy("_span"))
    ).drop("_last")
    inside = F.lag(value).over(Window.partitionBy(*series, "_span").orderBy(ts, value))
    return (
        df.withColumn("_inside", inside)
        .join(carry, [*series, "_span"])
        .withColumn("previous", F.coalesce("_inside", "_carry"))
        .drop("_span", "_inside", "_carry")
    )


def dense_ids(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """Consecutive numbers 1..n in ``order``, numbered per range partition plus an offset.

    The sorted rows are checkpointed, so the partition of a row is the same for the count and the
    numbering even if executors are lost. The offset table has one row per partition.
    """
    checkpoint_root(df.sparkSession)
    rows = df.sort(*order).withColumn("_seq", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_seq", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    position = F.col("_seq") - F.shiftleft(part, 33)
    return (
        rows.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + position + 1)
        .drop("_part", "_offset", "_seq")
    )


def collect_in_parts(
    df: DataFrame, keys: list[str], item: Column, spread: str, name: str, size: int = 10_000
) -> DataFrame:
    """Sorted array of ``item`` per key and ``part``; a key above ``size`` items gets several parts.

    Ordinary keys have part 0 only. The number of large keys is at most rows / size. ``item`` is never null: items are compared as they
    are, not by the comparison function of ``array_sort``.
    """
    large = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > size)
        .withColumn("_parts", F.ceil(F.col("_n") / size))
        .drop("_n")
    )
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0).cast("long"))
    return (
        df.withColumn("_item", item)
        .join(large, keys, "left")
        .withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list("_item")).alias(name))
    )


def contained_terms(
    texts: DataFrame, text: str, terms: DataFrame, term: str, separators: str = "[/—]", gram: int = 4
) -> DataFrame:
    """Rows (text, term) where ``term`` occurs inside ``text``, by equi-joins.

    Texts are cut at the separators, and only the distinct pieces are searched: a term without a
    separator lies inside one piece, of any other term the longest part does. That part is looked up by its rarest gram: grams
    of the pieces are counted first, and a part meets only the pieces that hold the one gram which the fewest pieces hold. So a gram
    that many terms and many pieces share is no key that all of them meet at. Parts shorter than a gram are one of that length.
    """
    longest = F.array_max(
        F.transform(F.split(F.col(term), separators), lambda p: F.struct(F.length(p).alias("n"), p.alias("part")))
    )["part"]
    probes = terms.select(term).distinct().withColumn("_probe", longest).filter(F.col("_probe") != "")
    sizes = [r["n"] for r in probes.select(F.least(F.length("_probe"), F.lit(gram)).alias("n")).distinct().collect()]  # ``gram`` rows at most
    probes = probes.withColumn("_gram", F.explode(grams(F.col("_probe"), F.least(F.length("_probe"), F.lit(gram)))))
    pieces = texts.select(text).distinct().withColumn("_piece", F.explode(F.array_distinct(F.split(text, separators))))
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col("_piece"), F.lit(n)) for n in sizes]))) if sizes else F.array().cast("array<string>")
    held = stored(pieces.select("_piece").distinct().withColumn("_gram", F.explode(every)), "piece-grams")
    found = (
        held.join(rarest(probes, [term, "_probe"], "_gram", held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))), "_gram")
        .filter(F.contains("_piece", "_probe"))
        .select("_piece", term)
        .distinct()
    )
    return (
        pieces.join(found, "_piece")
        .filter(F.contains(F.col(text), F.col(term)))
        .select(text, term)
        .distinct()
    )


def grams(text: Column, size: Column) -> Column:
    """The different strings of ``size`` characters in a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    whole = F.transform(starts, lambda i: F.substr(text, i, size))
    return F.when(F.length(text) >= size, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))


def rarest(probes: DataFrame, keys: list[str], gram: str, counts: DataFrame) -> DataFrame:
    """For each of ``keys`` the one ``gram`` that ``counts`` (gram, ``_n``) has the fewest of; none if a gram is not there at all."""
    known = probes.join(counts, gram, "left")
    return known.groupBy(*keys).agg(
        F.min_by(gram, F.struct("_n", gram)).alias(gram), F.count_if(F.col("_n").isNull()).alias("_missing")
    ).filter("_missing = 0").drop("_missing")
