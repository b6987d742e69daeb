"""Contiguous shards of near equal bytes, from prefix sums over range partitions; Spark expressions only.

All rows stand in one global order. Row r, with ``before`` bytes ahead of it, goes to the shard in whose equal share of all
bytes its middle falls: floor((2 * before + size) * shards / (2 * total)). So shards follow each other in that order, and the
bytes of a shard differ from an equal share by at most the size of one row (half a row at either end).

1. The narrow rows (id, size, checksum, no text) are sorted by range; every partition becomes a ``part``. They are
   written, so a row keeps its part and place even if executors are lost.
2. Totals per part (one row each) give every part the bytes and rows ahead of it.
3. Inside a part a running sum finishes the prefix. Nothing larger than a part is ever in one task, and rows that are equal in
   every respect spread over parts, since the order ends with the place at which a row was read.

Defined cases: rows without an id come first; equal ids stand by size, checksum, then as read (equal rows can change places
with each other, which no result shows). A null or empty text has OVERHEAD bytes. Fewer rows than shards leave shards empty;
an empty table gives no rows. Up to 9.2e18 / (2 * shards) bytes in all; beyond, the sum raises an error. Output columns
replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxspark.llm import common as C

SHARDS = 40
OVERHEAD = 16
LAW = "bytes"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and OVERHEAD) and ``text_crc32`` (of the UTF-8 bytes; null text as empty)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"size": F.octet_length(raw).cast("long") + OVERHEAD, "text_crc32": F.crc32(raw)})


def assign(docs: DataFrame, order: list[str] | None = None, size: str = "size", shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``position`` (in all), ``shard`` and ``slot`` (in the shard), both counted from 0.

    Rows are as wide as ``docs`` is: leave texts out and join them afterwards, or let ``write`` carry them.
    """
    if shards < 1:
        raise ValueError("one shard at least")
    own = ["position", "shard", "slot"]
    keep = [c for c in docs.columns if c not in own]
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*keep).alias("row"), F.struct(*(order or ["doc_id", size, "text_crc32"])).alias("key"), F.col(size).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("seq"),
    )
    rows = C.stored(rows, "shard-rows")  # the sort samples what it reads: ``seq`` must not change between its passes
    parts = C.stored(rows.sort("key", "seq").withColumn("part", F.spark_partition_id()), "shard-parts")
    totals = parts.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_ahead"), F.sum("bytes").over(whole).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("key", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = 2 * (F.col("bytes_ahead") + F.sum("bytes").over(inside)) - F.col("bytes")
    done = parts.join(starts, "part").select(
        "row",
        (F.col("rows_ahead") + F.count("*").over(inside) - 1).alias("position"),
        middle.alias("middle"), "total",
    )
    shard = F.least(F.expr(f"({shards} * middle) div (2 * total)"), F.lit(shards - 1)).cast("int")
    done = C.stored(done.select("row", "position", shard.alias("shard")), "shard-places")
    firsts = done.groupBy("shard").agg(F.min("position").alias("first"))  # one row a shard
    return done.join(firsts, "shard").select(
        *(F.col("row").getField(c).alias(c) for c in keep), "position", "shard", (F.col("position") - F.col("first")).alias("slot")
    )


def write(docs: DataFrame, path: str, order: list[str], size: str = "size", shards: int = SHARDS, pieces: int = 8) -> DataFrame:
    """Write whole rows below ``path``, a folder ``shard=N`` each, and read them back with ``shard``, ``slot`` and ``position``.

    A shard is written by up to ``pieces`` tasks, each with a contiguous run of its slots in order.
    """
    placed = assign(docs, order, size, shards)
    last = placed.groupBy("shard").agg(F.count("*").alias("_rows"))
    piece = F.expr(f"({pieces} * slot) div _rows").cast("int")
    rows = placed.join(last, "shard").withColumn("_piece", piece).drop("_rows")
    rows = rows.repartition("shard", "_piece").sortWithinPartitions("shard", "slot").drop("_piece")
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
