"""Exact removal of repeated byte strings across documents, by suffix arrays over bounded blocks.

A start of a ``length``-byte window is *repeated* if an equal window starts earlier: in a row of smaller id, or in the
same row at a smaller place. Every byte of a repeated window goes. How the corpus is cut so that no block is large:

1. Each window selects its k-gram of the least hash (leftmost of equals). Equal windows select the same k-gram at the
   same place inside them, so windows need comparing only where they share the hash of that *anchor*. Neighbouring
   windows share an anchor; their union, the anchor's *context*, is at most 2 * length - k bytes.
2. Equal contexts are one class: all but the first occurrence are repeated throughout. A task settles its own copies
   before it shuffles, so a text copied a million times costs one row per task and anchor.
3. Only anchors with several different contexts need bytes. A group's contexts are trimmed to what another context of
   the group shares; they stand end to end in small blocks, and each block gets a suffix array by linear grouping
   (``suffix_array``). Runs of equal windows in it tell the first occurrence from the repeated ones.
4. An anchor with over BLOCK_CONTEXTS contexts is cut into several blocks; the first occurrence of each of their
   windows then meets those of the other blocks in a Spark aggregation. Nothing is capped.

Defined cases: null or empty text has no windows; texts shorter than ``length`` stay whole; rows without an id stay as
they are and count for nothing; rows that share an id are each cut by all spans found under it, and of two such rows
with the same window at the same place neither is earlier. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C
from rxspark.llm.suffix_array import equal_windows

BLOCK_CONTEXTS = 2000  # contexts of one anchor that share a block
BLOCK_BYTES = 8192  # groups of contexts are put together up to this size
PIECE = 1 << 21  # starts of a long text looked at together
FLUSH = 1 << 20  # anchors a task holds before it settles its own copies

_CANDIDATES = "h long, fp long, id long, a int, shape int"
_FOUND = "kind int, h long, block int, id long, a int, shape int"
_CONTEXTS = "h long, block int, hot boolean, id long, a int, at int, bytes binary"
_REPEATS = "kind int, h long, window long, id long, a int, n int"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _gram(length: int) -> int:
    return max(1, min(32, length * 8 // 25))


def _anchors(data: np.ndarray, begin: np.ndarray, length: int):
    """Anchors of concatenated texts: row, first and last start that select them, place of the anchor, two hashes."""
    k = _gram(length)
    width = length - k + 1
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + length - 1]
        if len(piece) < length:
            break
        rolling = C.RollingHash(piece, 1)
        grams = C.mix(rolling.all_of(k))
        low = np.uint64((1 << 22) - 1)
        best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if width > span:
            best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
        row = np.searchsorted(begin, at + np.arange(len(best)), "right") - 1
        start = np.flatnonzero(at + np.arange(len(best)) + length <= begin[row + 1])
        if not len(start):
            continue
        place = (best[start] & low).astype(np.int64)
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 1))
        a, e, p = start[np.r_[0, cut + 1]], start[np.r_[cut, len(start) - 1]], place[np.r_[0, cut + 1]]
        fp = rolling(a, e + length) + C.mix(((p - a) * 4096 + (e - a)).astype(np.uint64))
        r = row[a]
        shift = at - begin[r]
        yield r, a + shift, e + shift, p + shift, grams[p], C.mix(fp)


def _ranges(ids: np.ndarray, a: np.ndarray, e: np.ndarray):
    """Union of ranges of starts per id, for ranges that touch or overlap."""
    if not len(ids):
        return ids, a, e
    order = np.lexsort((e, a, ids))
    ids, a, e = ids[order], a[order], e[order]
    first = np.r_[True, ids[1:] != ids[:-1]]
    reach = e + (np.cumsum(first) << 32)  # keeps documents apart in one running maximum
    reach = np.maximum.accumulate(reach)
    new = first | np.r_[True, a[1:] + (np.cumsum(first)[1:] << 32) > reach[:-1] + 1]
    at = np.flatnonzero(new)
    return ids[at], a[at], (reach & 0xFFFFFFFF)[np.r_[at[1:], len(ids)] - 1]


def _elsewhere(new: np.ndarray, ids: np.ndarray, a: np.ndarray, first: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Which rows of classes stand at another id or place than the first of their class.

    ``new`` marks where classes begin; rows before the first mark go on with a class whose first row is ``first``.
    """
    own = np.cumsum(new)
    return (np.r_[first[0], ids[new]][own] != ids) | (np.r_[first[1], a[new]][own] != a)


def _candidates(length: int):
    schema = _arrow(_CANDIDATES)

    def settle(held):
        h, fp, ids, a, e, p = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((a, ids, fp, h))
        h, fp, ids, a, e, p = (x[order] for x in (h, fp, ids, a, e, p))
        keep = np.r_[True, (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])]
        yield C.batch(schema, h[keep].view(np.int64), fp[keep].view(np.int64), ids[keep], a[keep].astype(np.int32),
                      ((p - a) * 4096 + (e - a))[keep].astype(np.int32))
        again = _elsewhere(keep, ids, a)
        i, s, t = _ranges(ids[again], a[again], e[again])
        if len(i):
            key = C.mix(i.astype(np.uint64)).view(np.int64)
            yield C.batch(schema, key, np.zeros(len(i), np.int64), i, s.astype(np.int32), (s - t - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in C.slices(batches):
            data, begin = C.text_bytes(part.column("text"))
            ids = part.column("id").to_numpy(zero_copy_only=False)
            for row, a, e, p, h, fp in _anchors(data, begin, length):
                held.append((h, fp, ids[row], a, e, p))
                n += len(a)
            if n >= FLUSH:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, fp, id, a): repeated ranges (kind 0), contexts of shared anchors (1), very common anchors (2)."""
    schema = _arrow(_FOUND)
    last_h = last_fp = None
    first_of = (0, 0)
    count, pending = 0, None
    for part in batches:
        h, fp, ids, a, shape = (part.column(i).to_numpy() for i in range(5))
        ready = shape < 0
        if ready.any():
            yield C.batch(schema, np.zeros(ready.sum(), np.int32), h[ready], np.zeros(ready.sum(), np.int32), ids[ready],
                          a[ready], -shape[ready])
            h, fp, ids, a, shape = (x[~ready] for x in (h, fp, ids, a, shape))
        if not len(h):
            continue
        new_h = np.r_[last_h is None or h[0] != last_h, h[1:] != h[:-1]]
        new = new_h | np.r_[last_fp is None or fp[0] != last_fp, fp[1:] != fp[:-1]]
        x = _elsewhere(new, ids, a, first_of)
        n = int(x.sum())
        if n:
            yield C.batch(schema, np.zeros(n, np.int32), h[x], np.zeros(n, np.int32), ids[x], a[x], shape[x] % 4096 + 1)
        if new_h[0]:
            count, pending = 0, None
        r = np.flatnonzero(new)
        if len(r):
            first_of = (ids[r[-1]], a[r[-1]])
            group = np.cumsum(new_h[r])  # 0: goes on from the batch before
            first = np.searchsorted(group, group)
            index = np.arange(len(r)) - first + np.where(group == 0, count, 0)
            total = np.bincount(group, minlength=group[-1] + 1)
            total[0] += count
            send = r[total[group] > 1]
            idx = index[total[group] > 1]
            rows = [h[send], idx // BLOCK_CONTEXTS, ids[send], a[send], shape[send]]
            if pending is not None and group[0] == 0:
                rows = [np.r_[p, x] for p, x in zip(pending, rows, strict=True)]
                pending = None
            if len(rows[0]):
                yield C.batch(schema, np.ones(len(rows[0]), np.int32), rows[0], rows[1].astype(np.int32), *rows[2:])
            hot = send[idx == BLOCK_CONTEXTS]
            if len(hot):
                zero = np.zeros(len(hot), np.int32)
                yield C.batch(schema, zero + 2, h[hot], zero, ids[hot], zero, zero)
            count = int(total[group[-1]])
            if count == 1:
                x = r[-1]
                pending = (h[x], 0, ids[x], a[x], shape[x])
        last_h, last_fp = h[-1], fp[-1]


def _cut(length: int):
    schema = _arrow(_CONTEXTS)

    def run(batches):
        for part in C.slices(batches):
            data, begin = C.text_bytes(part.column("text"))
            ids = part.column("id").to_numpy()
            lists = part.column("wanted")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            h, block, hot, a, shape = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            at, width = shape // 4096, shape % 4096 + length
            start = begin[owner] + a
            raw = data.tobytes()
            pieces = [raw[s : s + n] for s, n in zip(start.tolist(), width.tolist(), strict=True)]
            yield C.batch(schema, h, block, hot, ids[owner], a, at.astype(np.int32), pa.array(pieces, pa.binary()))

    return run


def _reach(group: np.ndarray, sides: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many leading bytes of its row another row of the same group shares at most; -1 for a row alone."""
    n = len(group)
    keys = np.ascontiguousarray(sides.reshape(n, -1, 8)[:, :, ::-1]).view(np.uint64)[:, :, 0]
    order = np.lexsort([room, *(keys[:, j] for j in range(keys.shape[1] - 1, -1, -1)), group])
    rows, g, r = sides[order], group[order], room[order]
    same = np.concatenate([rows[1:] == rows[:-1], np.zeros((n - 1, 1), bool)], axis=1)
    shared = np.minimum(same.argmin(axis=1), np.minimum(r[1:], r[:-1]))
    shared[g[1:] != g[:-1]] = -1
    reach = np.empty(n, np.int64)
    reach[order] = np.maximum(np.r_[-1, shared], np.r_[shared, -1])
    return reach


def _settle(group, h, hot, ids, a, at, data, begin, length, schema):
    """Repeated ranges among the contexts of whole groups."""
    k = _gram(length)
    n = len(group)
    side = -(-(length - k) // 8) * 8 or 8
    anchor, size = begin[:-1] + at, np.diff(begin)
    left, right = np.minimum(at, side), np.minimum(size - at - k, side)
    padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(side + k, np.uint8)])
    steps = np.arange(side)
    lefts = np.where(steps < left[:, None], padded[(anchor + side - 1)[:, None] - steps], 0).astype(np.uint8)
    rights = np.where(steps < right[:, None], padded[(anchor + side + k)[:, None] + steps], 0).astype(np.uint8)
    left = np.where(hot, at, _reach(group, lefts, left))
    right = np.where(hot, size - at - k, _reach(group, rights, right))
    live = np.flatnonzero((left >= 0) & (right >= 0) & (left + right + k >= length))
    if not len(live):
        return
    start, stop = (anchor - left)[live], (anchor + k + right)[live]
    group, h, hot, ids, left = group[live], h[live], hot[live], ids[live], left[live]
    place = (a + at)[live] - left  # of the trimmed context in its document
    # equal trimmed contexts: the first stands for all
    print_ = C.mix(C.RollingHash(data, 2)(start, stop) + C.mix(left.astype(np.uint64)))
    order = np.lexsort((place, ids, print_, group))
    new = np.r_[True, (np.diff(group[order]) != 0) | (print_[order][1:] != print_[order][:-1])]
    again = order[_elsewhere(new, ids[order], place[order])]
    out = [(ids[again], place[again], (place + (stop - start) - length)[again])]
    rep = order[new]
    rep = rep[np.argsort(group[rep], kind="stable")]
    sizes = (stop - start)[rep]
    g = group[rep]
    ends = np.r_[np.flatnonzero(np.diff(g)) + 1, len(g)]
    begin_of = 0
    total = np.r_[0, np.cumsum(sizes)]
    raw = data.tobytes()
    for i, end in enumerate(ends.tolist()):
        if i + 1 < len(ends) and total[ends[i + 1]] - total[begin_of] <= BLOCK_BYTES:
            continue
        these = rep[begin_of:end]
        if end - begin_of > 1 or hot[these].any():  # the windows of a hot anchor meet those of its other blocks
            yield from _block(raw, start[these], stop[these], ids[these], place[these], h[these], hot[these], length, schema, out)
        begin_of = end
    i, s, e = _ranges(*(np.concatenate(x) for x in zip(*out, strict=True)))
    if len(i):
        zero = np.zeros(len(i), np.int64)
        yield C.batch(schema, zero.astype(np.int32), zero, zero, i, s.astype(np.int32), (e - s + 1).astype(np.int32))


def _block(raw, start, stop, ids, place, h, hot, length, schema, out):
    text = b"".join([raw[s:e] for s, e in zip(start.tolist(), stop.tolist(), strict=True)])
    size = stop - start
    base = np.cumsum(size) - size
    valid = np.ones(len(text), bool)
    valid[np.minimum((base + size)[:, None] - 1 - np.arange(length - 1), len(text) - 1)] = False
    order, kind = equal_windows(text, valid, length)
    owner = np.searchsorted(base, order, "right") - 1
    where = place[owner] + order - base[owner]
    by = np.lexsort((where, ids[owner], kind))
    order, kind, owner, where = order[by], kind[by], owner[by], where[by]
    new = np.r_[True, kind[1:] != kind[:-1]]
    again = _elsewhere(new, ids[owner], where)
    out.append((ids[owner[again]], where[again], where[again]))
    first = new & hot[owner]
    if first.any():
        codes = np.frombuffer(text, np.uint8)
        window = C.mix(C.RollingHash(codes, 3)(order[first], order[first] + length)).view(np.int64)
        n = int(first.sum())
        yield C.batch(schema, np.ones(n, np.int32), h[owner[first]], window, ids[owner[first]],
                      where[first].astype(np.int32), np.ones(n, np.int32))


def _arrays(length: int):
    schema = _arrow(_REPEATS)

    def run(batches):
        held = []

        def flush(table: pa.Table):
            b = table.combine_chunks().to_batches()[0]
            h, block, hot, ids, a, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            data, begin = C.text_bytes(_as_text(b.column("bytes")))
            group = np.cumsum(np.r_[True, (np.diff(h) != 0) | (np.diff(block) != 0)])
            yield from _settle(group, h, hot, ids, a.astype(np.int64), at.astype(np.int64), data, begin, length, schema)

        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 16384:
                continue
            table = pa.Table.from_batches(held)
            h, block = table.column("h").to_numpy(), table.column("block").to_numpy()
            cut = np.flatnonzero((np.diff(h) != 0) | (np.diff(block) != 0))
            if not len(cut):
                continue
            cut = int(cut[-1]) + 1
            yield from flush(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _as_text(column: pa.Array) -> pa.Array:
    """A binary column seen as a string column (same buffers, nothing decoded)."""
    return pa.Array.from_buffers(pa.string(), len(column), column.buffers(), offset=column.offset)


def _apply(length: int, as_text: bool):
    schema = pa.schema([("kept", pa.string() if as_text else pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        for part in C.slices(batches):
            data, begin = C.text_bytes(part.column("text"))
            lists = part.column("ranges")
            owner = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))
            a, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
            size = np.diff(begin)[owner]
            fits = a < size  # rows that share an id may be shorter than the row a span was found in
            owner, a, n, size = owner[fits], a[fits], n[fits], size[fits]
            i, s, e = _ranges(owner, a, np.minimum(a + n - 1 + length, size) - 1)
            gone = np.zeros(len(data) + 1, np.int8)
            gone[begin[i] + s] += 1
            np.subtract.at(gone, begin[i] + e + 1, 1)
            stay = np.cumsum(gone[:-1], dtype=np.int8) == 0
            left = data[stay].tobytes()
            to = np.r_[0, np.cumsum(stay)][begin].tolist()
            spans = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e + 1, pa.int32())], ["start", "end"])
            offsets = np.searchsorted(i, np.arange(len(lists) + 1)).astype(np.int32)
            pieces = [left[x:y] for x, y in zip(to, to[1:], strict=False)]
            columns = [
                pa.array([x.decode("utf-8", "ignore") for x in pieces] if as_text else pieces, schema.field("kept").type),
                pa.ListArray.from_arrays(pa.array(offsets), spans),
            ]
            yield pa.RecordBatch.from_arrays([part.column("row"), *columns], names=["row", *schema.names])

    return run


def repeated_ranges(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``(id, a, n)``: the windows that start at a .. a + n - 1 of that document also start earlier."""
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    found = C.stored(
        texts.filter(F.octet_length("text") >= length)
        .mapInArrow(_candidates(length), _CANDIDATES)
        .repartition("h")
        .sortWithinPartitions("h", "fp", "id", "a")
        .mapInArrow(_repeats, _FOUND),
        "repeats",
    )
    common = found.filter("kind = 2").select("h", F.lit(True).alias("hot"))
    wanted = (
        found.filter("kind = 1")
        .join(common, "h", "left")
        .groupBy("id")
        .agg(F.collect_list(F.struct("h", "block", F.coalesce("hot", F.lit(False)).alias("hot"), "a", "shape")).alias("wanted"))
    )
    settled = C.stored(
        texts.join(wanted, "id")
        .select("id", "text", "wanted")
        .mapInArrow(_cut(length), _CONTEXTS)
        .repartition("h", "block")
        .sortWithinPartitions("h", "block")
        .mapInArrow(_arrays(length), _REPEATS),
        "windows",
    )
    windows = settled.filter("kind = 1")
    earliest = windows.groupBy("h", "window").agg(F.min(F.struct("id", "a")).alias("first"), F.count("*").alias("times"))
    across = (
        windows.join(earliest.filter("times > 1"), ["h", "window"])
        .filter(F.struct("id", "a") != F.col("first"))
        .select("id", "a", "n")
    )
    return (
        found.filter("kind = 0")
        .select("id", "a", F.col("shape").alias("n"))
        .unionByName(settled.filter("kind = 0").select("id", "a", "n"))
        .unionByName(across)
    )


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 100, as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes) and ``spans`` (removed byte ranges, end exclusive), one row each.

    ``as_text`` gives the remaining text instead; what is left of a character that was cut apart goes as well.
    """
    ranges = repeated_ranges(docs, id, text, length).groupBy("id").agg(F.collect_list(F.struct("a", "n")).alias("ranges"))
    packed = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.struct("*").alias("row"))
    row = packed.schema["row"].dataType.simpleString()
    done = (
        packed.join(ranges, "id", "left")
        .select("row", "text", F.coalesce("ranges", F.expr("CAST(array() AS array<struct<a:int,n:int>>)")).alias("ranges"))
        .mapInArrow(_apply(length, as_text), f"row {row}, kept {'string' if as_text else 'binary'}, spans array<struct<start:int,end:int>>")
    )
    own = ["kept", "spans"]
    return done.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in own), *own)
