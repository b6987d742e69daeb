"""Near duplicates by a chosen-path set similarity join, contracted to connected components.

A text's set is its distinct five-word shingles (with fewer words, the whole sequence). Texts are linked if
100 * |A and B| >= percent * |A or B|; a component's smallest id names it.

1. Texts with equal sets form one class, found by a hash of the whole set; the smallest id stands for it from then on.
2. Every class gets SIGNATURE minwise values and a 128-bit sketch, one bit of each of these and of as many more.
3. TREES independent trees branch the classes. A node picks each signature coordinate with probability
   1 / (similarity * SIGNATURE), by a hash of its path; classes with the same minwise value there go on together. A pair
   at the threshold meets in one child on average, a pair far below it dies out. A first branch depends on the coordinate
   alone, so trees that pick the same one share it.
4. Nodes of at most SMALL classes (SMALLER further down) are compared exhaustively. In a larger one, every class is compared with one of them, the pivot:
   the class that shares most values with others, which is the common origin in a group of near copies. That is
   one comparison a class, however large the node.
   Classes that share fewer first nodes with others than linked classes do (chance below MISSED) end here: texts with one common line.
5. Links are contracted to components. Larger nodes that still hold several components branch on, and only
   classes of different components are compared from then on. At the first of these levels, what stands around a node's pivot is
   told apart by the values in which it differs from the pivot: classes that differ from it but not from each other share such a
   value, and each class has few of them. So those next to a pivot, most of a group of near copies, branch by these alone; classes
   further away from the pivot (at which two classes can be linked although one is not like the pivot) branch as before. After WIDE levels a node follows one path only, by more
   and more coordinates at once, so the work no longer grows. A node ends when it is one component, or when it is small, or when at most FEW classes stand
   outside its largest component: these are compared with all. After LEVELS branchings links are contracted again, and
   so on until no node is left. Nothing is capped.
6. A comparison is first estimated from sketches, with a margin of five standard deviations, then confirmed on full sets,
   which are made once from the texts of the ids concerned (found with a bit filter of bounded size, so texts never shuffle).

So a group of near copies costs its size times the trees, not its square. A pair at exactly the threshold that meets only small
nodes is missed with a chance below 1e-6 (by its sketch); of those that have to go down two levels more, one in 2,000. Below that, single pairs at
the threshold inside a dense group can be missed (each further level halves their chances), but a class is lost to its group only if that
holds for all its links, the pivots' included.

Defined cases: null text, or one without a word, has an empty set and no links. Rows that repeat an id are taken as
different texts under one id. A null id is a document of its own without links (component null). Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C

WORDS = 5
PERCENT = 75
SIGNATURE = 64
TREES = 16
SMALL = 48  # classes in a first node that are compared exhaustively
SMALLER = 24  # and in nodes further down, of which there are more
FEW = 6  # classes outside a node's largest component that are compared with all others
WIDE = 2  # levels in which a node picks each coordinate by chance
LEVELS = 12  # branchings between two contractions
MISSED = 1e-7  # chance at which a class with a link counts as one that has none, by its first nodes


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, end to end, and where each row begins."""
    words, row = C.word_hashes(column, 5)
    n = len(column)
    at = C.span_of_rows(row, n)
    count = np.diff(at)
    lengths = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    total = int(lengths.sum())
    owner = np.repeat(np.arange(n), lengths)
    start = at[owner] + np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes = np.zeros(total, np.uint64)
    width = np.minimum(count, WORDS)[owner]
    for i in range(WORDS):
        inside = i < width
        step = hashes * np.uint64(0x9FB21C651E98DF25) + words[np.where(inside, start + i, 0)] if len(words) else hashes
        hashes = np.where(inside, C.mix(step), hashes)
    hashes = C.mix(hashes + width.astype(np.uint64))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(total, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def _minima(hashes: np.ndarray, begin: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least value of every row under each of the seeded hash functions; rows must not be empty."""
    out = np.empty((len(begin) - 1, len(seeds)), np.uint64)
    spread = hashes.copy()
    for j, seed in enumerate(seeds):
        x = spread * (seed | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[:, j] = np.minimum.reduceat(x, begin[:-1])
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("id", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()), ("s0", pa.int64()), ("s1", pa.int64()),
        ("signature", pa.list_(pa.int32())),
    ])
    seeds = C.seeded(31, 128)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for part in C.slices(batches):
        hashes, begin = _shingles(part.column("text"))
        size = np.diff(begin)
        full = np.flatnonzero(size)
        n = part.num_rows
        signature = np.zeros((n, SIGNATURE), np.int32)
        sketch = np.zeros((n, 2), np.int64)
        prints = np.zeros((n, 2), np.uint64)
        if len(full):
            at = np.r_[begin[full], begin[-1]]
            least = _minima(hashes, at, seeds)
            signature[full] = (least[:, :SIGNATURE] ^ (least[:, :SIGNATURE] >> np.uint64(32))).astype(np.uint32).view(np.int32)
            one = (least >> np.uint64(17)) & np.uint64(1)
            sketch[full] = np.stack([(one[:, :64] * powers).sum(axis=1), (one[:, 64:] * powers).sum(axis=1)], 1).astype(np.uint64).view(np.int64)
            for j, seed in enumerate(C.seeded(33, 2)):  # two independent 64-bit sums over the set
                prints[full, j] = np.add.reduceat(C.mix(hashes ^ seed), at[:-1])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SIGNATURE, pa.int32()), pa.array(signature.ravel()))
        raw = pa.array([x.tobytes() for x in prints], pa.binary())
        yield C.batch(schema, part.column("id"), size.astype(np.int64), raw, sketch[:, 0].copy(), sketch[:, 1].copy(), flat)


def _sets(shared):
    """Full sets of the rows whose id passes a bit filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            known = np.flatnonzero(part.column("id").is_valid().to_numpy(zero_copy_only=False))
            live = C.passes(shared.value, part.column("id").fill_null(0).to_numpy()[known])
            for some in C.slices([part.take(pa.array(known[live]))]):
                hashes, begin = _shingles(some.column("text"))
                sets = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column("id"), sets], names=["id", "shingles"])

    return run


def _confirmed(percent: int) -> Column:
    """Whether two full sets, ``left`` and ``right``, are linked."""
    both = F.size(F.array_intersect("left", "right"))
    return 100 * both >= percent * (F.size("left") + F.size("right") - both)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in edges ``(a, b)``: large stars and small stars in turn until nothing moves."""
    now = C.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count_if(F.col("b") < F.col("a")).alias("lower"))
        if around.filter("lower > 1 OR (low < a AND high > a)").isEmpty():  # every id is a root, or has one link, to a root
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        least = around.select("a", F.least("low", "a").alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = C.stored(large.filter("a != b").distinct(), "large-star")
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        now = C.stored(small.filter("a != b").distinct(), "small-star")


def _picked(path: Column, level: int, percent: int) -> Column:
    """The coordinates that a node picks by a hash of its path, each with probability 100 / (percent * SIGNATURE)."""
    coordinates = F.sequence(F.lit(0), F.lit(SIGNATURE - 1))
    return F.filter(coordinates, lambda i: F.pmod(F.xxhash64(path, i, F.lit(level)), F.lit(percent * SIGNATURE * 1000)) < 100_000)


def _apart(x: str, y: str) -> Column:
    """How many of the 128 bits of two sketches differ."""
    return F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))) + F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1")))


def _bounds(percent: int) -> tuple[float, float]:
    """Differing bits below which a class is next to another one, and above which the two cannot be linked."""
    expected = 128 * (100 - percent) / 200
    return 0.75 * expected, expected + 5 * (expected * (1 - (100 - percent) / 200)) ** 0.5


def _alike(percent: int) -> Column:
    """Whether the classes ``x`` and ``y`` can be linked, by their sizes and sketches."""
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    return sizes & (_apart("x", "y") <= _bounds(percent)[1])


def _pair() -> list[Column]:
    return [F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")]


def _within(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of likely links in one node but different components, from rows ``node, m, all, outside``: every class of a
    node that is compared exhaustively (``all``), else those ``outside`` its largest component, with every other class."""
    x = nodes.filter("all OR outside").select("node", F.col("m").alias("x"), "all")
    y = nodes.select("node", F.col("m").alias("y"))
    once = ~F.col("all") | (F.col("x.id") < F.col("y.id"))
    return x.join(y, "node").filter(once & (F.col("x.c") != F.col("y.c")) & _alike(percent)).select(*_pair())


def _star(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of likely links between the members of a node and its pivot."""
    pairs = nodes.select(F.col("m").alias("x"), F.col("pivot").alias("y"))
    return pairs.filter((F.col("x.c") != F.col("y.c")) & _alike(percent)).select(*_pair())


class _Links:
    """Links found so far, contracted to labels ``(id, component)``; the full sets read so far, each once."""

    def __init__(self, texts: DataFrame, percent: int):
        self.texts, self.percent = texts, percent
        self.labels: DataFrame | None = None
        self.sets: DataFrame | None = None

    def labelled(self, classes: DataFrame) -> DataFrame:
        """``classes`` with ``c``, the component of ``id``."""
        if self.labels is None:
            return classes.withColumn("c", F.col("id"))
        return classes.join(self.labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")

    def add(self, pairs: DataFrame) -> None:
        """Confirm pairs ``(a, b)`` on full sets, and contract."""
        pairs = C.stored(pairs.distinct(), "pairs")
        wanted = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("id"), "id", "left_anti")
        wanted = C.stored(wanted, "wanted")
        if not wanted.isEmpty():
            shared = self.texts.sparkSession.sparkContext.broadcast(C.bit_filter(wanted))  # 32 MB at most
            found = self.texts.select("id", "text").mapInArrow(_sets(shared), "id long, shingles array<long>")
            found = C.stored(found.join(wanted, "id", "left_semi"), "sets")
            self.sets = found if self.sets is None else self.sets.unionByName(found)
        if pairs.isEmpty():
            return
        links = C.stored(
            pairs.join(self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
            .join(self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
            .filter(_confirmed(self.percent))
            .select("a", "b"),
            "confirmed",
        )
        if links.isEmpty():
            return
        if self.labels is not None:
            links = links.unionByName(self.labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        self.labels = components(links)


def _several(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold several components, with what is known of the node: ``size``, ``others`` (rows outside its
    largest component, ``main``) and ``pivot``."""
    order = F.struct("m.ties", -F.col("m.id"))
    parts = rows.groupBy("node", "m.c").agg(F.count("*").alias("n"), F.max_by("m", order).alias("pivot"))
    nodes = parts.groupBy("node").agg(
        F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("others"), F.max_by("c", F.struct("n", -F.col("c"))).alias("main"),
        F.max_by("pivot", F.struct("pivot.ties", -F.col("pivot.id"))).alias("pivot"),
    )
    return rows.join(nodes.filter("others > 0"), "node")


def _first_coordinates(spark, trees: int, percent: int) -> list[tuple[int, int]]:
    """``(tree, coordinate)`` of every first branch."""
    roots = spark.range(1, trees + 1).select(F.xxhash64(F.lit(17), "id").alias("tree"))
    picked = roots.select("tree", F.explode(_picked(F.col("tree"), 0, percent)).alias("at"))
    return [(r["tree"], r["at"]) for r in picked.collect()]  # trees * 1.3 rows


def _per_tree(nodes: DataFrame, first: list[tuple[int, int]]) -> DataFrame:
    """First nodes once for every tree that picks their coordinate."""
    trees = F.array(*(F.struct(F.lit(tree).alias("tree"), F.lit(at).alias("at")) for tree, at in first))
    own = F.filter(trees, lambda t: F.xxhash64(t["at"], F.element_at("signature", t["at"] + 1)) == F.col("node"))
    return nodes.withColumn("own", F.explode(own)).withColumn("node", F.xxhash64("node", "own.tree")).drop("own")


def _branch(nodes: DataFrame, level: int, percent: int) -> DataFrame:
    """Nodes one level down."""
    value = lambda at: F.element_at("signature", at + 1)
    if level <= WIDE:
        nodes = nodes.withColumn("at", F.explode(_picked(F.col("node"), level, percent)))
        return nodes.withColumn("node", F.xxhash64("node", "at", value(F.col("at")))).drop("at")
    picks = [F.pmod(F.xxhash64("node", F.lit(level), F.lit(i)), F.lit(SIGNATURE)).cast("int") for i in range(level - 1)]
    return nodes.withColumn("node", F.xxhash64("node", *(value(p) for p in picks)))


def _signed(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of nodes with the signature of their class."""
    return rows.withColumn("id", F.col("m.id")).join(members.select("id", "signature"), "id").drop("id")


def _around(nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The classes around each pivot in nodes of the values in which they differ from it. Nodes of one pivot do this once."""
    around = nodes.filter(_apart("m", "pivot") <= _bounds(percent)[1]).select(F.col("pivot.id").alias("p"), "m").distinct()
    pivots = members.select(F.col("id").alias("p"), F.col("signature").alias("_pivot"))
    values = F.transform("signature", lambda v, i: F.when(v != F.get("_pivot", i), F.xxhash64(F.lit(23), "p", i, v)))
    return _signed(around, members).join(pivots, "p").select(F.explode(F.array_compact(values)).alias("node"), "m")


def _descend(
    nodes: DataFrame, members: DataFrame, level: int, percent: int, first: list[tuple[int, int]]
) -> tuple[DataFrame, DataFrame, int]:
    """Up to LEVELS branchings: the pairs to confirm, ``node, id, ties`` of nodes that are still open, and the level reached.

    What stands next to a pivot branches alike in all trees that share a first node; only classes ``further`` away go on once a tree.
    The rows of a branching are written before their nodes are looked at, as these are grouped and then joined: they are made once.
    """
    closed, wide = [], []
    for _ in range(LEVELS):
        level += 1
        if level == 1:
            further = nodes.filter(_apart("m", "pivot") > _bounds(percent)[0])
            below = _branch(_per_tree(_signed(further, members), first), level, percent).select("node", "m")
            below = below.unionByName(_around(nodes, members, percent))
        else:
            below = _branch(_signed(nodes, members), level, percent).select("node", "m")
        nodes = C.stored(_several(C.stored(below, "branched")), "nodes")
        all_ = F.col("size") <= SMALLER
        ended = all_ | (F.col("others") <= FEW)
        closed.append(nodes.filter(ended).select("node", "m", all_.alias("all"), (F.col("m.c") != F.col("main")).alias("outside")))
        nodes = nodes.filter(~ended)
        wide.append(nodes.select("m", "pivot"))
        if nodes.isEmpty():
            break
    pairs = _within(reduce(DataFrame.unionByName, closed), percent).unionByName(_star(reduce(DataFrame.unionByName, wide), percent))
    return pairs, nodes.select("node", "m.id", "m.ties"), level


def _least_shared(coordinates: int, percent: int) -> int:
    """The number of coordinates of which linked classes agree in fewer with a chance below MISSED only."""
    p, chance = percent / 100, 0.0
    for n in range(coordinates + 1):
        chance += comb(coordinates, n) * p**n * (1 - p) ** (coordinates - n)
        if chance >= MISSED:
            return n
    return coordinates


def _first_nodes(classes: DataFrame, coordinates: list[int], percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs from the first branches, and ``node, id, ties`` of the large nodes. Narrow rows find the nodes with several classes.

    A class that shares too few of its first nodes with any other has no link to find: it does not branch on.
    """
    branch = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.element_at("signature", i + 1).alias("value")) for i in coordinates)))
    rows = classes.select("id", branch.alias("p")).select("id", F.xxhash64("p.at", "p.value").alias("node"))
    sizes = C.stored(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "node-sizes")
    rows = C.stored(rows.join(sizes, "node"), "first-nodes")
    ties = rows.groupBy("id").agg(F.sum(F.when(F.col("size") > SMALL, F.col("size"))).alias("ties"), F.count("*").alias("shared"))
    going = ties.filter(F.col("ties").isNotNull() & (F.col("shared") >= _least_shared(len(coordinates), percent))).select("id", "ties")
    member = F.struct("id", "n", "s0", "s1", F.col("id").alias("c"), F.coalesce("ties", F.lit(0).cast("long")).alias("ties")).alias("m")
    members = classes.select("id", "n", "s0", "s1").join(ties.filter("ties IS NOT NULL"), "id", "left").select("id", member)
    few = rows.filter(F.col("size") <= SMALL).join(members, "id").select("node", "m", F.lit(True).alias("all"), F.lit(True).alias("outside"))
    many = rows.filter(F.col("size") > SMALL).select("node", "id")
    pivots = _several(many.join(members, "id").select("node", "m"))
    return _within(few, percent).unionByName(_star(pivots, percent)), many.join(going, "id")


def linked_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """``(id, n_shingles, component)`` for every row with an id: the result of the module."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    every = C.stored(
        texts.mapInArrow(_signatures, "id long, n_shingles long, print binary, s0 long, s1 long, signature array<int>"), "signatures"
    )
    some = every.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = C.stored(
        some.groupBy("print", F.col("n_shingles").alias("n")).agg(
            F.min(F.struct("id", "s0", "s1", "signature")).alias("first")
        ).select("print", "n", "first.*"),
        "classes",
    )
    first = _first_coordinates(spark, trees, percent)
    work = _Links(texts, percent)
    pairs, large = _first_nodes(classes, sorted({i for _, i in first}), percent)
    large = C.stored(large, "large-nodes")
    work.add(pairs)
    level = 0
    members = classes.select("id", "n", "s0", "s1", "signature")
    while not large.isEmpty():
        members = C.stored(members.join(large.select("id").distinct(), "id", "left_semi"), "members")
        whole = work.labelled(large.join(members.drop("signature"), "id"))
        nodes = C.stored(_several(whole.select("node", F.struct("id", "n", "s0", "s1", "c", "ties").alias("m"))), "open-nodes")
        pairs, large, level = _descend(nodes, members, level, percent, first)
        work.add(pairs)
    joined = classes.select("print", "n", "id")
    if work.labels is not None:
        joined = joined.join(work.labels, "id", "left").select("print", "n", F.coalesce("component", "id").alias("component"))
    else:
        joined = joined.select("print", "n", F.col("id").alias("component"))
    return (
        every.select("id", "n_shingles", "print")
        .join(joined.withColumnRenamed("n", "n_shingles"), ["print", "n_shingles"], "left")
        .select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    )
