"""Periodic runs, byte shards and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_helpers import SCHEMA, documents, empty, rows
from pyspark.sql import functions as F

from rxspark.llm import periodic_runs, queries, resampling, sharding
from rxspark.llm.suffix_tree import SuffixTree

# --- periodic runs


def brute_runs(w, least, exponent):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - start + q
            smallest = all(any(w[start + k] != w[start + k + d] for k in range(size - d)) for d in range(1, q))
            if i > start and size >= max(least, exponent * q) and smallest:
                out.append((start, size, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_suffix_tree():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 25))]
        tree, n = SuffixTree(s), len(s)
        assert sorted(range(n + 1), key=lambda i: s[i:]) == sorted(range(n + 1), key=lambda i: tree.rank[i])
        for i in range(n + 1):
            for j in range(i + 1, n + 1):
                same = next((k for k in range(n - j) if s[i + k] != s[j + k]), n - j)
                assert tree.common([i], [j])[0] == same


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (1, 3), (10, 2)])
def test_runs(least, exponent):
    rng = random.Random(least)
    for _ in range(2500):
        w = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        if w and rng.random() < 0.4:
            a, p = rng.randrange(len(w)), rng.randint(1, 8)
            w = [x if i < a else w[a + (i - a) % min(p, len(w) - a)] for i, x in enumerate(w)]
        assert [tuple(r) for r in periodic_runs.runs_of(w, least, exponent).tolist()] == brute_runs(w, least, exponent), w


def test_long_texts_have_whole_runs():
    rng = random.Random(8)
    for n, p in ((60_000, 1), (60_000, 7), (60_000, 13_000)):
        base = [rng.randint(1, 5000) for _ in range(p)]
        w = [0] * 50 + [base[i % p] for i in range(n)] + [-1]
        assert (50, n, p) in [tuple(r) for r in periodic_runs.runs_of(w).tolist()]


def test_find_runs_odd_rows(spark):
    got = periodic_runs.find_runs(documents(spark).withColumn("runs", F.lit("x"))).collect()
    assert len(got) == len(rows())
    for r in got:
        w = (r.text or "").encode().split()
        runs = brute_runs(w, 6, 4)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == runs
        assert r.collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert any(r.runs for r in got)
    assert periodic_runs.find_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.find_runs(documents(spark), exponent=1)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_runs_query(spark, tmp_path):
    documents(spark, n=200).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in rows(n=200):
        w = (text or "").encode().split()
        n = len(w)
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w, 6, 4)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = [sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())]
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest))
    key = lambda r: (r[0] is None, r[0] or 0, r[6:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs for r in got) > 10


# --- shards


def test_shards(spark):
    docs = sharding.measured(documents(spark, n=300)).withColumn("shard", F.lit("clash"))
    got = sharding.assign(docs, ["doc_id", "size", "text_crc32"], shards=7).collect()
    assert len(got) == len(rows(n=300))
    got.sort(key=lambda r: r.position)
    total, before, slots = sum(r["size"] for r in got), 0, Counter()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32)
    assert [key(r) for r in got] == sorted(map(key, got))
    held = Counter()
    for place, r in enumerate(got):
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.position) == (len(raw) + 16, zlib.crc32(raw), place)
        assert r.shard == min((2 * before + r["size"]) * 7 // (2 * total), 6)
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
        held[r.shard] += r["size"]
        before += r["size"]
    widest = max(r["size"] for r in got)
    assert all(abs(held[s] - total / 7) <= widest for s in range(7))


def test_shards_of_equal_rows_few_rows_and_none(spark):
    same = spark.createDataFrame([(1, "same text")] * 500, "doc_id long, text string").repartition(5)
    got = sharding.assign(sharding.measured(same), shards=40).collect()
    assert sorted(r.position for r in got) == list(range(500))
    assert set(Counter(r.shard for r in got).values()) <= {12, 13}
    few = sharding.assign(sharding.measured(same.limit(3)), shards=40).collect()
    assert [r.slot for r in few] == [0, 0, 0] and len({r.shard for r in few}) == 3
    assert sharding.assign(sharding.measured(empty(spark))).count() == 0
    with pytest.raises(ValueError, match="one shard"):
        sharding.assign(sharding.measured(same), shards=0)


def test_written_shards(spark, tmp_path):
    docs = sharding.measured(documents(spark, n=100))
    back = sharding.write(docs, str(tmp_path / "shards"), ["doc_id", "size", "text_crc32"], shards=5, pieces=2)
    placed = sharding.assign(docs, ["doc_id", "size", "text_crc32"], shards=5)
    columns = ["doc_id", "text", "shard", "slot", "position"]
    key = lambda r: r[4]
    # equal rows may change places: compare what each place holds
    assert sorted(back.select(columns).collect(), key=key) == sorted(placed.select(columns).collect(), key=key)


# --- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w + [" ".join(x) for x in zip(w, w[1:], strict=False)]


def bucket(gram, buckets=10_000):
    return zlib.crc32(gram.encode()) % buckets


def test_bucket_of_every_feature(spark):
    import pyarrow as pa

    texts = [t for _, t, *_ in rows()] + ["A" * 200 + " " + "é" * 70 + " x", "a\n\n b\nc d", "x" * 65 + "\n" + "y" * 64]
    row, words, pair_row, pairs, cross = resampling.features(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert [*words[row == i], *pairs[pair_row == i]] == [bucket(g) for g in grams(text)]
    last = len(texts) - 2
    assert cross[pair_row == last].tolist() == [True, True, False]


def test_counts_by_lines(spark):
    extra = [(2000 + i, f"Repeated line here\n\nown {i} line\nRepeated line here", *[None] * 8) for i in range(20)]
    docs = documents(spark).unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {r.bucket: r.n for r in resampling.count(docs).collect()}
    want = Counter(bucket(g) for _, t, *_ in [*rows(), *extra] for g in grams(t))
    assert got == want
    assert resampling.count(empty(spark)).count() == 0


def test_draw(spark):
    docs, target = documents(spark, n=150), [" ".join(t.split()[:40]) for _, t, *_ in rows()[:9] if t]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    gain = resampling.gains(resampling.count(docs), resampling.count(aims))
    got = resampling.draw(resampling.weigh(docs.withColumn("rank", F.lit(9)), gain)).collect()
    s, t = Counter(), Counter()
    for counts, texts in ((s, [r[1] for r in rows(n=150)]), (t, target)):
        for text in texts:
            counts.update(map(bucket, grams(text)))
    n_s, n_t = s.total(), t.total()
    gains = [math.floor(1000 * math.log((t[b] + 1) * float(n_s + 10_000) / ((s[b] + 1) * float(n_t + 10_000)))) for b in range(10_000)]
    able = []
    assert len(got) == len(rows(n=150))
    for r in got:
        own = grams(r.text)
        assert r.n_features == len(own) and r.weight == (sum(gains[bucket(g)] for g in own) // len(own) if own else 0)
        if r.doc_id is None:
            assert r.score is None and r.rank is None
            continue
        h = int(hashlib.sha256(f"7:{r.doc_id}".encode()).hexdigest()[:8], 16)
        assert r.score == r.weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if r.n_words >= 20:
            able.append(r)
        else:
            assert r.rank is None
    able.sort(key=lambda r: (-r.score, r.doc_id))
    drawn = 25 * len(able) // 100
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, drawn + 1))
    assert [(r.score, r.doc_id) for r in ranked] == [(r.score, r.doc_id) for r in able[:drawn]]


def test_draw_from_nothing(spark):
    gain = resampling.gains(resampling.count(empty(spark)), resampling.count(empty(spark)))
    assert [r.gain for r in gain.distinct().collect()] == [0]
    assert resampling.draw(resampling.weigh(empty(spark), gain)).count() == 0
