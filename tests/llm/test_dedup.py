import random

import numpy as np
import pytest
from llm_helpers import documents, empty, linked, overlap, rows, shingles, without_repeats
from pyspark.sql import functions as F

from rxspark.llm import decontamination, near_dup, suffix_dedup
from rxspark.llm.suffix_array import equal_windows, suffix_array


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(1500):
        size, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 200])
        text = bytes(rng.randrange(letters) for _ in range(size))
        assert suffix_array(text) == sorted(range(size), key=lambda i: text[i:])
    for text in (b"a" * 400, b"ab" * 250, b"abaab" * 90, bytes(range(256)) * 2):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_equal_windows_share_a_class():
    import numpy as np

    text = b"abcabcxabcabc"
    valid = np.arange(len(text)) <= len(text) - 3
    order, kind = equal_windows(text, valid, 3)
    by = {}
    for start, k in zip(order.tolist(), kind.tolist(), strict=True):
        by.setdefault(text[start : start + 3], set()).add(k)
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(kind.tolist()))


def test_repeated_passages_like_window_by_window(spark):
    docs = documents(spark)
    want = without_repeats([(r[0], (r[1] or "").encode()) for r in {x[0]: x for x in rows() if x[0] is not None}.values()])
    got = suffix_dedup.suffix_dedup(docs).select("doc_id", "text", "kept", "spans").collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert bytes(r.kept) == (r.text or "").encode() and not r.spans
        else:
            assert bytes(r.kept) == want[r.doc_id], r.doc_id
            assert sum(e - s for s, e in r.spans) == len((r.text or "").encode()) - len(r.kept)


def test_anchors_of_long_texts_in_pieces(monkeypatch):
    """Looked at in pieces, every window of a long text has the anchor that it has as a whole."""
    rng = random.Random(13)
    texts_ = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (2500, 90, 0, 101, 700)]
    data = np.frombuffer("".join(texts_).encode(), np.uint8)
    begin = np.r_[0, np.cumsum([len(t) for t in texts_])]

    def windows():
        found = [zip(*(x.tolist() for x in part), strict=True) for part in suffix_dedup._anchors(data, begin, 100)]
        return {(r, s): p for part in found for r, a, e, p, _, _ in part for s in range(a, e + 1)}

    whole = windows()
    assert len(whole) == sum(max(0, len(t) - 99) for t in texts_)
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    assert windows().keys() == whole.keys()
    grams = lambda places: [texts_[r][p : p + 32] for (r, _), p in sorted(places.items())]
    assert grams(windows()) == grams(whole)


def test_text_longer_than_a_piece(spark):
    """2.3 MB in one row: passages that it shares with itself and with another row go, the rest stays."""
    rng = random.Random(14)
    prose = lambda n: bytes(rng.choices(b"abcdefghij klmnop", k=n)).decode()
    one, two = prose(140), prose(180)
    long = prose(1000) + one + prose(2_300_000) + two + prose(300) + one + prose(50)
    data = [(1, prose(90) + two + prose(90)), (2, long), (3, None)]
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1] == (data[0][1].encode(), []) and got[3] == (b"", [])
    at = [long.index(two), long.rindex(one)]
    want = [(a, a + len(x)) for a, x in zip(at, (two, one), strict=True)]
    assert got[2][1] == want
    assert got[2][0] == (long[: at[0]] + long[at[0] + 180 : at[1]] + long[at[1] + 140 :]).encode()


def test_common_anchors_meet_across_blocks(spark, monkeypatch):
    """Many different contexts of one anchor fall into several blocks; their windows still meet."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", 3)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef ") for _ in range(130))
    near = lambda: "".join(rng.choice("ghijkl ") for _ in range(70))
    data = [(i, near() + passage[i % 9 :] + near()) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want = without_repeats([(i, t.encode()) for i, t in data])
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(docs).collect()} == want


@pytest.mark.parametrize("parts", [1, 2])
@pytest.mark.parametrize("contexts", [2000, 3])
def test_repeated_rows_keep_their_text(spark, monkeypatch, parts, contexts):
    """Two rows of one id with the same text: neither is earlier, alone or beside other rows with parts of that text."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", contexts)
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    alone, shared, twice = prose(400), prose(130), prose(150)
    one = [(1, alone), (2, prose(60) + shared + prose(60)), (3, twice + "-" + twice), (4, alone + prose(50))]
    one += [(10 + i, prose(70) + shared[i % 7 :] + prose(70)) for i in range(20)]
    docs = one[:4] + [(2, one[1][1] + prose(90)), *one]  # and a longer row of an id
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    df = df if parts == 1 else df.limit(5).coalesce(1).union(spark.createDataFrame(docs[5:], "doc_id long, text string").coalesce(1))
    want = without_repeats([(i, t.encode()) for i, t in one])
    got = suffix_dedup.suffix_dedup(df).collect()
    assert len(got) == len(docs)
    for r in got:
        tail = r.text[len(one[1][1]) :] if r.doc_id == 2 else ""
        assert bytes(r.kept) == want[r.doc_id] + tail.encode(), r.doc_id
    assert want[1] and want[2] and len(want[3]) == 151


def test_last_block_of_a_hot_anchor_with_one_context():
    """A context alone in its block is still sent to meet the other blocks, if its anchor is cut over several."""
    import pyarrow as pa

    schema = suffix_dedup._arrow(suffix_dedup._CONTEXTS)
    for hot in (True, False):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip([[5], [1], [hot], [7], [40], [20], [bytes(range(110))]], schema, strict=True)], schema=schema
        )
        sent = [r for b in suffix_dedup._arrays(100)([batch]) for r in b.to_pylist()]
        assert sorted(r["a"] for r in sent if r["kind"] == 1) == ([*range(40, 51)] if hot else [])
        assert all(r["kind"] == 1 for r in sent)


def test_cut_text_has_whole_characters(spark):
    data = [(1, "é" * 120), (2, "xé" + "é" * 118 + "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in suffix_dedup.suffix_dedup(docs, as_text=True).collect()}
    assert "�" not in got[2] and got[2].startswith("x") and got[2].endswith("y")


def test_near_duplicates_like_all_pairs(spark):
    one = {r[0]: r[1] for r in rows() if r[0] is not None}
    want = linked({i: shingles(t) for i, t in one.items()})
    got = near_dup.linked_classes(documents(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.id is None:
            assert r.component is None
        else:
            assert (r.n_shingles, r.component) == (len(shingles(one[r.id])), want[r.id]), r.id


def test_large_groups_of_near_copies(spark):
    """A group above the size of exhaustive nodes, beside others that share most of a passage with it."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    data = []
    for i in range(90):
        own = list(base)
        own[rng.randrange(120)] = f"e{i}"
        data.append((i, " ".join(own)))
    for i in range(60):  # half the words only: unlinked with the group
        own = base[:60] + [f"z{rng.randrange(10**6)}" for _ in range(60)]
        data.append((100 + i, " ".join(own)))
    want = linked({i: shingles(t) for i, t in data})
    got = near_dup.linked_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == want


def _families(rng, n, edits, words=80):
    """Copies of copies: each differs from an earlier one of its family in some words."""
    family = [[f"w{rng.randrange(10**6)}" for _ in range(words)]]
    while len(family) < n:
        own = list(rng.choice(family[-12:]))
        for _ in range(rng.randint(1, edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        family.append(own)
    return family


def test_branching_over_several_levels(spark, monkeypatch):
    """Nodes above four classes branch on, two levels between contractions; the result is that of all pairs."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "SMALLER", 4)
    monkeypatch.setattr(near_dup, "LEVELS", 2)
    reached = []
    descend = near_dup._descend
    monkeypatch.setattr(near_dup, "_descend", lambda *x: (lambda y: reached.append(y[2]) or y)(descend(*x)))
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(50)]
    data = [" ".join(x) for _ in range(3) for x in _families(rng, 60, 2)]
    data += [" ".join(passage + [f"z{rng.randrange(10**6)}" for _ in range(45)]) for _ in range(80)]  # share much, but are not linked
    texts_ = list(enumerate(data))
    want = linked({i: shingles(t) for i, t in texts_})
    got = {r.id: r.component for r in near_dup.linked_classes(spark.createDataFrame(texts_, "doc_id long, text string")).collect()}
    assert max(reached) >= 3
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    # links lost are few, and none is invented
    assert all(want[i] == want[got[i]] for i in got)


def test_a_branching_is_made_once(spark, monkeypatch):
    """Nodes are grouped and joined from written rows: the explode of a branching is in no plan that reads its rows twice."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    plans = []
    several = near_dup._several

    def told(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return several(rows)

    monkeypatch.setattr(near_dup, "_several", told)
    rng = random.Random(9)
    texts_ = list(enumerate(" ".join(x) for x in _families(rng, 60, 2)))
    near_dup.linked_classes(spark.createDataFrame(texts_, "doc_id long, text string")).collect()
    assert len(plans) > 2 and not any("Generate" in p for p in plans)


def test_classes_that_share_too_few_first_nodes_do_not_branch(spark, monkeypatch):
    """Texts that have one line in common and nothing else meet in large first nodes, and go no further."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    seen = []
    per_tree = near_dup._per_tree
    monkeypatch.setattr(near_dup, "_per_tree", lambda nodes, first: seen.append(nodes.count()) or per_tree(nodes, first))
    rng = random.Random(10)
    line = " ".join(f"p{i}" for i in range(12))
    data = [line + " " + " ".join(f"z{rng.randrange(10**9)}" for _ in range(40)) for _ in range(60)]
    data += [" ".join(x) for x in _families(rng, 60, 3)]
    want = linked({i: shingles(t) for i, t in enumerate(data)})
    got = {r.id: r.component for r in near_dup.linked_classes(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect()}
    assert all(got[i] == want[i] for i in range(60)) and all(want[i] == want[got[i]] for i in got)
    first = {at for _, at in near_dup._first_coordinates(spark, near_dup.TREES, near_dup.PERCENT)}
    least = near_dup._least_shared(len(first), near_dup.PERCENT)
    assert 4 <= least <= len(first) // 3
    classes, _ = _first_rows(spark, data)
    large = near_dup._first_nodes(classes, sorted(first), near_dup.PERCENT)[1]
    going = {r.id for r in large.select("id").distinct().collect()}
    assert going and sum(i < 60 for i in going) <= 12 < sum(i >= 60 for i in going)


def _first_rows(spark, data):
    every = spark.createDataFrame(list(enumerate(data)), "id long, text string").mapInArrow(
        near_dup._signatures, "id long, n_shingles long, print binary, s0 long, s1 long, signature array<int>"
    )
    return every.selectExpr("id", "n_shingles AS n", "s0", "s1", "signature"), every


def test_only_classes_away_from_a_pivot_branch_per_tree(spark, monkeypatch):
    """Of a group of near copies, those next to a pivot are not copied for every tree."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    seen = []
    per_tree = near_dup._per_tree

    def told(nodes, first):
        seen.extend(nodes.select(near_dup._apart("m", "pivot").alias("n")).collect())
        return per_tree(nodes, first)

    monkeypatch.setattr(near_dup, "_per_tree", told)
    rng = random.Random(8)
    texts_ = list(enumerate(" ".join(x) for x in _families(rng, 90, 2)))
    want = linked({i: shingles(t) for i, t in texts_})
    got = {r.id: r.component for r in near_dup.linked_classes(spark.createDataFrame(texts_, "doc_id long, text string")).collect()}
    assert seen and min(r.n for r in seen) > near_dup._bounds(near_dup.PERCENT)[0]
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want) and all(want[i] == want[got[i]] for i in got)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100), (200, 150)], "a long, b long")
    got = {r.id: r.component for r in near_dup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[150] == got[200] == 100


def test_benchmark_overlaps(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([7, 18, 30])))) for i in range(8)] + [(90, None), (91, "a b"), (None, "x")]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            leak = items[i % 8][1].split()
            if i % 2:
                leak = [w if j % 9 != 5 else "other" for j, w in enumerate(leak)]
            own[len(own) // 2 : len(own) // 2] = [w.title() + "," for w in leak]
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame([*docs, (None, items[1][1]), (99, None), docs[3]], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item) for r in decontamination.overlaps(df, bench).collect()}
    clean = {(i, j) for i, t in docs for j, x in items[:8] if not any(w in t.lower() for w in x.split())}
    sure = {(i, j) for i, t in docs for j, x in items[:8] if len(x.split()) >= 16 and overlap(t, x)}
    exact = {(i, j) for i, t in docs for j, x in items[:8] if x in t.lower().replace(",", "")}
    assert sure | exact <= got and not got & clean
    left = decontamination.decontaminate(df, bench)
    assert {r.doc_id for r in left.collect()} == ({i for i, _ in docs} | {None, 99}) - {i for i, _ in got}


def agrees(text: str, item: str) -> bool:
    """Whether some window of 16 words (or the shorter item) agrees in three quarters, by that rule alone."""
    a, b = text.lower().split(), item.split()
    width = min(16, len(b))
    for shift in range(-len(b), len(a)):
        same = [0 <= j + shift < len(a) and a[j + shift] == b[j] for j in range(len(b))]
        if any(sum(same[s : s + width]) >= 0.75 * width for s in range(len(b) - width + 1)):
            return True
    return False


def test_benchmark_overlaps_by_the_rule_alone(spark):
    """Any words differ: every fourth or sixth from each phase, as many as allowed or one more, and cut at both ends."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(n, [word() for _ in range(n)]) for n in [*range(5, 19), 24, 33]]
    docs = []
    for n, own in items:
        width = min(16, n)
        allowed = width - -(-3 * width // 4)
        leaks = [[w if i % step != phase else word() for i, w in enumerate(own)] for step in (4, 6) for phase in range(step)]
        for extra in (0, 0, 0, 1):
            gone = set(rng.sample(range(width), allowed + extra))
            leaks.append([w if i not in gone else word() for i, w in enumerate(own[:width])])
        around = lambda: [word() for _ in range(rng.randint(0, 40))]
        texts = [[*around(), *leak, *around()] for leak in leaks]
        texts += [own[allowed:] + around(), around() + own[: width - allowed], own[: width - allowed - 1]]
        docs += [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(n, " ".join(own)) for n, own in items], "item_id long, text string")
    want = {(i, n) for i, t in enumerate(docs) for n, own in items if not set(own).isdisjoint(t.split()) and agrees(t, " ".join(own))}
    got = decontamination.overlaps(df, bench).collect()
    assert {(r.id, r.item) for r in got} == want and len(got) == len(want)


def test_masks_fit_between_any_differing_words():
    from itertools import combinations

    for length in range(decontamination.SHORTEST, 17):
        differ = length - -(-3 * length // 4)
        masks = [[j for j, x in enumerate(m) if x == "1"] for m in decontamination._families([length], 0.75)[length]]
        for gone in combinations(range(length), differ):
            assert any(not {i + j for j in m} & set(gone) for m in masks for i in range(length - m[-1])), (length, gone)


def test_empty_tables(spark):
    none = empty(spark)
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert near_dup.linked_classes(none).count() == 0
    bench = spark.createDataFrame([(1, "some words of an item that is long enough to be found here")], "item_id long, text string")
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.overlaps(documents(spark), bench.limit(0)).count() == 0


def test_extra_columns_survive(spark):
    docs = documents(spark)
    got = suffix_dedup.suffix_dedup(docs)
    assert set(got.columns) == set(docs.columns) and dict(got.dtypes)["kept"] == "binary"
    assert got.filter(F.col("row") == "x").count() == docs.filter(F.col("row") == "x").count()
