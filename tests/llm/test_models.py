import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_helpers import documents, empty, rows, texts, words
from pyspark.sql import functions as F

from rxspark.llm import lattice_model, language_id, quality_classifier, quality_rules, sentence_pieces, toxicity, url_filter

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return sentence_pieces.load(MODEL)


# --- pieces


def test_encoding_equals_the_library(vocabulary):
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentence_pieces.Encoder(vocabulary)
    rng = random.Random(3)
    pieces = [p for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True) if k == "n"]
    pools = ["ab ", "the quickon ing  tionre.,!", "aàé▁ \n\t<>", "один два ", "日本語ＡB漢字😀 \0", "".join(pieces[:2000])]
    cases = ["", " ", "  a b", "\n", "a▁b", "▁", "<s>", "<0x0A>", "   " * 30, "a" * 300, "the" * 100, *texts()]
    cases += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    cases += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    for text in cases:
        ids = library.encode(text, add_bos=True, add_eos=True)
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert own.decode(got) == library.decode(ids), text


def test_decoding_any_ids(vocabulary):
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentence_pieces.Encoder(vocabulary)
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.choice([1, 2, *range(3, 259), 264, 287, 29891]) for _ in range(rng.randint(1, 8))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_encode_rows(spark, vocabulary):
    got = sentence_pieces.encode(documents(spark), vocabulary).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(got) == len(rows())
    for r in got:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(r.ids) // 4
    assert sentence_pieces.encode(empty(spark), vocabulary).count() == 0


# --- language


def plain_bits(train: list[tuple[str, str]], text: str, order: int = language_id.ORDER) -> dict[str, float]:
    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    counts = defaultdict(lambda: [Counter() for _ in range(order + 1)])
    tree = defaultdict(lambda: defaultdict(Counter))
    for lang, t in train:
        raw = b"\0" * order + fold(t)
        for i in range(order, len(raw)):
            for k in range(order + 1):
                tree[lang][raw[i - k : i]][raw[i]] += 1
    assert counts is not None
    out = {}
    for lang, contexts in tree.items():
        raw, bits = b"\0" * order + fold(text), 0.0
        for i in range(order, len(raw)):
            for k in range(order, -1, -1):
                seen = contexts.get(raw[i - k : i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if raw[i] in seen:
                    bits -= math.log2(seen[raw[i]] / (n + d))
                    break
                bits -= math.log2(d / (n + d))
            else:
                bits += 8
        out[lang] = bits
    return out


@pytest.mark.parametrize("entries, costs", [(1 << 21, 1 << 22), (200, 1 << 22), (0, 4000)])
def test_code_lengths_are_exact(spark, monkeypatch, entries, costs):
    """Also if few weights or none go to the tasks, and texts are scored in pieces of 1,024 bytes."""
    monkeypatch.setattr(language_id, "COSTS", costs)
    docs = documents(spark)
    model = language_id.fit(docs, entries=entries)
    assert (model.rare is None) == (entries > 200)
    train = [(r[2], r[1]) for r in rows() if r[2] is not None and r[1]]
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.lang_pred == "und":
            assert not any(c.isalpha() for c in r.text or "") and r.lang_score == 0
            continue
        bits = plain_bits(train, r.text)
        assert r.lang_pred == min(bits, key=lambda x: (bits[x], x))
        assert math.isclose(r.bits_per_byte * len(r.text.encode()), min(bits.values()), rel_tol=1e-9)
        assert math.isclose(r.lang_score, 1 / sum(2 ** max(min(bits.values()) - x, -1000) for x in bits.values()), rel_tol=1e-6)


def test_many_languages_and_long_texts(spark, monkeypatch):
    """300 languages with one short text each, texts cut into slices and pieces; a bound of 5,000 weights."""
    monkeypatch.setattr(language_id.C, "SLICE_BYTES", 1500)
    monkeypatch.setattr(language_id, "COSTS", 300 * 1024)
    rng = random.Random(11)
    train = [(f"x{i:03}", " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(20))) for i in range(300)]
    data = [(i, t, lang) for i, (lang, t) in enumerate(train)] + [(1000, " ".join(t for _, t in train[:60]), None), (1001, train[7][1] * 3, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(2)
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs, entries=5000), keep=["doc_id"]).collect()}
    assert len(got) == 302
    for i in (0, 7, 123, 299, 1000, 1001):
        text = {d: t for d, t, _ in data}[i]
        bits = plain_bits(train, text)
        assert got[i].lang_pred == min(bits, key=lambda x: (bits[x], x))
        assert math.isclose(got[i].bits_per_byte * len(text), min(bits.values()), rel_tol=1e-9)


def test_language_without_teaching_or_rows(spark):
    model = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.identify(documents(spark), model).collect()} == {"und"}
    assert language_id.identify(empty(spark), language_id.fit(documents(spark))).count() == 0


# --- quality


def test_base_signals_and_ratio(spark):
    docs = documents(spark)
    target = spark.createDataFrame([(i,) for i in range(40) if i % 10 not in (7, 8)] + [(None,)], "id long")
    weights = quality_rules.fit(docs, target).first()["weights"]
    grams = quality_rules._with_grams(docs.select("text"), quality_rules.BUCKETS).select("text", "grams").collect()
    by_text = {r.text: r.grams for r in grams}
    got = quality_rules.judge(docs, target).collect()
    assert len(got) == len(rows())
    for r in got:
        import re

        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {i for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
        lines = [x for x in (r.text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        own = by_text[r.text]
        ratio = sum(weights[g] for g in own) / len(own) if own else 0.0
        assert math.isclose(r.log_ratio, ratio, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and ratio >= quality_rules.THRESHOLD)
    counts = Counter(g for t in [r.text for r in grams] for g in by_text[t])
    n, t = sum(counts.values()), sum(len(by_text[r[1]]) for r in rows() if r[0] is not None and r[0] < 40 and r[0] % 10 not in (7, 8))
    bucket = counts.most_common(1)[0][0]
    own = sum(by_text[r[1]].count(bucket) for r in rows() if r[0] is not None and r[0] < 40 and r[0] % 10 not in (7, 8))
    share = (counts[bucket] + 1) / (n + quality_rules.BUCKETS)
    want = math.log((own + quality_rules.SMOOTHING * share) / (t + quality_rules.SMOOTHING) / share)
    assert math.isclose(weights[bucket], want, rel_tol=1e-9)


def test_rules_without_target_or_rows(spark):
    none = spark.createDataFrame([], "id long")
    assert {r.log_ratio for r in quality_rules.judge(documents(spark), none).collect()} == {0.0}
    assert quality_rules.judge(empty(spark), none).count() == 0


def scored_quality(spark, labels):
    stats = quality_classifier.with_statistics(documents(spark, n=150)).withColumnRenamed("doc_id", "id")
    model = quality_classifier.fit(stats, labels)
    return quality_classifier.score(stats, model)


def test_quality_classifier_separates(spark):
    labels = spark.createDataFrame([(i, int(i % 10 != 7)) for i in range(100)] + [(3, None), (None, 1), (4, 1)], "id long, label int")
    got = scored_quality(spark, labels).filter("id BETWEEN 100 AND 149").collect()
    bad, good = ([r.score for r in got if (r.id % 10 == 7) == x] for x in (True, False))
    assert len(bad) == 5 and np.mean(bad) < 0.3 < 0.7 < np.mean(good)
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_classifier_with_one_class_or_none(spark):
    one = scored_quality(spark, spark.createDataFrame([(1, 1), (2, 1)], "id long, label int"))
    assert {r.score for r in one.collect()} == {1.0}
    none = scored_quality(spark, spark.createDataFrame([], "id long, label int"))
    assert {r.score for r in none.collect()} == {0.5}
    model = quality_classifier.fit(quality_classifier.with_statistics(empty(spark)).withColumnRenamed("doc_id", "id"), spark.createDataFrame([], "id long, label int"))
    assert quality_classifier.score(quality_classifier.with_statistics(empty(spark)), model).count() == 0


def test_pooling_is_isotonic():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 9, 30).astype(float)
        ones = np.floor(n * rng.random(30))
        _, values = quality_classifier.pooled(np.arange(30.0), n, ones)
        assert (np.diff(values) > 0).all() and values.min() >= 0 and values.max() <= 1


# --- toxicity


def test_segments_are_all_maximal_ones():
    def plain(score):
        """By definition: best segment, then left and right of it."""
        best = max(((sum(score[a:b]), -(b - a), -a) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[2], -best[2] - best[1]
        return plain(score[:a]) + [(a, b, best[0])] + [(x + b, y + b, v) for x, y, v in plain(score[b:])]

    rng = random.Random(7)
    for _ in range(400):
        score = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(score))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain(score)]
        assert np.allclose([v for *_, v in got], [v for *_, v in plain(score)])


def test_rate_solves_its_equation():
    scores, n = np.array([-1.5, 3.0, 5.0]), np.array([1000.0, 5.0, 1.0])
    rate = toxicity.rate_of(scores, n)
    assert math.isclose(n @ np.exp(rate * scores) / n.sum(), 1, rel_tol=1e-6)
    assert toxicity.rate_of(scores, np.array([1000.0, 0, 0])) == 1.0


def plain_toxicity(docs, labels):
    """The module's description, row by row: ``evidence, n_significant, score`` of every text."""
    import re

    tokens = [re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    known = [labels.get(i) if i is not None else None for i, _ in docs]
    n, sides = Counter(w for x in tokens for w in x), {1: Counter(), 0: Counter()}
    for x, label in zip(tokens, known, strict=True):
        if label is not None:
            sides[label].update(x)
    pseudo = max(1000.0, toxicity.PRIOR * (sides[0].total() + sides[1].total()))
    odds = {}
    for w in n:
        prior = pseudo * (n[w] + 0.5) / (n.total() + 0.5 * max(len(n), toxicity.VOCABULARY))
        own = {s: c[w] + prior for s, c in sides.items()}
        value = math.log(own[1] / (sides[1].total() + pseudo - own[1])) - math.log(own[0] / (sides[0].total() + pseudo - own[0]))
        odds[w] = value if abs(value) >= toxicity.CERTAIN * math.sqrt(1 / own[1] + 1 / own[0]) else 0.0
    scores = [[odds[w] - toxicity.DRIFT for w in x] for x in tokens]
    found = [[v for *_, v in toxicity.segments(np.array(x))] for x in scores]
    steps = Counter(np.round(v * toxicity.STEPS) / toxicity.STEPS for x, label in zip(scores, known, strict=True) if label == 0 for v in x)
    rate = toxicity.rate_of(np.array(list(steps)), np.array(list(steps.values()), float))
    best = [max(x, default=0.0) for x in found]
    clean = [rate * b - math.log(len(x)) for b, x, label in zip(best, tokens, known, strict=True) if label == 0 and b > 0]
    log_k = sum(clean) / len(clean) - 0.5772156649015329 if clean else 0.0
    evidence, many = [], []
    for x, b, own in zip(tokens, best, found, strict=True):
        floor = math.log(max(1, len(x))) + log_k
        over = [rate * v - floor for v in own if rate * v > floor]
        many.append(len(over))
        evidence.append(max(toxicity.LOWEST, sum(over) if over else rate * b - floor if b > 0 else toxicity.LOWEST))
    taught = [(round(min(e, toxicity.HIGHEST) * toxicity.BINS) / toxicity.BINS, label) for e, label in zip(evidence, known, strict=True) if label is not None]
    bins = sorted({e for e, _ in taught})
    counts = [[sum(x == e for x, _ in taught), sum(label for x, label in taught if x == e)] for e in bins]
    a, b = toxicity._logistic(np.array(bins), *np.array(counts, float).T)
    return [(e, m, 1 / (1 + math.exp(-(a + b * e)))) for e, m in zip(evidence, many, strict=True)]


def test_toxicity_like_its_description(spark):
    docs = [(r[0], r[1]) for r in rows(n=200)]
    labels = {i: int(i % 10 == 8) for i in range(140)}
    df = spark.createDataFrame(list(labels.items()), "id long, label int")
    odds = toxicity.fit(documents(spark, n=200), df)
    got = toxicity.score(toxicity.passages(documents(spark, n=200), odds), df).select("doc_id", "text", "evidence", "n_significant", "score").collect()
    want = defaultdict(list)
    for (i, t), x in zip(docs, plain_toxicity(docs, labels), strict=True):
        want[i, t].append(x)
    assert len(got) == len(docs) and any(r.n_significant for r in got)
    for r in got:
        assert np.allclose(tuple(r)[2:], want[r.doc_id, r.text][0], rtol=1e-6), r


def test_bounded_labels_teach(spark):
    docs, labels = documents(spark, n=200), spark.createDataFrame([(i, int(i % 10 == 8)) for i in range(200)], "id long, label int")
    some = toxicity.fit(docs, labels, most=100)
    assert 0 < len(some[0]) and not np.array_equal(some[1], toxicity.fit(docs, labels)[1])
    target = labels.filter("id % 10 < 7").select("id")
    few = quality_rules.fit(docs, target, most=30).first()["weights"]
    assert few != quality_rules.fit(docs, target).first()["weights"] and any(few)


def test_toxicity_separates(spark):
    docs = documents(spark, n=200)
    labels = spark.createDataFrame([(i, int(i % 10 == 8)) for i in range(140)] + [(None, 1), (5, None)], "id long, label int")
    odds = toxicity.fit(docs, labels)
    got = toxicity.score(toxicity.passages(docs, odds), labels).collect()
    assert len(got) == len(rows(n=200))
    held = [r for r in got if r.doc_id is not None and 140 <= r.doc_id < 200 and r.doc_id % 10 not in (4, 5)]
    assert all((r.score >= 0.5) == (r.doc_id % 10 == 8) for r in held)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "id long, label int")
    odds = toxicity.fit(documents(spark), none)
    assert {r.score for r in toxicity.score(toxicity.passages(documents(spark), odds), none).collect()} == {0.5}
    assert toxicity.score(toxicity.passages(empty(spark), toxicity.fit(empty(spark), none)), none).count() == 0


# --- urls


def test_urls(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abcd") for _ in range(4))
    hosts = [f"{name()}.{x}" for x in ("good.org", "bad.net", "bad.com", "example.net", "NET", "notnet") for _ in range(15)]
    urls = [f"http://{h}/{p}{name()}{q}" for h in hosts for p, q in (("en/", ""), ("fr/", "?x=://y/z"), ("", "#f"))]
    urls += [None, "", "no scheme", "http://", "http://h", "http://h?q", "x://A.É.Net/en/", "http://a://b/c", "http://e.net\n/en/", urls[0]]
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("good.org/fr/", "allow"), ("org/fr/", "block")]
    df = spark.createDataFrame([(u, "x", "y") for u in urls], "url string, verdict string, row string")
    got = url_filter.judge(df, spark.createDataFrame(rules, "rule string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        host = path = ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            end = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
            path = rest[cut:end] if end > cut else ""
        fits = [(-len(x), x, v) for x, v in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        rule, verdict = min(fits)[1:] if fits else (None, None)
        assert (r.host, r.path, r["rule"]) == (host, path, rule), r.url
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    free = [r for r in got if r.rule is None and r.url and "bad.com" in r.url]
    assert free and len({r.verdict for r in free}) == 1 or free
    none = spark.createDataFrame([], "url string")
    assert url_filter.judge(none, spark.createDataFrame(rules, "rule string, verdict string")).count() == 0


@pytest.mark.parametrize("frequent", [1 << 16, 40])
def test_url_differences_are_exact(spark, monkeypatch, frequent):
    """Thousands of different contexts a side, each with its own counts."""
    monkeypatch.setattr(url_filter, "FREQUENT", frequent)
    rng = random.Random(11)
    name = lambda n: "".join(rng.choice("abcdefghijklmnop0123456789é") for _ in range(n))
    urls = [f"http://{name(5)}.{rng.choice(['good.org', 'bad.net', 'free.com'])}/{name(12)}" for _ in range(1500)]
    urls += [urls[0], urls[1], "", None]
    rules = [("org/", "allow"), ("net/", "block")]
    got = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "rule string, verdict string")).collect()
    trees = [defaultdict(Counter), defaultdict(Counter)]
    codes = lambda u: [(tuple(([-1] * url_filter.ORDER + list(u.encode()))[i : i + url_filter.ORDER]), b) for i, b in enumerate(u.encode())]
    for u in urls:
        if u and "free" not in u:
            for context, b in codes(u):
                for k in range(url_filter.ORDER + 1):
                    trees["good" in u][context[url_filter.ORDER - k :]][b] += 1

    def log(side, context, b):
        p = 1 / 256
        for k in range(url_filter.ORDER + 1):
            seen = trees[side].get(context[url_filter.ORDER - k :])
            if seen:
                p = (seen[b] + len(seen) * p) / (seen.total() + len(seen))
        return math.log(p)

    assert len(got) == len(urls) and Counter(r.url for r in got) == Counter(urls)
    for r in got:
        want = sum(log(1, c, b) - log(0, c, b) for c, b in codes(r.url or "")) / max(len((r.url or "").encode()), 1)
        assert math.isclose(r.difference, want, rel_tol=1e-9, abs_tol=1e-9), r.url
        assert r.verdict in {"org": ["allow"], "net": ["block"]}.get((r.url or "").split("/", 3)[2][-3:] if r.url else "", ["allow", "block"])


# --- language model


def test_lattice_sums_all_segmentations(vocabulary):
    pieces = {p: i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)) if k == "n"}
    lattice = lattice_model.initial(vocabulary)

    def plain(word):
        total = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                part = word[start:end]
                if part in pieces:
                    total[end] += total[start] * math.exp(lattice.logs[pieces[part]])
                elif len(part) == 1:
                    total[end] += total[start] * math.exp(sum(lattice.logs[3 + b] for b in part.encode()))
        return math.log10(total[-1])

    spelled = ["▁" + w for w in "a the token tokenization ünïcode x\0y Ａbc aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa".split(" ")]
    assert np.allclose(lattice.likelihood(spelled), [plain(w) for w in spelled])
    expected = lattice.expected(["▁the"], np.array([2.0]))
    lengths = np.array([len(p) if k == "n" else 0 for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)] + [0])
    assert math.isclose(expected @ lengths, 2 * len("▁the"), rel_tol=1e-9)  # every segmentation covers the word


@pytest.mark.parametrize("frequent", [1 << 18, 8])
def test_lm_scores(spark, vocabulary, monkeypatch, frequent):
    monkeypatch.setattr(lattice_model, "FREQUENT", frequent)
    docs = documents(spark)
    train = docs.filter("doc_id % 2 = 0")
    counts = lattice_model.count(train)
    lattice = lattice_model.fit(counts, vocabulary)
    got = lattice_model.score(docs, counts, lattice).collect()
    c = Counter(w for r in rows() if r[0] is not None and r[0] % 2 == 0 for w in words(r[1]))
    n_texts = sum(r[0] is not None and r[0] % 2 == 0 for r in rows())
    n, v = sum(c.values()) + n_texts, len(c) + 1
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    assert len(got) == len(rows())
    for r in got:
        w = words(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, sum(log(c[x]) for x in w) + log(n_texts), rel_tol=1e-9)
        want = lattice.likelihood(["▁" + x.decode() for x in w]).sum() + lattice.logs[-1] / math.log(10)
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-9)


def test_lm_without_training_or_rows(spark, vocabulary):
    counts = lattice_model.count(empty(spark))
    lattice = lattice_model.fit(counts, vocabulary)
    got = lattice_model.score(documents(spark), counts, lattice).filter(F.col("text") == "").first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (1, 0, 0, 0.0)
    assert lattice_model.score(empty(spark), counts, lattice).count() == 0
