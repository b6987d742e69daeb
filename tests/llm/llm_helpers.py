"""Small documents with every odd case, and plain versions of the operators to compare with."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, row string, ids string, spans string"


def texts(seed: int = 5, n: int = 60) -> list[str]:
    """Prose of invented words with copies, near copies, shared passages and junk."""
    rng = random.Random(seed)
    syllables = {"en": "th he in er an re on at en nd ti es".split(), "de": "sch ein ich ung keit ge be ver er en zu ä".split()}
    out: list[str] = []
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word("en") for _ in range(60))
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        words = [word(lang) for _ in range(rng.randint(5, 120))]
        kind = i % 10
        if kind == 4 and out:
            out.append(rng.choice(out))
            continue
        if kind == 5 and out:
            words = rng.choice(out).split()
            words[len(words) // 2 : len(words) // 2 + 1] = ["edited"]
        if kind == 6:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if kind == 7:
            words = [w + rng.choice(["%%%", "$$$", "***"]) for w in words]
        if kind == 8:
            words[::9] = ["trash"] * len(words[::9])
        text = " ".join(words)
        out.append(text.replace(" ", "\n", 1) if kind == 9 else text)
    return out


def rows(seed: int = 5, n: int = 60) -> list[tuple]:
    out = [(i, t, "de" if i % 3 == 0 else "en", f"s{i % 4}", len(t), "x", "x", "x", "x", "x") for i, t in enumerate(texts(seed, n))]
    odd = [None, "", " \t\n ", "one", "Ünï cödé ☃ 😀 ▁▁ x", "12 34 !! ??", "aa " * 400, "ab" * 300]
    out += [(1000 + i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(odd)]
    out += [(None, "a text without an id " * 8, "en", "s", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    out += out[3:5]  # repeated rows
    return out


def documents(spark: SparkSession, seed: int = 5, n: int = 60) -> DataFrame:
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(sets: dict[int, set]) -> dict[int, int]:
    """Smallest id of every connected component of near duplicates."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def without_repeats(docs: list[tuple[int, bytes]], length: int = 100) -> dict[int, bytes]:
    """Remaining bytes of every document, window by window."""
    seen: set[bytes] = set()
    out = {}
    for i, text in sorted(docs):
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            window = text[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        out[i] = bytes(b for b, g in zip(text, gone, strict=True) if not g)
    return out


def overlap(text: str, item: str) -> bool:
    """Whether some window of 16 words (or the shorter item) agrees in three quarters on some diagonal that has a seed hit."""
    a, b = (re.findall(r"[^\W_]+", x.lower()) for x in (text, item))
    width = min(16, len(b))
    for shift in range(-len(b), len(a)):
        same = [0 <= j + shift < len(a) and a[j + shift] == b[j] for j in range(len(b))]
        for s in range(len(b) - width + 1):
            if sum(same[s : s + width]) >= 0.75 * width and any(all(same[k : k + 8]) for k in range(len(b) - 7)):
                return True
    return False
