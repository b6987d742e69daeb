"""Exact merge-type (BPE) SentencePiece encoding by backtracking, and decoding.

The text, with a leading space, is written with U+2581 for spaces. No piece has U+2581 after another character, none
holds a line feed, and none has certain marks (found from the vocabulary) after a Latin letter. Merges cannot reach over
such places, so each different stretch between them is encoded once per worker (a bounded cache). Inside a stretch:

* an Aho-Corasick automaton over the pieces gives the matches that begin at every place;
* from the left, the longest match is tried first, then shorter ones. A piece may follow another only if the merges,
  run again on the two of them together, lead back to exactly these two. By the order of merges, a row of pieces that
  is compatible pair by pair is the row the merges make;
* if nothing fits at a place, its bit is set in a bitfield of failed places, the last piece is taken back and its next
  shorter match is tried; a place whose bit is set is never entered again.

Characters that no piece holds become one byte piece for each byte of their UTF-8 form.

Defined cases: null and empty text become only the begin and end ids, and decode to the empty text. Decoding gives
U+FFFD for each byte that is no UTF-8, and drops the leading space that encoding added; a text that itself holds U+2581
decodes with spaces there, as the library does. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import codecs
import re
import string
from array import array
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C

SPACE = "▁"
CACHE = 400_000  # stretches a worker remembers
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says: the text, score and kind (n: normal, b: byte, c: control, u: unknown) of every id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    bos: int
    eos: int


def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = lambda i: "b" if model.is_byte(i) else "c" if model.is_control(i) else "u" if model.is_unknown(i) else "n"
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), "".join(map(kind, ids)),
        model.bos_id(), model.eos_id(),
    )


def _one_by_one(error: UnicodeDecodeError):
    return "�", error.start + 1


codecs.register_error("each-byte", _one_by_one)


class _Stretches(dict):
    """Ids of a stretch as little-endian bytes; what is not known yet is encoded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[stretch] = self.make(stretch)
        return out


@dataclass
class Encoder:
    vocabulary: Vocabulary
    pairs: dict[tuple[int, int], bool] = field(default_factory=dict)
    whole: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self):
        v = self.vocabulary
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == "n"}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(v.pieces) if v.kinds[i] == "b"}
        self.unknown = v.kinds.find("u")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces reach over spaces or lines: this vocabulary cannot be encoded stretch by stretch")
        after = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if re.match(f"[{LATIN}]", a)}
        marks = re.escape("".join(c for c in string.punctuation if c not in after))
        stop = f"▁*+[{LATIN}]++(?=[{marks}])|" if marks else ""
        self.split = re.compile(stop + "▁+[^▁\n]*|\n|[^▁\n]+").findall
        self.stretches = _Stretches(lambda s: array("I", self.stretch(s)).tobytes())
        self.controls = {i for i, k in enumerate(v.kinds) if k == "c"}
        self.edges = tuple(np.array([i], "<u4").tobytes() for i in (v.bos, v.eos))
        self.plain = [
            b" \xe2\x81\x87 " if k == "u" else b"" if k == "c" else bytes([int(p[3:5], 16)]) if k == "b" else p.replace(SPACE, " ").encode()
            for p, k in zip(v.pieces, v.kinds, strict=True)
        ]

    def merged(self, text: str) -> list[str]:
        """The merges from single characters: always the pair whose union scores best, the leftmost of equals."""
        parts = list(text)
        ids, scores = self.ids, self.vocabulary.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                one = ids.get(parts[i] + parts[i + 1])
                if one is not None and (best is None or scores[one] > best):
                    best, at = scores[one], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of the two pieces' common text end in these two pieces."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            a, b = self.vocabulary.pieces[left], self.vocabulary.pieces[right]
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def stands(self, piece: int) -> bool:
        """Whether the merges make the piece from its own characters."""
        known = self.whole.get(piece)
        if known is None:
            text = self.vocabulary.pieces[piece]
            known = self.whole[piece] = self.merged(text) == [text]
        return known

    def stretch(self, text: str) -> list[int]:
        starts: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, (size, piece) in self.automaton.iter(text):
            starts[end - size + 1].append((size, piece))  # shorter matches end, and so come, earlier
        out: list[int] = []
        begin = 0
        for i, matches in enumerate(starts) if [] in starts else ():
            if not matches and text[i] not in self.ids:
                if i > begin:
                    out += self.known(starts[begin:i])
                codes = text[i].encode()
                out += [self.bytes[b] for b in codes] if self.bytes else [self.unknown]
                begin = i + 1
        if begin < len(text):
            out += self.known(starts[begin:] if begin else starts)
        return out

    def known(self, starts: list[list[tuple[int, int]]]) -> list[int]:
        """Backtracking over a stretch in which every character is a piece."""
        n = len(starts)
        failed = 0
        taken: list[tuple[int, int, int]] = []  # piece, its place, the index of the match tried
        place, tried = 0, len(starts[0]) - 1
        while place < n:
            matches = starts[place]
            last = taken[-1][0] if taken else None
            while tried >= 0:
                size, piece = matches[tried]
                end = place + size
                if end <= n and not failed >> end & 1 and self.stands(piece) and (last is None or self.fits(last, piece)):
                    break
                tried -= 1
            if tried >= 0:
                taken.append((piece, place, tried))
                place = end
                tried = len(starts[place]) - 1 if place < n else -1
            else:
                failed |= 1 << place
                if not taken:
                    raise AssertionError("no row of pieces is left")
                _, place, tried = taken.pop()
                tried -= 1
        return [piece for piece, _, _ in taken]

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end, little-endian unsigned 32-bit."""
        if not text:
            return b"".join(self.edges)
        found = self.split(SPACE + text.replace(" ", SPACE))
        return self.edges[0] + b"".join(map(self.stretches.__getitem__, found)) + self.edges[1]

    def decode(self, ids: bytes) -> str:
        plain, numbers = self.plain, np.frombuffer(ids, "<u4").tolist()
        first = next((i for i in numbers if plain[i]), None)
        runs = [numbers]
        if not self.controls.isdisjoint(numbers[1:-1]):  # bytes on the two sides of a control id make no character
            runs = [list(run) for _, run in groupby(numbers, self.controls.__contains__)]
        text = "".join([b"".join([plain[i] for i in run]).decode("utf-8", "each-byte") for run in runs])
        return text[1:] if first is not None and self.vocabulary.pieces[first].startswith(SPACE) else text


@lru_cache(maxsize=2)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def _encode(shared):
    def run(batches):
        encoder = _encoder(shared.value)
        for part in C.slices(batches):
            ids = [encoder.encode(x) for x in part.column("text").to_pylist()]
            texts = [encoder.decode(x) for x in ids]
            columns = [pa.array(ids, pa.binary()), pa.array(np.array([len(x) // 4 for x in ids])), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("row"), *columns], names=["row", "ids", "n_tokens", "decoded"])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns; all by default) with ``ids`` (little-endian unsigned 32-bit), ``n_tokens``, ``decoded``."""
    own = ["ids", "n_tokens", "decoded"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col(text).alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the model file
    done = packed.mapInArrow(_encode(shared), f"row {row}, ids binary, n_tokens long, decoded string")
    return done.select(*(F.col("row").getField(c).alias(c) for c in keep), *own)
