"""Subword encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three parts: the normaliser (a trie of characters to be replaced, longest
match first, then white space to its mark and the dummy prefix), the pieces as a trie from characters to ids, and the byte
fallback as arcs for characters without a piece. Composed with an input they give a lattice of pieces over its
positions. Arcs between pieces carry tropical weights: for a model of scored pieces the negative score; for a
merge model zero where the merges of the model leave exactly this pair of pieces side by side,
and infinite otherwise. The shortest path is then the model's own segmentation: for merges it is
the only path of finite weight, and for every prefix there is one, so one state per position is
enough. Pieces that the model's user has defined pass the normaliser unchanged; in a merge model they part the lattice, in
a model of scores their arcs cost less than any others over the same characters.

Pieces never hold a space mark after another character, so words are separate sub-lattices; each
distinct word of a task is solved once. The file's path is a parameter and is opened on the
workers, where it must exist.

Defined results: null and empty texts have no ids and decode to ''. Decoding inverts encoding up
to the model's own reading of marks, replaced characters and white space: a text with '▁' decodes to one with spaces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
WORDS_HELD = 250_000  # in each of two generations
PAIRS_HELD = 50_000  # pieces whose right neighbours are known
SHORT = 64  # longest word that is held
AHEAD = 16  # characters that one entry of a character map covers at most


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Compiled:
    ids: dict[str, int]
    score: list[float]
    surface: list[bytes]
    byte_ids: list[int]
    unknown: int
    longest: int
    merges: bool
    prefix: bool
    squeeze: bool
    escape: bool
    chars: CharacterMap | None
    defined: re.Pattern | None  # the pieces defined by the user, longest first
    user: frozenset[int]
    least: float  # of the scores of ordinary pieces
    most: float  # zero at least


class CharacterMap:
    """The model's map of characters: a double-array trie over bytes, and the replacements it leads to.

    A unit of the trie holds a label, an offset and whether a value follows, in fixed bit places.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.held: dict[str, tuple[str, int]] = {}

    def _longest(self, data: bytes) -> tuple[int, int]:
        """Value and length of the longest key at the start; length 0 where there is none."""
        units, found = self.units, (0, 0)
        at = self._offset(units[0])
        for n, c in enumerate(data, 1):
            at ^= c
            if at >= len(units) or units[at] & 0x800000FF != c:
                break
            leaf = units[at] >> 8 & 1
            at ^= self._offset(units[at])
            if leaf:
                found = (units[at] & 0x7FFFFFFF, n)
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def __call__(self, text: str, at: int) -> tuple[str, int]:
        """What the text starts with from a place on, replaced, and how many characters that takes."""
        ahead = text[at : at + AHEAD]
        known = self.held.get(ahead)
        if known is None:
            value, size = self._longest(ahead.encode())
            if size:
                known = self.texts[value : self.texts.index(b"\0", value)].decode(), len(ahead.encode()[:size].decode())
            else:
                known = ahead[0], 1
            if len(self.held) < WORDS_HELD:
                self.held[ahead] = known
        return known


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of one message of the model file."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        elif key & 7 == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@lru_cache(maxsize=2)
def compile_model(path: str) -> Compiled:
    """Read the pieces, their scores and kinds, and the normaliser's rules."""
    with open(path, "rb") as f:
        top = list(_fields(f.read()))
    ids, score, surface, byte_ids, unknown = {}, [], [], [0] * 256, 0
    merges, prefix, squeeze, escape, chars, defined = False, True, True, True, None, []
    normal = []
    for field, value in top:
        if field == 1:
            piece, points, kind = "", 0.0, 1
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    points = float(np.frombuffer(v, "<f4")[0])
                elif k == 3:
                    kind = v
            number = len(score)
            score.append(points)
            normal += [points] * (kind == 1)
            surface.append(piece.replace(SPACE, " ").encode() if kind in (1, 4) else b"")
            if kind in (1, 4):
                ids.setdefault(piece, number)
                defined += [piece] * (kind == 4)
            elif kind == 6:
                byte_ids[int(piece[1:-1], 16)] = number
                surface[number] = bytes([int(piece[1:-1], 16)])
            elif kind == 2:
                unknown = number
        elif field == 2:
            merges = [v for k, v in _fields(value) if k == 3][-1:] == [2]
        elif field == 3:
            for k, v in _fields(value):
                if k == 2 and v:
                    chars = CharacterMap(v)
                elif k == 3:
                    prefix = bool(v)
                elif k == 4:
                    squeeze = bool(v)
                elif k == 5:
                    escape = bool(v)
    own = re.compile("|".join(map(re.escape, sorted(defined, key=lambda p: (-len(p), p))))) if defined else None
    return Compiled(ids, score, surface, byte_ids, unknown, max(map(len, ids), default=1), merges, prefix, squeeze, escape, chars, own, frozenset(ids[p] for p in defined), min(normal, default=0.0), max([0.0, *normal]))


class Segmenter:
    """The composed transducer for one model, with the words solved so far."""

    def __init__(self, path: str):
        self.m = compile_model(path)
        self.pair: dict[str, dict[str, bool]] = {}
        self.tails: dict[str, str] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # a line end that no longer piece holds stands alone and parts the lattice
        inside = {c for p in self.m.ids if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.m.ids):
            self.cut = re.compile(r"[\s\S]+")
        else:
            self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if "\n" not in inside else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def _replaced(self, text: str) -> str:
        """The text through the character map, except for the user's pieces."""
        out, at = [], 0
        while at < len(text):
            own = self.m.defined.match(text, at) if self.m.defined else None
            part, size = (own.group(), own.end() - at) if own else self.m.chars(text, at)
            out.append(part)
            at += size
        return "".join(out)

    def normalise(self, text: str) -> str:
        if self.m.chars is not None:
            text = self._replaced(text)
        if self.m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = (" " if self.m.prefix else "") + text
        if self.m.escape:
            text = text.replace(" ", SPACE)
            # a mark that stood in the text goes with the spaces at the end
            text = text.rstrip(SPACE) if self.m.squeeze else text
        return text

    def merge(self, text: str) -> list[str]:
        """What the model's merges make of a short text: best score first, leftmost on ties."""
        ids, score, parts = self.m.ids, self.m.score, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and k not in self.m.user and (best is None or score[k] > best):
                    best, at = score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, left: str, right: str) -> bool:
        """Whether the arc from one piece to the next has a finite weight."""
        right_of = self.pair.get(left)
        if right_of is None:
            if len(self.pair) > PAIRS_HELD:
                self.pair.clear()
            right_of = self.pair[left] = {}
        known = right_of.get(right)
        if known is None:
            known = right_of[right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def tail(self, text: str) -> str:
        """The last piece of the path through a short text; beginnings are shared by many words."""
        known = self.tails.get(text)
        if known is None:
            ids, n = self.m.ids, len(text)
            # the longest pieces first: usually the first finite arc
            for start in range(max(0, n - self.m.longest), n):
                piece = text[start:]
                if (piece in ids or start == n - 1) and self.weight(self.tail(text[:start]) if start else "", piece):
                    break
            known = self.tails[text] = piece
        return known

    def path(self, word: str) -> list[str]:
        """The shortest path through the word's lattice."""
        ids, longest = self.m.ids, self.m.longest
        n = len(word)
        if not self.m.merges:
            return self._best_scores(word)
        if n <= SHORT:
            out, rest = [], word
            while rest:
                out.append(self.tail(rest))
                rest = rest[: -len(out[-1])]
            return out[::-1]
        last: list[str | None] = [""] + [None] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                if last[start] is None:
                    continue
                piece = word[start:end]
                if end - start > 1 and piece not in ids:
                    continue
                before = last[start]
                if self.weight(before, piece):
                    last[end] = piece
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _best_scores(self, word: str) -> list[str]:
        m, n = self.m, len(word)
        cost, back = [0.0] + [np.inf] * n, [0] * (n + 1)
        # as the library has it: what no piece covers costs ten more than the worst, the user's pieces win
        floor = m.least - 10.0
        for end in range(1, n + 1):
            for start in range(max(0, end - m.longest), end):
                k = m.ids.get(word[start:end])
                if k is None and end - start > 1:
                    continue
                if k is None:
                    c = cost[start] - floor
                elif k in m.user:
                    c = cost[start] - ((end - start) * m.most - 0.1)
                else:
                    c = cost[start] - m.score[k]
                if c < cost[end]:
                    cost[end], back[end] = c, start
        out, at = [], n
        while at:
            out.append(word[back[at] : at])
            at = back[at]
        return out[::-1]

    def solve(self, word: str) -> bytes:
        m, out = self.m, []
        if m.merges and m.ids.get(word) in m.user:
            return array("i", [m.ids[word]]).tobytes()
        for piece in self.path(word):
            k = m.ids.get(piece)
            if k is not None:
                out.append(k)
            else:
                fallback = [m.byte_ids[b] for b in piece.encode()]
                out += fallback if all(fallback) else [m.unknown]
        return array("i", out).tobytes()

    def words_of(self, text: str) -> list[str]:
        """Sub-lattices of a normalised text; in a merge model the user's pieces stand alone."""
        if self.m.defined is None or not self.m.merges:
            return self.cut.findall(text)
        out, at = [], 0
        for own in self.m.defined.finditer(text):
            out += [*self.cut.findall(text[at : own.start()]), own.group()]
            at = own.end()
        return out + self.cut.findall(text[at:])

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        if len(self.words) > WORDS_HELD:
            self.words, self.older = {}, self.words
            self.tails.clear()
        held, older, out = self.words, self.older, []
        for w in self.words_of(self.normalise(text)):
            ids = held.get(w)
            if ids is None:
                ids = older.get(w) or self.solve(w)
                # words as long as a text are not worth holding
                if len(w) <= SHORT:
                    held[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        surface = self.m.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def segmenter(path: str) -> Segmenter:
    """One per worker: words solved in a task serve the next."""
    return Segmenter(path)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, and whether decoding gives the text back."""
    path = model or default_model()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("restored", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = segmenter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc = batch.column("doc_id")
            i = 0
            while i < len(texts):
                # rows of one output piece: about a megabyte of text
                j, size = i, 0
                while j < len(texts) and (j == i or size < 1 << 20):
                    size += len(texts[j])
                    j += 1
                coded = [machine.encode(t) for t in texts[i:j]]
                flat = np.frombuffer(b"".join(coded), "<i4")
                ends = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
                back = [machine.decode(flat[a:b]) == t.replace(SPACE, " ") for a, b, t in zip(ends[:-1], ends[1:], texts[i:j])]
                yield pa.record_batch([doc.slice(i, j - i), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(back)], schema=schema)
                i = j

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, restored boolean")


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """Per row: doc_id and the text of ``ids``."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = segmenter(path)
        for batch in batches:
            out = [machine.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")
