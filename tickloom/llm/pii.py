"""Personal data, and the terms that reveal it.

Base spans (emails, IP addresses, cards, phone numbers) are found by patterns in every whole
text. Strings of letters and digits as random as a key are found, too, by their entropy, as secrets. The
normalised values of all are the protected entities. A term discloses an entity by their
pointwise mutual information over documents, log2(N * n(e, t) / (n(e) * n(t))), as a share of
the entity's own information log2(N / n(e)). n(e, t) counts documents that hold both, wherever
they stand, n(t) all documents with the term, N all documents.

It is acted on at two levels. In a document that names the entity, n(e, t) / n(t) is smoothed by ``PRIOR``
documents that hold the entity at its rate in the corpus: a word that stands nowhere else goes with the
entity. In other documents that would be rarity and no disclosure; there a term counts only
if the corpus proves that it tells the entity: with the exact binomial bound at ``LEVEL``, the chance of the entity in a
document with the term is ``ELSEWHERE`` or more. Terms above ``REMOVE`` are taken out, terms above ``GENERALISE``
are replaced by the class of their shape.

A term is a word without punctuation at its ends, in lower case, known by 64 bits of its hash; words of
ASCII and Latin letters are folded and hashed for a whole batch at once, others one by one. Entities that stand in the
same documents are one class, terms too, and classes are paired instead of their members, so a list of
thousands of addresses is one entity. A pair counts only if the term is rare enough for that entity.

Defined results: a null text is empty and has no spans; every row is a document, a repeated one, too, in
all counts; a row without doc_id gets base spans and secrets, is not counted and has no terms.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from . import sketch
from . import textops as tx
from .quality_rules import binomial_tail

# The patterns and the order of kinds.
KINDS = ["email", "ip", "card", "phone", "term", "secret"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SECRET = re.compile(r"[A-Za-z0-9]{24,}")
ENTROPY = 3.0  # bits a character
PRIOR = 0.5
GENERALISE, REMOVE = 0.85, 0.95
ELSEWHERE, LEVEL = 0.5, 0.05
KNOWN = 200_000  # odd words a task remembers

ALNUM = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_low:_high] = True


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, one step per '@' instead of one per character."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind in (1, 5) else _digits(value)}"


def _term(word: str) -> tuple[str, int, int]:
    """A word without punctuation at its ends, in lower case, and what was cut."""
    left, right = 0, len(word)
    while left < right and not word[left].isalnum():
        left += 1
    while right > left and not word[right - 1].isalnum():
        right -= 1
    return word[left:right].lower(), left, right


def secret_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings that mix letters and digits and are as random as keys, and touch no base span."""
    out = []
    for m in SECRET.finditer(text):
        word = m.group()
        if sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:])) < 4:
            continue
        bits = -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())
        if bits >= ENTROPY and not any(s < m.end() and m.start() < e for s, _, e in base):
            out.append((m.start(), 5, m.end()))
    return out


def _hash(raw: bytes) -> int:
    return int(tx.span_hash(tx.prefix_hash(np.frombuffer(raw, np.uint8)), np.array([0]), np.array([len(raw)]))[0])


class Folder:
    """Terms of pieces of text: hashes, byte ranges and rows. Odd words are remembered."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int, int] | None] = {}

    def odd(self, raw: bytes) -> tuple[int, int, int] | None:
        """Hash and what is cut at both ends, in bytes; None for a word that is no term."""
        if raw not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            word = raw.decode("utf-8", "replace")
            term, left, right = _term(word)
            self.known[raw] = (_hash(term.encode()), len(word[:left].encode()), len(word[right:].encode())) if len(term) >= 3 else None
        return self.known[raw]

    def terms(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, row = tx.words(data, offsets)
        low = tx.LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        low[lead[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)] + 1] += 32
        # beyond ASCII and the Latin letters of two bytes words are folded one by one
        odd = (data >= 0xC4) | (data == 0xC2)
        odd[lead[(after == 0x97) | (after == 0xB7)]] = True
        odd_before = np.concatenate(([0], np.cumsum(odd, dtype=np.int32)))
        strange = odd_before[ends] > odd_before[starts]
        left, right = starts.copy(), ends.copy()
        for edge, step in ((left, 1), (right, -1)):
            live = np.flatnonzero(~strange)
            while len(live):
                # a word of marks alone is eaten up
                at = np.clip(edge[live] if step > 0 else edge[live] - 1, 0, len(data) - 1)
                live = live[(left[live] < right[live]) & ~ALNUM[data[at]]]
                edge[live] += step
        hashes = tx.span_hash(tx.prefix_hash(low), left, right)
        inner = np.concatenate(([0], np.cumsum((data & 0xC0) == 0x80, dtype=np.int32)))
        whole = (right - left) - (inner[right] - inner[left]) >= 3
        for i in np.flatnonzero(strange).tolist():
            found = self.odd(data[starts[i] : ends[i]].tobytes())
            whole[i] = found is not None
            if found is not None:
                hashes[i], left[i], right[i] = found[0], starts[i] + found[1], ends[i] - found[2]
        use = np.flatnonzero(whole)
        return hashes[use], left[use], right[use], row[use]


def _places(data: np.ndarray) -> np.ndarray:
    """The code point at every byte, and the number of all at the end."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def _free(start: np.ndarray, stop: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which ranges touch no span."""
    if not spans:
        return np.ones(len(start), bool)
    begin, reach = np.array([s[0] for s in spans]), np.maximum.accumulate([s[2] for s in spans])
    ahead = np.searchsorted(begin, stop, "left")
    return (ahead == 0) | (reach[np.maximum(ahead - 1, 0)] <= start)


def row_terms(folder: Folder, text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end, in code points, of every term of a text that touches no span."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    hashes, left, right, _ = folder.terms(data, np.array([0, len(data)]))
    place = _places(data)
    # bytes that continue a character count to it
    start, stop = place[left], place[right]
    free = _free(start, stop, spans)
    return hashes[free], start[free], stop[free]


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


_HELD = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.int64()))])


def _find_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with an entity: its names, and the distinct terms of the whole text."""
    folder = Folder()
    for batch in batches:
        rows = []
        for doc, key, text in zip(*(_column(batch, c) for c in ("doc_id", "text_key", "text"))):
            base = base_spans(text)
            if spans := sorted(base + secret_spans(text, base)):
                rows.append((doc, key, sorted({entity(k, text[s:e]) for s, k, e in spans}), np.unique(row_terms(folder, text, spans)[0]).view(np.int64)))
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _HELD)], schema=_HELD)


def _test(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = (hashes & np.uint64((1 << sketch.MARK_BITS) - 1)).astype(np.int64)
    return (bits[cell >> 5] >> (cell & 31).astype(np.uint32)) & 1 == 1


def _counts(table: Broadcast):
    """How many rows hold each marked term, summed over a batch."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            seen = []
            for _, _, data, offsets in tx.pieces(batch.column("text")):
                if not len(data):
                    continue
                hashes, _, _, row = folder.terms(data, offsets)
                hit = _test(table.value, hashes)
                hashes, row = hashes[hit], row[hit]
                by = np.lexsort((row, hashes))
                hashes, row = hashes[by], row[by]
                new = np.ones(len(by), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                seen.append(hashes[new])
            if seen:
                terms, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.record_batch([terms.view(np.int64), n], schema=schema)

    return run, "term bigint, n bigint"


def _occurrences(table: Broadcast):
    """Where marked terms stand in any document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            ids, keys = _column(batch, "doc_id"), _column(batch, "text_key")
            for i, _, data, offsets in tx.pieces(batch.column("text")):
                if not len(data):
                    continue
                hashes, _, _, row = folder.terms(data, offsets)
                for k in np.unique(row[_test(table.value, hashes)]).tolist():
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
                    base = base_spans(text)
                    terms, start, stop = row_terms(folder, text, sorted(base + secret_spans(text, base)))
                    hit = _test(table.value, terms)
                    if hit.any():
                        n = int(hit.sum())
                        yield pa.record_batch([pa.array([ids[i + k]] * n, pa.int64()), pa.array([keys[i + k]] * n, pa.int64()), terms[hit].view(np.int64), start[hit].astype(np.int32), stop[hit].astype(np.int32)], schema=schema)

    return run, "doc_id bigint, text_key bigint, term bigint, start int, stop int"


def _shape(term: str) -> str:
    return "[number]" if term.isdigit() else "[code]" if any(c.isdigit() for c in term) else "[word]"


def _rewrite(text: str, spans: list[tuple[int, int, int]], removed: set[int]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start < at:
            if end > at:  # overlapping kinds: the later one hides the rest
                at = end
            continue
        out.append(text[at:start])
        if kind != 4:
            out.append(f"[{KINDS[kind]}]")
        elif start not in removed:
            out.append(_shape(text[start:end]))
        at = end
    out.append(text[at:])
    return "".join(out)


_OUT = pa.schema(
    [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_term", pa.int64()), ("n_secret", pa.int64()), ("n_spans", pa.int64()), ("clean_text", pa.string())]
)


def _sanitise(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            rows = []
            for doc, text, terms in zip(*(_column(batch, c) for c in ("doc_id", "text", "found"))):
                base = base_spans(text)
                fixed = sorted(base + secret_spans(text, base))
                name = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
                found: dict[tuple[int, int, int], float] = {}
                own = {t["term"]: t["share"] for t in terms or () if t["start"] is None}
                for t in terms or ():
                    if t["start"] is not None:
                        found[t["start"], 4, t["stop"]] = t["share"]
                if own:
                    hashes, start, stop = row_terms(folder, text, fixed)
                    hashes = hashes.view(np.int64)
                    for i in np.flatnonzero(np.isin(hashes, np.array(list(own), np.int64))).tolist():
                        key = (int(start[i]), 4, int(stop[i]))
                        found[key] = max(found.get(key, 0.0), own[int(hashes[i])])
                spans = sorted([*fixed, *found])
                removed = {s[0] for s, share in found.items() if share >= REMOVE}
                counts = [sum(k == i for _, k, _ in base) for i in range(4)]
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                rows.append((doc, *counts, hashlib.sha256(",".join(name).encode()).hexdigest(), said, len(found), len(fixed) - len(base), len(spans), _rewrite(text, spans, removed) if spans else text))
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)]
                kept = [batch.column(f"kept_{i}") for i in range(len(carry))]
                yield pa.record_batch(columns + kept, names=[*_OUT.names, *carry])

    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_t: in how many rows each of some terms occurs, over the whole corpus."""
    found = docs.select("text").mapInArrow(*_counts(sketch.bitmap(F.col("term"), terms)))
    return found.groupBy("term").agg(F.sum("n").alias("n_t")).join(terms, "term", "left_semi")


def disclosures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, term, share of terms that count in documents naming an entity; term, share of those that count everywhere."""
    docs = docs.where("doc_id IS NOT NULL")
    held = docs.mapInArrow(_find_entities, "doc_id bigint, text_key bigint, entities array<string>, terms array<bigint>")
    held = _stored(held.withColumn("row", F.monotonically_increasing_id()), "entities")
    total = float(max(docs.count(), 1))
    n = F.lit(total)
    mark = F.bit_xor(F.xxhash64("row"))
    # entities, and terms, that stand in the same rows are one class
    named = held.select("row", F.explode("entities").alias("entity"))
    kinds = named.groupBy("entity").agg(mark.alias("e_rows"), F.count("*").alias("n_e"))
    entities = _stored(named.join(kinds, "entity").select("row", "e_rows", "n_e").distinct(), "entity-classes")
    # n(e, t) <= n(e), so above the threshold n(t) <= n(e) * (N / n(e)) ** (1 - GENERALISE); smoothing only lowers a positive share
    reach = F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(1 - GENERALISE)) * 1.001 + 1
    widest = entities.agg(F.max(reach)).first()[0] or 0.0
    words = held.select("row", F.explode("terms").alias("term"))
    rare = term_counts(docs, words.select("term").distinct()).where(F.col("n_t") <= widest)
    words = words.join(rare, "term")
    kinds = words.groupBy("term", "n_t").agg(mark.alias("t_rows"), F.count("*").alias("n_held"))
    words = _stored(words.select("row", "term").join(kinds, "term"), "terms")
    a_term = ["t_rows", "n_held", "n_t"]
    pairs = _stored(entities.join(words.select("row", *a_term).distinct(), "row").where(F.col("n_t") <= reach), "pairs")
    counted = pairs.groupBy("e_rows", "n_e", *a_term).agg(F.count("*").alias("n_et"))
    own = F.log2(n / F.col("n_e"))
    rate = F.col("n_e") / n
    shared = F.log2((F.col("n_et") + PRIOR * rate) / ((F.col("n_t") + PRIOR) * rate))
    known = counted.withColumn("share", F.when(own > 0, shared / own).otherwise(0.0)).where(F.col("share") >= GENERALISE)
    known = _stored(known, "disclosing")
    here = pairs.join(known.drop("n_et"), ["e_rows", "n_e", *a_term]).groupBy("row", *a_term).agg(F.max("share").alias("share"))
    here = words.join(here, ["row", *a_term]).select("row", "term", "share").join(held.select("row", "doc_id", "text_key"), "row")
    proven = binomial_tail(F.col("n_t") - F.col("n_et"), F.col("n_t"), 1 - ELSEWHERE) <= LEVEL
    sure = known.where((F.col("n_et") > ELSEWHERE * F.col("n_t")) & proven).groupBy(a_term).agg(F.max("share").alias("share"))
    anywhere = words.select("term", *a_term).distinct().join(sure, a_term).select("term", "share")
    return here.select("doc_id", "text_key", "term", "share"), anywhere


def found_terms(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, found: terms that count in all of a text (no start), and single occurrences."""
    here, anywhere = disclosures(docs)
    anywhere = _stored(anywhere, "anywhere")
    spots = docs.where("doc_id IS NOT NULL").mapInArrow(*_occurrences(sketch.bitmap(F.col("term"), anywhere))).join(anywhere, "term")
    none = F.lit(None).cast("int")
    both = here.withColumns({"start": none, "stop": none}).unionByName(spots).distinct()
    return both.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("term", "start", "stop", "share")).alias("found"))


def sanitise(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Per row: base counts and digest, all spans, counts of terms, secrets and spans, clean_text, and the columns to carry."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), *keep)
    terms = found_terms(rows.select("doc_id", "text", "text_key"))
    kind = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_term bigint, n_secret bigint, n_spans bigint, clean_text string"
    kind += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return sketch.with_found(rows, terms, _sanitise(list(carry)), kind)
