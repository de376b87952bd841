"""SentencePiece BPE encoding and decoding by suffix-array matching.

Texts are cut into units that no piece crosses: a run of blanks and the characters up to
the next blank. A batch's different units are concatenated and indexed by a suffix array;
every piece's occurrence range is found by binary search; the ranges give the edges (start,
piece), which are sorted by position and relaxed from left to right: the piece that ends the
encoding of a prefix is the one edge whose pair with the piece before it is stable under the
model's merges. That is the BPE result itself, not the best sum of scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.llm.spans import SpanCache
from seqsieve.plans.workers import release_memory

BLANK = "▁"
#: Different units that are indexed at once.
INDEX_UNITS = 200_000
#: Pairs of pieces whose stability a worker remembers before it forgets them all.
KNOWN_PAIRS = 800_000


class Pieces:
    """The pieces of a model, as arrays of code points in sorted order, and its merge order."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {self.text[i]: i for i in normal}
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_value = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        crossing = [p for p in self.id_of if BLANK in p.lstrip(BLANK)]
        if crossing:
            raise ValueError(f"pieces run over blanks: {crossing[:3]}")
        # identity normalisation with a leading blank is what the cut into units relies on
        probe = "  a  éﬁ\t"
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("the model normalises texts")
        self.long = sorted((p for p in self.id_of if len(p) > 1))
        self.stable: dict[tuple[int, int], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Reference encoding of a short text: repeatedly merge the best-scored adjacent pair, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.id_of.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair_is_stable(self, left: str, right: str) -> bool:
        """Whether the two pieces, side by side, are their own encoding."""
        key = (left, right)
        known = self.stable.get(key)
        if known is None:
            known = self.stable[key] = self.merge(left + right) == [left, right]
        return known


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in order of the first depth code points of their suffixes, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < min(depth, n):
        shifted = np.full(n, -1, np.int64)
        shifted[: n - width] = rank[width:]
        rank = np.unique(rank * (n + 1) + shifted + 1, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable")


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the range of order whose suffixes begin with each piece, all pieces searched together, one character deeper at a time."""
    n = len(codes)
    padded = np.concatenate([codes, np.full(64, -1, codes.dtype)])
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
    longest = max(map(len, pieces), default=0)
    table = np.full((len(pieces), longest), -2, np.int64)
    for row, p in zip(table, pieces, strict=True):
        row[: len(p)] = [ord(c) for c in p]
    for depth in range(longest):
        live = np.flatnonzero((table[:, depth] != -2) & (low < high))
        if not len(live):
            break
        want = table[live, depth]

        def bound(a: np.ndarray, b: np.ndarray, right: bool) -> np.ndarray:
            a, b = a.copy(), b.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                c = padded[order[np.minimum(mid, n - 1)] + depth]
                go = open_ & ((c <= want) if right else (c < want))
                a, b = np.where(go, mid + 1, a), np.where(open_ & ~go, mid, b)
            return a

        first = bound(low[live], high[live], False)
        last = bound(first, high[live], True)
        low[live], high[live] = first, last
    return low, high


def encode_units(units: list[str], pieces: Pieces) -> list[list[int]]:
    """Ids of each unit, by the suffix array over all of them."""
    if not units:
        return []
    text = "\0".join(units) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    order = suffix_array(codes, max(map(len, pieces.long), default=1))
    low, high = occurrences(codes, order, pieces.long)
    found = high - low
    starts = order[np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(found.sum())]
    piece = np.repeat(np.arange(len(pieces.long)), found)
    sizes = np.array([len(p) for p in pieces.long], np.int64)
    ends = starts + sizes[piece]
    by_end = np.lexsort((-sizes[piece], ends))  # edges by position, longest first
    starts, piece, ends = starts[by_end].tolist(), piece[by_end].tolist(), ends[by_end]
    first = np.searchsorted(ends, np.arange(len(codes) + 1)).tolist()
    names, stable, test = pieces.long, pieces.stable, pieces.pair_is_stable
    out, begin = [], 0
    for unit in units:
        # last[i]: the piece that ends the encoding of the unit's first i characters
        last: list[str] = [""] * (len(unit) + 1)
        for i in range(1, len(unit) + 1):
            at = begin + i
            chosen = unit[i - 1]
            for e in range(first[at], first[at + 1]):
                j = starts[e] - begin
                if j < 0:
                    continue
                name = names[piece[e]]
                before = last[j]
                if j == 0:
                    ok = stable.get(name)
                    if ok is None:
                        ok = stable[name] = pieces.merge(name) == [name]
                else:
                    ok = stable.get((before, name))
                    if ok is None:
                        ok = test(before, name)
                if ok:
                    chosen = name
                    break
            last[i] = chosen
        parts, i = [], len(unit)
        while i > 0:
            parts.append(last[i])
            i -= len(last[i])
        out.append(to_ids(parts[::-1], pieces))
        begin += len(unit) + 1
    return out


def to_ids(parts: list[str], pieces: Pieces) -> list[int]:
    """Ids of pieces; a character that is no piece falls back to its bytes, or to the unknown id without byte pieces."""
    ids = []
    for p in parts:
        i = pieces.id_of.get(p)
        if i is not None:
            ids.append(i)
        elif pieces.bytes:
            ids += [pieces.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        else:
            ids.append(pieces.unknown)
    return ids


def unit_spans(raw: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the units of texts in UTF-8, joined, each with a leading blank: cut before each run of blanks, at each text's start, and around NULs."""
    blank, nul = raw == 32, raw == 0
    cut = np.zeros(len(raw) + 1, bool)
    cut[:-1] = blank & ~np.concatenate([[False], blank[:-1]]) | nul
    cut[1:] |= nul
    cut[firsts] = True
    starts = np.flatnonzero(cut[: len(raw)])
    return starts, np.append(starts[1:], len(raw)) if len(starts) else starts


class Encoder:
    """Encodes batches of texts, remembering the ids of units."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.cache = pieces, SpanCache(np.dtype("<u4"))

    def _encode_new(self, units: list[bytes]) -> list[list[int]]:
        if len(self.pieces.stable) > KNOWN_PAIRS:
            self.pieces.stable.clear()
        texts = [u.decode("utf-8", "surrogatepass").replace(" ", BLANK) for u in units]
        plain = encode_units([t for t in texts if t != "\0"], self.pieces)
        found = iter(plain)
        return [to_ids(["\0"], self.pieces) if t == "\0" else next(found) for t in texts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [b" " + t.replace(BLANK, " ").encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        first = np.cumsum([0, *map(len, parts)])
        raw = np.frombuffer(b"".join(parts), np.uint8)
        starts, ends = unit_spans(raw, first)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        ids, n = self.cache.ids(raw, starts, ends, self._encode_new, INDEX_UNITS)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, first)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of ids: pieces joined, byte pieces as UTF-8, control ids nothing, the leading blank dropped."""
    out = bytearray()
    for i in ids.tolist():
        if i in pieces.byte_value:
            out.append(pieces.byte_value[i])
        elif i not in pieces.control:
            out += pieces.text[i].encode("utf-8", "surrogatepass")
    text = out.decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(pieces_of(path))


def encode_documents(docs: DataFrame, model: str, *, batch_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int). A null text gives null, an empty text no ids.

    The text's own U+2581 is a blank to the model, as in its own encoder. Texts are encoded
    whole, however long; a batch ends after batch_chars characters or one text. Equal texts
    get equal ids, repeated rows a row each, a null id stays null; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model)
        for pdf in batches:
            for _, part in pdf.groupby(pdf["text"].str.len().fillna(0).cumsum() // batch_chars, sort=False):
                ids = encoder.encode([t or "" for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": [None if t is None else x.astype(np.int32) for t, x in zip(part["text"], ids, strict=True)]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, no ids an empty one, bytes that are no UTF-8 U+FFFD. Repeated rows get a row each; other columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [None if x is None else decode(np.asarray(x), pieces) for x in pdf["ids"]]})

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, text string")


def digest(docs: DataFrame, model: str, *, batch_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_crc32, round_trip) per row: encodes and decodes again in one pass.

    As encode_documents, but that a null text has the ids of an empty one, namely none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model)
        pieces = encoder.pieces
        table = [bytes([pieces.byte_value[i]]) if i in pieces.byte_value else b"" if i in pieces.control else p.encode().replace(BLANK.encode(), b" ") for i, p in enumerate(pieces.text)]
        for pdf in batches:
            for _, part in pdf.groupby(pdf["text"].str.len().fillna(0).cumsum() // batch_chars, sort=False):
                rows = []
                for i, t, ids in zip(part["doc_id"].astype("Int64"), part["text"], encoder.encode([t or "" for t in part["text"]]), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    back = b"".join(map(table.__getitem__, ids.tolist()))[1:]
                    rows.append((i, len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back), back == raw.replace(BLANK.encode(), b" ")))
                yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"]).astype({"doc_id": "Int64"})
        release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
