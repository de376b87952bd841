"""Alignment of the tokens of two tokenizers over the same texts.

Documents are shuffled by their full text, and each different text is tokenized and aligned
once; its links count as often as there are documents with it. What a text's links add up to
is joined back to the documents by the text's SHA-256.

Byte offsets where tokens of both end cut a text into groups; a link is the pair of tokens
that end there. Texts are taken in units that neither tokenizer joins across, so each
different unit of a batch is tokenized and aligned once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.llm.spans import different
from seqsieve.plans.materialise import join_groups, materialise
from seqsieve.plans.workers import release_memory

#: Units that end in anything but a character that is surely no white space, or hold U+2581 or a NUL.
ODD = re.compile(rb"(?<![!-~])(?<![\xc3-\xdf][\x80-\xbf])\Z|\xe2\x96\x81|\0")
#: Units that make a text for the tokenizers: they are slower on one long text.
UNITS_A_TEXT = 500
#: A pair with over 1 / HOT_PAIRS of all links is broadcast; so fewer than HOT_PAIRS are, whatever the data.
HOT_PAIRS = 100_000
ALIGNED = "sha binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def byte_level_table() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable ones stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The byte-level tokenizer of a file: ids of texts, bytes of ids. Strings of special tokens in a text are plain text.

    Where ids ascend in the order of the file's merges, they are ranks, and the file's
    vocabulary is handed to the faster library that works on ranks.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, split = said["model"], said["pre_tokenizer"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][x + y] for x, y in merges]
        if said["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or order != sorted(order):
            raise ValueError(f"{path} is no byte-level tokenizer whose ids are ranks")
        letters, special = byte_level_table(), {t["content"] for t in said["added_tokens"]}
        spelt = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        self.bytes = [b""] * (max(spelt.values()) + 1)
        for raw, i in spelt.items():
            self.bytes[i] = raw
        self.model = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=spelt, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.model.encode_ordinary, texts))


class Pieces:
    """The piece tokenizer, which puts a blank before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(n))]
        self.blank = [self.model.piece_to_id("▁")]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with the blank that is added; the blank alone is a piece of its own, though the library gives nothing for an empty text."""
        return [ids or self.blank for ids in self.model.encode([t[1:] for t in texts], num_threads=1)]


def unit_bounds(raw: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Starts of the units of joined texts (firsts: where each begins): a blank behind a character that is surely no white space, printable ASCII or from U+00C0 to U+07FF, begins one.

    Pre-tokenizers keep white space with what follows, and pieces hold a blank only in front,
    so no token of either crosses such a place.
    """
    cut = np.zeros(len(raw) + 1, bool)
    plain = (raw > 32) & (raw < 127)
    plain[1:] |= (raw[1:] > 127) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
    cut[1:-1] = (raw[1:] == 32) & plain[:-1]
    cut[firsts] = True
    return np.flatnonzero(cut[:-1])


class Spelling:
    """Ids of one tokenizer with the bytes they spell."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], table: list[bytes]) -> None:
        self.encode, self.table = encode, table
        self.size = np.array(list(map(len, table)), np.int64)
        self.digits = [str(i).encode() for i in range(len(table))]

    def ids(self, texts: list[bytes]) -> np.ndarray | None:
        """Ids of some texts, one after the other, or None if they spell other ones."""
        found = self.encode([t.decode("utf-8", "surrogatepass") for t in texts])
        same = all(b"".join(map(self.table.__getitem__, ids)) == t for ids, t in zip(found, texts, strict=True))
        return np.concatenate([np.array(ids, np.int64) for ids in found]) if same else None


class Units:
    """Different units as one text, with the tokens of both tokenizers: for each unit its numbers of tokens and of groups, its links, and its groups as written."""

    def __init__(self, units: list[bytes], a: Spelling, b: Spelling) -> None:
        ids_a, ids_b, self.good = self._both(units, a, b)
        ends = np.cumsum(np.array(list(map(len, units)), np.int64) * self.good)
        end_a, end_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
        common, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        self.links = np.stack([ids_a[at_a], ids_b[at_b]], axis=1)
        upto = [np.concatenate([[0], np.searchsorted(x, ends, side="right")]) for x in (end_a, end_b, common)]
        self.n_a, self.n_b, self.n_groups = (np.diff(x) for x in upto)
        self.first_link = upto[2][:-1]
        self.text = self._written(ids_a, ids_b, at_a, at_b, upto[2], a, b)

    @staticmethod
    def _both(units: list[bytes], a: Spelling, b: Spelling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of a, ids of b, which units both spell); the others have no ids.

        Units that end so that the next one's blank can't be told from their own white space,
        and those that a tokenizer may rewrite, are taken alone, all the rest as one text.
        """
        alone = [bool(ODD.search(u)) for u in units]
        if not all(alone):
            plain = [u for u, odd in zip(units, alone, strict=True) if not odd]
            texts = [b"".join(plain[i : i + UNITS_A_TEXT]) for i in range(0, len(plain), UNITS_A_TEXT)]
            flat = a.ids(texts), b.ids(texts)
            if flat[0] is None or flat[1] is None:
                alone = [True] * len(units)
        if not any(alone):
            return *flat, np.ones(len(units), bool)
        parts, good = ([], []), np.ones(len(units), bool)
        if not all(alone):
            done = np.cumsum([0 if odd else len(u) for u, odd in zip(units, alone, strict=True)])
            cuts = [np.concatenate([[0], np.searchsorted(np.cumsum(x.size[ids]), done, side="right")]) for x, ids in ((a, flat[0]), (b, flat[1]))]
        for k, (unit, odd) in enumerate(zip(units, alone, strict=True)):
            own = [x.ids([unit]) for x in (a, b)] if odd else [ids[c[k] : c[k + 1]] for ids, c in zip(flat, cuts, strict=True)]
            good[k] = own[0] is not None and own[1] is not None
            if good[k]:
                parts[0].append(own[0])
                parts[1].append(own[1])
        return *(np.concatenate([np.zeros(0, np.int64), *p]) for p in parts), good

    @staticmethod
    def _written(ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, upto: np.ndarray, a: Spelling, b: Spelling) -> list[bytes]:
        """The groups of each unit as `a1,a2|b1;a3|b2,b3`: the tokens of both in the order of the text, each with the mark that follows it."""
        sized_a, sized_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        place_a = np.arange(len(ids_a)) + np.repeat(np.cumsum(sized_b) - sized_b, sized_a)
        place_b = np.arange(len(ids_b)) + np.repeat(np.cumsum(sized_a), sized_b)
        marks = np.zeros(len(ids_a) + len(ids_b), np.int64)
        codes = np.zeros_like(marks)
        codes[place_a], codes[place_b] = ids_a, ids_b
        marks[place_b] = 2
        marks[place_a[at_a]], marks[place_b[at_b]] = 1, 3
        tables = [[x + m for x in s.digits] for s, m in ((a, b","), (a, b"|"), (b, b","), (b, b";"))]
        starts = np.cumsum([0, *map(len, tables[:-1])])
        every = [x for t in tables for x in t]
        words = list(map(every.__getitem__, (codes + starts[marks]).tolist()))
        ends = np.concatenate([[0], np.cumsum(np.array(list(map(len, words)), np.int64))])
        last = np.concatenate([[0], np.cumsum(sized_a + sized_b)])[upto]  # tokens until each unit's end
        whole, cut = b"".join(words), ends[last].tolist()
        return [whole[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


class Aligner:
    """Aligns batches of texts."""

    def __init__(self, path_a: str, path_b: str) -> None:
        first, second = ByteLevel(path_a), Pieces(path_b)
        self.a, self.b = Spelling(first.encode, first.bytes), Spelling(second.encode, second.bytes)

    def align(self, texts: list[str]) -> pa.RecordBatch:
        """Columns of ALIGNED but sha and n, a row per text; no text is empty."""
        parts = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        firsts = np.cumsum([0, *map(len, parts)])
        raw = np.frombuffer(b"".join(parts), np.uint8)
        starts = unit_bounds(raw, firsts)
        found, kind = different(raw, starts, np.append(starts[1:], len(raw)))
        units = Units(found.to_pylist(), self.a, self.b)
        bounds = np.searchsorted(starts, firsts)
        each = np.stack([units.n_a, units.n_b, units.n_groups, units.good], axis=1).astype(np.int64)[kind]
        upto = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(each, axis=0)])
        totals = upto[bounds[1:]] - upto[bounds[:-1]]
        good = totals[:, 3] == np.diff(bounds)
        totals *= good[:, None]
        text, order, digests = units.text, kind.tolist(), []
        for x, y, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist(), strict=True):
            digests.append(hashlib.sha256(b"".join([text[k] for k in order[x:y]])[:-1]).hexdigest() if ok else "")
        codes, owner, times = self._pairs(units, kind, bounds, good)
        offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (codes >> 32, codes & 0xFFFFFFFF, times)]
        return pa.RecordBatch.from_arrays([*(pa.array(totals[:, i]) for i in (0, 1, 2, 2)), pa.array(digests, pa.string()), *lists], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])

    @staticmethod
    def _pairs(units: Units, kind: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a << 32 | b, number of its text, times) of the different links of each text that is good, by text and pair."""
        every, code = np.unique(units.links[:, 0] << 32 | units.links[:, 1], return_inverse=True)
        text = np.repeat(np.arange(len(good)), np.diff(bounds))
        use = good[text]
        kind, text = kind[use], text[use]
        n = units.n_groups[kind]
        upto = np.cumsum(n)
        place = np.repeat(units.first_link[kind] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)
        keys, times = np.unique(np.repeat(text, n) * max(1, len(every)) + code[place], return_counts=True)
        return every[keys % max(1, len(every))], keys // max(1, len(every)), times


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, *, text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """ALIGNED: a row for each different text of docs that isn't null or empty; n is the number of its rows, a, b and times are its different links with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        names = [c.split()[0] for c in ALIGNED.split(", ")]
        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // batch_bytes)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if not part.num_rows:
                    continue
                found = aligner.align(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["sha"], part["n"], *found.columns], names)
        release_memory()

    texts = docs.select(F.col(text_col).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    return texts.select(F.unhex(F.sha2("text", 256)).alias("sha"), "n", "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, rows, best): the links of each id pair over all documents, the texts that have it, and whether no pair of the same b has more."""
    links = aligned.select("n", F.inline(F.arrays_zip("a", "b", "times")))
    counts = materialise(links.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("times")).alias("count"), F.count("*").alias("rows")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", "rows", (F.col("count") == F.col("most")).alias("best"))


def link_measures(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sha, n_best, count_sum) of each text with a link.

    Pairs with over 1 / HOT_PAIRS of the rows are fewer than HOT_PAIRS, so they are broadcast,
    and a text's links meet them in its own task; the rare pairs shuffle.
    """
    total = pairs.agg(F.sum("rows")).first()[0] or 0
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    known = pairs.select("a", "b", "count", "best", (F.col("rows") > total / HOT_PAIRS).alias("hot"))
    links = aligned.select("sha", F.inline(F.arrays_zip("a", "b", "times")))
    hot = F.broadcast(known.where("hot").drop("hot"))
    met = links.join(hot, ["a", "b"], "left")
    often = met.where("best IS NOT NULL").groupBy("sha").agg(*sums)
    rare = met.where("best IS NULL").select("sha", "a", "b", "times").join(known.where("NOT hot").drop("hot"), ["a", "b"]).groupBy("sha").agg(*sums)
    return often.unionByName(rare).groupBy("sha").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a is a byte-level tokenizers file, which encodes a blank and the text; path_b a piece
    model, which adds the blank itself. Null and empty texts, and those that the tokens of
    either don't spell byte by byte, have zeros and an empty digest. A pair's count is over the
    links of all documents, copies included; among the pairs of one b all with the highest
    count are best. Repeated rows get a row each, null ids stay null, texts count whole,
    however long; other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    aligned = materialise(aligned_texts(docs, path_a, path_b, text_col=text_col))
    pairs = materialise(pair_counts(aligned.where("n_links > 0")))
    sums = link_measures(aligned.where("n_links > 0"), pairs)
    zero = F.lit(0).cast("long")
    texts = materialise(
        aligned.select("sha", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        .join(sums, "sha", "left")
        .select("sha", "n", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    )
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    without = named.where("text IS NULL OR text = ''").select("doc_id", *[zero.alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.lit("").alias("groups_sha256"))
    rows = materialise(named.where("text <> ''").select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")))
    found = join_groups(rows, texts, "sha", "n", rows.count())
    return found.select(*without.columns).unionByName(without)
