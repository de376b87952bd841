"""Prediction by partial matching (PPM) scores, pretrained on the whole training part of a corpus.

The model is a context trie over bytes, of a parameter order, in tables of one row per node
and following byte: the counts of all runs of order + 1 bytes of the training texts, and
their sums over ever shorter contexts. It grows with the corpus and never gathers anywhere.
Escapes follow method C (as many as bytes seen in the context), and bytes seen in a longer
context are excluded from the shorter ones.

A byte's code length depends on its run alone. So blocks of documents name their different
runs, every run of the corpus is coded once, and the code lengths return to the blocks by
one join, in which no run has more rows than there are blocks. Word counts, for the base
score, take the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.llm.spans import different
from seqsieve.plans.materialise import materialise
from seqsieve.plans.workers import release_memory

ORDER = 5
END = b"\n"
#: Bytes of text that share one list of runs and words, and that are laid out in memory at once.
BLOCK_BYTES, SLICE_BYTES = 48 << 20, 2 << 20
#: The part of the documents that is held out of training.
FOLDS, HELD_OUT = 7, 2
#: Cells of a table of runs by next byte, beyond which runs are sorted instead.
TABLE_CELLS = 1 << 26
#: Cells of a table that has a place of each: it is faster than bits, and takes five bytes a cell.
PLACE_CELLS = 1 << 24


def normal(text: bytes | None) -> bytes:
    """A text as it is coded: A-Z lower-cased, words joined by a space, and an end."""
    return b" ".join((text or b"").lower().split()) + END


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text falls into the held-out fold. A null id counts as an empty text, which doesn't."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def places(cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different numbers of cell, ascending, the place of each cell among them), by a table of all numbers below cells; of many, by a bit each and a count every eight."""
    mark = np.zeros(cells, bool)
    mark[cell] = True
    found = np.flatnonzero(mark)
    if cells <= PLACE_CELLS:
        place = np.zeros(cells, np.int32)
        place[found] = np.arange(len(found), dtype=np.int32)
        return found, place[cell]
    bits = np.packbits(mark, bitorder="little")
    del mark
    ones = np.bitwise_count(bits)
    before = np.cumsum(ones, dtype=np.int32)
    before -= ones
    eight = cell >> 3
    lower = bits[eight] & ((np.uint8(1) << (cell & 7).astype(np.uint8)) - np.uint8(1))
    return found, before[eight] + np.bitwise_count(lower)


def runs(raw: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the run of order + 1 bytes that ends at each byte from the order-th on, the different runs as numbers, ascending)."""
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    rank = np.zeros(256, np.int32)
    rank[used] = np.arange(len(used))
    last, width = rank[raw], len(used)
    index, code = last, used.astype(np.int64)
    for _ in range(order):
        last = last[1:]
        cells = len(code) * width
        if cells <= TABLE_CELLS:
            found, index = places(index[:-1] * np.int32(width) + last, cells)
        else:
            found, index = np.unique(index[:-1].astype(np.int64) * width + last, return_inverse=True)
            index = index.astype(np.int32)
        code = code[found // width] << 8 | used[found % width]
    return index, code


class Slice:
    """Some normalised texts side by side, each after order ends: their runs and words."""

    def __init__(self, texts: list[bytes], order: int) -> None:
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        gap = END * order
        raw = np.frombuffer(gap + gap.join(texts), np.uint8)
        index, self.code = runs(raw, order)
        self.first = np.cumsum(self.size) - self.size  # of each text in the runs
        inside = np.ones(len(index), bool)
        if len(texts) > 1:
            cut = (self.first + np.arange(len(texts)) * order)[1:]
            inside[(cut[:, None] - np.arange(1, order + 1)).ravel()] = False
        self.index = index[inside]
        blank = (raw == 32) | (raw == 10)
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.words, self.word = different(raw, starts, ends) if len(starts) else (pa.array([], pa.large_binary()), np.zeros(0, np.int32))
        at = order + np.arange(len(texts)) * order + self.first  # of each text in raw
        self.text_of_word = np.searchsorted(at, starts, side="right") - 1

    def run_counts(self, trained: np.ndarray) -> np.ndarray:
        """How often each run stands in trained texts; -1 for runs across the gaps between texts."""
        n = np.bincount(self.index[np.repeat(trained, self.size)], minlength=len(self.code))
        n[np.bincount(self.index, minlength=len(self.code)) == 0] = -1
        return n

    def word_counts(self, trained: np.ndarray) -> np.ndarray:
        return np.bincount(self.word[trained[self.text_of_word]], minlength=len(self.words))


def word_keys(words: list[bytes], seed: int) -> np.ndarray:
    """A negative number of each word; the end, an empty word, is the least of all."""
    key = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) >> 1 for w in words), np.int64, len(words))
    return np.where(np.fromiter(map(len, words), np.int64, len(words)) > 0, ~np.maximum(key, 1) + 1, np.iinfo(np.int64).min) if words else key


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of several lists, with the sums of their counts."""
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


class Block:
    """The different runs and words of some slices, with their counts in trained texts."""

    def __init__(self, name: int) -> None:
        self.name, self.held, self.runs, self.words, self.word_n, self.ends, self.seed = name, 0, [], [], [], 0, 0

    def add(self, part: Slice, trained: np.ndarray) -> None:
        n = part.run_counts(trained)
        self.runs.append((part.code[n >= 0], n[n >= 0]))
        if sum(len(c) for c, _ in self.runs) > 1_000_000:
            self.runs = [merged(self.runs)]
        self.words.append(part.words)
        self.word_n.append(part.word_counts(trained))
        if len(self.words) >= 8:
            self.words, self.word_n = ([x] for x in self.all_words())
        self.ends += int(trained.sum())
        self.held += int(part.size.sum())

    def all_words(self) -> tuple[pa.Array, np.ndarray]:
        """The different words so far and their counts."""
        found = pa.concat_arrays(self.words).dictionary_encode()
        return found.dictionary, np.bincount(found.indices.to_numpy(), np.concatenate(self.word_n), len(found.dictionary)).astype(np.int64)

    def vocabulary(self) -> Iterator[pa.RecordBatch]:
        code, n = merged(self.runs)
        for at in range(0, len(code), 200_000):
            yield _rows(self.name, key=code[at : at + 200_000], n=n[at : at + 200_000])
        self.runs = []
        found, counts = self.all_words()
        self.words, words = [], [b"", *found.to_pylist()]
        key = word_keys(words, self.seed)
        while len(np.unique(key)) < len(key):  # two words of a block share a number: all get new ones
            self.seed += 1
            key = word_keys(words, self.seed)
        counts = np.concatenate([[self.ends], counts])
        for at in range(0, len(words), 100_000):
            yield _rows(self.name, key=key[at : at + 100_000], word=words[at : at + 100_000], n=counts[at : at + 100_000])


OWN = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("meta", pa.binary()), ("texts", pa.binary())])
OWN_DDL = "block long, key long, word binary, n long, meta binary, texts binary"
DONE = "doc_id long, held boolean, n_tokens long, n_known long, gain double, score double, v_part long"


def _rows(block: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns["block"] = np.full(n, block)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in OWN], schema=OWN)


def read_blocks(rows: DataFrame, order: int, block_bytes: int, slice_bytes: int) -> DataFrame:
    """OWN: of each block its different runs (key 0 or more) and words (key below 0), with their counts in training texts, and its texts, packed.

    rows: doc_id, text (binary), held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, partition, blocks = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32, 0
        block, wait, size = Block(partition), [], 0

        def take() -> tuple[bytes, bytes]:
            texts = [t for _, _, t in wait]
            part = Slice(texts, order)
            block.add(part, ~np.array([h for _, h, _ in wait], bool))
            meta = np.array([(i or 0, (i is None) * 2 + h, len(t)) for i, h, t in wait], np.int64)
            return meta.tobytes(), packer.compress(b"".join(texts))

        def close(packed: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            yield from block.vocabulary()
            for meta, texts in packed:
                yield _rows(block.name, n=[block.seed], meta=[meta], texts=[texts])

        packed: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for i, text, held in zip(batch["doc_id"].to_pylist(), batch["text"], batch["held"].to_pylist(), strict=True):
                wait.append((i, held, normal(text.as_py())))
                size += len(wait[-1][2])
                if size >= slice_bytes:
                    packed.append(take())
                    wait, size = [], 0
                    if block.held >= block_bytes:
                        yield from close(packed)
                        blocks, packed = blocks + 1, []
                        block = Block(partition + blocks)
                        release_memory()
        if wait:
            packed.append(take())
        if packed:
            yield from close(packed)
        release_memory()

    return rows.mapInArrow(run, OWN_DDL)


def trie_levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """(run, n) of each order from 0 to order: counts of a context of so many bytes and the byte after it, by summing over the oldest byte."""
    levels = [materialise(counts.where("n > 0").select("run", "n"))]
    for k in range(order, 0, -1):
        levels.append(materialise(levels[-1].groupBy(F.col("run").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("run")).agg(F.sum("n").alias("n"))))
    return levels[::-1]


def code_lengths(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(run, logp): log10 probability of the last byte of each run of counts (run, n) after the others, under the trie of all counts.

    A run that training has seen is coded in its own context; the others go down the levels, each
    with the bytes that are excluded so far. A node has 256 following bytes at most, so its list
    is bounded; the lists of orders 0 and 1, 257 at most, are broadcast.
    """
    levels = trie_levels(counts, order)
    followers = [t.groupBy(F.shiftright("run", 8).alias("context")).agg(F.sum("n").alias("total"), F.collect_list(F.struct((F.col("run").bitwiseAND(F.lit(255))).alias("byte"), "n")).alias("next")) for t in levels]
    node = levels[order].groupBy(F.shiftright("run", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    seen = levels[order].join(node, F.shiftright("run", 8) == F.col("context")).select("run", F.log10(F.col("n") / (F.col("total") + F.when(F.col("kinds") < 256, F.col("kinds")).otherwise(0))).alias("logp"))
    none = F.array().cast("array<bigint>")
    todo = counts.where("n <= 0").select("run", F.lit(0.0).alias("spent"), none.alias("gone"), F.lit(None).cast("double").alias("logp"))
    for k in range(order, -1, -1):
        lists = F.broadcast(followers[k]) if k < 2 else followers[k]
        todo = todo.join(lists, F.shiftright("run", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("context"), "left")
        todo = todo.select("run", "spent", "gone", "logp", F.filter(F.coalesce("next", F.array().cast("array<struct<byte:bigint,n:bigint>>")), lambda x: ~F.array_contains("gone", x["byte"])).alias("left"))
        todo = todo.select("*", F.aggregate("left", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("total"), F.size("left").alias("kinds"), F.get(F.filter("left", lambda x: x["byte"] == F.col("run").bitwiseAND(F.lit(255))), 0)["n"].alias("hit"), F.when(F.size("left") + F.size("gone") < 256, F.size("left")).otherwise(0).alias("escapes"))
        share = lambda n: F.log10(n / (F.col("total") + F.col("escapes")))
        todo = todo.select("run", F.coalesce("logp", F.col("spent") + share(F.col("hit"))).alias("logp"), (F.col("spent") + F.when(F.col("escapes") > 0, share(F.col("escapes"))).otherwise(0.0)).alias("spent"), F.concat("gone", F.transform("left", lambda x: x["byte"])).alias("gone"))
    return seen.unionByName(todo.select("run", F.coalesce("logp", F.col("spent") - F.log10(F.greatest(F.lit(1), 256 - F.size("gone")).cast("double"))).alias("logp")))


def block_scores(order: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DONE of whole blocks (block, key, value, pack): rows sorted by block, of which those without a key have pack (n, meta, texts)."""
    at, packs, keys, values = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if packs:
            key = np.concatenate(keys)
            keys.clear()
            value = np.concatenate(values)
            values.clear()
            by = np.argsort(key, kind="stable")
            key[:] = key[by]
            value[:] = value[by]
            del by
            yield score(packs, key, value, order)
            packs.clear()
            release_memory()

    for batch in batches:
        block = batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in pairwise(cuts):
            if a == b:
                continue
            if block[a] != at:
                yield from close()
                at = block[a]
            piece = batch.slice(a, b - a)
            packs += piece["pack"].drop_null().to_pylist()
            piece = piece.select(["key", "value"]).filter(piece["key"].is_valid())
            keys.append(piece["key"].to_numpy(zero_copy_only=False).astype(np.int64))  # copies, so the batch can go
            values.append(piece["value"].to_numpy(zero_copy_only=False).astype(float))
    yield from close()


def score(packs: list[dict], key: np.ndarray, value: np.ndarray, order: int) -> pa.RecordBatch:
    """DONE of a block's packed texts, whose runs and words have values by ascending key."""
    c_end = abs(value[0])  # the end's is the least key
    unpack, out = zstandard.ZstdDecompressor(), []
    for pack in packs:
        rows = np.frombuffer(pack["meta"], np.int64).reshape(-1, 3)
        raw, ends = unpack.decompress(pack["texts"]), np.cumsum(rows[:, 2]).tolist()
        part = Slice([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], order)
        logp = value[np.minimum(np.searchsorted(key, part.code), len(key) - 1)]  # codes across gaps are looked up in vain, and unused
        own = np.abs(value[np.searchsorted(key, word_keys(part.words.to_pylist(), pack["n"]))]) if len(part.words) else np.zeros(0)
        each, n = own[part.word], len(rows)
        in_text = lambda x: np.bincount(part.text_of_word, x, n) if len(x) else np.zeros(n)  # noqa: B023,E731
        out.append((rows, in_text(np.ones(len(each))) + 1, in_text(each > 0) + (c_end > 0), in_text(np.log10(each + 1)) + np.log10(c_end + 1), np.add.reduceat(logp[part.index], part.first)))
    rows, n, n_known, gain, logp = (np.concatenate(x) for x in zip(*out, strict=True))
    v_part = np.zeros(len(rows), np.int64)
    v_part[0] = int((value[: np.searchsorted(key, 0)] > 0).sum())
    columns = [pa.array(rows[:, 0], mask=rows[:, 1] >= 2), pa.array((rows[:, 1] & 1).astype(bool)), *map(pa.array, (n.astype(np.int64), n_known.astype(np.int64), gain, logp, v_part))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DONE.split(", ")])


def score_documents(docs: DataFrame, *, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are scored whole, as words joined by a space and an end, however long. score is the
    log10 probability under the PPM model, base_score the one of add-one word counts; both learn
    from the texts that aren't held out, and score those too. A null text counts as empty (an end
    alone); a null id as training; repeated rows each train and get a row; equal texts get equal
    scores; other columns are ignored, whatever their names; an empty table gives an empty
    result. order is 1 to 6 bytes.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6: a run is one number of 64 bits")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), held_out(F.col(id_col)).alias("held"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # neighbouring partitions are read together, without a shuffle, if they are smaller than a block
    own = materialise(read_blocks(rows.coalesce(max(1, -(-total // block_bytes))), order, block_bytes, slice_bytes))
    run = own.where("key >= 0").select("block", F.col("key").alias("run"), "n")
    coded = code_lengths(materialise(run.groupBy("run").agg(F.sum("n").alias("n"))), order)
    of_runs = run.select("block", "run").join(coded, "run").select("block", F.col("run").alias("key"), F.col("logp").alias("value"))
    # a word has at most one row in a block; the first block that has it counts it as one of the vocabulary
    words = own.where("key < 0").selectExpr("block", "key", "sum(n) OVER (PARTITION BY word) AS c", "min(block) OVER (PARTITION BY word) = block AS first")
    of_words = words.select("block", "key", F.when(F.col("first"), F.col("c")).otherwise(-F.col("c")).cast("double").alias("value"))

    # blocks come one after the other, so a task holds no more than one block's keys and values; sorting keys there would take Spark longer
    packed = own.where("key IS NULL").select("block", "key", F.lit(None).cast("double").alias("value"), F.struct("n", "meta", "texts").alias("pack"))
    known = of_runs.unionByName(of_words).withColumn("pack", F.lit(None).cast(packed.schema["pack"].dataType))
    done = materialise(packed.unionByName(known).repartition("block").sortWithinPartitions("block").mapInArrow(partial(block_scores, order), DONE))
    n = own.where("key < 0").agg(F.sum("n")).first()[0] or 0
    v = done.agg(F.sum("v_part")).first()[0] or 0
    return done.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("gain") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score")
