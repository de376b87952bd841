"""Mixture-controlled packing by deficit round-robin over source queues.

A round gives every source a quantum of its target share times the window; a segment is
served in the first round in which the quanta granted so far cover it and all before it in
its queue. So the credit that a queue has left after a window is its deficit, carried to
the next window, and for backlogged queues the round of a segment is simply

    round = ceil(tokens up to the segment's end in its queue / quantum of its source)

which needs no loop over windows: queue positions come from two-level prefix sums, and the
deficits hold across windows and partitions alike. Segments in order of (round, source,
position) form one stream, which is cut into sequences. A source that has run dry is in no
later round, so these are shorter and the stream holds the others' quanta in their old
proportions: what it leaves is passed on by the order itself. Several rounds make a window of
the written stream, so that each window, wherever it begins, holds the targets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.llm.spans import SpanCache
from seqsieve.plans.materialise import materialise
from seqsieve.plans.workers import release_memory

def _marked(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


BLANKS, MARKS, PLAIN = _marked(b" \t\n\v\f\r"), _marked(b".,"), _marked(b"abcdefghijklmnopqrstuvwxyz0123456789")


def word_spans(raw: np.ndarray, closing: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words between ASCII blanks; with closing, a stop or comma that ends a word after a letter or digit is a word of its own."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = np.concatenate([[True], BLANKS[raw], [True]])
    cut = np.zeros(len(raw) + 1, bool)
    if closing:
        cut[1:-1] = MARKS[raw[1:]] & PLAIN[raw[:-1]] & blank[3:]
    starts = np.flatnonzero(~blank[1:-1] & (blank[:-2] | cut[:-1]))
    ends = np.flatnonzero(~blank[1:-1] & (blank[2:] | cut[1:])) + 1
    return starts, ends


class WordEncoder:
    """Encodes texts by a tokenizers file whose pre-tokenizer never joins across ASCII white space.

    So a text's ids are those of its words, and each different word of a batch is looked up
    once. Tokenizers that lower-case letters and cut runs of marks from runs of letters have
    case and closing marks taken off first, which leaves fewer different words. Added tokens
    are found in the text as it stands, before any of that, so a text that holds one, in
    whatever case, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added) or b"(?!)", re.I)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.plain = self._ids("Thing, x.") == self._ids("thing , x .")
        self.cache = SpanCache(self.kind)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes of the encoder's kind."""
        whole = {i: np.array(self._ids(t.decode("utf-8", "replace")), self.kind).tobytes() for i, t in enumerate(texts) if self.added.search(t)}
        if whole:
            texts = [b"" if i in whole else t for i, t in enumerate(texts)]
        joined = b"\n".join(texts)
        if self.plain:
            joined = joined.lower()
        raw = np.frombuffer(joined, np.uint8)
        starts, ends = word_spans(raw, self.plain)
        if not len(starts):
            return [whole.get(i, b"") for i in range(len(texts))]
        ids, n = self.cache.ids(raw, starts, ends, self._encode_words)
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])  # where each text starts in joined
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, first)]
        return [whole.get(i) or ids[a:b].tobytes() for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def _chunks(pdf: pd.DataFrame, size: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Slices of a batch of at most about size characters, one row at least."""
    big = pdf["text"].str.len().fillna(0).cumsum() // size
    for _, part in pdf.groupby(big, sort=False):
        yield part


def token_segments(docs: DataFrame, tokenizer: str, *, sequence: int, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(rid, doc_id, source, start, length, doc_tokens, ids): each text's ids and the end id, in segments of at most sequence ids, compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = _encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        rid, end = TaskContext.get().partitionId() << 40, np.array([end_id], encoder.kind).tobytes()
        wide = encoder.kind.itemsize
        for batch in batches:
            for pdf in _chunks(batch):
                out = []
                coded = encoder.encode([("" if t is None else t).encode("utf-8", "surrogatepass") for t in pdf["text"]])
                for i, source, ids in zip(pdf["doc_id"].astype("Int64"), pdf["source"], coded, strict=True):
                    ids += end
                    n = len(ids) // wide
                    for start in range(0, n, sequence):
                        part = ids[start * wide : (start + sequence) * wide]
                        out.append((rid, i, source, start, len(part) // wide, n, packer.compress(part)))
                        rid += 1
                yield pd.DataFrame(out, columns=["rid", "doc_id", "source", "start", "length", "doc_tokens", "ids"]).astype({"doc_id": "Int64"})
        release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    return rows.mapInPandas(run, "rid long, doc_id long, source string, start long, length long, doc_tokens long, ids binary")


def queue_ends(segments: DataFrame, rows: int) -> DataFrame:
    """segments with end: tokens of its queue (source) up to and with the segment, in order of (bucket, rid).

    About sqrt(rows) buckets cut each queue, so that neither a bucket nor the list of a
    queue's buckets is ever large, not even for a source with most rows.
    """
    buckets = max(1, math.isqrt(rows))
    cut = segments.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    totals = cut.groupBy("source", "bucket").agg(F.sum("length").alias("tokens"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("head"))
    within = Window.partitionBy("source", "bucket").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("part", F.sum("length").over(within))
    return own.join(heads, own["source"].eqNullSafe(heads["_s"]) & (own["bucket"] == heads["_b"])).withColumn("end", F.col("head") + F.col("part")).drop("_s", "_b", "head", "part", "bucket")


def quanta(segments: DataFrame, round_tokens: int, targets: Mapping[str, float] | None, temperature: float) -> DataFrame:
    """(_source, quantum): tokens that a round grants each source, null for a source that is to come after all others."""
    given = {k: v for k, v in (targets or {}).items() if k is not None}
    if any(v < 0 for v in given.values()) or sum(given.values()) > 1 + 1e-9:
        raise ValueError("targets must be shares of 0 to 1 that add up to 1 at most")
    named = F.coalesce(F.col("source").isin(*given), F.lit(False)) if given else F.lit(False)
    queues = segments.groupBy("source").agg(F.pow(F.sum("length"), F.lit(float(temperature))).alias("weight")).withColumn("named", named)
    rest = queues.where("NOT named").agg(F.sum("weight")).first()[0] or 1.0
    share = F.col("weight") / rest * max(0.0, 1 - sum(given.values()))
    if given:
        share = F.when(F.col("named"), F.try_element_at(F.create_map(*(F.lit(x) for k, v in given.items() for x in (k, float(v)))), "source")).otherwise(share)
    return queues.select(F.col("source").alias("_source"), F.when(share > 0, share * round_tokens).alias("quantum"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    sequence: int = 4096,
    window: int = 16,
    rounds: int = 16,
    end_id: int = 2,
    targets: Mapping[str, float] | None = None,
    temperature: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (compressed), doc_tokens, sequence_id, offset, window, source.

    targets gives sources their shares of the tokens of each window of window sequences; what
    they leave of 1 goes to the other sources, in proportion to their tokens to the power of
    temperature (1: as the corpus, 0: all alike). A share of 0, given or left, means after all
    others. A window is filled by rounds rounds. A source that has run dry leaves its share to
    the others in their proportions. All sequences but the last are full. A null text or one
    without tokens is the end id alone; a null source is a queue of its own, which targets
    can't name; null ids stay null; repeated rows are packed each; texts are packed whole,
    however long; other columns are ignored, whatever their names; an empty table gives no
    pieces.
    """
    segments = materialise(token_segments(docs, tokenizer, sequence=sequence, end_id=end_id, id_col=id_col, text_col=text_col, source_col=source_col))
    narrow = segments.select("rid", "source", "length")
    rows = segments.count()
    shares = quanta(narrow, max(1, sequence * window // rounds), targets, temperature)
    ended = queue_ends(narrow, rows)
    turn = ended.join(shares, ended["source"].eqNullSafe(shares["_source"])).select("rid", "source", "length", "end", F.coalesce(F.ceil(F.col("end") / F.col("quantum")), F.lit(LAST)).alias("round"))
    turn = materialise(turn)
    ordered = turn.repartitionByRange("round", "source", "end").sortWithinPartitions("round", "source", "end")
    ordered = materialise(ordered.select("*", F.spark_partition_id().alias("part")).withColumn("inside", F.sum("length").over(Window.partitionBy("part").orderBy("round", "source", "end").rowsBetween(Window.unboundedPreceding, -1))))
    sums = ordered.groupBy("part").agg(F.sum("length").alias("tokens"))  # one row per partition of the range shuffle
    firsts = sums.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placed = ordered.join(F.broadcast(firsts), "part").select("rid", (F.col("first") + F.coalesce("inside", F.lit(0))).alias("at"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            out = []
            for doc, source, start, length, total, ids, at in zip(*(pdf[c] for c in ("doc_id", "source", "start", "length", "doc_tokens", "ids", "at")), strict=True):
                plain = unpack.decompress(ids)
                wide, done = len(plain) // length, 0
                while done < length:
                    n = min(length - done, sequence - (at + done) % sequence)
                    part = plain[done * wide : (done + n) * wide]
                    crc = zlib.crc32(np.frombuffer(part, f"<u{wide}").astype("<u4").tobytes())
                    out.append((doc, source, start + done, n, crc, total, (at + done) // sequence, (at + done) % sequence, (at + done) // (sequence * window), wide, packer.compress(part)))
                    done += n
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return segments.join(placed, "rid").select("doc_id", "source", "start", "length", "doc_tokens", "ids", "at").mapInPandas(cut, PIECES)


#: The round of sources without a share.
LAST = 1 << 62
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, id_bytes int, ids binary"


def piece_ids(ids: bytes, id_bytes: int) -> np.ndarray:
    """The ids of a piece as unsigned 32-bit integers."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), f"<u{id_bytes}").astype(np.uint32)
