"""SimHash near-duplicates: candidates from Golay-code fuzzy hashing, exact verification, components.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Of two fingerprints at no
more than 2 differing bits, at least one segment is equal, and the segment after it (in a
ring) differs in at most 2 bits. Each segment, padded to 23 bits, is decoded by the perfect
binary Golay code [23, 12, 7] for itself and for each of its one-bit neighbours, which gives
one to six codeword indices; words at a distance of 2 or less share a one-bit neighbour and
so at least one index. A key is an equal segment with one index of the next: some 34 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqsieve.operators.components import connected_components
from seqsieve.plans.materialise import join_groups, materialise
from seqsieve.plans.workers import release_memory

#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY_POLYNOMIAL = 0b101011100011
#: (shift, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are compared pair by pair; larger buckets go the linear way.
BUCKET = 16
MAX_BITS = 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over XXH64 (seed 42) of word shingles, repeats included; 0 if there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))), repeat(42))
    return majority(np.fromiter(hashes, np.uint64, max(1, len(words) - shingle + 1)))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A null text has no word, so fingerprint zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp})
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each low half of 12 bits and then of each high half of 11 bits of a word, error of up to 3 bits of each syndrome); a word's syndrome is the exclusive or of its halves'."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - 11)
        return word

    unit = [remainder(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ unit[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ unit[12 + i]
    error = np.zeros(1 << 11, np.int32)
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return np.concatenate([low, high]), error


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within 3 bits of each 23-bit word."""
    halves, error = golay_tables()
    words = words.astype(np.int32)
    syndrome = halves[words & 0xFFF] ^ halves[(1 << 12) + (words >> 12)]
    return (words ^ error[syndrome]) >> 11


def fuzzy_keys(fp: np.ndarray) -> list[np.ndarray]:
    """The distinct keys of each fingerprint (uint64 array)."""
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    columns = []
    for z in range(3):
        near, bits = parts[(z + 1) % 3], SEGMENTS[(z + 1) % 3][1]
        for flip in [0, *(1 << i for i in range(bits))]:
            columns.append((np.int64(z) << 34) | (parts[z] << 12) | decode(near ^ flip).astype(np.int64))
    return [np.unique(row) for row in np.stack(columns, axis=1)] if len(fp) else []


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys_udf(fp: pd.Series) -> pd.Series:
    return pd.Series(fuzzy_keys(fp.to_numpy(np.int64).view(np.uint64)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ball_udf(fp: pd.Series) -> pd.Series:
    ball = np.array([0, *(1 << i for i in range(64))], dtype=np.uint64)
    return pd.Series(list((fp.to_numpy(np.int64).view(np.uint64)[:, None] ^ ball).view(np.int64)))


def shared_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp, n): the keys that n > 1 of the distinct fingerprints have."""
    keys = distinct.select("fp", F.explode(_keys_udf("fp")).alias("key"))
    sizes = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return materialise(keys.join(sizes, "key"))


def small_links(shared: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, b) at 2 or fewer differing bits that meet in a key of at most bucket fingerprints."""
    small = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return small.select(F.inline(pairs))


def _balls(shared: DataFrame, bucket: int) -> DataFrame:
    """(m): of the fingerprints of larger keys, in order, those that share a one-bit neighbour or are it; 65 at most."""
    large = shared.where(F.col("n") > bucket).select("fp").distinct()
    return large.select("fp", F.explode(_ball_udf("fp")).alias("key")).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("m")).where(F.size("m") > 1)


def ball_pairs(shared: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, b) at 2 or fewer differing bits of the fingerprints of keys of over bucket, some of them repeatedly."""
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return _balls(shared, bucket).select(F.inline(pairs))


def near_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp (no nulls; an empty table gives none) with the same components as all pairs at 2 or fewer differing bits.

    Keys of up to bucket fingerprints compare all their pairs. The fingerprints of larger keys
    instead meet in their one-bit neighbours: two lie within 2 bits exactly if they share one
    (or are each other's), no neighbour has more than 65 of them, and a chain through each
    neighbour's members gives the same components in linear space.
    """
    shared = shared_keys(distinct)
    links = small_links(shared, bucket)
    chain = _balls(shared, bucket).select(F.inline(F.transform(F.expr("slice(m, 2, size(m) - 1)"), lambda x: F.struct(F.element_at("m", 1).alias("a"), x.alias("b")))))
    return links.unionByName(chain).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Two documents are linked if their fingerprints differ in 2 or fewer bits; component_id is
    the smallest doc_id reachable. Texts without a word, null or empty, have fingerprint zero
    and are linked to each other like any others. Null ids get the component of their
    fingerprint. Repeated rows each get a row; other columns are ignored; an empty table gives
    an empty result. Links are sought between distinct fingerprints, so copies cost nothing.
    """
    rows = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = connected_components(near_links(distinct.select("fp")))
    labelled = materialise(distinct.join(found, distinct["fp"] == found["id"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component")))
    linked = labelled.where("component <> fp").select("component").distinct()
    group = labelled.join(linked, "component", "left_semi").groupBy("component").agg(F.min("first").alias("least"))
    named = materialise(labelled.join(group, "component", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")))
    out = join_groups(rows, named, "fp", "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
