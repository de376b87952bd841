"""Ids of text spans, remembered in flat arrays; each different span of a batch is looked up once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

#: Spans whose ids are remembered, in some 40 bytes each, before all are forgotten.
LIMIT = 1_500_000


def different(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """(the different spans by their bytes, which of them each span is); spans are in order and don't overlap."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    if at[-1] < len(raw):
        step = np.zeros(len(raw) + 1, np.int8)
        step[ends] = -1
        step[starts] += 1  # a span may begin where another ends
        raw = raw[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


class SpanCache:
    """Maps spans of bytes to arrays of ids. Within a batch spans are told apart by their bytes, between batches by XXH3 of 128 bits."""

    def __init__(self, kind: np.dtype, limit: int = LIMIT) -> None:
        self.kind, self.limit = kind, limit
        self.forget()

    def forget(self) -> None:
        """Spans by their hashes, sorted by the first half, with the places of their ids in one pool."""
        self.keys, self.proof = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[bytes]], Sequence[Sequence[int]]], batch: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans in a row, number of ids of each span); encode gives the ids of spans met for the first time."""
        found, kind = different(raw, starts, ends)
        spans = found.to_pylist()
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, spans)), np.uint64).reshape(-1, 2)
        first, second = hashes[:, 0].copy(), hashes[:, 1].copy()
        if len(self.keys) > self.limit:
            self.forget()
        near = np.minimum(np.searchsorted(self.keys, first), max(0, len(self.keys) - 1))
        known = (self.keys[near] == first) & (self.proof[near] == second) if len(self.keys) else np.zeros(len(first), bool)
        at, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int32)
        at[known], size[known] = self.at[near[known]], self.size[near[known]]
        new = np.flatnonzero(~known)
        for i in range(0, len(new), batch):
            some = new[i : i + batch]
            coded = encode([spans[j] for j in some.tolist()])
            size[some] = np.fromiter(map(len, coded), np.int32, len(coded))
            ids = np.fromiter(chain.from_iterable(coded), self.kind, int(size[some].sum()))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.kind)])
            self.pool[self.used : self.used + len(ids)] = ids
            at[some] = self.used + np.cumsum(size[some]) - size[some]
            self.used += len(ids)
        if len(new):
            order = new[np.argsort(first[new], kind="stable")]
            into = np.searchsorted(self.keys, first[order])
            self.keys, self.proof = np.insert(self.keys, into, first[order]), np.insert(self.proof, into, second[order])
            self.at, self.size = np.insert(self.at, into, at[order]), np.insert(self.size, into, size[order])
        n = size[kind].astype(np.int64)
        until = np.cumsum(n)
        return self.pool[np.repeat(at[kind] - until + n, n) + np.arange(until[-1] if len(until) else 0)], n
